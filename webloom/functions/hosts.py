"""Hosts and paths by the URL standard, for one URL at a time: what the live sources decide by on their executors.

The columns of ``webloom.functions.url`` do the same in Catalyst; tests hold one against the other.
"""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote_to_bytes

from webloom.functions.reserved import RESERVED_OWNERS

ENDS, BREAKS = re.compile(r"^[\x00-\x20]+|[\x00-\x20]+\Z"), re.compile(r"[\t\n\r]")
AUTHORITY = re.compile(r"https?:[/\\]*([^/\\?#]*)([^?#]*)")
FORBIDDEN = re.compile(r"[\x00-\x20\x7f<>^|%\"`{}\\#/:?@\[\]]")
#: What a name's dots may look like.
DOTS = re.compile("[。．｡]")
#: Signs that a name may hold but that aren't kept: soft hyphen, joiners, variation selectors and their like.
DROPPED = re.compile(r"[\u00ad\u034f\u1806\u180b-\u180d\u200b-\u200d\u2060\ufe00-\ufe0f\ufeff]")
#: What is percent-encoded in a path.
ENCODED = re.compile(r"[\x00-\x20\x22<>`{}\x7f]|[^\x00-\x7F]")


def number(part: str) -> int | None:
    """A part of a numeric address: decimal, octal after 0, hexadecimal after 0x; nothing behind the prefix is 0."""
    base, digits = (16, part[2:]) if part[:2] in ("0x", "0X") else (8, part[1:]) if len(part) > 1 and part[0] == "0" else (10, part)
    if not digits:
        return 0 if base != 10 else None
    if not digits.isascii() or not re.fullmatch({16: "[0-9A-Fa-f]+", 8: "[0-7]+", 10: "[0-9]+"}[base], digits):
        return None
    return int(digits, base)


def numeric(host: str) -> bool:
    """Whether the last label makes the host a numeric address: digits, or what ``number`` reads."""
    labels = host.split(".")
    last = labels[-2] if labels[-1] == "" and len(labels) > 1 else labels[-1]
    return bool(last) and (last.isascii() and last.isdigit() or number(last) is not None)


def address(host: str) -> str | None:
    """A numeric host of one to four parts in its common form; None if it is none."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    values = [number(p) for p in parts]
    if len(parts) > 4 or any(v is None for v in values):
        return None
    *first, last = values
    if any(v > 255 for v in first) or last >= 256 ** (5 - len(parts)):
        return None
    whole = last + sum(v * 256 ** (3 - i) for i, v in enumerate(first))
    return ".".join(str(whole >> s & 255) for s in (24, 16, 8, 0))


def label(text: str) -> str | None:
    """A mapped label in its ASCII form. None if it can't be one."""
    if text.isascii():
        return text
    out = "xn--" + text.encode("punycode").decode()
    return None if len(out) > 63 or any(unicodedata.category(c) in ("Cn", "Co", "Cs", "Cc", "Zs", "Zl", "Zp") for c in text) else out


def ascii_host(host: str) -> str | None:
    """A percent-decoded host name, in any letters, as it is asked for; None if it isn't valid.

    Letters are folded and composed (compatibility forms too, so a sharp s is ss and a final sigma a sigma), other dots
    are dots, invisible signs go, labels become Punycode; numeric addresses get their common form.
    """
    name = host.lower()
    if not name.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", DROPPED.sub("", DOTS.sub(".", host))).casefold())
        labels = text.split(".")
        found = [label(p) for p in labels]
        if any(p is None for p in found) or not all(labels[:-1]):
            return None
        name = ".".join(found)
    return None if not name or FORBIDDEN.search(name) else address(name) if numeric(name) else name


def bracketed(host: str) -> str | None:
    import ipaddress

    try:
        return f"[{ipaddress.IPv6Address(host[1:-1]).compressed}]" if "%" not in host else None
    except ValueError:
        return None


def parsed(url: str) -> tuple[str, str] | None:
    """Host and normalised path of an http(s) URL; None if the URL isn't valid."""
    found = AUTHORITY.match(BREAKS.sub("", ENDS.sub("", url)))
    place = found and re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(.*))?", found[1].rpartition("@")[2], re.S)
    if not place:
        return None
    name, port = place.groups()
    if not name or port and not (port.isascii() and port.isdigit() and len(port) < 10 and int(port) < 65536):
        return None
    try:
        host = bracketed(name) if name.startswith("[") else ascii_host(unquote_to_bytes(name).decode())
    except UnicodeDecodeError:
        host = None
    return None if host is None else (host, path(found[2]))


def path(raw: str) -> str:
    """A path without dot segments, percent-encoded, beginning with a slash or empty."""
    out: list[str] = []
    first, *rest = raw.replace("\\", "/").split("/")
    for i, part in enumerate(rest):
        plain = re.sub("%2e", ".", part, flags=re.I)
        if plain == "..":
            out = out[:-1]
        elif plain != ".":
            out.append(part)
        if plain in (".", "..") and i == len(rest) - 1:
            out.append("")
    made = "/" + "/".join(out) if rest else first
    return ENCODED.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), made)


def has_scheme(url: str) -> bool:
    return url.startswith(("http://", "https://"))


def refused(url: str | None, allow: tuple[str, ...], block: tuple[str, ...]) -> str | None:
    """The first check that a URL fails, in the words of a capture's net_error: missing, scheme, blocked; else None."""
    if not url:
        return "missing"
    if not has_scheme(url) or parsed(url) is None:
        return "scheme"
    if allow and not url.startswith(allow) or block and url.startswith(block):
        return "blocked"
    return None


def repository(url: str) -> tuple[str, str] | None:
    """Owner and name of a repository's page on the code host, else None."""
    found = parsed(url)
    if not found or found[0] != "github.com" or not has_scheme(url):
        return None
    parts = found[1].split("/")
    fits = len(parts) == 3 and parts[1] and parts[2] and parts[1] not in RESERVED_OWNERS
    return (parts[1], parts[2]) if fits else None
