"""Text functions: white space, newlines, lossy decoding, base64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filter_excessive_newlines(s: Column) -> Column:
    """Runs of newlines are cut to two; nothing else changes."""
    return F.regexp_replace(s, r"\n{3,}", "\n\n")


def clean_whitespace(s: Column) -> Column:
    """Unicode white space collapses to one space, none stands beside a newline, and both ends are trimmed.

    Newlines in direct succession are cut to two. Runs that other white space interrupts aren't, since the order of
    the steps is part of the function: the cut comes first.
    """
    s = filter_excessive_newlines(s)
    # Only runs that change are matched: anything but one plain space, and newlines with a space beside them.
    s = F.regexp_replace(s, r"(?U) *+[\s&&[^\n ]][\s&&[^\n]]*+| {2,}+", " ")
    s = F.regexp_replace(s, r" (\n++) ?|(\n++) ", "$1$2")
    return F.regexp_replace(s, r"\A[ \n]+|[ \n]+\z", "")


def lossy(body: Column) -> Column:
    """Bytes as text, with U+FFFD for what isn't UTF-8."""
    return F.make_valid_utf8(body.cast("string"))


def base64_text(s: Column) -> Column:
    """Text of a base64 string, white space ignored; null if it isn't base64 or not UTF-8.

    Four signs at a time give three bytes. An equals sign counts as a zero wherever it stands; as the third or fourth of
    its four it leaves out the second or third byte.
    """
    bare = F.regexp_replace(s, r"(?U)\s+", "")

    def bytes_of(four: Column) -> Column:
        digits = F.hex(F.try_to_binary(F.translate(four, "=", "A"), F.lit("base64")))
        second = F.when(F.substring(four, 3, 1) != "=", F.substring(digits, 3, 2)).otherwise("")
        third = F.when(F.substring(four, 4, 1) != "=", F.substring(digits, 5, 2)).otherwise("")
        return F.concat(F.substring(digits, 1, 2), second, third)

    plain = F.try_to_binary(bare, F.lit("base64"))
    fours = F.transform(F.regexp_extract_all(bare, F.lit(r"(?s).{4}"), F.lit(0)), bytes_of)
    inner = F.rlike(bare, F.lit("=[^=]|=={2}|^={1,2}$")) | F.contains(bare, F.lit("==="))
    odd = F.when(~F.exists(fours, lambda x: x.isNull()), F.unhex(F.array_join(fours, "")))
    return F.when(F.octet_length(bare) % 4 == 0, F.try_validate_utf8(F.when(inner, odd).otherwise(plain).cast("string")))
