"""Places in file systems, as Python tasks open them."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it of a URI (``file:``, ``hdfs:``, ``s3:`` and what else pyarrow knows) or of a path that all machines share."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path.rstrip("/"))
