"""Opening dumps wherever they are: local and mounted paths, and addresses of stores that Arrow reads (hdfs, s3, gs, abfs)."""

from __future__ import annotations

import io
from typing import BinaryIO

BUFFER = 1 << 18


def opened(path: str) -> BinaryIO:
    """A file to read, seek and read lines from; the same call serves driver and executors."""
    scheme, mark, rest = str(path).partition("://")
    if not mark or scheme == "file":
        return open(rest if mark else path, "rb", buffering=BUFFER)
    return stored(path)


def stored(uri: str) -> BinaryIO:
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(uri)
    return io.BufferedReader(system.open_input_file(place), BUFFER)
