"""Byte streams of files on any file system that Arrow can open, for use inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes held at a time.
BLOCK = 4 << 20


def _located(path: str):
    """File system and path within it of ``file:/a``, ``/a``, ``hdfs://...`` or ``s3a://...``."""
    from pyarrow import fs
    path = re.sub(r"^file:/+", "/", path)
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def open_file(path: str):
    """Seekable input of the file."""
    system, inner = _located(path)
    return system.open_input_file(inner)


def blocks(path: str, size: int = BLOCK) -> Iterator[bytes]:
    """The file's bytes in order, ``size`` at a time."""
    with open_file(path) as source:
        while part := source.read(size):
            yield part


def create_file(path: str):
    """Output stream that replaces the file; folders above it are made."""
    system, inner = _located(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner)
