"""Files that tasks read and write by themselves."""

from __future__ import annotations

from urllib.parse import quote

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, whose characters need not be escaped, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe="/:@%=")) if "://" in path else (fs.LocalFileSystem(), path)
