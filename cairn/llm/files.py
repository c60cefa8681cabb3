"""Files of any file system that pyarrow knows, by URI or path, as executors write and read them."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    # Hadoop writes file:/x for file:///x
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def create(folder: str, name: str, suffix: str):
    """An output stream to a new file of a name that no other attempt uses, and its path."""
    system, inner = _at(folder)
    system.create_dir(inner, recursive=True)
    leaf = f"{name}-{uuid.uuid4().hex}{suffix}"
    return system.open_output_stream(posixpath.join(inner, leaf), compression=None), f"{folder.rstrip('/')}/{leaf}"


def open_input(path: str):
    """A seekable input file."""
    system, inner = _at(path)
    return system.open_input_file(inner)


def listing(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """Paths and sizes of the files below a folder (or of the one file) with one of the suffixes, sorted."""
    system, inner = _at(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    head = path.rstrip("/")
    return sorted((head + x.path[len(inner.rstrip("/")) :], x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(suffixes))
