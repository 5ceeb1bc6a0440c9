"""File systems that tasks and the driver open by themselves, by path or URI (local, and what pyarrow reaches)."""

from __future__ import annotations

import re

from pyarrow import fs


def store(where: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    local = re.sub(r"^file:/+", "/", where)
    if "://" not in local:
        return fs.LocalFileSystem(), local.rstrip("/") or "/"
    system, path = fs.FileSystem.from_uri(where)
    return system, path.rstrip("/")


def files_under(system: fs.FileSystem, path: str) -> list[tuple[str, int]]:
    """``(path, size)`` of a file, or of all files below a folder, by path; nothing where neither is."""
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File)
