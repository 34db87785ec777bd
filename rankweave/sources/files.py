"""Files of any store that Spark can use, opened in Python."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.fs as pafs

#: Schemes that Spark uses for stores that Arrow knows by another one.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it: Arrow's own, or Hadoop's client for a scheme that Arrow lacks."""
    parts = re.match(r"([a-z][a-z0-9+.-]*):/(?:/([^/]*))?", path)
    if not parts:
        return pafs.LocalFileSystem(), path
    scheme = SCHEMES.get(parts[1], parts[1])
    try:
        return pafs.FileSystem.from_uri(scheme + path[len(parts[1]) :])
    except pa.ArrowInvalid:
        return pafs.HadoopFileSystem(f"{scheme}://{parts[2] or ''}"), path[parts.end() :] or "/"


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder in order of their names, without hidden ones."""
    fs, root = open_fs(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(path, info.size)]
    inside = fs.get_file_info(pafs.FileSelector(root))
    return [(f"{path.rstrip('/')}/{f.base_name}", f.size) for f in sorted(inside, key=lambda f: f.base_name) if f.is_file and f.base_name[0] not in "._"]
