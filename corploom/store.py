"""Files of any store that pyarrow knows (local, HDFS, S3, GCS), used alike on the driver and in tasks; a plain path is local."""

from __future__ import annotations

import hashlib

from pyarrow import fs

PART = 1 << 20


def at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it. file:/x, file:///x and /x are the same."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def exists(path: str) -> bool:
    f, p = at(path)
    return f.get_file_info(p).type != fs.FileType.NotFound


def size(path: str) -> int:
    f, p = at(path)
    return f.get_file_info(p).size


def parents(path: str) -> None:
    """Makes the folder of a path."""
    f, p = at(path)
    f.create_dir(p.rsplit("/", 1)[0], recursive=True)


def digest(path: str) -> str:
    """SHA-256 of a file, read in parts."""
    f, p = at(path)
    h = hashlib.sha256()
    with f.open_input_stream(p) as stream:
        while part := stream.read(PART):
            h.update(part)
    return h.hexdigest()


def move(a: str, b: str) -> None:
    """Renames a file within its store, over any file that is there."""
    f, p = at(a)
    f.move(p, at(b)[1])


def copy(a: str, b: str) -> None:
    """Copies a file, also between stores."""
    (x, p), (y, q) = at(a), at(b)
    fs.copy_files(p, q, source_filesystem=x, destination_filesystem=y)


def read(path: str) -> bytes:
    f, p = at(path)
    with f.open_input_stream(p) as stream:
        return stream.read()


def write(path: str, content: bytes) -> None:
    """Replaces a file as a whole: readers see the old or the new content."""
    parents(path)
    f, p = at(path + ".part")
    with f.open_output_stream(p) as stream:
        stream.write(content)
    f.move(p, at(path)[1])


def remove(path: str) -> None:
    f, p = at(path)
    if f.get_file_info(p).type == fs.FileType.File:
        f.delete_file(p)
