"""Files read by byte range on executors and written as one stream by the driver, in any store pyarrow opens."""

from __future__ import annotations

from collections.abc import Iterable

from pyarrow import fs


def opened(path: str):
    """A seekable input and its length."""
    where, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where.open_input_file(at), where.get_file_info(at).size


def write(path: str, pieces: Iterable[bytes]) -> None:
    where, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with where.open_output_stream(at, compression=None) as out:
        for piece in pieces:
            out.write(piece)


def read(path: str) -> bytes:
    f, size = opened(path)
    with f:
        return f.read(size)


def make(folder: str) -> None:
    where, at = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    where.create_dir(at, recursive=True)
