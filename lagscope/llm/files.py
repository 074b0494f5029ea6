"""Small files in a folder that all machines share, by any address pyarrow can open."""

from __future__ import annotations

import uuid

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def make_folder(path: str) -> None:
    system, inner = locate(path)
    system.create_dir(inner, recursive=True)


def write_new(folder: str, suffix: str, content: bytes) -> str:
    """Write under a name of its own and return the name; a task that is run again writes another file."""
    system, inner = locate(folder)
    name = f"{uuid.uuid4().hex}{suffix}"
    with system.open_output_stream(f"{inner}/{name}", compression=None) as out:
        out.write(content)
    return name


def read_whole(folder: str, name: str) -> bytes:
    system, inner = locate(folder)
    with system.open_input_stream(f"{inner}/{name}", compression=None) as source:
        return source.read()
