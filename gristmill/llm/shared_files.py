"""Files in the shared folder that tasks write and read themselves."""

from __future__ import annotations

import uuid

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(path)


def fresh(folder: str, suffix: str) -> str:
    """A name no other attempt of any task uses."""
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def write(path: str, data: bytes) -> None:
    system, inner = locate(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    with system.open_output_stream(inner, compression=None) as out:
        out.write(data)


def read(path: str) -> bytes:
    system, inner = locate(path)
    with system.open_input_file(inner) as f:
        return f.read()
