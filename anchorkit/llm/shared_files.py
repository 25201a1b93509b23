"""Small binary files below the shared folder, written whole by tasks and mapped by others."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401


def folder_uri(path: str) -> str:
    return path if ":/" in path else "file://" + os.path.abspath(path)


def write_whole(folder: str, name: str, data: bytes) -> None:
    """A whole file under its name, or none: a task that runs twice writes the same file twice."""
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, f"{path}/{name}")


def mapped(folder: str, name: str) -> np.ndarray:
    """The bytes of a file: mapped where the folder is mounted, else read. A missing file is an error."""
    fs, path = pa.fs.FileSystem.from_uri(folder)
    if isinstance(fs, pa.fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", np.uint8, "r")
    with fs.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), np.uint8)
