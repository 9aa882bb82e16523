"""Files in the shared folder from Python tasks, by URI: local paths, or any store that Arrow knows (hdfs, s3, gs)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"file:/|/", uri):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_bytes(uri: str, data: bytes) -> None:
    """Write under a name of this attempt's own, then rename, so that readers never see half a file."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(f"{path}.part") as out:
        out.write(data)
    fs.move(f"{path}.part", path)


def read_array(uri: str, dtype: str) -> np.ndarray:
    """The file as a flat array: memory-mapped where it is local, else read whole."""
    fs, path = open_fs(uri)
    if not fs.get_file_info(path).size:
        return np.empty(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)
