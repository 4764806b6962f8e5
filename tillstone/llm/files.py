"""Binary files in the shared folder of the cluster, written and memory-mapped by tasks."""

from __future__ import annotations

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession


def made_folder(spark: SparkSession, folder: str) -> str:
    """Create a folder where Spark would; its full address, as executors need it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    address = system.makeQualified(path).toString()
    return f"file://{address.removeprefix('file:')}" if address.startswith("file:/") else address


def written(address: str):
    """A new file at an address, for writing bytes."""
    system, path = fs.FileSystem.from_uri(address)
    return system.open_output_stream(path)


class Mapped:
    """Numbers of one kind in a file; those asked for are read, from a memory map where the file system has one."""

    def __init__(self, address: str, kind: str):
        system, path = fs.FileSystem.from_uri(address)
        self.kind = np.dtype(kind)
        self.size = system.get_file_info(path).size // self.kind.itemsize
        local = isinstance(system, fs.LocalFileSystem)
        self._map = np.memmap(path, self.kind, "r") if local and self.size else None
        self._file = None if local else system.open_input_file(path)

    def __getitem__(self, span: slice) -> np.ndarray:
        start, stop, _ = span.indices(self.size)
        if stop <= start:
            return np.zeros(0, self.kind)
        if self._map is not None:
            return self._map[start:stop]
        width = self.kind.itemsize
        return np.frombuffer(self._file.read_at((stop - start) * width, start * width), self.kind)
