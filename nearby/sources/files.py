"""Byte-range access to files in a folder that all executors share, whatever store holds it."""

from __future__ import annotations

import pyarrow.fs as pafs


#: Hadoop's names of stores, to the names that Arrow has for them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address and the path in it. Used inside tasks; nothing is kept on a machine's own disk.

    Addresses are as Spark takes them: file, hdfs, s3a, gs, abfs and their like.
    """
    scheme, mark, rest = uri.partition("://")
    uri = SCHEMES.get(scheme, scheme) + mark + rest
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


class Replacing:
    """Writes a file under an attempt's own name and gives it its final name at the end, so that a
    repeated or speculative task leaves one whole file."""

    def __init__(self, folder: str, name: str, attempt: int | str):
        self.fs, self.folder = store(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.path, self.mine = f"{self.folder}/{name}", f"{self.folder}/.{name}.{attempt}"
        self.out, self.size = self.fs.open_output_stream(self.mine), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def done(self) -> int:
        self.out.close()
        self.fs.move(self.mine, self.path)
        return self.size
