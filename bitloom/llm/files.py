"""Binary files in the shared folder, from the driver or executors, by URI (file, hdfs, s3, ... as pyarrow knows them)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str):
    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return system, path


class Writer:
    """A file under a name of its own; names carry a random part, so a repeated or speculative task never meets another's.

    Only files that a finished task reported count; what a lost task leaves behind is never read."""

    def __init__(self, folder: str, stem: str, suffix: str):
        self.uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
        system, path = _at(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self._out = system.open_output_stream(path, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def close(self) -> str:
        self._out.close()
        return self.uri


def open_input(uri: str):
    """A seekable input file."""
    system, path = _at(uri)
    return system.open_input_file(path)
