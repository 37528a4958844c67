"""Files of our own formats in the shared folder, through whatever file system its address names."""

from __future__ import annotations

import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of an address such as file:///a/b or s3://bucket/a."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Output:
    """A file that appears under its name only when it is whole, so a task that dies or runs twice does no harm."""

    def __init__(self, uri: str, attempt: int):
        self.fs, self.path = open_fs(uri)
        self.part = f"{self.path}.{attempt}.part"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.stream, self.at = self.fs.open_output_stream(self.part), 0

    def write(self, data: bytes) -> int:
        """Appends; returns where the data begins."""
        at = self.at
        self.stream.write(data)
        self.at += len(data)
        return at

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.part, self.path)


def read_range(uri_or_file, offset: int, length: int) -> bytes:
    """Exactly `length` bytes from `offset` of an open random-access file."""
    uri_or_file.seek(offset)
    data = uri_or_file.read(length)
    if len(data) != length:
        raise OSError(f"wanted {length} bytes at {offset}, got {len(data)}")
    return data
