"""Byte files of the shared folder, written by tasks that may run more than once."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, or of a plain local path."""
    return pafs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (pafs.LocalFileSystem(), uri)


@contextmanager
def replacing(uri: str):
    """An output stream whose file takes its name at the end, whole or not at all.

    A task's second attempt writes its own file and replaces the first's.
    """
    fs, path = open_fs(uri)
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    temp = f"{folder}/_{uuid.uuid4().hex}.{name}"
    stream = fs.open_output_stream(temp, compression=None)
    try:
        yield stream
        stream.close()
        if not isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_file(path)
        fs.move(temp, path)
    except BaseException:
        stream.close()
        fs.delete_file(temp)
        raise
