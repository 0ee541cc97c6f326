"""Files that tasks write to, and read from, the shared folder.

Paths are those of ``spark.checkpoint.dir``: a local or mounted path, or any
address Arrow's file systems know (hdfs, s3, gs). A file is written under a name
of its attempt and then renamed, so a repeated or speculative task leaves one
whole file with the same content.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path)


@contextmanager
def writing(path: str) -> Iterator:
    """An output stream whose content appears at ``path`` when it is complete."""
    fs, place = locate(path)
    fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
    attempt = f"{place}.{uuid.uuid4().hex[:8]}.attempt"
    try:
        with fs.open_output_stream(attempt) as out:
            yield out
        if fs.get_file_info(place).type != pafs.FileType.NotFound:
            fs.delete_file(place)
        fs.move(attempt, place)
    except BaseException:
        if fs.get_file_info(attempt).type != pafs.FileType.NotFound:
            fs.delete_file(attempt)
        raise


def reading(path: str):
    """A random-access input file."""
    fs, place = locate(path)
    return fs.open_input_file(place)
