"""Binary files in the shared folder, written and read by tasks through Arrow's file systems (local, HDFS, S3, GCS)."""

from __future__ import annotations

import contextlib
import uuid
from urllib.parse import unquote, urlparse

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """file:/x, file:///x and plain paths are local; the rest is Arrow's to resolve."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def new_file(folder: str, stem: str, suffix: str):
    """Yields (stream, uri). Each attempt of a task writes a name of its own, and only a finished attempt reports it, so retries and speculative copies never meet."""
    uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
    store, path = opened(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        yield out, uri


def read_file(uri: str):
    store, path = opened(uri)
    return store.open_input_file(path)
