"""Files that tasks write and read in the shared folder: temporary names, renames, manifests."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"/{uri}")


def made_dir(uri: str) -> None:
    store, path = opened(uri)
    store.create_dir(path, recursive=True)


@contextmanager
def committed(folder: str, name: str) -> Iterator:
    """A stream whose bytes appear under name only when all are written. A repeated attempt of a task writes the same bytes and replaces them."""
    store, path = opened(folder)
    temporary = f"{path}/_temporary-{uuid.uuid4().hex}-{name}"
    try:
        with store.open_output_stream(temporary, compression=None) as out:
            yield out
        store.move(temporary, f"{path}/{name}")
    except BaseException:
        if store.get_file_info(temporary).type != fs.FileType.NotFound:
            store.delete_file(temporary)
        raise


def read_bytes(folder: str, name: str) -> bytes:
    store, path = opened(folder)
    with store.open_input_stream(f"{path}/{name}", compression=None) as f:
        return f.read()
