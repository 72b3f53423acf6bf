"""Flat arrays in the cluster's shared folder, written by tasks and memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np


class SharedFiles:
    """A folder of arrays. A mounted folder is mapped in place; from a store that is not mounted a worker maps a
    copy whose name is already gone, so that nothing is left behind."""

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")
        url = urlparse(self.folder)
        self.local = url.path if url.scheme in ("", "file") else None

    def write(self, name: str, values: np.ndarray) -> None:
        """Publish an array under a name, whole or not at all; a repeated task replaces it with the same content."""
        raw = np.ascontiguousarray(values)
        if self.local:
            os.makedirs(self.local, exist_ok=True)
            handle, part = tempfile.mkstemp(dir=self.local, prefix=".part-")
            with os.fdopen(handle, "wb") as f:
                f.write(raw.tobytes())
            os.replace(part, f"{self.local}/{name}")
        else:
            from pyarrow import fs

            store, base = fs.FileSystem.from_uri(self.folder)
            store.create_dir(base, recursive=True)
            part = f"{base}/.part-{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(raw.tobytes())
            store.move(part, f"{base}/{name}")

    def read(self, name: str, dtype: str) -> np.ndarray:
        """The array, memory-mapped."""
        if self.local:
            path = f"{self.local}/{name}"
            return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.folder)
        with tempfile.TemporaryFile() as copy, store.open_input_stream(f"{base}/{name}") as f:
            while block := f.read(1 << 22):
                copy.write(block)
            copy.flush()
            return np.memmap(copy, dtype=dtype, mode="r") if copy.tell() else np.zeros(0, dtype)
