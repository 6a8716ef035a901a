"""Files in the shared folder, by pyarrow's file systems: local mounts and object stores alike."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np


class SharedFiles:
    """The files below one folder, given as a URI."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file:///") else "file://" + uri[5:])
        self.local = self.fs.type_name == "local"

    def put(self, name: str, *pieces: bytes | np.ndarray) -> None:
        """Write under an own name, then move: a task that runs twice leaves one whole file."""
        tmp, to = f"{self.root}/_tmp-{uuid.uuid4().hex}", f"{self.root}/{name}"
        self.fs.create_dir(self.root, recursive=True)
        with self.fs.open_output_stream(tmp) as f:
            for x in pieces:
                f.write(x if isinstance(x, bytes) else memoryview(np.ascontiguousarray(x)).cast("B") if x.size else b"")
        self.fs.move(tmp, to)

    def read(self, name: str) -> bytes:
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            return f.read()

    def map(self, name: str) -> np.ndarray | None:
        """The file's bytes, mapped into memory, or None. A file that can't be mapped where it is goes to a nameless file first, gone with the map."""
        from pyarrow import fs

        path = f"{self.root}/{name}"
        if self.fs.get_file_info(path).type != fs.FileType.File:
            return None
        if self.local:
            return np.memmap(path, np.uint8, "r")
        with tempfile.TemporaryFile() as copy, self.fs.open_input_stream(path) as f:
            while piece := f.read(1 << 20):
                copy.write(piece)
            copy.flush()
            return np.memmap(copy, np.uint8, "r")
