"""Indexing state: the last commit and time of every repository, in a small JSON file on any file system."""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

from pyarrow import fs as arrow_fs


@dataclass
class StateStore:
    """``path`` is a local path or a URI that pyarrow knows, as of a shared folder."""

    path: str

    @property
    def _fs(self):
        return arrow_fs.FileSystem.from_uri(self.path if "://" in self.path else os.path.abspath(self.path))

    def _read(self) -> dict:
        fs, path = self._fs
        try:
            with fs.open_input_stream(path) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return {}

    def _write(self, data: dict) -> None:
        fs, path = self._fs
        fs.create_dir(os.path.dirname(path), recursive=True)
        temp = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(temp) as f:
            f.write(json.dumps(data, indent=1, sort_keys=True).encode())
        fs.move(temp, path)

    def get(self, repo: str) -> str | None:
        return self._read().get(repo, {}).get("last_commit")

    def set(self, repo: str, commit: str) -> None:
        self._write(self._read() | {repo: {"last_commit": commit, "last_indexed_time": int(time.time())}})

    def clear(self, repo: str | None = None) -> None:
        self._write({} if repo is None else {k: v for k, v in self._read().items() if k != repo})
