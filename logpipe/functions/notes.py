"""Small JSON files in a shared folder, written whole: what a stream must know after a restart."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyarrow import fs


@dataclass(frozen=True)
class Notes:
    """Notes below ``root``, a path or URI that the driver and all executors see."""
    root: str

    def _store(self) -> tuple[fs.FileSystem, str]:
        store, path = fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:")
                                             else os.path.abspath(self.root))
        return store, path.rstrip("/")

    def put(self, path: str, value) -> None:
        """Write or replace a note; readers see the old one or the new one."""
        store, root = self._store()
        folder, name = f"{root}/{path}".rsplit("/", 1)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/.{name}") as f:
            f.write(json.dumps(value).encode())
        store.move(f"{folder}/.{name}", f"{folder}/{name}")

    def get(self, path: str):
        """A note's value, None if there is none."""
        store, root = self._store()
        try:
            with store.open_input_file(f"{root}/{path}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def names(self, folder: str) -> list[str]:
        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/"), allow_not_found=True))
        return [i.base_name for i in found if not i.base_name.startswith(".")]

    def delete(self, path: str) -> None:
        """Delete a note or a folder of notes, if it is there."""
        store, root = self._store()
        kind = store.get_file_info(f"{root}/{path}").type
        if kind == fs.FileType.Directory:
            store.delete_dir(f"{root}/{path}")
        elif kind == fs.FileType.File:
            store.delete_file(f"{root}/{path}")
