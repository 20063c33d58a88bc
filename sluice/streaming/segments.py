"""Tables that streams add to: a segment of files per batch, and one small file that says which ones count.

A segment belongs to its batch and is replaced when that batch runs again. The list of segments is
versioned; a new version is put in place as a whole and is the commit. Merged segments take the place of
old ones in the same way, so a reader sees either.
"""

from __future__ import annotations

import json
from typing import Any

from pyarrow import fs

from sluice.sources.keyed_files import put, store_of

#: Versions of the list that stay; older ones are deleted.
KEPT_VERSIONS = 8


class Segments:
    """The list at ``folder``; facts: what must be the same whenever it is opened."""

    def __init__(self, folder: str, **facts: Any) -> None:
        self.folder, self.facts = folder.rstrip("/"), facts

    def _files(self) -> list[fs.FileInfo]:
        store, root = store_of(self.folder)
        found = store.get_file_info(fs.FileSelector(f"{root}/states", allow_not_found=True))
        return sorted((f for f in found if f.base_name.endswith(".json") and not f.base_name.startswith(".")), key=lambda f: f.base_name)

    def current(self) -> list[dict]:
        """The segments that count, oldest first: name and upto, the last batch that each has."""
        files = self._files()
        if not files:
            return []
        store, _ = store_of(self.folder)
        with store.open_input_stream(files[-1].path) as file:
            state = json.loads(file.read())
        for what, value in self.facts.items():
            if state["facts"][what] != value:
                raise ValueError(f"the table at {self.folder} has {state['facts'][what]} {what}, not {value}")
        return state["segments"]

    def commit(self, segments: list[dict]) -> None:
        """Makes ``segments`` the ones that count."""
        store, root = store_of(self.folder)
        files = self._files()
        version = int(files[-1].base_name[:-5]) + 1 if files else 1
        put(store, f"{root}/states/{version:012}.json", iter([json.dumps({"facts": self.facts, "segments": segments}).encode()]))
        for old in files[: -KEPT_VERSIONS + 1]:
            store.delete_file(old.path)
