"""Answers that a task has got, kept as they come, so that its next attempt does not ask for them again.

A task writes what it has got in small files, each visible as a whole once it is written, below a folder of
its own; every attempt begins with what earlier ones left there.  The folder lies in shared storage and is
reached through Arrow's file systems; where they do not know the store, nothing is kept.
"""

from __future__ import annotations

import json
import re
import uuid
from hashlib import md5

#: Answers in one file: so many, and the request under way, are asked for again at most.
EVERY = 20


class Journal:
    def __init__(self, folder: str | None, task: int, every: int = EVERY):
        self.every, self.held, self.known = every, [], {}
        self.store = None
        if folder is None:
            return
        from pyarrow import fs

        where = re.sub("^s3[an]:", "s3:", re.sub("^file:/*", "/", folder))
        try:
            self.store, path = fs.FileSystem.from_uri(where)
            self.path = f"{path}/task-{task}"
            self.store.create_dir(self.path, recursive=True)
            files = self.store.get_file_info(fs.FileSelector(self.path))
        except (ValueError, OSError, ImportError):
            self.store = None
            return
        for file in files:
            if file.base_name.endswith(".json"):
                with self.store.open_input_stream(file.path) as f:
                    self.known.update({key: (reply, n) for key, reply, n in json.loads(f.read())})

    @staticmethod
    def key(prompt: str) -> str:
        return md5(prompt.encode("utf-8", "surrogatepass")).hexdigest()

    def get(self, prompt: str) -> tuple[str, int] | None:
        """(answer, attempts) of an earlier attempt."""
        return self.known.get(self.key(prompt)) if self.known else None

    def add(self, prompt: str, reply: str, attempts: int) -> None:
        if self.store is None:
            return
        self.held.append((self.key(prompt), reply, attempts))
        if len(self.held) >= self.every:
            self.flush()

    def flush(self) -> None:
        if self.store is None or not self.held:
            return
        name = f"{self.path}/{uuid.uuid4().hex}"
        with self.store.open_output_stream(f"{name}.part", compression=None) as f:
            f.write(json.dumps(self.held).encode())
        self.store.move(f"{name}.part", f"{name}.json")
        self.held = []
