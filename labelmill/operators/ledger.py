"""A ledger of answered requests, so that what was answered is not asked again.

Each answer is written under its request's name before the next request is asked. A task that is run again, after it
failed or its executor was lost, finds the answers of the attempt before and asks only for the rest. A request that was
under way when its task died has no answer and is asked again.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import pandas as pd
from pyarrow import fs


class Ledger:
    """Answers below a folder that all executors reach, as a path or an address (``file:``, ``hdfs:``, ``s3:``, …)."""

    def __init__(self, folder: str):
        folder = folder if "://" in folder or not folder.startswith("file:") else "file://" + folder.removeprefix("file:")
        self.files, self.root = fs.FileSystem.from_uri(folder.rstrip("/"))
        self.made: set[str] = set()

    def place(self, seq, prompt: str | None) -> str:
        """Where a request's answer lies: by its number, and by its prompt, so that another plan's answers don't count."""
        name = hashlib.sha256(json.dumps([seq, prompt]).encode()).hexdigest()
        return f"{self.root}/{name[:2]}/{name}.json"

    def found(self, frame: pd.DataFrame) -> list[dict | None]:
        """The answer of each request, where there is one."""
        places = [self.place(int(s), p) for s, p in zip(frame["seq"], frame["prompt"], strict=True)]
        known = self.files.get_file_info(places) if places else []
        return [self._read(p) if i.type == fs.FileType.File else None for p, i in zip(places, known, strict=True)]

    def _read(self, place: str) -> dict:
        with self.files.open_input_stream(place) as f:
            return json.loads(f.read())

    def record(self, seq, prompt: str | None, answer: dict) -> None:
        """Write an answer; it appears whole."""
        place = self.place(int(seq), prompt)
        folder = place.rpartition("/")[0]
        if folder not in self.made:
            self.files.create_dir(folder, recursive=True)
            self.made.add(folder)
        aside = f"{place}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(aside) as f:
            f.write(json.dumps(answer).encode())
        self.files.move(aside, place)
