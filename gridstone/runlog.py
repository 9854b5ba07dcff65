"""A log of runs: one JSON line for each result, with what code, machine and data it is of."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import subprocess
import time
import uuid
from pathlib import Path


def fingerprint(folder: str) -> str:
    """A digest of the names and sizes of a folder's files."""
    seen = sorted((str(p.relative_to(folder)), p.stat().st_size) for p in Path(folder).rglob("*") if p.is_file())
    return hashlib.sha256(json.dumps(seen).encode()).hexdigest()[:16]


def provenance(data: str | None = None) -> dict:
    """Code, machine and data of a run."""
    import pyspark

    root = Path(__file__).resolve().parent.parent
    commit = subprocess.run(["git", "-C", str(root), "rev-parse", "HEAD"], capture_output=True, text=True).stdout.strip()
    out = {"commit": commit, "python": platform.python_version(), "pyspark": pyspark.__version__, "machine": platform.machine(), "cpus": os.cpu_count(), "at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
    return out | ({"data": data, "data_digest": fingerprint(data)} if data else {})


class RunLog:
    """Rows appended to a file of JSON lines, each with the run's id; the first line of a run has its provenance."""

    def __init__(self, path: str, data: str | None = None, **more: object):
        self.path, self.run_id = Path(path), uuid.uuid4().hex[:12]
        self._append({"run_id": self.run_id, "provenance": provenance(data) | more})

    def _append(self, row: dict) -> None:
        with self.path.open("a", encoding="utf-8") as f:
            f.write(json.dumps(row) + "\n")

    def add(self, **row: object) -> None:
        self._append({"run_id": self.run_id, **row})


def read(path: str, run_id: str | None = None) -> list[dict]:
    """The rows of a log, or of one run, without provenance."""
    rows = [json.loads(line) for line in Path(path).read_text(encoding="utf-8").splitlines()]
    return [r for r in rows if "provenance" not in r and (run_id is None or r["run_id"] == run_id)]
