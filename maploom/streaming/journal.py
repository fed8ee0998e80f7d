"""What was ingested, coalesced and folded, run by run, in one JSON file.

Each run is a job that carries on from the newest one: completed index ranges by
folder, and how far the map has been brought for them.  Every change rewrites the
file beside itself and renames it.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
from datetime import datetime, timezone

# What each strategy does.
STRATEGIES = {
    "": {"ingest", "coalesce", "smt"},
    "onlyingest": {"ingest"},
    "skipingest": {"coalesce", "smt"},
    "onlysmtupdate": {"smt"},
    "recordctsize": {"record"},
}
_NAME = re.compile(r"(\d+)-(\d+)(?:\.gz|\.csv)?")


def parse_interval(text: str) -> tuple[int, int]:
    """First and last index of ``A-B``, ``A-B.gz`` or ``A-B.csv``."""
    m = _NAME.fullmatch(os.path.basename(text))
    if not m or int(m[1]) > int(m[2]):
        raise ValueError(f"unexpected interval {text!r}")
    return int(m[1]), int(m[2])


def merged(intervals) -> list[list[int]]:
    """Sorted; those that overlap or touch are one."""
    out: list[list[int]] = []
    for start, end in sorted(intervals):
        if out and start <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def covers(intervals, start: int, end: int) -> bool:
    return any(a <= start and end <= b for a, b in intervals)


def completed_size(intervals) -> int:
    """How many entries from index 0 on are there without a gap; an error if the first is missing."""
    if not intervals or intervals[0][0] != 0:
        raise ValueError("the completed indices do not begin at 0")
    return intervals[0][1] + 1


class Journal:
    """The jobs of a map; ``strategy`` is a key of STRATEGIES."""

    def __init__(self, path: str, folder: str, strategy: str = "", with_csv: bool = False):
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy {strategy!r}")
        self.path, self.folder = path, os.path.basename(os.path.normpath(folder))
        self.jobs: list[dict] = []
        if os.path.exists(path):
            with open(path) as f:
                self.jobs = json.load(f)["jobs"]
            for job in self.jobs:
                job["completed"] = {k: merged(map(tuple, v)) for k, v in job["completed"].items()}
        last = self.jobs[-1] if self.jobs else {"coalesced": False, "smt": False, "log_size": 0, "completed": {}}
        job = {"command": sys.argv[:], "folder": os.getcwd(), "strategy": strategy, "with_csv": with_csv, "start": _now()}
        self.jobs.append(job | json.loads(json.dumps({k: last[k] for k in ("coalesced", "smt", "log_size", "completed")})))
        self._write()

    @property
    def job(self) -> dict:
        return self.jobs[-1]

    def does(self, step: str) -> bool:
        return step in STRATEGIES[self.job["strategy"]]

    def pending(self, files: list[str]) -> list[str]:
        """The files, by index, that no completed range covers."""
        wanted = [f for f in files if f.endswith(".gz") or (self.job["with_csv"] and f.endswith(".csv"))]
        done = self.job["completed"].get(self.folder, [])
        return [f for f in sorted(set(wanted), key=parse_interval) if not covers(done, *parse_interval(f))]

    def commit(self, files: list[str] = (), coalesced: bool = False, smt: bool = False) -> None:
        """These files are in the store; the map is coalesced and folded for all there is, or not."""
        ranges = [*map(tuple, self.job["completed"].get(self.folder, [])), *map(parse_interval, files)]
        if ranges:
            self.job["completed"][self.folder] = merged(ranges)
        self.job.update(coalesced=coalesced or smt, smt=smt)
        self._write()

    def commit_log_size(self, size: int) -> None:
        self.job["log_size"] = size
        self._write()

    def size(self) -> int:
        return completed_size(self.job["completed"].get(self.folder, []))

    def _write(self) -> None:
        self.job["end"] = _now()
        at, beside = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(self.path)), prefix=os.path.basename(self.path))
        with os.fdopen(at, "w") as f:
            json.dump({"jobs": self.jobs}, f, indent=2)
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, self.path)


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")
