"""Publication by a log of commits, for stores where a folder cannot be renamed in one step.

A run's artifacts go to a folder of their own and never move. What makes them current is one small file more in the log:
commits are numbered, each is made by a create that fails if the number is taken, and readers follow the one with the
largest number whose record is whole. Until that file is there the old run is what readers see; a writer that dies
leaves a folder that nothing names. Two writers that began from one commit cannot both follow it: the second one's
create fails, and it has to look again.

    <out>/runs/<id>/...          artifacts of a run
    <out>/_commits/00000001.json {"run": ..., "parent": 0, "files": [{"path", "size_bytes", "sha256"}, ...]}
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortlens.operators.integrity import manifest_differences
from cohortlens.sources.artifacts import Folder, json_text, scan_manifest

FILES = "path string, size_bytes bigint, sha256 string"


class CommitConflict(RuntimeError):
    """Another writer has committed since."""


class Log:
    """The commits below a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out, self.folder = spark, out.rstrip("/"), Folder(spark, f"{out.rstrip('/')}/_commits")

    def numbers(self) -> list[int]:
        """The numbers of all commits, ascending; leftovers of other names do not count."""
        names = (f["path"].rpartition("/")[2] for f in self.folder.listing(1_000_000))
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"([0-9]{8})\.json", n)))

    def read(self, number: int) -> dict | None:
        """A commit's record; None if it is not whole, as after a writer's death on a store without atomic creates."""
        text = self.folder.read_text(f"{number:08d}.json")
        try:
            record = json.loads(text)
        except ValueError:
            return None
        return record if isinstance(record, dict) and {"run", "files"} <= set(record) else None

    def current(self) -> tuple[int, dict | None]:
        """The last number in use (0 without commits), and the last whole record."""
        numbers = self.numbers()
        for n in reversed(numbers):
            record = self.read(n)
            if record is not None:
                return numbers[-1], record
        return (numbers[-1] if numbers else 0), None

    def path(self) -> str:
        """The folder of the current run."""
        record = self.current()[1]
        if record is None:
            raise FileNotFoundError(f"no commit in {self.out}")
        return f"{self.out}/{record['run']}"

    def begin(self) -> tuple[str, int]:
        """A new folder for a run's artifacts, and the commit that it follows."""
        return f"{self.out}/runs/{uuid.uuid4().hex}", self.current()[0]

    def commit(self, run: str, parent: int) -> int:
        """Make a run current; CommitConflict if another one followed the same commit. Its files are digested before."""
        if not Folder(self.spark, run).size():
            raise FileNotFoundError(run)
        files = [r.asDict() for r in scan_manifest(self.spark, run).orderBy("path").collect()]  # a run's artifacts
        record = {"run": run.removeprefix(f"{self.out}/"), "parent": parent, "files": files}
        if not self.folder.create_text(f"{parent + 1:08d}.json", json_text(record)):
            raise CommitConflict(f"commit {parent + 1} of {self.out} is taken")
        return parent + 1

    def differences(self) -> DataFrame:
        """path, problem of the current run's files that are not as committed."""
        record = self.current()[1]
        expected = self.spark.createDataFrame([(f["path"], f["size_bytes"], f["sha256"]) for f in (record or {"files": []})["files"]], FILES)
        return manifest_differences(expected, scan_manifest(self.spark, self.path()))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove the folders of runs that none of the last whole commits names, and return them. Not while a run is written."""
        named, kept = set(), 0
        for n in reversed(self.numbers()):
            record = self.read(n)
            if record is not None and kept < keep:
                named.add(record["run"])
                kept += 1
        there = {f"runs/{m[1]}" for f in Folder(self.spark, f"{self.out}/runs").listing(1_000_000) if (m := re.search(r"/runs/([0-9a-f]{32})/", f["path"]))}
        gone = sorted(there - named)
        for run in gone:
            Folder(self.spark, f"{self.out}/{run}").remove()
        return gone


def published(spark: SparkSession, out: str) -> str:
    """Where the artifacts of out are: the current run's folder where it has a log, else itself."""
    log = Log(spark, out)
    return log.path() if log.folder.exists() and log.numbers() else out
