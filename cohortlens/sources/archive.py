"""Recordings in ZIP archives with a text file for each channel, as a Python data source.

One partition reads one recording (group, condition, subject); only listed channels are opened. Names are
checked before anything is read, and a file that does not parse is a row with an error, not a failed job.
"""

from __future__ import annotations

import re
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cohortlens.functions.scalar import MEMBER
from cohortlens.operators.signal import CHANNELS

SCHEMA = "group string, condition string, subject string, channel string, samples array<double>, error string"


def safe_member(name: str) -> bool:
    """The driver's twin of functions.scalar.is_safe_member."""
    return bool(name) and "\\" not in name and ":" not in name and not any(p in ("", ".", "..") for p in name.split("/"))


def parse_samples(raw: bytes, expected: int | None = None) -> list[float]:
    """One number a line, blank lines skipped; an error for other text, no numbers, or another count than expected."""
    out = [float(line) for line in raw.decode("utf-8").splitlines() if line.strip()]
    if not out:
        raise ValueError("no samples")
    if expected is not None and len(out) != expected:
        raise ValueError(f"{len(out)} samples instead of {expected}")
    return out


class _Recording(InputPartition):
    def __init__(self, members: list[tuple[str, str, str, str, str]]):
        self.members = members


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.channels = set(filter(None, options.get("channels", ",".join(CHANNELS)).split(",")))
        self.condition = options.get("condition")
        self.expected = int(options["expected"]) if options.get("expected") else None

    def partitions(self) -> list[InputPartition]:
        groups: dict[tuple, list] = {}
        with _opened(self.path) as f, zipfile.ZipFile(f) as z:
            for name in sorted(n for n in z.namelist() if safe_member(n)):
                m = re.match(MEMBER, name)
                if m and m[4] in self.channels and self.condition in (None, m[2]):
                    groups.setdefault(m.groups()[:3], []).append((*m.groups(), name))
        return [_Recording(members) for members in groups.values()]

    def read(self, partition):
        with _opened(self.path) as f, zipfile.ZipFile(f) as z:
            for group, condition, subject, channel, name in partition.members:
                try:
                    yield group, condition, subject, channel, parse_samples(z.read(name), self.expected), None
                except (ValueError, UnicodeDecodeError) as e:
                    yield group, condition, subject, channel, None, str(e)


def _opened(path: str):
    """The archive as a file that can seek: its directory and the members that are asked for are all that is read."""
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return files.open_input_file(name)


class ArchiveSource(DataSource):
    """spark.read.format("zip_recordings").option("condition", ...).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "zip_recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_archive(spark: SparkSession, path: str, condition: str | None = None, channels: tuple[str, ...] = CHANNELS, expected: int | None = None) -> DataFrame:
    """SCHEMA and participant_id (group_subject, as groups reuse subject names)."""
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("zip_recordings").option("channels", ",".join(channels))
    reader = reader.option("condition", condition) if condition else reader
    reader = reader.option("expected", str(expected)) if expected else reader
    return reader.load(path).withColumn("participant_id", F.concat_ws("_", "group", "subject"))


def list_members(spark: SparkSession, path: str) -> DataFrame:
    """name of every safe member of an archive that is no folder, sorted; only the archive's directory is read."""
    with _opened(path) as f, zipfile.ZipFile(f) as z:
        names = sorted(n for n in z.namelist() if safe_member(n))
    return spark.createDataFrame([(n,) for n in names], "name string")


def index_members(names: DataFrame, condition: str, channels: tuple[str, ...] = CHANNELS, per_condition: bool = False) -> DataFrame:
    """group, subject, channels, missing, extra of subjects that have the condition, from member names (name).

    Channel sets are pooled over conditions unless per_condition.
    """
    from cohortlens.functions.scalar import is_safe_member, member_parts

    parts = names.where(is_safe_member(F.col("name"))).select(member_parts(F.col("name")).alias("m")).where("m is not null").select("m.*")
    here = parts.where(F.col("condition") == condition)
    sets = (here if per_condition else parts).groupBy("group", "subject").agg(F.array_sort(F.collect_set("channel")).alias("channels"))
    wanted = F.array(*map(F.lit, channels))
    out = sets.join(here.select("group", "subject").distinct(), ["group", "subject"], "left_semi")
    return out.select("group", "subject", "channels", F.array_sort(F.array_except(wanted, "channels")).alias("missing"), F.array_sort(F.array_except("channels", wanted)).alias("extra"))
