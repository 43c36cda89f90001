"""Artifacts of a run: contract files, tables, manifests, reports and their staged publication."""

from __future__ import annotations

import json
import os
import platform
import sys
from importlib import metadata
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.integrity import manifest


def load_contract(path: str) -> dict:
    """A YAML contract with its own path and the project's folder (the one above the contract's) added."""
    out = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    here = Path(path).resolve()
    return out | {"_config_path": str(here), "_project_root": str(here.parent.parent)}


def project_path(contract: dict, value: str) -> str:
    """An absolute path or a URI as it is, another below the project's folder."""
    return value if os.path.isabs(value) or "://" in value else str(Path(contract["_project_root"]) / value)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV (plain or compressed), JSON or Parquet by its name; CSV without a schema is inferred."""
    bare = path.removesuffix(".gz")
    if bare.endswith(".json"):
        return spark.read.option("multiLine", "true").json(path)
    if bare.endswith((".csv", ".tsv")):
        reader = spark.read.option("header", "true").option("sep", "\t" if bare.endswith(".tsv") else ",")
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").csv(path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, compression: str = "none", single: bool = False) -> None:
    """A CSV folder with headers; single writes one part, for small tables."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", "true").option("compression", compression).csv(path)


def write_marked_csv(df: DataFrame, path: str, rows: int = 100_000) -> None:
    """One CSV file with a byte-order mark for spreadsheet programs, of a small table; an error beyond rows."""
    held = df.limit(rows + 1).toPandas()
    if len(held) > rows:
        raise ValueError(f"more than {rows} rows")
    held.to_csv(path, index=False, encoding="utf-8-sig")


def json_text(value, allow_nan: bool = False) -> str:
    """JSON of a small summary; NaN is an error unless allowed."""
    return json.dumps(value, indent=2, ensure_ascii=False, allow_nan=allow_nan) + "\n"


def write_json(value, path: str, allow_nan: bool = False) -> None:
    """json_text as a file of this machine."""
    Path(path).write_text(json_text(value, allow_nan), encoding="utf-8")


def scan_manifest(spark: SparkSession, folder: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """path, size_bytes, sha256 of all files below a folder, digested where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return manifest(files, folder, ignore)


def by_extension(files: DataFrame, path: str = "path", size: str = "size_bytes") -> DataFrame:
    """ext (lower case, empty without one), n, bytes."""
    ext = F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+(\.[^.]+)$", 1))
    return files.groupBy(ext.alias("ext")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


class Folder:
    """A folder of any file system that Spark knows, for small files and moves; executors see the same one."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self._of(path).getFileSystem(conf)
        if self.fs.getUri().getScheme() == "file":
            # Without checksums beside the files: other programs may change them, and a manifest is what tells then.
            self.fs = self.jvm.org.apache.hadoop.fs.RawLocalFileSystem()
            self.fs.initialize(self.jvm.java.net.URI("file:///"), conf)

    def _of(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._of(f"{self.path}/{name}".rstrip("/")))

    def size(self, name: str = "") -> int:
        """Bytes of a file, or of all files below a folder; 0 if there is none."""
        return self.fs.getContentSummary(self._of(f"{self.path}/{name}".rstrip("/"))).getLength() if self.exists(name) else 0

    def listing(self, most: int = 10_000) -> list[dict]:
        """path, size_bytes and modified (milliseconds) of the files at or below the folder, up to most; sorted by path."""
        if not self.exists():
            return []
        out, files = [], self.fs.listFiles(self._of(self.path), True)
        while files.hasNext() and len(out) < most:
            f = files.next()
            out.append({"path": f.getPath().toString(), "size_bytes": f.getLen(), "modified": f.getModificationTime()})
        return sorted(out, key=lambda f: f["path"])

    def remove(self) -> None:
        self.fs.delete(self._of(self.path), True)

    def make(self) -> None:
        self.fs.mkdirs(self._of(self.path))

    def move_to(self, other: str) -> bool:
        return self.fs.rename(self._of(self.path), self._of(other))

    def read_text(self, name: str) -> str:
        stream = self.fs.open(self._of(f"{self.path}/{name}"))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
        finally:
            stream.close()

    def create_text(self, name: str, text: str) -> bool:
        """A small file, unless there is one of that name: whether it was made. The file system decides between writers."""
        self.make()
        target = self._of(f"{self.path}/{name}")
        if self.fs.getUri().getScheme() == "file":
            # Hadoop looks first and creates then on local disks; an exclusive open is one step.
            try:
                with open(target.toUri().getPath(), "x", encoding="utf-8") as out:
                    out.write(text)
            except FileExistsError:
                return False
            return True
        try:
            out = self.fs.create(target, False)
        except Exception as e:  # py4j hands on the JVM's exception
            if "AlreadyExists" in str(e):
                return False
            raise
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        return True

    def write_text(self, name: str, text: str) -> None:
        """A small file; folders above it are made."""
        out = self.fs.create(self._of(f"{self.path}/{name}"), True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()


def publish(spark: SparkSession, staging: str, out: str) -> None:
    """Replace out by staging in one step: the old one is moved aside, put back if the move fails, removed after."""
    target, backup = Folder(spark, out), Folder(spark, f"{out}.backup")
    if not Folder(spark, staging).exists():
        raise FileNotFoundError(staging)
    backup.remove()
    if target.exists() and not target.move_to(backup.path):
        raise OSError(f"{out} cannot be moved aside")
    if not Folder(spark, staging).move_to(out):
        if backup.exists():
            backup.move_to(out)
        raise OSError(f"{staging} cannot be moved to {out}")
    backup.remove()


def say(text: str, stream=None) -> None:
    """Print text; characters that the stream's encoding does not have are written as escapes."""
    stream = stream or sys.stdout
    try:
        print(text, file=stream)
    except UnicodeEncodeError:
        print(text.encode(stream.encoding or "ascii", "backslashreplace").decode(stream.encoding or "ascii"), file=stream)


def markdown_table(df: DataFrame, rows: int = 20) -> str:
    """The first rows as a Markdown table."""
    held = df.limit(rows).collect()
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(r[c]) for c in df.columns) + " |" for r in held)])


def software() -> dict[str, str]:
    """Versions of Python, the platform and the packages that results depend on."""
    out = {"python": platform.python_version(), "platform": platform.platform()}
    for name in ("pyspark", "numpy", "pandas", "pyarrow"):
        try:
            out[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            out[name] = "missing"
    return out
