"""Fingerprints, duplicate clusters, audits, gates and manifests. Checks are rows: name, status, detail."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.functions.scalar import is_finite
from cohortlens.operators.relational import dimension

CHECKS = "name string, status string, detail string"
#: Fixed value: marks the byte layout of a fingerprint, so that another layout never compares equal.
FINGERPRINT_TAG = b"osf-common19-float64-v2"
#: The names under which a run's content checks are reported.
AUDIT_NAMES = {
    "unique": "features:unique-participants",
    "finite": "features:finite-values",
    "baseline": "cohort:baseline-feature-consistency",
    "q_range": "statistics:q-value-range",
    "metric_range": "models:metric-range",
    "coverage": "models:out-of-fold-coverage",
    "failed": "processing:failed-subjects",
}


class GateError(RuntimeError):
    """A hard gate did not hold."""


def check(condition: Column, name: str, detail: Column, otherwise: str = "fail") -> Column:
    """A check as a struct (name, status, detail); a null condition does not pass."""
    return F.struct(F.lit(name).alias("name"), F.when(F.coalesce(condition, F.lit(False)), "pass").otherwise(otherwise).alias("status"), detail.cast("string").alias("detail"))


def checks_of(row: DataFrame, *checks: Column) -> DataFrame:
    """name, status, detail rows from a frame of one row of figures."""
    return row.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def roll_up(checks: DataFrame) -> DataFrame:
    """status (fail over warn over pass), n_pass, n_warn, n_fail."""
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    return checks.agg(n("pass").alias("n_pass"), n("warn").alias("n_warn"), n("fail").alias("n_fail")).select(F.when(F.col("n_fail") > 0, "fail").when(F.col("n_warn") > 0, "warn").otherwise("pass").alias("status"), "n_pass", "n_warn", "n_fail")


def require(checks: DataFrame, most: int = 20) -> None:
    """Raise GateError if a check fails; at most some failures are named."""
    failed = checks.where("status = 'fail'").limit(most).collect()
    if failed:
        raise GateError("; ".join(f"{r['name']}: {r['detail']}" for r in failed))


def signal_fingerprints(df: DataFrame, keys: list[str], channels: Iterable[str], expected: int) -> DataFrame:
    """keys, signal_sha256 (upper case): a digest over the tag and, for each channel in the given order, its name,
    count (little-endian 64-bit) and samples (little-endian doubles).

    A recording without exactly the expected finite samples in each channel has a null digest. Formatting
    of the source does not matter, since samples are numbers; one changed sample does.
    """
    order = list(channels)
    lists = df.where(F.col("channel").isin(order)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("channel", "samples"))).alias("_m"))

    @F.pandas_udf("string")
    def run(maps: pd.Series) -> pd.Series:
        def one(m):
            held = dict(m)
            digest = hashlib.sha256(FINGERPRINT_TAG)
            for c in order:
                x = held.get(c)
                if x is None or len(x) != expected or any(v is None for v in x) or not np.isfinite(np.asarray(x, float)).all():
                    return None
                digest.update(c.encode() + np.int64(len(x)).astype("<i8").tobytes() + np.asarray(x, "<f8").tobytes())
            return digest.hexdigest().upper()

        return maps.map(one)

    return lists.select(*keys, run("_m").alias("signal_sha256"))


def content_clusters(df: DataFrame, member: str, digest: str) -> DataFrame:
    """Adds cluster_size, representative (the smallest member as text), included and exclusion_reason.

    Sizes are aggregated and joined, so a frequent digest is not gathered. A null digest is a cluster of its own.
    """
    sizes = df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("cluster_size"), F.min(F.col(member).cast("string")).alias("representative"))
    out = df.join(sizes, digest, "left").withColumn("cluster_size", F.coalesce("cluster_size", F.lit(1))).withColumn("representative", F.coalesce("representative", F.col(member).cast("string")))
    included = F.col("representative") == F.col(member).cast("string")
    return out.withColumn("included", included).withColumn("exclusion_reason", F.when(~included, F.concat(F.lit("duplicate of "), F.col("representative"))))


def conflicting_clusters(df: DataFrame, digest: str, label: str) -> DataFrame:
    """Digests that stand under more than one label: digest, labels (sorted), n."""
    both = df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.array_sort(F.collect_set(label)).alias("labels"), F.count("*").alias("n"))
    return both.where(F.size("labels") > 1)


def cohort_audit(df: DataFrame, label: str, expected: dict[str, int]) -> DataFrame:
    """Checks of the rows of each expected label, of the total, and of labels that are not expected."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    both = counts.join(dimension(df.sparkSession, list(expected.items()), f"{label} string, want bigint"), label, "full_outer")
    each = both.select(
        F.concat(F.lit("cohort:"), F.coalesce(F.col(label), F.lit("null"))).alias("name"), F.when(F.col("want").isNull(), "warn").when(F.coalesce("n", F.lit(0)) == F.col("want"), "pass").otherwise("fail").alias("status"),
        F.concat(F.lit("n="), F.coalesce("n", F.lit(0)).cast("string"), F.lit(", expected="), F.coalesce(F.col("want").cast("string"), F.lit("none"))).alias("detail"),
    )
    total = sum(expected.values())
    row = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return each.unionByName(checks_of(row, check(F.col("n") == total, "cohort:total", F.concat(F.lit("n="), F.col("n").cast("string"), F.lit(f", expected={total}")))))


#: Fixed values of an archive's audit: channels that are left out, samples of a channel, groups, and the checks' names.
EXCLUDED_CHANNELS, ARCHIVE_SAMPLES, ARCHIVE_GROUPS = ("F1", "F2"), 1024, {"AD": 80, "Healthy": 12}
ARCHIVE_NAMES = {
    "total": "cohort:total-subjects", "group": "cohort:group:", "common": "channels:common-19-present", "extra": "channels:no-unexpected", "excluded": "channels:f1f2-excluded",
    "uniform": "channels:uniform-within-group", "samples": "integrity:sample-counts",
}


def archive_audit(index: DataFrame, samples: DataFrame, groups: dict[str, int] | None = None, expected: int = ARCHIVE_SAMPLES, excluded: tuple[str, ...] = EXCLUDED_CHANNELS) -> DataFrame:
    """Checks of an archive's cohort: subjects in all and by expected group, common channels present, no unexpected ones,
    one channel set within each group, and as many samples as expected in every channel.

    index has group, subject, channels, missing and extra for each subject; samples has group, subject, channel and n,
    -1 for a channel that did not parse. Details count what is wrong; lists of subjects are the tables' own. What
    has none is 0.
    """
    groups = ARCHIVE_GROUPS if groups is None else groups
    odd = F.size(F.array_except("extra", F.array(*map(F.lit, excluded)))) if excluded else F.size("extra")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    one = index.agg(F.count("*").alias("n"), count(F.size("missing") > 0).alias("missing"), count(odd > 0).alias("extra"), *(count(F.coalesce(F.col("group") == g, F.lit(False))).alias(f"g{i}") for i, g in enumerate(groups)))
    sets = index.groupBy("group").agg(F.countDistinct("channels").alias("k")).agg(count(F.col("k") > 1).alias("uneven"))
    bad = samples.agg(count(F.coalesce(F.col("n") != expected, F.lit(True))).alias("wrong"), count(F.coalesce(F.col("n") < 0, F.lit(True))).alias("failed"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    total = sum(groups.values())
    return checks_of(
        one.crossJoin(sets).crossJoin(bad),  # one row each
        check(F.col("n") == total, ARCHIVE_NAMES["total"], text("total=", F.col("n"), f" expected={total}")),
        *(check(F.col(f"g{i}") == want, f"{ARCHIVE_NAMES['group']}{g}", text(f"{g}=", F.col(f"g{i}"), f" expected={want}")) for i, (g, want) in enumerate(groups.items())),
        check(F.col("missing") == 0, ARCHIVE_NAMES["common"], text("subjects_missing=", F.col("missing"))),
        check(F.col("extra") == 0, ARCHIVE_NAMES["extra"], text("subjects_with_unexpected=", F.col("extra")), "warn"),
        check(F.lit(True), ARCHIVE_NAMES["excluded"], F.lit(f"excluded={sorted(excluded)}")),
        check(F.col("uneven") == 0, ARCHIVE_NAMES["uniform"], text("groups_with_several_sets=", F.col("uneven")), "warn"),
        check(F.col("wrong") == 0, ARCHIVE_NAMES["samples"], text("failures=", F.col("failed"), ", other counts=", F.col("wrong") - F.col("failed"))),
    )


def run_audit(spark: SparkSession, features: DataFrame, baseline: DataFrame, statistics: DataFrame, metrics: DataFrame, predictions: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Content checks of a run's tables: unique participants, finite values, baseline total, q range, metric range,
    out-of-fold coverage and failures. One aggregation for each table."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    numbers = [c for c, kind in features.dtypes if kind in ("double", "float")]
    bad = sum((F.coalesce((~is_finite(F.col(c).cast("double"))).cast("long"), F.lit(1)) for c in numbers), F.lit(0))
    f = features.agg(F.count("*").alias("rows"), F.countDistinct("participant_id").alias("unique"), F.coalesce(F.sum(bad), F.lit(0)).alias("nonfinite"))
    out = checks_of(
        f, check(F.col("rows") == F.col("unique"), AUDIT_NAMES["unique"], text("rows=", F.col("rows"), ", unique=", F.col("unique"))),
        check(F.col("nonfinite") == 0, AUDIT_NAMES["finite"], text("nonfinite=", F.col("nonfinite")), "warn"),
    )
    b = baseline.agg(F.sum("n").alias("n")).crossJoin(f)
    out = out.unionByName(checks_of(b, check(F.col("n") == F.col("unique"), AUDIT_NAMES["baseline"], text("baseline=", F.col("n"), ", features=", F.col("unique")))))
    s = statistics.agg(F.count("*").alias("rows"), F.coalesce(F.sum((~F.coalesce(F.col("q_value").between(0, 1), F.lit(False))).cast("long")), F.lit(0)).alias("bad"), F.sum((F.col("q_value") < 0.05).cast("long")).alias("hits"))
    out = out.unionByName(checks_of(s, check(F.col("bad") == 0, AUDIT_NAMES["q_range"], text("rows=", F.col("rows"), ", below 0.05=", F.coalesce("hits", F.lit(0))))))
    ranged = [F.coalesce(F.sum((~F.col(c).between(0, 1)).cast("long")), F.lit(0)) for c in ("accuracy", "balanced_accuracy", "auc_ovr")]
    m = metrics.agg(F.count("*").alias("models"), sum(ranged[1:], ranged[0]).alias("bad"), F.max_by("model", "balanced_accuracy").alias("best"))
    out = out.unionByName(checks_of(m, check(F.col("bad") == 0, AUDIT_NAMES["metric_range"], text("models=", F.col("models"), ", best=", F.coalesce("best", F.lit("none"))))))
    covered = predictions.groupBy("model").agg(F.count("*").alias("rows"), F.countDistinct("participant_id").alias("seen"))
    covered = metrics.select("model").distinct().join(covered, "model", "left").crossJoin(f.select("unique"))
    c = covered.agg(F.coalesce(F.sum((~F.coalesce((F.col("seen") == F.col("unique")) & (F.col("rows") == F.col("seen")), F.lit(False))).cast("long")), F.lit(0)).alias("bad"))
    out = out.unionByName(checks_of(c, check(F.col("bad") == 0, AUDIT_NAMES["coverage"], text("models without full coverage=", F.col("bad")))))
    n = failures.agg(F.count("*").alias("n")) if failures is not None else spark.range(1).select(F.lit(0).cast("long").alias("n"))
    return out.unionByName(checks_of(n, check(F.col("n") == 0, AUDIT_NAMES["failed"], text("failed=", F.col("n")), "warn")))


def manifest(files: DataFrame, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """path (below root), size_bytes, sha256 (upper case) of a binaryFile scan."""
    relative = F.regexp_replace("path", F.lit("^(file:)?/*" + root.removeprefix("file:").strip("/").replace(".", r"\.") + "/"), F.lit(""))
    out = files.select(relative.alias("path"), F.col("length").alias("size_bytes"), F.upper(F.sha2("content", 256)).alias("sha256"))
    return out.where(~F.element_at(F.split("path", "/"), -1).isin(*ignore)) if ignore else out


def manifest_differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """path, problem (missing, unexpected, size, content) of every file that differs."""
    a = expected.select("path", F.col("size_bytes").alias("a_size"), F.col("sha256").alias("a_sha"))
    b = found.select("path", F.col("size_bytes").alias("b_size"), F.col("sha256").alias("b_sha"))
    both = a.join(b, "path", "full_outer")
    problem = F.when(F.col("b_sha").isNull(), "missing").when(F.col("a_sha").isNull(), "unexpected").when(F.col("a_size") != F.col("b_size"), "size").when(F.col("a_sha") != F.col("b_sha"), "content")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def same_rows(a: DataFrame, b: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """One row: rows only in a and only in b, repeats counted, over the columns that are not ignored."""
    columns = [c for c in a.columns if c not in ignore]
    a, b = a.select(*columns), b.select(*columns)
    return a.exceptAll(b).agg(F.count("*").alias("only_left")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_right")))


def content_digest(files: DataFrame) -> DataFrame:
    """sha256 over the sorted (path, sha256) lines of a manifest."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat(x["path"], F.lit(":"), x["sha256"])), "\n")
    return files.agg(F.sha2(lines, 256).alias("digest"))


def repeated_clusters(a: DataFrame, b: DataFrame, member: str, digest: str) -> DataFrame:
    """digest, cluster_size, representative of duplicate clusters of a that b has with just the same members.

    Clusters are compared by their sizes and by sums over their members' hashes, so none is gathered in a row.
    """

    def of(t: DataFrame) -> DataFrame:
        one = t.where(F.col(digest).isNotNull()).select(digest, F.col(member).cast("string").alias("_m")).distinct()
        sums = [F.sum(F.xxhash64("_m", F.lit(k)).cast("decimal(38,0)")).alias(f"_s{k}") for k in (1, 2)]
        return one.groupBy(digest).agg(F.count("*").alias("cluster_size"), F.min("_m").alias("representative"), *sums).where("cluster_size > 1")

    return of(a).join(of(b).drop(digest), ["cluster_size", "representative", "_s1", "_s2"], "left_semi").select(digest, "cluster_size", "representative")


def no_conflicts(df: DataFrame, digest: str, label: str) -> None:
    """Raise GateError if content stands under more than one label."""
    found = conflicting_clusters(df, digest, label).limit(20).collect()
    if found:
        raise GateError("; ".join(f"{r[digest]}: {', '.join(map(str, r['labels']))}" for r in found))


def fact_gate(spark: SparkSession, found: dict[str, int], wanted: dict[str, int]) -> DataFrame:
    """Checks that figures equal frozen ones."""
    return spark.createDataFrame([(f"fact:{k}", "pass" if found.get(k) == v else "fail", f"found={found.get(k)}, expected={v}") for k, v in wanted.items()], CHECKS)


def first_of_group(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")
