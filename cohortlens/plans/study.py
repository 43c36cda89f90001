"""A study from its contract: participants, recordings, features, statistics, models, artifacts and audit.

A contract is a mapping (YAML):

    project: {dataset_id, task}
    paths: {participants, recordings, annotations, output_dir}
    participants: {label_column, label_map}
    recordings: {id_pattern, channels, range_bytes}             # vendor files only
    preprocess: {rate, low, high, notch, reference, max_minutes, epoch_seconds, reject, width, reject_annotations}
    features: {bands, regions, ratios, segment, flavour}        # flavour: discovery or archive
    connectivity: {proportional_threshold}
    models: {folds, seed, names, low_epochs}

recordings is Parquet with participant_id, channel and samples, a ZIP archive of channel files, or vendor files (EDF,
BDF, BrainVision: a file or a folder of them), which are read and filtered in chunks. A recording that cannot be used
becomes a row with its error; the others go on. Epochs that overlap an annotation that begins with "bad" are left out
where reject_annotations is set; annotations are a table (participant_id, onset, duration, description) or the files'
own.
"""

from __future__ import annotations

import math
import sys
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.operators import connectivity, glm, integrity, metrics, ml, relational, signal, stats
from cohortlens.sources import archive, artifacts, participants
from cohortlens.sources import recordings as recordings_source
from cohortlens.sources.commits import Log

STEPS = ("read participants", "preprocess recordings", "extract features", "test features", "validate models", "write artifacts", "audit the run")
#: What the audit names an artifact, and where it is.
REQUIRED = {
    "participants table": "participants", "feature matrix": "features", "baseline table": "table1_baseline", "feature statistics": "feature_statistics", "model metrics": "model_metrics",
    "model predictions": "model_predictions", "automated report": "auto_report.md", "agent plan": "plan.md",
}
OPTIONAL = {
    "quality-control report": "qc/qc_report.md", "adjusted analysis": "qc/adjusted_report.md", "residualized analysis": "qc/residualized_report.md", "connectivity report": "connectivity_features",
    "workflow figure": "figures/workflow.md", "connectivity figure": "figures/connectivity_edges", "ROC figure": "figures/roc",
}
#: Fixed value: participants with fewer epochs are left out of the sensitivity analysis.
LOW_EPOCHS = 30
VENDOR = (".edf", ".bdf", ".vhdr")
KEYS = ["participant_id"]


def check_contract(contract: dict) -> dict:
    """The contract; an error for keys that nothing reads, so that no setting is silently without effect."""
    known = {
        "project": {"dataset_id", "task"}, "paths": {"participants", "recordings", "annotations", "output_dir"}, "participants": {"label_column", "label_map"}, "recordings": {"id_pattern", "channels", "range_bytes"},
        "preprocess": {"rate", "low", "high", "notch", "reference", "max_minutes", "epoch_seconds", "reject", "width", "reject_annotations"}, "features": {"bands", "regions", "ratios", "segment", "flavour"},
        "connectivity": {"proportional_threshold"}, "models": {"folds", "seed", "names", "low_epochs"},
    }
    for section, values in contract.items():
        if section.startswith("_"):
            continue
        if section not in known or not set(values) <= known[section]:
            raise ValueError(f"unknown contract keys in {section}: {sorted(set(values) - known.get(section, set()))}")
    return contract


def plan_text(contract: dict) -> str:
    """The steps of a run as a Markdown checklist."""
    project = contract.get("project", {})
    return "\n".join([f"# Plan: {project.get('dataset_id')} ({project.get('task')})", "", *(f"- [ ] {s}" for s in STEPS)]) + "\n"


def read_recordings(spark: SparkSession, contract: dict) -> DataFrame:
    path = artifacts.project_path(contract, contract["paths"]["recordings"])
    if path.endswith(".zip"):
        return archive.read_archive(spark, path).select("participant_id", "channel", "samples", "error")
    return spark.read.parquet(path).select("participant_id", "channel", "samples", F.lit(None).cast("string").alias("error"))


def only_montage(df: DataFrame, kind: str = "kind", montage: tuple[str, ...] = signal.CHANNELS) -> DataFrame:
    """Rows of kind eeg; a recording without any takes its misc channels that the montage knows instead."""
    typed = df.groupBy(*KEYS).agg(F.max((F.col(kind) == "eeg").cast("int")).alias("_some"))
    both = df.join(typed, KEYS)
    return both.where(((F.col("_some") == 1) & (F.col(kind) == "eeg")) | ((F.col("_some") == 0) & (F.col(kind) == "misc") & F.col("channel").isin(*montage))).drop("_some")


def split_failures(recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable channels, and (participant_id, error) of recordings with a bad channel; these are left out as a whole."""
    x = F.col("samples")
    bad = F.coalesce(F.col("error"), F.when(x.isNull() | (F.size(x) == 0), "no samples").when(~signal.all_finite(x), "non-finite samples").when(signal.is_flat(x), "flat channel"))
    marked = recordings.withColumn("_bad", F.when(bad.isNotNull(), F.concat_ws(": ", "channel", bad)))
    sizes = recordings.where(x.isNotNull()).groupBy(*KEYS).agg(F.when(F.min(F.size("samples")) != F.max(F.size("samples")), "unequal sample counts").alias("error")).where("error is not null")
    failures = marked.where("_bad is not null").groupBy(*KEYS).agg(F.min("_bad").alias("error")).unionByName(sizes).groupBy(*KEYS).agg(F.min("error").alias("error"))
    return recordings.drop("error").join(failures, KEYS, "left_anti"), failures


def preprocess(recordings: DataFrame, settings: dict, notes: DataFrame | None = None) -> DataFrame:
    """participant_id, channel, epoch, samples of the epochs that are kept."""
    rate = float(settings["rate"])
    df = recordings.withColumn("samples", F.transform("samples", lambda x: x.cast("double")))
    if settings.get("low") or settings.get("high"):
        df = signal.filtered(df, rate, settings.get("low"), settings.get("high"), tuple(settings.get("notch") or ()), width=float(settings.get("width", 1.0)))
    if settings.get("reference", "average") == "average":
        df = signal.average_reference(df, KEYS)
    if settings.get("max_minutes"):
        df = df.withColumn("samples", signal.crop(F.col("samples"), rate, settings["max_minutes"]))
    return _kept(signal.epochs(df, int(round(settings.get("epoch_seconds", 4) * rate))), settings, notes)


def _kept(epochs: DataFrame, settings: dict, notes: DataFrame | None) -> DataFrame:
    """Epochs without an annotated part and without a range over the limit."""
    if notes is not None and settings.get("reject_annotations"):
        epochs = signal.unannotated(epochs, notes, KEYS, float(settings.get("epoch_seconds", 4)))
    return signal.keep_quiet(epochs, [*KEYS, "epoch"], settings["reject"]) if settings.get("reject") else epochs


def is_vendor(path: str) -> bool:
    """Whether recordings at a path are vendor files: one, or a folder that has some."""
    if path.lower().endswith(VENDOR):
        return True
    try:
        return not path.lower().endswith((".zip", ".parquet")) and bool(recordings_source.list_files(path))
    except (OSError, ValueError):
        return False


def read_chunks(spark: SparkSession, contract: dict) -> DataFrame:
    """participant_id, channel, chunk, rate, samples, error of vendor files; the participant is in the file's name."""
    settings = contract.get("recordings", {})
    chunks = recordings_source.read_recordings(spark, artifacts.project_path(contract, contract["paths"]["recordings"]), tuple(settings.get("channels") or ()), int(settings.get("range_bytes", 32 << 20)))
    return chunks.withColumn("participant_id", _participant(settings)).drop("path")


def _participant(settings: dict):
    name = F.regexp_extract("path", r"([^/]+)\.[A-Za-z]+$", 1)
    found = F.regexp_extract(name, settings.get("id_pattern", r"^(sub-[^_]+)"), 1)
    return F.when(found != "", found).otherwise(name)


def read_annotations(spark: SparkSession, contract: dict) -> DataFrame | None:
    """participant_id, onset, duration, description from the contract's table, or from vendor files."""
    if contract["paths"].get("annotations"):
        table = artifacts.read_table(spark, artifacts.project_path(contract, contract["paths"]["annotations"]))
        return table.select(F.col("participant_id").cast("string"), F.col("onset").cast("double"), F.col("duration").cast("double"), F.col("description").cast("string"))
    path = artifacts.project_path(contract, contract["paths"]["recordings"])
    if not is_vendor(path):
        return None
    notes = recordings_source.read_notes(spark, path).where("error is null")
    return notes.select(_participant(contract.get("recordings", {})).alias("participant_id"), "onset", "duration", "description")


def split_chunk_failures(chunks: DataFrame, rate: float) -> tuple[DataFrame, DataFrame]:
    """As split_failures(), for recordings in chunks; a channel of another sampling rate fails its recording too."""
    x = F.col("samples")
    each = chunks.groupBy(*KEYS, "channel").agg(
        F.min("error").alias("error"), F.sum(F.coalesce(F.size(x), F.lit(0))).alias("n"), F.min(F.coalesce(signal.all_finite(x), F.lit(True))).alias("finite"), F.min(F.array_min(x)).alias("low"), F.max(F.array_max(x)).alias("high"), F.min("rate").alias("slow"), F.max("rate").alias("fast"),
    )
    other = (F.abs(F.col("slow") - rate) > 1e-6 * rate) | (F.abs(F.col("fast") - rate) > 1e-6 * rate)
    bad = F.coalesce(F.col("error"), F.when(F.col("n") <= 0, "no samples").when(~F.col("finite"), "non-finite samples").when(F.col("low") == F.col("high"), "flat channel").when(other, "another sampling rate"))
    marked = each.withColumn("_bad", F.when(bad.isNotNull(), F.concat_ws(": ", "channel", bad)))
    sizes = each.where("n > 0").groupBy(*KEYS).agg(F.when(F.min("n") != F.max("n"), "unequal sample counts").alias("error")).where("error is not null")
    failures = marked.where("_bad is not null").groupBy(*KEYS).agg(F.min("_bad").alias("error")).unionByName(sizes).groupBy(*KEYS).agg(F.min("error").alias("error"))
    return chunks.drop("error", "rate").join(failures, KEYS, "left_anti"), failures


def preprocess_chunks(chunks: DataFrame, settings: dict, notes: DataFrame | None = None) -> DataFrame:
    """As preprocess(), for recordings in chunks of equal length: no array holds a recording.

    Chunks are put together to the least number of whole epochs and whole chunks that the filters' reach fits into.
    """
    rate, width = float(settings["rate"]), float(settings.get("width", 1.0))
    size = chunks.agg(F.max(F.size("samples"))).first()[0] or 1
    epoch, filters = int(round(settings.get("epoch_seconds", 4) * rate)), bool(settings.get("low") or settings.get("high"))
    notch = tuple(settings.get("notch") or ())
    reach = sum(len(t) // 2 for t in signal.filter_chain(rate, settings.get("low"), settings.get("high"), notch, width)) if filters else 1
    unit = math.lcm(size, epoch)
    length = unit * max(1, -(-reach // unit))
    together = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "samples"))), lambda c: c["samples"]))
    df = chunks.withColumn("_to", F.floor(F.col("chunk") / (length // size)).cast("long")).groupBy(*KEYS, "channel", F.col("_to").alias("_c")).agg(together.alias("samples")).withColumnRenamed("_c", "chunk")
    if filters:
        df = signal.filtered_chunks(df, [*KEYS, "channel"], rate, settings.get("low"), settings.get("high"), notch, width=width)
    if settings.get("reference", "average") == "average":
        df = signal.average_reference(df, [*KEYS, "chunk"])
    if settings.get("max_minutes"):
        df = signal.crop_chunks(df, rate, settings["max_minutes"], length)
    out = signal.epochs_of_chunks(df, length, epoch)
    return _kept(out.select(*KEYS, "channel", "epoch", "samples"), settings, notes)


def concatenated(epochs: DataFrame) -> DataFrame:
    """participant_id, channel, samples: kept epochs end to end."""
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "samples"))), lambda e: e["samples"]))
    return epochs.groupBy(*KEYS, "channel").agg(joined.alias("samples"))


def features_of(epochs: DataFrame, settings: dict, rate: float) -> DataFrame:
    """participant_id, feature, value; n_epochs is a feature."""
    bands, regions = {k: tuple(v) for k, v in settings.get("bands", relational.BANDS).items()}, settings.get("regions", {})
    ratios = [tuple(r) for r in settings.get("ratios", signal.RATIOS)]
    regions = regions or signal.REGIONS
    if settings.get("flavour", "discovery") == "archive":
        spectra = signal.welch_psd(concatenated(epochs), rate, settings.get("segment", signal.resolution_segment(rate)))
        out = signal.archive_features(signal.band_powers(spectra, [*KEYS, "channel"], bands), KEYS, regions, ratios)
    else:
        spectra = signal.welch_psd(epochs, rate, settings.get("segment", 256), "hamming")
        out = signal.discovery_features(signal.band_powers(spectra, [*KEYS, "channel"], bands, "mean"), KEYS, regions, ratios)
    counts = epochs.groupBy(*KEYS).agg(F.countDistinct("epoch").cast("double").alias("value")).select(*KEYS, F.lit("n_epochs").alias("feature"), "value")
    return out.unionByName(counts)


def harmonised_features(recordings: DataFrame, rate: float, regions: dict = signal.REGIONS, channels: tuple[str, ...] = signal.CHANNELS) -> tuple[DataFrame, DataFrame]:
    """(participant_id, feature, value) of the fixed harmonised vector, and failures: a recording that misses one of the
    channels or has a non-finite or flat one fails as a whole. Average reference, 0.5 Hz resolution, four bands."""
    usable, failures = split_failures(recordings.where(F.col("channel").isin(*channels)).withColumn("error", F.lit(None).cast("string")))
    missing = recordings.groupBy(*KEYS).agg(F.size(F.array_except(F.array(*map(F.lit, channels)), F.collect_set("channel"))).alias("n")).where("n > 0").select(*KEYS, F.concat(F.col("n").cast("string"), F.lit(" channels missing")).alias("error"))
    usable = usable.join(missing, KEYS, "left_anti")
    bands = {k: v for k, v in relational.BANDS.items() if k != "gamma"}
    spectra = signal.welch_psd(signal.average_reference(usable, KEYS), rate, signal.resolution_segment(rate))
    out = signal.archive_features(signal.band_powers(spectra, [*KEYS, "channel"], bands), KEYS, regions)
    wanted = signal.harmonised_names(tuple(bands), tuple(regions))
    return out.where(F.col("feature").isin(*wanted)), failures.unionByName(missing).dropDuplicates(KEYS)


def connectivity_of(epochs: DataFrame, settings: dict, bands: dict, rate: float, length: int) -> tuple[DataFrame, DataFrame]:
    """Connectivity and graph features in long form, and the edges."""
    edges = connectivity.pair_connectivity(epochs, KEYS, connectivity.band_bins({k: tuple(v) for k, v in bands.items()}, rate, length))
    nodes = epochs.select(*KEYS, F.col("channel").alias("node")).distinct().crossJoin(F.broadcast(edges.select("band").distinct()))
    graphs = connectivity.graph_features(edges, nodes, [*KEYS, "band"], float(settings.get("proportional_threshold", 0.2)), "wpli")
    names = ("clustering", "global_efficiency", "mean_strength")
    long = graphs.unpivot([*KEYS, "band"], list(names), "metric", "value").select(*KEYS, F.concat_ws("__", F.lit("graph__wpli"), "band", "metric").alias("feature"), "value")
    return connectivity.connectivity_features(edges, KEYS).unionByName(long), edges


def confound_tests(table: DataFrame, label: str, numbers: list[str], category: str | None = None) -> DataFrame:
    """variable, test, statistic, p_value, effect_size of label groups: Kruskal-Wallis with epsilon squared, chi-squared with V."""
    long = relational.to_long(table, [label], numbers)
    kw = stats.kruskal_wallis(long, label, fdr=False)
    effect = F.greatest(F.lit(0.0), (F.col("statistic") - F.col("groups") + 1) / F.nullif(F.col("n") - F.col("groups"), F.lit(0)))
    out = kw.select(F.col("feature").alias("variable"), F.lit("kruskal").alias("test"), "statistic", "p_value", effect.alias("effect_size"))
    if category:
        chi = stats.chi_square(table, label, category)
        out = out.unionByName(chi.select(F.lit(category).alias("variable"), F.lit("chi2").alias("test"), "statistic", "p_value", F.col("cramers_v").alias("effect_size")))
    return out


def run_study(spark: SparkSession, contract: dict, subjects_limit: int | None = None, output_dir: str | None = None, log: bool = False) -> str:
    """Run a contract and publish its artifacts in one step; returns the folder. The audit's failures raise before.

    With log the run stays where it is written and a commit makes it current, which needs no rename.
    """
    check_contract(contract)
    out = output_dir or artifacts.project_path(contract, contract["paths"]["output_dir"])
    if log:
        commits = Log(spark, out)
        run, parent = commits.begin()
        artifacts.Folder(spark, run).make()
        try:
            _fill(spark, contract, subjects_limit, run)
        except BaseException:
            artifacts.Folder(spark, run).remove()
            raise
        commits.commit(run, parent)
        return commits.path()
    staging = f"{out}.staging"
    folder = artifacts.Folder(spark, staging)
    folder.remove()
    folder.make()
    try:
        _fill(spark, contract, subjects_limit, staging)
        artifacts.publish(spark, staging, out)
    finally:
        folder.remove()  # what a gate has refused does not stay behind
    return out


def _fill(spark: SparkSession, contract: dict, subjects_limit: int | None, staging: str) -> None:
    """All artifacts of a run in its staging folder; the audit's failures raise."""
    people = participants.read_participants(spark, artifacts.project_path(contract, contract["paths"]["participants"]), **contract.get("participants", {}))
    people = people.dropDuplicates(KEYS)
    if subjects_limit:
        people = relational.stratified_head(people, subjects_limit, "label", KEYS)
    people = people.select("participant_id", "label", *(c for c in ("Age", "MMSE", "Gender") if c in people.columns)).persist()
    numbers = {n.lower(): n for n in ("Age", "MMSE") if n in people.columns}
    counts = {"female_n": F.col("Gender") == "F", "male_n": F.col("Gender") == "M"} if "Gender" in people.columns else {}

    settings, wanted = contract["preprocess"], contract.get("features", {})
    rate, length = float(settings["rate"]), int(round(settings.get("epoch_seconds", 4) * float(settings["rate"])))
    notes = read_annotations(spark, contract) if settings.get("reject_annotations") else None
    mine = lambda df: df.join(people.select(*KEYS), KEYS, "left_semi")
    if is_vendor(artifacts.project_path(contract, contract["paths"]["recordings"])):
        usable, failures = split_chunk_failures(mine(read_chunks(spark, contract)), rate)
        epochs = preprocess_chunks(usable, settings, notes).persist()
    else:
        usable, failures = split_failures(mine(read_recordings(spark, contract)))
        epochs = preprocess(usable, settings, notes).persist()
    silent = people.select(*KEYS).join(epochs, KEYS, "left_anti").join(failures, KEYS, "left_anti").withColumn("error", F.lit("no epochs"))
    long = features_of(epochs, wanted, rate).persist()
    names = [r["feature"] for r in long.select("feature").distinct().orderBy("feature").collect()]  # a contract's feature names
    wide = relational.to_wide(long, KEYS, names).join(people, KEYS)
    artifacts.write_csv(wide, f"{staging}/features", single=True)
    artifacts.write_csv(relational.baseline(wide.select(*people.columns), "label", numbers, counts), f"{staging}/table1_baseline", single=True)
    artifacts.write_csv(failures.unionByName(silent), f"{staging}/failed_subjects", single=True)
    labelled = long.where("feature <> 'n_epochs'").join(people.select("participant_id", "label"), KEYS)
    tests = stats.kruskal_wallis(labelled)
    artifacts.write_csv(tests.orderBy("q_value", "p_value", "feature"), f"{staging}/feature_statistics", single=True)
    artifacts.write_csv(stats.mann_whitney(labelled, stats.label_pairs(people)), f"{staging}/pairwise_statistics", single=True)
    bands = wanted.get("bands", relational.BANDS)
    connected, edges = connectivity_of(epochs, contract.get("connectivity", {}), bands, rate, length)
    artifacts.write_csv(connected, f"{staging}/connectivity_features", single=True)
    artifacts.write_csv(display_edges(edges.join(people.select("participant_id", "label"), KEYS), "label"), f"{staging}/figures/connectivity_edges", single=True)
    artifacts.write_csv(people, f"{staging}/participants", single=True)
    models = contract.get("models", {})
    grids = {m: ml.GRIDS[m] for m in models.get("names", ["logistic"])}
    features = [n for n in names if n != "n_epochs"]
    pred = ml.nested_cv(wide, "participant_id", "label", features, grids, models.get("folds", 5), models.get("seed", 42)).persist()
    classes = [r["label"] for r in people.select("label").distinct().orderBy("label").collect()]
    probs = pred.select("model", "true_label", *(F.col("probs")[c].alias(f"prob_{i}") for i, c in enumerate(classes)))
    scores = metrics.accuracy(pred, ["model"]).join(metrics.auc_ovr(probs, ["model"], "true_label", {c: f"prob_{i}" for i, c in enumerate(classes)}), "model", "left")
    artifacts.write_csv(scores, f"{staging}/model_metrics", single=True)
    artifacts.write_csv(pred.drop("probs"), f"{staging}/model_predictions", single=True)
    folder = artifacts.Folder(spark, staging)
    folder.write_text("plan.md", plan_text(contract))
    folder.write_text("figures/workflow.md", workflow_text(contract))
    points = [metrics.roc_curve(probs.withColumn("class", F.lit(c)), ["model", "class"], F.col("true_label") == c, f"prob_{i}", drop_intermediate=True) for i, c in enumerate(classes)]
    artifacts.write_csv(reduce(DataFrame.unionByName, points), f"{staging}/figures/roc", single=True)
    extensions(folder, wide, long, people, features, models)
    folder.write_text("auto_report.md", report_text(contract, tests.orderBy("q_value", "feature"), scores))
    checks = audit_folder(spark, staging)
    integrity.require(checks)
    write_audit(spark, staging, checks, contract)
    for frame in (people, epochs, long, pred):
        frame.unpersist()


def report_text(contract: dict, tests: DataFrame, scores: DataFrame) -> str:
    project = contract.get("project", {})
    return f"# {project.get('dataset_id')}: {project.get('task')}\n\n## Features\n\n{artifacts.markdown_table(tests)}\n\n## Models\n\n{artifacts.markdown_table(scores)}\n"


def workflow_text(contract: dict) -> str:
    """The run's steps as a flow chart in Mermaid's notation."""
    lines = [f"    s{i}[{step}]" for i, step in enumerate(STEPS)] + [f"    s{i} --> s{i + 1}" for i in range(len(STEPS) - 1)]
    return "\n".join([f"# Workflow of {contract.get('project', {}).get('dataset_id')}", "", "```mermaid", "flowchart TD", *lines, "```", ""])


def extensions(folder: artifacts.Folder, wide: DataFrame, long: DataFrame, people: DataFrame, features: list[str], models: dict) -> None:
    """Reports beside the main one: epochs and what leaving out participants with few of them does, regression with
    covariates, and models with covariates taken out within each fold. Where the cohort does not allow one it says so."""
    folds, seed, least = models.get("folds", 5), models.get("seed", 42), models.get("low_epochs", LOW_EPOCHS)
    counts = long.where("feature = 'n_epochs'").join(people.select(*KEYS, "label"), KEYS)
    few = counts.where(F.col("value") < least)
    each = counts.groupBy("label").agg(F.count("*").alias("n"), F.min("value").alias("fewest"), F.avg("value").alias("mean"), F.sum((F.col("value") < least).cast("long")).alias("low"))

    def judged(cohort: DataFrame, nuisance: list[str] | None = None) -> str:
        try:
            pred = ml.nested_cv(cohort, "participant_id", "label", features, {"logistic": ml.GRIDS["logistic"]}, folds, seed, nuisance)
            return artifacts.markdown_table(metrics.accuracy(pred, ["model"]))
        except ValueError as e:
            return f"Not possible: {e}."

    rest = wide.join(few.select(*KEYS), KEYS, "left_anti")
    folder.write_text("qc/qc_report.md", f"# Quality control\n\n## Epochs\n\n{artifacts.markdown_table(each.orderBy('label'))}\n\n## Participants with {least} epochs or more\n\n{judged(rest)}\n")
    covariates = [c for c in ("Age", "Gender") if c in people.columns]
    coded = wide.withColumn("Gender", F.when(F.col("Gender") == "F", 1.0).when(F.col("Gender") == "M", 0.0)) if "Gender" in covariates else wide
    labels = [r["label"] for r in people.select("label").distinct().orderBy("label").limit(glm.MOST_CLASSES).collect()]
    if covariates and len(labels) > 1:
        design = coded.withColumns({f"_is_{i}": (F.col("label") == c).cast("double") for i, c in enumerate(labels) if i})
        tested = [f"_is_{i}" for i in range(1, len(labels))]
        fits = stats.benjamini_hochberg(stats.ols_hc3(design, [*covariates, *tested], features, tested).drop("contrast", "estimate", "robust_se", "z", "contrast_p"))
        adjusted = artifacts.markdown_table(fits.orderBy("q_value", "feature"))
    else:
        adjusted = "No covariates."
    folder.write_text("qc/adjusted_report.md", f"# Labels beside {', '.join(covariates) or 'nothing'}\n\n{adjusted}\n")
    folder.write_text("qc/residualized_report.md", f"# Models without {', '.join(covariates) or 'anything'}\n\n{judged(coded, covariates) if covariates else 'No covariates.'}\n")


def audit_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Artifact and content checks of a run's folder, 22 in all; missing or empty tables are failures, optional ones warnings."""
    held = artifacts.Folder(spark, folder)
    there = {n: held.size(n) > 0 for n in (*REQUIRED.values(), *OPTIONAL.values(), "failed_subjects")}
    rows = [(f"artifact:{k}", "pass" if there[n] else "fail", n) for k, n in REQUIRED.items()] + [(f"extension:{k}", "pass" if there[n] else "warn", n) for k, n in OPTIONAL.items()]
    out = spark.createDataFrame(rows, integrity.CHECKS)
    if all(there[n] for n in REQUIRED.values()):
        csv = lambda n: spark.read.option("header", "true").option("inferSchema", "true").csv(f"{folder}/{n}")
        text = lambda df: df.withColumn("participant_id", F.col("participant_id").cast("string"))
        failed = csv("failed_subjects") if there["failed_subjects"] and csv("failed_subjects").columns else None
        out = out.unionByName(integrity.run_audit(spark, text(csv("features")), csv("table1_baseline"), csv("feature_statistics"), csv("model_metrics"), text(csv("model_predictions")), failed))
    return out


def write_audit(spark: SparkSession, folder: str, checks: DataFrame, contract: dict) -> None:
    """audit.json, audit.md, provenance.json and the manifest of all other files."""
    held = [r.asDict() for r in checks.collect()]
    status = integrity.roll_up(checks).first().asDict()
    out = artifacts.Folder(spark, folder)
    out.write_text("audit.json", artifacts.json_text({"summary": status, "checks": held}))
    out.write_text("audit.md", f"# Audit: {status['status']}\n\n{artifacts.markdown_table(checks, 200)}\n")
    inputs = {n: artifacts.Folder(spark, artifacts.project_path(contract, p)).listing() for n, p in contract.get("paths", {}).items() if n != "output_dir"}
    record = {"command": sys.argv, "inputs": inputs, "created": datetime.now(timezone.utc).isoformat(timespec="seconds"), "software": artifacts.software(), "contract": {k: v for k, v in contract.items() if not k.startswith("_")}}
    out.write_text("provenance.json", artifacts.json_text(record))
    files = artifacts.scan_manifest(spark, folder, ("artifact_manifest.json", "_SUCCESS"))
    out.write_text("artifact_manifest.json", artifacts.json_text([r.asDict() for r in files.orderBy("path").collect()]))


def verify_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, problem of files that differ from the folder's manifest."""
    frozen = spark.read.option("multiLine", "true").json(f"{folder}/artifact_manifest.json").select("path", F.col("size_bytes").cast("long"), "sha256")
    return integrity.manifest_differences(frozen, artifacts.scan_manifest(spark, folder, ("artifact_manifest.json", "_SUCCESS")))


# --- data of figures ------------------------------------------------------------------------------------------


def topography(features: DataFrame, label: str = "label") -> DataFrame:
    """label, band, channel, value and shared limits (low, high) by band, from band_ch features with a label."""
    parts = F.split("feature", "__")
    means = features.where(F.col("feature").startswith("band_ch__")).groupBy(label, parts[1].alias("band"), parts[2].alias("channel")).agg(F.avg("value").alias("value"))
    return means.join(relational.padded_limits(means, ["band"], "value"), "band")


def display_edges(edges: DataFrame, label: str, k: int = 20, value: str = "wpli") -> DataFrame:
    """label, band, source, target, value: the k largest group means of edges with a label."""
    means = edges.groupBy(label, "band", "source", "target").agg(F.avg(value).alias("value"))
    order = Window.partitionBy(label, "band").orderBy(F.desc("value"), "source", "target")
    return means.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
