"""Queries of recordings that no array holds: vendor files read by ranges, filters over chunks, annotated spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import storage
from cohortlens.operators import relational, signal
from cohortlens.plans.catalog import RATE, query, r, rounded, table
from cohortlens.sources import recordings

#: Embeddings as two channels of five recordings, in chunks of 32 samples.
LAID_SQL = "select vec_id % 5 as recording, 'ch' || c as channel, vec_id // 5 as chunk, (embedding::double[])[c * 32 + 1:c * 32 + 32] as samples from embeddings, range(0, 2) r(c)"


def laid_out(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    chunks = e.select((F.col("vec_id") % 5).alias("recording"), F.floor(F.col("vec_id") / 5).cast("long").alias("chunk"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.explode(F.array(F.lit(0), F.lit(1))).alias("c"))
    return chunks.select("recording", F.concat(F.lit("ch"), F.col("c").cast("string")).alias("channel"), "chunk", F.slice("x", F.col("c") * 32 + 1, F.lit(32)).alias("samples"))


def _numbered(df):
    """recording, channel, position, value of samples that were read."""
    name = F.regexp_extract("path", r"([^/]+)\.[a-z]+$", 1).cast("long")
    return df.select(name.alias("recording"), "channel", "chunk", F.posexplode("samples").alias("i", "value")).select("recording", "channel", (F.col("chunk") * 32 + F.col("i")).alias("position"), "value")


def _files(spark, sf, kind: str):
    """The recordings written as files of a kind to the shared folder, and the folder."""
    folder = storage.shared_dir(spark, f"recordings-{kind}")
    whole = laid_out(spark, sf)
    recordings.write_recordings(whole, folder, RATE, kind, -4.0, 4.0).foreach(lambda _: None)
    return folder


@query(f"select recording, channel, chunk * 32 + i - 1 as position, samples[i] as value from ({LAID_SQL}), range(1, 33) s(i)")
def vision_files(spark, sf):
    """Signals written as BrainVision files of 32-bit floats and read back by ranges of sample frames: equal, sample by sample."""
    return _numbered(recordings.read_recordings(spark, _files(spark, sf, "vhdr"), range_bytes=4096, frames=32))


@query(f"select recording, channel, chunk * 32 + i - 1 as position, {r('greatest(-32768, least(32767, floor((samples[i] + 4) / (8 / 65535.0::double) + 0.5) - 32768)) * (8 / 65535.0::double) - 4 + 32768 * (8 / 65535.0::double)')} as value from ({LAID_SQL}), range(1, 33) s(i)")
def edf_files(spark, sf):
    """Signals written as EDF files of 16-bit integers and read back by ranges of data records: steps of the physical range."""
    return rounded(_numbered(recordings.read_recordings(spark, _files(spark, sf, "edf"), range_bytes=4096)))


TAPS_SQL = """
sinc as (select m, (case when m = 0 then 36 / 64.0 else (sin(2 * pi() * 20 * m / 64) - sin(2 * pi() * 2 * m / 64)) / (pi() * m) end) * (0.54 - 0.46 * cos(2 * pi() * (m + 26) / 52)) as pass,
  case when m = 0 then 1 else 0 end - (case when m = 0 then 4 / 64.0 else (sin(2 * pi() * 13 * m / 64) - sin(2 * pi() * 11 * m / 64)) / (pi() * m) end) * (0.54 - 0.46 * cos(2 * pi() * (m + 26) / 52)) as notch from range(-26, 27) r(m))"""
MIRROR = "case when o.i + m < 0 then -(o.i + m) when o.i + m >= o.n then 2 * (o.n - 1) - (o.i + m) else o.i + m end"


@query(
    f"""with {TAPS_SQL}, x as (select vec_id % 7 as recording, vec_id // 7 * 64 + i - 1 as i, embedding[i]::double as v, count(*) over (partition by vec_id % 7) as n from embeddings, range(1, 65) s(i)),
at_ as (select o.recording, o.i, m, pass, notch, {MIRROR} as j from x o, sinc),
y as (select at_.recording, at_.i, sum(pass * x.v) as v from at_ join x on x.recording = at_.recording and x.i = at_.j group by all),
z as (select at_.recording, at_.i, sum(notch * y.v) as v from at_ join y on y.recording = at_.recording and y.i = at_.j group by all)
select recording, i as position, {r('v')} as value from z"""
)
def filtered_recordings(spark, sf):
    """Seven recordings in chunks of 64 samples through a band-pass and a notch: every sample, by what neighbours lend."""
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    chunks = e.select((F.col("vec_id") % 7).alias("recording"), F.floor(F.col("vec_id") / 7).cast("long").alias("chunk"), F.col("embedding").alias("samples"))
    out = signal.filtered_chunks(chunks, ["recording"], RATE, 2.0, 20.0, (12.0,), width=4.0)
    return rounded(out.select("recording", "chunk", F.posexplode("samples").alias("i", "value")).select("recording", (F.col("chunk") * 64 + F.col("i")).alias("position"), "value"))


#: Orders as spans of customers' months: an hour at most, but two days for each fiftieth.
SPAN = {"onset": "(o_orderkey * 7919) % 2592000", "seconds": "case when o_orderkey % 50 = 0 then 172800 else o_orderkey % 3600 end"}


@query(
    f"""with span as (select o_custkey % 150 as user_id, {SPAN['onset']} as a, {SPAN['onset']} + {SPAN['seconds']} as b from orders),
e as (select event_id, user_id, event_type, epoch(ts) - epoch(timestamp '2024-01-01') as s from events)
select user_id, event_type, count(*) as n, sum(case when exists (select 1 from span where span.user_id = e.user_id and e.s < b and e.s + 30 > a) then 0 else 1 end)::bigint as kept from e group by all"""
)
def unannotated_events(spark, sf):
    """Half minutes from each event on that overlap no annotated span of their user."""
    e = table(spark, sf, "events", "event_id", "user_id", "event_type", "ts")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1e6
    points = e.select("event_id", "user_id", "event_type", seconds.alias("start"), (seconds + 30).alias("stop"))
    spans = table(spark, sf, "orders", "o_orderkey", "o_custkey").selectExpr("o_custkey % 150 as user_id", f"double({SPAN['onset']}) as start", f"double({SPAN['onset']} + {SPAN['seconds']}) as stop")
    hit = relational.overlapping(points, spans, ["user_id"], 3600.0).select("event_id").withColumn("hit", F.lit(1))
    both = points.join(hit, "event_id", "left")
    return both.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("kept"))
