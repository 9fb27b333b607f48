"""Frame, turn, chunk and feature tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(events: DataFrame, name: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.withColumn(name, (F.row_number().over(w) - 1).cast("long")).withColumnRenamed("user_id", "rec")


#: Event types that may be tracks.
MOST_TRACKS = 64


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, frame, track, prob: a user's n-th event is frame n, an event type a track, prob a 5-frame mean."""
    e = _numbered(table(spark, sf_dir, "events"), "frame").select("rec", "frame", "event_type")
    names = e.select("event_type").distinct().orderBy("event_type").limit(MOST_TRACKS + 1).collect()
    if len(names) > MOST_TRACKS:
        raise ValueError(f"more than {MOST_TRACKS} event types")
    kinds = spark.createDataFrame([(r[0], i) for i, r in enumerate(names)], "event_type string, track int")
    w = Window.partitionBy("rec", "track").orderBy("frame").rowsBetween(-2, 2)
    # One row for each event type, MOST_TRACKS at most.
    grid = e.withColumnRenamed("event_type", "own").crossJoin(F.broadcast(kinds))
    return grid.select("rec", "frame", "track", F.avg((F.col("own") == F.col("event_type")).cast("double")).over(w).alias("prob"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, turn, speaker, dur, start: conversations as speaker turns, 16 characters a second."""
    c = table(spark, sf_dir, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("text")
    return c.select(F.col("conv_id").alias("rec"), "turn", F.col("role").alias("speaker"), (size / 16.0).alias("dur"), (F.coalesce(F.sum(size).over(before), F.lit(0)) / 16.0).alias("start"))


def reference_frames(spark: SparkSession, sf_dir: str, longer: float = 0.0) -> DataFrame:
    """rec, speaker, frame at 1 Hz, active rows only; longer shifts all ends."""
    t = turns(spark, sf_dir)
    a, b = F.bround("start", 0).cast("long"), F.bround(F.col("start") + F.col("dur") + longer, 0).cast("long")
    return t.where(b > a).select("rec", "speaker", F.explode(F.sequence(a, b - 1)).alias("frame")).distinct()


VECTORS = 250
SPEAKERS = [("user", 0), ("system", 1), ("assistant", 2)]


def predicted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, frame, track, prob: the reference one frame late, with drop-outs."""
    ref = reference_frames(spark, sf_dir)
    names = spark.createDataFrame(SPEAKERS, "speaker string, track int")
    grid = ref.select("rec", "frame").distinct().crossJoin(F.broadcast(names))
    late = ref.select("rec", "speaker", (F.col("frame") + 1).alias("frame"), F.lit(1).alias("on"))
    off = F.pmod(F.col("frame") * 7 + F.col("track") * 3, F.lit(11)) == 0
    prob = F.when(off, F.lit(0.3)).when(F.col("on").isNotNull(), F.lit(0.9)).otherwise(F.lit(0.1))
    return grid.join(late, ["rec", "speaker", "frame"], "left").select("rec", "frame", "track", prob.alias("prob"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, chunk, start_sample, samples: a vector is a chunk of 64 samples.

    A recording is a label within VECTORS successive vectors, so that their number grows with the table, not their length.
    """
    rec = F.floor(F.col("vec_id") / VECTORS) * 1_000_000 + F.col("label")
    w = Window.partitionBy("rec").orderBy("vec_id")
    n = (F.row_number().over(w) - 1).cast("long")
    return table(spark, sf_dir, "embeddings").withColumn("rec", rec.cast("long")).select("rec", n.alias("chunk"), (n * 64).alias("start_sample"), F.col("embedding").alias("samples"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, frame, dim, value of the chunks."""
    return chunks(spark, sf_dir).select("rec", F.col("chunk").alias("frame"), F.posexplode("samples").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


def voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, chunk, prob of chunks of 4096 samples."""
    return _numbered(table(spark, sf_dir, "events"), "chunk").select("rec", "chunk", F.least(F.lit(1.0), F.col("value") / 100.0).alias("prob"))


#: The same tables in SQL.
SQL = {
    "fx1": """e0 AS (SELECT user_id AS rec, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame, event_type FROM events),
k0 AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS track FROM (SELECT DISTINCT event_type FROM events) q),
fx1 AS (SELECT e0.rec, e0.frame, k0.track, avg(CASE WHEN e0.event_type = k0.event_type THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
  OVER (PARTITION BY e0.rec, k0.track ORDER BY e0.frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS prob FROM e0 CROSS JOIN k0)""",
    "fx2": """fx2 AS (SELECT conv_id AS rec, turn, role AS speaker, length(text) / 16.0::DOUBLE AS dur,
  coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 16.0::DOUBLE AS start FROM conversations)""",
    "fx3": """fx3 AS (SELECT DISTINCT rec, speaker, unnest(generate_series(CAST(round_even(start, 0) AS BIGINT), CAST(round_even(start + dur, 0) AS BIGINT) - 1)) AS frame
  FROM fx2 WHERE round_even(start + dur, 0) > round_even(start, 0)),
fx3p AS (SELECT DISTINCT rec, speaker, unnest(generate_series(CAST(round_even(start, 0) AS BIGINT), CAST(round_even(start + dur + 2, 0) AS BIGINT) - 1)) AS frame
  FROM fx2 WHERE round_even(start + dur + 2, 0) > round_even(start, 0))""",
    "fx4": """t0 AS (SELECT * FROM (VALUES ('user', 0), ('system', 1), ('assistant', 2)) v(speaker, track)),
fx4 AS (SELECT g.rec, g.frame, t0.track, CASE WHEN (g.frame * 7 + t0.track * 3) % 11 = 0 THEN 0.3::DOUBLE WHEN a.frame IS NOT NULL THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS prob
  FROM (SELECT DISTINCT rec, frame FROM fx3) g CROSS JOIN t0 LEFT JOIN fx3 a ON a.rec = g.rec AND a.speaker = t0.speaker AND a.frame = g.frame - 1)""",
    "fx5": f"""fx5 AS (SELECT rec, CAST(row_number() OVER (PARTITION BY rec ORDER BY vec_id) - 1 AS BIGINT) AS chunk,
  CAST((row_number() OVER (PARTITION BY rec ORDER BY vec_id) - 1) * 64 AS BIGINT) AS start_sample, embedding AS samples
  FROM (SELECT CAST(vec_id // {VECTORS} * 1000000 + label AS BIGINT) AS rec, vec_id, embedding FROM embeddings) q)""",
    "fx6": "fx6 AS (SELECT rec, chunk AS frame, CAST(unnest(range(0, len(samples))) AS INT) AS dim, CAST(unnest(samples) AS DOUBLE) AS value FROM fx5)",
    "fx7": """fx7 AS (SELECT user_id AS rec, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS chunk,
  least(1.0::DOUBLE, value / 100.0::DOUBLE) AS prob FROM events)""",
}
NEEDS = {"fx1": ["fx1"], "fx2": ["fx2"], "fx3": ["fx2", "fx3"], "fx4": ["fx2", "fx3", "fx4"], "fx5": ["fx5"], "fx6": ["fx5", "fx6"], "fx7": ["fx7"]}


def with_views(sql: str, *views: str, recursive: bool = False) -> str:
    """sql, which begins with its own CTEs or SELECT, after the views that it reads."""
    names = list(dict.fromkeys(n for v in views for n in NEEDS[v]))
    own = sql.strip()
    more = own[4:].strip() if own.upper().startswith("WITH") else None
    head = "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(SQL[n] for n in names)
    return f"{head},\n{more}" if more else f"{head}\n{own}"
