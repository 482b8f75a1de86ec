"""The driver tables seen as intervals, bins, labels and codes; the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.scalar import draw, epoch_seconds
from quillon.operators.ranks import explode_vectors
from quillon.operators.vectors import topk_codes

WIDTH, LENGTH = 3600, 1800
K = 8
TYPES = ("click", "purchase")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spans(spark: SparkSession, sf: str, length: int = LENGTH) -> DataFrame:
    """Events as intervals: a user is a chrom, seconds are positions, the type is the concept."""
    at = epoch_seconds(F.col("ts"))
    return table(spark, sf, "events").select("event_id", F.concat(F.lit("u"), "user_id").alias("chrom"), at.alias("start"), (at + length).alias("end"), F.col("event_type").alias("concept"), "value")


def hours(spark: SparkSession, sf: str) -> DataFrame:
    """The bins in which a chrom has events."""
    low = (F.floor(F.col("start") / WIDTH) * WIDTH).alias("bin_start")
    return spans(spark, sf).select("chrom", low).distinct().withColumn("bin_end", F.col("bin_start") + WIDTH)


def channels(spark: SparkSession, sf: str) -> DataFrame:
    return explode_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding")


def codes(spark: SparkSession, sf: str) -> DataFrame:
    return topk_codes(table(spark, sf, "embeddings"), "vec_id", "embedding", K)


def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    """(id, concept, y): every label against the rest; ten labels."""
    own = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("concept"))
    return own.select("id", "concept", (F.col("label") == F.col("concept")).cast("int").alias("y"))


def weights(spark: SparkSession, channels: int = 64, features: int = 256) -> DataFrame:
    """(channel, feature, w): a dictionary drawn by hash, from -1 to 1."""
    grid = spark.range(channels * features).select((F.col("id") % channels).cast("int").alias("channel"), F.floor(F.col("id") / channels).cast("int").alias("feature"))
    return grid.withColumn("w", (draw(F.lit("w"), F.col("channel"), F.col("feature")) % 20001 - 10000) / 10000.0)


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    text = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.alias("sequence"))


EV = f"ev AS (SELECT event_id, 'u' || user_id AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + {LENGTH} AS e, event_type AS concept, value FROM events)"
HOURS = f"hours AS (SELECT DISTINCT chrom, s // {WIDTH} * {WIDTH} AS b, s // {WIDTH} * {WIDTH} + {WIDTH} AS be FROM ev)"
CHANNELS = "ch AS (SELECT vec_id AS id, CAST(i - 1 AS INTEGER) AS feature, embedding[i] AS value FROM embeddings, range(1, 65) r(i))"
CODES = f"codes AS (SELECT id, feature, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, feature) AS rn FROM ch) WHERE rn <= {K} AND value > 0)"
ONE_HOT = "lab AS (SELECT vec_id AS id, CAST(c AS INTEGER) AS concept, CAST(label = c AS INTEGER) AS y FROM embeddings, range(0, 10) r(c))"
SEQ = "seq AS (SELECT doc_id AS id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS sequence FROM documents)"


def merged_sql(source: str, name: str) -> str:
    """CTEs that merge the intervals (chrom, s, e) of a relation."""
    return f"""{name}_r AS (SELECT chrom, s, e, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
{name}_i AS (SELECT chrom, s, e, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM {name}_r),
{name} AS (SELECT chrom, min(s) AS s, max(e) AS e FROM {name}_i GROUP BY chrom, isl)"""


def subtracted_sql(left: str, right: str, name: str) -> str:
    return f"""{name}_p AS (SELECT chrom, s AS pos, 1 AS l, 0 AS r FROM {left} UNION ALL SELECT chrom, e, -1, 0 FROM {left} UNION ALL SELECT chrom, s, 0, 1 FROM {right} UNION ALL SELECT chrom, e, 0, -1 FROM {right}),
{name}_g AS (SELECT chrom, pos, sum(l) AS l, sum(r) AS r FROM {name}_p GROUP BY chrom, pos),
{name}_d AS (SELECT chrom, pos AS s, lead(pos) OVER w AS e, sum(l) OVER w AS l, sum(r) OVER w AS r FROM {name}_g WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
{name}_k AS (SELECT chrom, s, e FROM {name}_d WHERE l > 0 AND r = 0 AND e IS NOT NULL),
{merged_sql(name + '_k', name)}"""


def draw_sql(key: str) -> str:
    return f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT)"
