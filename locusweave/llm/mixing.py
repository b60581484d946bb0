"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is ``target share * total size / source size``; a document appears as often as a Poisson
variable with that mean says, inverted at a uniform number hashed from the seed, doc_id and text. Copies are then shuffled
globally by a hashed position. All in SQL functions.

Sizes are characters. A null source is a source of its own; null and empty texts have size zero and are kept or repeated
like others; a source without any characters, or a total of zero, has rate one. A null doc_id is hashed as an empty
string. Repeated rows get the same number of copies. An empty table gives an empty result. Columns named like the
operator's own are kept: it works on structs of the whole row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SEED = 17
#: Inversion starts at exp(-rate); a larger rate is a sum of parts of at most this mean.
PART = 256.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def distribution(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, 2 ... for a rate of at most PART, until 12 deviations and 30 above it."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(acc: Column, j: Column) -> Column:
        p = acc["p"] * rate / j
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["c"])


def invert(table: Column, u: Column) -> Column:
    """The least k at which the distribution function exceeds u: as many as its values that don't."""
    return F.least(F.size(F.filter(table, lambda c: c <= u)), F.size(table) - 1)


def repetition_rates(documents: DataFrame, temperature: float = 0.5, targets: dict[str, float] | None = None) -> DataFrame:
    """(source, n_docs, size, weight, rate); target weights are given, or shares of size ** temperature."""
    sizes = documents.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("size"))
    if targets is None:
        raw = F.pow(F.col("size").cast("double"), F.lit(float(temperature)))
    else:
        raw = F.coalesce(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])[F.col("source")], F.lit(0.0)) if targets else F.lit(1.0)
    sizes = sizes.withColumn("raw", raw)
    whole = sizes.agg(F.sum("size").alias("total"), F.sum("raw").alias("sum_raw"))
    rated = sizes.join(F.broadcast(whole))  # one row
    weight = F.when(F.col("sum_raw") > 0, F.col("raw") / F.col("sum_raw")).otherwise(F.lit(0.0))
    rate = F.when((F.col("size") > 0) & (F.col("sum_raw") > 0), F.col("raw") / F.nullif("sum_raw", F.lit(0.0)) * F.col("total") / F.nullif("size", F.lit(0))).otherwise(F.lit(1.0))
    return rated.select("source", "n_docs", "size", weight.alias("weight"), rate.alias("rate"))


def mix_sources(documents: DataFrame, temperature: float = 0.5, targets: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """Every column of ``documents`` in a struct ``doc``, with ``copy`` (from 1), ``copies`` and ``position`` (0 to 1)."""
    rates = repetition_rates(documents.select("source", "text"), temperature, targets)
    # written: both sides of the join are then plain, so a source of a third of all rows can be split among tasks
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    rates = rates.select(F.col("source").alias("rate_of"), "rate", parts.alias("parts"), distribution(F.col("rate") / parts).alias("table"))
    rates = materialize(rates, "rates")
    rows = documents.select(F.col("source").alias("of"), F.struct(*[documents[f"`{c}`"] for c in documents.columns]).alias("doc"))
    joined = rows.join(rates, F.col("of").eqNullSafe(F.col("rate_of")))
    drawn = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda i: uniform(F.lit(seed), F.col("doc.doc_id"), F.md5(F.coalesce(F.col("doc.text"), F.lit(""))), i))
    numbers = joined.withColumn("u", drawn)
    counted = numbers.withColumn("copies", F.aggregate("u", F.lit(0), lambda a, u: a + invert(F.col("table"), u))).where("copies > 0")
    copies = counted.select("doc", "copies", "rate", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    placed = copies.withColumn("position", uniform(F.lit(seed + 1), F.col("doc.doc_id"), F.xxhash64(F.col("doc.text")), F.col("copy")))
    return placed.repartition(F.col("position")).sortWithinPartitions("position")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc.doc_id", "doc.source", "copy", "copies", F.round("rate", 6).alias("rate"), F.length("doc.text").cast("long").alias("n_chars"), F.md5("doc.text").alias("text_md5"))


ORACLE = """
WITH s AS (SELECT source, sum(length(coalesce(text, ''))) AS size, sqrt(CAST(sum(length(coalesce(text, ''))) AS DOUBLE)) AS raw FROM documents GROUP BY source)
, r AS (SELECT source, CASE WHEN size > 0 AND (SELECT sum(raw) FROM s) > 0 THEN raw / (SELECT sum(raw) FROM s) * (SELECT sum(size) FROM s) / size ELSE 1.0 END AS rate FROM s)
, c AS (
  SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM (SELECT source, rate, unnest(range(0, 400)) AS k FROM r)
), u AS (
  SELECT doc_id, source, text, CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':1'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM documents
), n AS (
  SELECT doc_id, u.source, text, c.rate, CAST(count(*) FILTER (cdf <= u) AS INTEGER) AS copies
  FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY doc_id, u.source, text, c.rate
)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, copies, round(rate, 6) AS rate, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM n)
"""
