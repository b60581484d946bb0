"""Views that give the event tables the shape of a segmented track (see TESTDATA.md for the tables)."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.core import by_block, halo, with_map

_HELD: WeakKeyDictionary[SparkSession, dict[str, DataFrame]] = WeakKeyDictionary()
LABELS = ["click", "error", "purchase", "signup", "view"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hold(df: DataFrame, name: str) -> DataFrame:
    """Persist a frame that operators read several times; one copy of each name is held.

    What memory can't hold goes to disk, and what is lost with an executor is computed again.
    """
    held = _HELD.setdefault(df.sparkSession, {})
    if name in held:
        held[name].unpersist()
    held[name] = df.persist(StorageLevel.MEMORY_AND_DISK)
    return df


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, chr, start, end, p1, p2, m1, m2): two posterior matrices over the same bins.

    A bin's posteriors are shares of event types among its neighbours, from windows over blocks of events.
    """
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), "event_type", (F.col("user_id") % 5 != 0).alias("counts"))
    one, two = by_block().rowsBetween(-3, 2), by_block().rowsBetween(-2, 3)
    sums = {"n1": F.count("*").over(one), "n2": F.count("*").over(two)}
    for k, label in enumerate(LABELS):
        of = F.col("event_type") == label
        sums |= {f"a{k}": F.count(F.when(of, 1)).over(one), f"b{k}": F.count(F.when(of & F.col("counts"), 1)).over(two)}
    bins = halo(e, 3).withColumns(sums).where("_own")
    p1 = F.array(*[F.col(f"a{k}") / F.col("n1") for k in range(5)])
    p2 = F.array(*[F.col(f"b{k}") / F.col("n2") for k in range(5)])
    chrom = F.concat(F.lit("chr"), (1 + F.floor(F.col("idx") / 4000)).cast("string"))
    start = (F.col("idx") % 4000) * 200
    pairs = with_map(bins.select("idx", chrom.alias("chr"), start.alias("start"), (start + 200).alias("end"), p1.alias("p1"), p2.alias("p2")), LABELS)
    return hold(pairs, "pairs")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation intervals (rid, chr, start, end) from orders."""
    key = F.col("o_orderkey")
    start = (key * 7919) % 780000
    return read(spark, sf_dir, "orders").select(key.alias("rid"), F.concat(F.lit("chr"), (1 + key % 3).cast("string")).alias("chr"), start.alias("start"), (start + 100 + (key % 17) * 90).alias("end"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene_id, chr, start, end, tpm) from parts."""
    key = F.col("p_partkey")
    start = (key * 3571) % 790000
    return read(spark, sf_dir, "part").select(key.alias("gene_id"), F.concat(F.lit("chr"), (1 + key % 3).cast("string")).alias("chr"), start.alias("start"), (start + F.col("p_size") * 60).cast("long").alias("end"), F.col("p_retailprice").alias("tpm"), F.concat(F.lit("t"), (key % 3).cast("string")).alias("gene_type"))


def tss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tss_id, chr, coord) from suppliers."""
    key = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(key.alias("tss_id"), F.concat(F.lit("chr"), (1 + key % 3).cast("string")).alias("chr"), ((key * 7877 + 57) % 790000).alias("coord"))


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(setting, model, cell, state, coverage, auc, max_auc, p, r2): states of runs, from orders by priority, segment, nation and status.

    A state's coverage is its share of the run's orders.
    """
    orders, customers, nations = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    whose = customers.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_mktsegment").alias("model"), F.col("n_name").alias("cell"))
    price = F.col("o_totalprice")
    states = orders.join(whose, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_orderpriority").alias("setting"), "model", "cell", F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"), (F.avg(price) / 500000).alias("auc"), (F.max(price) / 500000).alias("max_auc"), (F.min(price) / 1000000).alias("p"), (F.avg(price) / F.max(price)).alias("r2"))
    total = F.sum("n").over(Window.partitionBy("setting", "model", "cell"))  # a run has three states
    return states.withColumn("coverage", F.col("n") / total).drop("n")
