"""Labels and their posteriors: names, orders, groups, hardening, scaling, filters of rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mnemonic_names(count: int, mnemonics: Iterable[str]) -> list[str]:
    """Names of states 0 .. count - 1: ``id_New_Low`` is cut to ``id_New[:4]_Low[:3]``, an id without a mnemonic is ``id_Unkn``."""
    known = {}
    for whole in mnemonics:
        state, *rest = whole.split("_")
        if len(rest) in (1, 2):
            known[state] = "_".join([state, rest[0][:4], *(x[:3] for x in rest[1:])])
    return [known.get(str(i), f"{i}_Unkn") for i in range(count)]


def ordered(labels: Sequence[str], order: Sequence[str]) -> list[str]:
    """Labels by the place of their name (behind the id) in ``order``; as they are if one isn't in it."""
    place = {x: i for i, x in enumerate(order)}
    names = ["_".join(x.split("_")[1:]) or x for x in labels]
    return list(labels) if any(x not in place for x in names) else [x for _, _, x in sorted((place[n], i, x) for i, (n, x) in enumerate(zip(names, labels, strict=True)))]


def arranged(p: str | Column, labels: Sequence[str], order: Sequence[str]) -> Column:
    """Posteriors in another order of their labels."""
    p = F.col(p) if isinstance(p, str) else p
    return F.array(*[p[list(labels).index(x)] for x in order])


def paired_names(pairs: Sequence[tuple[str, str]]) -> tuple[dict[str, str], dict[str, str]]:
    """Both tracks' labels by the name of their pair, ``i|j``."""
    return {i: f"{i}|{j}" for i, j in pairs}, {j: f"{i}|{j}" for i, j in pairs}


def renamed(label: str | Column, names: dict[str, str]) -> Column:
    """A label by its new name; those without one keep theirs."""
    label = F.col(label) if isinstance(label, str) else label
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[label], label) if names else label


def term_of(label: str, terms: Sequence[str]) -> str:
    """The longest of the terms that a label contains, the first of equal ones; of merged labels (``a+b``) one for each part."""
    return "+".join(max((x for x in terms if x in part), key=len, default=part) for part in label.split("+"))


def group_sums(p: str | Column, groups: Sequence[Sequence[int]]) -> Column:
    """Posteriors summed by groups of label numbers."""
    p = F.col(p) if isinstance(p, str) else p
    total = lambda own: sum((p[i] for i in own[1:]), p[own[0]])
    return F.array(*[total(own) for own in groups])


def hardened(p: str | Column) -> Column:
    """One for the first of the largest posteriors, zero for the others."""
    p = F.col(p) if isinstance(p, str) else p
    first = F.array_position(p, F.array_max(p)) - 1
    return F.transform(p, lambda x, i: (i == first).cast("double"))


def capped(p: str | Column, margin: float) -> Column:
    """Posteriors kept ``margin`` away from zero and one."""
    return F.transform(F.col(p) if isinstance(p, str) else p, lambda x: F.least(F.greatest(x, F.lit(margin)), F.lit(1 - margin)))


def minus_log(p: str | Column, complement: bool = False) -> Column:
    """-ln(p), or -ln(1 - p)."""
    return F.transform(F.col(p) if isinstance(p, str) else p, lambda x: -F.ln(1 - x if complement else x))


def rescaled(rows: DataFrame, p: str, labels: Sequence[str], by_label: bool) -> DataFrame:
    """Posteriors moved to 0 .. 1 by the least and largest of all, or of their label; null where those are equal."""
    facts = rows.agg(*[f(F.col(p)[i]).alias(f"{n}{i}") for i in range(len(labels)) for n, f in (("low", F.min), ("high", F.max))])
    k = range(len(labels))
    low, high = F.array(*[F.col(f"low{i}") for i in k]), F.array(*[F.col(f"high{i}") for i in k])
    if not by_label:
        low, high = F.array_repeat(F.array_min(low), len(labels)), F.array_repeat(F.array_max(high), len(labels))
    one = facts.select(low.alias("_low"), high.alias("_high"))
    scaled = F.transform(F.col(p), lambda x, i: F.try_divide(x - F.col("_low")[i], F.col("_high")[i] - F.col("_low")[i]))
    return rows.crossJoin(F.broadcast(one)).withColumn(p, scaled).drop("_low", "_high")  # one row


def without_overconfident(pairs: DataFrame) -> DataFrame:
    """Rows of which neither track is sure."""
    return pairs.where((F.array_max("p1") < 1) & (F.array_max("p2") < 1))


def complete(pairs: DataFrame) -> DataFrame:
    """Rows without a null or NaN posterior in either track; pairs stay paired."""
    good = lambda p: F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x))
    return pairs.where(good("p1") & good("p2"))


def clean_contigs(rows: DataFrame, column: str = "chr") -> DataFrame:
    """Rows on assembled chromosomes: no unplaced or random contigs, no mitochondrion, no virus."""
    return rows.where(~F.col(column).rlike("chrUn|chrM|chrEBV|random"))


def each_hundredth(rows: DataFrame, step: int = 100) -> DataFrame:
    """A systematic sample: every ``step``-th position."""
    return rows.where(F.col("idx") % step == 0)


def concatenated(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two tracks, or lists of chromosomes, as one: names get the suffixes _1 and _2."""
    return one.withColumn("chr", F.concat("chr", F.lit("_1"))).unionByName(two.withColumn("chr", F.concat("chr", F.lit("_2"))))


def in_order(rows: DataFrame, label: str) -> DataFrame:
    """(label, first): distinct labels with the position at which each is first seen."""
    return rows.groupBy(F.col(label).alias("label")).agg(F.min("idx").alias("first"))
