"""Mixing sources to target weights by random order, prefix sums and an exact cut."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixConfig:
    """``weights`` repeat over the sources in code-point order, null last. ``share`` of all words is
    dealt out; a source gives its words ``epochs`` times at most. ``slice_rows``: rows whose prefix
    sums one task makes, on average."""

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    epochs: int = 2
    seed: str = "mix-1"
    slice_rows: int = 50_000


def source_targets(sizes: DataFrame, cfg: MixConfig) -> DataFrame:
    """(source, source_size, target) for (source, source_size): water-filling, exactly.

    With level L every source gets min(epochs * size, weight * L). In the order of
    epochs * size / weight the sources before a point are full there, so the level follows from
    running sums; sources number far fewer than rows, and meet in one task only as sums.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cfg.weights]), (rank % len(cfg.weights) + 1).cast("int"))
    t = sizes.withColumn("w", weight).withColumn("top", F.col("source_size") * float(cfg.epochs))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    t = t.withColumn("pool", F.sum("source_size").over(every) * float(cfg.share))
    t = t.withColumn("full", F.coalesce(F.sum("top").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("open_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # the level at the first source, in this order, that it doesn't fill; at later ones it would be lower
    level = F.greatest(F.lit(0.0), F.col("pool") - F.col("full")) / F.col("open_w")
    t = t.withColumn("level", F.max(F.when(F.col("w") * level <= F.col("top"), level)).over(every))
    target = F.least("top", F.coalesce(F.col("w") * F.col("level"), F.col("top")))
    return t.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): source, size, source_size, target, taken.

    ``taken`` words of a document enter the mix: whole passes over its source and, in the pass
    that meets the budget, all documents before the cut by random key; the document at the cut
    gives the words that are missing, so that a source's sum is its target rounded to a word. A null text has
    size 0 and gives nothing; rows without source are a source of their own; rows alike in
    doc_id and size are interchangeable. Other columns are ignored.
    """
    tmp = Scratch(docs.sparkSession, "mix")
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(f"{cfg.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = tmp.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key")), "rows")
    totals = tmp.save(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), cfg), "totals")

    # the random keys are uniform, so their ranges hold equal shares of every source
    slices = max(1, -(-rows.count() // cfg.slice_rows))
    cut = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * slices / float(1 << 32)).cast("int")
    rows = rows.withColumn("slice", cut)
    same = ["source", "slice"]
    sums = rows.groupBy(*same).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).select(F.col("source").alias("_s"), F.col("slice").alias("_k"), "base")
    inside = Window.partitionBy(*same).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = rows.withColumn("upto", F.sum("size").over(inside))
    part = part.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slice") == F.col("_k")))
    part = part.join(totals.select(F.col("source").alias("_t"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_t")))
    start = F.col("base") + F.col("upto") - F.col("size")
    budget = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - passes * F.col("source_size")
    taken = passes * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest - start))
    return part.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
