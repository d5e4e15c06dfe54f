"""Shared pieces: scratch tables, connected components, vectorised text hashing."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only where all runs in one process (tests)."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="tessera-"))
    return f"file://{_LOCAL_DIR[0]}"


class Scratch:
    """Intermediate tables of one operator call, as Parquet in the shared checkpoint folder.

    A written table cuts lineage and outlives lost executors. ``drop`` deletes a table
    that no later step reads; ``release`` lets Spark delete shuffle files of finished jobs.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        gc.collect()  # frames that Python still holds keep their shuffle files
        self.spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Alternating large-star / small-star contraction.

    ``edges`` has columns ``a`` and ``b`` of one orderable type. Returns ``(node, label)``
    for every node of an edge, label being the least node of its component. Minima are
    partial aggregates and go back under a name of their own (``node``): with an exchange on either side Spark
    can split the rejoin, so a hub doesn't meet in one task.
    """
    def down(df: DataFrame) -> DataFrame:
        return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = e.groupBy("a").agg(F.max("a").alias("node"), F.min("b").alias("lo")).select("node", F.least("node", "lo").alias("m"))
        joined = e.join(least, F.col("a") == F.col("node"))
        if large:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))

    def settled(e: DataFrame) -> bool:
        """Every node points to one root at most, and no root points on."""
        ends = e.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("root")).unionByName(e.select(F.col("b").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("root")))
        odd = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("root").alias("root")).filter("out > 1 or (out = 1 and root = 1)")
        return odd.agg(F.count(F.lit(1))).first()[0] == 0

    cur, r = scratch.save(down(edges.select("a", "b")), f"{tag}-0"), 0
    while not settled(cur):
        r += 1
        if r > max_rounds:
            raise RuntimeError("components did not settle")
        cur = scratch.save(down(star(star(cur, True), False)), f"{tag}-{r}")
        scratch.drop(f"{tag}-{r - 1}")
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as set it apart from ``columns`` (whose case doesn't count)."""
    used, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def link_groups(cells: DataFrame, verify, scratch: Scratch, traits: DataFrame, may, early: tuple[str, ...] = (), need: int = 1, pivots: int = 6, large: int = 1024, narrow: int = 32, passes: int = 1, done=None, meet=None) -> DataFrame:
    """Components (node, label) of the links among keys that share ``need`` cells of ``cells`` (cell, h) at least, or, if that is 2, one cell of an odd number.

    ``traits`` (key, h, ...) names the keys behind a 64-bit ``h``, so that the many cells that
    hold one key move as two longs; a key is in a cell once. ``may(a, b)`` is a condition on two keys' traits, by prefix, that links meet.
    More columns of ``cells`` go with a key's cell, and ``meet(a, b)`` is a condition on them and on ``early``, by prefix: a cell that doesn't meet it isn't shared.
    The traits named ``early`` travel with the cells; if they are all that ``may`` needs, pairs are pruned where they arise.
    ``verify`` takes pairs (a, b), a < b, and returns those that are links. A key has a bounded number of cells.

    In cells of up to ``narrow`` keys all pairs meet. In others, as far as their keys lie in several components, each key is verified against
    2, then ``pivots`` keys of least hashes that lie in another one, so that a group of alike keys costs a bounded number of pairs a key; then all
    pairs that are still apart meet, in blocks of ``large`` keys by ``large``, so that no task has a large cell to itself. No link is lost.
    Nodes without any link are not returned. The cells move in ``passes`` parts, one after the other, which bounds the disk; then ``done`` is called: ``cells`` aren't read again.
    """
    parts, own_columns = [], tuple(c for c in cells.columns if c not in ("cell", "h"))
    for i in range(passes):
        own = cells.filter(F.pmod(F.xxhash64("cell"), F.lit(passes)) == i) if passes > 1 else cells
        dealt = own.repartition(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), "cell")
        # either side reads the same exchange, so both take h; the cells are on disk once
        shared = dealt.groupBy("cell").agg(F.min("h").alias("x"), F.max("h").alias("y"), F.count(F.lit(1)).alias("cell_n")).filter("x <> y").select(F.col("cell").alias("_c"), "cell_n")
        part = dealt.join(shared.hint("shuffle_hash"), F.col("cell") == F.col("_c")).select("cell", "cell_n", "h", *own_columns)
        parts.append(scratch.save(part, f"shared-{i}") if passes > 1 else part)
        if passes > 1:
            scratch.release()
    if done and passes > 1:
        done()
    live = reduce(DataFrame.unionByName, parts)
    live = scratch.save(live.join(traits.select("h", "key", *early), "h").select("cell", "cell_n", "key", *early, *own_columns), "live")
    for i in range(passes):
        scratch.drop(f"shared-{i}")
    if done and passes == 1:
        done()
    scratch.release()
    ahead = may if early else None
    weight = 1 + F.col("cell").bitwiseAND(F.lit(1))

    def met(rows: DataFrame, on: tuple[str, ...], other: DataFrame, prune) -> DataFrame:
        """(a, b, w) of the pairs of ``rows`` and ``other`` that meet, w being what the cells that they share weigh."""
        left, right = (x.select(*(F.col(c).alias(f"{p}_{c}") for c in x.columns)) for p, x in (("a", rows), ("b", other)))
        both = reduce(and_, (F.col(f"a_{c}") == F.col(f"b_{c}") for c in on)) & (F.col("a_key") < F.col("b_key"))
        if "label" in rows.columns:
            both &= F.col("a_label") != F.col("b_label")
        for more in filter(None, (meet, prune)):
            both &= more("a", "b")
        pairs = left.join(right, both)
        return pairs.groupBy(F.col("a_key").alias("a"), F.col("b_key").alias("b")).agg(F.sum(1 + F.col("a_cell").bitwiseAND(F.lit(1))).alias("w"))

    def against(rows: DataFrame, chosen: dict, carried: tuple[str, ...]) -> DataFrame:
        """(a, b) of each key and its cell's chosen ones that share enough cells."""
        picked = rows.groupBy("cell").agg(F.max("cell").alias("_c"), *(v.alias(k) for k, v in chosen.items())).drop("cell")
        far = [F.when((F.col("key") != F.col(f"{k}.key")) & (F.col("label") != F.col(f"{k}.label")), F.col(k)) for k in chosen]
        near = rows.join(picked, F.col("cell") == F.col("_c")).select(weight.alias("w"), *(F.col(c).alias(f"a_{c}") for c in carried), F.array_distinct(F.array_compact(F.array(*far))).alias("ps")).filter(F.size("ps") > 0)
        if need == 1:  # the cells of a key mostly have the same chosen ones: each pair is made once
            near = near.groupBy(*(f"a_{c}" for c in carried)).agg(F.max("w").alias("w"), F.array_distinct(F.flatten(F.collect_list("ps"))).alias("ps"))
        near = near.select("w", *(f"a_{c}" for c in carried), F.explode("ps").alias("p"))
        near = near.select("*", *(F.col(f"p.{c}").alias(f"b_{c}") for c in carried))
        for more in filter(None, (meet, ahead)):
            near = near.filter(more("a", "b"))
        # a cell holds a pair of two pivots twice
        near = near.select("w", (F.col("a_key") > F.col("b_key")).alias("turned"), F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b"))
        if need == 1:
            return near.select("a", "b").distinct()
        return near.groupBy("a", "b", "turned").agg(F.sum("w").alias("w")).filter(F.col("w") >= need).select("a", "b").distinct()

    def apart(comp: DataFrame, more: tuple[str, ...], tag: str) -> DataFrame:
        """The rows of the wide cells whose keys lie in several components, with their labels and traits."""
        placed = traits.select("key", *more).join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        rows = scratch.save(wide.select("cell", "key", *own_columns).join(placed, "key"), f"{tag}-all")  # read twice, joined once
        mixed = rows.groupBy("cell").agg(F.max("cell").alias("_c"), F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("cell_n")).filter("x <> y").select("_c", "cell_n")
        found = scratch.save(rows.join(mixed, F.col("cell") == F.col("_c")).select("cell", "cell_n", "key", "label", *own_columns, *more), tag)
        scratch.drop(f"{tag}-all")
        return found

    def joined(comp: DataFrame, links: DataFrame, tag: str) -> DataFrame:
        known = comp.select(F.col("node").alias("a"), F.col("label").alias("b"))
        return scratch.save(connected_components(known.unionByName(links), scratch, tag), tag)

    few, wide = live.filter(F.col("cell_n") <= narrow), live.filter(F.col("cell_n") > narrow)
    few = scratch.save(met(few, ("cell",), few, ahead), "pairs-0")
    seen = few.filter(F.col("w") >= need).select("a", "b")
    comp = scratch.save(connected_components(scratch.save(verify(seen), "edges"), scratch, "first"), "first")
    scratch.release()
    if not wide.take(1):
        return comp

    for r, k in enumerate((2, pivots)):
        still = apart(comp, early, f"still-{r}")
        if not still.take(1):
            return comp
        some = {f"p{j}": F.min(F.struct(F.xxhash64(F.lit(j + 2 * r), "key").alias("by"), F.struct("key", "label", *early, *own_columns).alias("m"))).getField("m") for j in range(k)}
        pairs = scratch.save(against(still, some, ("key", "label", *early, *own_columns)).join(seen, ["a", "b"], "left_anti"), f"pairs-{r + 1}")
        scratch.drop(f"still-{r}")
        if pairs.take(1):
            comp, seen = joined(comp, scratch.save(verify(pairs), f"links-{r}"), f"round-{r}"), seen.unionByName(pairs)
        scratch.release()

    last = apart(comp, tuple(c for c in traits.columns if c not in ("key", "h")), "last-rows")
    scratch.drop("live")
    scratch.release()
    if not last.take(1):
        return comp
    blocks = F.ceil(F.col("cell_n") / large).cast("int")
    last = last.withColumn("own", F.pmod(F.xxhash64(F.lit(-1), "key"), blocks).cast("int")).withColumn("all", F.sequence(F.lit(0), blocks - 1)).drop("cell_n")
    by_row, by_column = last.withColumn("i", F.col("own")).withColumn("j", F.explode("all")), last.withColumn("i", F.explode("all")).withColumn("j", F.col("own"))
    cross = met(by_row.drop("own", "all"), ("cell", "i", "j"), by_column.drop("own", "all"), may)
    if need > 1:  # what a pair shares of narrow cells counts with it
        cross = cross.unionByName(few.filter(F.col("w") < need)).groupBy("a", "b").agg(F.sum("w").alias("w"))
    cross = scratch.save(cross.filter(F.col("w") >= need).select("a", "b").join(seen, ["a", "b"], "left_anti"), "cross")
    scratch.drop("last-rows")
    scratch.release()
    if not cross.take(1):
        return comp
    links = scratch.save(verify(cross), "links-last")
    scratch.release()
    return joined(comp, links, "last") if links.take(1) else comp


_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Substring hashes of a byte array from one prefix sum (polynomial modulo 2^64, then mixed)."""

    def __init__(self):
        self.pow = np.ones(1, np.uint64)
        self.inv = np.ones(1, np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True

    def _grow(self, n: int) -> None:
        if len(self.pow) < n:
            n = max(n, 1 << 17)
            for name, base in (("pow", _BASE), ("inv", _BASE_INV)):
                t = np.full(n, base, np.uint64)
                t[0] = 1
                setattr(self, name, np.multiply.accumulate(t))

    def prefix(self, a: np.ndarray) -> np.ndarray:
        n = len(a)
        self._grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * self.pow[:n], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (prefix[end] - prefix[start]) * self.inv[start]
        return mix64(raw ^ ((end - start).astype(np.uint64) << np.uint64(48)))

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs without ASCII white space."""
        word = np.zeros(len(a) + 2, np.int8)
        word[1:-1] = ~self.space[a]
        step = np.diff(word)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def words(self, text: str | None) -> np.ndarray:
        """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased, in order."""
        b = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() touches A-Z only
        if not b:
            return np.zeros(0, np.uint64)
        a = np.frombuffer(b, np.uint8)
        s, e = self.bounds(a)
        return self.spans(self.prefix(a), s, e)

    def shingles(self, text: str | None, k: int) -> np.ndarray:
        """Sorted distinct hashes of k-word shingles; of the whole sequence if it has fewer words."""
        w = self.words(text)
        if not len(w):
            return w
        size = min(k, len(w))
        m = len(w) - size + 1
        acc = np.full(m, (size * 0x632BE59BD9B4E019) & _MASK, np.uint64)
        for j in range(size):
            acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + w[j : j + m])
        return np.unique(acc)
