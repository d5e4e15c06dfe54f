"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification.

Two permutations of the shingle space give the whole signature: the first scatters the
shingles, the second is read at circularly shifted positions, one shift per coordinate.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, Scratch, fresh, link_groups, mix64


@dataclass(frozen=True)
class NearDupConfig:
    """``num / den`` is the least Jaccard similarity of a link; with the default bands a pair at
    0.8 fails to meet in any band with a chance below 2e-7."""

    shingle: int = 5
    num: int = 80
    den: int = 100
    bands: int = 30
    rows: int = 4
    dim_bits: int = 21
    seed: int = 20251


def circulant_table(cfg: NearDupConfig) -> np.ndarray:
    """View [position, coordinate] of the second permutation and its circular shifts."""
    perm = np.random.default_rng(cfg.seed).permutation(1 << cfg.dim_bits).astype(np.int32)
    k = cfg.bands * cfg.rows
    ring = np.concatenate([perm, perm[:k]])
    return np.lib.stride_tricks.as_strided(ring, (len(perm), k), (4, 4))


def signature(shingles: np.ndarray, table: np.ndarray, cfg: NearDupConfig) -> np.ndarray:
    at = (mix64(shingles) >> np.uint64(64 - cfg.dim_bits)).astype(np.int64)  # the first permutation
    out = table[at[:2048]].min(axis=0)
    for i in range(2048, len(at), 2048):
        np.minimum(out, table[at[i : i + 2048]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, cfg: NearDupConfig) -> np.ndarray:
    rows = sig.astype(np.uint64).reshape(cfg.bands, cfg.rows)
    acc = np.arange(cfg.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(cfg.rows):
        acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + rows[:, j])
    return acc.view(np.int64)


SKETCH = 16


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 1024 buckets, as 16 longs.

    Two sketches differ in at most as many bits as the sets differ in shingles, which bounds the similarity from above, exactly.
    """
    odd = np.bincount((shingles & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _set_key(sh: np.ndarray) -> bytes:
    return hashlib.blake2b(sh.tobytes(), digest_size=16).digest()


def _sign(cfg: NearDupConfig):
    def run(batches):
        hasher, table = Hasher(), circulant_table(cfg)
        for batch in batches:
            n, key, bands, sketch = [], [], [], []
            for text in batch.column(1):
                sh = hasher.shingles(text.as_py(), cfg.shingle)
                n.append(len(sh))
                key.append(_set_key(sh) if len(sh) else None)
                bands.append(band_keys(signature(sh, table, cfg), cfg) if len(sh) else None)
                sketch.append(parity_sketch(sh) if len(sh) else None)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (bands, sketch)]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()), *lists], ["doc_id", "text_hash", "n_shingles", "key", "bands", "sketch"])

    return run


def _sets(cfg: NearDupConfig):
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            keys, sets = [], []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                sh = hasher.shingles(text.as_py(), cfg.shingle)
                if _set_key(sh) == key.as_py():  # a doc_id may come with several texts
                    keys.append(key.as_py())
                    sets.append(sh.tobytes())
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "members"])

    return run


def _verify(cfg: NearDupConfig):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(cfg.den * both >= cfg.num * (len(p) + len(q) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id, kept.

    Documents with equal shingle sets are one class, and only classes are compared (see
    ``link_groups`` for the pairs of a band bucket). Null or empty texts have no shingles and link with nothing; a null doc_id is
    a component of its own (component_id null, kept true); rows that repeat a doc_id keep one
    row each and are linked by their texts. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    signed = tmp.save(docs.mapInArrow(_sign(cfg), "doc_id long, text_hash long, n_shingles long, key binary, bands array<long>, sketch array<long>"), "signed")

    linked = signed.filter("key is not null and doc_id is not null")
    classes = tmp.save(linked.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    hashed = F.xxhash64("key").alias("h")
    cells = classes.select(F.explode("bands").alias("cell"), hashed)

    # sets of the classes that share a bucket, written once
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell")
    members = cells.join(shared, "cell", "left_semi").select("h").distinct()
    owners = classes.select("key", F.col("rep").alias("doc_id"), hashed).join(members, "h", "left_semi").drop("h")
    sets = tmp.save(docs.join(owners, "doc_id").select("key", "text").mapInArrow(_sets(cfg), "key binary, members binary"), "sets")
    tmp.release()

    traits = classes.select("key", "n", *(F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)))

    def may(a: str, b: str):
        """Whether sizes and sketches leave the similarity possible: D shingles of S in all differ, D (den + num) <= S (den - num)."""
        differ = reduce(add, (F.bit_count(F.col(f"{a}_s{i}").bitwiseXOR(F.col(f"{b}_s{i}"))) for i in range(SKETCH)))
        total = F.col(f"{a}_n") + F.col(f"{b}_n")
        sizes = F.least(f"{a}_n", f"{b}_n") * cfg.den >= F.greatest(f"{a}_n", f"{b}_n") * cfg.num
        return sizes & (differ * (cfg.den + cfg.num) <= total * (cfg.den - cfg.num))

    def verify(pairs: DataFrame) -> DataFrame:
        for c in "ab":
            other = traits.select(F.col("key").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in traits.columns[1:]))
            pairs = pairs.join(other, c) if c == "a" else pairs.join(other, (pairs["b"] == other["b"]) & may("a", "b")).drop(other["b"])
        p = pairs.select("a", "b")
        for c in "ab":
            p = p.join(sets.select(F.col("key").alias(c), F.col("members").alias(f"set_{c}")), c)
        return p.select("a", "b", "set_a", "set_b").mapInArrow(_verify(cfg), "a binary, b binary")

    final = link_groups(cells, verify, tmp, traits.withColumn("h", hashed), may)
    labels = classes.select("key", "rep").join(final.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", F.coalesce("label", "key").alias("label"))
    least = labels.groupBy("label").agg(F.min("rep").alias("component"))
    named = labels.join(least, "label").select("key", "component")
    out = signed.select("doc_id", "n_shingles", "key", "text_hash").join(named, "key", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash")
    kept = F.col("component_id").isNull() | F.col("component_id").eqNullSafe(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash")


def drop_near_duplicates(docs: DataFrame, cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns: one document of each group.

    Of rows that repeat both doc_id and text one stays; rows without doc_id stay. Other columns, whatever their names, pass unchanged.
    """
    tmp = Scratch(docs.sparkSession, "minhash-kept")
    doc, th, n = fresh(docs.columns, "kept_doc", "kept_hash", "kept_rows")
    kept = near_duplicates(docs, cfg).filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(th)).agg(F.count(F.lit(1)).alias(n))
    kept = tmp.save(kept, "kept")  # read more than once
    same = (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(th))
    out = docs.join(kept.filter(F.col(n) == 1), same, "left_semi").unionByName(docs.filter(F.col("doc_id").isNull()))
    again = kept.filter(F.col(n) > 1)
    return out.unionByName(docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])) if again.take(1) else out
