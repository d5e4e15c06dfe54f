"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, Scratch, mix64


@dataclass(frozen=True)
class ResampleConfig:
    """``share`` of the rows is selected. ``targets`` bounds the labelled documents that make the target model
    (least hashes of doc_id first); the raw model counts all documents. ``smooth``: added to every bucket."""

    bits: int = 14
    share: float = 0.5
    targets: int = 20_000
    smooth: float = 1.0
    seed: int = 11


def buckets(hasher: Hasher, text: str | None, bits: int) -> np.ndarray:
    """Buckets of the words and word pairs of a text."""
    w = hasher.words(text)
    pair = mix64(w[:-1] * np.uint64(0xD6E8FEB86659FD93) + w[1:])
    return (np.concatenate([w, pair]) >> np.uint64(64 - bits)).astype(np.int64)


def _count(ids: np.ndarray, cfg: ResampleConfig):
    def run(batches):
        hasher, n = Hasher(), 1 << cfg.bits
        raw, target = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = np.bincount(buckets(hasher, text.as_py(), cfg.bits), minlength=n)
                raw += c
                if i is not None and (k := np.searchsorted(ids, i)) < len(ids) and ids[k] == i:
                    target += c
        hit = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(hit), pa.array(raw[hit]), pa.array(target[hit])], ["bucket", "raw", "target"])

    return run


def _weigh(ratio: np.ndarray, cfg: ResampleConfig):
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            x = [float(ratio[buckets(hasher, t.as_py(), cfg.bits)].sum()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(x, pa.float64()), batch.column(2)], ["doc_id", "log_weight", "th"])

    return run


def _cut(keys: DataFrame, k: int, small: int = 10_000) -> float:
    """The k-th largest ``key``: histograms narrow its range down, then a bounded rest is sorted."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while low < high:
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        width = (high - low) / 1024
        if width == 0 or low + width == low:
            break
        bins = inside.groupBy(F.least(F.floor((F.col("key") - low) / width), F.lit(1023)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        if sum(r.n for r in bins) <= small:
            return sorted((r.key for r in inside.select("key").collect()), reverse=True)[k - above - 1]
        for r in sorted(bins, key=lambda r: -r.b):
            if above + r.n >= k:
                low, high = r.lo, r.hi
                break
            above += r.n
    return low


def resample(docs: DataFrame, labels: DataFrame, cfg: ResampleConfig = ResampleConfig()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): log_weight, key, selected.

    ``labels`` (doc_id, quality): documents of quality 1 are the target. log_weight is the log ratio of the text's
    probabilities in the two bag-of-n-grams models; key adds Gumbel noise that depends on doc_id, text and seed alone; the
    rows of the largest keys are selected, all of them at a tie. Null and empty texts weigh 0.
    Without labels all weights are 0 and the selection is uniform. Rows that repeat share a key. Other columns are ignored.
    """
    tmp = Scratch(docs.sparkSession, "quality")
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("doc_id is not null and quality = 1").select("doc_id").distinct()
    ids = np.array(sorted(r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.targets).collect()), np.int64)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    counted = texts.mapInArrow(_count(ids, cfg), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    p, q = (np.full(1 << cfg.bits, cfg.smooth) for _ in range(2))
    for r in counted:
        q[r.bucket] += r.raw
        p[r.bucket] += r.target
    ratio = np.log(p / p.sum()) - np.log(q / q.sum()) if p.sum() > cfg.smooth * len(p) else np.zeros(len(p))
    weighed = texts.mapInArrow(_weigh(ratio, cfg), "doc_id long, log_weight double, th long")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(cfg.seed), "doc_id", "th"), 12).cast("double") + 0.5) / float(1 << 52)
    keys = tmp.save(weighed.select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("key")), "keys")
    k = round(keys.count() * cfg.share)
    cut = _cut(keys, k) if k else float("inf")
    return keys.select("doc_id", "log_weight", "key", (F.col("key") >= F.lit(cut)).alias("selected"))
