"""Toxicity: a factorization machine over hashed terms, trained in numpy on a bounded labelled sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, mix64


@dataclass(frozen=True)
class FMConfig:
    """``positives`` and ``negatives`` bound the labelled rows that are learned from (least hashes of doc_id first), ``held`` their terms in all;
    the bias is then shifted to the share of toxic documents among all labelled ones.
    ``prefixes``: bytes of word stems that are terms besides the word itself. Learned are the terms whose share
    among toxic documents differs by ``telling`` standard errors (of the log odds), and both terms of a pair whose joint share
    differs by ``joint`` standard errors and by half as much again as either term's own: of the ``common`` terms that most toxic documents hold.
    ``l1`` keeps weights without say at exactly zero, so that length alone scores nothing."""

    bits: int = 18
    rank: int = 4
    prefixes: tuple[int, ...] = (4, 5)
    positives: int = 3000
    negatives: int = 5000
    held: int = 20_000_000
    telling: float = 3.5
    joint: float = 6.0
    common: int = 2048
    epochs: int = 15
    batch: int = 64
    alpha: float = 0.5
    l1: float = 0.5
    l2: float = 0.1
    factor_rate: float = 0.1
    threshold: float = 0.3
    seed: int = 7


class Terms:
    """Distinct hashed terms of a text: its lower-cased words and their stems."""

    def __init__(self, cfg: FMConfig):
        self.cfg, self.hasher = cfg, Hasher()
        part = np.ones(256, bool)
        part[128:] = part[ord("a") : ord("z") + 1] = False
        self.hasher.space = part

    def of(self, text: str | None) -> np.ndarray:
        b = (text or "").lower().encode("utf-8", "surrogatepass")
        if not b:
            return np.zeros(0, np.int64)
        a = np.frombuffer(b, np.uint8)
        s, e = self.hasher.bounds(a)
        p = self.hasher.prefix(a)
        kinds = [self.hasher.spans(p, s, e)] + [mix64(self.hasher.spans(p, s, np.minimum(e, s + n)) + np.uint64(n)) for n in self.cfg.prefixes]
        return np.unique(np.concatenate(kinds) >> np.uint64(64 - self.cfg.bits)).astype(np.int64)


@dataclass
class FMModel:
    """``index``: the terms that were learned, in order, with their weights and factors."""

    bias: float
    index: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def logits(self, terms: list[np.ndarray]) -> np.ndarray:
        n = np.array([len(t) for t in terms], np.int64)
        flat = np.concatenate([*terms, np.zeros(0, np.int64)])
        if not len(self.index):
            return np.full(len(terms), self.bias)
        at = np.minimum(np.searchsorted(self.index, flat), len(self.index) - 1)
        known = self.index[at] == flat
        return self.summed(at[known], np.repeat(np.arange(len(terms)), n)[known], len(terms))

    def summed(self, at: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        out = self.bias + np.bincount(row, self.w[at], rows)
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            out += 0.5 * (np.bincount(row, x, rows) ** 2 - np.bincount(row, x * x, rows))
        return out

    def scores(self, terms: list[np.ndarray]) -> np.ndarray:
        return chance(self.logits(terms))


def chance(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def _distance(a, b, p, n):
    """Standard errors between the log odds of a share a of p and b of n."""
    a, b, p, n = a + 0.5, b + 0.5, p + 1, n + 1
    return np.abs(np.log(a / (p - a)) - np.log(b / (n - b))) / np.sqrt(1 / a + 1 / (p - a) + 1 / b + 1 / (n - b))


def _gap(a, b, p, n):
    """Standard errors between the shares a of p and b of n, if they were the same."""
    share = (a + b) / (p + n)
    return np.abs(a / p - b / n) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / p + 1 / n))


def telling(terms: list[np.ndarray], labels: np.ndarray, cfg: FMConfig) -> np.ndarray:
    """The terms that say something by themselves or together with another, in order."""
    counts = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(t for t, z in zip(terms, labels, strict=True) if z == y)]), minlength=1 << cfg.bits) for y in (1, 0)]
    totals = [float((labels == y).sum()) for y in (1, 0)]
    keep = _distance(*counts, *totals) > cfg.telling
    # pairs: documents by terms as a matrix of ones, whose square counts the documents that hold both
    some = np.sort(np.argsort(-counts[0], kind="stable")[: cfg.common])
    some = some[(counts[0][some] >= 5) & (counts[0][some] + counts[1][some] < 0.9 * len(labels))]
    if len(some) > 1 and cfg.rank:
        slot = np.full(1 << cfg.bits, -1)
        slot[some] = np.arange(len(some))
        both = []
        for y in (1, 0):
            square = np.zeros((len(some), len(some)), np.float32)
            rows = [slot[t][slot[t] >= 0] for t, z in zip(terms, labels, strict=True) if z == y]
            for k in range(0, len(rows), 1024):
                held = np.zeros((min(1024, len(rows) - k), len(some)), np.float32)
                for i, r in enumerate(rows[k : k + 1024]):
                    held[i, r] = 1
                square += held.T @ held
            both.append(square)
        single = _gap(*(c[some] for c in counts), *totals)
        together = _gap(*both, *totals)
        more = (together > cfg.joint) & (together > 1.5 * np.maximum(single[:, None], single[None])) & (both[0] + both[1] >= 8)
        np.fill_diagonal(more, False)
        keep[some[more.any(axis=1)]] = True
    return np.flatnonzero(keep)


def train(terms: list[np.ndarray], labels: np.ndarray, cfg: FMConfig) -> FMModel:
    """FTRL for linear weights, AdaGrad for the factors of all learned terms."""
    rng = np.random.default_rng(cfg.seed)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 1e-3
    model = FMModel(float(np.log(share / (1 - share))), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, cfg.rank)))
    if not len(labels) or labels.min() == labels.max():
        return model
    model.index = telling(terms, labels, cfg)
    dim = len(model.index)
    model.w, model.v = np.zeros(dim), rng.normal(0, 0.05, (dim, cfg.rank))
    z, n, vn, bz = np.zeros(dim), np.zeros(dim), np.zeros((dim, cfg.rank)), 1.0
    slot = np.full(1 << cfg.bits, -1)
    slot[model.index] = np.arange(dim)
    terms = [slot[t][slot[t] >= 0] for t in terms]
    for _ in range(cfg.epochs if dim else 0):
        order = rng.permutation(len(terms))
        for k in range(0, len(order), cfg.batch):
            some = order[k : k + cfg.batch]
            t = [terms[i] for i in some]
            flat, row = np.concatenate(t), np.repeat(np.arange(len(t)), [len(x) for x in t])
            error = chance(model.summed(flat, row, len(t))) - labels[some]
            for f in range(cfg.rank):
                x = model.v[flat, f]
                total = np.bincount(row, x, len(t))
                g = np.bincount(flat, error[row] * (total[row] - x), dim) + 1e-3 * model.v[:, f]
                vn[:, f] += g * g
                model.v[:, f] -= cfg.factor_rate * g / np.sqrt(vn[:, f] + 1)
            hit = np.unique(flat)
            g = np.bincount(flat, error[row], dim)[hit]
            step = (np.sqrt(n[hit] + g * g) - np.sqrt(n[hit])) / cfg.alpha
            z[hit] += g - step * model.w[hit]
            n[hit] += g * g
            model.w[hit] = np.where(np.abs(z[hit]) <= cfg.l1, 0, -(z[hit] - np.sign(z[hit]) * cfg.l1) / ((1 + np.sqrt(n[hit])) / cfg.alpha + cfg.l2))
            g = float(error.sum())
            bz += g * g
            model.bias -= 0.3 * g / np.sqrt(bz)
    return model


def _terms(cfg: FMConfig):
    def run(batches):
        terms = Terms(cfg)
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([terms.of(t.as_py()).astype(np.int32) for t in batch.column(1)], pa.list_(pa.int32()))], ["doc_id", "toxic", "terms"])

    return run


def _learn(cfg: FMConfig):
    """One model from all the rows of a task, in their order, up to the bound on their terms."""
    def run(batches):
        terms, labels, size = [], [], 0
        for batch in batches:
            for y, t in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                size += len(t)
                if size <= cfg.held:
                    terms.append(np.asarray(t.values, np.int64))
                    labels.append(y)
        y = np.array(labels, float)
        model = train(terms, y, cfg)
        arrays = [pa.array([x], pa.list_(pa.float64())) for x in (model.w, model.v.reshape(-1))]
        yield pa.record_batch([pa.array([model.bias]), pa.array([model.index], pa.list_(pa.int64())), *arrays, pa.array([int(y.sum())], pa.int64()), pa.array([int(len(y) - y.sum())], pa.int64())], ["bias", "index", "w", "v", "used1", "used0"])

    return run


def _score(model: FMModel, cfg: FMConfig):
    def run(batches):
        terms = Terms(cfg)
        for batch in batches:
            out = []
            for k in range(0, batch.num_rows, 256):
                out.append(model.scores([terms.of(t.as_py()) for t in batch.column(1).slice(k, 256)]))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(np.concatenate([*out, np.zeros(0)]))], ["doc_id", "text_hash", "score"])

    return run


def held_out(doc_id, modulus: int, rest: int):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, cfg: FMConfig = FMConfig(), learn=None) -> FMModel:
    """Model of the labels (doc_id, toxic) that ``learn``, a condition on doc_id, admits. Null ids and labels are left out,
    a document labelled more than once is toxic if any label says so."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    if learn is not None:
        known = known.filter(learn)
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    counted = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = known.filter("toxic = 1").orderBy(*order).limit(cfg.positives).unionByName(known.filter("toxic = 0").orderBy(*order).limit(cfg.negatives))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic").mapInArrow(_terms(cfg), "doc_id long, toxic int, terms array<int>")
    # a doc_id may come with several texts; training runs in one task, off the driver
    ordered = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "terms").limit(cfg.positives + cfg.negatives)
    learned = ordered.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "terms").mapInArrow(_learn(cfg), "bias double, index array<long>, w array<double>, v array<double>, used1 long, used0 long").first()
    if learned is None:  # no rows, no task
        return train([], np.zeros(0), cfg)
    model = FMModel(learned.bias, np.array(learned["index"], np.int64), np.array(learned.w, float), np.array(learned.v, float).reshape(-1, cfg.rank))
    # the classes are sampled at rates of their own, which only the bias takes in
    rates = [max(1.0, counted.get(c, 0) / most) * max(1.0, min(counted.get(c, 0), most) / max(used, 1) if learned.used1 + learned.used0 >= cfg.positives + cfg.negatives else 1.0) for c, most, used in ((1, cfg.positives, learned.used1), (0, cfg.negatives, learned.used0))]
    model.bias += float(np.log(rates[0]) - np.log(rates[1]))
    return model


def score_toxicity(docs: DataFrame, model: FMModel, cfg: FMConfig = FMConfig()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): score in 0..1, predicted, text_hash.

    Whole texts are scored. A null or empty text has no terms and gets the prior's score; rows that repeat score alike; without labels
    all score the least prior. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    out = texts.mapInArrow(_score(model, cfg), "doc_id long, text_hash long, score double")
    return out.select("doc_id", "score", (F.col("score") >= cfg.threshold).cast("int").alias("predicted"), "text_hash")


def drop_toxic(docs: DataFrame, model: FMModel, cfg: FMConfig = FMConfig()) -> DataFrame:
    """The rows of ``docs``, with all their columns, that don't score as toxic. Nothing is shuffled."""
    def scores(batches):
        terms = Terms(cfg)
        for s in batches:
            yield pa.array(np.concatenate([*(model.scores([terms.of(t.as_py()) for t in s.slice(k, 256)]) for k in range(0, len(s), 256)), np.zeros(0)]))

    from typing import Iterator

    scores.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(scores, "double")
    return docs.filter(udf(F.col("text").cast("string")) < cfg.threshold)
