"""Benchmark decontamination: q-gram lemma over overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh
from .suffix import _gram_hashes


@dataclass(frozen=True)
class LeakConfig:
    """An item of n bytes leaks where a stretch of the document is within ``rate * n`` edits of it
    (fewer for items so short that ``q``-grams couldn't tell). ``block_bytes``: benchmark text sent out at once.
    ``slice_bytes`` of a text are hashed, and ``hits`` of its grams in items counted, at a time, to the same result."""

    q: int = 10
    rate: float = 0.06
    block_bytes: int = 8 << 20
    slice_bytes: int = 4 << 20
    hits: int = 1 << 19


def normalise(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def budget(n: int, cfg: LeakConfig) -> int:
    """Edits allowed: e edits spoil at most q * e of n - q + 1 grams, and one at least must be left."""
    return max(0, min(int(cfg.rate * n), (n - cfg.q) // cfg.q)) if n >= cfg.q else 0


def aligned(item: np.ndarray, region: np.ndarray, limit: int, low: int, high: int) -> int:
    """Least edits between the item and a stretch of the region on diagonals low..high; limit + 1 if more."""
    n, m, width = len(item), len(region), high - low + 1
    big = limit + 1
    j = np.arange(width)
    col = low + j  # region position before the first byte of the item
    row = np.where((col >= 0) & (col <= m), 0, big)
    for i in range(1, n + 1):
        col = i + low + j
        inside = (col >= 1) & (col <= m)
        same = np.zeros(width, bool)
        same[inside] = region[col[inside] - 1] == item[i - 1]
        take = np.where(inside, row + ~same, big)
        drop = np.append(row[1:], big) + 1
        best = np.where((col >= 0) & (col <= m), np.minimum(take, drop), big + width)
        row = np.minimum(np.minimum.accumulate(best - j) + j, big)  # bytes of the region that the item lacks
        row[(col < 0) | (col > m)] = big
        if row.min() > limit:
            return big
    return int(row.min())


class Finder:
    """The grams of some benchmark items, and the search of one text for the items."""

    def __init__(self, items: list[tuple[int, bytes]], cfg: LeakConfig):
        self.cfg, self.items = cfg, [(i, b) for i, b in items if b]
        self.short = [k for k, (_, b) in enumerate(self.items) if len(b) < cfg.q]
        grams, owner, pos = [], [], []
        for k, (_, b) in enumerate(self.items):
            if len(b) >= cfg.q:
                h = _gram_hashes(np.frombuffer(b, np.uint8), cfg.q)
                grams.append(h)
                owner.append(np.full(len(h), k))
                pos.append(np.arange(len(h)))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        g = cat(grams, np.uint64)
        order = np.argsort(g, kind="stable")
        self.owner, self.pos = cat(owner, np.int64)[order], cat(pos, np.int64)[order]
        self.grams, self.first, self.count = np.unique(g[order], return_index=True, return_counts=True)
        self.bits = max(16, int(np.ceil(np.log2(len(self.grams) + 1))) + 5)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.grams)] = True
        n = np.array([len(b) for _, b in self.items], np.int64)
        self.edits = np.array([budget(x, cfg) for x in n], np.int64)
        self.least = n - cfg.q + 1 - cfg.q * self.edits
        self.width = self.edits + 1

    def _slot(self, h):
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _bands(self, b: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the (item, band) pairs with hits, and how many each has."""
        codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in range(0, len(b) - self.cfg.q + 1, self.cfg.slice_bytes):
            h = _gram_hashes(np.frombuffer(b, np.uint8)[s : s + self.cfg.slice_bytes + self.cfg.q - 1], self.cfg.q)
            at = np.flatnonzero(self.seen[self._slot(h)])
            g = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
            hit = self.grams[g] == h[at]
            at, g = at[hit], g[hit]
            cut = np.cumsum(self.count[g]) // self.cfg.hits
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(cut)) + 1):
                if not len(part):
                    continue
                times = self.count[g[part]]
                i = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.first[g[part]], times)
                owner, diag = self.owner[i], np.repeat(at[part] + s, times) - self.pos[i]
                # an item's hits lie on diagonals no further apart than its edits: in one of two overlapping bands
                band = diag // self.width[owner] + (1 << 20)
                code, n = np.unique(np.concatenate([owner << 42 | band, owner << 42 | (band - 1)]), return_counts=True)
                codes.append(code)
                counts.append(n)
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        return code, np.bincount(at, np.concatenate(counts), len(code)).astype(np.int64)

    def find(self, text: str | None) -> dict[int, int]:
        """item_id -> least edits found, for the items that leak into the text."""
        b, found = normalise(text), {}
        for k in self.short:
            if self.items[k][1] in b:
                found[self.items[k][0]] = 0
        if len(b) < self.cfg.q or not len(self.grams):
            return found
        code, n = self._bands(b)
        for c in code[n >= self.least[code >> 42]].tolist():
            k = c >> 42
            item, limit, w = self.items[k][1], int(self.edits[k]), int(self.width[k])
            if found.get(self.items[k][0], 1 << 30) == 0:
                continue
            low = ((c & ((1 << 42) - 1)) - (1 << 20)) * w
            s, e = max(0, low - limit), low + 2 * w + len(item) + 2 * limit
            region = b[s : max(s, e)]
            if item in region:
                got = 0
            else:
                got = aligned(np.frombuffer(item, np.uint8), np.frombuffer(region, np.uint8), limit, low - limit - s, low + 2 * w + limit - s)
            if got <= limit:
                found[self.items[k][0]] = min(got, found.get(self.items[k][0], got))
        return found


def _search(items: list[tuple[int, bytes]], cfg: LeakConfig):
    def run(batches):
        finder = Finder(items, cfg)
        for batch in batches:
            hits = [finder.find(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([sorted(x) for x in hits], pa.list_(pa.int64())), pa.array([min(x.values(), default=None) for x in hits], pa.int64())], ["doc_id", "text_hash", "items", "edits"])

    return run


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): leaked, items (ids of the items found), edits, text_hash.

    ``benchmark`` (item_id, text) goes out in blocks of ``block_bytes`` at most: one for a benchmark of usual size, and
    more passes over ``docs`` for a larger one. Texts and items are compared in lower case with white space as one
    blank; edits are counted in UTF-8 bytes. Null and empty texts leak nothing and null or empty items are
    not looked for; an item shorter than a gram must occur as it stands. Rows that repeat are judged alike. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // cfg.block_bytes)) if total > cfg.block_bytes else 1
    schema, out, tmp = "doc_id long, text_hash long, items array<long>, edits long", None, Scratch(docs.sparkSession, "leaks")
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        found = texts.mapInArrow(_search([(r[0], normalise(r[1])) for r in part.toLocalIterator()], cfg), schema)
        found = found if blocks == 1 else tmp.save(found, f"block-{k}")  # the driver holds one block at a time
        out = found if out is None else out.unionByName(found)
    if blocks > 1:  # rows alike in id and text have alike results: one for each comes from every block
        n = F.count(F.lit(1)) / blocks
        out = out.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.min("edits").alias("edits"), n.cast("int").alias("n"))
        out = out.select("doc_id", "text_hash", "items", "edits", F.explode(F.sequence(F.lit(1), "n"))).drop("col")
    return out.select("doc_id", (F.size("items") > 0).alias("leaked"), "items", "edits", "text_hash")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no benchmark item. Other columns, whatever their names, pass unchanged."""
    (th,) = fresh(docs.columns, "leak_hash")
    bad = benchmark_leaks(docs, benchmark, cfg).filter("leaked").select(F.col("text_hash").alias(th)).distinct()
    return docs.join(bad, F.xxhash64(F.col("text").cast("string")) == F.col(th), "left_anti")
