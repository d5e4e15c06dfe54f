"""Exact substring dedup: every byte under a long string that also starts earlier goes.

Windows of ``length`` bytes are dealt out by their leftmost least ``gram`` hash (their
anchor), so that equal windows meet wherever they stand. Only windows with an anchor seen
more than once can repeat. Stretches of windows of one anchor that repeat as a whole are settled by
counting; the suffixes of the rest are sorted per anchor by deep-shallow sorting, after which
equal windows are neighbours and all but the earliest are removed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, Hasher, Scratch, mix64

_NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class SubstringConfig:
    """``shallow``: characters of eight bytes that multikey quicksort looks at before the tries
    take over. ``bucket``: stretches of one anchor that are sorted in one task; larger buckets are settled
    window by window through an aggregate, to the same result. ``block``: windows of one text at a time."""

    length: int = 100
    gram: int = 32
    shallow: int = 3
    bucket: int = 8192
    block: int = 1 << 22
    chunk: int = 16384


def _gram_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings, by doubling."""
    cur, size, parts = a.astype(np.uint64) + np.uint64(1), 1, []
    while True:
        if k & size:
            parts.append((size, cur))
        if size * 2 > k:
            break
        cur = cur[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + cur[size:]
        size *= 2
    n, off = len(a) - k + 1, 0
    out = np.zeros(n, np.uint64)
    for size, h in parts:
        out = out * np.uint64(pow(_BASE, size, 1 << 64)) + h[off : off + n]
        off += size
    return mix64(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def stretches(a: np.ndarray, cfg: SubstringConfig, hasher: Hasher):
    """Runs of windows with one anchor: (anchor hash, content hash, start, anchor offset, windows)."""
    width = cfg.length - cfg.gram + 1
    out = []
    for s in range(0, len(a) - cfg.length + 1, cfg.block):
        part = a[s : s + cfg.block + cfg.length - 1]
        h = _gram_hashes(part, cfg.gram)
        at = _sliding_min((h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64), width)
        owner = (at & np.uint64(0xFFFFFF)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        count = np.diff(np.append(begin, len(owner)))
        anchor = owner[begin]
        content = hasher.spans(hasher.prefix(part), begin, begin + count + cfg.length - 1)
        out.append((h[anchor], content, begin + s, anchor - begin, count))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else None


def _bytes(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _anchors(cfg: SubstringConfig):
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            held, size = [], 0
            for d, t, text in zip(*(batch.column(i).to_pylist() if i < 2 else batch.column(i) for i in range(3)), strict=True):
                a = np.frombuffer(_bytes(text.as_py()), np.uint8)
                if (x := stretches(a, cfg, hasher)) is None:
                    continue
                h, content, start, off, count = x
                held.append((np.full(len(h), d), np.full(len(h), t), h.view(np.int64), content.view(np.int64), start << 16 | off << 8 | count))
                size += len(h)
                if size > 200_000:
                    yield _batch(held, ("doc", "th", "h", "c", "loc"))
                    held, size = [], 0
            if held:
                yield _batch(held, ("doc", "th", "h", "c", "loc"))

    return run


def _batch(held, names):
    return pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*held, strict=True)], list(names))


def _contexts(cfg: SubstringConfig):
    """Bytes of the stretches that a row lists: (h, n, doc, th, loc, ctx)."""
    def run(batches):
        for batch in batches:
            rows, ctx = [], []
            for d, t, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                b = _bytes(text.as_py())
                for x in found.as_py():
                    start, count = x["loc"] >> 16, x["loc"] & 255
                    rows.append((x["h"], x["n"], d, t, x["loc"]))
                    ctx.append(b[start : start + count + cfg.length - 1])
            cols = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.record_batch([*(pa.array(c) for c in cols), pa.array(ctx, pa.binary())], ["h", "n", "doc", "th", "loc", "ctx"])

    return run


def deep_shallow(buf: np.ndarray, at: np.ndarray, group: np.ndarray, rank: np.ndarray, length: int, shallow: int) -> np.ndarray:
    """Which of the strings ``buf[at:at+length]`` equal one of lower rank in their group.

    Multikey quicksort, eight bytes a character, takes all groups one character deeper at a
    time and drops strings that stand alone. After ``shallow`` characters the groups that are left share
    a long prefix: a blind trie per group, grown level by level, keeps only the position where
    its strings first differ and branches on that byte, skipping what all share.
    """
    dup = np.zeros(len(at), bool)
    words = np.ndarray((len(buf) - 7,), ">u8", buf.tobytes(), strides=(1,))
    spots = [min(8 * d, length - 8) for d in range(-(-length // 8))]
    live, gid = np.arange(len(at)), group

    def split(live, gid, key):
        """Groups by (gid, key), in order; strings alone in theirs are dropped."""
        order = np.lexsort((key, gid))
        live, gid, key = live[order], gid[order], key[order]
        new = np.ones(len(live) + 1, bool)
        new[1:-1] = (gid[1:] != gid[:-1]) | (key[1:] != key[:-1])
        alone = new[:-1] & new[1:]
        gid = np.cumsum(new[:-1])
        return live[~alone], gid[~alone]

    if not shallow:
        live, gid = split(live, gid, group)
    for d in range(min(shallow, len(spots))):
        if not len(live):
            return dup
        live, gid = split(live, gid, words[at[live] + spots[d]].astype(np.uint64))
    while len(live):
        first = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
        sizes = np.diff(np.append(first, len(live)))
        leader = np.repeat(at[live[first]], sizes)
        here, lcp = at[live], np.full(len(live), length)
        todo = np.arange(len(live))
        for off in spots:  # the first word that differs from the leader's, and the byte in it
            diff = words[here[todo] + off] != words[leader[todo] + off]
            hit = todo[diff]
            if len(hit):
                x = (buf[here[hit, None] + off + np.arange(8)] != buf[leader[hit, None] + off + np.arange(8)]).argmax(axis=1)
                lcp[hit] = off + x
                todo = todo[~diff]
        low = np.repeat(np.minimum.reduceat(lcp, first), sizes)
        same = low == length
        if same.any():
            ids, g = live[same], gid[same]
            f = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank[ids], f), np.diff(np.append(f, len(ids))))
            dup[ids] = rank[ids] > least
        live, gid, low = live[~same], gid[~same], low[~same]
        if len(live):
            live, gid = split(live, gid, buf[at[live] + low])
    return dup


def _windows(ctx, loc, length):
    """Concatenated bytes, and of each window its place in them, its stretch and its distance to the anchor."""
    count, off = loc & 255, (loc >> 8) & 255
    size = count + length - 1
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    owner = np.repeat(np.arange(len(loc)), count)
    i = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return np.frombuffer(b"".join(ctx) + bytes(8), np.uint8), base[owner] + i, owner, i, off[owner] - i


def _spans(keys, loc, owner, i, dup, length):
    """Runs of removed windows as (doc, th, start, end)."""
    o, j = owner[dup], i[dup]
    if not len(o):
        return None
    cut = np.flatnonzero((o[1:] != o[:-1]) | (j[1:] != j[:-1] + 1)) + 1
    a, b = np.concatenate([[0], cut]), np.append(cut - 1, len(o) - 1)
    start = loc[o[a]] >> 16
    return pa.record_batch([pa.array(keys[0][o[a]]), pa.array(keys[1][o[a]]), pa.array(start + j[a]), pa.array(start + j[b] + length)], ["doc", "th", "s", "e"])


def _sort_buckets(cfg: SubstringConfig):
    def settle(h, doc, th, loc, ctx):
        order = np.lexsort((loc >> 16, th, doc))
        h, doc, th, loc, ctx = h[order], doc[order], th[order], loc[order], [ctx[i] for i in order]
        buf, at, owner, i, rel = _windows(ctx, loc, cfg.length)
        bucket = np.unique(h, return_inverse=True)[1]
        # repeated rows of one document are one place
        place = np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (loc[1:] != loc[:-1])]))
        dup = deep_shallow(buf, at, bucket[owner] * 256 + rel, place[owner], cfg.length, cfg.shallow)
        return _spans((doc, th), loc, owner, i, dup, cfg.length)

    def run(batches):
        held, size = [], 0

        def take(upto):
            cols = [np.concatenate([x[j] for x in held]) for j in range(4)]
            ctx = [c for x in held for c in x[4]]
            rest = [c[upto:] for c in cols], ctx[upto:]
            out = settle(*(c[:upto] for c in cols), ctx[:upto]) if upto else None
            return out, ([(*rest[0], rest[1])] if len(rest[1]) else [])

        for batch in batches:
            for part in (batch.slice(k, cfg.chunk) for k in range(0, batch.num_rows, cfg.chunk)):
                held.append((*(part.column(j).to_numpy() for j in (0, 2, 3, 4)), part.column(5).to_pylist()))
                size = sum(len(x[4]) for x in held)
                if size >= cfg.chunk:
                    h = np.concatenate([x[0] for x in held])
                    last = np.flatnonzero(h[1:] != h[:-1])
                    if len(last):  # up to the end of the last whole bucket
                        out, held = take(last[-1] + 1)
                        if out is not None:
                            yield out
        if held:
            out, _ = take(sum(len(x[4]) for x in held))
            if out is not None:
                yield out

    return run


def _window_hashes(cfg: SubstringConfig):
    """For large buckets: (h, rel, w, doc, th, start) of every window."""
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for part in (batch.slice(k, 2048) for k in range(0, batch.num_rows, 2048)):
                h, doc, th, loc = (part.column(j).to_numpy() for j in (0, 2, 3, 4))
                buf, at, owner, i, rel = _windows(part.column(5).to_pylist(), loc, cfg.length)
                w = hasher.spans(hasher.prefix(buf), at, at + cfg.length).view(np.int64)
                yield _batch([(h[owner], rel, w, doc[owner], th[owner], (loc[owner] >> 16) + i)], ("h", "rel", "w", "doc", "th", "s"))

    return run


def _cut(with_text: bool):
    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(2), batch.column(3), strict=True):
                b, spans = _bytes(text.as_py()), spans.as_py() or []
                runs = []
                for x in sorted((x["s"], x["e"]) for x in spans):
                    if runs and x[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x[1])
                    else:
                        runs.append(list(x))
                kept, p = [], 0
                for s, e in runs:
                    kept.append(b[p:s])
                    p = e
                left = b"".join([*kept, b[p:]])
                row = (len(b), len(b) - len(left), len(runs), hashlib.sha256(left).hexdigest(), runs)
                out.append((*row, left.decode("utf-8", "ignore")) if with_text else row)
            cols = list(zip(*out, strict=True)) or [[]] * (5 + with_text)
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.list_(pa.int64())))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            ids = pa.array([None if i == _NO_ID else i for i in batch.column(0).to_pylist()], pa.int64())
            yield pa.record_batch([ids, *arrays, *([pa.array(cols[5], pa.string())] if with_text else [])], names + ["kept_text"] * with_text)

    return run


def repeated_substrings(docs: DataFrame, cfg: SubstringConfig = SubstringConfig(), with_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, spans.

    ``spans`` are the removed runs [start, end) in bytes; ``with_text`` adds what is left
    (bytes of a character cut in two are dropped from it). A null text counts as empty and a text shorter than
    ``length`` loses nothing. Rows without doc_id come after all others, by their text's hash.
    Rows with one doc_id and different texts are ordered by that hash; rows alike in both are one document,
    each with its result. Other columns are ignored.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "substrings")
    key = ["doc", "th"]
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    anchors = tmp.save(texts.mapInArrow(_anchors(cfg), "doc long, th long, h long, c long, loc long"), "anchors")
    repeated = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    hits = tmp.save(anchors.join(repeated.hint("shuffle_hash"), "h", "left_semi"), "hits")
    tmp.drop("anchors")
    tmp.release()

    place = F.struct("doc", "th", "loc")
    firsts = tmp.save(hits.groupBy("h", "c").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")), "firsts")
    whole = hits.join(firsts.filter("n > 1").select("h", "c", "at"), ["h", "c"]).filter(place > F.col("at"))
    start = F.shiftright("loc", 16)
    whole = tmp.save(whole.select("doc", "th", start.alias("s"), (start + F.col("loc").bitwiseAND(255) + (cfg.length - 1)).alias("e")), "whole")
    tmp.drop("hits")
    several = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rest = firsts.select("h", "at.*").join(several, "h")
    listed = rest.groupBy(*key).agg(F.collect_list(F.struct("h", "n", "loc")).alias("found"))  # at most one for each few bytes of its text
    context = tmp.save(texts.join(listed, key).select(*key, "text", "found").mapInArrow(_contexts(cfg), "h long, n long, doc long, th long, loc long, ctx binary"), "context")
    tmp.release()

    schema = "doc long, th long, s long, e long"
    small = context.filter(F.col("n") <= cfg.bucket).repartition("h").sortWithinPartitions("h")
    parts = [whole, small.mapInArrow(_sort_buckets(cfg), schema)]
    if context.filter(F.col("n") > cfg.bucket).take(1):
        large = tmp.save(context.filter(F.col("n") > cfg.bucket).mapInArrow(_window_hashes(cfg), "h long, rel long, w long, doc long, th long, s long"), "windows")
        spot, same = F.struct("doc", "th", "s"), ["h", "rel", "w"]
        lead = large.groupBy(*same).agg(F.min(spot).alias("at"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(*same, "at")
        parts.append(large.join(lead, same).filter(spot > F.col("at")).select("doc", "th", "s", (F.col("s") + cfg.length).alias("e")))
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)
    gone = tmp.save(spans.groupBy(*key).agg(F.collect_list(F.struct("s", "e")).alias("spans")), "gone")
    tmp.release()
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>" + ", kept_text string" * with_text
    return texts.join(gone, key, "left").select(*key, "text", "spans").mapInArrow(_cut(with_text), out)
