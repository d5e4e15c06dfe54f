"""Language ID: a byte convolutional network trained in numpy, run over all windows of a text."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CNNConfig:
    """``sample`` bounds the labelled documents that are learned from (least hashes of doc_id first), ``per_doc``
    the windows of each text, and their product all windows, where a doc_id comes with many texts. A text is judged by all its windows of ``window`` bytes, the last one padded."""

    window: int = 256
    embed: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    sample: int = 6000
    per_doc: int = 2
    epochs: int = 6
    batch: int = 64
    rate: float = 0.005
    seed: int = 3


_LETTER = re.compile(r"[^\W\d_]")


def windows(text: str | None, size: int) -> np.ndarray:
    b = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros((-(-len(b) // size), size), np.uint8)
    out.reshape(-1)[: len(b)] = np.frombuffer(b, np.uint8)
    return out


@dataclass
class ByteCNN:
    langs: list[str]
    cfg: CNNConfig
    emb: np.ndarray
    conv: list[np.ndarray]
    conv_b: list[np.ndarray]
    out: np.ndarray
    out_b: np.ndarray

    @classmethod
    def new(cls, langs: list[str], cfg: CNNConfig) -> ByteCNN:
        rng = np.random.default_rng(cfg.seed)
        f = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        n = len(cfg.widths) * cfg.filters
        return cls(langs, cfg, f(256, cfg.embed, scale=0.5), [f(w, cfg.embed, cfg.filters, scale=1 / np.sqrt(w * cfg.embed)) for w in cfg.widths], [np.zeros(cfg.filters, np.float32) for _ in cfg.widths], f(n, len(langs), scale=0.1), np.zeros(len(langs), np.float32))

    def tables(self) -> list[np.ndarray]:
        """Per width: what each byte adds at each place of a filter, [place, byte, filter]."""
        return [np.einsum("be,wef->wbf", self.emb, c).astype(np.float32) for c in self.conv]

    def pooled(self, x: np.ndarray, tables) -> tuple[np.ndarray, list[np.ndarray]]:
        tops, where = [], []
        for t, b in zip(tables, self.conv_b, strict=True):
            n = x.shape[1] - len(t) + 1
            y = t[0][x[:, :n]]
            for j in range(1, len(t)):
                y += t[j][x[:, j : n + j]]
            at = y.argmax(axis=1)
            where.append(at)
            tops.append(np.maximum(np.take_along_axis(y, at[:, None], 1)[:, 0] + b, 0))
        return np.concatenate(tops, axis=1), where

    def probs(self, x: np.ndarray, tables) -> np.ndarray:
        tops = []
        for t, b in zip(tables, self.conv_b, strict=True):
            n = x.shape[1] - len(t) + 1
            y = t[0][x[:, :n]]
            for j in range(1, len(t)):
                y += t[j][x[:, j : n + j]]
            tops.append(np.maximum(y.max(axis=1) + b, 0))
        return softmax(np.concatenate(tops, axis=1) @ self.out + self.out_b)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], cfg: CNNConfig) -> ByteCNN:
    """Cross-entropy by Adam; gradients reach a filter through the place of its maximum."""
    net, rng = ByteCNN.new(langs, cfg), np.random.default_rng(cfg.seed)
    params = [net.emb, *net.conv, *net.conv_b, net.out, net.out_b]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(cfg.epochs if len(langs) > 1 else 0):
        order = rng.permutation(len(x))
        for k in range(0, len(order), cfg.batch):
            some = order[k : k + cfg.batch]
            xb = x[some]
            h, where = net.pooled(xb, net.tables())
            d = softmax(h @ net.out + net.out_b)
            d[np.arange(len(some)), y[some]] -= 1
            d /= len(some)
            g_out, g_b, dh = h.T @ d, d.sum(axis=0), (d @ net.out.T) * (h > 0)
            g_emb, g_conv, g_cb = np.zeros_like(net.emb), [], []
            for i, (w, at) in enumerate(zip(cfg.widths, where, strict=True)):
                dy = dh[:, i * cfg.filters : (i + 1) * cfg.filters]
                g_cb.append(dy.sum(axis=0))
                g = np.zeros_like(net.conv[i])
                for j in range(w):
                    byte = np.take_along_axis(xb, at + j, 1)  # [row, filter]
                    g[j] = np.einsum("rfe,rf->ef", net.emb[byte], dy)
                    np.add.at(g_emb, byte, dy[:, :, None] * net.conv[i][j].T[None])
                g_conv.append(g)
            step += 1
            for p, g, a, b in zip(params, [g_emb, *g_conv, *g_cb, g_out, g_b], m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= cfg.rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def _sampled(cfg: CNNConfig):
    def run(batches):
        for batch in batches:
            ids, langs, wins = [], [], []
            for i, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = windows(text, cfg.window)
                for k in sorted({0, len(w) // 2} if len(w) else set())[: cfg.per_doc]:
                    ids.append(i)
                    langs.append(lang)
                    wins.append(w[k].tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(wins, pa.binary())], ["doc_id", "lang", "win"])

    return run


def fit(docs: DataFrame, cfg: CNNConfig = CNNConfig(), learn=None) -> ByteCNN:
    """Network of the non-null ``lang`` of the rows of ``docs`` (doc_id, text, lang) that ``learn`` admits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("doc_id is not null and text is not null and lang is not null")
    if learn is not None:
        rows = rows.filter(learn)
    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.sample)
    t = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "lang").mapInArrow(_sampled(cfg), "doc_id long, lang string, win binary")
    t = t.orderBy(F.xxhash64("doc_id"), "doc_id", "win", "lang").limit(cfg.sample * cfg.per_doc).toPandas()
    t = t.sort_values(["doc_id", "win", "lang"], kind="stable")
    langs = sorted(t.lang.unique())
    x = np.frombuffer(b"".join(t.win), np.uint8).reshape(-1, cfg.window)
    return train(x, np.searchsorted(langs, t.lang.to_numpy(str)) if langs else np.zeros(0, int), langs, cfg)


def _predict(net: ByteCNN):
    def run(batches):
        tables, size, none = net.tables(), net.cfg.window, not net.langs
        for batch in batches:
            best, score = [], []
            held: list[np.ndarray] = []
            todo: list[int] = []

            def settle():
                if not held:
                    return
                x = np.concatenate(held)
                p = np.concatenate([net.probs(x[k : k + 512], tables) for k in range(0, len(x), 512)])
                weight = (x != 0).sum(axis=1)[:, None]
                first = np.cumsum([0, *(len(h) for h in held)])[:-1]
                mean = np.add.reduceat(p * weight, first) / np.maximum(np.add.reduceat(weight, first), 1)
                for i, row in zip(todo, mean, strict=True):
                    best[i], score[i] = net.langs[int(row.argmax())], float(min(row.max(), 1.0))
                held.clear()
                todo.clear()

            count = 0
            for text in batch.column(1):
                t = text.as_py()
                best.append("und")
                score.append(0.0)
                if not none and t is not None and _LETTER.search(t):
                    w = windows(t, size)
                    held.append(w)
                    todo.append(len(best) - 1)
                    count += len(w)
                    if count >= 2048:
                        settle()
                        count = 0
            settle()
            yield pa.record_batch([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict_language(docs: DataFrame, net: ByteCNN) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): lang_pred, score (mean probability over all windows, by their bytes).

    ``und`` with score 0 where the text is null or has no letter, and everywhere if nothing was learned. Rows that repeat are
    judged alike. Other columns are ignored; nothing is shuffled.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_predict(net), "doc_id long, lang_pred string, score double")
