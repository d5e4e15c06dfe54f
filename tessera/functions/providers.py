"""What makes vectors of texts and entities of chunks: named providers behind one interface, checked where they hand over."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from . import udfs

#: Providers that are known by name and need a network or model files, which this engine doesn't bring along.
ABSENT = ("local", "openai", "ollama")


class ProviderError(RuntimeError):
    """An embedder that can't be used, or whose answer doesn't fit its questions."""


@dataclass(frozen=True)
class Embedder:
    """``embed`` maps a list of texts to as many vectors of ``dim`` numbers. It runs on the executors, ``batch`` texts at a time."""

    model: str
    dim: int
    embed: Callable[[list[str]], Sequence[Sequence[float]]]
    batch: int = 64

    @property
    def namespace(self) -> str:
        return f"{self.model}:{self.dim}"

    def checked(self, texts: list[str]) -> list[list[float]]:
        """Vectors of all texts. An answer of another count or length, or with a number that isn't finite, is an error."""
        out: list[list[float]] = []
        for k in range(0, len(texts), self.batch):
            some = texts[k : k + self.batch]
            got = [np.asarray(v, np.float64) for v in self.embed(some)]
            if len(got) != len(some):
                raise ProviderError(f"{self.model} gave {len(got)} vectors for {len(some)} texts")
            for v in got:
                if v.shape != (self.dim,):
                    raise ProviderError(f"{self.model} gave a vector of {v.size} numbers instead of {self.dim}")
                if not np.isfinite(v).all():
                    raise ProviderError(f"{self.model} gave a number that isn't finite")
            out += [v.tolist() for v in got]
        return out

    def one(self, text: str) -> list[float]:
        return self.checked([text])[0]

    def column(self, text: Column) -> Column:
        """A vector for each text; a null text counts as empty."""
        checked = self.checked
        return udfs.batched(lambda ts: udfs.vectors(checked(["" if t is None else t for t in ts])), "array<float>")(text)


def hashing(dim: int = 256) -> Embedder:
    if dim < 1:
        raise ProviderError(f"not a dimension: {dim}")
    return Embedder(f"hash-bow-v1-{dim}", dim, lambda texts: T.hash_embeddings(texts, dim), 1024)


def parse_embedder(spec: str) -> Embedder:
    """``hash`` or ``hash:DIM``. Other names are known, but can't be had here: pass an ``Embedder`` of your own instead."""
    kind, colon, rest = spec.strip().partition(":")
    kind = kind.lower()
    if kind == "hash":
        if colon and not rest.isdigit():
            raise ProviderError(f"not a dimension: {rest!r}")
        return hashing(int(rest)) if colon else hashing()
    if kind in ABSENT:
        raise ProviderError(f"{kind} needs a network or model files; pass an Embedder instead")
    raise ProviderError(f"unknown embedder: {spec!r}")


@dataclass(frozen=True)
class Extractor:
    """``column`` maps a text column to an array of (name, norm, entity_type, confidence, mentions)."""

    name: str
    column: Callable[[Column], Column]


def rule_extractor(min_mentions: int = 1) -> Extractor:
    return Extractor("rule-v1", lambda c: udfs.entities(c, min_mentions))


def null_extractor() -> Extractor:
    """Finds nothing."""
    kind = "array<struct<name:string,norm:string,entity_type:string,confidence:double,mentions:int>>"
    return Extractor("none", lambda c: F.array().cast(kind))
