"""Differences between versions, piece by piece."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import lcs_diff


def diff_pairs(pairs: DataFrame, most: int = 2000) -> DataFrame:
    """(src, dst, pos, op, text) for (src, dst, old, new): how the pieces of ``old`` become ``new``."""
    def run(batches):
        for b in batches:
            rows = [(s, d, k, op, t) for s, d, old, new in zip(b.src, b.dst, b.old, b.new, strict=True) for k, (op, t) in enumerate(lcs_diff(list(old), list(new), most))]
            yield pd.DataFrame(rows, columns=["src", "dst", "pos", "op", "text"])

    return pairs.select("src", "dst", "old", "new").mapInPandas(run, "src string, dst string, pos int, op string, text string")
