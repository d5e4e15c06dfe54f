"""Arrow UDFs over the text rules, and native expressions for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Python works on so many rows, or bytes or items of them, at a time: what it holds doesn't grow with Spark's batches, nor with what a row yields.
ROWS, SIZE = 256, 1 << 20


def portions(col: pa.Array, rows: int = ROWS, size: int = SIZE) -> Iterator[pa.Array]:
    """The column in slices of up to ``rows`` rows and about ``size`` bytes of text or items of lists, one row at least."""
    length = pc.list_value_length if pa.types.is_list(col.type) or pa.types.is_large_list(col.type) else pc.binary_length
    ends = np.cumsum(pc.fill_null(length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(col):
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        end = min(max(end, at + 1), at + rows)
        yield col.slice(at, end - at)
        at = end


def batched(fn: Callable[[list], pa.Array], kind: str, size: int = SIZE):
    """A column function that maps lists of values to Arrow arrays, a portion at a time."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in portions(batch, size=size):
                yield fn(part.to_pylist())

    return F.arrow_udf(run, kind)


def nested(rows: list[list], values: Callable[[list], pa.Array]) -> pa.Array:
    """An array of lists; ``values`` makes the array of all their items."""
    ends = np.cumsum([0, *(len(r) for r in rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values([x for r in rows for x in r]))


def records(rows: list[list[tuple]], **kinds: pa.DataType) -> pa.Array:
    """An array of lists of structs."""
    columns = lambda items: [pa.array([x[k] for x in items], t) for k, t in enumerate(kinds.values())]
    return nested(rows, lambda items: pa.StructArray.from_arrays(columns(items), list(kinds)))


def html_text(col: Column) -> Column:
    return batched(lambda ts: pa.array([None if t is None else T.html_to_text(t) for t in ts], pa.string()), "string")(col)


def chunks(col: Column, chunker: T.Chunker) -> Column:
    return batched(lambda ts: nested([chunker.split(t) for t in ts], lambda x: pa.array(x, pa.string())), "array<string>")(col)


def entities(col: Column, least: int = 1) -> Column:
    kind = "array<struct<name:string,norm:string,entity_type:string,confidence:double,mentions:int>>"
    return batched(lambda ts: records([T.entities(t, least) for t in ts], name=pa.string(), norm=pa.string(), entity_type=pa.string(), confidence=pa.float64(), mentions=pa.int32()), kind)(col)


def embedding(col: Column, dim: int = 256) -> Column:
    return batched(lambda ts: vectors(T.hash_embeddings(ts, dim)), "array<float>")(col)


def vectors(rows) -> pa.Array:
    """An array of lists of equal length."""
    rows = np.asarray(rows, np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def aliases(col: Column, threshold: float, across_types: bool) -> Column:
    """Of arrays of (entity, name, entity_type, mentions)."""
    find = lambda rows: T.find_aliases([tuple(r.values()) for r in rows], threshold, across_types)
    return batched(lambda docs: records([find(d) for d in docs], id=pa.string(), head=pa.string(), similarity=pa.float64()), "array<struct<id:string,head:string,similarity:double>>", 1 << 14)(col)


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, ``size - overlap`` apart, trimmed, blank ones dropped: no Python."""
    t, step = F.trim(text), max(size - overlap, 1)
    n = F.when(F.char_length(t) <= size, 1).otherwise(F.ceil((F.char_length(t) - size) / step) + 1).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.trim(F.substring(t, i * step + 1, F.lit(size)))), lambda p: p != "")


def token_estimate(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.greatest(F.floor(F.char_length(text) / 4).cast("int"), words)


def normal_name(name: Column) -> Column:
    n = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{IsAlphabetic}\p{N}&]+", " "), " +", " "))
    return F.regexp_replace(n, "^the (?=.)", "")


def title(text: Column, name: Column) -> Column:
    head = F.filter(F.slice(F.split(text, "\n"), 1, 20), lambda x: F.trim(x).startswith("# "))
    return F.coalesce(F.nullif(F.trim(F.substring(F.trim(F.try_element_at(head, F.lit(1))), 3, 1 << 30)), F.lit("")), name)
