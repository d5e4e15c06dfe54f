"""Predicates over nodes: dataclasses, their JSON form, and their compilation to columns.

Logic is two-valued: a missing property makes every comparison false but ``ne``, so each leaf is
coalesced and negation never meets a null. As a filter, where null counts as false, times, kinds and documents
compile to plain comparisons that Parquet takes; a typed field may be shadowed by metadata, so its comparison stays above the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import parse_kind
from .props import pv, pv_of

OPS = ("eq", "ne", "lt", "lte", "gt", "gte", "contains", "starts_with", "in")
#: kind -> key -> type; a key shadows metadata only on nodes of its kind.
FIELDS = {
    "Document": {"title": "text", "source_uri": "text", "content_hash": "text", "version": "int"},
    "Chunk": {"text": "text", "document_id": "text", "chunk_index": "int", "token_count": "int", "embedding_model": "list"},
    "Entity": {"name": "text", "entity_type": "text", "canonical_id": "text"},
    "PipelineRun": {"pipeline_version": "text", "embedding_model": "text", "chunker": "text"},
}
COMMON = {"id": "text", "kind": "text", "created_at": "int"}


def _snake(kind: str) -> str:
    return {"PipelineRun": "pipeline_run"}.get(kind, kind.lower())


@dataclass(frozen=True)
class Predicate:
    type: str
    args: dict = field(default_factory=dict)

    def __and__(self, other: Predicate) -> Predicate:
        return all_of(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return any_of(self, other)

    def __invert__(self) -> Predicate:
        return Predicate("not", {"predicate": self})

    def to_json(self) -> dict:
        out: dict[str, Any] = {"type": self.type}
        for k, v in self.args.items():
            out[k] = v.to_json() if isinstance(v, Predicate) else [x.to_json() if isinstance(x, Predicate) else x for x in v] if isinstance(v, (list, tuple)) else v
        return out

    @staticmethod
    def from_json(data: dict) -> Predicate:
        kind, args = data["type"], {k: v for k, v in data.items() if k != "type"}
        if kind in ("and", "or"):
            args["predicates"] = tuple(Predicate.from_json(x) for x in args["predicates"])
        elif kind == "not":
            args["predicate"] = Predicate.from_json(args["predicate"])
        elif kind not in _COMPILE:
            raise ValueError(f"unknown predicate: {kind!r}")
        elif kind == "property" and args["op"] not in OPS:
            raise ValueError(f"unknown comparison: {args['op']!r}")
        return Predicate(kind, args)

    def needs_latest(self) -> bool:
        inner = [*self.args.get("predicates", ()), *([self.args["predicate"]] if "predicate" in self.args else [])]
        return self.type in ("latest_version", "superseded") or any(p.needs_latest() for p in inner)

    def column(self) -> Column:
        """Boolean, never null; ``_superseded`` tells whether a live document supersedes the node's document."""
        return _COMPILE[self.type](**self.args)

    def condition(self) -> Column:
        """The same for a filter: without what keeps nulls out, which scans can't be asked."""
        if self.type in ("and", "or"):
            parts = [p.condition() for p in self.args["predicates"]]
            return reduce(lambda a, b: a & b if self.type == "and" else a | b, parts, F.lit(self.type == "and"))
        return _CONDITION.get(self.type, lambda **_: self.column())(**self.args)


def all_nodes() -> Predicate:
    return Predicate("all")


def kind(*kinds: str) -> Predicate:
    return Predicate("kind", {"kinds": tuple(_snake(parse_kind(k)) for k in kinds)})


def latest() -> Predicate:
    return Predicate("latest_version")


def superseded() -> Predicate:
    return Predicate("superseded")


def created_after(at: int) -> Predicate:
    return Predicate("created_after", {"at": at})


def created_before(at: int) -> Predicate:
    return Predicate("created_before", {"at": at})


def has_embedding(model: str) -> Predicate:
    return Predicate("has_embedding", {"model": model})


def in_document(node_id: str) -> Predicate:
    return Predicate("in_document", {"id": node_id})


def prop(key: str, op: str, value: Any) -> Predicate:
    return Predicate.from_json({"type": "property", "key": key, "op": op, "value": value})


def all_of(*ps: Predicate) -> Predicate:
    return Predicate("and", {"predicates": ps})


def any_of(*ps: Predicate) -> Predicate:
    return Predicate("or", {"predicates": ps})


def _time() -> Column:
    return F.when(F.col("kind") == "PipelineRun", F.col("run_at")).otherwise(F.col("created_at"))


def _field(key: str, node_kind: str | None) -> Column:
    if key == "created_at":
        return _time()
    if key == "embedding_model" and node_kind == "Chunk":
        return F.transform("embeddings", lambda e: e["model"])
    return F.col(key)


def _native(col: Column, ftype: str, op: str, value: Any) -> Column | None:
    """Comparison of a typed field without the struct, where both sides' types agree."""
    same = {"int": isinstance(value, int) and not isinstance(value, bool), "text": isinstance(value, str)}.get(ftype, False)
    if op == "in" and isinstance(value, (list, tuple)):
        ok = [v for v in value if (isinstance(v, int) and not isinstance(v, bool) if ftype == "int" else isinstance(v, str))]
        return None if ftype == "list" else col.isin(ok) if ok else F.lit(False)
    if not same:
        return None
    simple = {"eq": lambda: col == value, "ne": lambda: col != value, "lt": lambda: col < value, "lte": lambda: col <= value, "gt": lambda: col > value, "gte": lambda: col >= value}
    if op in simple:
        return simple[op]()
    if ftype == "text" and op in ("contains", "starts_with"):
        return (F.lower(col).contains if op == "contains" else F.lower(col).startswith)(value.lower())
    return F.lit(False)


def _struct(p: Column, op: str, value: Any) -> Column:
    v = pv(value)
    no = F.lit(False)
    nan = v["tok"] == "f:nan!"
    if op in ("eq", "ne"):
        same = no if nan else (p["tok"] == v["tok"]) & (p["tok"] != "f:nan!")
        return same if op == "eq" else ~same
    if op in ("lt", "lte", "gt", "gte"):
        side, want = ("num", v["num"]) if v["num"] is not None else ("txt", v["txt"])
        if want is None:
            return no
        x = p[side]
        return {"lt": x < want, "lte": x <= want, "gt": x > want, "gte": x >= want}[op]
    if op == "contains":
        in_list = F.array_contains(p["items"], v["tok"])
        in_text = F.lower(p["txt"]).contains(value.lower()) if isinstance(value, str) else no
        return F.coalesce(in_list, no) | F.coalesce(in_text, no)
    if op == "starts_with":
        return F.lower(p["txt"]).startswith(value.lower()) if isinstance(value, str) else no
    return p["tok"].isin([pv(x)["tok"] for x in value]) if isinstance(value, (list, tuple)) and value else no


def _property(key: str, op: str, value: Any) -> Column:
    missing = F.lit(op == "ne")
    meta = F.col("metadata")[key]
    general = F.coalesce(_struct(meta, op, value), missing)

    def one(ftype: str, node_kind: str | None) -> Column:
        col = _field(key, node_kind)
        typed = _native(col, ftype, op, value)
        typed = typed if typed is not None else _struct(pv_of(col, ftype), op, value)
        return F.when(col.isNull(), general).otherwise(F.coalesce(typed, missing))

    if key in COMMON:
        return one(COMMON[key], None)
    kinds = [k for k in FIELDS if key in FIELDS[k]]
    out = general
    for k in kinds:
        out = F.when(F.col("kind") == k, one(FIELDS[k][key], k)).otherwise(out)
    return out


_COMPILE = {
    "all": lambda: F.lit(True),
    "kind": lambda kinds: F.col("kind").isin([parse_kind(k) for k in kinds]),
    "latest_version": lambda: ~F.col("_superseded"),
    "superseded": lambda: F.col("_superseded"),
    "created_after": lambda at: F.coalesce(_time() > at, F.lit(False)),
    "created_before": lambda at: F.coalesce(_time() < at, F.lit(False)),
    "has_embedding": lambda model: F.coalesce(F.exists("embeddings", lambda e: (e["model"] == model) | (F.concat_ws(":", e["model"], e["dim"].cast("string")) == model)), F.lit(False)),
    "in_document": lambda id: F.coalesce(F.when(F.col("kind") == "Chunk", F.col("document_id") == id).when(F.col("kind") == "Document", F.col("id") == id), F.lit(False)),
    "property": _property,
    "and": lambda predicates: reduce(lambda a, b: a & b, (p.column() for p in predicates), F.lit(True)),
    "or": lambda predicates: reduce(lambda a, b: a | b, (p.column() for p in predicates), F.lit(False)),
    "not": lambda predicate: ~predicate.column(),
}


def _at(test) -> Column:
    return ((F.col("kind") != "PipelineRun") & test(F.col("created_at"))) | ((F.col("kind") == "PipelineRun") & test(F.col("run_at")))


_CONDITION = {
    "created_after": lambda at: _at(lambda c: c > at),
    "created_before": lambda at: _at(lambda c: c < at),
    "in_document": lambda id: ((F.col("kind") == "Chunk") & (F.col("document_id") == id)) | ((F.col("kind") == "Document") & (F.col("id") == id)),
}
