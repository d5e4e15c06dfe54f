"""Dynamic property values as a comparable struct: (tok, num, txt, items)."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

PV = "struct<tok:string,num:double,txt:string,items:array<string>>"


def token(v: Any) -> str:
    """Type-tagged canonical text: equal tokens are equal values, and 3 isn't 3.0."""
    if v is None:
        return "n"
    if isinstance(v, bool):
        return f"b:{str(v).lower()}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, float):
        return "f:nan!" if math.isnan(v) else f"f:{v + 0.0!r}"
    if isinstance(v, str):
        return f"s:{v}"
    if isinstance(v, (list, tuple)):
        return "l:" + json.dumps([token(x) for x in v], ensure_ascii=False)
    return "m:" + json.dumps({k: token(v[k]) for k in sorted(v)}, ensure_ascii=False)


def pv(v: Any) -> dict:
    number = isinstance(v, (int, float)) and not isinstance(v, bool) and not (isinstance(v, float) and math.isnan(v))
    return {"tok": token(v), "num": float(v) if number else None, "txt": v if isinstance(v, str) else None, "items": [token(x) for x in v] if isinstance(v, (list, tuple)) else None}


def pv_of(col: Column, kind: str) -> Column:
    """The struct of a typed column: kind is int, text or list (of texts)."""
    null = F.lit(None)
    if kind == "int":
        parts = (F.concat(F.lit("i:"), col.cast("long").cast("string")), col.cast("double"), null.cast("string"), null.cast("array<string>"))
    elif kind == "text":
        parts = (F.concat(F.lit("s:"), col), null.cast("double"), col, null.cast("array<string>"))
    else:
        parts = (F.concat(F.lit("l:"), F.to_json(col)), null.cast("double"), null.cast("string"), F.transform(col, lambda x: F.concat(F.lit("s:"), x)))
    made = F.struct(*(p.alias(n) for p, n in zip(parts, ("tok", "num", "txt", "items"), strict=True)))
    return F.when(col.isNotNull(), made)
