"""Identifiers, hashes and the vocabulary of the graph."""

from __future__ import annotations

import hashlib
import re
import time
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("Document", "Chunk", "Entity", "PipelineRun")
#: In code order, which is also the order in which neighbours are listed.
EDGE_TYPES = ("PART_OF", "PRECEDES", "FOLLOWS", "SUPERSEDES", "MENTIONS", "RELATES_TO", "SIMILAR_TO", "DERIVED_FROM", "EMBEDDED_BY", "EXTRACTED_BY")
EDGE_CODE = {t: i + 1 for i, t in enumerate(EDGE_TYPES)}
EDGE_CLASS = {t: "structural" if i < 4 else "semantic" if i < 7 else "provenance" for i, t in enumerate(EDGE_TYPES)}
INVERSE = {"PRECEDES": "FOLLOWS", "FOLLOWS": "PRECEDES"}


def parse_kind(name: str) -> str:
    key = re.sub(r"[_-]", "", name).lower()
    found = {k.lower(): k for k in KINDS} | {"doc": "Document", "run": "PipelineRun"}
    if key not in found:
        raise ValueError(f"unknown node kind: {name!r}")
    return found[key]


def new_id() -> str:
    """A time-ordered identifier."""
    n = int(time.time() * 1000) << 80 | uuid.uuid4().int & ((1 << 80) - 1)
    return str(uuid.UUID(int=n & ~(0xF << 76) & ~(0x3 << 62) | 7 << 76 | 2 << 62))


def _shape(h: Column) -> Column:
    """The first 128 bits of a hex digest as an identifier of version 8."""
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def derived_id(space: str, *seed: Column) -> Column:
    """The same identifier for the same seed, on every run and machine."""
    return _shape(F.sha2(F.concat_ws("\u0000", F.lit(space), *seed), 256))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_id(node_id: str) -> str:
    return node_id.replace("-", "")[-8:]


def config_hash(**parts) -> str:
    return hashlib.sha256(repr(sorted(parts.items())).encode()).hexdigest()
