"""Text files as rows: discovery on the driver, reading in Arrow batches."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_to_text, title_of
from ..functions.wordlists import EXTENSIONS, SKIPPED_DIRS

#: The names that count as text without an ending.
BARE = {"readme", "license", "licence", "changelog", "makefile", "dockerfile", "notice"}


def is_supported(name: str) -> bool:
    name = os.path.basename(name).lower()
    return name in BARE or os.path.splitext(name)[1].lstrip(".") in EXTENSIONS


def discover(root: str, recursive: bool = True) -> list[str]:
    """A file as it is, or the supported files of a directory, sorted; hidden and build directories are left out."""
    if os.path.isfile(root):
        return [os.path.abspath(root)]
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    out = []
    for top, dirs, names in os.walk(os.path.abspath(root)):
        dirs[:] = [d for d in dirs if recursive and not d.startswith(".") and d not in SKIPPED_DIRS]
        out += [os.path.join(top, n) for n in names if is_supported(n)]
    return sorted(out)


def read_documents(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(source_uri, title, text, skipped): text is null and skipped says why for binary or undecodable files.

    Paths must be visible to the executors; ``from_binary`` takes what Spark reads from any store.
    """
    paths = spark.createDataFrame([(p,) for p in discover(root, recursive)], "path string")

    def run(batches):
        for b in batches:
            rows = []
            for p in b.path:
                with open(p, "rb") as f:
                    rows.append(_decode(p, f.read()))
            yield pd.DataFrame(rows, columns=["source_uri", "title", "text", "skipped"])

    return paths.mapInPandas(run, "source_uri string, title string, text string, skipped string")


def from_binary(df: DataFrame) -> DataFrame:
    """The same from (path, content), as the binaryFile source gives."""
    def run(batches):
        for b in batches:
            yield pd.DataFrame([_decode(p, bytes(c)) for p, c in zip(b.path, b.content, strict=True)], columns=["source_uri", "title", "text", "skipped"])

    return df.select("path", "content").mapInPandas(run, "source_uri string, title string, text string, skipped string")


def _decode(path: str, raw: bytes):
    uri = path if "://" in path or path.startswith("file:") else "file://" + path.replace("\\", "/")
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    if b"\0" in raw[:8192]:
        return uri, name, None, "appears to be binary"
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return uri, name, None, "is not valid UTF-8"
    text = html_to_text(text) if name.lower().endswith((".html", ".htm")) else text
    return uri, title_of(text, name), text, None


def from_texts(spark: SparkSession, rows) -> DataFrame:
    """(source_uri, title, text, skipped) from (uri, title, text)."""
    return spark.createDataFrame(list(rows), "source_uri string, title string, text string").withColumn("skipped", F.lit(None).cast("string"))
