"""Snapshots on disk: Parquet folders that a small manifest names, swapped by one rename."""

from __future__ import annotations

import glob
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.props import PV
from .operators import graph as G

SCHEMAS = {
    "nodes": ", ".join(f"{c} {t}" for c, t in G.NODE_FIELDS.items()),
    "edges": f"seq bigint, src string, edge_type string, dst string, created_at bigint, properties map<string,{PV}>",
    "vectors": "namespace string, node_id string, vector array<float>, seq bigint",
    "tombstones": "node_id string, lsn bigint",
}


class ConflictError(RuntimeError):
    """Another writer committed since this one opened the store."""


class Store:
    """A reader keeps the folders of the manifest that it opened; a commit writes new folders and then the next manifest.

    Manifests are local or mounted files, one a version; the highest counts. Each is written aside and then linked to its name, which only one
    writer can do. Tables are whatever ``root`` is to Spark. ``create`` refuses a store that is there.
    """

    def __init__(self, spark: SparkSession, root: str, create: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        found = max(glob.glob(f"{glob.escape(self.root)}/manifest-*.json"), default=None)
        if create and found:
            raise FileExistsError(f"there is a store at {root}")
        if found:
            with open(found) as f:
                self.manifest = json.load(f)
            if self.manifest["format"] != 1:
                raise ValueError(f"unknown store format: {self.manifest['format']}")
        elif create:
            os.makedirs(self.root, exist_ok=True)
            self._publish({"format": 1, "version": 0, "tables": {t: [] for t in SCHEMAS}})
        else:
            raise FileNotFoundError(f"no store at {root}")

    @classmethod
    def exists(cls, root: str) -> bool:
        return bool(glob.glob(f"{glob.escape(root.rstrip('/'))}/manifest-*.json"))

    def _publish(self, manifest: dict) -> None:
        path = f"{self.root}/manifest-{manifest['version']:012d}.json"
        with open(tmp := f"{self.root}/.{uuid.uuid4().hex}", "w") as f:
            json.dump(manifest, f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(tmp, path)
        except FileExistsError:
            raise ConflictError("the store changed since it was opened") from None
        finally:
            os.unlink(tmp)
        self.manifest = manifest

    def table(self, name: str) -> DataFrame:
        dirs = [f"{self.root}/{d}" for d in self.manifest["tables"][name]]
        if not dirs:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*dirs)

    def graph(self) -> G.Graph:
        """Of rows with one node id the newest part's counts."""
        return G.Graph(*(self.table(t) for t in ("nodes", "edges", "vectors", "tombstones")))

    def commit(self, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None) -> int:
        tables = {k: list(v) for k, v in self.manifest["tables"].items()}
        for how, frames in (("append", append or {}), ("replace", replace or {})):
            for name, df in frames.items():
                part = f"{name}-{self.manifest['version'] + 1}-{uuid.uuid4().hex[:8]}"
                df.select(*(c.split()[0] for c in SCHEMAS[name].split(", "))).to(self.spark.createDataFrame([], SCHEMAS[name]).schema).write.parquet(f"{self.root}/{part}")
                tables[name] = [part] if how == "replace" else [*tables[name], part]
        self._publish({"format": 1, "version": self.manifest["version"] + 1, "tables": tables})
        return self.manifest["version"]

    def put_nodes(self, nodes: DataFrame) -> int:
        """Upsert: given rows replace stored ones of their ids."""
        kept = self.table("nodes").join(nodes.select("id"), "id", "left_anti").unionByName(nodes)
        return self.commit(replace={"nodes": kept})

    def delete(self, *ids: str) -> int:
        return self.commit(append={"tombstones": self.spark.createDataFrame([(i, self.manifest["version"] + 1) for i in ids], SCHEMAS["tombstones"])})

    def undelete(self, *ids: str) -> int:
        return self.commit(replace={"tombstones": self.table("tombstones").filter(~F.col("node_id").isin(list(ids)))})

    def compact(self) -> int:
        """One folder a table, without vectors of deleted nodes."""
        g = self.graph()
        return self.commit(replace={"nodes": g.nodes, "edges": g.edges, "tombstones": g.tombstones.distinct(), "vectors": g.vectors.join(g.tombstones.select("node_id"), "node_id", "left_anti")})
