"""An inverted file that writers share: a buffer for what is new, and folds and rebuilds that publish in one step.

A state names the cells, the centroids and the parts of the buffer, as one numbered JSON file. Whoever
takes the next number has published; a writer that finds it taken looks again at what is new and tries
the next, RETRIES times at most. So a fold or rebuild replaces the cells and clears what it has taken in
from the buffer in the same step, and rows that came in meanwhile stay in the buffer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import vectors
from tidemark.operators.store import Conflict, Files

RETRIES = 8
ENTRIES = "key string, embedding array<float>"
CELLS = f"cell int, {ENTRIES}"


class AnnIndex:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def _states(self) -> list[str]:
        return [n for n in self.files.names(f"{self.root}/states") if n.endswith(".state")]

    def state(self) -> dict:
        """The last state published: its number, cells, centroids, and parts of the buffer in the order they came."""
        names = self._states()
        if not names:
            return {"number": 0, "cells": None, "centroids": [], "buffer": []}
        return json.loads(self.files.read(f"{self.root}/states/{names[-1]}"))

    def _publish(self, change: Callable[[dict], dict]) -> dict:
        for _ in range(RETRIES):
            now = self.state()
            new = {**change(now), "number": now["number"] + 1}
            if self.files.create(f"{self.root}/states/{new['number']:012d}.state", json.dumps(new)):
                return new
        raise Conflict("the index is busy")

    def _write(self, df: DataFrame, kind: str) -> str:
        path = f"{self.root}/{kind}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _buffer(self, parts: list[str]) -> DataFrame:
        """Buffered rows: of one key that of the last part counts."""
        rows = self.spark.createDataFrame([], f"{ENTRIES}, part int")
        for n, path in enumerate(parts):
            rows = rows.unionByName(self.spark.read.schema(ENTRIES).parquet(path).withColumn("part", F.lit(n)))
        last = rows.groupBy("key").agg(F.max_by("embedding", "part").alias("embedding"))
        return last.select("key", "embedding")

    def _cells(self, state: dict) -> DataFrame:
        return self.spark.read.schema(CELLS).parquet(state["cells"]) if state["cells"] else self.spark.createDataFrame([], CELLS)

    def insert(self, rows: DataFrame) -> dict:
        """Adds rows (key, embedding) to the buffer, where a search finds them at once."""
        part = self._write(rows.select("key", F.col("embedding").cast("array<float>").alias("embedding")), "buffer")
        return self._publish(lambda now: {**now, "buffer": [*now["buffer"], part]})

    def entries(self, state: dict | None = None) -> DataFrame:
        state = state or self.state()
        return vectors.union_buffer(self._cells(state), self._buffer(state["buffer"]))

    def fold(self) -> dict:
        """Takes the buffer into the cells. If another fold or rebuild came first, its cells stand and this one is void."""
        was = self.state()
        c = np.array(was["centroids"], np.float64)
        if not len(c):
            return self.rebuild()
        return self._replace(was, self._write(vectors.fold(self._cells(was), c, self._buffer(was["buffer"])), "cells"), was["centroids"])

    def rebuild(self, cells: int | None = None) -> dict:
        """New centroids and cells from all entries, the buffer's too."""
        was = self.state()
        every = self.entries(was)
        c = vectors.centroids(every, cells)
        if not len(c):
            return was
        return self._replace(was, self._write(vectors.assign(every, c), "cells"), c.tolist())

    def _replace(self, was: dict, cells: str, centroids: list) -> dict:
        def change(now: dict) -> dict:
            if now["cells"] != was["cells"]:
                raise Conflict("the cells were replaced meanwhile")
            return {"cells": cells, "centroids": centroids, "buffer": [p for p in now["buffer"] if p not in was["buffer"]]}

        return self._publish(change)

    def search(self, query: list[float], k: int, probes: int | None = None) -> DataFrame:
        state = self.state()
        c = np.array(state["centroids"], np.float64)
        buffer = self._buffer(state["buffer"])
        return vectors.search(self._cells(state), c, buffer, query, k, probes) if len(c) else vectors.exact(buffer, query, k)
