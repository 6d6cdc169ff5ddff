import numpy as np
import pytest

from tidemark.operators import vectors
from tidemark.operators.annindex import AnnIndex
from tidemark.operators.store import Conflict


def frame(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], "key string, embedding array<float>")


def test_folds_and_rebuilds_lose_nothing(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 8))
    index = AnnIndex(spark, str(tmp_path / "ann"))
    assert index.search([1.0] * 8, 3).count() == 0
    index.insert(frame(spark, [(f"k{i:02d}", x) for i, x in enumerate(v[:40])]))
    assert index.search([float(x) for x in v[7]], 1).first().key == "k07"
    first = index.rebuild()
    assert first["buffer"] == [] and len(first["centroids"]) == 6
    index.insert(frame(spark, [(f"k{i:02d}", x) for i, x in enumerate(v[40:], 40)]))
    index.insert(frame(spark, [("k07", v[50])]))  # replaces an indexed row

    # A row that comes in while a fold is writing stays in the buffer of the state that the fold publishes.
    write = index._write

    def slow(df, kind):
        path = write(df, kind)
        if kind == "cells":
            AnnIndex(spark, index.root).insert(frame(spark, [("late", v[3])]))
        return path

    monkeypatch.setattr(index, "_write", slow)
    folded = index.fold()
    monkeypatch.undo()
    assert len(folded["buffer"]) == 1 and folded["number"] == 6
    assert index._cells(folded).count() == 60 and index.entries().count() == 61
    want = {r.key for r in vectors.exact(index.entries(), [float(x) for x in v[3]], 5).collect()}
    assert "late" in want and {r.key for r in index.search([float(x) for x in v[3]], 5, probes=8).collect()} == want

    # Of two that replace the cells at once, the second is void.
    monkeypatch.setattr(index, "_write", lambda df, kind: (AnnIndex(spark, index.root).rebuild(), write(df, kind))[1])
    with pytest.raises(Conflict):
        index.fold()
    monkeypatch.undo()
    assert index.entries().count() == 61 and index.state()["buffer"] == []


def test_a_busy_index_gives_up(spark, tmp_path, monkeypatch):
    index = AnnIndex(spark, str(tmp_path / "ann"))
    tries = []
    monkeypatch.setattr(index.files, "create", lambda *a: tries.append(a) and False)
    with pytest.raises(Conflict):
        index.insert(frame(spark, [("a", [1.0])]))
    assert len(tries) == 8
