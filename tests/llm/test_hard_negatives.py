import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import hard_negatives as hn

SCHEMA = "id long, label int, vector array<double>, row int, windows string, score int"


def rows_of(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    return frame.withColumn("vector", hn.quantised(F.col("vector"))).withColumn("anchor", F.col("id") % 10 == 0)


def plain(rows, positives=5, negatives=5, low=80, high=100):
    """The same by scoring everything."""
    kept = []
    for i, label, v in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, label, [math.floor(256 * x) for x in v]))
    found = []
    for n, (i, label, v) in enumerate(kept):
        if i is None or i % 10:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, other) for m, (j, other, w) in enumerate(kept) if m != n]
        scored.sort(key=lambda x: x[:3])
        for s, _, j, _ in [x for x in scored if x[3] == label][:positives]:
            inside = [x for x in scored if x[3] != label and low * -s <= 100 * -x[0] <= high * -s]
            found += [(i, j, k + 1, x[2], -s, -x[0]) for k, x in enumerate(inside[:negatives])]
    return sorted(found)


def random_rows(n, dims, seed, labels=3):
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(n, dims)) / dims**0.5
    made[n // 2 : n // 2 + n // 3] = made[5]  # a third of all rows are alike
    return [(int(i), int(rng.integers(labels)), v.tolist()) for i, v in zip(rng.permutation(n), made)]


@pytest.mark.parametrize("cells", [2, 8, 64, 256])
def test_against_scoring_all(spark, monkeypatch, cells):
    monkeypatch.setattr(hn, "LEAST_ROWS", 40)
    monkeypatch.setattr(hn, "SLICE", 16)
    rows = random_rows(240, 6, cells)
    got = hn.mine(rows_of(spark, rows).repartition(5), cells=cells).collect()
    assert sorted(map(tuple, got)) == plain(rows) and len(got) > 100


@pytest.mark.parametrize("limits", [(1, 2, 50, 90), (7, 1, 0, 100), (3, 9, 100, 100)])
def test_other_windows(spark, limits):
    rows = random_rows(150, 4, 9)
    got = hn.mine(rows_of(spark, rows), *limits).collect()
    assert sorted(map(tuple, got)) == plain(rows, *limits)


def test_rows_that_take_no_part_and_odd_vectors(spark):
    rows = random_rows(60, 3, 4)
    rows += [(1000, None, [1.0, 1.0, 1.0]), (1010, 1, None), (1020, 1, [1.0, None, 0.0]), (1030, 1, [float("nan"), 0.0, 0.0]), (1040, 2, [float("inf"), 0.0, 0.0])]
    rows += [(1050, 1, []), (1060, 2, [0.5]), (1070, 0, [0.1, 0.2, 0.3, 0.4]), (1080, 0, [-9.0, 0.0, 3.0])]
    got = hn.mine(rows_of(spark, rows)).collect()
    assert sorted(map(tuple, got)) == plain(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = random_rows(40, 3, 5)
    rows = rows + rows[:15] + [(None, 1, [0.3, 0.1, 0.2])]
    key = lambda r: str(r)
    got = [tuple(r) for r in hn.mine(rows_of(spark, rows)).collect()]
    assert sorted(((*r[:3], r[3] or 0, *r[4:]) for r in got), key=key) == sorted(plain(rows), key=key)


def test_large_components(spark):
    rows = [(i, i % 2, [float((i * 7919) % 31 + 1) * 3e5, float(i % 5) * 3e5]) for i in range(30)]
    assert sorted(map(tuple, hn.mine(rows_of(spark, rows)).collect())) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(10, 1, [1.0])], [(1, 1, [1.0]), (2, 1, [1.0])], [(10, None, None)]])
def test_empty_tables_and_no_anchors(spark, rows):
    assert hn.mine(rows_of(spark, rows)).collect() == []


def test_few_rows_are_scored():
    rng = np.random.default_rng(1)
    vectors = np.floor(256 * rng.normal(size=(20_000, 64)) / 8).astype(np.int64)
    cuts = np.quantile(vectors, np.arange(1, 64) / 64, axis=0).astype(np.int64).T
    lows = np.hstack((vectors.min(0)[:, None], cuts))
    grid = hn.Grid(lows, np.hstack((np.maximum(lows[:, 1:] - 1, lows[:, :-1]), vectors.max(0)[:, None])))
    import pyarrow as pa

    cells = grid.cells(vectors)
    block = hn.Block(pa.table({"label": rng.integers(0, 10, 20_000), "row": np.arange(20_000), "id": np.arange(20_000), "vector": pa.array(vectors.tolist(), pa.list_(pa.int64())), "cells": [x.tobytes() for x in cells]}), grid)
    for anchor in range(5):
        own = vectors[anchor]
        low, high = grid.tables(own)
        at = cells.astype(np.int64) + np.arange(64) * 64
        assert (low.take(at).sum(1) <= vectors @ own).all() and (high.take(at).sum(1) >= vectors @ own).all()
    asking = [{"row": n, "label": int(block.labels[block.rows == n][0]), "vector": vectors[n], "windows": [(25_000, 31_000)]} for n in range(50)]
    block.nearest(asking, 5)
    block.within(asking, 5)
    assert block.scored < 0.02 * 50 * 20_000
