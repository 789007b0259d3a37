"""Links of embeddings against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from lexigauge.llm import embedding_dedup


def vectors(seed, n=900, d=24):
    g = np.random.default_rng(seed)
    x = g.standard_normal((n, d))
    for k in range(0, n - 30, 10):
        x[k + 1 : k + g.integers(2, 6)] = x[k] + g.standard_normal((1, d)) * g.choice([0.1, 0.3])
    x[-30:] = x[-30] + g.standard_normal((30, d)) * 0.15
    return (x * g.uniform(0.5, 2, (n, 1))).astype(np.float32)


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK, 16])
def test_recall_and_precision(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "LIST_SIZE", 30)
    x = vectors(3)
    rows = [(i, v.tolist(), i % 10) for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.97 * linked.sum()
    assert all(got[i]["n_links"] <= linked[i].sum() for i in got)
    if found == linked.sum():
        label = list(range(len(u)))
        for _ in range(len(u)):
            new = [min([label[i], *(label[j] for j in np.flatnonzero(linked[i]))]) for i in range(len(u))]
            if new == label:
                break
            label = new
        assert all(got[i]["component_id"] == label[i] and got[i]["kept"] == (label[i] == i) for i in got)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [1.0, None]), (8, [inf, 1.0]), (9, []), (None, [0.0, 1.0]), (11, [0.0, 1.0]), (12, [1.0, 0.0, 0.0]), (13, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, v string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert got[None] == (1, 11, False) and got[11] == (1, 11, True)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 12, 13))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(df.filter("vec_id in (4, 5)")).count() == 2


def test_large_group_of_near_vectors(spark):
    """A third of 60,000 distinct vectors are near each other: their links are found from every list."""
    g = np.random.default_rng(7)
    n, d = 60_000, 32
    x = g.standard_normal((n, d))
    x[: n // 3] = x[0] + g.standard_normal((n // 3, d)) * 0.3
    x = x.astype(np.float32)
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), d).cast(pa.list_(pa.float32()))})
    got = embedding_dedup.near_duplicates(spark.createDataFrame(table)).select("vec_id", "n_links").toArrow().sort_by("vec_id").column("n_links").to_numpy()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = np.concatenate([(u[i : i + 2000] @ u.T >= 0.9).sum(1) - 1 for i in range(0, n, 2000)])
    assert linked.sum() > 50_000_000 and np.array_equal(got, linked)


def test_dimensions(spark):
    """Vectors of equal dimension link, whatever dimension most have; those of different ones never do."""
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [2.0, 0.0, 0.1]), (6, [3.0]), (7, [0.5]), (8, [-1.0]), (9, [1.0, 0.0, 0.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (0, 8), 9: (0, 9)}
