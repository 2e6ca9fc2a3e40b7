import numpy as np
import pytest

from memloom.operators import vectors
from memloom.session import input_bytes, new_dir, shared_root, spread


def test_small_tables_use_all_cores(spark, tmp_path):
    at = str(tmp_path / "t.parquet")
    spark.range(1000).coalesce(1).write.parquet(at)
    table = spark.read.parquet(at)
    assert 0 < input_bytes(table.where("id > 5")) < 100_000
    cores = spark.sparkContext.defaultParallelism
    assert spread(table).rdd.getNumPartitions() == cores and spread(table).count() == 1000
    had = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spread(table) is table
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", had)


def test_shared_folders(spark):
    assert new_dir(spark, "x").startswith(shared_root(spark) + "/x-") and new_dir(spark, "x") != new_dir(spark, "x")


@pytest.mark.parametrize("block", (1024, 3))
def test_nearest_is_exact(spark, block, monkeypatch):
    """Any number of query blocks, ties, other widths, and vectors that can't be compared."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    monkeypatch.setattr(vectors, "LEAST_FLUSH", 20)
    rng = np.random.default_rng(1)
    rows = [(str(i), rng.normal(size=8).round(1).tolist()) for i in range(60)]
    rows += [("t1", rows[3][1]), ("t2", [2 * x for x in rows[3][1]]), ("w", [1.0, 2.0]), ("n", None), ("z", [0.0] * 8), ("nan", [float("nan")] * 8), ("null", [None] + [1.0] * 7), ("e", [])]
    asked = [(i, rows[i][1]) for i in range(10)] + [(90, [3.0, 6.0]), (91, None), (92, [0.0] * 8)]
    v = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame(asked, "query_id long, vector array<double>")
    got = {}
    for r in vectors.nearest(q, v, 4).collect():
        got.setdefault(r["query_id"], {})[r["id"]] = r["score"]
    unit = {k: np.array(x) / np.linalg.norm(x) for k, x in rows if x and None not in x and np.isfinite(x).all() and any(x)}
    assert set(got) == {*range(10), 90} and got[90].keys() == {"w"}
    for i in range(10):
        true = {k: float(u @ unit[str(i)]) for k, u in unit.items() if len(u) == 8}
        fourth = sorted(true.values())[-4]
        assert {k for k, s in true.items() if s > fourth + 1e-9} <= got[i].keys() and all(abs(s - true[k]) < 1e-9 for k, s in got[i].items())
        assert {k for k, s in true.items() if s >= fourth - 1e-12} - got[i].keys() == set() or len([s for s in true.values() if abs(s - fourth) < 1e-9]) > 1
