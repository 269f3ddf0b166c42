"""Queries of the subpackage against their SQL in DuckDB, over whole tables."""

from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from siltstone.llm import registry, vectors
from siltstone.llm.oracle import SQL


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(([r[i] for i in order] for r in found), key=repr)


def agree(spark, name, folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    found = registry.queries()[name](spark, str(folder))
    assert rows(found.columns, map(tuple, found.collect())) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    agree(spark, name, "/root/testdata/sf0.01")


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def pairs(n: int, seed: int = 3, d: int = 64) -> np.ndarray:
    """n random vectors and n at a cosine of 0.951 to 0.97 of them, float32."""
    rng = np.random.default_rng(seed)
    a, o = unit(rng.normal(size=(n, d))), rng.normal(size=(n, d))
    c = rng.uniform(0.951, 0.97, n)[:, None]
    return np.concatenate([a, c * a + (1 - c * c) ** 0.5 * unit(o - (o * a).sum(1)[:, None] * a)]).astype(np.float32)


def test_vectors_with_links(spark, tmp_path):
    # few enough for one list, so that no link can be lost
    v = pairs(150)
    rng = np.random.default_rng(5)
    chain = unit(np.cumsum(rng.normal(size=(60, 64)) * 0.12, axis=0) + 1).astype(np.float32)
    table = [(i, x.tolist()) for i, x in enumerate([*v, *chain, *([v[0]] * 5)])] + [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [1.0, None]), (904, [])]
    spark.createDataFrame(table, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    agree(spark, "op2_embedding_near_dedup", tmp_path)


@pytest.mark.parametrize("n", [1000, 50_000])
def test_vectors_recall_of_isolated_pairs(spark, tmp_path, n):
    v = pairs(n)
    pq.write_table(pa.table({"vec_id": np.arange(2 * n), "embedding": pa.FixedSizeListArray.from_arrays(v.ravel(), 64).cast(pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    found = vectors.near_duplicates(spark.read.parquet(f"{tmp_path}/v.parquet")).where("n_links > 0").toPandas().set_index("vec_id")
    # each vector's own partner, by brute force over the planted pairs alone: random vectors are far apart
    linked = (unit(v[:n].astype(float)) * unit(v[n:].astype(float))).sum(1) >= 0.95
    both = found.n_links.reindex(np.arange(n), fill_value=0).to_numpy() == 1
    assert both[linked].mean() >= 0.99 and not both[~linked].any()
    assert (found.component_id == found.index % n).all()
