"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from earmark.llm import catalog, learned, vafile


def _vectors(n, seed=0, kind=float):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n // 2 : n // 2 + n // 5] = x[0]  # ties
    return np.floor(x * 256).astype(int) if kind is int else x.astype(np.float32).astype(float)


def _odd(kind):
    bad = [[None] * 16, [1, None] + [1] * 14]
    return bad if kind is int else [*bad, [float("nan")] * 16, [float("inf")] + [0.5] * 15]


def _table(spark, x, kind):
    rows = [(i, [kind(v) for v in r], "clash") for i, r in enumerate(x)]
    odd = [[v if v is None else kind(v) for v in r] for r in _odd(kind)]
    rows += [(100_000 + 50 * i, r, "clash") for i, r in enumerate(odd)] + [(200_000, None, "clash"), (None, [kind(1)] * 16, "clash")]
    return spark.createDataFrame(rows, f"vec_id long, vector array<{'long' if kind is int else 'float'}>, key string")


@pytest.mark.parametrize("bits", [2, 6])
def test_exact_top_k(spark, bits):
    x = _vectors(700, kind=int)
    df = _table(spark, x, int)
    got = vafile.top_k(df, df.filter("vec_id % 50 = 0"), 5, bits).collect()
    want = set()
    for q in range(0, 700, 50):
        scores = x @ x[q]
        order = [i for i in np.lexsort((np.arange(700), -scores)) if i != q][:5]
        want |= {(q, rank, int(i), int(scores[i])) for rank, i in enumerate(order, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    few = df.filter("vec_id < 3")
    assert vafile.top_k(few, few.filter("vec_id = 0"), 5).count() == 2
    assert vafile.top_k(df.filter("false"), df.filter("false"), 5).count() == 0


def test_exact_top_k_of_repeated_rows(spark):
    import duckdb

    from earmark.llm.catalog import OP5_SQL

    rng = np.random.default_rng(4)
    x = rng.integers(-40, 40, (400, 8))
    x[100:400:3] = x[100]  # ties across the cut
    ids = np.arange(400) // 3 * 3  # candidates of three vectors, some on both sides of the first cut
    ids[300:306] = 50  # a repeated query
    ids[390:] = 390
    rows = [(int(i), [int(v) for v in r]) for i, r in zip(ids, x)] + [(0, [int(v) for v in x[0]])] * 2
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = sorted(map(tuple, vafile.top_k(df, df.filter("vec_id % 50 = 0"), 5, 2).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [(i, [v / 256 for v in r]) for i, r in rows])
    assert got == sorted(con.execute(OP5_SQL).fetchall())


def test_learned_partitions(spark):
    x = _vectors(4_000)
    df = _table(spark, x, float)
    index = learned.build_index(df, sample_rows=2_000)
    assert index.parts > index.probes > 0 and index.blocks.agg(F.sum("n")).first()[0] == 4_000
    got = learned.search(index, df.filter("vec_id % 20 = 0"), 20).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q in range(0, 4_000, 20):
        scores = x @ x[q]
        order = [i for i in np.lexsort((np.arange(4_000), -np.round(scores, 12))) if i != q][:20]
        rows = sorted(found[q], key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 21)) and all(r.vec_id != q for r in rows)
        assert all(r.score == pytest.approx(scores[r.vec_id], abs=1e-12) for r in rows)
        hits, total = hits + len({r.vec_id for r in rows} & set(order)), total + 20
    assert hits >= 0.9 * total


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_registered_search_goes_through_its_parts(spark, sf):
    """The registered function against brute force: recall of 0.9 at least, exact scores, ties to the smaller id."""
    d = f"/root/testdata/sf{sf}"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r[0], r[1]) for r in rows if r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    index = learned.build_index(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector")))
    assert 0 < index.probes < index.parts
    found = {}
    for r in catalog.op6_learned_partitions(spark, d).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        scores = np.add.accumulate(x * x[i], axis=1)[:, -1]
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:20]
        own = sorted(found[ids[i]])
        assert [n for n, _, _ in own] == list(range(1, 21))
        exact = dict(zip(ids.tolist(), scores.tolist()))
        assert all(exact[v] == s for _, v, s in own) and own == [(n + 1, v, s) for n, (v, s) in enumerate(sorted(((v, s) for _, v, s in own), key=lambda z: (-z[1], z[0])))]
        hits, total = hits + len({v for _, v, _ in own} & set(ids[order].tolist())), total + 20
    assert hits >= 0.9 * total


def test_a_large_part_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(learned, "TASK_BLOCKS", 1)
    monkeypatch.setattr(learned, "BLOCK_ROWS", 40)
    df = _table(spark, _vectors(600), float)
    index = learned.build_index(df)
    got = sorted(map(tuple, learned.search(index, df.filter("vec_id % 20 = 0"), 20).collect()))
    monkeypatch.undo()
    assert got == sorted(map(tuple, learned.search(index, df.filter("vec_id % 20 = 0"), 20).collect())) and len(got) == 600


def test_double_vectors_keep_their_digits(spark):
    x = np.random.default_rng(1).standard_normal((30, 3)) + 1e-9
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, vector array<double>")
    for r in learned.search(learned.build_index(df), df.filter("vec_id = 0"), 5).collect():
        assert r.score == np.add.accumulate(x[0] * x[r.vec_id])[-1]


def test_small_and_empty_tables(spark):
    df = _table(spark, _vectors(10), float)
    index = learned.build_index(df)
    assert learned.search(index, df.filter("vec_id % 20 = 0"), 20).count() == 9
    empty = df.filter("false")
    assert learned.search(learned.build_index(empty), empty).count() == 0


def test_parts_are_balanced():
    x = _vectors(512, 3)
    parts = learned.balanced_parts(learned.neighbours(x, x, 8, True), 8)
    assert set(np.bincount(parts)) == {64}
