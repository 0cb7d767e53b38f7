import numpy as np
import pytest
from pyspark.sql import functions as F
from stratalog.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=400, d=12, seed=3):
    rng = np.random.default_rng(seed)
    v = (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) / 8 + rng.normal(size=d)).astype(np.float32)
    rows = [(i, r.tolist(), 0) for i, r in enumerate(v)] + [(5, v[5].tolist(), 1), (None, v[9].tolist(), 1)]
    bad = [(900, None, 0), (901, [], 0), (902, [None] * d, 0), (903, [float("nan")] * d, 0), (904, [1.0] * (d - 1) + [float("-inf")], 0), (905, [1.0] * (d - 1), 0)]
    return rows, rows + bad


def plain(good):
    x = np.floor(1024 * np.array([v for _, v, _ in good], np.float64)).astype(int).astype(object) + 100_000
    n, s = len(x), x.sum(0)
    z = n * x - s
    c = z.astype(float) / n
    v = c.T @ c / n
    values, vectors = np.linalg.eigh(v)
    return n, (z * z).sum(1), np.abs(c @ vectors[:, ::-1] / np.sqrt(values[::-1])), values[::-1] / np.trace(v)


@pytest.mark.parametrize("extra", [0, 1])
def test_rows_against_numpy(spark, extra):
    good, rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    if extra:
        df = df.withColumns({c: F.lit("z") for c in ("id", "x", "v", "n", "whitened")})
    got = whitening.whiten(spark, df).collect()
    n, deviation, white, explained = plain(good)
    key = lambda i, d: (i is None, i or 0, int(d))
    want = sorted(zip((g[0] for g in good), deviation, white[:, :8].tolist(), strict=True), key=lambda w: key(w[0], w[1]))
    got = sorted(got, key=lambda r: key(r.id, r.deviation))
    assert len(got) == len(want) and {r.n for r in got} == {n}
    for r, (i, d, w) in zip(got, want, strict=True):
        assert r.id == i and int(r.deviation) == d
        np.testing.assert_allclose(np.abs(r.whitened), w, atol=1e-9)
        np.testing.assert_allclose(r.explained, explained[:8], rtol=1e-9)
    all_ = np.array([r.whitened for r in got])
    error = np.abs((all_ - all_.mean(0)).T @ (all_ - all_.mean(0)) / n - np.eye(8)).max()
    assert got[0].identity_error < 1e-9 and error < 1e-9 and len({r.identity_error for r in got}) == 1


def test_directions_without_spread_are_left_out(spark):
    make = lambda rows: whitening.whiten(spark, spark.createDataFrame(rows, SCHEMA))
    assert make([]).count() == 0 and make([(1, [1.0, 2.0], 0)]).count() == 0 and make([(i, [1.0, 2.0], 0) for i in range(9)]).count() == 0
    flat = make([(i, [i / 8, 1.0, i / 4, -i / 8], 0) for i in range(9)]).collect()
    assert {len(r.whitened) for r in flat} == {1} and len(flat) == 9 and abs(flat[0].explained[0] - 1) < 1e-12


def test_squares_beyond_64_bits_are_exact():
    z = np.array([[3_000_000_000, 4_000_000_000], [1, 2]])
    assert [int(d) for d in whitening._squares(z)] == [25 * 10**18, 5] and [int(d) for d in whitening._squares(z[1:])] == [5]


def test_the_registered_query(spark):
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{folder}/embeddings.parquet").to_pylist()
    n, deviation, white, explained = plain([(r["vec_id"], r["embedding"], 0) for r in rows])
    got = queries.op11_gramian_whitening(spark, folder).collect()
    assert len(got) == 8 * n
    at = {r["vec_id"]: i for i, r in enumerate(rows)}
    for r in got:
        i = at[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation[i]) and abs(abs(r.whitened) - white[i, r.component - 1]) < 1e-8 and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
