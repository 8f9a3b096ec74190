import numpy as np

from trailgraph.llm import vectors


def brute(rows, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    size = max((len(v) for _, v in good), default=1)
    x = np.array([np.pad(v, (0, size - len(v))) for _, v in good]).reshape(-1, size)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.array([i for i, _ in good])
    while True:
        new = np.array([min([label[k], *label[near[k]]]) for k in range(len(label))])
        if (new == label).all():
            break
        label = new
    out = {i: (int(n), int(c)) for (i, _), n, c in zip(good, near.sum(axis=1), label, strict=True)}
    return out | {i: (0, i) for i, _ in rows if i not in out}


def check(spark, rows, kind="FLOAT", **kw):
    df = spark.createDataFrame(rows, f"vec_id BIGINT, embedding ARRAY<{kind}>")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    out = vectors.near(df, **kw).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["n_links"], r["component_id"]) == want[r["vec_id"]] and r["kept"] == (r["vec_id"] == r["component_id"])


def test_random_clusters_copies_and_bad_vectors(spark, odd):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(25, 40))
    rows = [centres[k % 25] + rng.normal(size=40) * rng.choice([0.05, 0.15, 0.5]) for k in range(400)]
    rows += [rows[0]] * 30 + [rows[1] * 7.5]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 40), (n + 3, [float("nan")] + [1.0] * 39), (n + 4, [float("inf")] * 40), (n + 5, [None] * 40), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0])]
    check(spark, rows)
    check(spark, rows, block=60)


def test_pruned_tiles_equal_the_product():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 64))
    x = np.concatenate([base, base + 0.2 * rng.normal(size=(60, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    i, j = vectors.tile_links(x, x, x @ q, x @ q, 0.95)
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == set(zip(*(a.tolist() for a in np.nonzero(x @ x.T >= 0.95)), strict=True))


def test_empty(spark):
    empty = spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert vectors.near(empty).count() == 0


def test_the_smallest_and_largest_numbers(spark):
    """Norms that would under- or overflow change neither their own links nor those of others."""
    rows = [(1, [1.0, 0.0]), (2, [0.99, 0.1]), (3, [1e-200, 1e-200]), (4, [1e200, 1e200]), (5, [5e-324, 5e-324]), (6, [1.7e308, 1.7e308]), (7, [1.7e308, 5e-324]), (8, [0.0, -1e-320])]
    check(spark, rows, "DOUBLE")
    check(spark, rows, "DOUBLE", block=2)
    links = {r["vec_id"]: r["n_links"] for r in vectors.near(spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")).collect()}
    assert links == {1: 2, 2: 2, 3: 3, 4: 3, 5: 3, 6: 3, 7: 2, 8: 0}


def test_rows_of_one_id_are_nodes_by_their_own_vectors(spark):
    """Held against the links and components of rows, counted plainly: an id's vectors, near and far, don't join each other."""
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2, 16))
    rows = [(1, a), (5, a + 0.01), (5, b), (7, b + 0.01), (7, a), (9, -a), (9, -a)]
    x = np.array([v / np.linalg.norm(v) for _, v in rows])
    close = x @ x.T >= 0.95
    reach = np.linalg.matrix_power(close.astype(int), len(rows)) > 0
    ids = np.array([i for i, _ in rows])
    want = sorted((int(i), int(close[k].sum()) - 1, int(ids[reach[k]].min())) for k, i in enumerate(ids))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id LONG, embedding ARRAY<DOUBLE>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near(df).collect())
    assert got == want and (5, 1, 5) in want and (5, 2, 1) in want
