import duckdb
import numpy as np
import pytest

from verdigris.llm import cover_tree, curve_neighbours


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    centre = rng.standard_normal((20, 16))
    x = np.concatenate([centre[rng.integers(0, 20, 500)] + rng.standard_normal((500, 16)) * rng.choice([0.02, 0.2, 0.0], (500, 1)), rng.standard_normal((200, 16))])
    return x.astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, block int, vector int")


def unit(x):
    x = x.astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links(x, threshold=0.95):
    """(class, links) of each row by brute force."""
    near = unit(x) @ unit(x).T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            return {(i, int(c), int(n)) for i, (c, n) in enumerate(zip(label, near.sum(axis=1)))}
        label = new


@pytest.mark.parametrize("block", [40, 300, 5000])
def test_all_links_are_found(spark, vectors, block):
    found = cover_tree.linked_embeddings(frame(spark, enumerate(vectors.tolist())), block=block).collect()
    assert len(found) == len(vectors) and {tuple(r) for r in found} == links(vectors)


def test_low_threshold_links_are_found(spark, vectors):
    found = cover_tree.linked_embeddings(frame(spark, enumerate(vectors.tolist())), 0.5, 100).collect()
    assert {tuple(r) for r in found} == links(vectors, 0.5)


def test_cover_tree_covers(vectors):
    x = unit(vectors).astype(np.float32)
    tree = cover_tree.cover_tree(x)
    assert sorted(tree.order) == list(range(len(x)))
    y = x[tree.order]
    levels = 0
    for lo, hi, radius, parent, kids in zip(tree.lo, tree.hi, tree.radius, tree.parent, tree.many):
        assert np.linalg.norm(y[lo:hi] - y[lo], axis=1).max() <= radius + 2e-3
        if parent >= 0:
            assert tree.lo[parent] <= lo and hi <= tree.hi[parent] and radius <= tree.radius[parent] / 2 + 2e-3
        if kids:
            levels += 1
            own = tree.open(np.array([np.flatnonzero((tree.lo == lo) & (tree.hi == hi))[0]]))
            assert tree.hi[own].max() == hi and (tree.hi - tree.lo)[own].sum() == hi - lo
            # Centres are a net: none lies within half the radius of another.
            d = np.linalg.norm(y[tree.lo[own]][:, None] - y[tree.lo[own]][None], axis=2) + 9 * np.eye(len(own))
            assert d.min() > radius / 2 - 2e-3
    assert levels > 20


@pytest.mark.parametrize("every, scan, queries", [(1, 16384, 32768), (50, 16384, 32768), (3, 64, 40)])
def test_neighbours_match_brute_force(spark, vectors, monkeypatch, every, scan, queries):
    monkeypatch.setattr(curve_neighbours, "SCAN_BLOCK", scan)
    monkeypatch.setattr(curve_neighbours, "QUERIES", queries)
    s = np.round(unit(vectors) @ unit(vectors).T, 9)
    np.fill_diagonal(s, -9)
    rows = curve_neighbours.nearest(frame(spark, enumerate(vectors.tolist())), every=every).collect()
    got = {(r["vec_id"], r["rank"]): r["neighbour_id"] for r in rows}
    want = {}
    for i in range(0, len(s), every):
        order = np.lexsort((np.arange(len(s)), -s[i]))[:10]
        want |= {(i, k + 1): int(j) for k, j in enumerate(order)}
    assert np.mean([got.get(k) == v for k, v in want.items()]) > 0.999 and len(got) == len(want)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [1.0, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [2.0, 0.0])]
    df = frame(spark, rows)
    assert {tuple(r) for r in cover_tree.linked_embeddings(df).collect()} == {(1, 1, 2), (2, 1, 2), (8, 8, 0), (9, 1, 2)}
    near = sorted((r["vec_id"], r["rank"], r["neighbour_id"]) for r in curve_neighbours.nearest(df, every=1).collect())
    assert near == [(1, 1, 9), (1, 2, 2), (2, 1, 1), (2, 2, 9), (9, 1, 1), (9, 2, 2)]
    assert cover_tree.linked_embeddings(frame(spark, [])).count() == 0
    assert curve_neighbours.nearest(frame(spark, [])).count() == 0


def test_planted_close_pairs_match_the_sql(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 64))
    x = np.concatenate([x, x[:60] + rng.standard_normal((60, 64)) * rng.choice([0.05, 0.2, 0.3, 0.4], (60, 1))]).astype(np.float32)
    frame(spark, enumerate(x.tolist())).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = set(con.execute(cover_tree.oracle()).fetchall())
    rows = cover_tree.op9_cover_tree_pairs(spark, str(tmp_path)).collect()
    assert 20 < sum(n > 0 for _, _, n in want) < 120 and {tuple(r) for r in rows} == want


def test_a_group_of_copies_costs_rows_in_proportion(spark):
    """A third of all vectors are copies, another third near copies; no pair is written out."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 16))
    x[:1000] = x[0]
    x[1000:2000] = x[1000] + 0.02 * rng.standard_normal((1000, 16))
    found = cover_tree.linked_embeddings(frame(spark, enumerate(x.astype(np.float32).tolist())), block=256).collect()
    assert {tuple(r) for r in found} == links(x.astype(np.float32))


def test_windows_alone_find_what_lies_near_few_dimensions(spark):
    rng = np.random.default_rng(4)
    x = np.zeros((6000, 64))
    x[:, :4] = rng.standard_normal((6000, 4))
    x += 0.01 * rng.standard_normal(x.shape)
    s = unit(x.astype(np.float32)) @ unit(x.astype(np.float32)).T
    np.fill_diagonal(s, -9)
    found = curve_neighbours.nearest(frame(spark, enumerate(x.astype(np.float32).tolist())), windows_only=True).collect()
    hits = sum(r["neighbour_id"] in np.argsort(-s[r["vec_id"]])[:10] for r in found)
    assert hits / (120 * 10) >= 0.9


def test_what_travels_doesnt_grow_with_the_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(cover_tree, "LEAST_GROUPS", 4)
    rows = spark.sparkContext.accumulator(0)
    meet = cover_tree._meet

    def counted(threshold):
        run = meet(threshold)

        def count(t):
            rows.add(t.num_rows)
            return run(t)

        return count

    monkeypatch.setattr(cover_tree, "_meet", counted)
    got = {r["vec_id"]: r for r in cover_tree.linked_embeddings(table, 0.4, 16).collect()}
    linked = x @ x.T >= 0.4
    np.fill_diagonal(linked, False)
    assert {k: r["n_links"] for k, r in got.items()} == dict(enumerate(linked.sum(axis=1).tolist()))
    # 40 parts and more, which all meet: each vector goes to 4 pairs of groups.
    assert rows.value <= 600 * 4
