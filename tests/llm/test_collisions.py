import math

import numpy as np

from tripkit.llm import collisions, register

SCHEMA = "vec_id long, embedding array<double>, label int, number long, shard string, `id` string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 7, "", "") for i, v in rows], SCHEMA)


def slow(rows, every=20, top=20):
    """``{row number: [(score, id)]}`` of each query."""

    def sound(v):
        return bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)

    found = {}
    for q, (i, v) in enumerate(rows):
        if i is None or i % every or not sound(v):
            continue
        near = [
            (-float((np.array(w) * np.array(v)).sum()), j is None, j or 0)
            for r, (j, w) in enumerate(rows)
            if r != q and sound(w) and len(w) == len(v)
        ]
        found[q] = [(-s, None if no else j) for s, no, j in sorted(near)[:top]]
    return found


def results(frame):
    got = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return got


def test_odd_vectors_ties_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, [-1.0, 0.0]), (5, [3.0, 0.0]), (None, [1.0, 0.0]),
            (6, None), (7, []), (8, [0.0, 0.0]), (9, [nan, 1.0]), (10, [inf, 1.0]), (11, [None, 1.0]), (12, [1.0, 0.0, 0.0]), (20, [0.0, 1.0]),
            (40, [0.0, 0.0]), (60, None), (80, [1.0]), (-20, [2.0, 1.0])]
    got = results(collisions.nearest(table(spark, rows)))
    want = {rows[q][0]: near for q, near in slow(rows).items() if near}
    assert got == want and set(got) == {0, 20, -20}
    assert collisions.nearest(table(spark, [])).collect() == []
    assert collisions.nearest(table(spark, rows[1:4])).collect() == []


def test_repeated_rows_take_the_smallest_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(1, 120)] + [(200, [3.0, 2.0, 1.0]), (200, [3.0, 2.0, 1.0])]
    found = collisions.nearest(table(spark, rows), every=100, shard_rows=16, query_rows=1).collect()
    assert len(found) == 2 * 20 + 20  # two rows with id 200, and 100
    mine = sorted(r.vec_id for r in found if r.query_id == 100)
    assert mine == list(range(1, 21))
    assert sorted(r.vec_id for r in found if r.query_id == 200) == sorted([200, *range(1, 20)] * 2)


def test_recall_with_lengths_blocks_and_shards(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 1, (12, 24))
    vectors = centers[rng.integers(0, 12, 1500)] + rng.normal(0, 0.8, (1500, 24))
    vectors *= rng.uniform(0.2, 3, (1500, 1))  # the longest row is far from typical
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    want = {rows[q][0]: {j for _, j in near} for q, near in slow(rows).items()}
    for how in ({}, {"shard_rows": 200, "query_rows": 16}):
        got = results(collisions.nearest(table(spark, rows), **how))
        assert all(len(near) == 20 for near in got.values())
        assert sum(len(want[q] & {j for _, j in near}) for q, near in got.items()) >= 0.93 * 20 * len(want)


def test_shard_windows_are_ranges_of_sorted_arrays():
    rng = np.random.default_rng(6)
    rows = rng.normal(0, 1, (100, 5))
    shard = collisions.Shard(rows, 16)
    units = rows[:3] / np.linalg.norm(rows[:3], axis=1)[:, None]
    hashes, reach = shard.hashes(units), np.array([0.3, 1.0, 50.0])
    plain = shard.axes @ shard.lifted.T
    want = (np.abs(plain[None, :, :] - hashes[:, :, None]) <= reach[:, None, None]).sum(axis=1)
    assert (shard.counts(hashes, reach) == want).all() and (want[2] == 16).all()


def test_other_queries_are_no_candidates(spark):
    rows, asked = [(1, [1.0, 0.0]), (2, [0.0, 1.0])], [(7, [1.0, 0.1])]
    got = collisions.nearest(table(spark, rows), queries=table(spark, asked)).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(7, 1, 1, 1.0), (7, 2, 2, 0.1)]


def test_query_recall(spark):
    folder = "/root/testdata/sf0.1"
    source = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    vectors = {r.vec_id: np.array(r.embedding, float) for r in source}
    ids, every = np.array(list(vectors)), np.array(list(vectors.values()))
    found = register.queries()["op13_collision_search"](spark, folder).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append(r)
        assert abs(r.score - vectors[r.query_id] @ vectors[r.vec_id]) < 1e-12
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, near in got.items():
        scores = every @ vectors[q]
        scores[ids == q] = -9
        best = {int(ids[k]) for k in np.argsort(-scores)[:20]}
        near.sort(key=lambda r: r.rank)
        assert [r.rank for r in near] == list(range(1, 21))
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(near, near[1:], strict=False))
        hits += len(best & {r.vec_id for r in near})
    assert hits >= 0.93 * 20 * len(got)
