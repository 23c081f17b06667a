import math

import numpy as np

from lattica.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, cell long, vector string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)


def brute(rows, k=10):
    seen = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        seen[i] = np.array(v, dtype=np.float32).astype(float)
    out = {}
    for q, v in seen.items():
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in seen.items() if i != q)
            out[q] = near[:k]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    return out


def recall(got, want):
    return sum(len({i for _, i in got.get(q, [])} & {i for _, i in near}) for q, near in want.items()) / sum(map(len, want.values()))


def test_recall_order_and_scores(spark):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(1500, 16))
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    got, want = answers(ann.nearest(table(spark, rows))), brute(rows)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    for near in got.values():
        assert near == sorted(near) and len(near) == 10
    exact = {(q, i): s for q, near in want.items() for s, i in near}
    assert all(abs(exact.get((q, i), s) - s) < 1e-12 for q, near in got.items() for s, i in near)


def test_a_vector_that_a_third_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.normal(size=4).tolist()) for i in range(1200)]
    got, want = answers(ann.nearest(table(spark, rows))), brute(rows)
    for q in (0, 300, 600):
        assert got[q] == want[q]
    assert recall(got, want) >= 0.9


def test_rows_that_take_no_part_few_rows_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (100, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [None, 1.0]), (None, [1.0, 1.0]), (2, [0.0, 1.0]), (7, [1.0]), (8, [-0.0, 1.0])]
    got = answers(ann.nearest(table(spark, rows)))
    assert set(got) == {0} and [i for _, i in got[0]] == [1, 2, 8]
    assert ann.nearest(table(spark, [])).count() == 0
    assert ann.nearest(table(spark, [(0, [1.0])])).count() == 0
    one = answers(ann.nearest(table(spark, [(0, [1.0]), (1, [3.0]), (2, [2.0])])))
    assert [i for _, i in one[0]] == [2, 1]


def test_heap_yields_cells_by_summed_distance():
    rng = np.random.default_rng(2)
    a, b = rng.random(7), rng.random(5)
    order = list(ann.cells_by_distance(a, b))
    sums = [a[i] + b[j] for i, j in order]
    assert len(set(order)) == 35 and sums == sorted(sums)


def test_a_table_far_larger_than_the_sample(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_ROWS", 50)  # several chunks per block
    rng = np.random.default_rng(4)
    noise = rng.normal(size=(12_000, 16))
    points = np.where(rng.random(12_000)[:, None] < 0.5, noise, noise * 0.05 + rng.normal(size=(8, 16))[rng.integers(0, 8, 12_000)])
    points = points.astype(np.float32).astype(float)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    got = answers(ann.nearest(table(spark, rows), sample_rows=1000))
    want = {}
    for q in range(0, len(points), 100):
        far = np.sqrt(((points - points[q]) ** 2).sum(1))
        far[q] = np.inf
        want[q] = [(far[i], int(i)) for i in np.argsort(far, kind="stable")[:10]]
    assert set(got) == set(want) and recall(got, want) >= 0.9


def test_clustered_vectors_are_searched_by_a_small_share():
    rng = np.random.default_rng(5)
    sample = rng.normal(size=(400, 32))[rng.integers(0, 400, 20_000)] + rng.normal(size=(20_000, 32)) * 0.1
    assert ann.fit(sample, 1_000_000, 10).share < 0.05
