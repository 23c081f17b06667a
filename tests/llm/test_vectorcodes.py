"""Vector codes against plain integer arithmetic over all entries."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from lattica.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, x string, key string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "c", "x", "k") for r in rows], SCHEMA)


def brute_force(rows, entries=256, rounds=4):
    good = [(i, v, label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, [math.floor(1024 * c) for c in v], label) for i, v, label in good]
    width = len(x[0][1])
    ends = [width * k // 4 for k in range(5)]
    first = sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[a:b] for _, v, _ in first] for a, b in zip(ends, ends[1:], strict=False)]

    def nearest(part, book):
        return min((sum((p - q) ** 2 for p, q in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            held = defaultdict(list)
            for _, v, _ in x:
                held[nearest(v[a:b], books[p])[1]].append(v[a:b])
            books[p] = [
                [sum(c) // len(held[k]) for c in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(books[p])
            ]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out, sums = [], defaultdict(int)
    for i, v, label in x:
        found = [nearest(v[a:b], book) for (a, b), book in zip(zip(ends, ends[1:], strict=False), books, strict=True)]
        error = sum(d for d, _ in found)
        sums[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    return sorted((i or -1, code, error, sums[label], sha) for i, code, error, label in out)


def found(df):
    return sorted((r["vec_id"] or -1, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def test_against_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(300)
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    assert found(vectorcodes.codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))) == brute_force(rows)


def test_edge_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=9)], i % 3 if i % 5 else None) for i in range(400)]
    rows += [(1000, None, 1), (1001, [1.0] * 8 + [None], 1), (1002, [float("nan")] * 9, 1), (1003, [float("-inf")] * 9, 1)]
    rows += [rows[7], (7, rows[9][1], 2), (None, rows[4][1], None), (2000, rows[4][1], 1)]
    assert found(vectorcodes.codes(vectors(spark, rows))) == brute_force(rows)  # 9 isn't divided by 4, ids repeat


def test_ties_few_rows_and_empty(spark):
    rows = [(i, [float(i % 2)] * 4, 1) for i in range(6)]
    got = found(vectorcodes.codes(vectors(spark, rows)))
    assert got == brute_force(rows)
    assert {g[1] for g in got} == {"00000000", "01010101"}  # the lower number of equal entries
    assert found(vectorcodes.codes(vectors(spark, [(5, [1.0, 2.0, 3.0], None)]))) == brute_force([(5, [1.0, 2.0, 3.0], None)])
    assert vectorcodes.codes(vectors(spark, [])).count() == 0
    assert [g[1:4] for g in found(vectorcodes.codes(vectors(spark, [(1, [], 3)])))] == [("00000000", 0, 0)]


def test_large_components(spark):
    rows = [(i, [1e12 * i, -1e12, float(i), 0.5], 1) for i in range(1, 5)]
    got = found(vectorcodes.codes(vectors(spark, rows)))
    assert [g[:3] for g in got] == [g[:3] for g in brute_force(rows)]
    far = [(i, [3e300 * (i % 2), 0.0, 0.0, 0.0], 1) for i in range(300)]
    assert vectorcodes.codes(vectors(spark, far)).count() == 300


def test_lengths_have_their_own_codebooks(spark):
    rng = np.random.default_rng(2)
    eight = [(i, [float(c) for c in rng.normal(size=8)], 1) for i in range(30)]
    four = [(i, [float(c) for c in rng.normal(size=4)], 2) for i in range(100, 130)]
    assert found(vectorcodes.codes(vectors(spark, eight + four))) == sorted(brute_force(eight) + brute_force(four))


@pytest.mark.parametrize("bits", [1, 4])
def test_va_file(bits):
    rng = np.random.default_rng(bits)
    entries = rng.integers(-900, 900, size=(200, 16))
    rows = np.concatenate([rng.integers(-1000, 1000, size=(300, 16)), entries[:50]])
    exact = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    file = vectorcodes.VAFile(entries, bits)
    lower, upper = file.bounds(rows)
    assert (lower <= exact).all() and (exact <= upper).all()
    entry, distance = file.nearest(rows)
    assert (entry == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    if bits == 4:
        assert (lower <= upper.min(axis=1)[:, None]).mean() < 0.5  # most entries are never compared
