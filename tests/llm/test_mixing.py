import duckdb
import numpy as np
import pytest

from lattica.llm import mixing
from lattica.llm.queries import ORACLE_SQL


def oracle(pdf):
    con = duckdb.connect()
    con.register("documents", pdf)
    return con.execute(ORACLE_SQL["op3_mixing"]).fetch_df()


def water_fill(sizes, cap=3):
    """Shares by weight with excess reshared, round by round."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + ([None] if None in sizes else [])
    weights = {n: k % 3 + 1 for k, n in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        total = sum(weights[n] for n in open_)
        over = [n for n in open_ if left * weights[n] / total > cap * sizes[n]]
        if not over:
            target |= {n: left * weights[n] / total for n in open_}
            break
        for n in over:
            target[n] = cap * sizes[n]
        left -= sum(cap * sizes[n] for n in over)
        open_ -= set(over)
    return target


def test_against_water_filling_and_sql(spark, documents):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 50)), rng.choice(["a", "b", "Z", "é", "hot", None], p=[0.01, 0.1, 0.1, 0.09, 0.6, 0.1])) for i in range(3000)]
    rows = [(i, t, None if s is None or s == "None" else str(s)) for i, t, s in rows]
    docs = documents(rows)
    out = mixing.mix(docs).toPandas()
    sizes = out.groupby("source", dropna=False)["size"].sum()
    sizes = {None if n != n else n: int(v) for n, v in sizes.items()}
    expected = water_fill(sizes)
    for source, group in out.groupby("source", dropna=False):
        name = None if source != source else source
        assert group.target.iloc[0] == pytest.approx(expected[name])
        assert abs(group.taken.sum() - expected[name]) <= group["size"].max() / 2 + 1e-6
    assert (out.taken <= 3 * out["size"]).all() and (out.copies >= 0).all()
    want = oracle(docs.toArrow())
    got = out.sort_values("doc_id").reset_index(drop=True)
    want = want.sort_values("doc_id").reset_index(drop=True)
    assert got.taken.tolist() == want.taken.tolist() and got.target.tolist() == want.target.tolist()


def test_nulls_repeated_rows_and_empty(spark, documents):
    rows = [(None, "a b", "x"), (None, None, "x"), (1, "a", "y"), (1, "a", "y"), (2, "", None), (3, "\t\x0b \n", None)]
    out = mixing.mix(documents(rows)).toPandas()
    assert len(out) == 6 and (out[out.source.isna()].target == 0).all()
    mixed = mixing.mixed_documents(documents(rows))
    assert mixed.count() == out.copies.sum() and len(mixed.columns) == len(documents(rows).columns)
    assert mixing.mix(documents([])).count() == 0
    assert mixing.mixed_documents(documents([])).count() == 0


def test_reruns_agree_whatever_the_partitions(spark, documents):
    docs = documents([(i, "w " * (i % 17), f"s{i % 5}") for i in range(500)])
    a = mixing.mix(docs).orderBy("doc_id").toPandas()
    b = mixing.mix(docs.repartition(7)).orderBy("doc_id").toPandas()
    assert a.equals(b)


def test_documents_are_repeated_as_the_mix_says(spark, documents):
    docs = documents([(i, "w " * (i % 17), f"s{min(3, i % 9)}") for i in range(400)])
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in copies.items() if v}


@pytest.mark.parametrize("block", [100_000, 64])
def test_null_ids_and_repeated_rows_come_near_the_targets(spark, documents, block, monkeypatch):
    monkeypatch.setattr(mixing, "NUMBERED_ROWS", block)
    rows = [(None, "w " * 4, "a") for i in range(500)] + [(i, "w " * 4, "b") for i in range(500)]
    rows += [(7, "w " * 4, "a")] * 300 + [(None, "v " * (1 + i % 5), "c") for i in range(300)]
    docs = documents(rows).repartition(6)
    out = mixing.mix(docs).toPandas()
    assert len(out) == len(rows)
    for _, group in out.groupby("source"):
        assert abs(group.taken.sum() - group.target.iloc[0]) <= group["size"].max() / 2 + 1e-6
    want = oracle(docs.toArrow())
    key = ["source", "doc_id", "size", "taken"]
    shown = [sorted(map(str, pdf[key].astype({"doc_id": "Int64"}).values.tolist())) for pdf in (out, want)]
    assert shown[0] == shown[1]
    mixed = mixing.mixed_documents(docs).groupBy("source").count().toPandas().set_index("source")["count"]
    assert mixed.to_dict() == out.groupby("source").copies.sum().to_dict()


def test_a_long_text(spark, documents):
    out = mixing.mix(documents([(1, "word " * 600_000, "a"), (2, "one", "b")])).toPandas().set_index("doc_id")
    assert out.loc[1, "size"] == 600_000 and out.loc[2, "copies"] == 3
