import corpus_pipeline
import numpy as np

from lattica.llm import mixing, simhash, toxicity
from tests.llm.test_decontamination import brute as brute_hits
from tests.llm.test_simhash import brute_print


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.train(docs, labels)
    grammar = toxicity.Grammar(model.stems)
    left = sorted(i for i, r in rows.items() if model.score_texts([r["text"]], grammar)[0] < toxicity.THRESHOLD)
    prints = {i: brute_print(rows[i]["text"]) for i in left}
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in left:
        for j in left:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3 and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    left = [i for i in left if find(i) == i]
    hits = brute_hits([(i, rows[i]["text"]) for i in left], [(r["item_id"], r["text"]) for r in benchmark.collect()])
    left = [i for i in left if not hits[i][4]]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.filter(docs.doc_id.isin(left))).collect()}

    out = corpus_pipeline.run(spark, d)
    assert out.columns == [*docs.columns, "home", "shard"]
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in copies.items() if v}
    assert np.ptp([r["shard"] for r in out.collect()]) <= 15


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), d)
        assert out.columns == docs.columns and out.count() == 0
    assert simhash.deduplicated(docs).columns == docs.columns
