import math
import re
from collections import Counter

import numpy as np
import pytest

from lattica.llm import urls

SCHEMA = "page_id long, url string, html string, host string, label string, rate string"


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [n + p for _, n, p in urls.RULES if (host == n or host.endswith("." + n)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


CASES = [
    None, "", "nothing", "http://", "http://A.NET/x?y#z", "http://example.net/en/1", "http://m.example.net/en/", "http://example.net/en",
    "https://example.com/de/1", "https://xexample.com/de/1", "https://a.example.com/de", "ftp://x.org/fr/?q", "http://org/fr/", "http://xorg/fr/",
    "a://b://c.net/p", "http://net", "http://net/", "http://x.net?a=1", "http://ü.net/\nx", "http://u:p@h.net:80/x", "http://b.example.com/",
]


def test_hosts_paths_and_rules(spark):
    rows = [(k, u, None, "x", "y", "z") for k, u in enumerate(CASES)]
    out = {r["page_id"]: r for r in urls.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == len(CASES)
    verdicts = {n + p: d for d, n, p in urls.RULES}
    for k, url in enumerate(CASES):
        assert (out[k]["host"], out[k]["path"], out[k]["rule"]) == brute(url), url
        assert out[k]["verdict"] in ("allow", "block")
        if out[k]["rule"]:
            assert out[k]["verdict"] == verdicts[out[k]["rule"]]


def test_empty_table_repeats_and_one_label(spark):
    assert urls.judged(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "http://a.net/x", None, "", "", "")] * 2 + [(None, "http://q.io/", None, "", "", "")]
    assert urls.judged(spark.createDataFrame(rows, SCHEMA)).count() == 3


def test_trees_learn_lexical_differences(spark):
    good = [(f"http://site{k}.org/about/page", 0.0) for k in range(200)]
    bad = [(f"http://x{k * 7919}-9{k}.org/p?a={k}&b={k}&c=77{k}", 1.0) for k in range(200)]
    rows = spark.createDataFrame(good + bad, "url string, label double")
    rows = rows.withColumns({"host": urls.host(rows["url"]), "path": urls.path(rows["url"])})
    train, test = rows.filter("length(url) % 2 = 0"), rows.filter("length(url) % 2 = 1")
    scored = urls.train(train).score(test).toPandas()
    assert ((scored.blocked > 0.5) == (scored.label == 1)).mean() > 0.95


def test_entropy_against_counting_and_long_urls(spark):
    texts = ["", "a", "aab", "http://x.org/ab?c=1&d=2", "é" * 9 + "f" * 3, "http://long.org/" + "xyz0" * 200_000]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "url string")
    rows = rows.withColumns({"host": urls.host(rows["url"]), "path": urls.path(rows["url"])})
    got = [r["f_entropy"] for r in urls.lexical(rows).select("f_entropy").collect()]
    for text, value in zip([*texts, ""], got, strict=True):
        counts = Counter(text).values()
        assert value == pytest.approx(-sum(n / len(text) * math.log2(n / len(text)) for n in counts))
    pages = spark.createDataFrame([(1, texts[-1], None, "", "", ""), (2, "http://a.net/x", None, "", "", "")], SCHEMA)
    assert {r["page_id"]: r["host"] for r in urls.judged(pages).collect()} == {1: "long.org", 2: "a.net"}


def test_a_training_url_does_not_see_its_own_label(spark):
    rows = [(f"http://h.s{k}/x", f"h.s{k}", "/x", float(k % 2)) for k in range(40)]
    train = spark.createDataFrame(rows, "url string, host string, path string, label double")
    features = urls._training_features(train, 0.5).collect()
    place = urls.FEATURES.index("f_suffix_rate_2")
    assert len(features) == 40 and {round(float(r["features"][place]), 6) for r in features} == {0.5}


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    for value in np.unique(scores):
        ranks[scores == value] = ranks[scores == value].mean()
    good = labels.sum()
    return (ranks[labels == 1].sum() - good * (good + 1) / 2) / (good * (len(labels) - good))


def test_held_out_urls_are_judged_well(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    rows = pages.withColumns({"host": urls.host(pages["url"]), "path": urls.path(pages["url"])})
    rule, verdict = urls.rule_columns()
    rows = rows.withColumns({"rule": rule, "verdict": verdict}).filter("rule IS NOT NULL")
    rows = rows.selectExpr("url", "host", "path", "double(verdict = 'block') AS label", "pmod(xxhash64(url, 1), 4) = 0 AS held")
    scored = urls.train(rows.filter("NOT held")).score(rows.filter("held")).toPandas()
    print("held out", len(scored), "AUC", auc(scored.blocked.to_numpy(), scored.label.to_numpy()))
    assert auc(scored.blocked.to_numpy(), scored.label.to_numpy()) > 0.7
