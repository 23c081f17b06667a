import hashlib
import random
import re

import pytest

from lattica.llm import decontamination as dc

NONE = dc.Bounds(windows=0)
ITEMS = "item_id long, text string, window string"


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, n=10):
    out = {}
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for window, of in windows.items():
            for s in range(len(w) - len(window) + 1):
                if tuple(w[s : s + len(window)]) == window:
                    hit |= set(range(s, s + len(window)))
                    found |= of
        names = ",".join(sorted(str(i) for i in found if i is not None))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


def cases():
    rng = random.Random(4)
    word = lambda: rng.choice(["ab", "cd", "Ef", "gh9", "ñu", "x"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 11, 14])))) for k in range(30)]
    items += [(40, None), (41, ""), (42, "!!"), (43, items[0][1])]
    docs = [(k, ", ".join(word() for _ in range(rng.randrange(60)))) for k in range(60)]
    for k in range(20):
        docs.append((100 + k, "intro words. " + (items[k][1] or "") + " and an end"))
    return docs + [(200, None), (201, ""), (202, "...")], items


def as_dict(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()}


def benchmark(spark, items):
    return spark.createDataFrame([(*i, "x") for i in items], ITEMS)


@pytest.mark.parametrize("most", [200_000, 2])
def test_against_brute_force_broadcast_and_joined(spark, documents, monkeypatch, most):
    monkeypatch.setattr(dc, "HOT_ROWS", most)
    docs, items = cases()
    want = brute(docs, items)
    assert as_dict(dc.report(documents(docs), benchmark(spark, items))) == want
    assert as_dict(dc.report(documents(docs), benchmark(spark, items), bounds=NONE)) == want


def test_empty_tables_and_repeats(spark, documents):
    docs, items = cases()
    assert not any(v[4] for v in as_dict(dc.report(documents(docs), benchmark(spark, []))).values())
    assert dc.report(documents([]), benchmark(spark, items)).count() == 0
    assert dc.report(documents([(1, "a"), (1, "a"), (None, "a")]), benchmark(spark, items)).count() == 3


def test_long_text_is_read_to_its_end(spark, documents):
    passage = " ".join(f"w{k}" for k in range(12))
    text = "filler " * 700_000 + passage
    out = as_dict(dc.report(documents([(1, text)]), benchmark(spark, [(5, passage)])))
    assert out[1][:3] == (700_012, 12, 1)


def test_removal_of_documents_and_spans(spark, documents):
    passage = " ".join(f"w{k}" for k in range(12))
    docs = documents([(1, f"before, {passage.upper()}! after"), (2, "clean; text\n"), (3, None)])
    items = benchmark(spark, [(5, passage)])
    kept = dc.decontaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    cut = {r["doc_id"]: r["text"] for r in dc.decontaminated(docs, items, spans=True).collect()}
    assert cut == {1: "before, ! after", 2: "clean; text\n", 3: None}


def test_removal_by_join_equals_removal_by_broadcast(spark, documents):
    docs, items = cases()
    docs, items = documents([*docs, docs[0]]), benchmark(spark, items)
    for spans in (False, True):
        near = dc.decontaminated(docs, items, spans=spans).collect()
        joined = dc.decontaminated(docs, items, spans=spans, bounds=NONE)
        assert joined.columns == docs.columns
        assert sorted(map(str, joined.collect())) == sorted(map(str, near))
        assert spans or 0 < len(near) < 80


def test_join_reads_long_texts(spark, documents):
    passage = " ".join(f"w{k}" for k in range(12))
    text = "filler " * 200_000 + passage
    out = as_dict(dc.report(documents([(1, text)]), benchmark(spark, [(5, passage)]), bounds=NONE))
    assert out[1][:3] == (200_012, 12, 1)


def test_items_beyond_the_bound_of_bytes_are_joined(spark, documents):
    docs, items = cases()
    items = items + [(90, "x" * 5000)]
    out = dc.report(documents(docs), benchmark(spark, items), bounds=dc.Bounds(bytes=4000))
    assert as_dict(out) == brute(docs, items)
