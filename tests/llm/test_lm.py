"""Language-model scores: counts and base scores against plain Python, the model as a distribution, held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import lm


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), "\n"]


def is_held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute_force(rows):
    counts = Counter(t for i, text in rows if not is_held_out(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        found = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in found)
        out.append((-1 if i is None else i, is_held_out(i), len(found), sum(counts[t] > 0 for t in found), n, base))
    return sorted(out)


def check(got, rows):
    want = brute_force(rows)
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], *list(r)[1:6]) for r in got)
    assert [f[:5] for f in found] == [w[:5] for w in want]
    assert np.allclose([f[5] for f in found], [w[5] for w in want], rtol=1e-12, atol=1e-9)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return [(r["doc_id"], r["text"]) for r in table.collect()], lm.scored(table).collect()


def test_counts_and_base_scores(found):
    rows, got = found
    check(got, rows)


def test_model_beats_counts_on_held_out_texts(found):
    held = [r for r in found[1] if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edge_cases(documents):
    ids = [i for i in range(40) if not is_held_out(i)]
    rows = [(ids[0], None), (ids[1], ""), (ids[2], " \t\n"), (None, "the cat"), (ids[3], "The CAT sat\x0bon thé MAT İ"), (ids[3], "the")]
    rows += [(ids[4], "cat\x00dog bird   x"), (ids[4], "cat\x00dog bird   x"), (2, "unseen words only")]
    check(lm.scored(documents(rows)).collect(), rows)
    assert lm.scored(documents([])).count() == 0


def test_all_held_out(documents):
    rows = [(None, "a b"), (None, None)]
    check(lm.scored(documents(rows)).collect(), rows)


def test_rare_tokens_are_joined(documents, monkeypatch):
    monkeypatch.setattr(lm, "COMMON", 3)  # nearly every token goes through the join
    rows = [(i, " ".join(f"w{k}" for k in range(i % 7, 30, 1 + i % 3))) for i in range(60)]
    check(lm.scored(documents(rows)).collect(), rows)


def test_pieces_of_long_texts(monkeypatch):
    texts = ["one Two  three " * 50, None, "x" * 500 + " y", "", "last"]
    whole = [p for p in lm.pieces(pa.array(texts))]
    monkeypatch.setattr(lm, "PIECE_BYTES", 40)
    parts = list(lm.pieces(pa.array(texts)))
    assert len(whole) == 1 and len(parts) > 10
    together = [(int(r), p.words[c]) for p in parts for r, c in zip(p.row, p.code, strict=True)]
    assert together == [(int(r), whole[0].words[c]) for r, c in zip(whole[0].row, whole[0].code, strict=True)]
    assert [w.decode() for r, w in together if r == 0] == tokens(texts[0])
    one, many = lm.Reader(12), lm.Reader(12)
    a = one.contexts(whole[0])
    b = [many.contexts(p) for p in parts]
    for name in ("first", "second", "first_rows", "second_rows"):
        assert (getattr(a, name) == np.concatenate([getattr(c, name) for c in b], axis=-1)).all()


def test_probabilities_add_up_to_one():
    """Over all subclasses after any context, and within a subclass over its known tokens and its unknown one."""
    rng = np.random.default_rng(0)
    counts = {f"w{k}".encode(): int(rng.integers(1, 50)) for k in range(500)}
    words = list(counts)
    leaf = lm.subclasses(words)
    held = np.bincount(leaf, weights=list(counts.values()), minlength=lm.CLASSES**2)
    types = np.bincount(leaf, minlength=lm.CLASSES**2)
    model = lm.untrained(held, types)
    model.weights = rng.normal(size=model.weights.shape).astype(np.float32)
    n = lm.CLASSES**2
    first, second = np.divmod(np.arange(n), lm.CLASSES)
    one, two = np.full(n, 12345, dtype=np.uint64), np.full(n, 678, dtype=np.uint64)
    cut = np.uint64(64 - model.bits)
    rows = np.stack([(r >> cut).astype(np.uint16) for r in (lm._mixed(1, one), lm._mixed(2, one, two), lm._mixed(3, two))])
    under = [lm._mixed(4, one, first), lm._mixed(5, one, two, first), lm._mixed(6, two, first)]
    under = np.stack([(r >> cut).astype(np.uint16) for r in under])
    logs = model.log10_subclass(lm.Contexts(first, second, rows, under))
    mass = np.array([sum(counts[w] + 1 for w, at in zip(words, leaf, strict=True) if at == k) + 1 for k in range(n)])
    assert math.isclose((10**logs * mass).sum(), 1, rel_tol=1e-5)


def test_gradient_steps_learn_a_sequence():
    words = [b"a", b"b", b"c", lm.END]
    code = np.tile([0, 1, 2, 3], 500)
    piece = lm.Piece(np.repeat(np.arange(500), 4), code, words)
    model = lm.untrained(np.bincount(lm.subclasses(words)[code], minlength=lm.CLASSES**2), np.bincount(lm.subclasses(words), minlength=lm.CLASSES**2))
    trainer = lm.Trainer(model)
    contexts = lm.Reader(model.bits).contexts(piece)
    before = model.log10_subclass(contexts).sum()
    for _ in range(20):
        trainer.learn(contexts)
    assert trainer.model.log10_subclass(contexts).sum() > before + 500
    assert not model.weights.any()  # the tasks' start is left as it is
