import random

import pytest
import xxhash

from lattica.llm import simhash


def brute_print(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(space, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[find(i)] = min(doc, smallest.get(find(i), doc))
    return sorted((d if d is not None else -1, f"{p:016x}", smallest.get(find(i), -1)) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))


def cases():
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(40):
        base = [rng.choice(vocabulary) for _ in range(120)]
        rows.append((10 * k + 5, " ".join(base)))
        for copy in range(4):
            changed = list(base)
            for _ in range(copy):
                changed[rng.randrange(120)] = rng.choice(vocabulary)
            rows.append((10 * k + copy, "\n".join(changed).upper()))
    short = [(1000 + k, t) for k, t in enumerate(["", None, " \t", "One", "one", "a b", "A  B", "a b c", "é É", "\x1cx y", "x\u00a0y z"])]
    return rows + short + [(2000, rows[0][1])] * 2 + [(None, rows[1][1]), (None, "alone and nameless here")]


def test_against_brute_force(spark, documents):
    rows = cases()
    out = simhash.near_duplicates(documents(rows)).collect()
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fingerprint"], r["component_id"] if r["component_id"] is not None else -1) for r in out)
    assert got == brute(rows)


@pytest.mark.parametrize("most", [20_000, 3])
def test_links_find_every_close_pair_once(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "SEGMENT_ROWS", most)
    rng = random.Random(8)
    values = set()
    for _ in range(30):
        value = rng.getrandbits(64)
        values.add(value)
        for _ in range(12):
            other = value
            for _ in range(rng.randrange(1, 5)):
                other ^= 1 << rng.randrange(64)
            values.add(other)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    got = [(r["a"], r["b"]) for r in simhash.links(df).collect()]
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("most", [200_000, 4])
def test_components_of_a_long_chain_and_a_star(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "HOT_ROWS", most)
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(900, 901)] + [(2000 + k, 1000) for k in range(50)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert roots == {**{k: 0 for k in range(301)}, 900: 900, 901: 900, 1000: 1000, **{2000 + k: 1000 for k in range(50)}}


def test_deduplicated_keeps_one_of_each_component(spark, documents):
    rows = cases()
    docs = documents(rows)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    groups = {}
    for doc, _, component in brute(rows):
        groups.setdefault(component, set()).add(doc)
    got = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect())
    assert got == sorted(groups)
    assert simhash.deduplicated(documents([])).count() == 0 and simhash.near_duplicates(documents([])).count() == 0


def test_long_text_counts_to_its_end():
    text = "a b c d " * 200_000
    assert simhash.fingerprint(text.encode()) == brute_print(text)


def test_deduplicated_keeps_each_text_of_a_repeated_id(spark, documents):
    a, b, c = (" ".join(f"{name}{k}" for k in range(60)) for name in "abc")
    rows = [(5, a), (5, b), (5, b.upper()), (2, c), (7, a), (8, b)]
    kept = sorted((r["doc_id"], r["text"].lower()) for r in simhash.deduplicated(documents(rows)).collect())
    assert kept == [(2, c), (5, a), (5, b)]
    rows = [(5, a), (5, b), (2, b.upper()), (9, c), (9, c)]
    kept = sorted((r["doc_id"], r["text"].lower()) for r in simhash.deduplicated(documents(rows)).collect())
    assert kept == [(2, b), (5, a), (9, c)]
    kept = simhash.deduplicated(documents([(None, a), (None, a.upper()), (None, b), (3, b)])).collect()
    assert sorted((r["doc_id"] or 0, r["text"].lower()) for r in kept) == [(0, a), (3, b)]
