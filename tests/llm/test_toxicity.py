import zlib

from lattica.llm import toxicity as tx

LABELS = "doc_id long, quality int, toxic int"


def named(text, stems=()):
    return dict(zip(tx.MATCHES, tx.Grammar(stems).matches(text), strict=True))


def test_clauses():
    assert named("What an idiot")["plain"] == 1
    assert named("you are such a MORON!")["targeted"] == 1
    assert named("he is not an idiot")["negated"] == 1
    assert named("they said the idiot left")["reported"] == 1
    assert named("I will hurt you")["threat"] == 1
    assert named("I will not hurt. You may go")["threat"] == 0  # the clause ends before the target
    assert named("She said so. An idiot came")["plain"] == 1  # nor does the report reach over
    assert sum(named("a clowns' idiotic parade").values()) == 0 and sum(named("").values()) == sum(named(None).values()) == 0


def test_negation_and_report_act_on_threats_and_targets_stand_on_both_sides():
    assert named("I will not hurt you") == {"plain": 0, "targeted": 0, "negated": 1, "reported": 0, "threat": 0}
    assert named("he said he will kill you") == {"plain": 0, "targeted": 0, "negated": 0, "reported": 1, "threat": 0}
    assert named("he isn\u2019t an idiot")["negated"] == 1 and named("he isn\u2019t an idiot")["targeted"] == 0
    assert named("an idiot, you are")["targeted"] == 1 and named("an idiot. You are")["plain"] == 1
    assert named("idiot, I will kill you") == {"plain": 0, "targeted": 1, "negated": 0, "reported": 0, "threat": 1}


def brute(text):
    """The matches by looking at each word's surroundings."""
    classes = {w: c for c, ws in zip("ITYNR", (tx.INSULTS, tx.THREATS, tx.TARGETS, tx.NEGATIONS, tx.REPORTS), strict=True) for w in ws}
    found = dict.fromkeys(tx.MATCHES, 0)
    for clause in text.split("."):
        names = [classes.get(w, "W") for w in clause.split()]
        negated, kinds = set(), []
        for k, name in enumerate(names):
            near = [j for j in range(max(0, k - tx.REACH), k) if names[j] == "N"]
            if name in "IT" and near:
                negated.add(k)
        for k, name in enumerate(names):
            if name not in "IT":
                kinds.append(name)
            elif k in negated:
                kinds.append("negated")
            else:
                kinds.append("reported" if "R" in names[:k] else name)
        used = set()
        for k, kind in enumerate(kinds):
            if kind == "I":
                found["targeted" if "Y" in kinds else "plain"] += 1
            elif kind in ("negated", "reported"):
                found[kind] += 1
            elif kind == "Y":
                before = [j for j in range(max(0, k - tx.REACH), k) if kinds[j] == "T" and j not in used]
                if before:
                    found["threat"] += 1
                    used |= set(range(k))
    return found


def test_grammar_against_brute_force():
    import random

    rng = random.Random(12)
    pool = ["idiot", "moron", "kill", "hurt", "you", "she", "not", "never", "said", "word", "more", ".", "xx"]
    for _ in range(20_000):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))
        assert named(text) == brute(text), text


def test_negated_and_reported_matches_never_raise_a_score():
    import numpy as np

    rng = np.random.default_rng(2)
    m = rng.integers(0, 3, size=(400, 5)).astype(float)
    labels = (m.sum(1) > 4).astype(float)  # labels that would raise them
    weights = tx.fit_weights(m, labels)
    assert weights[3] <= 0 and weights[4] <= 0 and weights[1] > 0
    free = tx.fit_weights(m, (m[:, 0] > 1).astype(float))
    assert free[3] <= 0 and np.isfinite(free).all()


def test_one_threat_or_targeted_insult_is_enough_whatever_the_labels():
    import numpy as np

    rng = np.random.default_rng(3)
    m = np.zeros((500, 5))
    m[:, 0] = rng.integers(0, 3, 500)  # labels that know plain insults only, and clean documents with targets
    m[:100, 1] = 1
    labels = (m[:, 0] > 0).astype(float)
    weights = tx.fit_weights(m, labels)
    model = tx.ToxicityModel((), weights)
    assert weights[2] >= weights[1]
    assert (model.score_texts(["I will kill you", "You are an idiot.", "kill yourself"], tx.Grammar()) >= tx.THRESHOLD).all()
    assert (model.score_texts(["fine", "he said you are an idiot", "not an idiot", None], tx.Grammar()) < tx.THRESHOLD).all()


def test_whole_scores_against_brute_force(spark, documents):
    """Learned weights over the brute-force matches give the scores of the query."""
    import math

    texts = ["you idiot", "kill him", "never kill him. moron", "she said idiot you", "idiot word moron you hurt she", "word", "", None]
    rows = [(k, texts[k % len(texts)]) for k in range(400)]
    docs = documents(rows)
    labels = spark.createDataFrame([(k, 1, int(k % len(texts) in (0, 1, 4))) for k in range(400)], LABELS)
    model = tx.train(docs, labels)
    assert model.stems == ()  # every toxic document has a known match
    for row in tx.scored(docs, labels).collect():
        found = brute(rows[row["doc_id"]][1] or "")
        logit = model.weights[0] + sum(w * math.log1p(found[name]) for w, name in zip(model.weights[1:], tx.MATCHES, strict=True))
        assert math.isclose(row["score"], 1 / (1 + math.exp(-logit)), rel_tol=1e-9)
        assert row["predicted"] == int(row["score"] >= tx.THRESHOLD)


def test_the_sample_has_at_most_its_rows_however_often_documents_repeat(spark, documents):
    docs = documents([(k, f"text {k} {j}") for k in range(40) for j in range(50)])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)], LABELS)
    sample = tx._sample(docs, labels, 10).collect()
    assert len(sample) == 10 and all(r["text"].endswith(" 0") for r in sample)


def test_stems():
    assert named("lowe lowei loweixy", ("lowei",))["plain"] == 2
    assert named("achlich one", ("2achlich",))["plain"] == 0
    assert named("achlichx one. achlichy two, achlich", ("2achlich",))["plain"] == 2
    assert named("word words", ("=word",))["plain"] == 1


def test_composition_equals_the_machines_one_after_the_other():
    import itertools

    parts = [tx.negation(), tx.reported(), tx.targeted(), tx.threatening()]
    grammar = tx.clause_grammar()
    for symbols in itertools.product("ITYNRW", repeat=5):
        out = list(symbols)
        for part in parts:
            out = part.run(out)
        assert grammar.run(symbols) == out


def test_held_out_ids_are_never_learned_from(spark, documents):
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 == 1][:60]
    docs = documents([(i, "plain words zzkrat zzkrat here") for i in ids])
    labels = spark.createDataFrame([(i, 1, 1) for i in ids], LABELS)
    assert tx.train(docs, labels).stems == ()
    assert tx.scored(docs, labels).filter("held_out AND predicted = 0").count() == 60


def test_accuracy_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = tx.scored(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((out.predicted == 1) & (out.toxic == 0)).sum() <= 1
    assert out[out.toxic == 1].predicted.mean() >= 0.8
    assert out.score.between(0, 1).all()


def test_nulls_empties_repeats_and_missing_labels(spark, documents):
    docs = documents([(None, "you idiot"), (1, None), (2, ""), (3, "fine"), (3, "fine"), (4, "ok " * 300_000 + "you idiot you moron")])
    nothing = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (3, 0, 0), (3, 0, 1)], LABELS)
    for labels in (nothing, odd):
        out = tx.scored(docs, labels).toPandas()
        assert len(out) == 6 and out.score.between(0, 1).all()
        assert out[out.doc_id.isna()].held_out.all() and out[out.doc_id == 4].predicted.tolist() == [1]
        assert tx.scored(documents([]), labels).count() == 0
    kept = tx.accepted(docs, nothing)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "3", "None"]  # one insult is under the threshold
