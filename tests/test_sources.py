"""Sources, stacks, predictions and proofs on small literal rows."""

import hashlib
import random
import struct

from lattica.operators import code, proofs, stacks
from lattica.plans import ingest_queries
from lattica.sources import latex, markdown, repository

PAGE = """intro line
goes on

# One #

- a
- b [there](other.md) and [out](https://x.org)

### Deep

```py
# no heading
x = 1
```

## Two

> quoted
> twice

| a | b |
|---|---|

---

1. first [here](#one)

# Last
"""


def test_markdown_nests_by_heading_level(spark):
    docs = spark.createDataFrame([("d", PAGE), ("none", None), ("empty", "")], "doc string, text string")
    nodes = markdown.nodes(docs)
    rows = nodes.orderBy("position").collect()
    by_line = {r["id"]: r for r in rows}
    found = [(r["kind"], r["content"], by_line[r["parent_id"]]["content"] if r["parent_id"] in by_line else r["parent_id"]) for r in rows]
    assert found == [
        ("paragraph", "intro line goes on", "d"),
        ("heading", "One", "d"),
        ("list_item", "a", "One"),
        ("list_item", "b [there](other.md) and [out](https://x.org)", "One"),
        ("heading", "Deep", "One"),
        ("code_block", "# no heading\nx = 1", "Deep"),
        ("heading", "Two", "One"),
        ("block_quote", "quoted\ntwice", "Two"),
        ("table", "| a | b |\n|---|---|", "Two"),
        ("thematic_break", "---", "Two"),
        ("list_item", "first [here](#one)", "Two"),
        ("heading", "Last", "d"),
    ]
    assert [r["marker"] for r in rows if r["kind"] == "code_block"] == ["py"]
    assert [r["target"] for r in markdown.links(nodes).collect()] == ["other.md"]


LISTS = """# Lists

- a
  - b
    1. c
       - d
   - e
 - f
- g

      * h

after

10. ten
    - of ten
  - own
```
- code
```
"""


def test_markdown_nested_lists(spark):
    found = markdown.nodes(spark.createDataFrame([("n", LISTS), ("m", "- x\n\t- y\n\n---\n  - z\n"), ("o", None)], "doc string, text string"))
    plain = markdown.nodes(spark.createDataFrame([("p", "- x\n\nafter\n\n    - no item\n")], "doc string, text string")).collect()
    assert [(r["kind"], r["content"]) for r in plain] == [("list_item", "x"), ("paragraph", "after"), ("paragraph", "- no item")]
    rows = {(r["doc"], r["content"]): r for r in found.collect()}
    parent = {content: rows[doc, content]["parent_id"] for doc, content in rows if doc == "n"}
    at = lambda content, doc="n": rows[doc, content]["id"]
    assert parent["a"] == at("Lists") and parent["b"] == at("a") and parent["c"] == at("b") and parent["d"] == at("c")
    assert parent["e"] == at("a") and parent["f"] == parent["g"] == at("Lists") and parent["h"] == at("g")
    assert rows["n", "d"]["path"] == "n.0.2.3.4.5" and rows["n", "ten"]["kind"] == rows["n", "own"]["kind"] == "list_item"
    assert parent["of ten"] == at("ten") and parent["own"] == at("Lists") and rows["n", "- code"]["kind"] == "code_block"
    assert rows["m", "y"]["parent_id"] == at("x", "m") and rows["m", "z"]["parent_id"] == "m"
    again = markdown.nodes(markdown.reconstruct(found))
    shape = lambda rows: sorted((r["doc"], r["position"], r["kind"], r["content"], r["path"].count("."), r["indent"]) for r in rows.collect())
    assert shape(found) == shape(again)


def test_markdown_round_trip(spark):
    docs = spark.createDataFrame([("d", PAGE), ("e", "# A\r\n\r\n\r\ntext  \r\n## B")], "doc string, text string")
    first = markdown.nodes(docs)
    again = markdown.nodes(markdown.reconstruct(first))
    what = ["doc", "position", "kind", "content", "level", "marker"]
    assert sorted(map(str, first.select(what).collect())) == sorted(map(str, again.select(what).collect()))


def test_normalized(spark):
    cases = {"﻿a\r\nb  \n\n\n\nc": "a\nb\n\nc\n", "": "\n", "   \n  \n": "\n", "\n\nx\n\n": "x\n"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    got = [r[0] for r in rows.select(repository.normalized(rows["t"])).collect()]
    assert got == list(cases.values())


def test_languages_and_census(spark):
    rows = [
        ("r", "src/main.rs", b"fn main() {}\n"), ("r", "Makefile", b"all:\n\tcc\n"), ("r", "a.PNG", b"x"), ("r", "notes", b"a\nb"),
        ("r", "blob", b"a" * 8000 + b"\0"), ("r", "late", b"a" * 9000 + b"\0"), ("r", "x.yml", None),
    ]
    files = repository.files(spark.createDataFrame(rows, "repo string, path string, content binary"))
    got = {r["path"]: (r["kind"], r["language"], r["line_count"]) for r in files.collect()}
    assert got == {
        "src/main.rs": ("file", "rust", 1), "Makefile": ("repo_opaque_text", "make", 2), "a.PNG": ("repo_opaque_binary", None, 0),
        "notes": ("repo_opaque_text", "text", 2), "blob": ("repo_opaque_binary", None, 0), "late": ("repo_opaque_text", "text", 1),
        "x.yml": ("repo_opaque_text", "yaml", 0),
    }
    counts = {r["language"]: r["files"] for r in repository.census(files).collect()}
    assert counts == {"rust": 1, "make": 1, "binary": 2, "text": 2, "yaml": 1}


def test_latex(spark):
    text = r"\section*{A}\label{x} % \label{y}" + "\n" + r"\citep[see][p. 1]{k1, k2} \eqref{x} \ref{y} \begin{figure}"
    commands = latex.commands(spark.createDataFrame([(1, text)], "doc int, text string"))
    got = [(r["kind"], r["name"]) for r in commands.orderBy("position", "name").collect()]
    assert got == [("latex_section", "A"), ("latex_label", "x"), ("latex_cite", "k1"), ("latex_cite", "k2"), ("latex_ref", "x"),
                   ("latex_ref", "y"), ("latex_environment", "figure")]
    assert [(r[1], r[2]) for r in latex.reference_edges(commands).collect()] == [(3, 1)]


def test_stack_fold_against_replay(spark):
    rng = random.Random(3)
    log, held, taken = [], {}, []
    for seq in range(600):
        stack, op = rng.choice("abc"), rng.choices(["push", "pop", "drop", "replace", "clear"], [6, 3, 2, 3, 0.2])[0]
        log.append((stack, seq, op, f"v{seq}"))
        items = held.setdefault(stack, [])
        if op == "push":
            items.append(f"v{seq}")
        elif op == "clear":
            items.clear()
        elif items and op == "replace":
            items[-1] = f"v{seq}"
        elif items:
            taken.append((stack, seq, items.pop()))
    df = spark.createDataFrame(log, "stack string, seq int, op string, content string")
    got = sorted((r["stack"], r["position"], r["content"]) for r in stacks.items(df).collect())
    assert got == sorted((s, k + 1, v) for s, items in held.items() for k, v in enumerate(items))
    assert sorted(tuple(r) for r in stacks.popped(df).collect()) == sorted(taken)


def test_proofs(spark):
    rows = [("a.b", "kind", 3, 0.25), (None, "", -2, None), ("é", "x", 2**40, -1.5e300)]
    df = spark.createDataFrame(rows, "scope string, claim_type string, perspective_count long, avg_weight double")
    made = proofs.proven(df)
    for (scope, claim, count, weight), row in zip(rows, made.collect(), strict=True):
        want = ((scope or "") + claim).encode() + struct.pack("<q", count) + struct.pack("<d", weight or 0.0)
        assert row["proof_hex"] == hashlib.sha256(want).hexdigest()
    assert all(r["valid"] for r in proofs.verified(made).collect())
    tampered = made.withColumn("perspective_count", made["perspective_count"] + 1)
    assert not any(r["valid"] for r in proofs.verified(tampered).collect())


def test_naming_and_imports(spark):
    nodes = [(1, "fn", "goodName"), (2, "fn", "good_name"), (3, "struct", "bad_type"), (4, "const", "low"), (5, "fn", "_X"), (6, "fn", None)]
    found = code.naming_findings(spark.createDataFrame(nodes, "id int, kind string, content string"))
    assert sorted((r["id"], r["rule"]) for r in found.collect()) == [(1, "non_snake_fn"), (3, "non_camel_type"), (4, "non_upper_const")]
    lines = ["use crate::a;", "use serde::De;", "pub use std::fmt;", "use std :: fmt ;", "use super::b;"]
    rows = spark.createDataFrame([("f", k, s) for k, s in enumerate(lines)], "file string, position int, source string")
    got = [r["source"] for r in code.sorted_imports(rows).orderBy("place").collect()]
    assert got == ["pub use std::fmt;", "use serde::De;", "use crate::a;", "use super::b;"]


def test_discovery_finds_files_by_name_and_enters_no_skipped_folder(spark, tmp_path):
    root = tmp_path / "a repo+é"
    for path in ("src/main.rs", "src/a b%20+c/é.rs", "src/x.py", "src/targets/y.rs", "src/target/z.rs", "target/z.rs", ".git/z.rs", "src/.h.rs", "empty.rs"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("" if path == "empty.rs" else path)
    found = {r["path"]: bytes(r["content"]).decode() for r in repository.discovered(spark, str(root), "*.rs").collect()}
    assert found == {p: p for p in ("src/main.rs", "src/a b%20+c/é.rs", "src/targets/y.rs")}
    plan = repository.discovered(spark, str(root), "*.rs")
    kinds = repository.files(plan.selectExpr("'r' AS repo", "path", "content"))
    assert {r["kind"] for r in kinds.collect()} == {"file"}
    docs = {r["doc"]: r["text"] for r in latex.sources(plan).collect()}
    assert docs["src/main.rs"] == "src/main.rs"
    assert repository.discovered(spark, str(root), "*.go").count() == 0


def test_latex_references_of_a_source_need_no_shuffle(spark):
    texts = [(1, r"\label{x}\label{ x }\ref{x}\cref{y, x0}\label{x0}% \label{y}"), (2, r"\ref{x}\begin{z}\end{z}\cite{x}"), (3, ""), (4, r"100\% \label{a} \ref{a}")]
    docs = spark.createDataFrame(texts, "doc int, text string")
    found = latex.references(docs)
    assert sorted(map(tuple, found.collect())) == [(1, 2, 0), (1, 3, 4), (4, 1, 0)]
    assert sorted(map(tuple, latex.reference_edges(latex.commands(docs)).collect())) == [(1, 2, 0), (1, 3, 4), (4, 1, 0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Filter (((size" not in plan


def test_written_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ingest_queries, "TEXTS_PER_FILE", 10)
    docs = spark.range(100).selectExpr("concat('\\\\label{', id, '}') AS text").coalesce(1)
    found = ingest_queries._written_files(spark, docs, "bounded")
    assert found.count() == 10 and latex.commands(latex.sources(found)).count() == 100


def test_markdown_needs_no_shuffle_and_keeps_odd_lines(spark):
    text = "- a\n```\n# no\n\n~~~\n```py\nx\n```\n## h\n  1. n\n     - m\n> q\n>r\n* * *\n   # g\nt\n  u  "
    found = markdown.nodes(spark.createDataFrame([("a..b", text), ("e", None)], "doc string, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort " not in plan and plan.count("ArrowEvalPython") == 1
    rows = [(r["id"], r["kind"], r["content"], r["path"], r["marker"], r["indent"]) for r in found.orderBy("position").collect()]
    assert rows == [
        ("a..b#0", "list_item", "a", "a..b.0", "-", 0), ("a..b#1", "code_block", "# no\n", "a..b.1", "", 0), ("a..b#5", "code_block", "x", "a..b.5", "py", 0),
        ("a..b#8", "heading", "h", "a..b.8", None, 0), ("a..b#9", "list_item", "n", "a..b.8.9", "1.", 0), ("a..b#10", "list_item", "m", "a..b.8.9.10", "-", 3),
        ("a..b#11", "block_quote", "q\nr", "a..b.8.11", None, 0), ("a..b#13", "thematic_break", "* * *", "a..b.8.13", None, 0),
        ("a..b#14", "heading", "g", "a..b.14", None, 0), ("a..b#15", "paragraph", "t u", "a..b.14.15", None, 0),
    ]
