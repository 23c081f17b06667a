import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table from (doc_id, text) or (doc_id, text, source), with extra columns of clashing names."""

    def build(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        extra = ("size", "shard", "slot", "home", "hash", "row", "n", "score", "fingerprint", "component_id", "key", "copies",
                 "__id", "__at", "__row", "id", "root", "special", "seq", "number", "task", "text_hash")
        return df.selectExpr("*", *[f"'x' AS {name}" for name in extra])

    return build
