import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table: texts by position, or (doc_id, text, lang) rows; columns that clash come along."""

    def make(rows, extra: bool = False):
        full = [r if isinstance(r, tuple) else (i, r, None) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in full], DOCUMENTS)
        if extra:
            for name in ("id", "key", "n", "a", "b", "node", "component", "rep", "score", "words", "digest", "label"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make
