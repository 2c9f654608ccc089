import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; they must not care when the table has them, too.
CLASHES = ["id", "t", "key", "size", "fp", "root", "rep", "node", "text_hash", "component_id", "spans", "m", "leaf",
           "line", "docs", "keeper", "_key", "_size", "_going", "_stay", "doc", "score", "lang_pred", "n_words",
           "held_out", "x", "share", "length", "rank", "wanted", "anchor", "digest", "sig", "y"]


@pytest.fixture
def docs_of(spark):
    """A documents table of texts (or (id, text) pairs) with clashing extra columns."""
    def make(texts, lang=None, partitions=3):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in rows], SCHEMA)
        from pyspark.sql import functions as F
        return df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(partitions)
    return make


@pytest.fixture
def words():
    """Invented words, the same in every run."""
    rng = random.Random(11)
    syllables = ["ka", "lo", "mi", "ter", "an", "ö", "sh", "ru", "et", "qui"]
    vocabulary = sorted({"".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(600)})

    def make(n, seed):
        return random.Random(seed).choices(vocabulary, k=n)
    return make
