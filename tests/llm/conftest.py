import pytest
from pyspark.sql import functions as F

from lexicade.llm.stage import Stage, documents

FOLDER = "/root/testdata/sf0.001"
WORDS = "the quick brown fox jumps over a lazy dog and runs far away from it all "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names the operators use inside
CLASHING = ("row", "base", "spans", "chunk", "node", "toxicity", "_i", "_h", "_s", "_cut", "label", "half",
            "piece", "shard", "key", "part", "drawn", "doc", "seen", "bands", "text_hash", "class_id", "o0")


@pytest.fixture
def stage(spark):
    return Stage(spark)


def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    return [
        (900_001, None, None, None, None), (900_002, "", "en", "s", 0), (900_003, " \t\n ", "en", "s", 4),
        (900_004, "!!! ... ???", "en", "s", 11), (900_005, WORDS * 3, "en", "s", 1),
        (900_006, WORDS * 3, "en", "s", 1), (900_006, WORDS * 3, "en", "s", 1),
        (None, WORDS + "none", "en", "s", 1), (None, None, None, None, None),
        (900_007, WORDS * 2000, "en", "s", 1), (900_008, "7" * 30_000, "en", "s", 1),
        (900_009, "x", "en", "s", 1), (900_010, "é日本 ß́ 𝒳 a" * 3, "en", "s", 1),
    ]


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest given documents and odd rows, with columns of clashing names."""
    docs = documents(spark, FOLDER).select(*[c.split()[0] for c in SCHEMA.split(", ")])
    docs = docs.union(spark.createDataFrame(odd_rows(), SCHEMA))
    return docs.withColumns({c: F.lit("clash") for c in CLASHING}).persist()


@pytest.fixture(scope="session")
def rows(corpus):
    return [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
