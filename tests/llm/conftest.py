import pytest
from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(70))


def awkward_rows():
    """Nulls in any column, empty and blank texts, a very long one, ties, repeated rows, texts that share passages."""
    texts = [
        "The quick brown fox.\nReleased under the MIT License.", "", None, "   \n\t ", LONG, f"head one {PASSAGE} tail one", f"other {PASSAGE} end", PASSAGE, "a", "a", "a b", "A B", "é ü ß 漢字 😀 x",
        'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', "mail joe.12@mail3.example.com card 4556123412341234 done", "THE!! END!! OF!! ALL!!", "one two three four five six seven eight nine ten",
        "one two three four five six seven eight nine ten eleven", "licensed under cc by nc 4.0", "under  the\nMIT-license",
    ]
    rows = [(i, t, "en", f"src{i % 4}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "src1", len(texts[5])), (None, "no id " + PASSAGE, None, None, None), (40, texts[0], "de", "src0", 1)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names of outputs and of columns that operators use inside.
CLASH = ("size", "shard", "score", "n_words", "id", "component", "component_id", "token", "tokens", "n_tokens", "key", "bin", "_id", "_text", "part", "copy", "h", "unit", "kept", "target", "labels", "fingerprint", "findings")


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="session")
def clashing(awkward):
    from pyspark.sql import functions as F

    return awkward.select("*", *(F.lit("clash").alias(c) for c in CLASH))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], T.StructType.fromDDL(SCHEMA))


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def same(a, b):
    """Equal rows in any order, columns by name."""
    assert a.schema.simpleString() == b.schema.simpleString()
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
