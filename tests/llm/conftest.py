import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    # names that operators use themselves
                    T.StructField("score", T.StringType()), T.StructField("__fp", T.StringType()),
                    T.StructField("a.b", T.StringType())])

WORDS = {"en": "the and of with that this house river walks under trees because nothing there",
         "de": "der und die nicht über schön haus fluss läuft unter bäumen weil dort straße",
         "fr": "le et les dans être où maison rivière marche sous arbres parce très là"}


def prose(lang: str, n: int, seed: int) -> str:
    import random

    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text, lang, source)"""
        return spark.createDataFrame([(*r, "s", "f", "ab") for r in rows], DOC)
    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Null ids, null, empty, blank and very long texts, repeated rows."""
    rows = [(i, prose(x, 30 + i, i), x, f"s{i % 3}") for i, x in enumerate(["en", "de", "fr"] * 14)]
    rows += [(100, None, "en", "s0"), (101, "", "en", None), (102, " \t\n ", None, "s1"), (103, "12 34 !!", "de", "s1"),
             (104, "a", None, None), (None, prose("en", 20, 1), "en", "s2"), (None, None, None, None),
             (105, prose("de", 30_000, 2), "de", "s2"), (106, "x" * 200_000, None, "s0"),
             (7, *rows[7][1:]), (7, *rows[7][1:])]
    return make_docs(rows)
