import pytest
from llm_brute import SF

LONG = 60_000


def tricky_rows():
    """Null, empty, blank, very long, repeated and non-ASCII texts; null ids, sources and languages."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its files"
    return [
        (1, mit, "en", "a", 10), (2, mit, "en", "b", 10), (3, mit.upper(), "en", "a", 10), (3, mit.upper(), "en", "a", 10),
        (4, mit + " today", "en", None, 10), (5, None, None, None, None), (6, "", "en", "a", 0), (7, " \t\n\v\f\r ", "fr", "b", 7),
        (8, "one two", None, "é", 7), (9, "ONE two one TWO", "fr", "é", 7), (None, mit, "en", "a", 10), (None, "no id here", None, None, 1),
        (10, "word " * LONG, "en", "a", None), (11, "x" * 8_000, "en", "a", None), (12, "12 " * LONG, "de", "b", None),
        (13, "naïve 🙂 text with 𝔘nicode line and\x1cseparator <|endoftext|> end", "de", "c", 1),
        (14, "\n".join(["same line of words"] * 5 + ["", "  ", "other"]), "es", "c", 1),
        (15, 'password: "abc+def/123==" token=short Api_Key = \'Zz9_.=-/+x\' SECRET:=abcdefgh AKIAABCDEFGHIJKL12 ' + "0123456789abcdef" * 3, "en", "c", 1),
        (16, "mail a.b+c@d-e.org.uk, x@y, 10.0.0.256 10.0.0.255.1.2.3 4111 1111 1111 1111 4111-1111-1111-1112 +1 (234) 555-0199 +12345", "en", "c", 1),
        (17, "1.2.3.4.5.6.7.8 a@b.c%x@d.ee 00004111111111111111 +1.2.3.4.5.6.7.8.9", "en", "c", 1),
        (18, "12345 !!! ??? 678", "en", "c", 1), (19, "ß", "de", "c", 1),
    ]


#: Columns whose names the operators use inside.
CLASH = ["key", "n", "size", "kept", "x", "row", "token", "score", "n_words", "bucket", "spans", "near", "base", "host", "path", "c", "p", "lang_pred", "row_no", "term"]


@pytest.fixture(scope="session")
def tricky(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(tricky_rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return docs.select("*", *(F.lit(None).cast("string").alias(c) for c in CLASH))


@pytest.fixture(scope="session")
def empty(tricky):
    return tricky.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")

