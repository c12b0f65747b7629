import random

import pytest

DATA = "/root/testdata"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def small(spark):
    """The documents of the smallest table, as a DataFrame and as a list of (doc_id, text)."""
    df = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    return df, [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, very long and repeated texts, repeated rows, clashing extra columns."""
    r = random.Random(5)
    long = " ".join(r.choice(["the", "mit", "license", "cc", "by", "ça", "öl"]) for _ in range(60_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "src0", 0),
        (3, long, "en", "src1", len(long)),
        (4, long, "fr", "src1", len(long)),
        (5, "a", None, "src2", 1),
        (5, "a", None, "src2", 1),
        (6, "…!?", "de", None, 3),
        (7, "mit license mit license " * 20, "en", "src0", 480),
        (7, "mit license mit license " * 20, "en", "src0", 480),
        (8, "日本語 text 😀", "fr", "src9", 9),
    ]
    df = spark.createDataFrame([(*x, 9, "x", 1) for x in rows], SCHEMA + ", copy int, shard string, uid int")
    return df, rows


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
