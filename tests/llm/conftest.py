import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Null, empty, very long, repeated and odd texts, null ids' neighbours, and columns whose names operators use themselves."""
    r = random.Random(1)
    words = ["lorem", "ipsum", "Dolor", "sit", "amet", "größe", "naïve", "x1", "token", "deadbeef"]
    long = " ".join(r.choice(words) for _ in range(30_000))
    texts = [None, "", " ", "\n\n", "a", "A", "12345 !!", "same text here", "same text here", "Same Text Here", long, long + " end", "\x00\x1c▁ \t é̩ 🙂 　 end", "▁▁ x  y", "<|endoftext|> it's 5.7"]
    rows = [(i, t, None if i % 3 else "en", None, None) for i, t in enumerate(texts)]
    rows += [rows[7], rows[0]]
    return rows


@pytest.fixture(scope="session")
def frame(spark, awkward):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward, SCHEMA)
    for name in ("shard", "slot", "key", "h", "norm", "base", "spans", "kind", "id", "band", "gone", "score", "lang_pred", "media", "grp"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
