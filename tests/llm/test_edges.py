"""Null ids in every operator, and the pipeline on awkward tables."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SCHEMA
from tests.llm.test_ops import brute_spans
from tidemark.llm import exact, langid, linededup, ngramjoin, ogg, packing, queries, secrets, sharding, sptok, warc

LONG = "a null id and words of its own that nothing else in this table holds at all"


@pytest.fixture(scope="module")
def rows(awkward):
    return [*awkward, (None, LONG, "en", "s", None), (None, None, None, None, None), (None, "same text here", "en", "s", None), (None, LONG, "en", "s", None)]


@pytest.fixture(scope="module")
def nulls(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("key", "row", "th", "h", "grp", "c0", "stay")})


def texts(rows):
    return Counter((r[0], r[1]) for r in rows)


def test_media(nulls, rows):
    got = ogg.digests(ogg.decode(ogg.encode(nulls))).collect()
    assert Counter((g[0], *g[1:5]) for g in got) == Counter((r[0], *ogg.brute(r[1])) for r in rows)


def test_ngram(nulls, rows):
    got = ngramjoin.classes(nulls).collect()
    assert len(got) == len(rows)
    assert [(r.class_id, r.set_size, r.n_links) for r in got if r.doc_id is None] == [(None, 1, 0)] * 4
    left = ngramjoin.keep_one(nulls)
    assert left.columns == nulls.columns and left.where("doc_id is null").count() == 4


def test_shards(nulls, rows):
    got = sharding.shuffle(nulls).collect()
    assert texts([(r.doc_id, r.text) for r in got]) == texts(rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_tokens_and_packing(spark, nulls, rows):
    shipped = sptok.ship(spark, sptok.zipf(sptok.load(queries.tokenizer_path("piece_bpe_32k.model"))))
    got = sptok.decode(sptok.encode(nulls, shipped), shipped).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1] or "") for r in rows)
    packed = packing.pack(nulls, queries.tokenizer_path("word_bpe_49k.json")).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r[0] for r in rows)


def test_lines(nulls, rows):
    got = linededup.dedup_lines(nulls, count_col="n", drop_emptied=True)
    assert Counter(r.text for r in got.collect() if r.doc_id is None) == Counter(r[1] for r in rows if r[0] is None)
    assert set(got.columns) == {*nulls.columns, "n"}


def test_secrets(nulls, rows):
    got = secrets.scan(nulls).collect()
    assert Counter((r.doc_id, r.text) for r in got) == texts(rows)
    assert all([tuple(s) for s in r.spans] == brute_spans(r.text) for r in got)


def test_language(nulls, rows):
    got = langid.identify(nulls, langid.sample(nulls)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == texts(rows)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)


def test_exact(nulls, rows):
    norm = [(d, (t or "").translate(str.maketrans(exact.UPPER, exact.LOWER))) for d, t in (r[:2] for r in rows)]
    size = Counter(n for _, n in norm)
    keep = {n: max((d for d, m in norm if m == n and d is not None), default=None) for n in size}
    want = Counter((d, keep[n], size[n], d == keep[n], hashlib.sha256(n.encode()).hexdigest()) for d, n in norm)
    assert Counter(tuple(r) for r in exact.groups(nulls).collect()) == want


def test_pages(spark):
    df = spark.createDataFrame([(None, None, "<p>a</p>"), (3, "u", "<p>a</p>"), (4, "u", "<p>a</p>"), (None, "u", None)], "page_id long, url string, html string")
    got = warc.resolved(warc.digests(warc.archive(df))).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to) for r in got) == [(-1, "response", None), (-1, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_pipeline_on_awkward_rows(spark, nulls, rows, tmp_path):
    """Rows without letters go; null ids stay; repeated rows stay together; a text of any length is packed whole."""
    nulls.withColumn("lang", F.coalesce("lang", F.when(F.col("doc_id") % 2 == 0, "de"))).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    first = Counter(r.doc_id for r in got if r.start == 0)
    assert first[None] == 3 and first[10] == 1 and 0 not in first and 6 not in first
    assert first[7] == 2 and not {8, 9} & set(first)
    whole = sum(r.length if hasattr(r, "length") else len(r.ids) // 4 for r in got if r.doc_id == 10)
    assert whole == next(r.doc_tokens for r in got if r.doc_id == 10) > 2048


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_state_their_results(spark, nulls):
    for name, stage in corpus_pipeline.STAGES:
        assert stage.__doc__ and "ull" in stage.__doc__, name
