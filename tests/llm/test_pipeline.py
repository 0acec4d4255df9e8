"""The pipeline's stages, each on what its predecessor kept, against plain Python versions."""

import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from rasterloom.llm import pii, quality  # noqa: E402


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """name -> (input, output) of each stage, with odd documents, copies and near copies among the input."""
    docs = brute.documents(spark, sf_dir)
    some = docs.filter("doc_id % 9 = 0 and length(text) > 400")
    copies = some.withColumns({"doc_id": F.col("doc_id") + 5_000_000, "text": F.regexp_replace("text", " ", "  ")})
    near = some.withColumns({"doc_id": F.col("doc_id") + 6_000_000, "text": F.concat("text", F.lit(" one more ending"))})
    docs, out = docs.union(copies).union(near), {}
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        out[name] = (docs, made)
        docs = made
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_order_and_columns(steps):
    assert list(steps) == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]
    assert all(made.dtypes == docs.dtypes for docs, made in list(steps.values())[:-1])


def test_quality_stage(spark, sf_dir, steps):
    docs, made = steps["quality"]
    scores = quality.score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert sorted(texts(made)) == sorted(texts(docs.join(scores.filter("score >= 0.3"), "doc_id", "left_semi")))
    assert 0 < made.count() < docs.count()


def test_exact_stage(steps):
    docs, made = steps["exact_dedup"]
    rows = texts(docs)
    keep = {k for k, v in brute.exact(rows).items() if v[2]}
    assert sorted(texts(made)) == sorted(r for r in rows if r[0] in keep) and len(keep) < len(rows)


def test_near_stage(steps):
    docs, made = steps["near_dedup"]
    rows = texts(docs)
    keep = {k for k, v in brute.near(rows, 5).items() if v[2]}
    assert sorted(texts(made)) == sorted(r for r in rows if r[0] in keep) and len(keep) < len(rows)


def test_pii_stage(steps):
    docs, made = steps["pii"]
    before, after = dict(texts(docs)), dict(texts(made))
    assert before.keys() == after.keys()
    assert any("[SECRET]" in (t or "") for t in after.values()) == any("token = " in (t or "").lower() for t in before.values())
    touched = {r.id for r in pii.find_spans(docs).select("id").distinct().collect()}
    assert {k for k in before if before[k] != after[k]} == touched and touched
    assert {k for k, t in before.items() if brute.base_spans(t)} <= touched
    assert not [k for k, t in after.items() if t and any(a == "email" for a, _, _ in brute.base_spans(t))]
    assert made.filter("text is not null and n_chars != length(text)").count() == 0


def test_packing_stage(steps):
    import numpy as np
    from tokenizers import Tokenizer

    docs, made = steps["packing"]
    whole, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for r in made.collect():
        pieces.setdefault(r.doc_id, []).append(r)
    rows = texts(docs)
    assert pieces.keys() == {k for k, _ in rows}
    for k, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], np.uint32)
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes())), k
            at += r.length
        assert at == len(ids)


def test_repeated_rows(spark, sf_dir, steps, monkeypatch):
    """Which rows each stage keeps of repeated ones, of several texts with one key, and of those without a key."""
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcd"}
    good, bad = text["a"], text["b"]
    schema = steps["quality"][0].schema
    made = lambda rows: spark.createDataFrame([(k, t, "en", "s", None) for k, t in rows], schema)
    left = lambda df: sorted(texts(df), key=str)

    def scored(df, labels, **kept):
        return df.withColumn("predicted", F.coalesce((F.col("text") == good).cast("int"), F.lit(0)))

    rows = [(1, good), (1, good), (1, bad), (None, good), (None, bad), (None, None), (2, bad)]
    with monkeypatch.context() as m:
        m.setattr(quality, "score_quality", scored)
        assert left(corpus_pipeline.quality_stage(spark, made(rows), sf_dir)) == sorted([(1, good), (1, good), (None, good)], key=str)
    rows = [(1, good), (1, good), (1, bad), (2, bad), (None, text["c"]), (3, text["c"]), (None, text["d"]), (None, text["d"]), (4, None), (5, "")]
    want = [(1, good), (1, bad), (None, text["c"]), (None, text["d"]), (4, None)]
    assert left(corpus_pipeline.exact_stage(spark, made(rows), sf_dir)) == sorted(want, key=str)
    rows = [(1, good), (1, good), (1, good + " end"), (2, good), (1, bad), (None, bad), (None, text["c"]), (None, text["c"]), (None, text["d"] + " end"), (6, text["d"]), (None, None), (7, None)]
    kept = left(corpus_pipeline.near_stage(spark, made(rows), sf_dir))
    first = [r for r in kept if r[0] == 1 and r[1] != bad]
    assert len(first) == 1 and first[0] in rows
    assert [r for r in kept if r not in first] == sorted([(1, bad), (None, text["c"]), (6, text["d"]), (None, None), (7, None)], key=str)


@pytest.mark.parametrize("case", ["empty", "nulls"])
def test_odd_tables(spark, sf_dir, steps, case, monkeypatch):
    """Exact rows of each stage on an empty table, and on rows of nulls, repeated rows and clashing columns."""
    schema = steps["quality"][0].schema
    row, good = (7, "the same text in a repeated row, call +15551234567 now."), "text without a key"
    rows = [] if case == "empty" else [(None, None), (None, good), row, row, (8, None), (9, ""), (10, "rejected one")]
    names = ("cuts", "__id", "__row", "__key", "__text", "__y", "id", "kept", "row", "component_id", "key", "body", "row_identity", "whole", "set_id", "keep_0", "start", "parts")
    docs = spark.createDataFrame([(k, t, "en", "s", None) for k, t in rows], schema).withColumns({n: F.lit(n) for n in names})

    def scored(df, *inputs, **kept):
        return df.select(*kept["keep"], F.when(F.col("text") == "rejected one", 0).otherwise(1).alias("predicted"))

    whole = quality.score_quality
    assert whole(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=("__key", "__y")).count() == len(rows)
    monkeypatch.setattr(quality, "score_quality", scored)
    masked = "the same text in a repeated row, call [PHONE] now."
    want = {
        "quality": [r for r in rows if r[0] != 10], "exact_dedup": [(None, None), (None, good), row], "near_dedup": [(None, None), (None, good), row],
        "pii": [(None, None), (None, good), (7, masked)],
    }
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        if name != "packing":
            assert made.dtypes == docs.dtypes
            assert sorted(texts(made), key=str) == sorted(want[name] if rows else [], key=str), name
            assert all(r[n] == n for r in made.collect() for n in names)
        docs = made
    assert {r.doc_id for r in docs.collect()} == ({None, 7} if rows else set())
