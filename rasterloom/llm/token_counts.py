"""Token counts behind a digest cache: content and tokenizer-version digests are joined to stored counts, only
distinct misses are encoded, and their counts are appended to the cache."""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rasterloom.llm.byte_bpe import is_plain, read_ranks
from rasterloom.llm.common import arrow_map, new_path, written

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
#: The rank file that holds the same vocabulary as a .json file.
TWINS = {"byte_bpe_50k.json": "byte_bpe_50k.tiktoken"}


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: a digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: Column) -> Column:
    """Null and empty texts are the same content; nothing else that changes the tokens is normalised away."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


@functools.lru_cache(4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens of whole texts as the library of the file does.

    For a vocabulary that is also present as ranks, texts of the first Unicode blocks without special strings are
    counted by the ranks (equal results, tested), since they are several times faster; all others by the library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    slow = lambda texts: [len(e.ids) for i in range(0, len(texts), 64) for e in whole.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]
    twin = TWINS.get(os.path.basename(path))
    if not twin or not os.path.exists(twin := os.path.join(os.path.dirname(path), twin)):
        return slow
    import public_tokenizers
    import tiktoken

    fast = tiktoken.Encoding(twin, pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(twin), special_tokens={}).encode_ordinary
    special = [t.content for t in whole.get_added_tokens_decoder().values()]

    def count(texts: list[str]) -> list[int]:
        out = [len(fast(t)) if is_plain(t) and not any(s in t for s in special) else -1 for t in texts]
        rest = [i for i, n in enumerate(out) if n < 0]
        for i, n in zip(rest, slow([texts[i] for i in rest])):
            out[i] = n
        return out

    return count


def new_cache(spark: SparkSession) -> str:
    """An empty cache table in the shared folder."""
    path = new_path(spark, "token-cache")
    spark.createDataFrame([], CACHE_SCHEMA).write.parquet(path)
    return path


def count_tokens(df: DataFrame, cache: str, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Count the tokens of every whole text. Returns key, n_bytes, n_tokens; cache grows by what was missing.

    Null texts count as empty; repeated rows and equal texts are encoded once; other columns are ignored; key may
    be null or repeated; texts may be of any length; an empty table gives none and adds nothing to the cache. The texts themselves are shuffled at most once, and only those of missing contents."""
    spark, version = df.sparkSession, tokenizer_digest(path)
    docs = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = docs.select("key", content_digest(F.col("text")).alias("content_digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")

    def step(cols: dict) -> Iterator[dict]:
        yield {"content_digest": cols["content_digest"], "n_tokens": counter(path)(cols["text"])}

    # one row of each missing content stands for it; partial aggregation folds copies before the shuffle
    name = F.coalesce(F.col("key").cast("string"), F.lit(""))
    missing = rows.withColumn("name", name).groupBy("content_digest").agg(F.min("name").alias("name")).join(stored, "content_digest", "left_anti")
    wanted = docs.withColumns({"content_digest": content_digest(F.col("text")), "name": name}).join(missing, ["content_digest", "name"], "left_semi")
    made = arrow_map(wanted.select("content_digest", "text"), step, "content_digest binary, n_tokens long")
    made = made.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    made.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
    now = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer_digest") == version)
    now = now.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))  # two writers may both have appended
    now = written(now.join(rows.select("content_digest").distinct(), "content_digest", "left_semi"), "counts")
    return rows.join(now, "content_digest", "left").select(F.col("key").alias(key), "n_bytes", "n_tokens")
