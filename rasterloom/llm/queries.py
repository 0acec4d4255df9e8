"""The registered queries of this package, one per operator, over whole tables; and their DuckDB SQL where there is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterloom.llm import byte_bpe, chat, decontamination, exact_dedup, media, minhash, packing, pii, quality, spelling, substring_dedup, token_counts, turn_repair
from rasterloom.llm.common import table

OVER_LIMIT = 512


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_words").cast("long"), F.col("n_removed").cast("long"), F.sha2("text", 256).alias("kept_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.new_cache(spark), path)
    return out.withColumn("over_limit", F.col("n_tokens") > OVER_LIMIT)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    two = spark.range(2).select(
        F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    return chat.read_back(chat.format_windows(rows.unionByName(two)))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_substring_dedup, op2_pii, op3_media, op4_packing, op5_token_counts, op6_chat, op7_exact_dedup, op8_quality, op9_byte_bpe, op10_minhash, op11_turn_repair, op12_decontamination, op13_spelling)
    return {f.__name__: f for f in own}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d),
g AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 12], ' ')) AS h FROM p),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM f WHERE doc_id > first),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

# Pairs come from the rarest fifth of each distinct set: sets of similarity 0.8 or more share a shingle of it.
OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END)) AS g FROM d),
c AS MATERIALIZED (SELECT min(doc_id) AS rep, g, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
t AS MATERIALIZED (SELECT rep, n, unnest(g) AS x FROM c),
f AS (SELECT x, count(*) AS df FROM t GROUP BY x),
r AS (SELECT rep, n, x, row_number() OVER (PARTITION BY rep ORDER BY df, x) AS i FROM t JOIN f USING (x)),
p AS (SELECT rep, n, x FROM r WHERE i <= n - (8 * n + 9) // 10 + 1),
q AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
k AS (SELECT q.a, q.b, a.n + b.n AS total, len(list_intersect(a.g, b.g)) AS common FROM q JOIN c a ON a.rep = q.a JOIN c b ON b.rep = q.b),
e AS MATERIALIZED (SELECT a, b FROM k WHERE 100 * common >= 80 * (total - common)),
e2 AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT rep AS a, rep AS b FROM c UNION SELECT reach.a, e2.b FROM reach JOIN e2 ON reach.b = e2.a),
m AS (SELECT c.g, min(reach.b) AS component FROM reach JOIN c ON c.rep = reach.a GROUP BY c.g)
SELECT doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM s LEFT JOIN m ON s.g = m.g
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS body
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM i WHERE len(w) > 0)),
g AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS body
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM b))),
m AS MATERIALIZED (SELECT doc_id, k, n, item_id FROM g JOIN b USING (n, body)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

# The checksum is taken bit by bit; near words meet on what is left when one place is taken out of both, or of one.
OP13_SQL = f"""
WITH RECURSIVE e AS (SELECT n, list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) t(n)),
crc AS (SELECT list(v ORDER BY n) AS t FROM e),
d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
o AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM d GROUP BY ALL),
c AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
    lambda s, b: xor(s >> 8, t[xor(s & 255, b) + 1])), 4294967295) AS h FROM o CROSS JOIN crc),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM c)
  GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
p AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
r AS MATERIALIZED (SELECT a.word, b.word AS other, b.n FROM p a JOIN p b ON a.k = b.k AND a.i = b.i AND a.word != b.word
  UNION SELECT p.word, w.word, w.n FROM p JOIN w ON p.k = w.word UNION SELECT w.word, p.word, p.n FROM p JOIN w ON p.k = w.word),
f AS MATERIALIZED (SELECT w.word, w.n, count(other) AS n_near, min({{'less': -r.n, 'form': other}}) AS best FROM w LEFT JOIN r USING (word) GROUP BY w.word, w.n),
g AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN -best.less >= 2 * n THEN best.form END AS form, CASE WHEN -best.less >= 2 * n THEN -best.less END AS form_n FROM f),
z AS (SELECT word, word AS at FROM g UNION ALL SELECT z.word, g.form FROM z JOIN g ON g.word = z.at WHERE g.form IS NOT NULL)
SELECT g.word, g.form, z.at AS root, g.n, g.n_near, g.form_n FROM g JOIN z USING (word) JOIN g l ON l.word = z.at WHERE l.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op7_exact_dedup": OP7_SQL, "op10_minhash": OP10_SQL, "op12_decontamination": OP12_SQL, "op13_spelling": OP13_SQL}
