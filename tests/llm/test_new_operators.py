"""Turn repair, decontamination and spelling variants against plain Python versions."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rasterloom.llm import decontamination, queries, spelling, turn_repair  # noqa: E402

REPAIR = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
LEAK = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def talk(n, seed, conv):
    rng = random.Random(seed)
    return [(conv, i if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice([f"hi {i}.", "ho.", f"cut {i}", "x!", "", " \t", None])) for i in range(n)]


def repaired(df):
    got = {r.conv_id: tuple(r[c] for c in REPAIR) for r in turn_repair.repair_damaged(df).collect()}
    rows = brute.conversation_rows([(r.conv_id, r.turn, r.role, r.text) for r in df.select("conv_id", "turn", "role", "text").collect()])
    return got, {k: brute.repaired(v) for k, v in rows.items()}


def test_repair(spark, sf_dir):
    """The table, null keys, repeated rows, texts of megabytes, and one conversation over many ranges."""
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    more = [*talk(900, 1, -5), *talk(40, 2, None), *[(-6, 3, "user", "the same row.")] * 7, (-7, None, "user", None), (-8, 5, "system", "alone."), (-9, 1, "user", "long " * 400_000 + ".")]
    more += [x for i in range(60) for x in talk(i % 9, i, 10_000 + i)]
    more += [(20_000, None, "user", "none."), (20_000, None, "assistant", "none."), (20_001, 0, "super", "s."), (20_001, 1, "u", "u."), (20_001, 2, "abc", "a.")]
    df = df.union(spark.createDataFrame(more, df.schema)).withColumns({"conv": F.lit(1), "told": F.lit(2), "flag": F.lit(3), "gone": F.lit(True)})
    got, want = repaired(df)
    assert got == want


def test_repair_borders(spark):
    """Every cut of conversations into pieces gives the same result."""
    rng = random.Random(7)
    df = spark.createDataFrame([x for i in range(30) for x in talk(rng.randint(1, 25), i, i // 3)], "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "2", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got, want = repaired(df)
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_align_fuzzed(monkeypatch):
    rng = random.Random(3)
    for i in range(300):
        monkeypatch.setattr(turn_repair, "CHUNK", rng.choice((1, 2, 3, 12)))
        rows = [(t, r or "", x or " ") for _, t, r, x in sorted(talk(rng.randint(0, 9), i, 0), key=lambda r: (r[1] is not None, r[1] or 0))]
        piece, seen = turn_repair._Piece((0,), (0,), True), set()
        for t, r, x in rows:
            piece.marked = (t, (r, x)) if (r, x) in seen else None
            seen.add((r, x))
            piece.add(t, (r, x), r, x)
        assert piece.result() == brute.repaired(rows)


def test_repair_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repair_damaged(df).collect() == []


@pytest.fixture(scope="module")
def leaky(spark, sf_dir):
    """Documents and items with odd ones: whole, short, empty and null items, one in two ids, words with other characters."""
    docs = brute.documents(spark, sf_dir)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    text = items.filter("item_id = 1").first().text
    own = [(900, "Alpha BETA gamma"), (901, "alpha"), (902, ""), (903, None), (904, text), (None, "one two three four five six seven eight nine ten"), (905, "Ünïcode wörds: 日本 e-mail"), (906, "four five six seven"), (907, brute.LONG[:200])]
    made = [(8_000_000, f"x {text.upper() if text.isascii() else text} y"), (8_000_001, "alpha-beta;gamma alpha"), (8_000_002, "ünïcode wörds ÜNïcode Wörds 日本 E MAIL é日本 wörds 日本"), (8_000_003, "filler " * 700_000 + text + " filler" * 300_000 + " alpha"), (8_000_004, None)]
    docs = docs.unionByName(spark.createDataFrame([(k, t, "en", "odd", 1) for k, t in made], docs.schema)).withColumns({"row": F.lit(1), "runs": F.lit(2), "n_words": F.lit(3), "key": F.lit(4)})
    return docs.cache(), items.union(spark.createDataFrame(own, items.schema)).withColumn("size", F.lit(1)).cache()


@pytest.mark.parametrize("block", [decontamination.BLOCK_BYTES, 20_000])
def test_leaks(leaky, block):
    docs, items = leaky
    got = {r.doc_id: (*(r[c] for c in LEAK[:3]), brute.sha(",".join(r["items"])), r.contaminated, list(zip(r.span_starts, r.span_ends))) for r in decontamination.decontaminate(docs, items, block=block).collect()}
    want = brute.leaks([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want
    assert sum(v[4] for v in want.values()) > 5


def test_leaks_slices(monkeypatch):
    """Windows over the slices of a long text are met, too."""
    monkeypatch.setattr(decontamination, "CHUNK_BYTES", 7)
    machine = decontamination.Automaton([("a", "b c d"), ("b", "d"), (None, "e f")])
    assert machine.scan(b"x b C-d x eeeeeeeeeeeeeeeeeeeee b  c   d e f" + b" g" * 40 + b" b c d") == (54, [(1, 4), (6, 11), (51, 54)], {"a", "b"})


def test_leaks_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    items = spark.createDataFrame([(1, "some item")], "item_id int, text string")
    assert decontamination.decontaminate(empty, items).collect() == []
    docs = spark.createDataFrame([(None, "some item"), (1, "some item"), (1, "some item"), (None, None)], "doc_id int, text string")
    assert sorted(r.n_hit for r in decontamination.decontaminate(docs, items, block=1).collect()) == [0, 2, 2, 2]
    assert [r.n_hit for r in decontamination.decontaminate(docs, items.filter("item_id > 1")).collect()] == [0] * 4


@pytest.mark.parametrize("block", [spelling.BLOCK, 50])
def test_variants(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    near = spelling.near_words
    monkeypatch.setattr(spelling, "near_words", lambda words: near(words, block))
    docs = brute.documents(spark, sf_dir)
    rng = random.Random(1)
    chain = ["aaaaaa"] * 100 + ["aaaaab"] * 45 + ["aaaabb"] * 20 + ["aaabbb"] * 9 + ["aabbbb"] * 4 + ["abbbbb"] * 3 + ["xaaaaaa"] * 3 + ["aaaaa"] * 200 + ["éaaaaa"] * 60 + ["y" * 5000] * 9 + ["y" * 4999 + "z"] * 4 + ["y" * 4999] * 3 + ["Straße×÷"] * 5
    near_others = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 7))) for _ in range(4000)]
    made = [(None, " ".join(chain)), (7_000_000, "-".join(near_others)), (7_000_001, " ".join(near_others)), (7_000_001, " ".join(chain)), (7_000_002, "q" * 2_500_000)] * 2
    docs = docs.unionByName(spark.createDataFrame([(k, t, "en", "odd", 1) for k, t in made], docs.schema)).withColumns({c: F.lit(1) for c in ("word", "n", "key", "side")}).cache()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variant_groups(docs).collect()}
    assert got == brute.variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sum(v[0] is not None for v in got.values()) > 100


def test_near_fuzzed():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 8))) for _ in range(1500)})
    held = spelling.SortedList(words)

    def edit(a, b):
        return a != b and (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(9)))

    for q in rng.sample(words, 150):
        for k in (2, len(q) // 2):
            assert [words[i] for i in held.near(q, k)] == [w for w in words if w[:k] == q[:k] and edit(w, q)]


def test_variants_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variant_groups(df).collect() == []
    assert spelling.variant_groups(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).collect() == []


def test_queries(spark, sf_dir):
    """The registered queries over whole tables, against the plain versions."""
    made = queries.queries()
    got = {r.conv_id: tuple(r[c] for c in REPAIR) for r in made["op11_turn_repair"](spark, sf_dir).collect()}
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert got == {k: brute.repaired(v) for k, v in brute.conversation_rows(rows).items()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r[c] for c in LEAK) for r in made["op12_decontamination"](spark, sf_dir).collect()}
    assert got == {k: v[:5] for k, v in brute.leaks(docs, items).items()}
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in made["op13_spelling"](spark, sf_dir).collect()}
    assert got == brute.variants(docs)
