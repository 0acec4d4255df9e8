"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets and star-shaped candidate
edges, confirmed on the full shingle sets.

Stars alone can miss a link between two members of a bucket that are both unlike its centre. What the stars leave apart
is therefore finished exactly: two sets that reach the similarity share one of their rarest shingles, so the documents
of buckets that still hold several components meet on those."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.llm.common import arrow_map, identity, pieces as slices, schemas, written
from rasterloom.llm.components import apart, merged
from rasterloom.llm.hashing import encoded, mix, run_hashes, texts_hashes

#: 32 bands of 4 bins: a pair at similarity 0.8 shares no band with a probability of (1 - 0.8 ** 4) ** 32 = 5e-8.
BINS, ROWS = 128, 4
#: Members of a star, and rows of a shingle, that one group compares.
STAR, BLOCK = 128, 1024
#: 64-bit words of a set's parity bits.
PARITY = 8


def _orders(bins: int) -> np.ndarray:
    """For each bin the order in which other bins are tried when it is empty."""
    keys = mix(np.arange(bins * bins, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D)).reshape(bins, bins)
    keys[np.arange(bins), np.arange(bins)] = 0
    return keys.argsort(axis=1)


_ORDER = _orders(BINS)
_BOUNDS = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One-permutation signature of a sorted array of distinct hashes: the least of each bin, empty bins filled from
    the first non-empty bin in their own order (optimal densification). 16 bits a bin."""
    first = np.searchsorted(shingles, _BOUNDS)
    last = np.append(first[1:], len(shingles))
    full = first < last
    values = ((shingles[np.minimum(first, len(shingles) - 1)] >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16)
    if full.all():
        return values
    return values[_ORDER[np.arange(BINS), full[_ORDER].argmax(axis=1)]]


def parity(shingles: np.ndarray) -> np.ndarray:
    """64 * PARITY bits, each turned over by every shingle that falls on it. Shingles that two sets share cancel out,
    so two sets differ in at least as many shingles as these bits differ."""
    bits = np.bincount((mix(shingles) & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def shingle_sets(raw: list[bytes], n: int, seed: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct hashes of the n-word shingles of each text, and where each first occurs; a text of fewer words
    is one shingle, a text without words none."""
    words, at = texts_hashes(raw, seed)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        m = min(n, b - a)
        yield np.unique(run_hashes(words[a:b], m, salt=m), return_index=True) if m else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def exact_shingles(raw: bytes, n: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    words = raw.split()
    return set(zip(*(words[i:] for i in range(n)))) if len(words) >= n else {tuple(words)} - {()}


def sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """id, row, n_shingles, set_id (128-bit digest of the set, told by two hashes of each shingle) and signature of each
    text. rows: id, row, text."""

    def step(cols: dict) -> Iterator[dict]:
        out: dict[str, list] = {"id": cols["id"], "row": cols["row"], "n_shingles": [], "set_id": [], "signature": []}
        raw = encoded(cols["text"], lower=True)
        second, at = texts_hashes(raw, 1)
        for (s, first), a, b in zip(shingle_sets(raw, shingle), at[:-1].tolist(), at[1:].tolist()):
            m = min(shingle, b - a)
            told = s.tobytes() + run_hashes(second[a:b], m, salt=m)[first].tobytes() if m else b""
            out["n_shingles"].append(len(s))
            out["set_id"].append(hashlib.blake2b(told, digest_size=16).digest() if m else None)
            out["signature"].append(signature(s).tobytes() if m else None)
        yield out

    return arrow_map(rows, step, "id long, row string, n_shingles long, set_id binary, signature binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class _Centre:
    """The set of a star's centre, as hashes and, once needed, as shingles."""

    def __init__(self, raw: bytes, hashes: np.ndarray, shingle: int, percent: int):
        self.raw, self.hashes, self.shingle, self.percent, self.exact = raw, hashes, shingle, percent, None

    def links(self, raw: bytes, hashes: np.ndarray) -> bool:
        """Whether the sets reach the similarity: by hashes first, then by the shingles themselves."""
        if not similar(hashes, self.hashes, self.percent):
            return False
        if self.exact is None:
            self.exact = exact_shingles(self.raw, self.shingle)
        own = exact_shingles(raw, self.shingle)
        both = len(own & self.exact)
        return 100 * both >= self.percent * (len(own) + len(self.exact) - both)


def linked(edges: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The edges (a, b) whose full shingle sets reach the similarity. texts: id, text of all that occur in edges.

    Members a go to their centre b, whose text comes first and is read once for STAR members or so; a centre of more
    is dealt to several groups."""
    sizes = edges.groupBy("b").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    members = edges.select("a", "b").join(sizes, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("member"), F.col("a").alias("id"))
    centres = sizes.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"), F.col("b").alias("id"))
    rows = members.union(centres).join(texts.select("id", "text"), "id").repartition("b", "part").sortWithinPartitions("b", "part", "member")
    out, arrow = schemas("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = None
        for batch in batches:
            for piece in slices(batch):
                b, member, ids, texts = (piece.column(i).to_pylist() for i in range(4))
                raw, kept = encoded(texts, lower=True), ([], [])
                for x, y, m, r, (s, _) in zip(ids, b, member, raw, shingle_sets(raw, shingle)):
                    if not m:
                        centre = _Centre(r, s, shingle, percent)
                    elif centre.links(r, s):
                        kept[0].append(x)
                        kept[1].append(y)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in kept], schema=arrow)

    return rows.select("b", "member", "id", "text").mapInArrow(run, out)


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: key, n_shingles, component_id, kept (it is the smallest of its component).

    Texts with equal shingle sets are one class from the start, so copies are never paired. Documents are linked when
    100 * intersection >= percent * union of their sets; a component is what links reach. Null, empty and blank texts
    have no shingles, no links and stay. key must be whole numbers; other columns are ignored. The method is meant for
    percent >= 80; lower ones need more bands. Texts and words may be of any length; an empty table gives none.

    Rows with a null key are linked like others and come after all keys: one is kept, with a null component_id, where
    its component has no key. Of one key with several texts in a component one row is kept; rows repeated with the same
    key and text get the same result."""
    return near_rows(df, key, text, shingle, percent).drop("row")


def near_rows(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """near_groups with row, the identity of key and text."""
    docs = df.select(F.col(key).cast("long").alias("id"), identity(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text"))
    sk = written(sketches(docs, shingle), "sketches")
    lead = F.min(F.struct(F.col("id").isNull().alias("void"), "id", "row")).alias("lead")
    sets = sk.filter("set_id is not null").groupBy("set_id").agg(lead, F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    sets = written(sets.select("set_id", "lead.*", "n_shingles", "signature"), "sets")
    # each class is a node, numbered in the order of its first row: the smallest node has the smallest key
    order, n = ["void", "id", "row"], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = written(sets.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "nodes")
    reps = nodes.select("set_id", F.col("node").alias("id"), F.col("row"), "n_shingles", "signature")
    bands = [F.xxhash64(F.lit(i), F.substring("signature", 1 + 2 * ROWS * i, 2 * ROWS)) for i in range(BINS // ROWS)]
    in_bands = reps.select("id", F.posexplode(F.array(*bands)).alias("band", "bucket"))
    centres = in_bands.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("size")).filter("size > 1")
    hits = written(in_bands.join(centres, "bucket"), "buckets")  # members of buckets that hold more than one

    found = hits.select("id").distinct()
    need = reps.select("id", "row").join(found, "id", "left_semi")
    texts = written(docs.select("row", "text").join(need, "row").dropDuplicates(["row"]).select("id", "text"), "candidates")
    stars = hits.filter("id != centre").groupBy(F.col("id").alias("a"), F.col("centre").alias("b")).agg(F.count("*").alias("shared"))
    stars = written(stars, "stars")

    # first each member with the centre that it meets most often, then the rest where it still joins components
    best = stars.groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("less"))).alias("x")).select("a", (-F.col("x.less")).alias("b"))
    joined = merged(None, linked(best, texts, shingle, percent))
    others = written(apart(stars.join(best, ["a", "b"], "left_anti"), joined).select("a", "b"), "others")
    for pairs in (lambda: others, lambda: _residual(hits, texts, joined, shingle, percent)):
        edges = pairs()
        if not edges.isEmpty():
            joined = merged(joined, linked(edges, texts, shingle, percent))

    first = nodes.select(F.col("node").alias("component"), F.col("id").alias("component_id"), F.col("row").alias("lead"))
    classes = reps.select("set_id", "id").join(joined.select(F.col("node").alias("id"), "component"), "id", "left")
    classes = classes.select("set_id", F.coalesce("component", "id").alias("component")).join(first, "component")
    classes = written(classes.select("set_id", "component_id", "lead"), "classes")  # a table: so the join may split a hot set's rows
    own = F.when(F.col("lead").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return sk.join(classes, "set_id", "left").select(
        F.col("id").alias(key), "n_shingles", own.alias("component_id"), F.coalesce(F.col("row") == F.col("lead"), F.lit(True)).alias("kept"), "row"
    )


def _residual(hits: DataFrame, texts: DataFrame, joined: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) that may link different components among the documents of buckets that still hold several.

    Shingles are ordered by how many of these documents hold them. Sets of n shingles that reach the similarity share
    one of the first n - ceil(n * percent / 100) + 1 of that order, so documents of a template whose own words are the
    rare ones never meet. Those that fill its slots from few values do meet, on common shingles; they are told apart where
    they meet by their parity bits, which bound the difference of two sets from below. Only pairs that can still reach the
    similarity by sizes, places and parity bits leave the join; they remain to be confirmed."""
    member = hits.join(joined.select(F.col("node").alias("id"), "component"), "id", "left")
    member = member.select("bucket", "id", F.coalesce("component", "id").alias("component"))
    mixed = member.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("bucket")
    rest = written(member.join(mixed, "bucket").select("id", "component").distinct(), "rest")

    def step(cols: dict) -> Iterator[dict]:
        sets = [s for s, _ in shingle_sets(encoded(cols["text"], lower=True), shingle)]
        yield {"id": cols["id"], "component": cols["component"], "n": [len(s) for s in sets], "x": [s.view(np.int64) for s in sets], "bits": [parity(s) for s in sets]}

    sets = written(arrow_map(rest.join(texts, "id").select("id", "component", "text"), step, "id long, component long, n long, x array<long>, bits array<long>"), "sets")
    each = sets.select("id", "component", "n", F.explode("x").alias("x"))
    counts = written(each.groupBy("x").agg(F.count("*").alias("df")).filter("df > 1"), "counts")
    held = each.join(counts, "x").groupBy("id").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "x"))).alias("s"))
    alone = F.col("n") - F.size("s")  # shingles of one document alone come first in the order
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    held = held.withColumns({"alone": alone, "s": F.slice("s", F.lit(1), F.greatest(F.lit(0), first - alone).cast("int"))})
    places = written(held.select("id", "component", "n", "alone", F.posexplode("s.x").alias("place", "x")).withColumn("place", F.col("alone") + F.col("place") + 1), "places")
    groups = places.groupBy("x").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.min("component").alias("low"), F.max("component").alias("high"))
    groups = written(groups.filter("low != high").select("x", "parts"), "groups")
    rows = places.join(groups, "x").join(sets.select("id", "bits"), "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))

    names = ("id", "component", "n", "place", "bits")

    def side(name: str, p: Column, q: Column) -> DataFrame:
        named = [F.col(c).alias(f"{c}_{name}") for c in names]
        return rows.select("x", p.alias("p"), *named, "own", "parts").select("x", "p", q.alias("q"), *[f"{c}_{name}" for c in names])

    # a shingle of many rows is a grid of blocks, each a key of its own
    pairs = side("a", F.col("own"), every).join(side("b", every, F.col("own")), ["x", "p", "q"])
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    most = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    fits = (100 * small >= percent * large) & (most * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b")))
    differ = sum((F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(PARITY)), F.lit(0))
    fits &= differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    pairs = pairs.filter((F.col("id_a") > F.col("id_b")) & (F.col("component_a") != F.col("component_b")) & fits)
    return written(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "pairs")
