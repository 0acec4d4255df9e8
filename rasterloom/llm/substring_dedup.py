"""Substring dedup, seed and extend: each window has a seed, the least of its runs of a few words (winnowing); places of
one seed in several documents meet with the words around them. Each place is extended, word by word to both sides,
against the one of the smallest document; windows that this leaves open are looked up among those of the places
before. What is found again is told as runs of words, and adjoining runs merge to maximal repeats. A whole copy of a
document with a smaller id is one repeat from the start.

Hashes choose the seeds only. Windows are compared by their words (of words over LONG bytes, by their BLAKE2b digests),
except those few that several tasks hold of one hot seed: they meet by the 128-bit digest of their words. Whole texts
are equal when their SHA-256 digests are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterloom.llm.common import arrow_map, pieces, schemas, written
from rasterloom.llm.hashing import encoded, run_hashes, texts_hashes

#: Words of an anchor. With windows of 13 words, each window holds 9 anchors of which the least is its seed.
ANCHOR = 5
#: Documents of an anchor that one task compares; the places of a hotter anchor are dealt to several.
HOT = 20_000
#: Windows of an anchor that a task keeps in memory; further ones meet by digest instead.
MOST = 200_000
#: Bytes of a word that are compared as they are; longer words are told by a digest.
LONG = 64
#: Documents of the sample that tells the hottest anchors, in how many of them an anchor is hot, how many anchors are
#: told at most, and parts that their rows are dealt to. These only spread the work; results don't depend on them.
SAMPLE, OFTEN, HOTTEST, SALTS = 20_000, 20, 65_536, 64


def seed_places(runs: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` runs the place of its least, the first of equals. It depends on the window alone, so
    equal windows have their seeds at equal places; and it never goes back from one window to the next."""
    m = len(runs) - width + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    least, place, at = runs, np.arange(len(runs)), 1

    def first(low: slice, high: slice) -> tuple[np.ndarray, np.ndarray]:
        left = least[low] <= least[high]
        return np.where(left, least[low], least[high]), np.where(left, place[low], place[high])

    while 2 * at <= width:  # doubling: least of 1, 2, 4, ... neighbours
        least, place = first(slice(0, -at), slice(at, None))
        at *= 2
    return first(slice(0, m), slice(width - at, width - at + m))[1]


def seeds(words: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """The winnowed anchor of each window of `length` words: the least hash of the runs of `anchor` words in it."""
    runs = run_hashes(words, anchor, salt=1)
    return runs[seed_places(runs, length - anchor + 1)]


def _hashed(raw: list[bytes], seed: int = 0) -> Iterator[np.ndarray]:
    words, at = texts_hashes(raw, seed)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield words[a:b]


def _handle() -> Column:
    """One number for (id, row). Documents that share it by chance share their anchors, which only adds candidates."""
    return F.xxhash64("id", "row")


def _anchors(docs: DataFrame, length: int, anchor: int, hottest: dict[int, int]) -> DataFrame:
    """(doc, anchor, parts): the anchors of each document, with the parts of the hottest, 0 for others."""
    known = np.array(sorted(hottest), np.int64)
    dealt = np.array([hottest[k] for k in known.tolist()] or [0], np.int32)

    def step(cols: dict) -> Iterator[dict]:
        held = [np.unique(seeds(w, length, anchor)).view(np.int64) for w in _hashed(encoded(cols["text"]))]
        parts = []
        for h in held:
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            parts.append(np.where(known[at] == h, dealt[at], 0) if len(known) else np.zeros(len(h), np.int32))
        yield {"doc": cols["doc"], "anchors": held, "parts": parts}

    made = arrow_map(docs.select(_handle().alias("doc"), "text"), step, "doc long, anchors array<long>, parts array<int>")
    return made.select("doc", F.explode(F.arrays_zip("anchors", "parts")).alias("a")).select("doc", F.col("a.anchors").alias("anchor"), F.col("a.parts").alias("parts"))


def hottest_anchors(docs: DataFrame, length: int, anchor: int, hot: int) -> dict[int, int]:
    """The anchors that are frequent in a bounded sample of documents, and the parts that their windows are dealt to."""
    every = max(1, docs.count() // SAMPLE)
    some = docs.filter(F.pmod(_handle(), F.lit(every)) == 0)
    often = _anchors(some, length, anchor, {}).groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    rows = often.orderBy(F.desc("n"), "anchor").limit(HOTTEST).collect()
    return {r.anchor: max(1, -(-r.n * every // hot)) for r in rows}


def shared_anchors(docs: DataFrame, length: int, anchor: int, hot: int) -> DataFrame:
    """For each document (doc) that holds anchors of several: those, and in how many parts their places are dealt out.
    docs: id, row, text. The hottest anchors are known to be shared, so their rows needn't meet; all others are counted."""
    held = _anchors(docs, length, anchor, hottest_anchors(docs, length, anchor, hot))
    salt = F.when(F.col("parts") > 0, F.pmod("doc", F.lit(SALTS))).otherwise(0)
    n = F.count("*").over(Window.partitionBy("anchor", "salt"))
    shared = held.withColumn("salt", salt).withColumn("n", n).filter("n > 1 or parts > 0")
    parts = F.when(F.col("parts") > 0, F.col("parts")).otherwise(F.ceil(F.col("n") / hot).cast("int"))
    lists = shared.groupBy("doc").agg(F.collect_set(F.struct("anchor", parts.alias("parts"))).alias("a"))
    return lists.select("doc", F.col("a.anchor").alias("anchors"), F.col("a.parts").alias("parts"))


def whole_copies(docs: DataFrame) -> DataFrame:
    """(id, row, first) of the documents whose whole text a smaller id has, too, the smallest being first."""
    told = docs.select("id", "row", F.unhex(F.sha2("text", 256)).alias("digest"))
    first = written(told.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last"), "copies")
    return written(told.join(first, "digest").filter("id > first").select("id", "row", "first").distinct(), "copies")


def seed_rows(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """The places of shared anchors: anchor, parts, id, row, start (of the first window that has this place as its seed), lead
    (words before the place there), again, words (of all these windows, by lines). texts: id, row, text, anchors, parts.

    A document tells of equal words around an anchor once, at their first place; again says that others follow."""
    names = ("anchor", "parts", "id", "row", "start", "lead", "again", "words")

    def step(cols: dict) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in names}
        raw = encoded(cols["text"])
        for i, r, t, w, shared, dealt in zip(cols["id"], cols["row"], raw, _hashed(raw), cols["anchors"], cols["parts"]):
            runs = run_hashes(w, anchor, salt=1)
            seed = seed_places(runs, length - anchor + 1)
            if not len(seed):
                continue
            own = np.array(shared, np.int64).view(np.uint64)
            order = np.argsort(own)
            own, parts = own[order], np.array(dealt, np.int32)[order]
            begin = np.flatnonzero(np.diff(seed, prepend=-1))
            end = np.append(begin[1:], len(seed))
            value = runs[seed[begin]]
            at = np.minimum(np.searchsorted(own, value), len(own) - 1)
            held = np.flatnonzero(own[at] == value)
            begin, end, value, parts = begin[held], end[held], value[held].view(np.int64), parts[at[held]]
            words = [x if len(x) <= LONG else b" " + hashlib.blake2b(x, digest_size=32).hexdigest().encode() for x in t.split()]
            lines, stop = b"\n".join(words), np.cumsum([len(x) + 1 for x in words]) - 1
            low, high = np.append(0, stop[:-1] + 1)[begin].tolist(), stop[end + length - 2].tolist()
            known: dict[tuple[int, bytes], int] = {}
            for a, p, s, d, x, y in zip(value.tolist(), parts.tolist(), begin.tolist(), (seed[begin] - begin).tolist(), low, high):
                around = lines[x:y]
                first = known.setdefault((d, around), len(out["id"]))
                if first < len(out["id"]):
                    out["again"][first] = True
                    continue
                for k, v in zip(names, (a, p, i, r, s, d, False, around)):
                    out[k].append(v)
        yield out

    return arrow_map(texts, step, "anchor long, parts int, id long, row long, start int, lead int, again boolean, words binary")


class _Seed:
    """What a task has seen of one anchor, in the order of ids."""

    def __init__(self, length: int, anchor: int, most: int):
        self.length, self.anchor, self.most = length, anchor, most
        self.centre: tuple[int, int, list[bytes]] | None = None
        self.around: dict[tuple[int, bytes], list] = {}
        self.windows: dict[bytes, int] = {}

    def covered(self, lead: int, words: list[bytes]) -> range:
        """The windows that are equal to the centre's: those that lie in the words which extend the seed in both."""
        _, other, centre = self.centre
        n, a, b = self.anchor, 0, self.anchor
        if words[lead : lead + n] != centre[other : other + n]:
            return range(0)
        while a < min(lead, other) and words[lead - a - 1] == centre[other - a - 1]:
            a += 1
        while b < min(len(words) - lead, len(centre) - other) and words[lead + b] == centre[other + b]:
            b += 1
        return range(lead - a, max(lead - a, lead + b - self.length + 1))

    def firsts(self, id_: int, lead: int, around: bytes) -> list:
        """Runs (from, to, first) of windows with the first id that holds them, None where memory has ended."""
        known = self.around.get((lead, around))
        if known is not None:
            return known
        words = around.split(b"\n")
        n = len(words) - self.length + 1
        if self.centre is None:
            self.centre = (id_, lead, words)
        same, firsts = self.covered(lead, words), []
        for k in range(n):
            if k in same:
                first = self.centre[0]
            else:
                window = b"\n".join(words[k : k + self.length])
                first = self.windows.get(window)
                if first is None and len(self.windows) < self.most:
                    first = self.windows[window] = id_
            if firsts and firsts[-1][2] == first:
                firsts[-1][1] = k + 1
            else:
                firsts.append([k, k + 1, first])
        if len(self.around) < self.most and all(f[2] is not None for f in firsts):
            self.around[lead, around] = firsts
        return firsts


def repeats(seen: DataFrame, length: int, anchor: int, most: int) -> DataFrame:
    """(doc, id, row, start, end, again, first): runs of words that consist of windows which also start in a document with a
    smaller id, first. seen: as seed_rows() gives it.

    Where a hot anchor is dealt to several tasks, each passes on the windows of the first document in which it sees them,
    and these meet by digest; so do windows beyond what a task keeps."""
    rows = seen.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "id", "row", "start")
    out, arrow = schemas("id long, row long, start int, end int, again boolean, first long, low long, high long")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seed = None, None
        for batch in batches:
            for piece in pieces(batch):
                found: list[tuple] = []
                cols = (piece.column(n).to_pylist() for n in ("anchor", "salt", "parts", "id", "row", "start", "lead", "again", "words"))
                for a, salt, parts, i, r, start, lead, again, around in zip(*cols):
                    if now != (a, salt):
                        now, seed = (a, salt), _Seed(length, anchor, most)
                    for low, high, first in seed.firsts(i, lead, around):
                        if first is not None and first < i:
                            found.append((i, r, start + low, start + high - 1 + length, again, first, None, None))
                        elif first is None or parts > 1:
                            words = around.split(b"\n")
                            for k in range(low, high):
                                digest = hashlib.blake2b(b"\n".join(words[k : k + length]), digest_size=16).digest()
                                told = (int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True))
                                found.append((i, r, start + k, start + k + length, again, None, *told))
                columns = zip(*found) if found else [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    told = rows.mapInArrow(extend, out).withColumn("doc", _handle())
    # runs that are settled have no digest; they are dealt out by their places
    told = told.withColumn("low", F.coalesce("low", F.xxhash64("doc", "start")))
    least = F.min("id").over(Window.partitionBy("low", "high"))
    return told.withColumn("first", F.coalesce("first", least)).filter("id > first").select("doc", "id", "row", "start", "end", "again", "first")


def _all_places(raw: bytes, runs: list, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all windows in runs as repeats() gives them, in order, with others of the same words where a run
    stands for several; and the first of each."""
    sizes = [r["end"] - r["start"] - length + 1 for r in runs]
    at = np.concatenate([np.arange(r["start"], r["start"] + n) for r, n in zip(runs, sizes)])
    firsts = np.repeat([r["first"] for r in runs], sizes)
    if not any(r["again"] for r in runs):
        return at, firsts
    both = [run_hashes(next(_hashed([raw], seed)), length, salt=2).tobytes() for seed in (0, 1)]
    told = np.stack([np.frombuffer(b, np.uint64) for b in both], axis=1).copy().view("V16").ravel()  # two hashes of each window
    own, order = np.unique(told[at], return_index=True)
    near = np.minimum(np.searchsorted(own, told), len(own) - 1)
    places = np.flatnonzero(own[near] == told)
    return places, firsts[order[near[places]]]


def remove_repeats(df: DataFrame, length: int = 13, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text", hot: int = HOT, most: int = MOST) -> DataFrame:
    """Remove every word that lies in a window of `length` words which also starts in a document with a smaller id.

    Returns key, n_words, n_removed, text (kept words joined by one space), and of each maximal removed repeat its word
    positions in span_starts and span_ends and in span_firsts a smaller id that holds its first window. Words are
    runs without white space, unchanged; windows are judged on the input. Null texts count as empty; texts under
    `length` words lose nothing; an empty table gives none. Rows with a null key lose nothing and are no one's smaller
    document. Rows of one key don't make each other repeats: repeated ones get the same result, several texts of a key
    one each. Texts and single words may be of any length; other columns are ignored."""
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.select("id", F.xxhash64("text").alias("row"), "text")
    keyed = docs.filter("id is not null")
    copies = whole_copies(keyed).groupBy(_handle().alias("doc")).agg(F.collect_set(F.struct("id", "row", "first")).alias("c"))
    shared = shared_anchors(keyed, length, anchor, hot)
    same = lambda x: (x.id == F.col("id")) & (x.row == F.col("row"))
    # every join is on the one number by which the texts are dealt out, so that they are shuffled once
    by_id = keyed.withColumn("doc", _handle()).repartition("doc").join(copies, "doc", "left").withColumn("whole", F.get(F.filter("c", same), F.lit(0)).first).drop("c")
    texts = by_id.filter("whole is null").join(shared, "doc").select("id", "row", "text", "anchors", "parts")
    later = repeats(seed_rows(texts, length, anchor), length, anchor, most).groupBy("doc")
    later = later.agg(F.collect_set(F.struct("id", "row", "start", "end", "again", "first")).alias("r"))  # a set: rows may be repeated
    found = F.sort_array(F.transform(F.filter("r", same), lambda x: x.dropFields("id", "row")))

    def cut(cols: dict) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("id", "n_words", "n_removed", "text", "span_starts", "span_ends", "span_firsts")}
        for i, raw, runs, whole in zip(cols["id"], encoded(cols["text"]), cols["r"], cols["whole"]):
            words = raw.split()
            kept, n, starts, ends, holders = words, 0, [], [], []
            if whole is not None and len(words) >= length:
                kept, n, starts, ends, holders = [], len(words), [0], [len(words)], [whole]
            elif runs:
                at, firsts = _all_places(raw, runs, length)
                new = np.flatnonzero(np.diff(at, prepend=-length - 1) > length)  # windows that neither overlap nor adjoin
                begin, end = at[new], np.append(at[new[1:] - 1], at[-1]) + length
                kept, done = [], 0
                for a, b in zip(begin.tolist(), end.tolist()):
                    kept += words[done:a]
                    done = b
                kept += words[done:]
                n, starts, ends, holders = int((end - begin).sum()), begin.tolist(), end.tolist(), firsts[new].tolist()
            for k, v in zip(out, (i, len(words), n, b" ".join(kept).decode("utf-8", "surrogatepass"), starts, ends, holders)):
                out[k].append(v)
        yield out

    rows = by_id.join(later, "doc", "left").withColumn("r", found).select("id", "text", "r", "whole")
    void = docs.filter("id is null").select("id", "text", F.lit(None).cast(rows.schema["r"].dataType).alias("r"), F.lit(None).cast("long").alias("whole"))
    schema = "id long, n_words long, n_removed long, text string, span_starts array<int>, span_ends array<int>, span_firsts array<long>"
    return arrow_map(rows.union(void), cut, schema).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", key)
