"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised test items reads every document
once; what it meets is mapped back to the original text.

The automaton's letters are words: each word of the items has a number, all others share one that is in no window."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.common import CHUNK_BYTES, arrow_map, identity, written

WINDOW = 10
#: Bytes of the windows in one automaton, about; a worker holds some ten times as much. More items make further passes.
BLOCK_BYTES = 16_000_000
_RUNS = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"
#: After A-Z are lower-cased, all other ASCII characters but digits and letters separate words.
_BLANK = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().translate(_BLANK).split()


def item_windows(items: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, body, size): the distinct windows of each item, words joined by a space; an item of fewer words, but not
    none, is one."""

    def step(cols: dict) -> Iterator[dict]:
        for item, text in zip(cols["item"], cols["text"]):
            words = words_of(text.encode("utf-8", "surrogatepass"))
            for at in range(0, max(len(words) - window + 1, min(len(words), 1)), 10_000):
                last = min(at + 10_000, max(len(words) - window + 1, 1))
                made = list({b" ".join(words[i : i + window]) for i in range(at, last)})
                yield {"item": [item] * len(made), "body": [m.decode("utf-8", "surrogatepass") for m in made], "size": [m.count(b" ") + 1 for m in made]}

    rows = items.select(F.col(key).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return arrow_map(rows, step, "item string, body string, size int").distinct()


class Automaton:
    """Finds windows in a document's words."""

    def __init__(self, windows: list[tuple[str | None, str]]):
        self.ids: dict[bytes, int] = {}
        self.items: list[set] = []
        self.sizes: list[int] = []
        place: dict[tuple, int] = {}
        for item, body in windows:
            letters = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in body.encode("utf-8", "surrogatepass").split(b" "))
            at = place.setdefault(letters, len(place))
            if at == len(self.items):
                self.items.append(set())
                self.sizes.append(len(letters))
            if item is not None:
                self.items[at].add(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for letters, at in place.items():
            self.machine.add_word(letters, at)
        if place:
            self.machine.make_automaton()

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, the hit words as disjoint runs (first, after the last), and the items met.

        Very long texts are read in slices; the automaton keeps its state from one to the next."""
        n, ends, search, begun = 0, [], None, 0
        get = self.ids.get
        for part in _slices(raw):
            letters = tuple([get(w, 0) for w in words_of(part)])
            if not self.sizes or not any(letters):  # no window goes on or begins here
                search = None if letters else search
            elif search is None:
                search, begun = self.machine.iter(letters), n
                ends += [(begun + i, at) for i, at in search]
            else:
                search.set(letters, False)  # places go on from the slice before
                ends += [(begun + i, at) for i, at in search]
            n += len(letters)
        if not ends:
            return n, [], set()
        met = {at for _, at in ends}
        items = set().union(*(self.items[at] for at in met))
        change = np.zeros(n + 1, np.int64)
        last = np.array([e for e, _ in ends], np.int64) + 1
        first = last - np.array([self.sizes[at] for _, at in ends], np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, last, -1)
        edge = np.flatnonzero(np.diff(np.cumsum(change) > 0, prepend=False))
        return n, list(zip(edge[::2].tolist(), edge[1::2].tolist())), items


def _slices(raw: bytes) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > CHUNK_BYTES:
        end = at + CHUNK_BYTES
        while end < len(raw) and _BLANK[raw[end] | (32 if 65 <= raw[end] <= 90 else 0)] != 32:
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def places(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point places in the original text of runs of words."""
    if not runs:
        return []
    data = np.frombuffer(raw.lower().translate(_BLANK), np.uint8)
    edge = np.diff(data == 32, prepend=True, append=True).nonzero()[0]
    starts, ends = edge[::2], edge[1::2]
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])  # code points up to each byte
    return [(int(before[starts[a]]), int(before[ends[b - 1]])) for a, b in runs]


#: The automaton that this worker has built last, by the name of its windows.
_machines: dict[str, Automaton] = {}


def _held(name: str, windows) -> Automaton:
    if name not in _machines:
        _machines.clear()
        _machines[name] = Automaton(windows.value)
    return _machines[name]


def _scans(rows: DataFrame, windows: list[tuple[str | None, str]]) -> DataFrame:
    """One pass over all rows (key, row, text) with one automaton, whose windows are of bounded size.

    Returns key, row, n_words, runs (hit words and their places in the text) and items."""
    sent, name = rows.sparkSession.sparkContext.broadcast(windows), uuid.uuid4().hex

    def step(cols: dict) -> Iterator[dict]:
        machine, out = _held(name, sent), {k: [] for k in ("key", "row", "n_words", "runs", "items")}
        for key, row, text in zip(cols["key"], cols["row"], cols["text"]):
            raw = text.encode("utf-8", "surrogatepass")
            n, runs, items = machine.scan(raw)
            found = [{"first": a, "last": b, "start": c, "end": d} for (a, b), (c, d) in zip(runs, places(raw, runs))]
            for k, v in zip(out, (key, row, n, found, sorted(items))):
                out[k].append(v)
        yield out

    kind = rows.schema["key"].dataType.simpleString()
    return arrow_map(rows, step, f"key {kind}, row string, n_words long, runs {_RUNS}, items array<string>")


def _joined(runs: list[dict]) -> list[dict]:
    """Runs of several automatons as disjoint ones."""
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: r["first"]):
        if out and r["first"] <= out[-1]["last"]:
            if r["last"] > out[-1]["last"]:
                out[-1] |= {"last": r["last"], "end": r["end"]}
        else:
            out.append(dict(r))
    return out


def decontaminate(df: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block: int = BLOCK_BYTES) -> DataFrame:
    """For each document which of its words lie inside a window of `window` words of a test item.

    Returns key, n_words, n_hit, n_items, items (ids as strings, sorted), span_starts and span_ends (code points of the
    original text, one for each maximal run of hit words), contaminated. A-Z are lower-cased; words are runs of
    digits, letters and characters beyond ASCII; an item of fewer words than a window, but not none, is one window.

    Null texts have no words. A null item id's windows hit words, but it isn't listed; an id of several texts is listed
    once. Repeated rows and null keys get results of their own; texts may be of any length; other columns are ignored;
    without documents there are no rows, without items no hits. The windows are measured first: those of up to `block`
    bytes make one automaton and one pass without a shuffle, more are dealt into blocks with a pass each, and only the
    documents that are hit meet again."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), identity(F.col(key), F.col(text)).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    windows = written(item_windows(items, window, item, item_text), "windows")
    size = windows.agg(F.sum(F.octet_length("body") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    n_blocks = max(1, -(-size // block))
    dealt = windows.withColumn("block", F.pmod(F.xxhash64("item", "body"), F.lit(n_blocks)))
    sets = ([(r.item, r.body) for r in dealt.filter(F.col("block") == b).collect()] for b in range(n_blocks))
    found = _scans(rows, next(sets))
    if n_blocks > 1:
        found = written(found, "scans")
        hits = [found.filter("size(runs) > 0").select("row", "runs", "items").distinct()]
        hits += [written(_scans(rows, s).filter("size(runs) > 0").select("row", "runs", "items").distinct(), "scans") for s in sets]
        hit = functools.reduce(DataFrame.union, hits).groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

        def step(cols: dict) -> Iterator[dict]:
            yield cols | {"runs": [_joined(r) for r in cols["runs"]]}

        hit = arrow_map(hit, step, f"row string, runs {_RUNS}, items array<string>")
        none = found.select("key", "row", "n_words").join(hit, "row", "left")
        found = none.withColumns({"runs": F.coalesce("runs", F.array().cast(_RUNS)), "items": F.coalesce("items", F.array().cast("array<string>"))})
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return found.select(
        F.col("key").cast(kind).alias(key), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        F.col("runs.start").alias("span_starts"), F.col("runs.end").alias("span_ends"), (n_hit > 0).alias("contaminated"),
    )
