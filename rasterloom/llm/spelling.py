"""Spelling variants: the words of a corpus, those one edit apart, and the most frequent form of each.

Near words are found by dynamic programming over sorted lists. A list is scanned with one word: the banded rows of the
edit matrix are kept on a stack, a row for each character, so that the next word reuses those of its common prefix
with the word before; when a row has no entry of at most one edit, all words that share the prefix are skipped. A single
edit leaves the first or the last half of a word whole, so each word scans the words of its own first half in the list,
and those of its own last half in the list of reversed words. Spark sorts both lists into blocks and brings each word
to the few blocks that its half can lie in."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.common import CHUNK_BYTES, arrow_map, pieces, schemas, written

#: A-Z are lower-cased before; the second part are the two-byte characters from U+00C0 to U+00FF.
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
#: Words of a sorted block, about.
BLOCK = 20_000
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Code points of a block's first word that routing looks at.
HEAD = 64
_LAST = "\U0010ffff"


def _step(row: tuple[int, int, int], same: int) -> int:
    """The row below a banded row, as a number; entries above 1 count as 2. same: bits of the band's three characters."""
    a, b, c = row
    a = min(a + (not same & 4), b + 1, 2)
    b = min(b + (not same & 2), c + 1, a + 1, 2)
    c = min(c + (not same & 1), b + 1, 2)
    return 9 * a + 3 * b + c


#: Row and equal characters -> next row. A row is 9 a + 3 b + c for the distances of a prefix of d characters to the
#: query's prefixes of d - 1, d and d + 1.
_NEXT = [[_step((r // 9, r // 3 % 3, r % 3), same) for same in range(8)] for r in range(27)]
_DEAD = 26
#: The row of a prefix that equals the query's.
_EQUAL = 9 * 1 + 3 * 0 + 1


def count_words(df: DataFrame, every: int = 97, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all runs of letters, A-Z lower-cased; runs whose checksum with the key `every` divides lose a
    character. Counted inside tasks first, so a frequent word is a few rows in the shuffle. Null keys count as empty."""

    def step(cols: dict) -> Iterator[dict]:
        held: Counter = Counter()
        for key, text in zip(cols["key"], cols["text"]):
            begun = zlib.crc32(f"{key}:".encode("utf-8", "surrogatepass"))
            for part in _slices(text.encode("utf-8", "surrogatepass").lower()):
                for run, n in Counter(_RUN.findall(part)).items():
                    h = zlib.crc32(run, begun)
                    if h % every == 0:
                        word = run.decode()
                        at = h % len(word)
                        run = (word[:at] + word[at + 1 :]).encode()
                    held[run] += n
                if len(held) > HELD:
                    yield {"word": [w.decode() for w in held], "n": list(held.values())}
                    held.clear()
        yield {"word": [w.decode() for w in held], "n": list(held.values())}

    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return arrow_map(rows, step, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _slices(raw: bytes) -> Iterator[bytes]:
    """Parts of bounded size that cut no run, unless the run itself is longer."""
    at = 0
    while len(raw) - at > CHUNK_BYTES:
        end = at + CHUNK_BYTES
        while end < len(raw) and (97 <= raw[end] <= 122 or raw[end] >= 128):
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


class SortedList:
    """A sorted block of distinct words that is scanned with one word at a time."""

    def __init__(self, words: list[str]):
        self.words = words
        self.lcp = [0] * len(words)
        for i in range(1, len(words)):
            self.lcp[i] = _common(words[i - 1], words[i])

    def near(self, query: str, k: int) -> list[int]:
        """Places of the words that share the query's first k characters and are one edit away from it."""
        words, lcp, head, size, step, dead = self.words, self.lcp, query[:k], len(query), _NEXT, _DEAD
        i, end, found = bisect_left(words, head), bisect_left(words, head + _LAST), []
        q = query + "\0\0\0"  # matches no letter
        rows = [_EQUAL] * (k + 1)
        d = k  # rows[d] is right for the word at i
        while i < end:
            word = words[i]
            n = len(word)
            del rows[d + 1 :]
            row = rows[d]
            most = min(n, size + 1)
            while d < most:
                c = word[d]
                row = step[row][4 * (c == q[d - 1]) + 2 * (c == q[d]) + (c == q[d + 1])]
                d += 1
                if row == dead:
                    break
                rows.append(row)
            if row != dead and d == n and -2 < size - n < 2 and (row // 9, row // 3 % 3, row % 3)[1 + size - n] == 1:
                found.append(i)
            if row == dead or d < n:  # no word with these d characters is near
                i = bisect_left(words, word[:d] + _LAST, i + 1, end)
            else:
                i += 1
            if i < end:
                d = max(lcp[i], k)
        return found


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def may_hold(low: str, high: str | None, query: str, k: int) -> bool:
    """Whether a block between two words can hold one that is near: not, if the prefix they share is over one edit away."""
    if high is None:
        return True
    row, q = _EQUAL, query + "\0\0\0"
    for d in range(k, min(_common(low, high), len(query) + 1)):
        c = low[d]
        row = _NEXT[row][4 * (c == q[d - 1]) + 2 * (c == q[d]) + (c == q[d + 1])]
        if row == _DEAD:
            return False
    return True


def routes(lows: list[str], query: str) -> list[int]:
    """The blocks, given by the first HEAD characters of their first words, where words that share the query's first
    half and are near it can be."""
    k = len(query) // 2
    head = query[:k][:HEAD]
    first, last = max(bisect_left(lows, head) - 1, 0), bisect_left(lows, head + _LAST) - 1
    if first >= last:
        return [first]
    # the test needs prefixes that reach past the half that is equal anyway
    ends = [*lows[1:], None]
    return [b for b in range(first, last + 1) if not lows[b].startswith(head) or may_hold(lows[b], ends[b], query, k)]


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each word of (word, n) that has near words: word, n_near, best (struct of less, form: the near word of
    largest n and of these the smallest). Words are distinct and have four characters or more.

    Both sorted lists are range-partitioned from a sample into blocks of about `block` words; what is collected is the
    first characters of each block's first word."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("s")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("s")))
    both = vocabulary.select(F.explode(sides).alias("x"), "n").select("x.side", "x.s", "n")
    n_blocks = max(1, -(-2 * vocabulary.count() // block))
    lists = written(both.repartitionByRange(n_blocks, "side", "s").withColumn("part", F.spark_partition_id()), "lists")
    firsts = lists.groupBy("side", "part").agg(F.min("s").alias("s")).select("side", "part", F.substring("s", 1, HEAD).alias("s")).orderBy("side", "part").collect()
    blocks = [[r for r in firsts if r.side == side] for side in (0, 1)]
    lows, parts = [[r.s for r in b] for b in blocks], [[r.part for r in b] for b in blocks]

    def deal(cols: dict) -> Iterator[dict]:
        out: dict[str, list] = {"side": [], "part": [], "s": [], "n": []}
        for side, s, n in zip(cols["side"], cols["s"], cols["n"]):
            for b in routes(lows[side], s):
                for k, v in zip(out, (side, parts[side][b], s, n)):
                    out[k].append(v)
        yield out

    asked = arrow_map(lists.select("side", "s", "n"), deal, "side int, part int, s string, n long").withColumn("asks", F.lit(True))
    met = lists.withColumn("asks", F.lit(False)).unionByName(asked).repartition(n_blocks, "side", "part").sortWithinPartitions("side", "part", "asks", "s")
    out, arrow = schemas("word string, n_near long, less long, form string")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, counts, held = None, [], [], None
        for batch in batches:
            for piece in pieces(batch):
                made = []
                for side, part, s, n, asks in zip(*(piece.column(i).to_pylist() for i in range(5))):
                    if (side, part) != now:
                        now, words, counts, held = (side, part), [], [], None
                    if not asks:
                        words.append(s)
                        counts.append(n)
                        continue
                    if held is None:
                        held = SortedList(words)
                    k = len(s) // 2
                    found = held.near(s, k)
                    if side:  # what shares the first half as well is found in the other list
                        tail = s[len(s) - k :]
                        found = [i for i in found if not words[i].endswith(tail)]
                    if found:
                        less, form = min((-counts[i], words[i][::-1] if side else words[i]) for i in found)
                        made.append((s[::-1] if side else s, len(found), less, form))
                cols = list(zip(*made)) or [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    told = met.select("side", "part", "s", "n", "asks").mapInArrow(scan, out)
    return told.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last. Each round doubles the steps that are taken; a
    form is at least twice as frequent as its word, so there are few."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onto"))
        # every form of a form moves one on; without any, all roots are last
        if now.join(onward, "root", "left_semi").isEmpty():
            return now
        now = written(now.join(onward, "root", "left").select("word", F.coalesce("onto", "root").alias("root")), "roots")


def variant_groups(df: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2, every: int = 97, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of at least min_length code points that occur min_count times or more, each with its form and root.

    Returns word, form, root, n, n_near, form_n. Words are maximal runs of letters (A-Z lower-cased; null texts have none);
    a run whose checksum `<key>:<run>` is divisible by `every` loses one character, which makes misspellings to find.
    A form is the near word of largest n (of these the smallest) if that is at least ratio times the word's, else null;
    root is the last form, or the word itself. Repeated rows count each, a null key as an empty one; words and texts
    may be of any length; other columns are ignored; an empty table gives none."""
    words = count_words(df, every, key, text).filter((F.length("word") >= min_length) & (F.col("n") >= min_count))
    words = written(words, "words")
    near = written(near_words(words), "near")
    own = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    good = F.col("form_n") >= ratio * F.col("n")
    own = written(own.select("word", "n", "n_near", F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")), "forms")
    last = roots(own.filter("form is not null"))
    return own.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
