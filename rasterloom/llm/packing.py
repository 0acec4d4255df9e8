"""Packing: documents become tokens, are cut into pieces, and the pieces are placed into sequences by the
sum-of-squares rule: each goes to the fill level that keeps the sum of squared counts of partially filled
sequences smallest; the counts live in a level array."""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.llm.byte_bpe import byte_characters
from rasterloom.llm.common import pieces as slices, schemas

#: Ends each word in marked texts; texts that hold it themselves take the slow way.
END = "\x00"
#: Texts of these characters, lower-cased, need no Unicode normalisation and mean the same to every regular-expression
#: engine in use; the dotted capital I, whose lower case is two characters, is left out.
_PLAIN = "(?s)[\\x01-\\u012F\\u0131-\\u024F\\u2010-\\u2027\\u20AC]*+"
_SPACES = "\\t-\\r \\x85\\xA0"


def marked(text: Column) -> Column:
    """The lower-cased text with END after each pre-token of the word vocabulary; null for texts that need the
    library's own normalisation."""
    low = F.lower(text)
    words = F.regexp_replace(low, f"('s|'t|'re|'ve|'m|'ll|'d|\\p{{L}}+|\\p{{N}}|[^{_SPACES}\\p{{L}}\\p{{N}}]+)", f"$1{END}")
    return F.when(text.rlike(f"\\A{_PLAIN}\\z") & ~text.contains("<|"), words)


class WordBpe:
    """Ids of the lower-case BPE vocabulary with word ends."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            model = json.load(f)["model"]
        back = {c: b for b, c in enumerate(byte_characters())}
        suffix = model["end_of_word_suffix"]
        ranks = {}
        for token, i in model["vocab"].items():
            word = token.removesuffix(suffix)
            if all(c in back for c in word) and not token.startswith("<|"):
                ranks[bytes(back[c] for c in word) + (END.encode() if token.endswith(suffix) else b"")] = i
        # the merged pair decides by its own rank, as the merge list does: ids run in the order of the merges
        self.fast = tiktoken.Encoding(path, pat_str="[^\\x00" + "\\t-\\r \\x{85}\\x{A0}" + "]+\\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str], words: list[str | None]) -> list[list[int]]:
        out = [None if w is None else self.fast(w) for w in words]
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = self.library.encode(texts[i], add_special_tokens=False).ids
        return out


@functools.lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


class SquarePacker:
    """Sum-of-squares packing of one task's documents.

    Every remainder of a document is placed by the rule, however many sequences are open; what the rule has left open
    when the task ends is poured together."""

    def __init__(self, task: int, size: int):
        self.size, self.next = size, task << 40
        self.levels = np.zeros(size + 1, np.int64)  # partly filled sequences at each fill
        self.open: list[list[list]] = [[] for _ in range(size + 1)]  # their pieces
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.size
        for at in range(0, whole, self.size):
            self._close([(doc, at, ids[at : at + self.size], n)])
        if n > whole:
            self._place((doc, whole, ids[whole:].copy(), n))

    def best_level(self, s: int) -> int:
        """The level whose sequence a piece of s tokens joins, 0 for a new one: the least sum of squared counts of
        partly filled sequences, of equal ones the fullest."""
        levels, top = self.levels, self.size - s
        # change of the sum of squares when a sequence moves from level h to h + s; new and full ones don't count
        change = 2 * levels[s : self.size + 1] + 1
        change[top] = 0
        change[1:] += 1 - 2 * levels[1 : top + 1]
        usable = levels[: top + 1] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        return int(np.flatnonzero(change == change.min())[-1])

    def _place(self, piece: tuple) -> None:
        s = len(piece[2])
        h = self.best_level(s)
        pieces = self.open[h].pop() if h else []
        if h:
            self.levels[h] -= 1
        pieces.append(piece)
        if h + s == self.size:
            self._close(pieces)
        else:
            self.open[h + s].append(pieces)
            self.levels[h + s] += 1

    def _close(self, pieces: list[tuple], poured: bool = False) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at, poured))
            at += len(ids)
        self.next += 1

    def finish(self) -> None:
        """Cut what partly filled sequences hold anew: full sequences, then a remainder in powers of two."""
        left = [p for level in reversed(self.open) for pieces in level for p in pieces]
        self.levels[:] = 0
        self.open = [[] for _ in range(self.size + 1)]
        tokens = sum(len(p[2]) for p in left)
        rest = tokens % self.size
        sizes = iter([self.size] * (tokens // self.size) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1])
        goal, pieces, filled = next(sizes, None), [], 0
        for doc, start, ids, total in left:
            while len(ids):
                take = min(goal - filled, len(ids))
                pieces.append((doc, start, ids[:take], total))
                start, ids, filled = start + take, ids[take:], filled + take
                if filled == goal:
                    self._close(pieces, poured=True)
                    pieces, filled, goal = [], 0, next(sizes, None)

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(df: DataFrame, path: str | None = None, size: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents. Returns a row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and poured (not placed by the rule).

    Each task packs its own input rows, so nothing is shuffled and a task that is run again gives the same rows.
    A document of more than `size` tokens fills sequences of its own, its remainder is placed by the rule. At the
    end of a task the sequences that the rule has left partly filled are poured together and the last few tokens go to
    sequences of a power of two, so none needs padding; until then a task holds their ids, at most those of its input.
    Null and empty texts are the end id alone; null keys are packed like others; repeated rows are packed each; texts may
    be of any length; other columns are ignored; an empty table gives no pieces."""
    import public_tokenizers
    import pyarrow as pa
    from pyspark import TaskContext

    path = path or public_tokenizers.path("word_bpe_49k.json")
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, poured boolean"
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("words", marked(F.col("text"))).withColumn("text", F.when(F.col("words").isNull(), F.col("text")))
    out_schema, arrow = schemas(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = word_bpe(path), SquarePacker(TaskContext.get().partitionId(), size)

        def ready() -> pa.RecordBatch:
            cols = list(zip(*packer.take())) or [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in batches:
            for piece in slices(batch):
                keys, texts, words = (piece.column(i).to_pylist() for i in range(3))
                for k, ids in zip(keys, bpe.encode(texts, words)):
                    packer.add(k, np.array([*ids, end_id], np.uint32))
                yield ready()
        packer.finish()
        yield ready()

    return rows.mapInArrow(run, out_schema).withColumnRenamed("key", key)
