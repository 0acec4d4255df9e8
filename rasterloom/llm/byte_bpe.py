"""Byte-level BPE encoding and decoding: the tokenizers library over Arrow batches, with the byte-to-character
table, offsets, and a decoder that reverses the table and handles characters split over ids."""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.common import arrow_map

#: Entries kept of the table piece -> ids before it starts anew; bounds a worker's memory.
CACHE_ENTRIES = 150_000
#: Characters of the longest piece that the table keeps.
CACHE_CHARS = 64
#: Texts within this set can use the standard library's regular expressions: letters, numbers and white space of the
#: first Unicode blocks are named outright below.
_PLAIN = re.compile("[\x00-ɏ‐-‧€]*")
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PLAIN_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def is_plain(text: str) -> bool:
    return text.isascii() or _PLAIN.fullmatch(text) is not None


@functools.lru_cache(16)
def members(escape: str) -> str:
    """The characters that tiktoken's own tables put into a class such as \\p{L}, as ranges for a bracket expression."""
    import tiktoken

    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    single = tiktoken.Encoding(escape, pat_str=escape, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    points = np.frombuffer(bytes(single.encode_ordinary(every)).decode("utf-8").encode("utf-32-le"), "<u4").astype(np.int64)
    first = np.flatnonzero(np.diff(points, prepend=-2) != 1)
    last = np.append(first[1:], len(points)) - 1
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(points[first].tolist(), points[last].tolist()))


def named_classes(pattern: str) -> str:
    """The pattern with its character classes spelt out by tiktoken's tables, for the standard library's expressions."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        m = re.compile(r"\\[pP]\{\w+\}|\\[sSdDwW]").match(pattern, at)
        if m:
            out.append(members(m[0]) if inside else f"[{members(m[0])}]")
            at = m.end()
            continue
        step = 2 if pattern[at] == "\\" else 1
        inside = (inside or pattern[at] == "[") and pattern[at] != "]"
        out.append(pattern[at : at + step])
        at += step
    return "".join(out)


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The two parts of each longer token: what merging by lower ranks leaves of it."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min(((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)), key=lambda x: x)
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class _Pieces(dict):
    """Piece -> its ids, made when first asked for; long pieces are made each time, so the table's bytes are bounded."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, piece: str):
        made = self.make(piece)
        if len(piece) <= CACHE_CHARS:
            self[piece] = made
        return made


class ByteBpe:
    """Encoder and decoder for one rank file; texts are split by the pattern and each match is encoded alone."""

    def __init__(self, path: str, pattern: str):
        import public_tokenizers
        from tokenizers.models import BPE

        ranks = read_ranks(path)
        chars = byte_characters()
        self.table = str.maketrans({chr(b): c for b, c in enumerate(chars)})
        named = lambda token: token.decode("latin-1").translate(self.table)
        self.model = BPE({named(t): r for t, r in ranks.items()}, [(named(a), named(b)) for a, b in merges_of(ranks)])
        back = {c: b for b, c in enumerate(chars)}
        self.bytes_of = {r: bytes(back[c] for c in self.model.id_to_token(r)) for r in ranks.values()}
        self.lengths = np.zeros(max(self.bytes_of) + 1, np.int64)
        for r, token in self.bytes_of.items():
            self.lengths[r] = len(token)
        self._pattern, self._general = pattern, None
        self._plain = re.compile(_PLAIN_PATTERN).findall if pattern == public_tokenizers.PATTERN else None
        self._cache = _Pieces(self._ids)

    def split(self, text: str) -> list[str]:
        """The matches of the pattern, as tiktoken's tables of characters give them."""
        if self._plain and is_plain(text):
            return self._plain(text)
        if self._general is None:
            self._general = re.compile(named_classes(self._pattern)).finditer
        return [m[0] for m in self._general(text)]

    def _ids(self, piece: str) -> tuple[tuple[int, ...], str]:
        chars = piece.encode("utf-8").decode("latin-1").translate(self.table)
        ids = tuple(t.id for t in self.model.tokenize(chars))
        return ids, " ".join(map(str, ids))

    def encoded(self, text: str | None) -> list[tuple[tuple[int, ...], str]]:
        """For each match of the pattern its ids, as numbers and as text."""
        if len(self._cache) > CACHE_ENTRIES:
            self._cache.clear()
        return list(map(self._cache.__getitem__, self.split(text or "")))

    def encode(self, text: str | None) -> list[int]:
        return list(itertools.chain.from_iterable(i for i, _ in self.encoded(text)))

    def offsets(self, ids: list[int], data: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Code-point starts and ends of the ids; ids that share a character all span that whole character."""
        sizes = self.lengths[np.array(ids, np.int64)]
        ends = np.cumsum(sizes)
        lead = np.frombuffer(self.decode_bytes(ids) if data is None else data, np.uint8) & 0xC0 != 0x80
        point = np.cumsum(lead)  # the code point of each byte: lead bytes count, the others belong to the last lead
        return point[ends - sizes] - 1, point[ends - 1]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Characters split over ids come together again; a character cut off at either end becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(4)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, offsets: bool = True) -> DataFrame:
    """Encode every whole text. Returns key, ids, starts and ends (code points of each id; null without offsets).

    Null and empty texts give empty lists; null keys stay; repeated rows give repeated results; texts may be of any
    length; other columns are ignored, whatever their names; an empty table gives none."""
    path, pattern = path or default_files()[0], pattern or default_files()[1]

    def step(cols: dict) -> Iterator[dict]:
        bpe = byte_bpe(path, pattern)
        ids = [bpe.encode(t) for t in cols["text"]]
        spans = [bpe.offsets(i) if offsets else None for i in ids]
        yield {"key": cols["key"], "ids": ids, "starts": [s and s[0] for s in spans], "ends": [s and s[1] for s in spans]}

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return arrow_map(rows, step, f"key {kind}, ids array<int>, starts array<int>, ends array<int>").withColumnRenamed("key", key)


def decode_column(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Decode lists of ids. Returns key, bytes, text (bytes that are no UTF-8 are replaced there).

    Null lists count as empty; null keys stay; repeated rows give repeated results; lists may be of any length; other
    columns are ignored, whatever their names; an empty table gives none."""
    path, pattern = path or default_files()[0], pattern or default_files()[1]

    def step(cols: dict) -> Iterator[dict]:
        bpe = byte_bpe(path, pattern)
        raw = [bpe.decode_bytes(i or []) for i in cols["ids"]]
        yield {"key": cols["key"], "bytes": raw, "text": [r.decode("utf-8", "replace") for r in raw]}

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return arrow_map(rows, step, f"key {kind}, bytes binary, text string").withColumnRenamed("key", key)


def round_trip_digests(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode every whole text, decode the ids again, and return counts and digests of both: key, n_tokens, ids_sha256,
    decoded_sha256 and offsets_crc32 (unsigned; the code-point start and end of each id, little-endian 32 bits each).

    Null and empty texts have no ids; repeated rows give repeated results; texts may be of any length; other columns are
    ignored; an empty table gives none."""
    path, pattern = path or default_files()[0], pattern or default_files()[1]

    def step(cols: dict) -> Iterator[dict]:
        bpe = byte_bpe(path, pattern)
        out: dict[str, list] = {"key": cols["key"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "offsets_crc32": []}
        for t in cols["text"]:
            got = bpe.encoded(t)
            ids = list(itertools.chain.from_iterable(i for i, _ in got))
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(" ".join([s for _, s in got]).encode()).hexdigest())
            data = bpe.decode_bytes(ids)
            out["decoded_sha256"].append(hashlib.sha256(data).hexdigest())
            out["offsets_crc32"].append(zlib.crc32(np.stack(bpe.offsets(ids, data), axis=1).astype("<u4").tobytes()))
        yield out

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return arrow_map(rows, step, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_crc32 long").withColumnRenamed("key", key)
