"""Every operator against a plain Python version, on the smallest tables with odd cases added."""

import random
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rasterloom.llm import byte_bpe, chat, exact_dedup, media, minhash, packing, pii, quality, substring_dedup, token_counts  # noqa: E402

EMPTY = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return brute.documents(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def clashing(spark):
    """Columns whose names the operators use inside, nulls in the key, repeated rows."""
    same = (5, "same text of a repeated row +15551234567 and more words than thirteen in this one so that it has windows", 1, "x", 2)
    data = [(None, "nobody's text", 1, "x", 2), (None, None, None, None, None), same, same, (6, "other", 1, "x", 2)]
    return spark.createDataFrame(data, "doc_id long, text string, n long, id string, kept int").withColumns({c: F.lit(1) for c in ("start", "body", "row", "signature", "key", "words", "n_bytes", "name", "__text", "component", "cuts", "__id", "__row", "__key", "__y", "whole", "own", "own_row", "at", "parts", "member", "n_chars", "score")})


def test_substring(docs, rows, monkeypatch):
    got = {r.doc_id: (r.n_words, r.n_removed, r.s) for r in substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("s")).collect()}
    assert got == brute.substring(rows)
    monkeypatch.setattr(substring_dedup, "OFTEN", 3)
    hot = substring_dedup.remove_repeats(docs, hot=3).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("s"))
    assert {r.doc_id: (r.n_words, r.n_removed, r.s) for r in hot.collect()} == got


@pytest.mark.parametrize("hot, most", [(20_000, 200_000), (2, 200_000), (20_000, 3), (3, 2)])
def test_substring_extends(spark, hot, most):
    """Texts of few words, so that a seed meets many others around it: extended, looked up, dealt to tasks, and without memory."""
    pick = random.Random(7)
    word = lambda: pick.choice("ab") if pick.random() < 0.8 else pick.choice(["c" * 70, "c" * 71])
    pool, texts = [word() for _ in range(300)], []
    for _ in range(60):  # pieces of one pool with single words changed, so that repeats begin and end at any place
        parts = [pool[at : at + pick.randrange(8, 40)] for at in (pick.randrange(280) for _ in range(pick.randrange(5)))]
        texts.append([word() if pick.random() < 0.05 else w for part in parts for w in part])
    texts += [["a"] * n for n in (12, 13, 40)] + [list("ab") * n for n in (6, 7, 30)] + [texts[3][5:] + texts[4][:40], texts[5] + texts[5]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    pick.shuffle(rows)
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot, most=most)
    got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.text)) for r in out.collect()}
    assert got == brute.substring(rows)
    assert sum(n > 0 for _, n, _ in got.values()) > 10


def test_seed_places():
    import numpy as np

    runs = np.array([5, 3, 3, 9, 1, 1, 1, 7, 8, 2, 2, 6], np.uint64)
    for width in range(1, 13):
        assert substring_dedup.seed_places(runs, width).tolist() == [i + int(runs[i : i + width].argmin()) for i in range(13 - width)]
    assert len(substring_dedup.seed_places(runs, 13)) == 0


def test_substring_spans(spark):
    df = spark.createDataFrame([(1, brute.PASSAGE), (2, f"a b {brute.PASSAGE} c"), (2, brute.PASSAGE), (2, f"a b {brute.PASSAGE} c"), (None, brute.PASSAGE)], "doc_id int, text string")
    out = substring_dedup.remove_repeats(df).collect()
    first, *two, void = sorted(out, key=lambda r: (r.doc_id is None, r.doc_id or 0, len(r.text)))
    assert (first.n_removed, void.n_removed, void.text) == (0, 0, brute.PASSAGE)
    assert [(r.span_starts, r.span_ends, r.span_firsts, r.text) for r in two] == [([0], [15], [1], ""), ([2], [17], [1], "a b c"), ([2], [17], [1], "a b c")]


def test_pii(docs, rows):
    got = {r.doc_id: r for r in pii.span_digests(docs).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        want = brute.base_spans(t)
        names = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        assert [got[k][f"n_{x}"] for x in pii.KINDS] == [sum(w[0] == x for w in want) for x in pii.KINDS], (k, names)
        assert got[k].base_sha256 == brute.sha(names), (k, names, got[k].spans)
        assert set(names.split(",")) - {""} <= set(got[k].spans.split(","))


def test_pii_context(spark):
    said = [(i, f"please ring phone desk +1555{1000000 + i} today") for i in range(40)]
    df = spark.createDataFrame([*said, (100, "please ring phone desk 555-0199 today"), (101, "there were 555-0199 of them")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.span_digests(df).collect()}
    assert got[100] == "phone:23:31" and got[101] == ""
    masked = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert masked[100] == "please ring phone desk [PHONE] today" and masked[101] == "there were 555-0199 of them" and masked[3] == masked[100]


def test_pii_context_spans(spark):
    """After learned contexts identifiers of several tokens are found whole, and those without a digit too."""
    said = [(i, f"please ring phone desk +1555{1000000 + i} today") for i in range(40)]
    cards = [n for n in range(4000_0000_0000_0000, 4000_0000_0000_0400) if sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(str(n)[::-1])) % 10 == 0]
    said += [(100 + i, f"please pay by card number {n} today") for i, n in enumerate(cards)]
    said += [(1000 + i, f"please write to mailbox name{i}@example.org today") for i in range(40)]
    odd = {
        5000: ("please ring phone desk (555) 010-1999 today", "phone", "(555) 010-1999"),
        5001: ("please ring phone desk 555 010 1999, or come", "phone", "555 010 1999"),
        5002: ("please ring phone desk 555 - 010 - 1999 today", "phone", "555 - 010 - 1999"),
        5003: ("please pay by card number 4111 1111 1111 1112 today", "card", "4111 1111 1111 1112"),
        5004: ("please pay by card number 4111-1111 1111-1112 12/27", "card", "4111-1111 1111-1112"),
        5005: ("please write to mailbox jane.doe[at]example.org today", "email", "jane.doe[at]example.org"),
        5006: ("please write to mailbox jane.doe(at)example.org.", "email", "jane.doe(at)example.org"),
        5007: ("please ring phone desk 555-0199 3 times", "phone", "555-0199"),
        5008: ("there were (555) 010-1999 of them, jane.doe[at]example.org said", None, None),
    }
    df = spark.createDataFrame([*said, *((k, v[0]) for k, v in odd.items())], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.span_digests(df).collect()}
    masked = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for k, (text, kind, hit) in odd.items():
        if kind:
            at = text.index(hit)
            assert (got[k], masked[k]) == (f"{kind}:{at}:{at + len(hit)}", text.replace(hit, f"[{kind.upper()}]")), k
    assert got[5008] == "" and masked[5008] == odd[5008][0]


def test_pii_secrets(spark):
    """Values of credentials are found, and the contexts they teach find others."""
    said = [(i, f'then {("api_token", "TOKEN")[i % 2]} = "{brute.sha(str(i))[:40]}" and more of it, token issued for build {i}') for i in range(20)]
    odd = {100: ('now TOKEN = "ab12-cd34" and more', "ab12-cd34"), 101: ("now password=hunter2hunter2hunter2. then", "hunter2hunter2hunter2"), 102: ("the commit ab12cd34ef56ab12cd34 of it", None), 103: ("the token = value of it", None)}
    df = spark.createDataFrame([*said, *((k, t) for k, (t, _) in odd.items())], "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.n_found) for r in pii.span_digests(df).collect()}
    for k, (t, hit) in odd.items():
        assert got[k] == ((f"secret:{t.index(hit)}:{t.index(hit) + len(hit)}", 1) if hit else ("", 0)), k
    assert all(got[i][0].startswith("secret:") for i in range(20))
    # 100's value is found by its learned context, 101's by the rule alone
    assert {r.doc_id: (r.n_found, r.n_graph) for r in pii.span_digests(df).filter("doc_id >= 100").collect()} == {100: (1, 1), 101: (1, 0), 102: (0, 0), 103: (0, 0)}


def test_pii_unseen(spark):
    """Identifiers that no base pattern finds, in contexts that seeds teach: recall and precision of the discovery."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    frames = {"phone": "call the office at {} before", "email": "send it to mailbox {} for", "ip": "host address: {} answered"}
    seen = {"phone": lambda: f"+1 {rng.randrange(200, 999)} 555 {rng.randrange(1000, 9999)}", "email": lambda: f"{word()}@mail.example.org", "ip": lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4))}
    unseen = {"phone": lambda: rng.choice(("555-{}", "(212) 555-{}", "212 555 {}")).format(rng.randrange(1000, 9999)), "email": lambda: f"{word()}{rng.choice(('(at)', '[at]'))}example.org", "ip": lambda: f"fe80::{rng.randrange(1, 99)}:ab:{rng.randrange(1, 9)}"}
    data, want = [], set()
    for i in range(900):
        kind = ("phone", "email", "ip")[i % 3]
        new = i >= 450
        value, a, b = (unseen if new else seen)[kind](), prose(20), prose(20)
        before = f"{a} {frames[kind].split('{}')[0]}"
        data.append((i, f"{before}{value}{frames[kind].split('{}')[1]} {b}"))
        if new:
            want.add((i, f"{kind}:{len(before)}:{len(before) + len(value)}"))
    data += [(1000 + i, f"{prose(10)} {rng.choice((f'{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}', str(rng.randrange(10**7)), f'v{i}.{i % 7}'))} {prose(10)}") for i in range(600)]
    found = {(r.doc_id, s) for r in pii.span_digests(spark.createDataFrame(data, "doc_id long, text string")).filter("n_found > 0").collect() for s in r.spans.split(",")}
    assert len(found & want) >= 0.98 * len(want) and len(found & want) >= 0.98 * len(found)


def test_pii_long_tokens(spark):
    """Tokens of 3 MB of any sort take seconds, not hours."""
    import time

    n = 3_000_000
    long = ["1" * n, "." * n, "+" * n, "1." * (n // 2), "+1" * (n // 2), "1-" * (n // 2), "a@" * (n // 2), "(" * n, '"' * n + "1", "1 " * (n // 2), "token=" + "a1" * (n // 2), "1" * 600, "(at)" * (n // 4), "x" * n]
    said = [(i, f"please ring phone desk +1555{1000000 + i} today") for i in range(40)]
    df = spark.createDataFrame([*said, *((100 + i, f"please ring phone desk {t} today") for i, t in enumerate(long))], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.spans for r in pii.span_digests(df).collect()}
    assert time.time() - began < 300
    assert got[100] == "" and got[111] == "" and got[110] == f"secret:29:{29 + 2 * (n // 2)}"


def test_redact(docs, rows):
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for k, t in rows:
        text, spans = t or "", sorted((b, c, a) for a, b, c in brute.base_spans(t))
        if not spans:
            assert got[k] == t
            continue
        out, at, i = "", 0, 0
        while i < len(spans):
            b, c, kind = spans[i]
            while i + 1 < len(spans) and spans[i + 1][0] < c:
                i += 1
                c = max(c, spans[i][1])
            out, at, i = out + text[at:b] + f"[{kind.upper()}]", c, i + 1
        if k != 9_000_012 and k != 9_000_013:  # overlapping spans: the first kind differs by order
            assert got[k] == out + text[at:], k


def test_media(docs, rows):
    got = {r.doc_id: r for r in media.media_digests(docs).collect()}
    for k, t in rows:
        raw = (t or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), brute.sha(full), zlib.crc32(full[-64:]))
    tile = media.media_columns(docs.limit(3)).first()
    assert tile.tile[:6] == b"\x93NUMPY" and bytes(media.decode(bytes(tile.media)).tobytes()) == bytes(tile.payload)


def test_image_formats():
    """All Netpbm kinds, 16-bit samples and BMP layouts, each against bytes written by hand."""
    import numpy as np

    a = np.arange(15, dtype=np.uint8).reshape(3, 5) * 17
    rgb = np.stack([a, 255 - a, a // 2], axis=2)
    bits = a > 100
    assert (media.decode(b"P1\n# c\n5 3\n" + b" ".join(str(int(b)).encode() for b in bits.ravel())) == np.where(bits, 0, 255)).all()
    assert (media.decode(b"P2 5 3 #x\n255\n" + b" ".join(str(v).encode() for v in a.ravel())) == a).all()
    assert (media.decode(b"P3\n5 3\n255\n" + b" ".join(str(v).encode() for v in rgb.ravel())) == rgb).all()
    assert (media.decode(b"P4\n5 3\n" + np.packbits(bits, axis=1).tobytes()) == np.where(bits, 0, 255)).all()
    assert (media.decode(media.encode_pgm(a)) == a).all() and (media.decode(media.encode_ppm(rgb)) == rgb).all()
    wide = a.astype(">u2") * 257
    assert (media.decode(b"P5\n5 3\n65535\n" + wide.tobytes()) == wide).all()
    assert (media.decode(media.encode_bmp(a)) == a).all() and (media.decode(media.encode_bmp(rgb)) == rgb).all()

    def bmp(height, depth, body, palette=b"", packed=0):
        import struct

        start = 54 + len(palette)
        return struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, 5, height, 1, depth, packed, len(body), 0, 0, len(palette) // 4, 0) + palette + body

    four = np.concatenate([rgb[:, :, ::-1], np.zeros((3, 5, 1), np.uint8)], axis=2)
    assert (media.decode(bmp(-3, 32, four.tobytes())) == rgb).all() and (media.decode(bmp(3, 32, four[::-1].tobytes())) == rgb).all()
    colours = np.array([[10, 20, 30], [40, 50, 60], [70, 80, 90]], np.uint8)
    index = (a % 3).astype(np.uint8)
    palette = b"".join(bytes((*c[::-1], 0)) for c in colours.tolist())
    assert (media.decode(bmp(-3, 8, np.pad(index, ((0, 0), (0, 3))).tobytes(), palette)) == colours[index]).all()
    for broken in (b"", b"P9 1 1", b"P5\n5 3\n255\nab", b"BMxx", bmp(3, 1, b"")):
        with pytest.raises(ValueError):
            media.decode(broken)


def test_area_resize():
    """Against the mean over each cell's exact area, summed pixel by pixel."""
    import numpy as np

    rng = np.random.default_rng(4)
    for h, w, out_h, out_w in ((7, 11, 3, 4), (5, 5, 8, 9), (1, 64, 8, 9), (40, 3, 32, 32)):
        a = rng.integers(0, 256, (h, w)).astype(np.uint8)
        want = np.zeros((out_h, out_w))
        for i in range(out_h):
            for j in range(out_w):
                top, low, left, right = i * h / out_h, (i + 1) * h / out_h, j * w / out_w, (j + 1) * w / out_w
                for r in range(h):
                    for c in range(w):
                        share = max(0, min(low, r + 1) - max(top, r)) * max(0, min(right, c + 1) - max(left, c))
                        want[i, j] += a[r, c] * share / ((low - top) * (right - left))
        assert np.allclose(media.area_resize(a, out_h, out_w), want)
        small = media.area_resize(a, 8, 9)
        bits = "".join(str(int(small[i, j + 1] > small[i, j])) for i in range(8) for j in range(8))
        assert media.difference_hash(a) == f"{int(bits, 2):016x}"
        import io

        tile = np.load(io.BytesIO(media.npy_tile(a)))
        assert tile.shape == (32, 32) and np.abs(tile - media.area_resize(a, 32, 32)).max() <= 0.5


def test_decoded_column(spark):
    """Broken files give an error text, not a failed job."""
    import numpy as np

    good = media.encode_ppm(np.zeros((4, 6, 3), np.uint8))
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"P5\n9")), (3, None), (4, bytearray())], "id long, data binary")
    got = {r.id: r for r in media.decode_column(df, "id", "data").collect()}
    assert (got[1].height, got[1].width, got[1].channels, got[1].error) == (4, 6, 3, None) and got[1].tile[:6] == b"\x93NUMPY"
    assert all(got[i].height is None and got[i].error for i in (2, 3, 4))


def test_packing(docs, rows):
    import numpy as np
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, fill = {}, {}
    for r in packing.pack(docs).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in fill.values():
        end = 0
        for at, n in sorted(v):
            assert at == end
            end += n
        assert end == 2048 or end & (end - 1) == 0
    for k, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], np.uint32)
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes())), k
            at += r.length
        assert at == len(ids)


def test_packer_rule():
    """Each placement is the one that a plain search over all levels finds; what is left open is poured without padding."""
    import random

    import numpy as np

    size, rng = 64, random.Random(2)
    p, counts = packing.SquarePacker(0, size), {}
    for i in range(3000):
        n = rng.choice((rng.randint(1, size - 1), rng.randint(1, 20), 33, 40))
        tried = []
        for h in (0, *(h for h in counts if h + n <= size)):
            after = dict(counts)
            if h:
                after[h] -= 1
            if h + n < size:
                after[h + n] = after.get(h + n, 0) + 1
            tried.append((sum(v * v for v in after.values()), -h, {k: v for k, v in after.items() if v}))
        _, h, counts = min(tried, key=lambda t: t[:2])
        assert p.best_level(n) == -h
        p.add(i, np.arange(n, dtype=np.uint32))
        assert {k: v for k, v in enumerate(p.levels.tolist()) if v} == counts
    assert sum(map(len, p.open)) == sum(counts.values())
    p.finish()
    out, fill = p.take(), {}
    for r in out:
        fill[r[5]] = fill.get(r[5], 0) + r[2]
    assert all(n == size or n & (n - 1) == 0 for n in fill.values()) and any(r[7] for r in out) and not all(r[7] for r in out)
    lengths = {}
    for r in sorted(out, key=lambda r: (r[0], r[1])):
        assert r[1] == lengths.get(r[0], 0)
        lengths[r[0]] = r[1] + r[2]
    assert len(lengths) == 3000


def test_token_counts(spark, docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, cache = Tokenizer.from_file(path), token_counts.new_cache(spark)
    for _ in range(2):
        got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, cache, path).collect()}
        assert got == {k: len(whole.encode(t or "", add_special_tokens=False).ids) for k, t in rows}
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})
    path = public_tokenizers.path("piece_bpe_32k.model")
    few = docs.limit(20)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(few, cache, path).collect()}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert got == {r.doc_id: len(sp.encode(r.text or "")) for r in few.collect()}


def test_byte_bpe(docs, rows):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.round_trip_digests(docs).collect()}
    for k, t in rows:
        ids = own.encode_ordinary(t or "")
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t or "")), k
    texts = dict(rows)
    for r in byte_bpe.encode_column(docs.filter("doc_id > 9000010")).collect():
        t, at, want = texts[r.doc_id] or "", 0, []
        chars = [i for i, c in enumerate(t) for _ in c.encode()]  # the character of each byte
        for i in r.ids:
            n = len(own.decode_single_token_bytes(i))
            want.append((chars[at], chars[at + n - 1] + 1))
            at += n
        assert list(zip(r.starts, r.ends)) == want
        assert got[r.doc_id].offsets_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for pair in want for x in pair))
    back = byte_bpe.decode_column(byte_bpe.encode_column(docs, offsets=False))
    assert {r.doc_id: r.text for r in back.collect()} == {k: t or "" for k, t in rows}


def test_byte_bpe_classes():
    """Texts of all planes are split by the tables of the library that the contract names."""
    import random

    import tiktoken

    path, pattern = byte_bpe.default_files()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    bpe, rng = byte_bpe.byte_bpe(path, pattern), random.Random(1)
    point = lambda: chr(rng.choice((rng.randrange(0x20, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x110000), rng.randrange(0x1F000, 0x40000))))
    texts = ["".join(rng.choice((point(), point(), " ", "'s", "'ll", "\n", "a1")) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts += [f"{chr(c)}'s {chr(c)}{chr(c)}'ll x{chr(c)}9" for c in (0x326CC, 0x3D39A, 0x3E7D7, 0x323B0, 0x1E4D0)]
    assert all(bpe.encode(t) == own.encode_ordinary(t) for t in texts)
    assert byte_bpe.named_classes(r"a[^\s\p{N}]\S") .count("[") == 2


def test_chat(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    odd = [(-1, 0, "system", "be <brief>"), *((-1, i, ("user", "assistant")[i % 2 == 0], f"turn {i} " + "word " * (60 + 60 * (i % 4))) for i in range(1, 19)), (-2, 0, None, None), (-2, 0, None, None), (-3, 0, "assistant", "x\\" * 3000), (None, None, "user", "who")]
    df = rows.union(spark.createDataFrame(odd, rows.schema))
    windows = chat.format_windows(df).cache()
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    want, turns = {}, {}
    for r in df.collect():
        turns.setdefault(r.conv_id, []).append((r.turn if r.turn is not None else -1, r.role or "", r.text or ""))
    for k, v in turns.items():
        v.sort()
        loss = "".join(t for _, role, t in v if role == "assistant")
        want[k] = (len(v), brute.sha("".join(f"{a}\n{t}\n" for _, a, t in v)), len(loss), brute.sha(loss))
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == want
    many = sorted((r for r in windows.collect() if r.conv_id == -1), key=lambda r: r.window)
    assert len(many) > 2 and all(chat.parse(r.text)[0] == ("system", "be <brief>") for r in many)
    assert all(r.n_tokens <= chat.BUDGET for r in many) and any(r.repeated_turns > 1 for r in many)


def test_read_back_odd(spark):
    """Windows with nulls in any column, given twice, with further columns, and none."""
    one = chat.format_windows(spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn int, role string, text string"))
    fields = ["conv_id", "text", "repeated_turns", "loss_starts", "loss_ends"]
    (w,) = one.select(*fields).collect()
    data = [(*w, 1), (*w, 1), (2, w.text, None, None, None, 1), (3, None, None, None, None, 1), (None, *w[1:], 1)]
    df = spark.createDataFrame(data, "conv_id long, text string, repeated_turns long, loss_starts array<long>, loss_ends array<long>, n_turns int").coalesce(1)
    got = {r.conv_id: (r.n_turns, r.loss_chars, r.n_windows, r.formatted_chars) for r in chat.read_back(df).collect()}
    n = len(w.text)
    assert got == {1: (4, 4, 2, 2 * n), 2: (2, 0, 1, n), 3: (0, 0, 1, 0), None: (2, 2, 1, n)}
    assert chat.read_back(df.limit(0)).count() == 0


def test_long_texts(spark):
    """Texts of megabytes through chat formatting, quality, media and byte-level BPE."""
    long = "Some <words> of a long text, \\### and 3.14 more!\n" * 45_000
    chats = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "user", "short")], "conv_id long, turn int, role string, text string")
    (r,) = chat.read_back(chat.format_windows(chats)).collect()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (3, len(long), brute.sha(long))
    df = spark.createDataFrame([(1, long), (None, "x"), (1, long)], "doc_id long, text string")
    want = brute.quality_features(long)
    for r in quality.features(df.select(F.col("doc_id").alias("key"), F.col("text").alias("body")), ["key"]).filter("key = 1").collect():
        assert all(abs(r[f"x_{k}"] - want[k]) < 1e-9 for k in quality.FEATURES)
    assert sorted((r.n_bytes, r.payload.rstrip(bytes(1)) == long.encode()) for r in media.media_columns(df).select("n_bytes", "payload").collect()) == [(1, False), *[(len(long), True)] * 2]


def test_bpe_columns(spark):
    """The columns operators with nulls, repeated rows, names that clash, and empty tables."""
    df = spark.createDataFrame([(1, "héllo", 1), (1, "héllo", 1), (None, None, 1), (2, "", None)], "doc_id long, text string, key int").withColumn("bytes", F.lit(1))
    ids = byte_bpe.encode_column(df)
    back = byte_bpe.decode_column(ids.withColumns({"text": F.lit(1), "bytes": F.lit(2), "key": F.lit(3)}))
    assert sorted((r.doc_id or 0, bytes(r.bytes).decode(), r.text) for r in back.collect()) == [(0, "", ""), (1, "héllo", "héllo"), (1, "héllo", "héllo"), (2, "", "")]
    assert [r.text for r in byte_bpe.decode_column(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>")).collect()] == [""]
    assert byte_bpe.encode_column(df.limit(0)).count() == 0 == byte_bpe.decode_column(ids.limit(0)).count()


def test_exact(docs, rows):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == brute.exact(rows)


def test_exact_hot_rows(spark):
    """One text under no key, one key or many, in thousands of rows."""
    df = spark.range(3000).selectExpr("if(id < 1000, null, if(id < 2000, 7, id)) AS doc_id", "if(id = 2500, 'a  b', 'a b') AS text", "id AS salt", "1 AS body")
    out = exact_dedup.exact_dedup(df).groupBy("doc_id", "keep_id", "group_size", "kept").count().collect()
    assert {(r.keep_id, r.group_size) for r in out} == {(2500, 3000)} and [(r.doc_id, r["count"]) for r in out if r.kept] == [(2500, 1)]
    assert {r.doc_id: r["count"] for r in out if r.doc_id in (None, 7)} == {None: 1000, 7: 1000}


def test_exact_neighbours(spark):
    """The texts decide, not their digests: all rows under one digest, many of them beginning alike, one text hot."""
    head = "x" * 100
    rows = [(i, (head + str(i % 700)) if i % 3 else (head + " y")) for i in range(3000)] + [(3000, None), (3001, ""), (3002, head), (3003, head + " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = exact_dedup.exact_dedup(df, digest=lambda body: F.concat(F.lit("one"), F.substring(body, 1, 0))).collect()
    assert {r.text_sha256 for r in out} == {"one"} and len(out) == len(rows)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in out} == {k: v[:3] for k, v in brute.exact(rows).items()}


def test_near(docs, rows):
    short = [(k, t) for k, t in rows if len(t or "") < 8000 or k > 9_000_000]
    some = docs.join(docs.sparkSession.createDataFrame([(k,) for k, _ in short], "doc_id long"), "doc_id")
    for n in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(some, shingle=n).collect()}
        assert got == brute.near(short, n)


def test_near_chain_finishes(spark):
    """Members unlike their centre are still linked to each other."""
    words = [f"t{i}" for i in range(120)]
    data = []
    for i in range(60):  # a drifting chain: only neighbours are similar enough
        data.append((i, " ".join(words[i * 2 : i * 2 + 40]) if i < 40 else " ".join(words[:40][: 39 - (i - 40)])))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(spark.createDataFrame(data, "doc_id long, text string"), shingle=2).collect()}
    assert got == brute.near(data)


def test_near_null_keys(spark):
    """Null keys are linked, and stay where nothing with a key leads them; one row of a key's similar texts stays."""
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcd"}
    data = [(None, text["a"]), (None, text["b"]), (5, text["b"] + " end"), (None, text["c"]), (None, text["c"] + " end"), (None, None), (7, None), (8, text["d"]), (8, text["d"] + " end"), (9, text["d"])]
    out = minhash.near_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id or 0), r.n_shingles, (r.component_id or 0), r.kept) for r in out)
    assert [g[:3] for g in got] == [(0, 0, 0), (0, 56, 0), (0, 56, 0), (0, 56, 5), (0, 57, 0), (5, 57, 5), (7, 0, 7), (8, 56, 8), (8, 57, 8), (9, 56, 8)]
    assert {k: sum(g[3] for g in got if g[0] == k) for k in (0, 5, 7, 8, 9)} == {0: 3, 5: 1, 7: 1, 8: 1, 9: 0} and (0, 56, 5, False) in got


def test_residual_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "STAR", 2)
    words = [f"t{i}" for i in range(200)]
    data = [(i, " ".join(words[i : i + 50])) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(spark.createDataFrame(data, "doc_id long, text string"), shingle=2).collect()}
    assert got == brute.near(data)


def test_template(spark, monkeypatch):
    """Documents on one template share many shingles but don't reach the similarity: few pairs of them are compared."""
    import random

    rng, asked, whole = random.Random(3), [], minhash.linked
    template = [f"t{i}" for i in range(110)]
    data = [(i, " ".join(template + [f"w{rng.randrange(50_000)}" for _ in range(40)])) for i in range(2000)]
    data += [(5000 + i, data[i][1].replace("t50 t51", "u v")) for i in range(0, 2000, 400)]

    def counted(edges, *rest):
        asked.append(edges.count())
        return whole(edges, *rest)

    monkeypatch.setattr(minhash, "linked", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(spark.createDataFrame(data, "doc_id long, text string"), shingle=2).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: k % 5000 for k, _ in data}
    assert sum(asked) < 35 * len(data)  # each member has at most one centre in each of the 32 bands


def test_slots(spark, monkeypatch):
    """Slots filled from few values: documents meet on common shingles, but only linked ones leave the join as pairs."""
    import random

    rng, asked, whole = random.Random(5), [], minhash._residual

    def text(values):
        return " ".join(f"t{i}" if i % 4 else f"s{i}v{values[i // 4]}" for i in range(100))

    def counted(*args):
        pairs = whole(*args)
        asked.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash, "_residual", counted)
    for n in (300, 600):
        slots = [[rng.randrange(3) for _ in range(25)] for _ in range(n)]
        for i in range(0, n, 20):  # some differ from another in a few slots only
            slots[i] = [v if rng.random() > 0.15 else rng.randrange(3) for v in slots[i + 1]]
        data = [(i, text(v)) for i, v in enumerate(slots)]
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(spark.createDataFrame(data, "doc_id long, text string"), shingle=2).collect()}
        assert got == brute.near(data) and 0 < sum(not v[2] for v in got.values()) < n // 10
    assert max(asked) < 60, asked  # 37,000 and 150,000 pairs meet


def test_parity_bounds():
    """Never more than the shingles in which two sets differ."""
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (0, 1, 30, 100, 3000):
        both, own, other = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (n, n // 3, n // 5))
        a, b = (minhash.parity(np.unique(np.append(both, x))) for x in (own, other))
        differ = sum(bin(int(x) & (2**64 - 1)).count("1") for x in a ^ b)
        assert differ <= len(own) + len(other) and (differ - len(own) - len(other)) % 2 == 0 and len(a) == minhash.PARITY


def test_colliding_words(spark):
    """Words that polynomial hashes can't tell apart are different words to the operators that compare shingles or windows."""
    a, b = brute.thue_morse(2048), brute.thue_morse(2048, "b", "a")
    words = [f"t{i}" for i in range(30)]
    data = [(i, " ".join(words[: 3 * i] + [(a, b)[i % 2]] * (1 + i // 4) + words[3 * i :])) for i in range(8)]
    data += [(10 + i, " ".join([w] * 3 + words[:10])) for i, w in enumerate((a, b, a, b))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for n in (2, 5):
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(df, shingle=n).collect()} == brute.near(data, n)
    out = substring_dedup.remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("s")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.s) for r in out} == brute.substring(data)


def test_quality(spark, sf_dir):
    from pyspark.sql import functions as F

    where = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score_quality(docs, labels).cache()
    assert out.count() == docs.count() and out.filter("score < 0 or score > 1 or score is null").count() == 0
    for r in out.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
    both = out.join(labels, "doc_id").filter("held_out").select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert both > 0.95


def test_quality_plainly(docs, rows, spark, sf_dir):
    """Every score is what the model gives for statistics that plain Python counts."""
    import numpy as np

    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
    stats = quality.features(docs.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("body")), ["key"]).cache()
    own = [(k, t or "") for k, t in rows]
    plain = {k: brute.quality_features(t) for k, t in own}
    for r in stats.collect():
        for name in quality.FEATURES:
            assert abs(r[f"x_{name}"] - plain[r.key][name]) < 1e-9, (r.key, name)
    model = quality.train(stats, labels)
    want = 1 / (1 + np.exp(-model.margin(np.array([[plain[k][f] for f in quality.FEATURES] for k, _ in own]))))
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score_quality(docs, labels).collect()}
    for (k, _), y in zip(own, want):
        assert abs(got[k][0] - y) < 1e-9 and got[k][1] == int(got[k][0] >= 0.3)


def test_rules_agree(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 4] <= 0.7)).astype(float)
    model = quality.fit(x, y, trees=10)
    df = spark.createDataFrame(x.tolist(), [f"x_{k}" for k in quality.FEATURES])
    got = [r.s for r in df.select(model.column().alias("s")).collect()]
    want = 1 / (1 + np.exp(-model.margin(x)))
    assert np.allclose(sorted(got), sorted(want)) and ((want >= 0.5) == (y == 1)).mean() > 0.97
    assert 0.4 < 1 / (1 + np.exp(-quality.fit(x, np.zeros(0)).intercept)) < 0.6


@pytest.mark.parametrize("case", ["empty", "clash"])
def test_tables(spark, case):
    df = spark.createDataFrame([], EMPTY) if case == "empty" else clashing(spark)
    n, path = df.count(), public_tokenizers.path("byte_bpe_50k.json")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    made = {
        "substring": substring_dedup.remove_repeats(df), "pii": pii.span_digests(df), "redact": pii.redact(df), "media": media.media_columns(df), "digests": media.media_digests(df),
        "counts": token_counts.count_tokens(df, token_counts.new_cache(spark), path), "exact": exact_dedup.exact_dedup(df), "quality": quality.score_quality(df, labels),
        "bytes": byte_bpe.round_trip_digests(df), "near": minhash.near_groups(df),
    }
    assert {k: v.count() for k, v in made.items()} == dict.fromkeys(made, n)
    assert packing.pack(df).count() >= n
    plain = df.select("doc_id", "text")
    same = {
        "substring": substring_dedup.remove_repeats(plain), "digests": media.media_digests(plain), "exact": exact_dedup.exact_dedup(plain), "near": minhash.near_groups(plain),
        "counts": token_counts.count_tokens(plain, token_counts.new_cache(spark), path), "quality": quality.score_quality(plain, labels), "bytes": byte_bpe.round_trip_digests(plain),
    }
    for k, v in same.items():  # other columns don't matter, whatever their names
        assert v.columns == made[k].columns and sorted(map(str, v.collect())) == sorted(map(str, made[k].collect())), k
    own = df.filter("doc_id = 5").select("doc_id", "text").first()
    if case == "clash":
        packed = packing.pack(df).collect()
        assert sum(r.length for r in packed if r.doc_id == 5) == 2 * [r.doc_tokens for r in packed if r.doc_id == 5][0] and own
        chats = spark.createDataFrame([(1, 0, "user", "hi", 5, "x"), (1, 1, "assistant", "yo", 5, "x"), (None, 0, "user", None, 5, "x")], "conv_id long, turn int, role string, text string, window int, key string")
        assert {(r.conv_id, r.n_turns, r.loss_chars) for r in chat.read_back(chat.format_windows(chats)).collect()} == {(1, 2, 2), (None, 1, 0)}
        assert made["redact"].columns == df.columns
        assert {r.n_phone for r in made["pii"].collect() if r.doc_id == 5} == {1} and made["substring"].agg(F.sum("n_removed")).first()[0] == 0
    else:
        assert chat.read_back(chat.format_windows(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))).count() == 0
