"""Plain Python versions of the contracts, and documents with odd cases."""

import hashlib
import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def thue_morse(n, a="a", b="b"):
    """The first n letters of the word that polynomial hashes can't tell from its complement."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


ODD = [
    (9_000_001, None), (9_000_002, ""), (9_000_003, " \t\n"), (9_000_004, "single"), (9_000_005, "two words"), (9_000_006, "Two WORDS"),
    (9_000_007, PASSAGE), (9_000_008, f"before {PASSAGE} after"), (9_000_009, f"{PASSAGE} {PASSAGE}"), (9_000_010, LONG), (9_000_011, LONG + " tail"),
    (9_000_012, "mail a.b@c.d_e@f.gg x@y, 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 +1 (555) 123-4567 +12 4111 1111 1111 1111 4111-1111-1111-1111-2"),
    (9_000_013, "é日本 u@é.com z+q%@a-b.c-d. 4111111111111111 ++12345678901 +1.2.3.4.5.6.7.8.9 5500-0000 0000 0004"),
    (9_000_014, "x" * 3_000 + "@" + "1" * 3_000), (9_000_015, "a b" + chr(0xA0) + "c\x1cd\x85e   f"), (9_000_016, "twowords"), (9_000_017, " two\twords"),
    (9_000_018, "1 2 3 4 5 6 7 8 9 " * 500), (9_000_019, "<|endoftext|> it's I'LL ''s İΣς ﬁ é ½²"),
]


def documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(k, t, "en", "odd", 1) for k, t in ODD], docs.schema)
    return docs.union(odd)


def sha(x):
    return hashlib.sha256(x.encode("utf-8") if isinstance(x, str) else x).hexdigest()


def substring(rows):
    first = {}
    words = {k: WORD.findall(t or "") for k, t in rows}
    for k in sorted(words):
        for i in range(len(words[k]) - 12):
            first.setdefault(tuple(words[k][i : i + 13]), k)
    out = {}
    for k, w in words.items():
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < k for j in range(i, i + 13)}
        out[k] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def luhn(s):
    d = [int(c) for c in re.sub(r"[^0-9]", "", s)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in p.finditer(text or ""):
            digits = len(re.sub(r"[^0-9]", "", m[0]))
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= digits <= 19 and luhn(m[0]) or kind == "phone" and 9 <= digits <= 15
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def exact(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), k))
    return {k: (min(g)[1], len(g), min(g)[1] == k, sha(n)) for n, g in groups.items() for _, k in g}


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near(rows, n=2, percent=80):
    sets = {k: shingles(t, n) for k, t in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            by[x].append(k)
    shared = defaultdict(int)
    for v in by.values():
        for i, a in enumerate(v):
            for b in v[:i]:
                shared[a, b] += 1
    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: (len(s), find(k), find(k) == k) for k, s in sets.items()}


def quality_features(text):
    """The classifier's features, counted plainly."""
    import regex

    words, lines = WORD.findall(text), text.split("\n")
    n, w, rows = len(text), max(len(words), 1), max(len(lines), 1)
    upper = len(regex.findall(r"(?<!\p{L})\p{Lu}{2,}+", text))
    symbols = sum(text.count(c) for c in "#%&$*=<>{}^~\\@_|")
    return {
        "n_chars": n, "n_words": len(words), "symbols": symbols, "doubled_words": sum(a == b for a, b in zip(words, words[1:])),
        "distinct_word_share": len(set(words)) / w, "doubled_word_share": sum(a == b for a, b in zip(words, words[1:])) / w, "upper_word_share": upper / w,
        "bar_share": text.count("|") / w, "symbol_share": symbols / w, "exclaim_share": text.count("!!") / w, "digit_share": len(re.findall("[0-9]", text)) / max(n, 1),
        "stop_share": len(re.findall(r"[.?!](?=[\x20\x09-\x0D]|\Z)", text)) / w, "comma_share": text.count(",") / w, "distinct_line_share": len(set(lines)) / rows,
        "chars_per_word": n / w, "words_per_line": len(words) / rows,
    }


def conversation_rows(rows):
    """conv -> rows (turn, role, text) after the damage, in order. rows: (conv, turn, role, text)."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        h = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out[conv] += [] if h == 0 else [(turn, "user" if h == 4 else role, text)] * (1 + (h == 3))
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in out.items()}


def repaired(rows):
    """The contract's columns of a conversation, by the cheapest and least audit for each role given out last."""
    seen, faults, turns = set(), [], [r[0] for r in rows if r[0] is not None]
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = {"": "us", "s": "u", "u": "a", "a": "u"}

    def inserted(ways):
        for _ in range(3):
            new = {s: [w] for s, w in ways.items()}
            for b, (c, a, t) in ways.items():
                x = "a" if b == "u" else "u"
                new.setdefault(x, []).append((c + 3, a + "I", (*t, {"u": "user:", "a": "assistant:"}[x])))
            ways = {s: min(v) for s, v in new.items()}
        return ways

    ways = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        ways = inserted(ways)
        new = defaultdict(list)
        for s, (c, a, t) in ways.items():
            new[s].append((c + 4, a + "D", t))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[:1] in follows[s]:
                    new[role[0]].append((c + more, a + "K", (*t, f"{role}:{text}")))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if x in follows[s]:
                        new[x].append((c + more + 3, a + "R", (*t, f"{name}:{text}")))
        ways = {s: min(v) for s, v in new.items()}
    ways = inserted(ways)
    cost, audit, lines = min(ways[s] for s in ("", "a") if s in ways)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha("\n".join(lines)))


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def leaks(docs, items):
    """doc -> n_words, n_hit, n_items, digest, contaminated, spans. docs, items: (id, text)."""
    windows = defaultdict(set)
    for k, t in items:
        w = BENCH_WORD.findall(lower_ascii(t))
        for i in range(max(len(w) - 9, min(len(w), 1))):
            windows[tuple(w[i : i + 10])].add(k)
    sizes, out = {len(w) for w in windows}, {}
    for k, t in docs:
        found = list(BENCH_WORD.finditer(lower_ascii(t)))
        w, hit, met = [m[0] for m in found], set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    met |= windows[x]
        spans = [(found[i].start(), next(found[j].end() for j in range(i, len(w)) if j + 1 not in hit)) for i in sorted(hit) if i - 1 not in hit]
        names = sorted(str(x) for x in met if x is not None)
        out[k] = (len(w), len(hit), len(names), sha(",".join(names)), bool(hit), spans)
    return out


def variants(rows):
    """word -> form, root, n, n_near, form_n."""
    counts = defaultdict(int)
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower_ascii(run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    by = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[w[:i], w[i + 1 :], 1].add(w)  # one character replaced
            by[w[:i] + w[i + 1 :]].add(w)
    out = {}
    for w, n in words.items():
        near = {x for i in range(len(w)) for x in by[w[:i], w[i + 1 :], 1]} | {w[:i] + w[i + 1 :] for i in range(len(w))} & set(words) | by.get(w, set())
        near = [x for x in near - {w} if x in words]
        best = min(((-words[x], x) for x in near), default=None)
        out[w] = (best[1] if best and -best[0] >= 2 * n else None, n, len(near), words)
    def last(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return {w: (form, last(w), n, m, words[form] if form else None) for w, (form, n, m, _) in out.items()}
