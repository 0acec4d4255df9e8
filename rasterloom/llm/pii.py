"""Personal data: four base kinds by pattern, then bootstrapped contextual extraction. Base finds, and hexadecimal values that
follow a word for a credential, are the seeds; the words before, after and around them are lexical patterns; a pattern-instance
graph is scored until no pattern is added; patterns of high confidence discover further identifiers: digit groups joined
by blanks, dashes, dots or brackets, tokens with a digit, @, (at) or [at], and values behind a key such as `tel:`.

DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterloom.llm.common import written

#: The base kinds in their order, each as a Java pattern. The look-behinds and possessive quantifiers
#: only save time on long runs: a match starts at the beginning of its run or where the last match ended.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Values of credentials: mixed letters and digits from 16 characters on, behind a word for one and = or a colon.
SECRET = (
    r"(?<![A-Za-z0-9_+/.-])(?<=[=:\x20\t\"'])(?=[A-Za-z0-9_+/.-]{16})"
    r"(?<=(?i:token|secret|passw(?:or)?d|pwd|credentials?|(?:api|access|auth|private|secret)[_\x20-]?key)[\"']?[\x20\t]{0,2}[=:][\x20\t]{0,2}[\"']?)"
    r"[A-Za-z0-9_+/-]++(?:\.[A-Za-z0-9_+/-]++)*+=*+"
)
#: Of those values the ones that are seeds: hexadecimal digits only. The others have to be found by their contexts; those whose context is not
#: learned are still told by SECRET, and counted apart.
SEED_SECRET = r"\A[0-9A-Fa-f]{32,}\z"
#: Identifier-like tokens: those with a digit, an @, (at) or [at]. A text without TOKEN_NEEDS has none.
TOKEN = r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D0-9@(\[]++|\((?!at\))|\[(?!at\]))*+(?:[0-9@]|\(at\)|\[at\])[^\x20\x09-\x0D]*+"
#: A text without these has no match of the kind.
NEEDS = {"email": "@", "ip": r"\.", "card": "[0-9]", "phone": r"\+", "secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|credentials?|key)[\"']?[\x20\t]{0,2}[=:]", "token": r"[0-9@]|\(at\)|\[at\]"}
#: Tokens make one span when a digit group that may go on is followed by one of these gaps and by another digit group.
GOES_ON = r"^[\"'(\[{<]*[0-9Xx*()./-]*[0-9Xx*)]$"
GAP = r"^(?:\x20{1,2}|\x20-\x20)$"
FOLLOWS = r"^\(?[0-9Xx*][0-9Xx*()./-]*[\"')\]}>.,;:!?]*$"
#: Shapes that a discovered identifier of each kind must have; each pattern is linear in its (bounded) length.
SHAPES = {
    "email": r"^[^@(\[]*[A-Za-z0-9](?:@|\(at\)|\[at\])[A-Za-z0-9][^@]*$",
    "ip": r"^[0-9A-Fa-f]{1,4}([.:][0-9A-Fa-f]{0,4}){3,7}$",
    "card": r"^([0-9Xx*][ -]?){13,19}$",
    "phone": r"^[0-9()./\x20-]++$",
    "secret": r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/=.-]{8,}$",
}
#: Digits of a discovered phone number, its groups, and the code points of the longest discovered identifier.
PHONE_DIGITS, PHONE_GROUPS, LONGEST = (7, 15), 5, 320
#: A span has at most as many tokens as a shape has places for digits.
MOST_TOKENS = 19
#: A pattern is strong from so many known instances and such a share of its instances on.
SUPPORT, CONFIDENCE = 5, 0.8
#: How much an unlabelled instance of the kind's shape counts against a pattern.
DOUBT = 0.1
#: Code points beside a find in which the words of a pattern lie; words that reach beyond, or are longer than WORD, make none.
CONTEXT, WORD = 160, 64
_S, _W = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D0-9]"
_KEY = r"^(?![A-Fa-f]+[:=])[A-Za-z][A-Za-z_-]{0,63}[:=]"


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return hit.rlike(rf"^(?:{octet}\.){{3}}{octet}$")
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    if kind == "card":
        place = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        doubled = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
        luhn = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, doubled(place(i))).otherwise(place(i))) % 10 == 0
        return F.when(n.between(13, 19), luhn).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") if kind == "secret" else F.lit(True)


def _matches(kind: str, gaps: Column, hits: Column) -> Column:
    """Array of (kind, gap: code points since the last match of the kind, size, valid, before and after: the ends of the
    gaps beside it, with a blank where the gap is whole, hit: null when longer than an identifier)."""
    before = lambda g: F.when(F.length(g) < CONTEXT, F.concat(F.lit(" "), g)).otherwise(F.right(g, F.lit(CONTEXT)))
    after = lambda g: F.when(F.length(g) < CONTEXT, F.concat(g, F.lit(" "))).otherwise(F.left(g, F.lit(CONTEXT)))
    both = F.filter(F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), lambda x: x.hit.isNotNull())
    return F.zip_with(both, F.slice(gaps, F.lit(2), F.greatest(F.size(hits), F.lit(0))), lambda x, g: F.struct(
        F.lit(kind).alias("kind"), F.length(x.gap).alias("gap"), F.length(x.hit).alias("size"), _valid(kind, x.hit).alias("valid"),
        before(x.gap).alias("before"), after(g).alias("after"), F.when(F.length(x.hit) <= LONGEST, x.hit).alias("hit"),
    ))


def _candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """All matches with their places: id, row (digest that tells rows of one key apart), kind, start, end, hit, gap, before,
    after, seed (of a base kind, or a SEED_SECRET), base (of the base kinds)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("id"), F.xxhash64(body).alias("row"), body.alias("text"))
    kinds = {**KINDS, "secret": SECRET, "token": TOKEN}
    none = F.array().cast("array<string>")
    cut = {}
    for k, p in kinds.items():
        cut[f"gaps_{k}"] = F.when(F.col("text").rlike(NEEDS[k]), F.split("text", p, -1)).otherwise(none)
        cut[f"hits_{k}"] = F.when(F.col("text").rlike(NEEDS[k]), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none)
    rows = rows.select("id", "row", *(c.alias(n) for n, c in cut.items()))
    arrays = [_matches(k, F.col(f"gaps_{k}"), F.col(f"hits_{k}")) for k in kinds]
    hits = rows.select("id", "row", F.posexplode(F.concat(*arrays)).alias("place", "m")).select("id", "row", "place", "m.*")
    hits = hits.dropDuplicates(["id", "row", "place"])  # rows repeated with the same key and text
    so_far = Window.partitionBy("id", "row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    hits = hits.filter(F.col("valid") & (F.col("hit").isNotNull() | (F.col("kind") != "token")))
    seed = (F.col("kind") != "token") & ((F.col("kind") != "secret") | F.coalesce(F.col("hit").rlike(SEED_SECRET), F.lit(False)))
    return hits.select("id", "row", "kind", "start", "end", "hit", "gap", "before", "after", seed.alias("seed"), F.col("kind").isin(*KINDS).alias("base"))


def _free_tokens(hits: DataFrame) -> DataFrame:
    """Seeds, and the tokens that touch none."""
    row = Window.partitionBy("id", "row").orderBy("start")
    held = hits.withColumn("before_end", F.max(F.when(F.col("seed"), F.col("end"))).over(row.rangeBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy("id", "row").orderBy(F.desc("start"))  # running minima from the end: linear in the row's finds
    held = held.withColumn("after_start", F.min(F.when(F.col("seed"), F.col("start"))).over(back.rangeBetween(Window.unboundedPreceding, 0)))
    free = (F.coalesce("before_end", F.lit(-1)) <= F.col("start")) & (F.coalesce(F.col("after_start") >= F.col("end"), F.lit(True)))
    return held.filter(F.col("hit").isNotNull() & (F.col("seed") | (free & (F.col("kind") == "token")))).drop("before_end", "after_start")


def _core(hit: Column) -> tuple[Column, Column, Column]:
    """The key that leads a find, the length of key and punctuation before it, and the find without what surrounds it.

    A bracket around the first digits of a longer number belongs to the number."""
    key = F.regexp_extract(hit, _KEY, 0)
    rest = F.substring(hit, F.length(key) + 1, F.length(hit))
    lead = F.length(key) + F.length(F.regexp_extract(rest, r"^(?:[\"'\[{<,;:!?=]|\((?![0-9]+\)[\x20./-]*[0-9]))*", 0))
    return key, lead, F.regexp_replace(F.substring(hit, lead + 1, F.length(hit)), r"[\"')\]}>.,;:!?*#$%&|]+$", "")


def _shaped(instance: Column, kind: str) -> Column:
    """Whether an instance of one or several tokens has the shape of the kind."""
    fits = F.regexp_replace(F.regexp_replace(instance, r"\x20-\x20", "-"), r"\x20+", " ").rlike(SHAPES[kind])
    if kind == "phone":  # a single digit after a blank counts something else
        enough = F.length(F.regexp_replace(instance, "[^0-9]", "")).between(*PHONE_DIGITS) & (F.regexp_count(instance, F.lit("[0-9]+")) <= PHONE_GROUPS)
        return fits & enough & ~instance.rlike(r"\x20[0-9]$") & instance.rlike(r"^\(?[0-9]")
    return fits


def _instances(near: DataFrame) -> DataFrame:
    """Seeds and free tokens as instances: id, row, kind, start, before, after, seed, instance.

    Digit groups with only a gap between them are one span, known by the words beside the whole of it; its instance is
    the longest run of tokens from its beginning that has a shape, or else its first token."""
    seeds = near.filter("seed").select("id", "row", "kind", "start", "before", "after", "seed", F.lower("hit").alias("instance"))
    row = Window.partitionBy("id", "row").orderBy("start")
    last = F.lag(F.struct("end", "hit")).over(row)
    between = F.substring("before", 2, 3)  # behind the blank that marks a whole gap
    joins = (last.end + F.col("gap") == F.col("start")) & (F.col("gap") <= 3) & between.rlike(GAP) & last.hit.rlike(GOES_ON) & F.col("hit").rlike(FOLLOWS)
    free = near.filter("not seed").withColumn("first", ~F.coalesce(joins, F.lit(False)))
    free = free.withColumn("head", F.max(F.when(F.col("first"), F.col("start"))).over(row.rowsBetween(Window.unboundedPreceding, 0)))
    free = free.withColumn("n", F.row_number().over(Window.partitionBy("id", "row", "head").orderBy("start"))).filter(F.col("n") <= MOST_TOKENS)
    part = F.struct("n", F.when(F.col("n") > 1, F.concat(between, F.col("hit"))).otherwise(F.col("hit")).alias("text"), "after")
    spans = free.groupBy("id", "row", F.col("head").alias("start")).agg(F.array_sort(F.collect_list(part)).alias("parts"), F.min_by("before", "n").alias("before"))
    upto = lambda k: F.struct(F.array_join(F.transform(F.slice("parts", 1, k), lambda x: x.text), "").alias("text"), F.get("parts", k - 1).after.alias("after"))
    shaped = lambda x: reduce(lambda a, k: a | _shaped(_core(x.text)[2], k), SHAPES, F.lit(False))
    longer = F.filter(F.transform(F.sequence(F.size("parts"), F.lit(1), F.lit(-1)), upto), shaped)
    one = upto(F.lit(1))
    spans = spans.withColumn("s", F.when(F.size("parts") > 1, F.coalesce(F.get(longer, F.lit(0)), one)).otherwise(one))
    key, lead, core = _core(F.col("s.text"))
    tokens = spans.select(
        "id", "row", F.lit("token").alias("kind"), (F.col("start") + lead).alias("start"), F.concat("before", key).alias("before"), F.col("s.after").alias("after"),
        F.lit(False).alias("seed"), core.alias("instance"),
    )
    return seeds.union(tokens).filter(F.length("instance") > 0)


def _patterns(found: DataFrame) -> DataFrame:
    """The lexical patterns of each find, lower-cased: the word before it, the two before it, the two after it, and the
    words on both sides, where the beginning of a line counts as one. A pattern holds a letter."""
    before, after = F.lower(F.regexp_replace("before", r"[\"'(\[{<]+$", "")), F.lower(F.regexp_replace("after", r"^[\"')\]}>.,;:!?*#$%&|]+", ""))
    word = f"{_W}{{1,{WORD}}}"
    squeezed = lambda c: F.regexp_replace(c, f"{_S}+", " ")
    one = F.regexp_extract(before, f"{_S}({word}){_S}*$", 1)
    two = squeezed(F.regexp_extract(before, f"{_S}({word}{_S}+{word}){_S}*$", 1))
    following = F.regexp_extract(after, f"^{_S}*({word}){_S}", 1)
    after_two = squeezed(F.regexp_extract(after, f"^{_S}*({word}{_S}+{word}){_S}", 1))
    at_line = (F.col("start") == 0) | F.col("before").rlike(r"[\n\r][\x20\t]*$")
    left = F.when(at_line, "^").otherwise(one)
    around = F.when((left != "") & (following != ""), F.concat(left, F.lit(" _ "), following)).otherwise("")
    named = [F.concat(F.lit(n), c) for n, c in (("1 ", one), ("2 ", two), ("> ", after_two), ("< ", around))]
    return found.withColumn("pattern", F.explode(F.filter(F.array(*named), lambda p: p.rlike(r"\p{L}"))))


def _scored(graph: DataFrame) -> DataFrame:
    """Score the pattern-instance graph (pattern, instance, kind or null for unlabelled) to a fixpoint.

    Returns pattern, kind, confidence for those of high confidence: the belief of the pattern's instances of the kind,
    over that belief, the instances of another kind or shape, and a part (DOUBT) of those that only have the shape.
    Beliefs only grow from round to round, so the strong patterns do, and the rounds end when none is added."""
    seeds = graph.filter("kind is not null").select("pattern", "instance", "kind", F.lit(1.0).alias("belief"))
    free = graph.filter("kind is null").select("pattern", "instance")
    shapes = F.array_compact(F.array(*(F.when(_shaped(F.col("instance"), k), F.lit(k)) for k in SHAPES)))
    fitting = free.select("pattern", F.explode(shapes).alias("kind")).groupBy("pattern", "kind").agg(F.count("*").alias("fitting"))
    labelled = seeds.groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    per = graph.select("pattern", "instance").distinct().groupBy("pattern").agg(F.count("*").alias("instances"))
    sides = labelled.join(fitting, ["pattern", "kind"], "full").na.fill(0, ["seeds", "fitting"]).join(per, "pattern")
    sides = written(sides.withColumn("other", F.greatest(F.lit(0), F.col("instances") - F.col("seeds") - F.col("fitting"))), "sides")
    known, before = seeds, None
    while True:
        score = known.groupBy("pattern", "kind").agg(F.sum("belief").alias("belief"), F.count("*").alias("support")).filter(F.col("support") >= SUPPORT)
        unknown = F.greatest(F.lit(0), F.col("seeds") + F.col("fitting") - F.col("support"))
        confidence = F.col("belief") / (F.col("belief") + F.col("other") + DOUBT * unknown + 1)
        strong = score.join(sides, ["pattern", "kind"]).withColumn("confidence", confidence).filter(F.col("confidence") >= CONFIDENCE)
        strong = written(strong.select("pattern", "kind", "confidence"), "patterns")
        state = strong.agg(F.count("*").alias("n"), F.sum(F.xxhash64("pattern", "kind").cast("decimal(38,0)")).alias("h")).first()  # the set, not its size
        if state == before or state.n == 0:
            return strong
        before = state
        new = (
            free.join(strong, "pattern").filter(_fits(F.col("kind")))
            .groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))).alias("belief"))
            .filter(F.col("belief") >= CONFIDENCE)
        )
        known = seeds.union(free.join(new, "instance").select("pattern", "instance", "kind", "belief"))


def _fits(kind: Column) -> Column:
    return reduce(lambda a, k: a | ((kind == k) & _shaped(F.col("instance"), k)), SHAPES, F.lit(False))


def find_spans(df: DataFrame, key: str = "doc_id", text: str = "text", contextual: bool = True) -> DataFrame:
    """All spans: id, row, kind, start, end (code points), base (of a base kind, found by pattern) or not, graph (discovered by a
    strong pattern of the graph) or not.

    Base kinds are matched leftmost and non-overlapping over the whole text, each kind alone. The others are credentials
    (kind secret) and what strong patterns discover, of at most LONGEST code points. Null and empty texts and an empty
    table have none. Rows repeated with the same key and text count once; texts and tokens of any length, null keys and
    several texts of a key are allowed; other columns are ignored, whatever their names."""
    hits = written(_candidates(df, key, text), "finds")
    told = F.col("base") | ((F.col("kind") == "secret") if contextual else F.lit(False))
    spans = hits.filter(told).select("id", "row", "kind", "start", "end", "base", F.lit(False).alias("graph"))
    if not contextual:
        return spans
    edges = _patterns(_instances(_free_tokens(hits)))
    edges = written(edges.select("id", "row", "start", "pattern", "instance", F.when(F.col("seed"), F.col("kind")).alias("kind")), "edges")
    strong = _scored(written(edges.select("pattern", "instance", "kind").distinct(), "graph"))
    more = edges.filter("kind is null").drop("kind").join(strong, "pattern").filter(_fits(F.col("kind")))
    best = more.groupBy("id", "row", "start", "instance").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    found = best.select("id", "row", "kind", "start", (F.col("start") + F.length("instance")).alias("end"), F.lit(False).alias("base"), F.lit(True).alias("graph"))
    # a credential that SECRET tells and the graph discovers is one span, the graph's
    return spans.union(found).groupBy("id", "row", "kind", "start").agg(F.max("end").alias("end"), F.max("base").alias("base"), F.max("graph").alias("graph"))


def span_digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, counts of the base kinds, base_sha256, spans (kind:start:end by kind as listed, then start; kind
    secret last), n_found, the spans that are not of the base kinds' patterns, and n_graph, those of them that patterns of the graph
    discovered (the others are credentials that SECRET tells). Equal rows give equal results; see find_spans()."""
    order = F.array_position(F.array(*map(F.lit, [*KINDS, "secret"])), F.col("kind"))
    item = F.struct(order.alias("o"), "start", "end", F.concat_ws(":", "kind", "start", "end").alias("name"))
    listed = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, item))), lambda x: x.getField("name")), ",")
    per = find_spans(df, key, text).groupBy("id", "row").agg(
        *(F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS),
        listed(F.col("base")).alias("base_spans"),
        listed(F.lit(True)).alias("spans"),
        F.count(F.when(~F.col("base"), 1)).alias("n_found"),
        F.count_if("graph").alias("n_graph"),
    )
    rows = df.select(F.col(key).alias("own"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("own_row"))
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("own_row") == F.col("row"))
    zero = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    empty = F.lit("")
    return rows.join(per, same, "left").select(
        F.col("own").alias(key), *zero, F.sha2(F.coalesce("base_spans", empty), 256).alias("base_sha256"), F.coalesce("spans", empty).alias("spans"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_found", "n_graph")),
    )


def redact(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with every span replaced by its kind in brackets; overlapping spans are masked together by the first kind.

    All rows and columns stay, whatever their names, those without spans unchanged (null texts stay null); repeated rows
    are masked alike; an empty table stays empty."""
    spans = find_spans(df, key, text)
    row = Window.partitionBy("id", "row").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(row.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("fresh", F.coalesce((F.col("start") >= reach), F.lit(True)).cast("int"))
    marked = marked.withColumn("group", F.sum("fresh").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy("id", "row", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("kind", "fresh").alias("kind"))
    since = F.coalesce(F.lag("end").over(Window.partitionBy("id", "row").orderBy("start")), F.lit(0))
    merged = merged.withColumn("since", since)
    cuts = merged.groupBy("id", "row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "since", "kind"))).alias("cuts"))
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("whole"))
    body = F.col("whole").getField(text)
    parts = F.transform("cuts", lambda s: F.concat(F.substring(body, s.since.cast("int") + 1, (s.start - s.since).cast("int")), F.lit("["), F.upper(s.kind), F.lit("]")))
    tail = F.substring(body, F.element_at("cuts", -1).end.cast("int") + 1, F.length(body))
    out = F.when(F.col("cuts").isNull(), body).otherwise(F.concat(F.array_join(parts, ""), tail))
    same = F.col("whole").getField(key).eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce(body, F.lit(""))) == F.col("row"))
    masked = whole.join(cuts, same, "left")
    return masked.select(*(out.alias(c) if c == text else F.col("whole").getField(c).alias(c) for c in df.columns))
