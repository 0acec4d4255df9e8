"""Quality classifier as a sparse rule ensemble: the paths of small trees over text statistics become conjunctive
rules, lasso logistic regression weights them, and the rules that keep a weight become Spark column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.llm.common import written

#: Labelled rows that the model is fitted on at most (a fixed pseudo-random choice); scoring covers all rows.
MAX_LABELLED = 12_000
TREES, DEPTH, LASSO, THRESHOLD = 60, 3, 2e-3, 0.3
_WORD = r"[^\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; all are defined for empty texts."""
    n = F.length(text)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    lines = F.split(text, "\n")
    return {
        "n_chars": n.cast("double"),
        "n_words": count(_WORD),
        "distinct_words": F.size(F.array_distinct(words)).cast("double"),
        "doubled_words": count(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]+(?=\1(?![^\x20\x09-\x0D]))"),
        "upper_words": count(r"(?<![\p{L}])\p{Lu}{2,}+"),
        "lone_bars": count(r"[|]"),
        "symbols": count(r"[#%&$*=<>{}^~\\@_|]"),
        "exclaims": count("!!"),
        "digits": count("[0-9]"),
        "stops": count(r"[.?!](?=[\x20\x09-\x0D]|\z)"),
        "commas": count(","),
        "n_lines": F.size(lines).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)).cast("double"),
    }


#: Ratios of the statistics, which the trees split on: name -> (part, whole).
RATIOS = {
    "distinct_word_share": ("distinct_words", "n_words"),
    "doubled_word_share": ("doubled_words", "n_words"),
    "upper_word_share": ("upper_words", "n_words"),
    "bar_share": ("lone_bars", "n_words"),
    "symbol_share": ("symbols", "n_words"),
    "exclaim_share": ("exclaims", "n_words"),
    "digit_share": ("digits", "n_chars"),
    "stop_share": ("stops", "n_words"),
    "comma_share": ("commas", "n_words"),
    "distinct_line_share": ("distinct_lines", "n_lines"),
    "chars_per_word": ("n_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}
FEATURES = ["n_chars", "n_words", "symbols", "doubled_words", *RATIOS]


def features(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep, and the features of each whole text of rows (columns of keep, and body)."""
    counted = rows.select(*keep, *(c.alias(f"count_{k}") for k, c in statistics(F.col("body")).items()))
    ratios = {k: F.col(f"count_{a}") / F.greatest(F.col(f"count_{b}"), F.lit(1.0)) for k, (a, b) in RATIOS.items()}
    return counted.select(*keep, *(ratios.get(k, F.col(f"count_{k}")).alias(f"x_{k}") for k in FEATURES))


@dataclass
class RuleModel:
    """Score = logistic(intercept + sum of the weights of the rules that hold). A rule is a list of (feature, "<=" or
    ">", value)."""

    intercept: float = 0.0
    rules: list[tuple[list[tuple[str, str, float]], float]] = field(default_factory=list)

    def column(self) -> Column:
        """The model as a Spark expression over the features."""
        test = {"<=": lambda f, v: F.col(f"x_{f}") <= F.lit(v), ">": lambda f, v: F.col(f"x_{f}") > F.lit(v)}
        held = [F.when(reduce(lambda a, b: a & b, [test[o](f, v) for f, o, v in rule]), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules]
        margin = reduce(lambda a, b: a + b, held, F.lit(self.intercept))
        return 1 / (1 + F.exp(-margin))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + sum((w * holds(rule, x) for rule, w in self.rules), np.zeros(len(x)))


def holds(rule: list[tuple[str, str, float]], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, o, v in rule:
        col = x[:, FEATURES.index(f)]
        out &= col <= v if o == "<=" else col > v
    return out


def grow(x: np.ndarray, r: np.ndarray, depth: int, rng: np.random.Generator, path: tuple = ()) -> list[tuple[list, np.ndarray]]:
    """A regression tree on residuals r; returns every node's path and its rows. Candidate cuts are quantiles."""
    out = [(list(path), np.ones(len(x), bool))] if path else []
    if depth == 0 or len(x) < 20 or r.std() < 1e-9:
        return out
    best = (1e-9, None, None)
    for j in rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False):
        order = np.argsort(x[:, j], kind="stable")
        v, s = x[order, j], np.cumsum(r[order])
        k = np.unique(np.linspace(5, len(v) - 6, 48).astype(int))
        k = k[(v[k] < v[k + 1])]
        if not len(k):
            continue
        n = k + 1
        gain = s[k] ** 2 / n + (s[-1] - s[k]) ** 2 / (len(v) - n) - s[-1] ** 2 / len(v)
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (gain[i], j, float((v[k[i]] + v[k[i] + 1]) / 2))
    if best[1] is None:
        return out
    _, j, cut = best
    low = x[:, j] <= cut
    for side, op in ((low, "<="), (~low, ">")):
        if side.any():
            for rule, rows in grow(x[side], r[side], depth - 1, rng, (*path, (FEATURES[j], op, cut))):
                full = np.zeros(len(x), bool)
                full[np.flatnonzero(side)[rows]] = True
                out.append((rule, full))
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 7) -> RuleModel:
    """Boosted small trees give the rules, accelerated proximal gradient fits their lasso logistic weights."""
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        p = min(max(share, 0.01), 0.99)
        return RuleModel(float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin, rules = np.full(len(y), base), {}
    for _ in range(trees):
        some = rng.random(len(y)) < 0.5
        p = 1 / (1 + np.exp(-margin[some]))
        nodes = grow(x[some], y[some] - p, depth, rng)
        for rule, _ in nodes:
            rules.setdefault(tuple(sorted(rule)), rule)
        inner = {tuple(rule[:-1]) for rule, _ in nodes}
        for rule, _ in nodes:
            if tuple(rule) not in inner:  # a leaf
                rows = holds(rule, x)
                q = 1 / (1 + np.exp(-margin[rows]))
                margin[rows] += 0.3 * np.clip((y[rows] - q).sum() / max((q * (1 - q)).sum(), 1e-3), -4, 4)
    kept = list(rules.values())
    a = np.stack([holds(r, x) for r in kept], axis=1).astype(np.float32)
    mean = a.mean(axis=0)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
    z = (a - mean) / scale
    w, b, v, vb, t = np.zeros(z.shape[1]), base, np.zeros(z.shape[1]), base, 1.0
    step = 4.0 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    for _ in range(400):
        g = 1 / (1 + np.exp(-(z @ v + vb))) - y
        new = v - step * (z.T @ g / len(y))
        new = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
        newb = vb - step * g.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), newb + (t - 1) / t2 * (newb - b)
        w, b, t = new, newb, t2
    weights = w / scale
    chosen = [(r, float(k)) for r, k in zip(kept, weights) if abs(k) > 1e-6]
    return RuleModel(float(b - (weights * mean).sum()), chosen)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 5 == 0


def train(stats: DataFrame, labels: DataFrame, key: str = "doc_id", max_rows: int = MAX_LABELLED) -> RuleModel:
    """Fit on at most max_rows labelled rows that aren't held out. stats: key and features; labels: their key, quality."""
    own = labels.select(F.col(key).alias("key"), F.col("quality").cast("double").alias("y")).filter(F.col("y").isin(0.0, 1.0) & F.coalesce(~held_out(F.col("key")), F.lit(False)))
    inputs = [f"x_{k}" for k in FEATURES]
    rows = stats.join(own, "key").orderBy(F.xxhash64("key"), *inputs).limit(max_rows).select("y", *inputs).toPandas()
    return fit(rows[inputs].to_numpy(np.float64), rows["y"].to_numpy(np.float64))


def score_quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = MAX_LABELLED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of df: key, held_out, score (0 to 1), predicted (1 from THRESHOLD on), and the columns of keep.

    labels (key, quality) serve the fit only. Null and empty texts are scored like any other, by features of no
    words; texts may be of any length; repeated rows are scored each, equal ones alike; a null key is held out of the
    fit; a key with several labels counts once for each in it; other columns are ignored, whatever their names; an empty table gives none. Without labelled rows, or with one
    label only, all scores are the same."""
    named = {"key": key} | {f"keep_{i}": c for i, c in enumerate(keep)}
    rows = df.select(*(F.col(c).alias(n) for n, c in named.items()), F.coalesce(F.col(text), F.lit("")).alias("body"))
    stats = written(features(rows, list(named)), "statistics")
    score = train(stats, labels, key, max_rows).column()
    out = stats.select(*named, F.coalesce(held_out(F.col("key")), F.lit(True)).alias("held_out"), score.alias("score"))
    out = out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
    return out.select(F.col("key").alias(key), "held_out", "score", "predicted", *(F.col(n).alias(c) for n, c in named.items() if n != "key"))
