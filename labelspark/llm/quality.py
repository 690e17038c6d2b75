"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees are grown on a bounded sample of labelled rows; each path
from a root to an inner node or leaf is a conjunctive rule. A lasso logistic
regression picks few of them, and the sum of their weights is one Spark column
expression over statistics that are column expressions too.

Defined results: a null text counts as empty, an empty text gets a score like
any other; without labels every score is 0.5 (predicted 1), with labels of one
class their smoothed share; labels of documents that are not there and null
labels are not used; a document labelled twice counts twice, and so does a row
that repeats a labelled doc_id, but never more than the sample in all; repeated
rows each get their score; a row without doc_id is never held out; columns of
the documents may have any names; an empty table gives an empty table. Language, source, doc_id and labels are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import spread

#: The most labelled rows that the model is fitted on, those of the least hashes.
SAMPLE = 6000
TREES, DEPTH, BINS, SHRINK = 40, 3, 24, 0.3
#: Lasso strengths tried, the strongest first; a weaker one must lower the held-back loss by 1 %.
STRENGTHS = (0.02, 0.01, 0.005, 0.002, 0.001)


def _share(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(0.0)


#: Classes of characters that are counted, and all of them together.
CLASSES = {"pipes": "|", "symbols": r"%#$&*@^~=<>{}\[\]_\\+", "bangs": "!?", "digits": "0-9", "capitals": "A-Z", "stops": ".;:", "commas": ","}
STATISTICS = ("log_words", "word_length", "distinct_words", "distinct_lines", "words_a_line", *CLASSES)


def with_statistics(rows: DataFrame, text: Column, name: str = "s") -> tuple[DataFrame, dict[str, str]]:
    """The rows with a column for each statistic of the text, called name and a number, and these names.

    Each step is a projection of its own, since a shared expression under a
    condition is not computed once: words and lines are split once, and classes
    are counted in what is left when one pass has taken out a-z, white space and
    all beyond ASCII.
    """
    carried = [F.col(f"`{c}`") for c in rows.columns]
    own = F.coalesce(text.cast("string"), F.lit(""))
    marks = F.regexp_replace(own, r"[^\x21-\x60\x7B-\x7E]+", "")
    split = rows.select(*carried, F.length(own).alias(f"{name}_size"), F.array_remove(F.split(own, r"[\x20\x09-\x0D]+"), "").alias(f"{name}_words"), F.split(own, "\n").alias(f"{name}_lines"), marks.alias(f"{name}_marks"))
    words, lines, left = (F.col(f"{name}_{x}") for x in ("words", "lines", "marks"))
    counts = {"size": F.col(f"{name}_size"), "words": F.size(words), "lines": F.size(lines), "own_words": F.size(F.array_distinct(words)), "own_lines": F.size(F.array_distinct(lines))}
    counts |= {k: F.length(left) - F.length(F.regexp_replace(left, f"[{c}]+", "")) for k, c in CLASSES.items()}
    counted = split.select(*carried, *[c.cast("double").alias(f"{name}_{k}") for k, c in counts.items()])
    n = {k: F.col(f"{name}_{k}") for k in counts}
    shares = {
        "log_words": F.log1p(n["words"]),
        "word_length": _share(n["size"] - n["words"], n["words"]),
        "distinct_words": _share(n["own_words"], n["words"]),
        "distinct_lines": _share(n["own_lines"], n["lines"]),
        "words_a_line": _share(n["words"], n["lines"]),
    } | {k: _share(n[k], n["size" if k in ("digits", "capitals") else "words"]) for k in CLASSES}
    names = {k: f"{name}_{i}" for i, k in enumerate(STATISTICS)}
    return counted.select(*carried, *[c.alias(names[k]) for k, c in shares.items()]), names


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, border): the statistic is above the border, or at most as large."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, border in self.terms:
            out &= (x[:, k] > border) == above
        return out


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    bias: float
    weights: tuple[float, ...]
    rules: tuple[Rule, ...]

    def column(self, stats: dict[str, Column]) -> Column:
        """The score as a column expression over the statistics."""
        total = F.lit(self.bias)
        for w, rule in zip(self.weights, self.rules, strict=True):
            fits = F.lit(True)
            for k, above, border in rule.terms:
                c = stats[self.names[k]]
                fits = fits & ((c > border) if above else (c <= border))
            total = total + F.when(fits, w).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for w, rule in zip(self.weights, self.rules, strict=True):
            total += w * rule.holds(x)
        return 1 / (1 + np.exp(-total))


def _borders(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, borders: list[np.ndarray]) -> tuple[list[Rule], np.ndarray]:
    """The rules of one tree on gradients g and curvatures h, and its step."""
    rules, step, todo = [], np.zeros(len(x)), [(np.arange(len(x)), ())]
    while todo:
        rows, terms = todo.pop()
        if terms:
            rules.append(Rule(terms))
        best = None
        if len(terms) < DEPTH and len(rows) >= 20:
            total_g, total_h = g[rows].sum(), h[rows].sum() + 1
            for k, own in enumerate(borders):
                if not len(own):
                    continue
                bin_ = np.searchsorted(own, x[rows, k], side="left")
                left_g = np.cumsum(np.bincount(bin_, g[rows], len(own) + 1))[:-1]
                left_h = np.cumsum(np.bincount(bin_, h[rows], len(own) + 1))[:-1]
                left_n = np.cumsum(np.bincount(bin_, minlength=len(own) + 1))[:-1]
                gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h) - total_g**2 / total_h
                gain[(left_n < 5) | (len(rows) - left_n < 5)] = 0
                at = int(gain.argmax())
                if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
                    best = gain[at], k, float(own[at])
        if best is None:
            step[rows] = -g[rows].sum() / (h[rows].sum() + 1)
            continue
        _, k, border = best
        above = x[rows, k] > border
        todo += [(rows[~above], (*terms, (k, False, border))), (rows[above], (*terms, (k, True, border)))]
    return rules, step


def _lasso(z: np.ndarray, y: np.ndarray, strength: float, start: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Weights of l1-penalised logistic regression by accelerated proximal steps; the last weight is the bias, unpenalised."""
    a = np.c_[z, np.ones(len(z))]
    v = np.ones(a.shape[1])
    for _ in range(15):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    rate = 4 * len(z) / (np.linalg.norm(a @ v) ** 2 * 1.05)
    w = start.copy()
    u, t = w, 1.0
    for _ in range(rounds):
        grad = a.T @ (1 / (1 + np.exp(-np.clip(a @ u, -30, 30))) - y) / len(z)
        new = u - rate * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * strength, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


def fit_rules(x: np.ndarray, y: np.ndarray, names: tuple[str, ...]) -> Model:
    """A model of the labels y (0 or 1) by the statistics x."""
    n, ones = len(y), float(y.sum())
    share = (ones + 0.5) / (n + 1)
    if ones in (0.0, float(n)):
        return Model(names, 0.0 if not n else float(np.log(share / (1 - share))), (), ())
    borders, rng = _borders(x), np.random.default_rng(7)
    f, rules = np.full(n, np.log(share / (1 - share))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        rows = rng.random(n) < 0.7
        own, _ = _grow(x[rows], (p - y)[rows], (p * (1 - p))[rows], borders)
        rules |= dict.fromkeys(own)
        _, step = _grow(x, p - y, p * (1 - p), borders)
        f += SHRINK * step
    rules = list(rules)
    held = np.array([r.holds(x) for r in rules]).T
    _, first = np.unique(held, axis=1, return_index=True)  # one of the rules that hold for the same rows
    rules = [rules[k] for k in sorted(first)]
    z = held[:, sorted(first)].astype(float)
    scale = np.sqrt(np.maximum(z.mean(axis=0) * (1 - z.mean(axis=0)), 1e-4))
    z /= scale
    back = np.arange(n) % 5 == 0
    w, best = np.zeros(z.shape[1] + 1), None
    w[-1] = np.log(share / (1 - share))
    for strength in STRENGTHS:
        w = _lasso(z[~back], y[~back], strength, w)
        p = np.clip(1 / (1 + np.exp(-(z[back] @ w[:-1] + w[-1]))), 1e-9, 1 - 1e-9)
        loss = -np.mean(y[back] * np.log(p) + (1 - y[back]) * np.log(1 - p))
        if best is None or loss < 0.99 * best[0]:
            best = loss, strength, w.copy()
    w = _lasso(z, y, best[1], best[2])
    chosen = [k for k in range(len(rules)) if abs(w[k]) > 1e-6]
    return Model(names, float(w[-1]), tuple(float(w[k] / scale[k]) for k in chosen), tuple(rules[k] for k in chosen))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model fitted on at most `sample` labelled rows that are not held out, of documents that share a labelled doc_id too."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)  # at most sample rows: small enough to send to every executor
    found, stats = with_statistics(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"), F.col("text"))
    found = found.select("doc_id", "quality", *[F.col(c).alias(k) for k, c in stats.items()])
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *stats).limit(sample).collect()
    rows.sort(key=lambda r: tuple(r))
    x = np.array([r[2:] for r in rows], float).reshape(len(rows), len(stats))
    return fit_rules(x, np.array([r.quality for r in rows], float), tuple(stats))


def _scored(rows: DataFrame, text: str, model: Model, name: str) -> DataFrame:
    """The rows with their score, which leaves an explode: no filter on it passes that, so nothing is computed twice."""
    stats, names = with_statistics(rows, F.col(text), name)
    return stats.select(*[F.col(f"`{c}`") for c in rows.columns], F.explode(F.array(model.column({k: F.col(c) for k, c in names.items()}))).alias(name))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    out = _scored(spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "text", model, "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """The documents, all their columns, whose score is at least `least`."""
    model = fit(documents, labels, sample)
    # columns travel under numbers, so that theirs may have any names
    rows = spread(documents).select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(documents.columns)])
    text = next(f"c{k}" for k, c in enumerate(documents.columns) if c == "text")
    good = _scored(rows, text, model, "score").filter(F.col("score") >= least)
    return good.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(documents.columns)])
