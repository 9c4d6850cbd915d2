"""Quality classifier: a sparse rule ensemble compiled to Spark columns.

Statistics of a text are column expressions. On a bounded sample of labelled rows, small
boosted trees are grown; every path from a root to a node is a conjunctive rule over the
statistics; a lasso logistic regression weighs the rules and drops most. The rules that are
left are compiled back into one column expression, so all documents are scored by the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, unused_prefix

#: Labelled rows that a model is fitted on, at most; smallest seeded hashes first.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE = 24, 3, 32, 0.3
PENALTY, STEPS = 0.001, 400
#: Least share of the sample that a rule must hold for, and fail for.
SUPPORT = 0.002
#: A document is predicted good at this score.
KEEP_AT = 0.3


def _raw(text: Column) -> dict[str, Column]:
    """What statistics are made of: plain counts over the whole text (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return {
        "chars": F.length(text).cast("double"),
        "words": count(WORD),
        "distinct": F.size(F.array_distinct(F.split(text, r"[\x20\x09-\x0D]+"))).cast("double"),
        "again": count(r"(?<![^ ])(\S+) (?=\1(?![^ ]))"),
        "symbols": count(r"[#*$%&<>=^~_+{}\[\]\\@]"),
        "bars": count(r"\|"),
        "capitals": count(r"[A-Z]"),
        "exclaimed": count(r"!"),
        "stops": count(r"[.,;:?](?= |\n|$)"),
        "digits": count(r"[0-9]"),
        "breaks": count(r"\n"),
    }


def _ratios(raw: dict[str, Column]) -> dict[str, Column]:
    chars, words = F.greatest(raw["chars"], F.lit(1.0)), F.greatest(raw["words"], F.lit(1.0))
    return {
        "words": raw["words"],
        "letters_a_word": chars / words,
        "distinct": raw["distinct"] / words,
        "again": raw["again"] / words,
        "symbols": raw["symbols"] / chars,
        "bars": raw["bars"] / words,
        "capitals": raw["capitals"] / chars,
        "exclaimed": raw["exclaimed"] / words,
        "stops": raw["stops"] / words,
        "digits": raw["digits"] / chars,
        "lines": (raw["breaks"] + 1) / words,
    }


def statistics(text: Column) -> dict[str, Column]:
    """What rules may speak of: counts and shares over the whole text (null: empty)."""
    return _ratios(_raw(text))


def measured(docs: DataFrame, kept: list[Column], text: Column, prefix: str) -> DataFrame:
    """``kept`` and, named with ``prefix``, the statistics that rules may speak of.

    The counts come out of a one-row generator, through which no filter or projection passes:
    otherwise a filter by the score would be pushed to the scan, with the expressions of the
    counts in the place of each mention of them, and every rule would search the text again.
    """
    raw = F.struct(*(c.alias(f"{prefix}raw_{k}") for k, c in _raw(text).items()))
    counted = docs.select(*kept, F.inline(F.array(raw)))
    own = counted.columns[: len(kept)]
    stats = _ratios({k: F.col(f"{prefix}raw_{k}") for k in _raw(text)})
    return counted.select(*(F.col(f"`{k}`") for k in own), *(stats[k].alias(prefix + k) for k in NAMES))


NAMES = ("words", "letters_a_word", "distinct", "again", "symbols", "bars", "capitals", "exclaimed", "stops", "digits", "lines")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold): ``> t`` if above, else ``<= t``."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.terms:
            out &= (x[:, f] > t) if above else (x[:, f] <= t)
        return out

    def column(self, prefix: str) -> Column:
        out = None
        for f, above, t in self.terms:
            c = F.col(prefix + NAMES[f])
            c = (c > F.lit(t)) if above else (c <= F.lit(t))
            out = c if out is None else out & c
        return out


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[float, Rule], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for w, r in self.rules:
            z += w * r.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, prefix: str = "") -> Column:
        """The score as an expression over columns named as the statistics."""
        z = F.lit(self.intercept)
        for w, r in self.rules:
            z = z + F.when(r.column(prefix), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _tree(x: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray):
    """Leaf values by row, and the rules of all nodes but the root, of one boosted tree."""
    value, rules = np.zeros(len(grad)), []

    def grow(rows: np.ndarray, terms: tuple, depth: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None)
        if depth < DEPTH and len(rows) >= 10:
            for f, edges in enumerate(cuts):
                if not len(edges):
                    continue
                gs = np.bincount(binned[rows, f], grad[rows], len(edges) + 1).cumsum()[:-1]
                hs = np.bincount(binned[rows, f], hess[rows], len(edges) + 1).cumsum()[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
        if best[1] is None:
            value[rows] = g / (h + 1)
            return
        f, k = best[1]
        left = binned[rows, f] <= k
        for above, part in ((False, rows[left]), (True, rows[~left])):
            if len(part) == 0:
                continue
            path = (*terms, (f, above, float(cuts[f][k])))
            rules.append(Rule(path))
            grow(part, path, depth + 1)

    grow(np.arange(len(grad)), (), 0)
    return value, rules


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of P(y = 1). Without rows it says 0.5; with one class, nearly that class."""
    if not len(y):
        return Model(0.0, ())
    prior = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(prior / (1 - prior)))
    if y.min() == y.max():
        return Model(base, ())
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    z, found = np.full(len(y), base), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        value, rules = _tree(x, binned, cuts, y - p, p * (1 - p))
        z = z + RATE * value
        found.update(dict.fromkeys(rules))
    masks, kept = {}, []
    for r in sorted(found, key=lambda r: (len(r.terms), r.terms)):
        m = r.holds(x)
        if SUPPORT <= m.mean() <= 1 - SUPPORT and masks.setdefault(m.tobytes(), r) is r:
            kept.append(r)
    if not kept:
        return Model(base, ())
    a = np.stack([r.holds(x) for r in kept], axis=1).astype(np.float32)
    # proximal gradient with momentum; columns are 0/1, so the step is bounded by their sum
    w, b = np.zeros(len(kept)), base
    v, c, t = w.copy(), b, 1.0
    u = np.random.default_rng(0).normal(size=len(kept) + 1)
    for _ in range(20):
        q = a @ u[:-1].astype(np.float32) + u[-1]
        u = np.append(a.T @ q, q.sum())
        top = np.linalg.norm(u)
        u /= top
    step = 4 * len(y) / top
    for _ in range(STEPS):
        r = 1 / (1 + np.exp(-(a @ v.astype(np.float32) + c))) - y
        w2 = v - step * (a.T @ r) / len(y)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * PENALTY, 0)
        b2 = c - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return Model(float(b), tuple((float(x), r) for x, r in zip(w, kept, strict=True) if abs(x) > 1e-4))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of doc_id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows that aren't held out. Rows without a label, doc_id
    or text teach nothing; a document labelled twice counts twice. Only the sampled documents
    are measured, and only their statistics come to the driver."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.withColumn("place", F.xxhash64(F.lit(7), "doc_id"))
    n = usable.count()
    if n > sample:
        cut = usable.approxQuantile("place", [sample / n], 0.001)[0]
        usable = usable.where(F.col("place") <= cut).orderBy("place", "doc_id", "quality").limit(sample)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("text IS NOT NULL")
    rows = own.join(F.broadcast(usable.select("doc_id", "quality")), "doc_id")  # bounded by sample
    got = measured(rows, [F.col("doc_id"), F.col("quality")], F.col("text"), "stat_").toPandas()
    names = [f"stat_{k}" for k in NAMES]
    got = got.sort_values(["doc_id", "quality", *names])
    return fit(got[names].to_numpy(np.float64), got["quality"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: the score of each whole text, 0 to 1, null and empty
    texts too. Repeated rows stay repeated; all other columns are passed through, but one that
    has this name already, in whatever case, is replaced."""
    prefix = unused_prefix(docs.columns)
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    found = measured(docs, [F.col(f"`{c}`") for c in kept], F.col("text"), prefix)
    return found.select(*(F.col(f"`{c}`") for c in kept), model.column(prefix).alias(name))


def keep_good(docs: DataFrame, model: Model, least: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``least`` or more."""
    prefix = unused_prefix(docs.columns)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return measured(docs, own, F.col("text"), prefix).where(model.column(prefix) >= least).select(*own)
