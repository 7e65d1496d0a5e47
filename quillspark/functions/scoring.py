"""Retrieval scores, language models, vector algebra and distances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# -- term weights ------------------------------------------------------------
def idf(df: Column, n: Column | int) -> Column:
    """max(0, ln((n + 1) / (df + 0.5))); 0 if nothing is counted."""
    df, n = _c(df), _c(n)
    return F.when((df > 0) & (n > 0), F.greatest(F.lit(0.0), F.log((n + 1) / (df + 0.5)))).otherwise(F.lit(0.0))


def tfidf(tf: Column, df: Column, n: Column | int) -> Column:
    return F.when(_c(tf) > 0, F.log1p(_c(tf)) * idf(df, n)).otherwise(F.lit(0.0))


def tfidf_raw(tf: Column, df: Column, n: Column | int) -> Column:
    return F.when(_c(tf) > 0, _c(tf) * idf(df, n)).otherwise(F.lit(0.0))


def tfidf_augmented(tf: Column, df: Column, n: Column | int, max_tf: Column) -> Column:
    return F.when((_c(tf) > 0) & (_c(max_tf) > 0), (F.lit(0.5) + F.lit(0.5) * _c(tf) / _c(max_tf)) * idf(df, n)).otherwise(F.lit(0.0))


def bm25(tf: Column, df: Column, n: Column | int, length: Column, avg_length: Column | float, k1: float = 1.2, b: float = 0.75) -> Column:
    """The inverse document frequency is cut off at 0, so terms in more than half of all documents score nothing."""
    tf, df, n = _c(tf), _c(df), _c(n)
    weight = F.greatest(F.lit(0.0), F.log((n - df + 0.5) / (df + 0.5)))
    norm = tf * (k1 + 1) / (tf + k1 * (1 - b + b * _c(length) / _c(avg_length)))
    return F.when((tf > 0) & (df > 0), weight * norm).otherwise(F.lit(0.0))


def bm25f(tfs: list[Column], weights: list[float], df: Column, n: Column | int, length: Column, avg_length: Column | float, k1: float = 1.2, b: float = 0.75) -> Column:
    return bm25(sum((_c(t) * w for t, w in zip(tfs, weights, strict=True)), F.lit(0.0)), df, n, length, avg_length, k1, b)


def combined(*scores: Column) -> Column:
    return sum(scores[1:], scores[0]) / len(scores)


def weighted(scores: list[Column], weights: list[float]) -> Column:
    total = sum(weights)
    return sum((s * w for s, w in zip(scores, weights, strict=True)), F.lit(0.0)) / total if total > 0 else F.lit(0.0)


def by_length(raw: Column, length: Column, avg_length: Column | float) -> Column:
    rel = (_c(length) - _c(avg_length)) / _c(avg_length)
    return raw * F.least(F.lit(2.0), F.greatest(F.lit(0.1), 1 / F.sqrt(F.greatest(1 + rel, F.lit(1e-12)))))


def pivoted(raw: Column, length: Column, avg_length: Column | float, slope: float) -> Column:
    rel = F.greatest(F.lit(0.01), _c(length) / _c(avg_length))
    return raw * (1 / F.greatest(F.lit(0.01), 1 - slope + slope * rel)) / rel


def sigmoid_boost(score: Column, midpoint: float, steepness: float) -> Column:
    mid = midpoint if midpoint > 0 else 1.0
    return score / (1 + F.exp(-steepness * (score - mid)))


def gauss_decay(value: Column, origin: float, scale: float, offset: float, decay: float) -> Column:
    """1 inside offset, falling to decay far away: a bell of width scale over a floor of decay."""
    d = F.greatest(F.lit(0.0), F.abs(value - origin) - offset) / scale
    return F.exp(-(d * d) / 2) * (1 - decay) + decay


def overlap(query: Column, doc: Column) -> Column:
    """Share of the query's distinct terms that the document has."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, doc)) / F.size(F.array_distinct(query))).otherwise(F.lit(0.0))


# -- language models ---------------------------------------------------------
def dirichlet(tf: Column, length: Column, p_corpus: Column, mu: float) -> Column:
    return (tf + mu * p_corpus) / (length + mu) if mu > 0 else tf / length


def jelinek_mercer(tf: Column, length: Column, p_corpus: Column, lam: float) -> Column:
    lam = min(max(lam, 0.0), 1.0)
    return (1 - lam) * tf / length + lam * p_corpus


def absolute_discount(tf: Column, length: Column, distinct: Column, p_corpus: Column, delta: float) -> Column:
    return F.greatest(tf - delta, F.lit(0.0)) / length + delta * distinct / length * p_corpus


def two_stage(tf: Column, length: Column, p_corpus: Column, mu: float, lam: float, background: Column) -> Column:
    return (1 - lam) * dirichlet(tf, length, p_corpus, mu) + lam * background


# -- vectors (array<float> is summed in double) ------------------------------
def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _zip(a: Column, b: Column, f) -> Column:
    """Over the shorter of the two lengths."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(_doubles(a), 1, n), F.slice(_doubles(b), 1, n), f)


def dot(a: Column, b: Column) -> Column:
    return _sum(_zip(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(a), lambda x: x * x)))


def sq_l2(a: Column, b: Column) -> Column:
    return _sum(_zip(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(sq_l2(a, b))


def l1(a: Column, b: Column) -> Column:
    return _sum(_zip(a, b, lambda x, y: F.abs(x - y)))


def linf(a: Column, b: Column) -> Column:
    return F.coalesce(F.array_max(_zip(a, b, lambda x, y: F.abs(x - y))), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 1e-8, F.transform(_doubles(a), lambda x: x / n)).otherwise(_doubles(a))


def add(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x - y)


def scale(a: Column, s: float) -> Column:
    return F.transform(_doubles(a), lambda x: x * s)


def bits(a: Column, threshold: float = 0.0) -> Column:
    return F.transform(_doubles(a), lambda x: x > threshold)


def hamming(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x))


def jaccard_bits(a: Column, b: Column) -> Column:
    """1 less shared over all set bits; 0 if none is set."""
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: x & y), lambda x: x))
    any_ = F.size(F.filter(F.zip_with(a, b, lambda x, y: x | y), lambda x: x))
    return F.when(any_ > 0, 1 - both / any_).otherwise(F.lit(0.0))


#: Distances by name; smaller is nearer.
METRICS = {
    "l2": l2,
    "sq_l2": sq_l2,
    "l1": l1,
    "linf": linf,
    "cosine": lambda a, b: 1 - cosine(a, b),
    "ip": lambda a, b: -dot(a, b),
    "hamming": lambda a, b: hamming(bits(a), bits(b)).cast("double"),
    "jaccard": lambda a, b: jaccard_bits(bits(a), bits(b)),
}
