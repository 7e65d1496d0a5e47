"""Tokens, n-grams, stems, phonetic codes and edit distances."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that an analyzer leaves out.
STOP_WORDS = tuple(
    """a an the and or but in on at to for of with by from is was are were be been being have has had do does did
    will would shall should may might must can could it its he she they we you i this that these those am not no if
    so as than too very just about into over after before between under again further then once here there all each every both
    few more most other some such only own same up out off down his her my our their me him us them what which who
    whom when where why how""".split()
)
PUNCTUATION = r"[.,;:!?()\[\]{}\"']"


def tokens(text: Column, kind: str = "standard") -> Column:
    """Words of a text in order: kind whitespace, or standard (punctuation taken out)."""
    t = F.coalesce(text, F.lit(""))
    if kind == "standard":
        t = F.regexp_replace(t, PUNCTUATION, "")
    return F.filter(F.split(t, r"\s+"), lambda x: x != "")


def analyzed(text: Column, lower: bool = True, stop: tuple[str, ...] = STOP_WORDS, stem: bool = False) -> Column:
    out = tokens(F.lower(text) if lower else text)
    if stop:
        out = F.filter(out, lambda x: ~x.isin(*stop))
    return stems()(out) if stem else out


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """All runs of low to high characters, shorter first."""
    def of(n: int) -> Column:
        last = F.length(text) - n + 1
        runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
        return F.when(last >= 1, runs).otherwise(F.array().cast("array<string>"))

    parts = [of(n) for n in range(low, high + 1)]
    return F.concat(*parts)


def ngram_jaccard(a: Column, b: Column, n: int = 2) -> Column:
    """Multiset Jaccard of the n-grams of words padded with n - 1 underscores on both sides; 1 for equal words."""
    pad = "_" * (n - 1)
    x, y = (char_ngrams(F.concat(F.lit(pad), F.coalesce(c, F.lit("")), F.lit(pad)), n, n) for c in (a, b))
    count = lambda arr, g: F.size(F.filter(arr, lambda t: t == g))
    both = F.aggregate(F.array_distinct(F.array_union(x, y)), F.lit(0), lambda s, g: s + F.least(count(x, g), count(y, g)))
    every = F.aggregate(F.array_distinct(F.array_union(x, y)), F.lit(0), lambda s, g: s + F.greatest(count(x, g), count(y, g)))
    return F.when(a == b, F.lit(1.0)).when(every > 0, both / every).otherwise(F.lit(0.0))


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def osa(a: str, b: str) -> int:
    """Edits by insertion, deletion, substitution and swap of neighbours, each place edited once."""
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            best = min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, prev2[j - 2] + 1)
            cur.append(best)
        prev2, prev = prev, cur
    return prev[-1]


@functools.cache
def osa_distance():
    """Pandas function of two text columns."""

    @F.pandas_udf("int")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([osa(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return f


#: Digits of the Soundex code.
SOUNDEX = {**dict.fromkeys("BFPV", "1"), **dict.fromkeys("CGJKQSXZ", "2"), **dict.fromkeys("DT", "3"), "L": "4", **dict.fromkeys("MN", "5"), "R": "6"}


def soundex_plain(word: str) -> str:
    """Soundex in which every letter without a digit, H and W too, ends a run of one digit."""
    letters = [c for c in word.upper() if "A" <= c <= "Z"]
    if not letters:
        return ""
    out, last = letters[0], SOUNDEX.get(letters[0], "")
    for c in letters[1:]:
        d = SOUNDEX.get(c, "")
        if d and d != last:
            out += d
        last = d
    return (out + "000")[:4]


@functools.cache
def soundex_code():
    @F.pandas_udf("string")
    def f(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else soundex_plain(x))

    return f


VOWELS = "aeiou"


def _has_vowel(w: str) -> bool:
    return any(c in VOWELS or (c == "y" and i) for i, c in enumerate(w))


#: Endings and what replaces them, tried in this order.
LATE_ENDINGS = (("ational", "ate"), ("tional", "tion"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("biliti", "ble"), ("ement", ""), ("ness", ""), ("ment", ""), ("able", ""), ("ible", ""))


def light_stem(word: str) -> str:
    """A reduced suffix stemmer: plurals, -ed and -ing after a vowel, final y, then one late ending."""
    w = word
    if len(w) < 3:
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1]
    else:
        for e in ("ed", "ing"):
            if w.endswith(e) and _has_vowel(w[: -len(e)]):
                w = w[: -len(e)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "lsz":
                    w = w[:-1]
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for e, to in LATE_ENDINGS:
        if w.endswith(e) and len(w) - len(e) >= 3:
            return w[: -len(e)] + to
    return w


@functools.cache
def stems():
    """Pandas function from arrays of words to arrays of stems; each distinct word of a batch is stemmed once."""

    @F.pandas_udf("array<string>")
    def f(a: pd.Series) -> pd.Series:
        memo: dict[str, str] = {}
        return a.map(lambda ws: None if ws is None else [memo.setdefault(w, light_stem(w)) for w in ws])

    return f


def edits_of_one(word: str, letters: str = "abcdefghijklmnopqrstuvwxyz") -> list[str]:
    """All texts one deletion, swap, substitution or insertion away, repeats kept."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return [a + b[1:] for a, b in cuts if b] + [a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1] + [a + c + b[1:] for a, b in cuts if b for c in letters] + [a + c + b for a, b in cuts for c in letters]


def edit_variants(words: DataFrame, column: str) -> DataFrame:
    """(word, variant) for all of edits_of_one."""

    def run(parts):
        for p in parts:
            yield pd.DataFrame([(w, v) for w in p[column] if w is not None for v in edits_of_one(w)], columns=["word", "variant"])

    return words.select(column).mapInPandas(run, "word string, variant string")


def corrections(words: DataFrame, dictionary: DataFrame, word: str, entry: str, max_distance: int, k: int) -> DataFrame:
    """The k nearest dictionary entries within max_distance edits, ties by entry.

    Two texts within d edits share one of the texts left after deleting up to d characters from each, so candidates come from
    an equi-join on those and not from all pairs. max_distance is small (1 or 2), as deletions grow with its power.
    """

    def deletions(column: str, out: str):
        def run(parts):
            for p in parts:
                rows = []
                for w in p[column].dropna().unique():
                    level = seen = {w}
                    for _ in range(max_distance):
                        level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))}
                        seen = seen | level
                    rows += [(w, x) for x in seen]
                yield pd.DataFrame(rows, columns=[out, "__left"])

        return run

    a = words.select(F.col(word).alias("word")).distinct().mapInPandas(deletions("word", "word"), "word string, __left string")
    b = dictionary.select(F.col(entry).alias("entry")).distinct().mapInPandas(deletions("entry", "entry"), "entry string, __left string")
    pairs = a.join(b, "__left").select("word", "entry").distinct()
    from pyspark.sql.window import Window

    near = pairs.withColumn("distance", F.levenshtein("word", "entry")).where(F.col("distance") <= max_distance)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("distance", "entry"))).where(F.col("rank") <= k)


def djb2(text: str, modulus: int) -> int:
    h = 5381
    for b in text.encode():
        h = (h * 33 + b) & 0xFFFFFFFF
    return h % modulus


@functools.cache
def djb2_partition(modulus: int):
    @F.pandas_udf("int")
    def f(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else djb2(x, modulus)).astype("Int32")

    return f
