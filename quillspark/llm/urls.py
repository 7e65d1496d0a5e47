"""URL filters: rules first, then naive Bayes over the words that hosts and paths are made of.

Names are cut at everything but letters and digits.  Each distinct name is split into words by
Viterbi over a unigram model counted from the pages' own text: the split with the largest probability
wins, and strings that are no word cost more the longer they are.  Only counts of strings that occur inside names are
needed, and those come by a join, so the vocabulary is neither cut nor broadcast.
Multinomial naive Bayes is counted over all pages whose url a rule decides, with the
rule's verdict as the label, and judges the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import ready, written

#: No word is longer; longer runs are split.
MAX_WORD = 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://``, and path; both empty without one or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lowered(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict. A rule ``host/path`` fits its host and subdomains if the path starts as its path does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):  # longer ones are tried first
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def names_of(c: Column) -> Column:
    """Runs of ASCII letters and digits and of characters beyond ASCII; digits alone are one name."""
    parts = F.filter(F.split(lowered(c), "[\\x00-/:-`{-\\x7f]+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("0")).otherwise(x))


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts, markup taken out, for words of at most MAX_WORD characters."""
    plain = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "<[^>]*>", " ")
    words = texts.select(F.explode(F.split(lowered(plain), "[\\x00-/:-`{-\\x7f]+")).alias("word"))
    return words.where(F.length("word").between(1, MAX_WORD)).groupBy("word").agg(F.count("*").alias("n"))


def best_split(name: str, counts: dict[tuple[int, int], int], total: int) -> list[str]:
    """The most probable split. A string without a count of length k has probability 10 / (total * 10^k); ties go to the longer last word."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        choice = None
        for start in range(max(0, end - MAX_WORD), end):
            n = counts.get((start, end), 0)
            p = math.log(n / total) if n else math.log(10 / total) - (end - start) * math.log(10)
            score = best[start][0] + p
            if choice is None or score > choice[0] + 1e-12:
                choice = (score, start)
        best.append(choice)
    out, end = [], len(name)
    while end:
        out.append(name[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def split_names(names: DataFrame, unigrams: DataFrame, total: int) -> DataFrame:
    """(name, words) of distinct names."""
    n, at = F.length("name"), F.col("start")
    starts = names.select("name", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    pieces = starts.select("name", "start", F.explode(F.sequence(at + 1, F.least(n, at + MAX_WORD))).alias("end"))
    pieces = pieces.withColumn("word", F.col("name").substr(at + 1, F.col("end") - at))
    known = pieces.join(unigrams, "word").groupBy("name").agg(F.collect_list(F.struct("start", "end", "n")).alias("pieces"))
    full = names.join(known, "name", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.append(best_split(name, {(p["start"], p["end"]): p["n"] for p in parts or ()}, max(total, 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])

    return written(full.select("name", "pieces").mapInArrow(run, "name string, words array<string>"), "splits")


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", text_col: str = "html", default: str = "allow") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score (log-odds of block, null if a rule decides).

    Naive Bayes has add-one smoothing over all words seen in labelled urls; words not seen there do not count; odds of
    exactly one, and corpora in which the rules give one label only or none, take the default. Null urls have an empty host and path.
    Repeated urls are scored once.
    """
    ready(pages.sparkSession)
    host, path = host_and_path(F.col(url_col).cast("string"))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col(text_col).cast("string").alias("__text"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    lean = base.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"))
    places = written(lean.groupBy("host", "path", "says").agg(F.count("*").alias("pages")), "places")
    named = places.select("host", "path", "says", "pages", F.explode(F.concat(names_of(F.col("host")), names_of(F.col("path")))).alias("name"))
    unigrams = written(word_counts(base, "__text"), "unigrams")
    total = unigrams.agg(F.sum("n")).first()[0] or 0
    splits = split_names(named.select("name").distinct(), unigrams, total)
    # words of labelled pages, by label; counts per name first, so that frequent names are small
    by_name = named.where("says is not null").groupBy("name").agg(*[F.sum(F.when(F.col("says") == v, F.col("pages")).otherwise(0)).alias(v) for v in ("block", "allow")])
    counts = by_name.join(splits, "name").select(F.explode("words").alias("word"), "block", "allow").groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    counts = written(counts, "bayes")
    sums = counts.agg(F.sum("block").alias("b"), F.sum("allow").alias("a"), F.count("*").alias("v")).first()
    labels = {r["says"]: r["n"] for r in places.where("says is not null").groupBy("says").agg(F.sum("pages").alias("n")).collect()}
    if len(labels) < 2:
        return lean.select("page_id", "host", "path", "rule", F.coalesce("says", F.lit(default)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    odds = F.log((F.col("block") + 1) / F.lit(float(sums.b + sums.v))) - F.log((F.col("allow") + 1) / F.lit(float(sums.a + sums.v)))
    name_odds = splits.select("name", F.explode("words").alias("word")).join(counts.select("word", odds.alias("odds")), "word").groupBy("name").agg(F.sum("odds").alias("odds"))
    prior = math.log(labels["block"] / labels["allow"])
    scored = named.where("says is null").join(name_odds, "name").groupBy("host", "path").agg(F.sum("odds").alias("odds"))
    # hosts and paths are never null, so places without scored names keep the prior alone
    out = lean.join(scored, ["host", "path"], "left")
    score = F.when(F.col("says").isNull(), F.round(F.coalesce("odds", F.lit(0.0)) + F.lit(prior), 9))
    verdict = F.coalesce("says", F.when(score == 0, F.lit(default)).when(score > 0, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))
