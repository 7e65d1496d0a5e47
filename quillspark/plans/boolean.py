"""Boolean search: a parser for AND, OR, NOT, parentheses, ``prefix*`` and ``"phrases"``, and its DataFrame plan.

OR binds weakest, then AND (also implied between neighbours), then NOT.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    kind: str  # term, prefix, phrase, and, or, not
    args: tuple


_TOKEN = re.compile(r'\s*(?:(\()|(\))|"([^"]*)"|([^\s()"]+))')


def parse(query: str) -> Node:
    """The syntax tree; raises ValueError for what is no query."""
    tokens: list[tuple[str, str]] = []
    at, text = 0, query.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unreadable at {at}: {query!r}")
        at = m.end()
        for kind, value in zip(("(", ")", "phrase", "word"), m.groups(), strict=True):
            if value is not None:
                tokens.append(("op" if kind == "word" and value in ("AND", "OR", "NOT") else kind, value))
    pos = 0

    def peek() -> tuple[str, str] | None:
        return tokens[pos] if pos < len(tokens) else None

    def either() -> Node:
        nonlocal pos
        parts = [both()]
        while peek() == ("op", "OR"):
            pos += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def both() -> Node:
        nonlocal pos
        parts = [unary()]
        while (t := peek()) and t != ("op", "OR") and t[0] != ")":
            if t == ("op", "AND"):
                pos += 1
            parts.append(unary())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def unary() -> Node:
        nonlocal pos
        t = peek()
        if t is None or t[0] == ")" or t in (("op", "AND"), ("op", "OR")):
            raise ValueError(f"a term is missing: {query!r}")
        pos += 1
        if t == ("op", "NOT"):
            return Node("not", (unary(),))
        if t[0] == "(":
            inner = either()
            if peek() is None or peek()[0] != ")":
                raise ValueError(f"a parenthesis stays open: {query!r}")
            pos += 1
            return inner
        if t[0] == "phrase":
            return Node("phrase", tuple(t[1].lower().split()))
        word = t[1].lower()
        return Node("prefix", (word[:-1],)) if word.endswith("*") and len(word) > 1 else Node("term", (word,))

    tree = either()
    if pos != len(tokens):
        raise ValueError(f"more than a query: {query!r}")
    return tree


def evaluate(tree: Node, postings: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, tf) of the matches. postings: term, doc_id, tf, positions; docs: doc_id of all documents. NOT gives tf 0."""
    if tree.kind == "term":
        return postings.where(F.col("term") == tree.args[0]).select("doc_id", F.col("tf").cast("long").alias("tf"))
    if tree.kind == "prefix":
        return postings.where(F.col("term").startswith(tree.args[0])).groupBy("doc_id").agg(F.sum("tf").alias("tf"))
    if tree.kind == "phrase":
        return phrase(postings, list(tree.args))
    if tree.kind == "not":
        return docs.join(evaluate(tree.args[0], postings, docs), "doc_id", "left_anti").select("doc_id", F.lit(0).cast("long").alias("tf"))
    parts = [evaluate(a, postings, docs) for a in tree.args]
    if tree.kind == "or":
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("doc_id").agg(F.sum("tf").alias("tf"))
    out = parts[0]
    for part, node in zip(parts[1:], tree.args[1:], strict=True):
        if node.kind == "not":  # no need for all other documents
            out = out.join(evaluate(node.args[0], postings, docs), "doc_id", "left_anti")
        else:
            out = out.join(part.withColumnRenamed("tf", "__tf"), "doc_id").select("doc_id", (F.col("tf") + F.col("__tf")).alias("tf"))
    return out


def phrase(postings: DataFrame, words: list[str], slop: int = 0) -> DataFrame:
    """Documents in which the words stand in order, each at most slop places further from the one before than next to it."""
    if not words:
        return postings.where("false").select("doc_id", F.col("tf").cast("long").alias("tf"))
    out = postings.where(F.col("term") == words[0]).select("doc_id", F.col("positions").alias("p"))
    for w in words[1:]:
        nxt = postings.where(F.col("term") == w).select("doc_id", F.col("positions").alias("q"))
        near = F.filter("q", lambda b: F.exists("p", lambda a: (b > a) & (b <= a + 1 + slop)))
        out = out.join(nxt, "doc_id").select("doc_id", near.alias("p")).where(F.size("p") > 0)
    return out.select("doc_id", F.size("p").cast("long").alias("tf"))


def proximity(postings: DataFrame, first: str, second: str, within: int) -> DataFrame:
    """Documents in which second stands 0 to within places after first."""
    a = postings.where(F.col("term") == first).select("doc_id", F.col("positions").alias("p"))
    b = postings.where(F.col("term") == second).select("doc_id", F.col("positions").alias("q"))
    return a.join(b, "doc_id").where(F.exists("q", lambda y: F.exists("p", lambda x: (y - x).between(0, within)))).select("doc_id")
