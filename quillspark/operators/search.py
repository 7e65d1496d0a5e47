"""Full-text search: postings, ranking, language models, retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import scoring
from quillspark.plans import boolean


def token_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, term): lower-cased runs between white space."""
    t = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda x: x != "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(t).alias("pos", "term"))


def postings(tokens: DataFrame) -> DataFrame:
    """term, doc_id, tf and ascending positions. A document's positions of one term are one row, so no row grows with the corpus."""
    return tokens.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def term_frequencies(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def term_stats(tf: DataFrame) -> DataFrame:
    """df and cf of each term."""
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def doc_lengths(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id").agg(F.count("*").alias("dl"))


def corpus_stats(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row: n documents and their average length."""
    return docs.agg(F.count("*").alias("n")).crossJoin(tokens.agg(F.count("*").alias("total"))).select("n", (F.col("total") / F.col("n")).alias("avgdl"))


def scored_terms(docs: DataFrame, tokens: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """term, doc_id, tf, df, n, dl, avgdl for the given terms, or all. The statistics row is one row by construction."""
    wanted = tokens if terms is None else tokens.where(F.col("term").isin(*terms))
    tf = term_frequencies(wanted)
    stats = term_stats(tf).select("term", "df")
    return tf.join(stats, "term").join(doc_lengths(tokens), "doc_id").crossJoin(F.broadcast(corpus_stats(docs, tokens)))


def bm25(docs: DataFrame, tokens: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score): sums over the terms."""
    s = scored_terms(docs, tokens, terms)
    return s.groupBy("doc_id").agg(F.sum(scoring.bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl"), k1, b)).alias("score"))


def tfidf(docs: DataFrame, tokens: DataFrame, terms: list[str]) -> DataFrame:
    s = scored_terms(docs, tokens, terms)
    return s.groupBy("doc_id").agg(F.sum(scoring.tfidf(F.col("tf"), F.col("df"), F.col("n"))).alias("score"))


def combined(docs: DataFrame, tokens: DataFrame, terms: list[str]) -> DataFrame:
    """Mean of the two scores."""
    s = scored_terms(docs, tokens, terms)
    both = scoring.combined(scoring.tfidf(F.col("tf"), F.col("df"), F.col("n")), scoring.bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl")))
    return s.groupBy("doc_id").agg(F.sum(both).alias("score"))


def search(docs: DataFrame, query: str, k: int, filter_term: str | None = None, exclude: bool = False) -> DataFrame:
    """Boolean matches ranked by the mean of tf-idf and BM25 over the query's terms, the k best; ties go to the smaller id."""
    tree = boolean.parse(query)
    tokens = token_rows(docs)
    post = postings(tokens)
    hits = boolean.evaluate(tree, post, docs.select("doc_id"))
    if filter_term:
        hits = hits.join(post.where(F.col("term") == filter_term.lower()), "doc_id", "left_anti" if exclude else "left_semi")
    terms = sorted(_terms(tree))
    ranked = hits.select("doc_id").join(combined(docs, tokens, terms), "doc_id", "left") if terms else hits.select("doc_id", F.lit(0.0).alias("score"))
    return ranked.select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def _terms(tree: boolean.Node) -> set[str]:
    if tree.kind in ("term", "phrase"):
        return set(tree.args)
    if tree.kind in ("and", "or"):
        return set().union(*(_terms(a) for a in tree.args))
    return set()


def language_model(tokens: DataFrame) -> DataFrame:
    """term, cf and its share of all tokens."""
    cf = tokens.groupBy("term").agg(F.count("*").alias("cf"))
    total = cf.agg(F.sum("cf").alias("total"))
    return cf.crossJoin(F.broadcast(total)).select("term", "cf", (F.col("cf") / F.col("total")).alias("p"))


def query_likelihood(tokens: DataFrame, terms: list[str], smoothing: str = "dirichlet", parameter: float = 1000.0, floor: float = 1e-10) -> DataFrame:
    """doc_id, ll (sum of ln P(term | document)) and perplexity for every document, terms that it lacks included."""
    wanted = tokens.where(F.col("term").isin(*terms))
    tf = term_frequencies(wanted)
    total = tokens.agg(F.count("*").alias("total"))
    p = wanted.groupBy("term").agg(F.count("*").alias("cf")).crossJoin(F.broadcast(total)).select("term", (F.col("cf") / F.col("total")).alias("p"))
    grid = doc_lengths(tokens).crossJoin(F.broadcast(p))  # p has a row per query term at most
    rows = grid.join(tf, ["doc_id", "term"], "left").withColumn("tf", F.coalesce("tf", F.lit(0)))
    model = scoring.dirichlet if smoothing == "dirichlet" else scoring.jelinek_mercer
    prob = F.greatest(F.lit(floor), model(F.col("tf"), F.col("dl"), F.col("p"), parameter))
    return rows.groupBy("doc_id").agg(F.sum(F.log(prob)).alias("ll"), F.pow(F.lit(2.0), -F.avg(F.log2(prob))).alias("perplexity"))


def ir_metrics(ranked: DataFrame, keys: list[str], k: int) -> DataFrame:
    """ranked: keys, rank (from 1), rel. precision and recall at k, average precision, nDCG at k, reciprocal rank."""
    w = Window.partitionBy(*keys)
    hit = (F.col("rel") > 0).cast("int")
    rows = ranked.withColumns({"hit": hit, "seen": F.sum(hit).over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)), "ideal": F.row_number().over(w.orderBy(F.desc("rel"), "rank"))})
    gain = lambda place: F.sum(F.when(place <= k, (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(place + 1)).otherwise(0.0))
    a = rows.groupBy(*keys).agg(
        F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias("top"),
        F.sum("hit").alias("relevant"),
        F.sum(F.when(F.col("hit") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        gain(F.col("rank")).alias("dcg"),
        gain(F.col("ideal")).alias("idcg"),
    )
    some = F.col("relevant") > 0
    return a.select(*keys, (F.col("top") / k).alias("precision"), F.when(some, F.col("top") / F.col("relevant")).otherwise(0.0).alias("recall"), F.when(some, F.col("ap") / F.col("relevant")).otherwise(0.0).alias("ap"), F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"), F.when(F.col("first").isNotNull(), 1 / F.col("first")).otherwise(0.0).alias("rr"))


def mmr(candidates: DataFrame, similarities: DataFrame, k: int, lam: float) -> DataFrame:
    """Maximal marginal relevance: doc_id and place. candidates (doc_id, score) are a query's top list, which is small by
    definition; the choice is sequential and made on the driver."""
    score = {r["doc_id"]: r["score"] for r in candidates.collect()}
    sim = {(r["a"], r["b"]): r["sim"] for r in similarities.collect()}
    chosen: list = []
    while score and len(chosen) < k:
        worth = {d: lam * s - (1 - lam) * max((sim.get((d, c), sim.get((c, d), 0.0)) for c in chosen), default=0.0) for d, s in score.items()}
        best = min(worth, key=lambda d: (-worth[d], d))
        chosen.append(best)
        score.pop(best)
    spark = candidates.sparkSession
    return spark.createDataFrame([(d, i) for i, d in enumerate(chosen, 1)], f"doc_id {candidates.schema['doc_id'].dataType.simpleString()}, place int")


def rocchio(query: DataFrame, docs: DataFrame, alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.15) -> DataFrame:
    """query: term, w; docs: doc_id, relevant, term, w. The moved query's term weights, none below 0."""
    n = docs.groupBy("relevant").agg(F.countDistinct("doc_id").alias("n"))
    part = docs.groupBy("relevant", "term").agg(F.sum("w").alias("s")).join(n, "relevant").select("term", F.when(F.col("relevant"), beta * F.col("s") / F.col("n")).otherwise(-gamma * F.col("s") / F.col("n")).alias("w"))
    moved = query.select("term", (alpha * F.col("w")).alias("w")).unionByName(part)
    return moved.groupBy("term").agg(F.greatest(F.lit(0.0), F.sum("w")).alias("w"))
