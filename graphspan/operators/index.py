"""Index statistics and postings over key, content and knowledge channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import stem_labels
from ..schema import BM25_B, BM25_K1, STOP_FRACTION, STOP_FROM
from ..sources.scratch import kept, lookup_join


def _counted(rows: DataFrame, item: str, weights: DataFrame | None) -> DataFrame:
    """item, df: in how many graphs an item is, of distinct (graph_id, item) rows; weights (graph_id, w): what each graph counts for."""
    if weights is None:
        return rows.groupBy(item).agg(F.count("*").alias("df"))
    return lookup_join(rows, weights, ["graph_id"]).groupBy(item).agg(F.sum("w").alias("df"))


def key_stats(keys: DataFrame, n: int, stop_fraction: float = STOP_FRACTION, weights: DataFrame | None = None) -> DataFrame:
    """key, df, idf, stop: of distinct (graph_id, key) rows.  Keys of more graphs than the cutoff are dead; below
    STOP_FROM graphs none is."""
    cutoff = float(n) if n < STOP_FROM else stop_fraction * n
    df = _counted(keys, "key", weights)
    return df.select("key", "df", (F.log(F.lit(n + 1.0) / (F.col("df") + 1.0)) + 1e-9).alias("idf"), (F.col("df") > cutoff).alias("stop"))


def content_terms(nodes: DataFrame) -> DataFrame:
    """graph_id, term, tf of the stems of a graph's labels, stop words left out; each distinct label is stemmed once."""
    stems = kept(stem_labels(nodes.select("label").distinct()).filter(F.size("stems") > 0))
    return lookup_join(nodes.select("graph_id", "label"), stems, ["label"]).select("graph_id", F.explode("stems").alias("term")).groupBy("graph_id", "term").agg(F.count("*").alias("tf"))


def content_stats(terms: DataFrame, n: int, weights: DataFrame | None = None) -> DataFrame:
    """term, df, idf = ln((n + 1) / (df + 0.5))."""
    return _counted(terms, "term", weights).select("term", "df", F.log(F.lit(n + 1.0) / (F.col("df") + 0.5)).alias("idf"))


def lengths(terms: DataFrame) -> DataFrame:
    return terms.groupBy("graph_id").agg(F.sum("tf").alias("length"))


def about_stats(knowledge: DataFrame, n: int, weights: DataFrame | None = None) -> DataFrame:
    """ref, df, idf = ln((n + 1) / (df + 1)), of what nodes are about; refs of every graph weigh nothing and are dropped."""
    df = _counted(knowledge.filter("bucket = 'about'").select("graph_id", "ref").distinct(), "ref", weights)
    return df.select("ref", "df", F.log(F.lit(n + 1.0) / (F.col("df") + 1.0)).alias("idf")).filter("idf > 0")


def bm25(tf: Column, length: Column, average: Column) -> Column:
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / F.greatest(average, F.lit(1e-9))))


def _of_queries(rows: DataFrame, query_ids: DataFrame) -> DataFrame:
    """rows of the queries, under query_id."""
    return lookup_join(rows, query_ids.select(F.col("query_id").alias("graph_id")), ["graph_id"]).withColumnRenamed("graph_id", "query_id")


def content_impacts(terms: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """graph_id, term, impact: what a term's posting adds for each unit of its idf."""
    sized = lengths(terms)
    average = sized.agg(F.avg("length").alias("average")) if weights is None else lookup_join(sized, weights, ["graph_id"]).agg((F.sum(F.col("w") * F.col("length")) / F.sum("w")).alias("average"))
    return terms.join(sized, "graph_id").crossJoin(F.broadcast(average)).select("graph_id", "term", bm25(F.col("tf"), F.col("length"), F.col("average")).alias("impact"))


def content_terms_of(impacts: DataFrame, stats: DataFrame, query_ids: DataFrame) -> DataFrame:
    """query_id, term, idf, own: a query's terms, and its score for itself."""
    mine = _of_queries(impacts, query_ids).join(stats.filter("idf <> 0").select("term", "idf"), "term")
    return mine.withColumn("own", F.sum(F.col("idf") * F.col("impact")).over(Window.partitionBy("query_id"))).filter("own > 0").select("query_id", "term", "idf", "own")


def content_scores(terms: DataFrame, stats: DataFrame, query_ids: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """query_id, graph_id, content: BM25 over shared terms, as a share of the query's score for itself, at most 1; of some pairs
    alone if they are given."""
    impacts = content_impacts(terms)
    return content_of(kept(content_terms_of(impacts, stats, query_ids)), impacts, pairs)


def content_of(asked: DataFrame, impacts: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    hits = lookup_join(impacts, asked, ["term"]) if pairs is None else lookup_join(impacts, pairs, ["graph_id"]).join(asked, ["query_id", "term"])
    sums = hits.filter("graph_id <> query_id").groupBy("query_id", "graph_id").agg(F.sum(F.col("idf") * F.col("impact")).alias("score"), F.first("own").alias("own"))
    return sums.select("query_id", "graph_id", F.least(F.lit(1.0), F.col("score") / F.col("own")).alias("content"))


def knowledge_scores(knowledge: DataFrame, stats: DataFrame, query_ids: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """query_id, graph_id, about, complement: summed idf of the candidate's nodes that are about what the query is about, or
    about what it requires; of some pairs alone if they are given.  A candidate counts once for each node that refers to it."""
    asked = kept(_of_queries(knowledge, query_ids).select("query_id", "bucket", "ref").distinct().join(stats.select("ref", "idf"), "ref"))
    posts = knowledge.filter("bucket = 'about'").select("graph_id", "ref")
    hits = lookup_join(posts, asked, ["ref"]) if pairs is None else lookup_join(posts, pairs, ["graph_id"]).join(asked, ["query_id", "ref"])
    hits = hits.filter("graph_id <> query_id")
    part = lambda b: F.sum(F.when(F.col("bucket") == b, F.col("idf")))
    return hits.groupBy("query_id", "graph_id").agg(part("about").alias("about"), part("requires").alias("complement"))


def live_query_keys(prints: DataFrame, stats: DataFrame, query_ids: DataFrame, budget: int | None = 96) -> DataFrame:
    """query_id, key, idf, qa, qb: a query's records with live keys; of more than ``budget`` keys the rarest, then the least."""
    mine = _of_queries(prints, query_ids).select("query_id", "key", F.col("a").alias("qa"), F.col("b").alias("qb"))
    live = mine.join(stats.filter("not stop").select("key", "idf"), "key")
    if budget is None:
        return live
    order = Window.partitionBy("query_id").orderBy(F.desc("idf"), "key")
    return live.withColumn("place", F.dense_rank().over(order)).filter(F.col("place") <= budget).drop("place")


def snapshot(canonical: DataFrame) -> DataFrame:
    """snapshot: one digest of a corpus (graph_id, sha); rows are folded in their order by id."""
    per = canonical.select(F.pmod(F.xxhash64(F.col("graph_id").cast("string")), F.lit(4096)).alias("bucket"), F.concat_ws(":", F.col("graph_id").cast("string"), "sha").alias("line"))
    folded = per.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ","), 256).alias("digest"))
    return folded.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("bucket").cast("string"), "digest"))), ","), 256).alias("snapshot"))
