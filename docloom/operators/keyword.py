"""Keyword retrieval: token statistics and BM25."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.functions import patterns as P
from docloom.functions.text import tokens
from docloom.runtime import sized, stage


def query_terms(queries: DataFrame, key: str, text: str, terms: int = P.QUERY_TERMS) -> DataFrame:
    """(query_id, token, times): the first terms of each question; a repeated term counts again."""
    first = F.slice(tokens(text), 1, terms)
    return (
        queries.select(F.col(key).alias("query_id"), F.explode(first).alias("token"))
        .groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    )


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: number of records and their mean token count, over the whole table."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(tokens(text))).alias("avg_len"))


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score): negative scores, smaller is better, of all records that hold a term of the question.

    k1 = 1.2, b = 0.75; the inverse document frequency ln((N - n + 0.5) / (n + 0.5)) is 1e-6 where it is not
    positive. N, n and the mean length hold for the whole table even if ``scope`` (one column, the keys
    allowed) restricts the result. explode_outer keeps the optimizer from
    tokenizing again for a filter on the array's size. The corpus is exploded once and loses, before any shuffle, all tokens
    that no question has; counts per record and token combine on the map side.
    """
    q = query_terms(queries, query_key, query_text)
    wanted = sized(q.select("token").distinct())
    held = docs.select(F.col(key).alias("key"), tokens(text).alias("t")).select("key", F.size("t").alias("len"), F.explode_outer("t").alias("token"))
    tf = held.join(wanted, "token", "left_semi").groupBy("key", "len", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    stats = F.broadcast(corpus_stats(docs, text))  # one row
    idf = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weight = df.crossJoin(stats).select("token", "avg_len", F.when(idf > 0, idf).otherwise(F.lit(1e-6)).alias("idf"))
    if scope is not None:
        tf = tf.join(scope.toDF("key").distinct(), "key", "left_semi")
    part = F.col("times") * F.col("idf") * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avg_len")))
    return (
        tf.join(weight, "token").join(q, "token").withColumn("part", part)
        .groupBy("query_id", F.col("key").alias(key)).agg((-F.sum("part")).alias("score"))
    )


#: Questions of one pass over the index (their weights are at most 32 numbers each), and cells of a score table at once.
QUESTIONS, CELLS = 8192, 1 << 22


def index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms): the tokens of every record, written once, for any number of searches."""
    return stage(docs.select(key, tokens(text).alias("terms")), "index")


def term_weights(held: DataFrame, q: DataFrame) -> tuple[DataFrame, float]:
    """((query_id, token, weight), mean length): times x idf x 2.2 of all questions' terms q(query_id, token, times), from one pass over an index.

    Counts per term combine on the map side; of the vocabulary only the questions' terms are shuffled.
    """
    q = stage(q, "asked")
    wanted = sized(q.select("token").distinct())
    n = held.select(F.explode_outer(F.array_distinct("terms")).alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    total, mean = held.agg(F.count(F.lit(1)), F.avg(F.size("terms"))).first()
    idf = F.log((F.lit(float(total)) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weight = F.col("times") * F.when(idf > 0, idf).otherwise(F.lit(1e-6)) * 2.2
    return stage(q.join(n, "token").select("query_id", "token", weight.alias("weight")), "weights"), float(mean or 0.0)


def _best_cells(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k best positive cells of every column: by 9 digits, then the earlier row."""
    if len(s) > k:
        least = np.partition(s, len(s) - k, axis=0)[len(s) - k] - 2e-9
        r, c = np.nonzero((s > 0) & (s >= least))
    else:
        r, c = np.nonzero(s > 0)
    order = np.lexsort((r, -np.round(s[r, c], 9), c))
    r, c = r[order], c[order]
    keep = np.arange(len(c)) - np.searchsorted(c, c) < k
    return r[keep], c[keep]


def bm25_top(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, k: int, scope: DataFrame | None = None, size: int = QUESTIONS) -> DataFrame:
    """(query_id, key, score, rank): the k best records of each question by the scores of ``bm25``.

    The index is made once. The weights of all questions' terms come from one pass over it, the scores of up to ``size`` questions
    from a second: each Arrow batch of term lists meets the questions' terms as a product of two sparse tables in numpy, so the work is that
    of the postings which questions and records share; of every batch only the best k of each question are
    shuffled. More questions are further passes, each written before the next. ``scope`` (one column, the keys allowed) restricts the result only.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes) | {"_q": dict(queries.dtypes)[query_key]}
    schema = f"query_id {kinds['_q']}, {key} {kinds[key]}, score double"
    kind = to_arrow_type(queries.schema[query_key].dataType)
    held = index(docs, key, text)
    weights, mean = term_weights(held, query_terms(queries, query_key, query_text))
    allowed = held if scope is None else held.join(scope.toDF(key).distinct(), key, "left_semi")
    blocks = max(1, -(-weights.select("query_id").distinct().count() // size))
    out = None
    for block in range(blocks):
        own = weights if blocks == 1 else weights.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = own.toArrow()  # about ``size`` questions of at most 32 terms
        if not rows.num_rows:
            continue
        words, asks = (rows.column(c).combine_chunks().dictionary_encode() for c in ("token", "query_id"))
        term, ask, weight = words.indices.to_numpy(), asks.indices.to_numpy(), rows.column("weight").to_numpy()
        order = np.lexsort((ask, term))
        start = np.searchsorted(term[order], np.arange(len(words.dictionary) + 1))
        told = spark.sparkContext.broadcast((words.dictionary, start, ask[order], weight[order], asks.dictionary.cast(kind), mean))

        def score(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            vocab, start, ask, weight, names, mean = told.value
            for b in batches:
                if not b.num_rows:
                    continue
                b = b.take(pa.compute.sort_indices(b, sort_keys=[(b.schema.names[0], "ascending")]))
                length = b.column(1).value_lengths().fill_null(0).to_numpy()
                ids = pa.compute.fill_null(pa.compute.index_in(b.column(1).flatten(), value_set=vocab), -1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b.num_rows), length)[ids >= 0]
                code, tf = np.unique(row * len(vocab) + ids[ids >= 0], return_counts=True)
                row, t = code // len(vocab), code % len(vocab)
                part = tf / (tf + 1.2 * (0.25 + 0.75 * length[row] / mean))
                step = max(1, CELLS // len(names))
                for a in range(0, b.num_rows, step):
                    z = min(a + step, b.num_rows)
                    x, y = np.searchsorted(row, [a, z])
                    n = start[t[x:y] + 1] - start[t[x:y]]
                    at = np.repeat(start[t[x:y]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    s = np.bincount(np.repeat(row[x:y] - a, n) * len(names) + ask[at], weight[at] * np.repeat(part[x:y], n), (z - a) * len(names)).reshape(z - a, len(names))
                    r, c = _best_cells(s, k)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(c)), b.column(0).take(pa.array(r + a)), pa.array(-s[r, c])], names=["query_id", b.schema.names[0], "score"])

        part = top(allowed.select(key, "terms").mapInArrow(score, schema), "score", key, k)
        part = part if blocks == 1 else stage(part, "pass")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema + ", rank int") if out is None else out


def top(scored: DataFrame, by: str, key: str, limit: int, group: str = "query_id", best_first: bool = False) -> DataFrame:
    """The best ``limit`` rows of each group with their rank from 1; the window's limit is applied before the shuffle. Scores that agree to 9 digits rank by key."""
    score = F.round(by, 9)
    w = Window.partitionBy(group).orderBy(score.desc() if best_first else score.asc(), F.col(key).asc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
