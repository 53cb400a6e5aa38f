"""The most similar vectors for every vector (problem 6), by an inverted multi-index.

Fitting: each half of the unit vectors gets a codebook of K centroids by
k-means on a bounded sample (the vectors with the smallest hashed ids). K grows
with the root of the number of vectors, so a cell holds about ``CELL`` of them at any size up to ``BOOK`` centroids.
Indexing: every vector lies in the cell of its two nearest half centroids.
Search: a query walks the centroid pairs in order of summed distance with a
heap until the cells it met hold enough candidates, and reranks their entries
by exact cosine of the original numbers in double precision. How many are enough is measured: for a
bounded sample of queries the true neighbours are found by brute force, and the walk goes as far
as ``recall`` of them need.

Entries are shuffled once by cell, queries once to each cell they walk to, so
the shuffle grows in proportion to the vectors. Only a cell of more than ``ENTRIES`` entries
or ``QUERIES`` queries is cut into pieces, each pair of pieces being a task group of its own.
Equal vectors are one class in the index, so a vector held by a third of all
rows costs one entry; its members are ranked afterwards.

Vectors that are null, all zero, not of ``dim`` numbers or hold a null, a NaN or
an infinite number take no part. Cosines that agree to 9 digits are ties, broken by the smaller id. A row that
comes twice counts once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.copies import copies
from docloom.runtime import drop_keys, hashed_sample, stage

DIM = 64
SAMPLE = 20_000
#: Entries of a cell on average, and most centroids of a codebook (the counts of its cells are 4 MB at most).
CELL, BOOK = 256, 1024
#: Queries whose true neighbours are found by brute force, the share of these that the walk must reach, and the least candidates of a walk.
PROBES, RECALL, LEAST = 1024, 0.995, 500
ENTRIES, QUERIES = 8192, 8192
#: Pairs whose exact cosines are made at once.
CELLS = 1 << 16


def usable(df: DataFrame, key: str, vector: str, dim: int = DIM) -> DataFrame:
    """(key, v): the vectors as bytes of float32, of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            sizes = col.value_lengths().fill_null(0).to_numpy()
            b = b.filter(pa.array(sizes == dim))
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.sqrt((x * x).sum(axis=1))
            good = np.isfinite(norm) & (norm > 0)
            own = np.ascontiguousarray(x[good].astype(np.float32))
            own[own == 0] = 0  # -0.0 equals 0.0
            raw = pa.Array.from_buffers(pa.binary(dim * 4), len(own), [None, pa.py_buffer(own.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), raw], names=["key", "v"])

    return df.where(F.col(key).isNotNull()).select(key, vector).mapInArrow(run, "key long, v binary").distinct()


def unpack(raw: list[bytes], dim: int = DIM) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of all x to all centers."""
    return (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)[None, :]


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from a seeded choice of points; an empty cluster takes the point farthest from its center."""
    rng = np.random.default_rng(seed)
    centers = x[rng.permutation(len(x))[:k]].astype(np.float64)
    for _ in range(rounds):
        d = nearest(x, centers)
        own = d.argmin(1)
        far = np.argsort(-d[np.arange(len(x)), own])
        taken = 0
        for c in range(len(centers)):
            mine = x[own == c]
            if len(mine):
                centers[c] = mine.mean(0)
            else:
                centers[c] = x[far[taken]]
                taken += 1
    return centers


def fit(vectors: DataFrame, count: int, dim: int = DIM, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of the two halves, from the ``sample`` vectors whose ids hash smallest, at most 40 for each centroid more."""
    k = max(2, min(BOOK, int(np.sqrt(count / CELL))))
    picked = hashed_sample(vectors.select("key", "v"), max(sample, 40 * k), "key").select("v").toPandas()
    x = unpack([bytes(v) for v in picked["v"]], dim)
    k, half = min(k, len(x)), dim // 2
    return kmeans(x[:, :half], k), kmeans(x[:, half:], k)


def walk(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, candidates: int) -> list[tuple[int, int]]:
    """Cells (i, j) in order of d1[i] + d2[j], until those met hold the wanted number of entries."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, cells, held = [(s1[0] + s2[0], 0, 0)], [], 0
    while heap and held < candidates:
        _, a, b = heapq.heappop(heap)
        n = counts[o1[a], o2[b]]
        if n:
            cells.append((o1[a], o2[b]))
            held += n
        # each pair is pushed once: along the row always, down the first column only
        if b + 1 < len(s2):
            heapq.heappush(heap, (s1[a] + s2[b + 1], a, b + 1))
        if b == 0 and a + 1 < len(s1):
            heapq.heappush(heap, (s1[a + 1] + s2[0], a + 1, 0))
    return cells


def needed(index: DataFrame, books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, k: int, floor: float, dim: int = DIM, probes: int = PROBES, recall: float = RECALL) -> int:
    """Candidates that reach ``recall`` of the true neighbours of a sample of queries, with a fifth more."""
    asked = hashed_sample(index.select("key", "v"), probes, "key").collect()
    ids, q = np.array([r.key for r in asked]), unpack([bytes(r.v) for r in asked], dim)
    told, half = index.sparkSession.sparkContext.broadcast((ids, q)), dim // 2

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, mat = told.value
        for b in batches:
            if not b.num_rows:
                continue
            x, own = unpack(b.column(1).to_pylist(), dim), b.column(0).to_numpy()
            cos = mat @ x.T
            cos[names[:, None] == own[None, :]] = -2
            top = np.argpartition(-cos, k - 1, axis=1)[:, :k] if len(own) > k else np.broadcast_to(np.arange(len(own)), cos.shape)
            r, c = np.repeat(np.arange(len(names)), top.shape[1]), top.ravel()
            keep = cos[r, c] >= floor
            r, c = r[keep], c[keep]
            take = pa.array(c)
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(np.round(cos[r, c], 9)), b.column(0).take(take), b.column(2).take(take), b.column(3).take(take)], names=["q", "cosine", "key", "i", "j"])

    w = Window.partitionBy("q").orderBy(F.desc("cosine"), "key")
    near = index.mapInArrow(best, "q int, cosine double, key long, i int, j int").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    want = []
    walks: dict[int, dict[tuple[int, int], int]] = {}
    d1, d2 = nearest(q[:, :half], books[0]), nearest(q[:, half:], books[1])
    for r in near.collect():  # at most probes x k rows
        if r.q not in walks:
            held, at = 0, {}
            for cell in walk(d1[r.q], d2[r.q], counts, int(counts.sum())):
                at[cell] = held  # entries met before this cell
                held += counts[cell]
            walks[r.q] = at
        want.append(walks[r.q][r.i, r.j] + 1)
    return max(LEAST, int(1.2 * float(np.quantile(want, recall))) if want else 0)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, dim: int = DIM, candidates: int | None = None, floor: float = -1.0) -> DataFrame:
    """(query, other, cosine): up to k most similar other rows of ``vectors`` for every row of ``queries`` (both (key, v)), of at least ``floor``.

    ``candidates`` fixes how far a walk goes; by default it is measured.
    """
    spark = vectors.sparkSession
    total = vectors.count()
    if not total:
        return spark.createDataFrame([], "query long, other long, cosine double")
    c1, c2 = fit(vectors, total, dim)
    half, books = dim // 2, spark.sparkContext.broadcast((c1, c2))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        for b in batches:
            if b.num_rows:
                x = unpack(b.column(1).to_pylist(), dim)
                i, j = nearest(x[:, :half], one).argmin(1), nearest(x[:, half:], two).argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], names=["key", "v", "i", "j"])

    index = stage(vectors.select("key", "v").mapInArrow(assign, "key long, v binary, i int, j int"), "cells")
    # at most BOOK x BOOK cells, whatever the number of vectors
    counts = np.zeros((len(c1), len(c2)), np.int32)
    for i, j, n in index.groupBy("i", "j").count().collect():
        counts[i, j] = n
    enough = candidates or needed(index, (c1, c2), counts, k, floor, dim)
    table = spark.sparkContext.broadcast(counts)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        for b in batches:
            row, cell = [], []
            if b.num_rows:
                x = unpack(b.column(1).to_pylist(), dim)
                for r, (d1, d2) in enumerate(zip(nearest(x[:, :half], one), nearest(x[:, half:], two))):
                    own = walk(d1, d2, table.value, enough)
                    row += [r] * len(own)
                    cell += [i * len(two) + j for i, j in own]
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(cell, pa.int32())], names=["key", "v", "cell"])

    probes = stage(queries.select("key", "v").mapInArrow(probe, "key long, v binary, cell int"), "probes")
    asked = np.zeros(counts.size, np.int64)
    for c, n in probes.groupBy("cell").count().collect():  # at most BOOK x BOOK rows
        asked[c] = n
    crowded = [(int(c), max(1, -(-int(counts.flat[c]) // ENTRIES)), max(1, -(-int(asked[c]) // QUERIES))) for c in np.flatnonzero((counts.ravel() > ENTRIES) | (asked > QUERIES))]
    pieces = F.broadcast(spark.createDataFrame(crowded, "cell int, e int, n int"))  # crowded cells only, at most total / ENTRIES + asks / QUERIES of them

    def cut(rows: DataFrame, own: str, other: str, own_piece: str, other_piece: str) -> DataFrame:
        """Rows of a crowded cell: in one piece of their own side, and once for every piece of the other."""
        return rows.join(pieces, "cell", "left").select(
            "cell", F.pmod(F.xxhash64("key"), F.coalesce(own, F.lit(1))).cast("int").alias(own_piece), F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(other_piece), "key", "v"
        )

    entries = cut(index.select((F.col("i") * len(c2) + F.col("j")).alias("cell"), "key", "v"), "e", "n", "ep", "qp")
    asks = cut(probes, "n", "e", "qp", "ep")

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": pd.Series([], dtype="int64"), "other": pd.Series([], dtype="int64"), "cosine": pd.Series([], dtype="float64")})
        if left.empty or right.empty:
            return none
        left = left.sort_values("key", kind="stable")
        e, ids = unpack(left["v"].tolist(), dim), left["key"].to_numpy()
        single = e.astype(np.float32)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(right), 1024):
            part = right.iloc[at : at + 1024]
            who, q = part["key"].to_numpy(), unpack(part["v"].tolist(), dim)
            # few pairs reach the floor: single precision finds those near it, double precision gives their cosines
            near = q.astype(np.float32) @ single.T >= np.float32(max(floor, -1.5) - 1e-4)
            near &= who[:, None] != ids[None, :]
            r, c = np.nonzero(near)
            cos = np.round(np.concatenate([np.zeros(0), *((q[r[x : x + CELLS]] * e[c[x : x + CELLS]]).sum(1) for x in range(0, len(r), CELLS))]), 9)
            keep = cos >= max(floor, -1.5)
            r, c, cos = r[keep], c[keep], cos[keep]
            order = np.lexsort((ids[c], -cos, r))
            r, c, cos = r[order], c[order], cos[order]
            best = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append((who[r[best]], ids[c[best]], cos[best]))
        return pd.DataFrame({n: np.concatenate([o[x] for o in out]) for x, n in enumerate(("query", "other", "cosine"))})

    part = ["cell", "ep", "qp"]
    local = entries.groupBy(*part).cogroup(asks.groupBy(*part)).applyInPandas(rerank, "query long, other long, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "other")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def similar_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embeddings", k: int = 5, least: float = 0.9, dim: int = DIM, candidates: int | None = None) -> DataFrame:
    """(a, b), a < b, with a cosine of at least ``least`` where one is among the k most similar of the other; equal vectors rank by id."""
    rows = stage(usable(df, key, vector, dim), "usable")
    dups = stage(copies(rows, "key", "v"), "copies")
    reps = stage(drop_keys(rows, dups.select("key"), "key"), "reps")
    near = stage(neighbours(reps, reps, k, dim, candidates, least - 1e-9), "near")
    # the first k + 1 members of every class of copies; a single vector is a class of its own
    members = dups.select("rep", "key").union(dups.select("rep", F.col("rep").alias("key")).distinct())
    members = stage(members, "members")
    w = Window.partitionBy("rep").orderBy("key")
    first = members.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).groupBy("rep").agg(F.array_sort(F.collect_list("key")).alias("m"))
    first = stage(first, "first")
    own = (
        members.join(first, "rep").select("key", F.explode("m").alias("other")).where("key <> other").withColumn("cosine", F.lit(1.0))
    )
    asking = near.join(first.withColumnRenamed("rep", "query"), "query", "left").where(F.coalesce(F.size("m"), F.lit(1)) <= k)
    outer = (
        asking.select(F.explode(F.coalesce("m", F.array("query"))).alias("key"), "other", "cosine")
        .join(first.select(F.col("rep").alias("other"), F.col("m").alias("om")), "other", "left")
        .select("key", F.explode(F.coalesce("om", F.array("other"))).alias("other"), "cosine")
    )
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("cosine"), "other"))
    best = own.unionByName(outer).withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("cosine") >= least))
    return best.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()
