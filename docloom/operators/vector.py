"""Exact vector search: a stated set of query vectors against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.runtime import stage

#: Query vectors held at once; more are searched in further passes of this size.
BLOCK = 4096


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the usable rows: of ``dim`` finite numbers, not all zero."""
    sizes = column.value_lengths().fill_null(-1).to_numpy()
    at = np.flatnonzero(sizes == dim)
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], x[good] / norm[good, None]


def cosine_top(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, dim: int = 64, group: str | None = None, same: bool = True, block: int = BLOCK, within: str | None = None) -> DataFrame:
    """(query_id, [group,] key, similarity, rank): the k most similar rows of each query, or of each query and group.

    similarity is max(0, cosine) as double; it ranks by 9 digits, then by key. Every Arrow batch of rows is multiplied with
    a block of queries and keeps its best k for each, so what is shuffled grows with the batches, not with the
    rows. ``same`` keeps a row as its own neighbour. Unusable vectors take no part. With ``within`` (a column of both)
    a query is searched among the rows of its own value only, such as its base or its document; rows without a value belong to none.
    """
    if within:
        group = within
    spark = rows.sparkSession
    kind, gkind = dict(rows.dtypes)[key], dict(rows.dtypes)[group] if group else None
    schema = f"query_id {kind}, {key} {kind}" + (f", {group} {gkind}" if group else "") + ", similarity double"
    out = None
    for ids, mat, places in _blocks(queries, key, vector, dim, block, within):
        held = spark.sparkContext.broadcast((pa.array(ids, to_arrow_type(queries.schema[key].dataType)), mat, np.array(places, dtype=object)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            qids, q, places = held.value
            for b in batches:
                pos, x = unit_rows(b.column(1), dim)
                keys = b.column(0).take(pa.array(pos))
                groups = np.array(b.column(2).take(pa.array(pos)).to_pylist(), dtype=object) if group else np.zeros(len(pos), object)
                names = np.array(keys.to_pylist(), dtype=object)
                rr, qq, ss = [], [], []
                for g in set(groups.tolist()):
                    asked = np.flatnonzero(places == g) if within else np.arange(len(qids))
                    if within and (g is None or not len(asked)):
                        continue
                    own = np.flatnonzero(groups == g)
                    own = own[np.argsort(names[own], kind="stable")]
                    sim = np.maximum(0.0, x[own] @ q[asked].T)
                    order = np.argsort(-np.round(sim, 9), axis=0, kind="stable")[: k + (not same)]
                    rr.append(own[order].ravel())
                    qq.append(np.broadcast_to(asked, order.shape).ravel())
                    ss.append(np.take_along_axis(sim, order, 0).ravel())
                r, c = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rr, qq))
                cols = [qids.take(pa.array(c)), keys.take(pa.array(r))]
                if group:
                    cols.append(b.column(2).take(pa.array(pos)).take(pa.array(r)))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(ss) if ss else np.zeros(0))], schema=_arrow(cols, key, group))

        part = rows.select(key, vector, *([group] if group else [])).mapInArrow(run, schema)
        # several passes are written one by one, so that no more than one block of queries is held at a time
        out = part if out is None and len(ids) < block else stage(part, "pass") if out is None else out.unionByName(stage(part, "pass"))
    if out is None:
        out = spark.createDataFrame([], schema)
    if not same:
        out = out.where(F.col("query_id") != F.col(key))
    w = Window.partitionBy("query_id", *([group] if group else [])).orderBy(F.round("similarity", 9).desc(), F.col(key).asc())
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, key: str, vector: str, dim: int, block: int, within: str | None = None) -> Iterator[tuple[list, np.ndarray, list]]:
    """The usable query vectors, normalized, and where each is searched, a block at a time."""
    asked = queries.select(F.col(key).alias("q"), F.col(vector).alias("v"), (F.col(within) if within else F.lit(None)).alias("w")).where(F.size("v") == dim)
    ids, mats, places = [], [], []
    for r in asked.toLocalIterator():
        x = np.array([np.nan if v is None else v for v in r.v], np.float64)
        n = np.sqrt((x * x).sum())
        if np.isfinite(n) and n > 0:
            ids.append(r.q)
            mats.append(x / n)
            places.append(r.w)
            if len(ids) == block:
                yield ids, np.stack(mats), places
                ids, mats, places = [], [], []
    if ids:
        yield ids, np.stack(mats), places


def _arrow(cols: list[pa.Array], key: str, group: str | None) -> pa.Schema:
    names = ["query_id", key, *([group] if group else [])]
    return pa.schema([*((n, c.type) for n, c in zip(names, cols)), ("similarity", pa.float64())])


def merge_groups(per_group: DataFrame, key: str, limit: int) -> DataFrame:
    """The best of all groups' lists, each query's first ``limit``."""
    w = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), F.col(key).asc())
    return per_group.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
