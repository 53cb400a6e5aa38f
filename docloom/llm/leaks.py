"""Evaluation passages that stand in training texts (problem 9), by winnowing.

Both sides are reduced to their letters and digits, in one case and width, and
the rightmost smallest k-gram hash of every window is kept. Common hashes are
hits; each is extended on the reduced texts to the whole common run. With
k + window - 1 equal to the required run no run is missed.

Null or short texts, on either side, leak nothing. Every text of a key that comes with several takes part. A test item or a document
that comes twice gives one row.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.spans import extend, blocks
from docloom.llm.winnow import encode, winnow
from docloom.runtime import keep_keys, sized, stage

MIN_RUN = 60
K = 32


@cache
def _reduced() -> np.ndarray:
    """For every code point its folded letter or digit, or 0 if it is skipped."""
    to = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalnum():
            x = unicodedata.normalize("NFKC", chr(c)).lower()
            to[c] = ord(x) if len(x) == 1 else c
    return to


def reduce_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of all texts in one case and width, and where each text begins."""
    points, offsets = encode(texts)
    to = _reduced()[points]
    kept = np.concatenate([np.zeros(1, np.int64), np.cumsum(to > 0)])
    return to[to > 0], kept[offsets]


def fingerprints(df: DataFrame, key: str, text: str, min_run: int = MIN_RUN, k: int = K) -> DataFrame:
    """(fp, id, pos): winnowed hashes of the reduced texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for i, j in blocks(texts):
                t, pos, h = winnow(*reduce_texts(texts[i:j]), k, min_run - k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[i:j][t]), pa.array(pos.astype(np.int32))], names=["fp", "id", "pos"])

    return df.where(F.length(text) >= min_run).select(key, text).mapInArrow(run, f"fp long, id {dict(df.dtypes)[key]}, pos int")


@F.pandas_udf(T.StringType())
def reduced_text(s: pd.Series) -> pd.Series:
    """The letters and digits of a text in one case and width."""
    points, offsets = reduce_texts(s.tolist())
    raw = points.astype("<u4").tobytes()
    return pd.Series([raw[4 * i : 4 * j].decode("utf-32-le", "surrogatepass") for i, j in zip(offsets[:-1], offsets[1:])])


def leaks(docs: DataFrame, items: DataFrame, min_run: int = MIN_RUN, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(key, item, run): documents and test items with a common run of min_run letters and digits, with the longest run.

    The items' fingerprints are broadcast only if their measured number allows; else the hashes are joined by shuffle.
    """
    k = min(K, max(4, min_run // 2))
    # a text is named by its key and itself, so that a key with several texts keeps them apart
    docs = docs.select(F.xxhash64(key, text).alias("_id"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    items = items.select(F.xxhash64(item, text).alias("_id"), F.col(item).alias("_key"), F.col(text).alias("_text"))
    tests = stage(fingerprints(items, "_id", "_text", min_run, k).distinct(), "tests").select("fp", F.col("id").alias("item"), F.col("pos").alias("at"))
    hits = fingerprints(docs, "_id", "_text", min_run, k).join(sized(tests), "fp")
    # hits on one diagonal belong together; all positions stay, as a diagonal may hold several runs
    hits = stage(hits.groupBy("id", "item", (F.col("pos") - F.col("at")).alias("shift")).agg(F.collect_set("at").alias("ats")), "hits")
    need = stage(hits.select(F.col("id").alias("_id")).distinct(), "need")
    texts = keep_keys(docs, need, "_id").dropDuplicates(["_id"]).select(F.col("_id").alias("id"), F.col("_key").alias(key), reduced_text("_text").alias("td"))
    asked = items.where(F.length("_text") >= min_run).dropDuplicates(["_id"]).select(F.col("_id").alias("item"), F.col("_key").alias("_item"), reduced_text("_text").alias("ti"))
    both = (
        hits.join(texts, "id").join(asked, "item").withColumn("at", F.explode("ats"))
        .withColumn("e", extend("td", "ti", F.col("at") + F.col("shift"), "at"))
    )
    return (
        both.withColumn("run", F.col("e.left") + F.col("e.right")).where(F.col("run") >= min_run)
        .groupBy(key, F.col("_item").alias(item)).agg(F.max("run").alias("run"))
    )
