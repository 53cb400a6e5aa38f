"""Near-duplicate texts (problem 2), by bit-sliced comparison of sketches.

1. Every different text gets 160 minimum hashes of its character n-grams. Four
   at a time make a band (40 of them); their lowest bits make a 160-bit sketch.
2. Records that agree in a band meet in its bucket. Buckets are dealt into
   blocks of 64 records; a block's sketches are stored as vertical bit planes,
   one 64-bit word for each plane. A query XORs its bit with each plane, and
   carry-save adders count the differences of 64 records at once. After every
   16 planes the counters are held against the radius, and a word of which
   every record exceeds it is abandoned.
3. Survivors are compared by the exact Jaccard similarity of their n-gram sets.

Error: a pair of similarity s misses all bands with probability (1 - s^4)^40,
0.4 % at 0.6 and under 0.01 % from 0.68 on; the radius is four standard
deviations beyond the mean distance at the threshold. No bucket is capped: a
crowded one is numbered in pieces, and its block pairs are rows of their own and spread over tasks.

Exact copies are compared once for their class. Null texts and texts of under
``least`` characters (at least n) take part in nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.copies import copies, copy_pairs, spread
from docloom.llm.graph import components
from docloom.llm.skew import CALM, crowded, dealt
from docloom.llm.spans import blocks
from docloom.llm.winnow import encode, gram_hashes, mix
from docloom.runtime import drop_keys, keep_keys, sized, stage, text_key

BANDS, ROWS = 40, 4
PLANES = BANDS * ROWS
LANES = 64
THRESHOLD = 0.6
_FACTORS = np.random.default_rng(20240501).integers(0, 1 << 32, PLANES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SIGNATURE_CHARS = 1 << 16


def radius(threshold: float, planes: int = PLANES) -> int:
    """Most differing bits that a pair at the threshold has, but for one in some ten thousand."""
    p = (1 - threshold) / 2
    return int(planes * p + 4 * (planes * p * (1 - p)) ** 0.5)


def signatures(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(band keys as int64 [texts, BANDS], sketches as uint8 [texts, PLANES / 8]); each text has n characters or more."""
    keys, bits = np.empty((len(texts), BANDS), np.int64), np.empty((len(texts), PLANES // 8), np.uint8)
    for i, j in blocks(texts, _SIGNATURE_CHARS):
        points, offsets = encode(texts[i:j])
        h = (gram_hashes(points, n) >> np.uint64(32)).astype(np.uint32)
        # grams that cross into the next text are replaced by the text's first gram, which changes no minimum
        at = np.repeat(offsets[:-1], np.diff(offsets))[: len(h)]
        ends = np.repeat(offsets[1:], np.diff(offsets))[: len(h)]
        h = np.where(np.arange(len(h)) + n <= ends, h, h[at])
        low = np.empty((j - i, PLANES), np.uint32)
        with np.errstate(over="ignore"):
            for p in range(PLANES):
                x = h * _FACTORS[p]
                x ^= x >> np.uint32(15)
                low[:, p] = np.minimum.reduceat(x, offsets[:-1])
            bits[i:j] = np.packbits(low & 1, axis=1, bitorder="little")
            band = np.zeros((j - i, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
            for r in range(ROWS):
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) + low[:, r::ROWS])
        keys[i:j] = band.view(np.int64)
    return keys, bits


def sketched(df: DataFrame, n: int) -> DataFrame:
    """(id, bands, sketch) of df(id long, text string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, bits = signatures(b.column(1).to_pylist(), n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            sketch = pa.Array.from_buffers(pa.binary(bits.shape[1]), len(bits), [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), lists, sketch], names=["id", "bands", "sketch"])

    return df.select("id", "text").mapInArrow(run, "id long, bands array<long>, sketch binary")


def tiles(signed: DataFrame, calm: int = CALM) -> DataFrame:
    """(bucket, blk, m): every bucket of two or more records in blocks of LANES members (id, sketch); a crowded bucket is dealt in pieces."""
    met = signed.select(F.explode("bands").alias("bucket"), "id")
    hot = crowded(met, "bucket", calm)
    w = Window.partitionBy("bucket").orderBy("id")
    calm_rows = met if hot is None else met.join(sized(hot), "bucket", "left_anti")
    blocked = (
        # a repeated row repeats its id; both windows run over one sort
        calm_rows.withColumn("before", F.lag("id").over(w)).where("before is null or before <> id")
        .select("bucket", "id", F.row_number().over(w).alias("rn"), F.lead("id").over(w).alias("next"))
        .where("rn > 1 or next is not null").select("bucket", "id", F.floor((F.col("rn") - 1) / LANES).cast("int").alias("blk"))
    )
    if hot is not None:
        many = met.join(sized(hot.select("bucket")), "bucket", "left_semi").distinct()
        blocked = blocked.unionByName(dealt(many, "bucket", ["id"], LANES, calm=calm).select("bucket", "id", "blk"))
    return (
        blocked.join(signed.select("id", "sketch").dropDuplicates(["id"]), "id")
        .groupBy("bucket", "blk").agg(F.collect_list(F.struct("id", "sketch")).alias("m"))
    )


def vertical(bits: np.ndarray) -> np.ndarray:
    """Bit planes of up to 64 sketches: [members, planes] of 0/1 to one word for each plane."""
    out = np.zeros((bits.shape[1], LANES // 8), np.uint8)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)[:, 0]


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _exceeds(counter: list[np.ndarray], limit: int) -> np.ndarray:
    """Lanes whose counter, least significant word first, is over the limit."""
    over, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in range(len(counter) - 1, -1, -1):
        if limit >> k & 1:
            equal &= counter[k]
        else:
            over |= equal & counter[k]
            equal &= ~counter[k]
    return over


def within(planes: np.ndarray, queries: np.ndarray, valid: np.ndarray, limit: int) -> np.ndarray:
    """Lanes within the radius, for rows of (block planes, query bits as 0 / ~0 words, lanes in use)."""
    rows = np.arange(len(planes))
    counter = [np.zeros(len(rows), np.uint64) for _ in range(planes.shape[1].bit_length())]
    alive = valid.copy()
    result = np.zeros(len(planes), np.uint64)
    for first in range(0, planes.shape[1], 16):
        x = planes[rows, first : first + 16] ^ queries[rows, first : first + 16]
        ones, twos, fours, eights = counter[:4]
        carry = []
        for half in (0, 8):
            c4 = []
            for q in (half, half + 4):
                ones, t1 = _csa(ones, x[:, q], x[:, q + 1])
                ones, t2 = _csa(ones, x[:, q + 2], x[:, q + 3])
                twos, f = _csa(twos, t1, t2)
                c4.append(f)
            fours, e = _csa(fours, *c4)
            carry.append(e)
        eights, up = _csa(eights, *carry)
        counter[:4] = ones, twos, fours, eights
        for k in range(4, len(counter)):
            counter[k], up = counter[k] ^ up, counter[k] & up
        alive &= ~_exceeds(counter, limit)
        go = alive != 0
        if not go.all():
            rows, alive, counter = rows[go], alive[go], [c[go] for c in counter]
            if not len(rows):
                return result
    result[rows] = alive
    return result


def close_pairs(tiled: DataFrame, limit: int) -> DataFrame:
    """(a, b), a < b, of records of one bucket whose sketches differ in at most ``limit`` bits. tiled is read three times, so it should be staged."""
    left = tiled.select("bucket", F.explode(F.sequence(F.lit(0), "blk")).alias("o"), "blk", F.col("m").alias("mb"))
    right = tiled.select("bucket", F.col("blk").alias("o"), F.col("m").alias("ma"))
    single = tiled.where("blk = 0").select("m", F.col("m").alias("q"))
    several = left.where("blk > 0").join(right, ["bucket", "o"]).select(F.col("mb").alias("m"), F.col("ma").alias("q"))
    paired = single.unionByName(several)

    def members(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = column.flatten()
        ids = flat.field("id").to_numpy(zero_copy_only=False)
        raw = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        return ids, np.unpackbits(raw, axis=1, bitorder="little"), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids, bits, off = members(b.column(0))
                qids, qbits, qoff = members(b.column(1))
                size = np.diff(off)
                planes = np.stack([vertical(bits[off[k] : off[k + 1]]) for k in range(b.num_rows)])
                block = np.repeat(np.arange(b.num_rows), np.diff(qoff))
                valid = np.where(size >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(size, 63).astype(np.uint64)) - np.uint64(1))
                hit = within(planes[block], np.where(qbits > 0, ~np.uint64(0), np.uint64(0)), valid[block], limit)
                rows = np.flatnonzero(hit)
                lanes = np.unpackbits(hit[rows].view(np.uint8).reshape(len(rows), 8), axis=1, bitorder="little")
                r, lane = np.nonzero(lanes)
                a, c = qids[rows[r]], ids[off[block[rows[r]]] + lane]
                keep = a != c
                pair = np.unique(np.stack([np.minimum(a, c)[keep], np.maximum(a, c)[keep]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    return paired.mapInArrow(run, "a long, b long").distinct()


def jaccard(n: int):  # noqa: ANN201
    """Column function: exact Jaccard similarity of the n-gram sets of two texts."""

    def sets(s: pd.Series) -> list[np.ndarray]:
        texts = s.tolist()
        points, offsets = encode(texts)
        h = gram_hashes(points, n)
        return [np.unique(h[i : max(i, j - n + 1)]) for i, j in zip(offsets[:-1], offsets[1:])]

    @F.pandas_udf(T.DoubleType())
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(sets(x), sets(y)):
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / max(1, len(p) + len(q) - both))
        return pd.Series(out, dtype="float64")

    return similarity


def similar_texts(df: DataFrame, key: str, text: str, n: int, threshold: float = THRESHOLD, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """(pairs, dups): (a, b, t_a, t_b, similarity) of different texts by their representatives' keys and their text
    keys, and the staged copies by text.

    If a key comes with several texts, each takes part.
    """
    rows = df.where(F.length(text) >= max(n, least)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    dups = stage(copies(rows, "key", "text", by_text=True), "copies")
    rows = drop_keys(rows.withColumn("t", text_key("text")), dups.select("key", "t"), ["key", "t"]).withColumn("id", F.xxhash64("key", "text"))
    signed = stage(sketched(rows, n), "signed")
    cands = stage(close_pairs(stage(tiles(signed), "tiles"), radius(threshold)), "cands")
    ids = stage(cands.select(F.col("a").alias("id")).union(cands.select(F.col("b").alias("id"))).distinct(), "ids")
    texts = stage(keep_keys(rows, ids, "id").dropDuplicates(["id"]), "texts")
    both = (
        cands.join(texts.select(F.col("id").alias("a"), F.col("key").alias("ka"), F.col("t").alias("t_a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("key").alias("kb"), F.col("t").alias("t_b"), F.col("text").alias("tb")), "b")
        .withColumn("similarity", jaccard(n)("ta", "tb"))
    )
    pairs = both.where(F.col("similarity") >= threshold).select(F.col("ka").alias("a"), F.col("kb").alias("b"), "t_a", "t_b", "similarity")
    return pairs, dups


def _all_pairs(pairs: DataFrame, dups: DataFrame) -> DataFrame:
    return spread(pairs.select("a", "b", "t_a", "t_b"), dups, "key").unionByName(copy_pairs(dups, "key")).distinct()


def similar_pairs(df: DataFrame, key: str, text: str, n: int, threshold: float = THRESHOLD, least: int = 0) -> DataFrame:
    """(a, b) of all records whose n-gram sets have a Jaccard similarity of the threshold or more, copies included."""
    return _all_pairs(*similar_texts(df, key, text, n, threshold, least))


def partners(pairs: DataFrame, dups: DataFrame) -> DataFrame:
    """(key, links): with how many other records each record is similar, copies included; from similar_texts(), both staged.

    Counted per text: the sizes of its own class and of the classes near it, so no pairs are written out. Only keys
    with several texts, which may meet a class more than once, are told apart one by one.
    """
    sides = [(dups, "key", "t"), (dups, "rep", "t"), (pairs, "a", "t_a"), (pairs, "b", "t_b")]
    of = stage(reduce(DataFrame.union, [x.select(F.col(k).alias("key"), F.col(t).alias("t")) for x, k, t in sides]).distinct(), "members")
    several = stage(of.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "several")
    one, more = drop_keys(of, several, "key"), stage(keep_keys(of, several, "key"), "more")
    near = pairs.select("t_a", "t_b").union(pairs.select("t_b", "t_a")).union(of.select("t", "t")).toDF("t", "o").distinct()
    near = stage(near, "near")
    size = one.groupBy(F.col("t").alias("o")).agg(F.count(F.lit(1)).alias("n"))
    some = more.select(F.col("t").alias("o"), F.col("key").alias("other"))
    extra = near.join(some, "o").select("t", "other").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("more"))
    each = near.join(size, "o", "left").groupBy("t").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n")).join(extra, "t", "left")
    links = one.join(sized(stage(each, "each")), "t").select("key", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    around = stage(more.join(near, "t").select("key", "o").distinct(), "around")
    single = around.join(size, "o").groupBy("key").agg(F.sum("n").alias("links"))
    again = around.join(some, "o").where("key <> other").select("key", "other").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("links"))
    return links.union(single.union(again).groupBy("key").agg(F.sum("links").alias("links")))


def groups(df: DataFrame, key: str, text: str, n: int, threshold: float = THRESHOLD, least: int = 0) -> DataFrame:
    """(key, class_id, links) of every record that has a similar one: the smallest key of its class, and its number of partners."""
    pairs, dups = similar_texts(df, key, text, n, threshold, least)
    pairs = stage(pairs, "similar")
    return components(_all_pairs(pairs, dups)).select("key", "class_id").join(partners(pairs, dups), "key")


def stem(name: str = "filename"):  # noqa: ANN201
    """A file name without its extension, in lower case."""
    return F.lower(F.regexp_replace(name, r"(?s)(?<=[^.])\.[^.]*$", ""))
