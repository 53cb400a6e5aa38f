"""Long exact spans shared between records (problem 10), by De Bruijn compaction.

A text is a sequence of tokens, each an anchor (a winnowed 24-gram); a token
2-mer, i.e. two consecutive anchors with the text between them, is an edge of
a De Bruijn graph whose nodes are anchors. Edges that occur once drop out.
Nonbranching paths of the repeated edges are compacted to unitigs by joins on
the nodes; documents on one unitig are candidates, and the source texts at
the stored coordinates are compared character by character.

Guarantee: with k = 24 and window = 44 a common stretch of 200 characters
holds two consecutive anchors that both texts keep (anchors within
window - 1 of its ends may differ, and 203 - k - 2 * window >= 2 * window),
so no stretch of ``min_span`` characters is lost.

Null and empty texts, and those shorter than the span, share nothing. Exact
copies are compared once for their class, see docloom.llm.copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.copies import copies, copy_pairs, spread
from docloom.llm.skew import CALM, crowded, dealt
from docloom.llm.winnow import encode, run_hashes, winnow
from docloom.runtime import drop_keys, keep_keys, sized, stage

MIN_SPAN = 200
#: Records of one unitig that meet pairwise at once; a larger group is first told apart by its surroundings.
HOT = 64
_BATCH_CHARS = 1 << 20


def geometry(min_span: int) -> tuple[int, int]:
    """(k, window) such that a stretch of min_span characters holds two common consecutive anchors."""
    k = max(8, min(24, min_span // 8))
    window = (min_span + 3 - k) // 4
    if window < 4:
        raise ValueError("min_span is too short for two anchors")
    return k, window


def blocks(texts: list[str], chars: int = _BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters, to bound the arrays made from them."""
    first, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > chars:
            yield first, i
            first, n = i, 0
        n += len(t)
    if first < len(texts):
        yield first, len(texts)


def edges(docs: DataFrame, key: str, text: str, min_span: int = MIN_SPAN) -> DataFrame:
    """(edge, head, tail, id, start, stop): every token 2-mer of every text, with its coordinates."""
    k, window = geometry(min_span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            texts = b.column(1).to_pylist()
            for i, j in blocks(texts):
                points, offsets = encode(texts[i:j])
                t, pos, h = winnow(points, offsets, k, window)
                a = np.flatnonzero(t[1:] == t[:-1])
                head, tail, start, stop = h[a], h[a + 1], pos[a], pos[a + 1] + k
                edge = run_hashes(points, offsets[t[a]] + start, offsets[t[a]] + stop)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)) for x in (edge, head, tail)] + [pa.array(ids[i:j][t[a]]), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))],
                    names=["edge", "head", "tail", "id", "start", "stop"],
                )

    kind = dict(docs.dtypes)[key]
    source = docs.where(F.length(text) >= min_span).select(key, text)
    return source.mapInArrow(run, f"edge long, head long, tail long, id {kind}, start int, stop int")


def repeated_edges(all_edges: DataFrame, calm: int = CALM) -> DataFrame:
    """Edges with more than one occurrence; all_edges should be staged. Neighbours in the sorted stream tell, so nothing is collected per edge; a crowded edge needs no sort."""
    hot = crowded(all_edges, "edge", calm)
    w = Window.partitionBy("edge").orderBy("id", "start")
    rest = all_edges if hot is None else all_edges.join(sized(hot), "edge", "left_anti")
    out = rest.withColumn("more", F.lag("id").over(w).isNotNull() | F.lead("id").over(w).isNotNull()).where("more").drop("more")
    return out if hot is None else out.unionByName(all_edges.join(sized(hot.select("edge")), "edge", "left_semi"))


def unitigs(rep: DataFrame, k: int) -> DataFrame:
    """(unitig, id, start, stop): repeated edges, made with anchors of k characters, compacted along nonbranching paths.

    A node ends a path if more than one distinct repeated edge enters or leaves
    it, or if in some record the repeated run begins or ends there. Between two
    such nodes every record that has the first edge has all the others, with
    the same text, so the first edge names the path.
    """
    w = Window.partitionBy("id").orderBy("start", "stop")
    at_head, at_tail = F.struct("head", "start"), F.struct("tail", (F.col("stop") - k).alias("start"))
    runs = rep.withColumn("prev", F.lag(at_tail).over(w)).withColumn("next", F.lead(at_head).over(w))
    # edges adjoin if the last one's tail is the next one's head at the same place: an anchor may come again after text of the record's own
    runs = runs.withColumn("opens", F.coalesce((F.col("prev.tail") != F.col("head")) | (F.col("prev.start") != F.col("start")), F.lit(True))).withColumn(
        "closes", F.coalesce((F.col("next.head") != F.col("tail")) | (F.col("next.start") != F.col("stop") - k), F.lit(True))
    )
    runs = stage(runs.drop("prev", "next"), "runs")
    distinct = runs.groupBy("edge", "head", "tail").agg(F.max("opens").alias("opens"), F.max("closes").alias("closes"))
    ends = distinct.select(
        F.explode(
            F.array(
                F.struct(F.col("head").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("opens").alias("cut")),
                F.struct(F.col("tail").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.col("closes").alias("cut")),
            )
        ).alias("e")
    ).select("e.*")
    cuts = (
        ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.max("cut").alias("cut"))
        .where("cut or o <> 1 or i <> 1").select(F.col("node").alias("head"), F.lit(True).alias("cut"))
    )
    step = F.sum(F.when(F.coalesce("cut", "opens"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    paths = runs.join(cuts, "head", "left").withColumn("path", step)
    return (
        paths.groupBy("id", "path")
        .agg(F.min_by("edge", F.struct("start", "stop")).alias("unitig"), F.min("start").alias("start"), F.max("stop").alias("stop"))
        .select("unitig", "id", "start", "stop")
    )


def _surroundings(group: DataFrame, docs: DataFrame, key: str, text: str, min_span: int) -> DataFrame:
    """Members of hot unitigs under the text on their left or right.

    A common stretch of min_span characters around a unitig of n goes on for
    half of the missing min_span - n on one side at least, so true pairs meet
    under that side's context and boilerplate with other neighbours does not.
    """
    half = F.greatest(F.ceil((F.lit(min_span) - (F.col("stop") - F.col("start"))) / 2), F.lit(0)).cast("int")
    with_text = group.join(docs.select(F.col(key).alias("id"), F.col(text).alias("doc")), "id").withColumn("half", half)
    left = F.when(F.col("start") >= F.col("half"), F.expr("substring(doc, start + 1 - half, half)"))
    right = F.when(F.length("doc") - F.col("stop") >= F.col("half"), F.expr("substring(doc, stop + 1, half)"))
    sides = F.array(F.struct(F.lit("l").alias("side"), F.xxhash64(left).alias("h"), left.isNotNull().alias("ok")), F.struct(F.lit("r").alias("side"), F.xxhash64(right).alias("h"), right.isNotNull().alias("ok")))
    return (
        with_text.select("unitig", "id", "start", F.explode(sides).alias("s")).where("s.ok")
        .select(F.xxhash64("unitig", "s.side", "s.h").alias("unitig"), "id", "start")
    )


def meet(groups: DataFrame, block: int = HOT) -> DataFrame:
    """(a, b, start_a, start_b), a < b, of members of one group.

    Members are dealt into blocks, those of a crowded group in pieces; block pairs are joined
    by key, so a group of any size spreads over tasks in pieces of block x block. Blocks of different
    pieces are in no order of ids, so their members meet either way round.
    """
    tiles = dealt(groups, "unitig", ["id", "start"], block).groupBy("unitig", "blk").agg(F.collect_list(F.struct("id", "start")).alias("m"))
    left = tiles.select("unitig", F.explode(F.expr("sequence(0, blk)")).alias("other"), "blk", F.col("m").alias("mb"))
    right = tiles.select("unitig", F.col("blk").alias("other"), F.col("m").alias("ma"))
    return (
        left.join(right, ["unitig", "other"])
        .select(F.explode("ma").alias("x"), "mb", (F.col("other") < F.col("blk")).alias("apart")).select("x", F.explode("mb").alias("y"), "apart")
        .where("x.id < y.id or (apart and x.id > y.id)").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.start").alias("start_a"), F.col("y.start").alias("start_b"))
    )


_REACH = T.StructType([T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType())])


@F.pandas_udf(_REACH)
def extend(ta: pd.Series, tb: pd.Series, pa_: pd.Series, pb: pd.Series) -> pd.DataFrame:
    """How far two texts agree to the left and to the right of a pair of positions."""
    left, right = [], []
    for x, y, i, j in zip(ta, tb, pa_, pb):
        left.append(_common(x[:i][::-1], y[:j][::-1]))
        right.append(_common(x[i:], y[j:]))
    return pd.DataFrame({"left": pd.Series(left, dtype="int32"), "right": pd.Series(right, dtype="int32")})


def _common(x: str, y: str) -> int:
    """Length of the common prefix, by halving comparisons of whole slices."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo, hi = 0, n  # x[:lo] agree, x[:hi] don't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _paths(docs: DataFrame, key: str, text: str, min_span: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(staged unitig occurrences, staged sizes (unitig, n, len) of those with more than HOT occurrences, staged copies)."""
    dups = stage(copies(docs.where(F.length(text) >= min_span), key, text), "copies")
    # copies go before anything is shuffled, so a text that a third of all records hold gives its edges once
    rep = repeated_edges(edges(drop_keys(docs.select(key, text), dups.select(key), key), key, text, min_span))
    paths = stage(unitigs(rep, geometry(min_span)[0]), "unitigs")
    many = paths.groupBy("unitig").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("stop") - F.col("start")).alias("len")).where(F.col("n") > HOT)
    return paths, stage(many, "many"), dups


def _verified(groups: DataFrame, docs: DataFrame, key: str, text: str, min_span: int) -> DataFrame:
    """(a, b, start_a, start_b, len): maximal spans of at least min_span characters of the members of groups(unitig, id, start), compared in their texts."""
    # one candidate for each pair and diagonal
    cands = (
        meet(groups).groupBy("a", "b", (F.col("start_b") - F.col("start_a")).alias("shift"))
        .agg(F.array_sort(F.collect_set("start_a")).alias("starts")).select("a", "b", "shift", F.explode("starts").alias("start_a"))
    )
    cands = stage(cands, "cands")
    ids = stage(cands.select(F.col("a").alias(key)).union(cands.select(F.col("b").alias(key))).distinct(), "ids")
    texts = stage(keep_keys(docs.select(key, text), ids, key).dropDuplicates([key]), "texts")
    both = (
        cands.join(texts.select(F.col(key).alias("a"), F.col(text).alias("ta")), "a")
        .join(texts.select(F.col(key).alias("b"), F.col(text).alias("tb")), "b")
        .withColumn("e", extend("ta", "tb", "start_a", F.col("start_a") + F.col("shift")))
    )
    spans = both.select("a", "b", (F.col("start_a") - F.col("e.left")).alias("start_a"), (F.col("start_a") + F.col("shift") - F.col("e.left")).alias("start_b"), (F.col("e.left") + F.col("e.right")).alias("len"))
    return spans.where(F.col("len") >= min_span).distinct()


def _told_apart(paths: DataFrame, many: DataFrame, docs: DataFrame, key: str, text: str, min_span: int, pairs: bool) -> DataFrame:
    """(unitig, id, start) of the occurrences to be compared: those of crowded short unitigs under their surroundings, those of crowded long ones only if pairs are wanted."""
    short = many.where(F.col("len") < min_span).select("unitig")
    apart = short if pairs else many.select("unitig")
    groups = paths.join(sized(apart), "unitig", "left_anti").select("unitig", "id", "start")
    if not short.isEmpty():
        groups = groups.unionByName(_surroundings(paths.join(sized(short), "unitig", "left_semi"), docs, key, text, min_span))
    return groups


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", min_span: int = MIN_SPAN) -> tuple[DataFrame, DataFrame]:
    """(spans, dups): verified maximal spans (a, b, start_a, start_b, len) of at least min_span characters
    between records with different texts, a < b, and the staged copies of docs."""
    paths, many, dups = _paths(docs, key, text, min_span)
    return _verified(_told_apart(paths, many, docs, key, text, min_span, pairs=True), docs, key, text, min_span), dups


def sharing_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_span: int = MIN_SPAN) -> DataFrame:
    """(a, b) of records that have a stretch of min_span characters in common, copies included."""
    spans, dups = shared_spans(docs, key, text, min_span)
    return spread(spans.select("a", "b").distinct(), dups, key).unionByName(copy_pairs(dups, key)).distinct()


def reaches(group: DataFrame, docs: DataFrame, key: str, text: str, min_span: int = MIN_SPAN) -> DataFrame:
    """(id, s, e) for occurrences (unitig, id, start, stop) of unitigs of min_span characters or more: how far the text around each is the same in another record.

    No pairs are made. The longest context that another record shares is found by doubling: in each round a context of so many more characters is
    kept where two records have it, told by the smallest and largest id of its hash. A context of two windows and an anchor is enough, as
    records that agree further have the next edge in common, and its path covers what follows.
    """
    k, window = geometry(min_span)
    reach = 1 << (2 * window + k).bit_length()
    doc = F.col("doc")
    ends = group.groupBy("unitig").agg((F.min("id") != F.max("id")).alias("several")).where("several").select("unitig")
    rows = group.join(ends, "unitig", "left_semi").join(docs.select(F.col(key).alias("id"), F.col(text).alias("doc")).dropDuplicates(["id"]), "id")
    left = F.reverse(F.expr(f"substring(doc, greatest(start - {reach - 1}, 0) + 1, least(start, {reach - 1}))"))
    right = F.substring(doc, F.col("stop") + 1, F.lit(reach - 1))
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), left.alias("c")), F.struct(F.lit("r").alias("side"), right.alias("c")))).alias("x")
    state = stage(rows.select("unitig", "id", "start", "stop", sides).select("unitig", "id", "start", "stop", "x.side", "x.c", F.lit(0).alias("n")), "contexts")
    step = reach // 2
    while step:
        more = F.col("n") + step
        tried = state.withColumn("h", F.when(F.length("c") >= more, F.xxhash64("unitig", "side", more, F.expr(f"substring(c, 1, n + {step})"))))
        shared = tried.where("h is not null").groupBy("h").agg((F.min("id") != F.max("id")).alias("two")).where("two")
        state = tried.join(shared, "h", "left").withColumn("n", F.when(F.col("two"), more).otherwise(F.col("n"))).drop("h", "two")
        step //= 2
    wide = stage(state.select("unitig", "id", "start", "stop", "side", "n"), "reaches").groupBy("unitig", "id", "start", "stop").agg(
        F.max(F.when(F.col("side") == "l", F.col("n"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("n"))).alias("r")
    )
    return wide.select("id", (F.col("start") - F.col("l")).alias("s"), (F.col("stop") + F.col("r")).alias("e"))


def shared_share(docs: DataFrame, key: str = "doc_id", text: str = "text", min_span: int = MIN_SPAN) -> DataFrame:
    """For every record that shares a span: its length, how many of its characters stand elsewhere too, and their share.

    A copy is shared whole; other records by the union of their spans. A crowded path of min_span characters or more, such as boilerplate
    in very many records, makes no pairs here, see ``reaches``.
    """
    paths, many, dups = _paths(docs, key, text, min_span)
    spans = stage(_verified(_told_apart(paths, many, docs, key, text, min_span, pairs=False), docs, key, text, min_span), "spans")
    ivals = spans.select(F.col("a").alias(key), F.col("start_a").alias("s"), (F.col("start_a") + F.col("len")).alias("e")).union(
        spans.select("b", "start_b", F.col("start_b") + F.col("len"))
    )
    long = many.where(F.col("len") >= min_span).select("unitig")
    if not long.isEmpty():
        ivals = ivals.union(reaches(paths.join(sized(long), "unitig", "left_semi"), docs, key, text, min_span).select(F.col("id").alias(key), "s", "e"))
    w = Window.partitionBy(key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    own = ivals.withColumn("from", F.greatest("s", F.coalesce(F.max("e").over(w), F.lit(0)))).groupBy(key).agg(
        F.sum(F.greatest(F.col("e") - F.col("from"), F.lit(0))).cast("long").alias("own")
    )
    whole = dups.select(key).union(dups.select("rep")).distinct().withColumn("whole", F.lit(True))
    size = docs.groupBy(key).agg(F.max(F.length(text)).cast("long").alias("chars"))
    return (
        own.join(whole, key, "full_outer").join(size, key)
        .withColumn("shared_chars", F.when(F.col("whole"), F.col("chars")).otherwise(F.col("own")))
        .select(key, "chars", "shared_chars", (F.col("shared_chars") / F.col("chars")).alias("share"))
    )
