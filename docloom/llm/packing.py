"""Filling containers of fixed capacity with texts (problem 8), by bounded-space online best-fit.

Texts are measured in tokens of a public tokenizer. Each packer takes its
share of the items one after the other and keeps a fixed number of open
containers in a bitset keyed by free space: the lowest set bit at or above an
item's size is the tightest container it fits. If none fits and all are in
use, the fullest (the lowest set bit) closes. Only a text above the capacity
is divided: into full containers of its own and a rest, which is packed like
any other item.

A null or empty text has no tokens and takes part as an item of size 0. Rows
that repeat a key and text are packed once; different texts of one key are items of their own. Assignments follow from the keys
alone, so a task that runs again after a loss gives the same containers.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import spread, stage, text_key

CAPACITY = 2048
OPEN = 256
#: Items for each packer. Its open containers at the end are all that its share can leave half empty.
ITEMS = 100_000
VOCABULARY = os.environ.get("DOCLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


@cache
def encoder(vocabulary: str):  # noqa: ANN201
    """The tokenizer of a rank file, split by the pattern published with it."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("docloom", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def measured(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, tokens, text_a, text_b) of every row, the last two naming the text; strings of special tokens are ordinary text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(2), b.column(3)], names=[key, "tokens", "text_a", "text_b"])

    named = spread(df.select(key, text)).select(key, text, text_key(text).alias("t"))
    return named.select(key, text, "t.a", "t.b").mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, tokens long, text_a long, text_b long")


def best_fit(sizes: Iterable[int], capacity: int = CAPACITY, spaces: int = OPEN) -> Iterator[tuple[int, int]]:
    """(container, size placed) for each item or part of one, in order."""
    free: dict[int, list[int]] = {}
    bits, in_use, made = 0, 0, 0
    for size in sizes:
        while size > capacity:
            yield made, capacity
            made, size = made + 1, size - capacity
        fit = bits >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            box = free[room].pop()
            if not free[room]:
                bits &= ~(1 << room)
        else:
            if in_use == spaces:
                room = (bits & -bits).bit_length() - 1
                free[room].pop()
                if not free[room]:
                    bits &= ~(1 << room)
            else:
                in_use += 1
            box, room, made = made, capacity, made + 1
        yield box, size
        room -= size
        free.setdefault(room, []).append(box)
        bits |= 1 << room


def packed(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, spaces: int = OPEN, vocabulary: str = VOCABULARY, items: int = ITEMS) -> DataFrame:
    """(key, part from 0, token_from, tokens, container) of every text."""
    sizes = stage(measured(df, key, text, vocabulary).distinct().drop("text_a", "text_b"), "tokens")
    packers = max(1, -(-sizes.count() // items))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 40
        got = [f for f in frames if len(f)]
        if not got:
            return
        whole = pd.concat(got, ignore_index=True)
        n = whole["tokens"].to_numpy()
        placed = np.array(list(best_fit(n.tolist(), capacity, spaces)), np.int64)
        count = np.maximum(1, -(-n // capacity))
        part = np.arange(len(placed)) - np.repeat(np.cumsum(count) - count, count)
        yield pd.DataFrame({key: whole[key].repeat(count).to_numpy(), "part": part, "token_from": part * capacity, "tokens": placed[:, 1], "container": base + placed[:, 0]})

    return (
        sizes.repartition(packers, key).sortWithinPartitions(key, "tokens")
        .mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, part int, token_from long, tokens long, container long")
    )
