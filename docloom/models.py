"""Pluggable models with deterministic offline defaults: embedding, answering, describing, recognising. A reranking model plugs into docloom.operators.fusion."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import patterns as P
from docloom.functions.text import segments, strip


class Embedder(Protocol):
    def __call__(self, texts: Sequence[str]) -> np.ndarray: ...


class Answerer(Protocol):
    def __call__(self, prompt: str) -> str: ...


_TERM = re.compile(f"{P.ASCII_RUN}|{P.CJK_RUN}")


def hashed_embedding(texts: Sequence[str], dim: int = 64) -> np.ndarray:
    """Unit vectors of hashed terms with signs: the same text gives the same vector everywhere."""
    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts):
        for run in _TERM.findall(text.lower()):
            for term in [run] if run.isascii() or len(run) == 1 else (run[i : i + 2] for i in range(len(run) - 1)):
                h = zlib.crc32(term.encode())
                row[h % dim] += 1 if h & 0x8000_0000 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def with_retries(call: Callable[[list[str]], np.ndarray], batch: int = 10, tries: int = 3, wait: Callable[[float], None] | None = None) -> Embedder:
    """An embedder of batches that repeats a failing batch after min(2^n, 8) seconds, at most ``tries`` times."""

    def run(texts: Sequence[str]) -> np.ndarray:
        import time

        out = []
        for at in range(0, len(texts), batch):
            for n in range(1, tries + 1):
                try:
                    out.append(np.asarray(call(list(texts[at : at + batch]))))
                    break
                except Exception:
                    if n == tries:
                        raise
                    (wait or time.sleep)(min(2**n, 8))
        return np.concatenate(out) if out else np.zeros((0, 0))

    return run


def prepared(text: Column | str) -> Column:
    """A text as it is embedded: stripped, blank ones under one name, cut."""
    body = strip(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.when(body == "", F.lit(P.EMPTY_TEXT)).otherwise(F.substring(body, 1, P.EMBED_CHARS))


def embedded(df: DataFrame, key: str, text: str, embedder: Embedder = hashed_embedding) -> DataFrame:
    """(key, embedding): each different prepared text is embedded once and joined back to its records by hash."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(s: pd.Series) -> pd.Series:
        return pd.Series(list(embedder(s.tolist()).astype("float32")))

    rows = df.select(key, prepared(text).alias("_t")).withColumn("_h", F.sha2("_t", 256))
    unique = rows.groupBy("_h").agg(F.first("_t").alias("_t")).select("_h", vectors("_t").alias("embedding"))
    return rows.select(key, "_h").join(unique, "_h").drop("_h")


def extractive_answer(prompt: str) -> str:
    """An offline answer: the first sentence of each numbered passage of a prompt with its number."""
    out = []
    for m in re.finditer(r"^\[(\d+)\][^\n]*\n(.+?)(?=\n\n\[|\n\n【|\Z)", prompt, re.S | re.M):
        first = next((s for s in re.split(P.SENTENCE_END, m[2]) if s.strip()), "")
        out.append(f"{first.strip()} [{m[1]}]")
    return "\n".join(out) or "资料不足。"


def answered(prompts: DataFrame, answerer: Answerer = extractive_answer) -> DataFrame:
    """(query_id, answer) of prompts(query_id, prompt)."""

    @F.pandas_udf(T.StringType())
    def answers(s: pd.Series) -> pd.Series:
        return s.map(answerer)

    return prompts.select("query_id", answers("prompt").alias("answer"))


def described(figures: DataFrame, context: str, describe: Callable[[str], str], limit: int = 1500) -> DataFrame:
    """figures with ``description`` of their context, cut to the limit; blank contexts are not described."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: describe(x) if x else None)

    return figures.withColumn("description", run(F.substring(strip(F.coalesce(F.col(context), F.lit(""))), 1, limit)))


#: What a recogniser gives for a text: a list of entities with type, start, end and maybe span, or such a list under "output".
Recogniser = Callable[[str], object]
_TITLED = re.compile("([\u4e00-\u9fa5]{2,3})(?=先生|女士)")


def titled_names(text: str) -> list[dict]:
    """An offline recogniser: the two or three ideographs before a title."""
    return [{"type": "PER", "start": m.start(), "end": m.end(), "span": m[0]} for m in _TITLED.finditer(text)]


def entities(result: object) -> list[dict]:
    """The entities in a recogniser's answer, whatever wraps them; anything else is none."""
    for _ in range(2):
        if isinstance(result, dict):
            result = result.get("output", [])
    return [x for x in result if isinstance(x, dict)] if isinstance(result, list) else []


def _whole(x: object) -> int:
    try:
        return int(x)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return -1


def recognised(df: DataFrame, text: str, recogniser: Recogniser = titled_names) -> DataFrame:
    """df with ``recognised``: spans (start, stop, value, label, source, priority 50) of a recogniser that reads a text in segments.

    A segment on which the recogniser fails gives no spans, so the rules stand alone. Entities without a place or out of the text drop out.
    """
    kind = "array<struct<start:int,stop:int,value:string,label:string,source:string,priority:int>>"
    wanted = T.StructType([*df.schema.fields, T.StructField("recognised", T._parse_datatype_string(kind))])

    def spans(several: list[dict] | None) -> list[dict]:
        out = []
        for at, body in ((s["start"], s["text"]) for s in several or []):
            try:
                found = entities(recogniser(body))
            except Exception:  # noqa: BLE001, S112 - the rules stand alone where a model fails
                continue
            for e in found:
                a, z, name = _whole(e.get("start")), _whole(e.get("end")), str(e.get("type") or "").upper()
                if 0 <= a < z <= len(body):
                    label = P.ENTITY_LABELS.get(name, name or P.NO_LABEL)
                    out.append({"start": at + a, "stop": at + z, "value": str(e.get("span") or body[a:z]), "label": label, "source": "ner", "priority": 50})
        return out

    shape = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string()), ("label", pa.string()), ("source", pa.string()), ("priority", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = b.num_columns - 1
            found = pa.array([spans(x) for x in b.column(last).to_pylist()], shape)
            yield pa.RecordBatch.from_arrays([*b.columns[:last], found], names=[*b.schema.names[:last], "recognised"])

    return df.withColumn("_segments", segments(text)).mapInArrow(run, wanted)
