"""Settings from the environment or a file of NAME=value lines; a value that can't be read gives the default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

from docloom.functions import patterns as P

_TRUE = {"1", "true", "yes", "y", "on"}


@dataclass(frozen=True)
class Settings:
    chunk_size: int = P.CHUNK_SIZE
    chunk_overlap: int = P.CHUNK_OVERLAP
    chunk_least: int = P.CHUNK_LEAST
    vector_candidates: int = P.VECTOR_CANDIDATES
    keyword_candidates: int = P.KEYWORD_CANDIDATES
    rrf_k: int = P.RRF_K
    rerank_top: int = P.RERANK_TOP
    contexts: int = P.CONTEXTS
    section_chunks: int = P.SECTION_CHUNKS
    section_chars: int = P.SECTION_CHARS
    context_chars: int = P.CONTEXT_CHARS
    heading_ratio: float = P.HEADING_RATIO
    strict_redaction: bool = True
    pdf_engine: str = "blocks"


def file_values(path: str | Path) -> dict[str, str]:
    """NAME=value lines; comments, blank lines and quotes around a value are dropped, ``export`` before a name too."""
    out = {}
    p = Path(path)
    for line in p.read_text(encoding="utf-8").splitlines() if p.is_file() else []:
        line = line.strip().removeprefix("export ").strip()
        if line and line[0] != "#" and "=" in line:
            name, _, value = line.partition("=")
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def load(env: Mapping[str, str] | None = None, path: str | Path | None = None) -> Settings:
    """Settings from a file, overridden by the environment."""
    given = (file_values(path) if path else {}) | dict(os.environ if env is None else env)
    values = {}
    for f in fields(Settings):
        raw = (given.get(f.name.upper()) or "").strip()
        if not raw:
            continue
        try:
            values[f.name] = raw.lower() in _TRUE if isinstance(f.default, bool) else int(float(raw)) if isinstance(f.default, int) else type(f.default)(raw)
        except (ValueError, OverflowError):
            continue
    return Settings(**values)
