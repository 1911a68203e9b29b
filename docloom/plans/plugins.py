"""Engines for binary inputs: page text, rendering, recognition.  None is built in; each is registered by name.

An engine works on whole partitions (an iterator of Arrow batches), so a model or a library is opened once a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: kind: schema of what the engine returns; each takes (key, raw_bytes) rows.
SCHEMAS = {
    "page_text": "page_number int, text string",
    "page_render": "page_number int, width int, height int, pixels binary",
    "page_images": "page_number int, ordinal int, width int, height int, pixels binary",
    "image_decode": "width int, height int, pixels binary",
    "recognize": "text string, confidence double",
    "detect": "x int, y int, width int, height int, confidence double",
}


@dataclass
class Registry:
    engines: dict[tuple[str, str], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]] = field(default_factory=dict)
    reasons: dict[str, str] = field(default_factory=dict)

    def register(self, kind: str, name: str, engine) -> None:
        if kind not in SCHEMAS:
            raise ValueError(f"unknown kind of engine: {kind}")
        self.engines[kind, name] = engine

    def available(self, kind: str) -> bool:
        return any(k == kind for k, _ in self.engines)

    def reason(self, kind: str) -> str:
        return self.reasons.get(kind, f"no engine for {kind} is registered")

    def run(self, kind: str, rows: DataFrame, key: str, name: str | None = None, raw: str = "raw_bytes") -> DataFrame:
        """key and the engine's columns; LookupError without an engine."""
        found = [e for (k, n), e in sorted(self.engines.items()) if k == kind and name in (None, n)]
        if not found:
            raise LookupError(self.reason(kind))
        kind_of_key = dict(rows.dtypes)[key]
        return rows.select(key, F.col(raw)).mapInArrow(found[0], f"`{key}` {kind_of_key}, {SCHEMAS[kind]}")


registry = Registry()


@dataclass(frozen=True)
class Settings:
    """Limits of a run; 0 means the default."""

    max_batch: int = 16
    pool: int = 2
    recognition_height: int = 48
    max_chunk_bytes: int = 2200
    overlap_bytes: int = 150

    def normalized(self) -> Settings:
        base = Settings()
        return Settings(**{k: v or getattr(base, k) for k, v in self.__dict__.items()})

    @staticmethod
    def flag(value: str | None) -> bool:
        return (value or "").strip().lower() in {"1", "true", "yes", "on"}


def dictionary(spark, path: str) -> list[str]:
    """A recognition dictionary: the blank, then a token a line."""
    return ["", *[r["value"] for r in spark.read.text(path).collect()]]
