"""Addresses to bytes: fetched in the tasks, a few at a time, with errors as rows."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.sources import resolve as R

FIELDS = [("raw", T.BinaryType(), pa.binary()), ("content_type", T.StringType(), pa.string()), ("disposition", T.StringType(), pa.string()), ("fetch_error", T.StringType(), pa.string())]


def get(url: str | None, timeout: float, most_bytes: int) -> tuple:
    """(body, Content-Type, Content-Disposition, error) of one address; a body over ``most_bytes`` is an error."""
    try:
        if not (url or "").startswith(("http://", "https://")):
            raise ValueError("only http and https are fetched")
        with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
            body = answer.read(most_bytes + 1)
            if len(body) > most_bytes:
                raise ValueError(f"the body has more than {most_bytes} bytes")
            return body, answer.headers.get("Content-Type"), answer.headers.get("Content-Disposition"), None
    except (urllib.error.URLError, OSError, ValueError) as e:
        return None, None, None, f"fetch failed: {e}"


def fetch(rows: DataFrame, url: str, timeout: float = 30.0, most_bytes: int = 64 << 20, at_once: int = 8) -> DataFrame:
    """``rows`` with raw, content_type, disposition and fetch_error of the address in ``url``.

    A task that is tried again fetches again; write the result before it is used more than once."""
    place = rows.columns.index(url)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                for i in range(0, batch.num_rows, 4 * at_once):
                    part = batch.slice(i, 4 * at_once)
                    got = list(zip(*pool.map(lambda u: get(u, timeout, most_bytes), part.column(place).to_pylist()), strict=True))
                    columns = [pa.array(v, kind) for v, (_, _, kind) in zip(got, FIELDS, strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*batch.schema.names, *[n for n, _, _ in FIELDS]])

    return rows.mapInArrow(apply, T.StructType([*rows.schema.fields, *[T.StructField(n, t) for n, t, _ in FIELDS]]))


def resolve_urls(rows: DataFrame, url: str, **limits) -> DataFrame:
    """Sources of addresses: upgraded, fetched, and resolved by headers, name and first bytes; failures keep their row."""
    asked = rows.withColumn("__address", R.upgrade_url(F.col(url)))
    got = fetch(asked, "__address", **limits).withColumn("__name", R.filename_from_disposition(F.col("disposition")))
    out = R.resolve(got, "raw", url="__address", content_type="content_type", filename="__name")
    return out.withColumn("error", F.coalesce("fetch_error", "error")).drop("__address", "__name", "raw", "fetch_error", "disposition", "content_type")
