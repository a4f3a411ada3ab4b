"""Landed bytes to text: compression by its first bytes, then the charset that header, byte mark or markup names."""

from __future__ import annotations

import gzip
import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMED = re.compile(rb"""charset=["']?\s*([A-Za-z0-9_.:-]+)|encoding=["']([A-Za-z0-9_.:-]+)""", re.I)
MARKS = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]


def to_text(body: bytes | None, header: str | None) -> str:
    raw = bytes(body or b"")
    if raw[:2] == b"\x1f\x8b":
        try:
            raw = gzip.decompress(raw)
        except (OSError, EOFError, zlib.error):
            return ""
    names = []
    for mark, name in MARKS:
        if raw.startswith(mark):
            raw, names = raw[len(mark) :], [name]
            break
    for place in ((header or "").encode(), raw[:2048]):
        if m := NAMED.search(place):
            names.append((m[1] or m[2]).decode())
    for name in [*names, "utf-8"]:
        try:
            return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("windows-1252", "replace")


@F.pandas_udf(T.StringType())
def decoded(bodies: pd.Series, headers: pd.Series) -> pd.Series:
    return pd.Series([to_text(b, h) for b, h in zip(bodies, headers, strict=True)])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files as documents: doc_id (the path) and body; each file is read by the executor that decodes it."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("doc_id"), decoded("content", F.lit("")).alias("body"))
