"""Content hashes, canonical JSON digests and order-free table signatures."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(df: DataFrame, drop: Sequence[str] = ()) -> Column:
    """The row as compact JSON with sorted keys, without private (`_`) and volatile fields. NULL fields are kept."""
    names = sorted(c for c in df.columns if not c.startswith("_") and c not in drop)
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def json_digest(df: DataFrame, drop: Sequence[str] = ()) -> Column:
    return F.sha2(canonical_json(df, drop), 256)


def settings_fingerprint(df: DataFrame, schema: str, fields: Sequence[str]) -> Column:
    """`schema:sha256:` and the first 16 hex digits of the settings' digest; the schema is not part of the digest."""
    return F.concat(F.lit(f"{schema}:sha256:"), F.substring(F.sha2(canonical_json(df.select(*fields)), 256), 1, 16))


def lanes(text: Column) -> list[Column]:
    """Four 60-bit integers of sha256: the terms of the order-free signature."""
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]


def signature(df: DataFrame, text: Column, by: Sequence[str] = ()) -> DataFrame:
    """One order-free digest per group: rows add up lane by lane, so the aggregate is partial and nothing is collected.

    The digest changes when a row is added, dropped, changed or repeated, and not when rows move.
    """
    rows = df.select(*by, *[c.alias(f"__l{i}") for i, c in enumerate(lanes(text))])
    sums = rows.groupBy(*by).agg(F.count("*").alias("rows"), *[F.sum(f"__l{i}").alias(f"__l{i}") for i in range(4)])
    total = F.concat_ws(":", "rows", *[F.col(f"__l{i}").cast("string") for i in range(4)])
    return sums.select(*by, "rows", F.sha2(total, 256).alias("signature"))


@F.pandas_udf(T.StringType())
def float32_sha256(samples: pd.Series) -> pd.Series:
    """sha256 of a float array as little-endian float32 bytes (SQL has no view of float bytes)."""
    import hashlib

    import numpy as np

    return samples.map(lambda a: None if a is None else hashlib.sha256(np.asarray(a, dtype="<f4").tobytes()).hexdigest())
