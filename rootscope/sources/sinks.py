"""Where results go: upserted incidents, feedback, signed webhook payloads, counters."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import latest


def upserted(old: DataFrame, new: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last written row of each key."""
    return latest(old.unionByName(new), key, order)


def feedback(rows: DataFrame) -> DataFrame:
    return rows.orderBy("recorded_at", "incident")


def sign(secret: bytes, body: bytes) -> str:
    return "sha256=" + hmac.new(secret, body, hashlib.sha256).hexdigest()


def payloads(events: DataFrame, secret: str, event: str = "event", id_: str = "id") -> DataFrame:
    """event, id, JSON body and its signature, ready for delivery."""

    @F.pandas_udf("string")
    def signed(body: pd.Series) -> pd.Series:
        return body.map(lambda b: sign(secret.encode(), b.encode()))

    body = F.to_json(F.struct(*events.columns))
    return events.select(F.col(event).alias("event"), F.col(id_).alias("id"), body.alias("body")).withColumn("signature", signed("body"))


def delays(attempts: int = 4, first_ms: int = 500) -> list[int]:
    """Waits between attempts, each twice the last."""
    return [first_ms * 2**i for i in range(attempts - 1)]


def retried(status: int) -> bool:
    """Whether a failed delivery is tried again: not after a client error, but for too many requests."""
    return not 400 <= status < 500 or status == 429


def counters(**parts: DataFrame) -> DataFrame:
    """name, value: rows of each part."""
    from functools import reduce

    return reduce(DataFrame.union, [df.agg(F.count("*").alias("value")).select(F.lit(n).alias("name"), "value") for n, df in parts.items()])
