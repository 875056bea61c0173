"""Content identities and short handles."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Fixed value: the digits of a handle in the order of their worth.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
NAMESPACE = "quillon.handle.v1"


def content_id(*parts: Column) -> Column:
    """SHA-256 over the parts, each behind its length in bytes, a null as ``-``, so that no two lists look alike."""
    framed = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*framed), 256)


def base62(value: int) -> str:
    out = ""
    for _ in range(11):
        value, digit = divmod(value, 62)
        out = DIGITS[digit] + out
    return out


def handle(snapshot: str, target: str | None, namespace: str = NAMESPACE) -> str:
    """An 11-character handle: XXH64, seed 0, over a JSON list, in base 62. No target: the whole scope."""
    import xxhash

    kind = "scope" if target is None else "record"
    return base62(xxhash.xxh64_intdigest(json.dumps([namespace, snapshot, kind, target], separators=(",", ":"), ensure_ascii=False), 0))


def handles(record: Column, snapshot: str) -> Column:
    """Handles of records; Spark's own xxhash64 has another seed and no base 62."""

    @pandas_udf(StringType())
    def derive(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: handle(snapshot, x), na_action="ignore")

    return derive(record)


@pandas_udf(StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """JSON with sorted keys and without spaces; null for text that is no JSON or has a key twice."""
    return values.map(_canonical, na_action="ignore")


def _canonical(text: str) -> str | None:
    def once(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key twice")
        return dict(pairs)

    def number(x: str) -> int:
        if abs(int(x)) > 2**53 - 1:
            raise ValueError("an integer beyond 2^53 - 1")
        return int(x)

    def refuse(x: str):
        raise ValueError(x)

    try:
        return json.dumps(json.loads(text, object_pairs_hook=once, parse_int=number, parse_constant=refuse), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None
