"""Randomness that depends on a seed and a key only, the same on every executor, in every run and in other engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int | str, *keys: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def draw(seed: int | str, *keys: Column | str) -> Column:
    """An integer in [0, 2^32)."""
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("bigint")


def unit(seed: int | str, *keys: Column | str) -> Column:
    """A double in [0, 1)."""
    return draw(seed, *keys) / F.lit(4294967296.0)


def digest_sql(seed: int | str, *keys: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(keys)}))"


def draw_sql(seed: int | str, *keys: str) -> str:
    return f"('0x' || substr({digest_sql(seed, *keys)}, 1, 8))::BIGINT"


def unit_sql(seed: int | str, *keys: str) -> str:
    return f"({draw_sql(seed, *keys)} / 4294967296.0)"
