"""Seeded order that every engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF


def mix32(seed: Column, number: Column) -> Column:
    """A 32-bit mix of two integers by shift, xor and 16-bit-split multiplication, as a bigint."""

    def times(x: Column, k: int) -> Column:
        low = x.bitwiseAND(F.lit(0xFFFF)) * k
        high = F.shiftright(x, 16) * k
        return (low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_MASK))

    x = (number.cast("bigint").bitwiseXOR(seed.cast("bigint") * 2654435)).bitwiseAND(F.lit(_MASK))
    x = times(x.bitwiseXOR(F.shiftright(x, 16)), 0x45D9F3B)
    x = times(x.bitwiseXOR(F.shiftright(x, 16)), 0x45D9F3B)
    return x.bitwiseXOR(F.shiftright(x, 16))


def mix32_sql(seed: str, number: str) -> str:
    """The same for DuckDB."""
    step = lambda x: f"((xor({x}, {x} >> 16)::HUGEINT * 73244475) % 4294967296)::BIGINT"
    x0 = f"(xor(({number})::BIGINT, ({seed})::BIGINT * 2654435) & 4294967295)"
    x2 = step(step(x0))
    return f"xor({x2}, {x2} >> 16)"


def text_hash(seed: int, value: Column) -> Column:
    """A 32-bit hash of a seed and a text, as a bigint: an order of names that every engine can repeat."""
    return F.conv(F.left(F.md5(F.concat_ws(":", F.lit(seed), value)), F.lit(8)), 16, 10).cast("bigint")


def text_hash_sql(seed: int, value: str) -> str:
    """The same for DuckDB."""
    return f"('0x' || substr(md5('{seed}:' || {value}), 1, 8))::BIGINT"


def day_seed(at: Column) -> Column:
    return F.floor(F.unix_millis(at) / 86_400_000)
