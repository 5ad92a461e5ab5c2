"""Small building blocks for array expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable, so it is evaluated once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(lengths: Column) -> Column:
    """[a, b, c] -> [0, a, a+b, a+b+c]."""
    return F.aggregate(
        lengths,
        F.array(F.lit(0)),
        lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
    )


def running_offsets(lengths: Column) -> Column:
    """Exclusive prefix sums of an int array.

    Sums run inside short blocks and then over the block totals, so the copying
    done by array appends stays linear for texts with very many matches.
    """

    def blocked(arr: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.greatest(F.size(arr), F.lit(1)) - 1) / BLOCK).cast("int")),
            lambda b: _scan(F.slice(arr, b * BLOCK + 1, F.lit(BLOCK))),
        )
        return let(
            blocks,
            lambda bs: let(
                _scan(F.transform(bs, lambda s: F.element_at(s, -1))),
                lambda base: F.flatten(
                    F.transform(
                        bs,
                        lambda s, i: F.transform(F.slice(s, 1, F.size(s) - 1), lambda x: x + F.get(base, i)),
                    )
                ),
            ),
        )

    few = lambda arr: F.slice(_scan(arr), F.lit(1), F.size(arr))
    return let(lengths, lambda arr: F.when(F.size(arr) <= BLOCK, few(arr)).otherwise(blocked(arr)))


def unnest(df: DataFrame, keep: Sequence[str], array: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per array element, with its position on request.

    The outer form with a filter behind it: a plain explode makes Spark push a size test
    below, and a computed array would then be computed twice.
    """
    if position is None:
        rows = df.select(*keep, F.explode_outer(array).alias(name))
    else:
        rows = df.select(*keep, F.posexplode_outer(array).alias(position, name))
    return rows.filter(F.col(name).isNotNull())


def string_array(values) -> Column:
    """Array literal of strings, also when empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def string_map(mapping: dict[str, str]) -> Column:
    """Map literal of strings, also when empty."""
    if not mapping:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def seeded_index(key: Column, seed: int | str, size: int) -> Column:
    """0-based pick out of ``size`` values, a pure function of (key, seed)."""
    digest = F.md5(F.concat(key, F.lit(f"|{seed}")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(size)).cast("int")
