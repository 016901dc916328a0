"""Rows that may have a partner, told by a bitmap of bounded size before whole texts or sets are shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

#: 64-bit words of the bitmap: its broadcast has at most so many rows of two longs, whatever the input
BITMAP_WORDS = 1 << 20


def _place(key: Column) -> tuple[Column, Column]:
    bit = F.pmod(F.xxhash64(key), F.lit(64 * BITMAP_WORDS))
    return F.shiftright(bit, 6), bit.bitwiseAND(F.lit(63)).cast("int")


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def aside(rows: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``rows`` with columns of the given names called otherwise, and what gives a filtered or changed ``rows`` its own columns back."""
    own, taken, renamed = rows.columns, {n.lower() for n in names}, {}
    for column in own:
        if column.lower() in taken:
            renamed[column] = fresh([*own, *names, *renamed.values()], column)
    inner = [renamed.get(c, c) for c in own]

    def back(changed: DataFrame) -> DataFrame:
        return changed.select(*[F.col(f"`{now}`").alias(column) for now, column in zip(inner, own, strict=True)])
    return rows.withColumnsRenamed(renamed), back


def flagged(rows: DataFrame, key: str, ids: DataFrame, name: str) -> DataFrame:
    """``rows`` with boolean ``name``: false only if ``key`` is not among ``ids`` (one column); rows of a NULL key are false.

    With far more ids than bits nearly all rows are true; an exact join has to follow in any case.
    """
    at, words, bits = (fresh([*rows.columns, name], c) for c in ("at_word", "of_word", "word_bits"))
    word, bit = _place(F.col(ids.columns[0]))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bitmap = ids.filter(F.col(ids.columns[0]).isNotNull()).groupBy(word.alias(words)).agg(F.bit_or(one).alias(bits))
    word, bit = _place(F.col(f"`{key}`"))
    found = rows.withColumn(at, F.when(F.col(f"`{key}`").isNotNull(), word)).join(F.broadcast(bitmap), F.col(at) == F.col(words), "left")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(F.getbit(bits, bit) == 1, F.lit(False)).alias(name))


def probable(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``key`` may be among ``ids``, with their own columns."""
    name = fresh(rows.columns, "probable")
    return flagged(rows, key, ids, name).filter(name).drop(name)
