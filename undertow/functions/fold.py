"""A running fold over an array as one column expression: what an automaton says at each item."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, as a lambda would compute it anew for each item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str, size: int = 128) -> Column:
    """Array of emit(state before the item, item), one for each item; step gives the next state, `kind` is emit's type.

    Spark copies the state at each item, so items are taken in chunks of `size` and the chunks' results put together at the
    end: n items cost about n * (size + n / size) copied references, not n**2. Null gives null."""
    none = F.array().cast(f"array<{kind}>")
    many = F.array().cast(f"array<array<{kind}>>")

    def chunks(x: Column) -> Column:
        starts = F.when(F.size(x) > 0, F.sequence(F.lit(0), (F.size(x) - 1).cast("int"), F.lit(size))).when(x.isNotNull(), F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.slice(x, at + 1, size))

    def chunk(held: Column, part: Column) -> Column:
        begin = F.struct(held["s"].alias("s"), none.alias("out"))
        one = lambda h, x: F.struct(step(h["s"], x).alias("s"), F.concat(h["out"], F.array(emit(h["s"], x))).alias("out"))
        return let(F.aggregate(part, begin, one), lambda r: F.struct(r["s"].alias("s"), F.concat(held["done"], F.array(r["out"])).alias("done")))

    return F.aggregate(let(items, chunks), F.struct(zero.alias("s"), many.alias("done")), chunk, lambda h: F.flatten(h["done"]))


def top(stack: Column) -> Column:
    """The last item; null of an empty stack."""
    return F.try_element_at(stack, F.lit(-1))


def popped(stack: Column) -> Column:
    return F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))


def pushed(stack: Column, item: Column | str) -> Column:
    return F.concat(stack, F.array(F.lit(item) if isinstance(item, str) else item))
