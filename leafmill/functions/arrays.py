"""Helpers for working inside one row's arrays (no shuffle)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A column that a lambda mentions is evaluated again for every element;
    a lambda variable is not. One-element ``transform`` binds it.
    """
    return F.transform(F.array(value), body)[0]


def indices(arr: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """0-based positions of the elements for which ``keep(element, position)`` holds."""
    flagged = F.transform(arr, lambda x, i: F.when(keep(x, i), i))
    return F.filter(flagged, lambda i: i.isNotNull())


def window_of(arr: Column, start: Column, end: Column) -> Column:
    """Elements at 0-based positions ``start`` to ``end`` inclusive."""
    return F.slice(arr, start + 1, end - start + 1)


def weave(gaps: Column, pieces: Column) -> Column:
    """gap0 piece0 gap1 piece1 ... gapN as one string (``split`` and its matches)."""
    return F.concat_ws(
        "",
        F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(pieces, i), F.lit("")))),
    )


def outside_spans(arr: Column, opens: Callable, closes: Callable) -> Column:
    """Elements outside open…close spans; closing elements are dropped as well.

    An element that both opens and closes counts as closing. A span that is
    never closed runs to the end.
    """
    event = "struct<at:int,on:boolean>"
    spans = "array<struct<a:int,b:int>>"
    far = F.lit(2147483647)

    def merge(acc, e):
        is_open = acc["start"].isNotNull()
        return F.struct(
            F.when(e["on"], F.coalesce(acc["start"], e["at"])).alias("start"),
            F.when(~e["on"] & is_open, F.concat(acc["done"], F.array(F.struct(acc["start"].alias("a"), e["at"].alias("b")))))
            .otherwise(acc["done"])
            .alias("done"),
        )

    def finish(acc):
        return F.when(
            acc["start"].isNotNull(),
            F.concat(acc["done"], F.array(F.struct(acc["start"].alias("a"), far.alias("b")))),
        ).otherwise(acc["done"])

    def body(ls):
        events = F.filter(
            F.transform(
                ls,
                lambda x, i: F.when(closes(x), F.struct(i.alias("at"), F.lit(False).alias("on"))).when(
                    opens(x), F.struct(i.alias("at"), F.lit(True).alias("on"))
                ),
            ),
            lambda e: e.isNotNull(),
        )
        init = F.struct(F.lit(None).cast("int").alias("start"), F.array().cast(spans).alias("done"))
        return let(
            F.aggregate(events.cast(f"array<{event}>"), init, merge, finish),
            lambda sp: F.filter(
                ls, lambda x, i: ~closes(x) & ~F.exists(sp, lambda s: (i >= s["a"]) & (i <= s["b"]))
            ),
        )

    return let(arr, body)
