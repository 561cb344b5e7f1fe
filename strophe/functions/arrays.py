"""Folds and fixed tables inside of expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def table(rows: list[dict], schema: str) -> Column:
    """A fixed table as one literal array of structs; ``schema`` names the
    fields of a row.  It is folded to a constant, so the plan stays small."""
    return F.from_json(F.lit(json.dumps(rows)), F.lit(f"array<struct<{schema}>>"))


def once(x: Column, use) -> Column:
    """``use`` of x with x evaluated once: a lambda's variable is bound, while
    a reference from inside of a lambda is evaluated for every element."""
    return F.element_at(F.transform(F.array(x), use), 1)


def scan_blocks(items: Column, state: Column, none: Column, step) -> Column:
    """What a fold over ``items`` puts out, in order: ``step(state, item)``
    gives the next state and an array of what is put out; ``none`` is an empty
    array of that type.  It runs in blocks of about sqrt(n) items, so that no
    array of n grows one by one."""

    def blocks(x: Column) -> Column:
        size = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(x).cast("double"))).cast("int"))
        starts = F.when(F.size(x) > 0, F.sequence(F.lit(1), F.size(x), size)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(x, i, size))

    def inner(before: Column, block: Column) -> Column:
        def one(a: Column, x: Column) -> Column:
            state, put = step(a["state"], x)
            return F.struct(state.alias("state"), F.concat(a["out"], put).alias("out"))

        return F.aggregate(block, F.struct(before.alias("state"), none.alias("out")), one)

    first = F.array(F.struct(state.alias("state"), none.alias("out")))
    done = F.aggregate(once(items, blocks), first, lambda a, block: F.concat(a, F.array(inner(F.element_at(a, -1)["state"], block))))
    return F.flatten(F.transform(done, lambda x: x["out"]))
