"""A join order given from outside, as JSON: which two inputs are joined by which keys, and what each join keeps.

Each item has ``ID``, ``Left``, ``Right`` (an input's name or an earlier item's ID), ``ProbeKeys``, ``BuildKeys`` (a
name, several parted by commas, or a list) and may have ``Projection``; ``Pred`` is a comment. The last item is the result.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _names(value: str | Sequence[str]) -> list[str]:
    return [n.strip() for n in value.split(",")] if isinstance(value, str) else list(value)


def join_in_order(order: str | Sequence[Mapping], inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Inner joins in the given order. Columns of the two sides of a join must have different names, but for its keys of one name."""
    items = json.loads(order) if isinstance(order, str) else order
    if not items:
        raise ValueError("an empty join order")
    made = dict(inputs)
    for item in items:
        missing = [s for s in (item["Left"], item["Right"]) if s not in made]
        if missing:
            raise ValueError(f"no input or earlier join is called {', '.join(missing)}")
        left, right = made[item["Left"]], made[item["Right"]]
        probe, build = _names(item["ProbeKeys"]), _names(item["BuildKeys"])
        own = {b: f"_{b}" for p, b in zip(probe, build, strict=True) if p == b}
        right = right.withColumnsRenamed(own)
        on = [F.col(p) == F.col(own.get(b, b)) for p, b in zip(probe, build, strict=True)]
        out = left.join(right, on).drop(*own.values())
        made[item["ID"]] = out.select(*item["Projection"]) if item.get("Projection") else out
    return made[items[-1]["ID"]]
