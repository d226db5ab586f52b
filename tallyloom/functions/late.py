"""Lateness by area: each rule has a cut-off and says which rows it covers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LateRule:
    """Rows with a listed value in any ``include`` column and in no ``exclude`` column."""

    cutoff: str
    include: Mapping[str, Sequence]
    exclude: Mapping[str, Sequence] = field(default_factory=dict)

    def covers(self) -> Column:
        inside = reduce(or_, [F.col(c).isin(list(v)) for c, v in self.include.items()])
        outside = [~F.col(c).isin(list(v)) for c, v in self.exclude.items()]
        return reduce(and_, outside, inside)


def late_expr(ts: Column | str, rules: Sequence[LateRule]) -> Column:
    """1 where any covering rule's cut-off lies strictly before ``ts``.

    Rows that no rule covers and rows without a time give 0. The area lists are
    literals, so the test needs neither a join nor a shuffle.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    hits = [(ts > F.lit(r.cutoff).cast("timestamp_ntz")) & r.covers() for r in rules]
    return F.when(reduce(or_, hits), 1).otherwise(0)
