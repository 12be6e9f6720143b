"""Repeatable pseudo-random values for generated rows.

A draw is a slice of the md5 of a seed, a label and the row's own id. Unlike ``rand``, it does not depend
on how rows are partitioned, so a task that runs again after a lost executor makes the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


class Draws:
    """Draws for the rows told apart by ``ids``."""

    def __init__(self, ids: Sequence[str], seed: int = 0):
        self.ids = list(ids)
        self.seed = seed

    def bits(self, label: str) -> Column:
        """32 bits as a bigint."""
        text = F.concat_ws("|", F.lit(str(self.seed)), F.lit(label), *[F.col(c).cast("string") for c in self.ids])
        return F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("bigint")

    def share(self, label: str) -> Column:
        """A double in [0, 1)."""
        return self.bits(label) / F.lit(4294967296.0)

    def whole(self, label: str, low: int, high: int) -> Column:
        """An int from ``low`` to ``high``, both included."""
        return (F.floor(self.share(label) * F.lit(float(high - low + 1))) + F.lit(low)).cast("int")

    def amount(self, label: str, low: int, high: int, type_: str = "decimal(12,2)") -> Column:
        """An amount from ``low`` to ``high`` in whole cents."""
        return (self.whole(label, low * 100, high * 100) * F.lit(Decimal("0.01"))).cast(type_)

    def one_of(self, label: str, values: Sequence[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), self.whole(label, 1, len(values)))

    def chance(self, label: str, probability: float) -> Column:
        return self.share(label) < F.lit(probability)

    def later(
        self,
        start: Column,
        label: str,
        days: tuple[int, int],
        hours: tuple[int, int],
        minutes: tuple[int, int] = (0, 0),
    ) -> Column:
        """``start`` moved on by a drawn number of days, hours and minutes."""
        return F.timestamp_add(
            "MINUTE",
            self.whole(f"{label}_days", *days) * 1440
            + self.whole(f"{label}_hours", *hours) * 60
            + self.whole(f"{label}_minutes", *minutes),
            start,
        )
