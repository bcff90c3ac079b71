"""Running values along time that do not put a whole key into one task.

A window over ``room_id`` alone would sort every reading of a busy room in one task. Here
each key is cut into slices of time. Rows are ordered inside their slice only; one summary
row per slice is carried forward along the key, and joined back to the slice. The input is read
twice: once for the rows, which are shuffled on (key, slice), and once for the summaries, which
are combined before their shuffle. The two reads prune different columns, so Spark shares
neither; fold over the stored log, where the second read is a narrow scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_no: Column,
    *,
    sums: Mapping[str, Column] | None = None,
    totals: Mapping[str, str] | None = None,
    values: Mapping[str, Column] | None = None,
    lasts: Mapping[str, str] | None = None,
    priors: Mapping[str, str] | None = None,
    peers: bool = False,
) -> DataFrame:
    """Add running columns to ``df``; keys must not be null.

    ``slice_no`` must not decrease along ``order``. ``sums`` are running sums up to and with
    the row (``peers``: and all rows equal to it in ``order``); ``totals`` maps a new column
    to the sum whose total over the key it holds. ``lasts`` maps a new column to the latest
    non-null of one of the ``values`` up to and with the row, ``priors`` to the one strictly
    before it.
    """
    sums, totals, values = dict(sums or {}), dict(totals or {}), dict(values or {})
    lasts, priors = dict(lasts or {}), dict(priors or {})
    cell = [*keys, "_slice"]
    inputs = {"_slice": slice_no}
    inputs.update({f"_in_{n}": e for n, e in {**sums, **values}.items()})
    rows = df.withColumns(inputs)

    position = F.struct(*order)
    summary = rows.groupBy(*cell).agg(
        *[F.sum(f"_in_{n}").alias(f"_in_{n}") for n in sums],
        *[
            F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), position)).alias(f"_in_{n}")
            for n in values
        ],
    )
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *cell,
        *[F.sum(f"_in_{n}").over(earlier).alias(f"_carry_{n}") for n in sums],
        *[F.last(f"_in_{n}", ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in values],
        *[F.sum(f"_in_{n}").over(whole).alias(t) for t, n in totals.items()],
    )

    inside = Window.partitionBy(*cell).orderBy(*order)
    upto = (
        inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        if peers
        else inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = {f"_own_{n}": F.sum(f"_in_{n}").over(upto) for n in sums}
    for frame, columns in ((upto, lasts), (before, priors)):
        local.update({f"_own_{c}": F.last(f"_in_{v}", ignorenulls=True).over(frame) for c, v in columns.items()})

    joined = rows.withColumns(local).join(carried, cell, "left")
    latest = {**lasts, **priors}
    kept = [c for c in df.columns if c not in sums and c not in latest]
    zero = F.lit(0)
    return joined.select(
        *kept,
        *[(F.coalesce(f"_own_{n}", zero) + F.coalesce(f"_carry_{n}", zero)).alias(n) for n in sums],
        *[F.coalesce(f"_own_{c}", f"_carry_{v}").alias(c) for c, v in latest.items()],
        *totals,
    )
