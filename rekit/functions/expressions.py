"""Column expressions of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_label(zone="zone", position="position", shelf="shelf") -> Column:
    """zone-position-shelf; NULL as soon as one part is NULL."""
    dash = F.lit("-")
    return F.concat(F.col(zone), dash, F.col(position), dash, F.col(shelf))


def net_available() -> Column:
    return F.col("on_hand") - F.col("on_reserve") - F.col("unavailable")


def invalid_share(valid: str, invalid: str) -> Column:
    """1.0 without a valid sum, 0.0 without an invalid one, else the share.

    Which branch applies depends on a sum being NULL, not on it being 0.
    """
    return (
        F.when(F.col(valid).isNull(), F.lit(1.0))
        .when(F.col(invalid).isNull(), F.lit(0.0))
        .otherwise(
            F.try_divide(
                F.col(invalid).cast("double"), (F.col(valid) + F.col(invalid)).cast("double")
            )
        )
    )


def fill_count(pool="pool", standard="std_qty", slots="slots") -> Column:
    """How many build slots, served in order, receive a component.

    Every slot takes the same quantity while the pool still covers it, so slot r
    is served exactly if pool >= standard * r. A standard of zero or less never
    runs out once the pool covers it; an unknown standard serves nobody.
    """
    served = F.expr(f"{pool} div nullif({standard}, 0)")
    return (
        F.when(
            F.col(standard) > 0,
            F.greatest(F.lit(0).cast("long"), F.least(F.col(slots), served)),
        )
        .when(F.col(standard).isNotNull() & (F.col(pool) >= F.col(standard)), F.col(slots))
        .otherwise(F.lit(0).cast("long"))
    )
