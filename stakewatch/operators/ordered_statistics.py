"""Medians and percentiles over everything earlier, per purchase.

These do not add up from days, so each purchase needs the order of all values before it. Two exact ways, chosen by
the size of the person's group:

* up to ``limit`` purchases: arrays over a growing window frame, all built-in expressions;
* above it: the group is cut into blocks along its own order and handled by ``blocked_statistics``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stakewatch import params
from stakewatch.functions.numeric import ratio
from stakewatch.operators.blocked import blocked_statistics
from stakewatch.operators.history import PERSON, sorted_median

STATISTICS = [
    "prior_median_purchase_value",
    "prior_purchase_value_percentile",
    "prior_median_ownership_increase_percent",
    "_median",
    "_below",
    "_median_log",
    "_mad",
    "_median_90d",
]


def has_large_groups(placed: DataFrame, limit: int = params.ARRAY_GROUP_LIMIT) -> bool:
    """Whether any group needs the second way. On a written table this reads one column, mostly its statistics."""
    return not placed.filter(F.col("group_size") > limit).select("group_size").isEmpty()


def with_prior_statistics(placed: DataFrame, limit: int = params.ARRAY_GROUP_LIMIT, large_groups: bool = True) -> DataFrame:
    """Adds the statistics of the earlier purchases to each purchase.

    ``large_groups=False`` leaves the second way out of the plan; only for a table checked by ``has_large_groups``.
    """
    if not large_groups:
        return array_statistics(placed)
    small = array_statistics(placed.filter(F.col("group_size") <= limit))
    large = blocked_statistics(placed.filter(F.col("group_size") > limit))
    return small.unionByName(large.select(*small.columns))


def array_statistics(placed: DataFrame) -> DataFrame:
    earlier = Window.partitionBy(*PERSON).orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    item = F.struct(
        F.col("purchase_value").alias("v"),
        F.col("ownership_increase_percent").cast("double").alias("o"),
        F.col("_full_90d").alias("t"),
    )
    listed = placed.withColumn("_earlier", F.collect_list(item).over(earlier))
    # strict: before this day; positional: also earlier purchases of the same day
    strict = F.slice(F.col("_earlier"), F.lit(1), F.col("prior_purchase_count").cast("int"))
    listed = listed.withColumns(
        {
            "_strict": F.array_sort(F.filter(F.transform(strict, lambda e: e["v"]), lambda v: v.isNotNull())),
            "_owned": F.array_sort(F.filter(F.transform(strict, lambda e: e["o"]), lambda v: v.isNotNull())),
            "_positive": F.array_sort(F.filter(F.transform(F.col("_earlier"), lambda e: e["v"]), lambda v: v > 0)),
            # own 90-day sums of the earlier purchases; those of the same day only see what came before this one
            "_trailing": F.array_sort(
                F.concat(
                    F.transform(strict, lambda e: e["t"]), F.array_repeat("_same_day_90d", F.col("_day_place").cast("int"))
                )
            ),
        }
    )
    value = F.col("purchase_value")
    listed = listed.withColumns(
        {
            "prior_median_purchase_value": sorted_median(F.col("_strict")),
            "prior_purchase_value_percentile": ratio(
                F.size(F.filter(F.col("_strict"), lambda v: v <= value)).cast("double"), F.size("_strict")
            )
            * 100,
            "prior_median_ownership_increase_percent": sorted_median(F.col("_owned")),
            "_median": sorted_median(F.col("_positive")),
            "_below": F.size(F.filter(F.col("_positive"), lambda v: v < value)).cast("bigint"),
            "_median_log": sorted_median(F.transform(F.col("_positive"), lambda v: F.log1p(v))),
            "_median_90d": sorted_median(F.col("_trailing")),
        }
    )
    middle = F.col("_median_log")
    distances = F.array_sort(F.transform(F.col("_positive"), lambda v: F.abs(F.log1p(v) - middle)))
    return listed.withColumn("_mad", sorted_median(distances)).drop(
        "_earlier", "_strict", "_owned", "_positive", "_trailing"
    )
