"""Behaviour signals of each purchase and the scores made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stakewatch import params
from stakewatch.functions.numeric import clamp, ratio, round_to
from stakewatch.functions.roles import is_operating, role_score
from stakewatch.operators.grouping import last_per_key
from stakewatch.operators.history import with_daily_history
from stakewatch.operators.ordered_statistics import with_prior_statistics


def executive_histories(events: DataFrame) -> DataFrame:
    """Purchases with their full causal history, order statistics included."""
    return complete_histories(with_daily_history(events))


def complete_histories(placed: DataFrame, large_groups: bool = True) -> DataFrame:
    """The second half of ``executive_histories``, for a written table of daily histories."""
    return with_prior_statistics(placed, large_groups=large_groups).withColumn("history_id", history_id())


def history_id() -> Column:
    return F.concat(F.lit("history:"), F.col("event_id"))


def abnormality_columns() -> dict[str, Column]:
    """Size of a purchase against the person's earlier ones."""
    value, priors = F.col("purchase_value"), F.col("_priors")
    first = priors == 0
    multiple = ratio(value, F.col("_median"))
    percentile = ratio(F.col("_below").cast("double"), priors) * 100
    z = F.when(first, F.lit(None)).when(
        F.col("_mad") > 0, (F.log1p(value) - F.col("_median_log")) / (F.col("_mad") * 1.4826)
    ).otherwise(F.when(value > F.col("_median"), F.lit(10.0)).otherwise(F.lit(0.0)))
    score = clamp(
        percentile * 0.45 + clamp(multiple / 10, 0, 1) * 35 + clamp(F.greatest(z, F.lit(0.0)) / 5, 0, 1) * 20
    )
    return {
        "first_ever_purchase": first,
        "purchase_multiple": F.when(~first, multiple),
        "largest_prior_multiple": F.when(~first, ratio(value, F.col("_largest"))),
        "historical_percentile": F.when(~first, percentile),
        "robust_z": z,
        "robust_z_display": F.greatest(F.lit(-10.0), F.least(F.lit(10.0), z)),
        "abnormality_score": F.when(first, F.lit(60.0)).otherwise(score),
        "abnormality_quality": F.when(first, F.lit("limited")).when(priors >= 3, F.lit("high")).otherwise(F.lit("acceptable")),
    }


def silence_columns(days: Column, median_gap: Column, first_ever: Column) -> dict[str, Column]:
    multiple = F.when(median_gap > 0, days / median_gap)
    score = F.least(
        F.lit(100.0),
        F.lit(25.0) + days / 365.0 * 12 + F.coalesce(F.greatest(multiple - 1, F.lit(0.0)) * 15, F.lit(0.0)),
    )
    return {
        "gap_multiple": F.when(~first_ever & days.isNotNull(), multiple),
        "silence_break_score": F.when(first_ever, F.lit(70.0)).when(days.isNull(), F.lit(0.0)).otherwise(score),
        "silence_quality": F.when(first_ever | days.isNull(), F.lit("limited"))
        .when(median_gap != 0, F.lit("high"))
        .otherwise(F.lit("acceptable")),
    }


def velocity_columns() -> dict[str, Column]:
    multiple = ratio(F.col("purchase_value_90d"), F.col("_median_90d"))
    return {
        "velocity_multiple": multiple,
        "velocity_score": F.least(F.lit(100.0), F.lit(40.0) + F.coalesce(multiple, F.lit(0.0)) * 15),
        "velocity_quality": F.when(F.col("sequence") >= 3, F.lit("high")).otherwise(F.lit("limited")),
    }


def acceleration_columns() -> dict[str, Column]:
    """Slope of log value over position (closed form on running sums) and change of the gap length."""
    n = (F.col("sequence") + 1).cast("double")
    mean_place = (n - 1) / 2
    slope = (F.col("_sum_placed_logs") - mean_place * F.col("_sum_logs")) / (n * (n * n - 1) / 12)
    first_gap = F.col("_first_gap").cast("double")
    frequency = (first_gap - F.col("_last_gap")) / F.greatest(first_gap, F.lit(1.0))
    enough = F.col("sequence") >= 2
    slope = F.when(enough, slope)
    frequency = F.when(enough, frequency)
    return {
        "value_acceleration": slope,
        "frequency_acceleration": frequency,
        "acceleration_score": F.when(enough, clamp(F.lit(50.0) + slope * 25 + frequency * 25)).otherwise(F.lit(0.0)),
        "acceleration_sample_count": F.col("sequence") + 1,
        "acceleration_quality": F.when(enough, F.lit("high")).otherwise(F.lit("limited")),
    }


def buyer_clusters(events: DataFrame, window_days: int = params.CLUSTER_DAYS) -> DataFrame:
    """Per issuer and day: who bought in the window ending that day, and in which roles.

    A person counts with the roles of their newest purchase in the window. That purchase day covers the days from
    itself until the person's next purchase day, at most to the end of the window; adding one where such a span
    begins and taking one away after it ends, a running sum gives the exact distinct counts. Nothing larger than
    one row per issuer, person and day is ever sorted, and no list of buyers is built.
    """
    person = ["issuer_cik", "insider_id"]
    days = events.groupBy(*person, "transaction_date").agg(
        F.max_by("normalized_roles", "event_id").alias("_roles"),
        F.sum(F.coalesce("purchase_value", F.lit(0.0))).alias("_value"),
    )
    roles = F.col("_roles")
    next_day = F.lead("transaction_date").over(Window.partitionBy(*person).orderBy("transaction_date"))
    marked = days.withColumns(
        {
            "_end": F.least(F.date_sub(next_day, 1), F.date_add("transaction_date", window_days)),
            "buyers": F.lit(1),
            "operating": is_operating(roles).cast("int"),
            "ceos": F.array_contains(roles, "ceo").cast("int"),
            "cfos": F.array_contains(roles, "cfo").cast("int"),
            "founders": F.array_contains(roles, "founder").cast("int"),
        }
    )
    flags = ["buyers", "operating", "ceos", "cfos", "founders"]
    begins = F.struct(F.col("transaction_date").alias("day"), *flags, "_value", F.lit(True).alias("_purchase"))
    ends = F.struct(F.date_add("_end", 1).alias("day"), *[(-F.col(c)).alias(c) for c in flags], F.lit(0.0).alias("_value"), F.lit(False).alias("_purchase"))
    # Both steps of a span are made from one reading of the days.
    steps = marked.select("issuer_cik", F.explode(F.array(begins, ends)).alias("_step")).select("issuer_cik", "_step.*").groupBy("issuer_cik", "day").agg(
        *[F.sum(c).alias(c) for c in flags], F.sum("_value").alias("_value"), F.max("_purchase").alias("_purchase")
    )
    line = Window.partitionBy("issuer_cik").orderBy(F.unix_date("day"))
    so_far = line.rangeBetween(Window.unboundedPreceding, 0)
    counted = steps.withColumns(
        {
            **{c: F.sum(c).over(so_far) for c in flags},
            "cluster_purchase_value": F.round(F.sum("_value").over(line.rangeBetween(-window_days, 0)), 2),
        }
    ).filter("_purchase")
    ceo, cfo, founder = F.col("ceos") > 0, F.col("cfos") > 0, F.col("founders") > 0
    score = F.least(
        F.lit(100.0),
        F.col("buyers") * 25.0 + ceo.cast("int") * 15.0 + cfo.cast("int") * 15.0 + founder.cast("int") * 15.0,
    )
    return counted.select(
        "issuer_cik",
        F.col("day").alias("transaction_date"),
        F.lit(window_days).alias("cluster_window_days"),
        F.col("buyers").cast("int").alias("unique_buyers"),
        F.col("operating").cast("int").alias("unique_operating_executives"),
        ceo.alias("ceo_present"),
        cfo.alias("cfo_present"),
        founder.alias("founder_present"),
        ((F.col("buyers") > 1) & (F.col("operating") == 0)).alias("director_only_cluster"),
        "cluster_purchase_value",
        score.alias("cluster_score"),
        F.when(F.col("buyers") > 1, F.lit("high")).otherwise(F.lit("acceptable")).alias("cluster_quality"),
    )


def drawdown_label(drawdown: Column, prior_21: Column) -> Column:
    return (
        F.when(drawdown.isNull(), F.lit("unknown"))
        .when(drawdown > -0.1, F.lit("near_highs"))
        .when(drawdown > -0.25, F.lit("moderate_pullback"))
        .when((drawdown <= -0.5) & (F.coalesce(prior_21, F.lit(0.0)) > 0), F.lit("early_recovery"))
        .when(drawdown <= -0.5, F.lit("post_capitulation"))
        .otherwise(F.lit("deep_drawdown"))
    )


def ownership_score(percent: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(percent, F.lit(0.0)) * 2)


def history_quality_score(depth: Column) -> Column:
    return (
        F.when(depth == "sparse", F.lit(45.0))
        .when(depth == "usable", F.lit(80.0))
        .when(depth == "deep", F.lit(100.0))
        .otherwise(F.lit(20.0))
    )


def behavior_columns() -> dict[str, Column]:
    """Weighted mean of the components that are present, with the parts kept visible."""
    zero = F.lit(0.0)
    weight = sum((F.when(F.col(c).isNotNull(), F.lit(params.BEHAVIOR_WEIGHTS[w])).otherwise(zero) for w, c in params.BEHAVIOR_COLUMNS.items()), zero)
    points = sum((F.coalesce(F.col(c) * params.BEHAVIOR_WEIGHTS[w], zero) for w, c in params.BEHAVIOR_COLUMNS.items()), zero)
    return {"behavior_change_score": round_to(points / F.when(weight > 0, weight).otherwise(F.lit(1.0)), 4), **behavior_parts()}


def behavior_parts() -> dict[str, Column]:
    """The components of the behaviour score as they stand in a signal."""
    named = list(params.BEHAVIOR_COLUMNS.values())
    return {
        "behavior_components": F.create_map(*[x for c in named for x in (F.lit(c), F.col(c))]),
        "behavior_missing": F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in named])),
    }


def flag_columns() -> Column:
    return F.array_compact(
        F.array(
            F.when(F.col("direct_indirect_code") == "I", F.lit("indirect_only")),
            F.when(~F.coalesce("discovery_eligible", F.lit(False)), F.lit("microcap_or_illiquid")),
            F.when(~F.coalesce("price_available", F.lit(False)), F.lit("missing_price")),
            F.when(F.col("history_depth").isin("no_history", "sparse"), F.lit("sparse_history")),
        )
    )


def conviction_parts() -> dict[str, Column]:
    value = F.greatest(F.coalesce("purchase_value", F.lit(0.0)), F.lit(1.0))
    return {
        "behavior_change": F.col("behavior_change_score"),
        "absolute_purchase_size": F.least(F.lit(100.0), F.log10(value) / 7 * 100),
        "ownership_increase": F.coalesce(ownership_score(F.col("ownership_increase_percent")), F.lit(0.0)),
        "cluster_confirmation": F.col("cluster_score"),
        "role_quality": F.col("role_score"),
        "direct_ownership": F.when(F.col("direct_indirect_code") == "D", F.lit(100.0)).otherwise(F.lit(35.0)),
        "company_context": F.when(F.col("discovery_eligible"), F.lit(100.0)).otherwise(F.lit(35.0)),
        "data_quality": F.when(F.col("event_quality") == "high", F.lit(100.0)).otherwise(F.lit(65.0)),
    }


def conviction_columns() -> dict[str, Column]:
    parts = conviction_parts()
    flags = F.col("reason_codes")
    penalties = penalty_map()
    raw = sum((parts[name] * weight for name, weight in params.CONVICTION_WEIGHTS.items()), F.lit(0.0))
    off = F.aggregate(flags, F.lit(0.0), lambda total, flag: total + F.coalesce(F.try_element_at(penalties, flag), F.lit(0.0)))
    return {"conviction_score": round_to(clamp(raw - off), 4), **conviction_maps()}


def penalty_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in params.PENALTIES.items() for x in pair])


def conviction_maps() -> dict[str, Column]:
    """The parts of the conviction score and what was taken off, as a signal's own columns tell them."""
    flags = F.col("reason_codes")
    return {
        "conviction_components": F.create_map(*[x for name, part in conviction_parts().items() for x in (F.lit(name), part)]),
        "conviction_penalties": F.map_filter(penalty_map(), lambda name, _: F.array_contains(flags, name)),
    }


#: Columns of a signal that its other columns tell.
TOLD = ["history_id", "behavior_components", "behavior_missing", "conviction_components", "conviction_penalties"]


def with_told(signals: DataFrame) -> DataFrame:
    """Signals with the columns ``TOLD``, which a stored signal need not hold twice."""
    return signals.withColumns({"history_id": history_id(), **behavior_parts(), **conviction_maps()})


def conviction_grade(score: Column) -> Column:
    return (
        F.when(score >= 90, F.lit("exceptional"))
        .when(score >= 80, F.lit("rare"))
        .when(score >= 65, F.lit("unusual"))
        .when(score >= 50, F.lit("notable"))
        .otherwise(F.lit("ordinary"))
    )


def score_histories(histories: DataFrame, companies: DataFrame, purchases: DataFrame | None = None) -> DataFrame:
    """All signals and scores of each purchase. ``companies`` brings eligibility and the display columns; ``purchases`` what
    ``histories`` do not hold of each purchase, by its id."""
    clusters = buyer_clusters(histories)
    context = companies.select("issuer_cik", "company_name", "sector", "industry", "market_cap", "discovery_eligible")
    day = ["issuer_cik", "transaction_date"]
    if purchases is None:
        scored = histories.join(clusters, day)
    else:
        # Only ids meet the clusters by day; the wide rows are all sent once, by id.
        found = histories.select("event_id", *day).join(clusters, day).drop(*day)
        held = [c for c in histories.columns if c != "event_id"]
        scored = histories.join(found, "event_id").join(purchases.drop(*held), "event_id")
    scored = scored.join(context, "issuer_cik", "left")
    scored = scored.withColumn("discovery_eligible", F.coalesce("discovery_eligible", F.lit(False)))
    scored = scored.withColumns(abnormality_columns())
    scored = scored.withColumns(
        {
            **silence_columns(F.col("days_since_previous_purchase"), F.col("median_prior_gap_days"), F.col("first_ever_purchase")),
            **velocity_columns(),
            **acceleration_columns(),
            "ownership_score": ownership_score(F.col("ownership_increase_percent")),
            "role_score": role_score(F.col("normalized_roles")),
            "history_quality_score": history_quality_score(F.col("history_depth")),
            "drawdown_label": drawdown_label(F.col("drawdown_52w"), F.col("return_prior_21d")),
            "reason_codes": flag_columns(),
        }
    )
    scored = scored.withColumns(behavior_columns()).withColumns(conviction_columns())
    hidden = [c for c in scored.columns if c.startswith("_")]
    return scored.withColumn("conviction_grade", conviction_grade(F.col("conviction_score"))).drop(*hidden)


def best_per_issuer(signals: DataFrame) -> DataFrame:
    """Company signal: the purchase with the highest conviction ever."""
    return last_per_key(signals, ["issuer_cik"], [F.col("conviction_score"), F.col("event_id")])
