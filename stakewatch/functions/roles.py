"""Roles from officer titles, and what a set of roles is worth."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from stakewatch import params
from stakewatch.functions.text import squeeze


def alias_pattern(aliases: list[str]) -> str:
    """Aliases as whole words; written without look-around so every engine reads it alike."""
    return r"(^|[^a-z0-9])(" + "|".join(re.escape(a) for a in aliases).replace("\\ ", " ").replace("\\-", "-") + r")([^a-z0-9]|$)"


def roles_from_title(
    title: Column,
    is_director: Column | None = None,
    is_ten_percent_owner: Column | None = None,
    is_officer: Column | None = None,
) -> Column:
    """Sorted distinct roles named by a title, plus those of the relationship flags."""
    text = squeeze(F.lower(F.coalesce(title, F.lit(""))))
    found = []
    for name, (aliases, roles) in params.ROLE_ALIASES.items():
        hit = text.rlike(alias_pattern(aliases))
        if name == "president":
            hit = hit & ~text.rlike(r"(^|[^a-z0-9])vice president([^a-z0-9]|$)")
        found.append(F.when(hit, F.array(*map(F.lit, roles))))
    found.append(F.when(text.contains("founder"), F.array(F.lit("founder"))))
    if is_director is not None:
        found.append(F.when(is_director, F.array(F.lit("director"))))
    if is_ten_percent_owner is not None:
        found.append(F.when(is_ten_percent_owner, F.array(F.lit("ten_percent_owner"))))
    roles = F.flatten(F.array_compact(F.array(*found)))
    if is_officer is not None:
        named = F.arrays_overlap(roles, F.array(*map(F.lit, params.OPERATING_ROLES)))
        roles = F.when(is_officer & ~named, F.concat(roles, F.array(F.lit("other_officer")))).otherwise(roles)
    return F.array_sort(F.array_distinct(roles))


def role_score(roles: Column) -> Column:
    """Weight of the best role; founder and chief executive in one person count as their own role."""
    weights = F.create_map(*[F.lit(x) for pair in params.ROLE_QUALITY.items() for x in pair])
    both = F.array_contains(roles, "founder") & F.array_contains(roles, "ceo")
    best = F.array_max(F.transform(roles, lambda role: F.coalesce(F.try_element_at(weights, role), F.lit(0.0))))
    return F.when(both, F.lit(params.ROLE_QUALITY["founder_ceo"])).otherwise(F.coalesce(best, F.lit(0.0)))


def role_label(roles: Column) -> Column:
    out = F.lit("Insider")
    for role, label in (
        ("director", "Director"),
        ("president", "President"),
        ("coo", "COO"),
        ("cfo", "CFO"),
        ("ceo", "CEO"),
        ("founder", "Founder"),
    ):
        out = F.when(F.array_contains(roles, role), F.lit(label)).otherwise(out)
    return out


def is_operating(roles: Column) -> Column:
    """Any role text holding an operating title, matched as a substring."""
    return F.array_join(roles, "|").rlike("operating_executive|ceo|cfo|founder")
