"""Explainable 0-100 scores and the final ranking."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid import settings as S
from noticegrid.functions.dates import days_left
from noticegrid.functions.text import term_hits, text_or_empty


def keyword_columns(df: DataFrame, scoring: S.ScorePolicy, keywords=()) -> DataFrame:
    """Lexicon hits of title and whole text, and the keyword component."""
    lexicon = tuple(keywords) or scoring.ranking_terms
    if not lexicon:
        return df.withColumns({
            "keyword_hits": F.array().cast("array<string>"), "keyword_part": F.lit(0.0),
            "n_hits": F.lit(0), "n_title_hits": F.lit(0),
        })
    title = text_or_empty(F.col("title"))
    blob = F.concat_ws(" ", title, text_or_empty(F.col("description")))
    hits = df.withColumns({
        "_hits": term_hits(blob, lexicon),
        "n_title_hits": F.size(term_hits(title, lexicon)),
        "_penalties": F.size(term_hits(blob, scoring.penalty_terms)),
    })
    density = F.least(F.size("_hits") / F.lit(float(scoring.keyword_saturation)), F.lit(1.0))
    raw = F.lit(0.7) * density + F.lit(0.3) * F.least(F.col("n_title_hits") / F.lit(2.0), F.lit(1.0))
    part = F.when(F.col("_penalties") > 0, raw * 0.55).otherwise(raw)
    return hits.withColumns({
        "n_hits": F.size("_hits"),
        "keyword_part": F.greatest(F.lit(0.0), F.least(part, F.lit(1.0))),
        "keyword_hits": F.array_sort("_hits"),
    }).drop("_hits", "_penalties")


def value_part(value: Column, policy: S.FilterPolicy, scoring: S.ScorePolicy) -> Column:
    floor = policy.min_value or 100_000.0
    span = max(floor * 50 - floor, 1.0)
    climb = F.lit(0.35) + F.lit(0.65) * ((value - F.lit(floor)) / F.lit(span))
    return (
        F.when(value.isNull(), F.lit(scoring.unknown_value_fraction))
        .when(value <= floor, F.lit(0.35))
        .otherwise(F.least(climb, F.lit(1.0)))
    )


def runway_part(closing: Column, run_date: date) -> Column:
    """Time left to respond, not nearness of the deadline."""
    left = days_left(closing, run_date)
    return (
        F.when(left.isNull(), F.lit(0.5))
        .when(left < 0, F.lit(0.0))
        .when(left <= 5, F.lit(0.15))
        .when(left <= 12, F.lit(0.5))
        .when(left <= 30, F.lit(1.0))
        .when(left <= 75, F.lit(0.85))
        .otherwise(F.lit(0.6))
    )


def score(df: DataFrame, policy: S.FilterPolicy, scoring: S.ScorePolicy, run_date: date) -> DataFrame:
    """Add ``score``, the rounded ``components`` and the kept ``keyword_hits``."""
    weights = scoring.active_weights(policy)
    scored = keyword_columns(df, scoring, policy.keywords)
    in_sector = F.coalesce(F.col("sector").isin(list(policy.sectors)), F.lit(False))
    parts = {
        "keyword": F.col("keyword_part"),
        "sector": in_sector.cast("double") if policy.sectors else F.lit(0.0),
        "value": value_part(F.col("estimated_value_usd"), policy, scoring),
        "urgency": runway_part(F.col("closing_date"), run_date),
    }
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(weight) * parts[name]
    if policy.eligibility_mode == "flag":
        limited = text_or_empty(F.col("eligibility")) != ""
        total = total - F.when(limited, F.lit(scoring.restricted_penalty)).otherwise(F.lit(0.0))
    components = F.create_map(*[
        x for name in weights for x in (F.lit(name), F.round(parts[name], 3))
    ])
    return scored.withColumns({
        "score": F.round(F.greatest(F.lit(0.0), F.least(total, F.lit(100.0))), 1),
        "components": components,
    }).drop("keyword_part", "n_hits", "n_title_hits")


def rank_order() -> list[Column]:
    """Best score first, then the nearest deadline, unknown deadlines last."""
    return [F.desc("score"), F.asc_nulls_last("closing_date"), F.asc("id")]


def ranked(df: DataFrame) -> DataFrame:
    return df.orderBy(*rank_order())


def band(c: Column) -> Column:
    return F.when(c >= 70, "high").when(c >= 40, "mid").otherwise("low")
