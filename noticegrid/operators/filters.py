"""Filters that name what they drop.

One projection gives every notice a ``drop_reason`` (NULL for survivors) and its ordered
``flags``; survivors and counts are both read from that column. A missing field never
drops a notice by accident: each test says what unknown means.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid import settings as S
from noticegrid.functions.text import term_hits, text_or_empty


def _implausible(value: Column, policy: S.FilterPolicy) -> Column:
    return value.isNotNull() & ~value.between(policy.plausible_min, policy.plausible_max)


def repair_value(df: DataFrame, policy: S.FilterPolicy) -> DataFrame:
    """Blank values that cannot be true and keep a note of the original."""
    before, after = S.FLAG_IMPLAUSIBLE.split("{value}")
    value = F.col("estimated_value_usd")
    odd = _implausible(value, policy)
    note = F.concat(F.lit(before), F.lit("USD "), F.format_number(value, 0), F.lit(after))
    return df.withColumns({
        "value_note": F.when(odd, note),
        "estimated_value_usd": F.when(~odd, value),
    })


def older_than(posted: Column, days: int, run_date: date) -> Column:
    return F.coalesce(F.datediff(F.lit(run_date), posted) > days, F.lit(False))


def drop_tests(policy: S.FilterPolicy, run_date: date) -> list[tuple[Column, str]]:
    """The tests that remove a notice, in order, each with its reason."""
    closing, posted = F.col("closing_date"), F.col("posted_date")
    value = F.col("estimated_value_usd")
    tests: list[tuple[Column, str]] = []

    closed = F.lit(False)
    if policy.exclude_closed:
        closed = F.coalesce(closing < F.lit(run_date), F.lit(False))
    if not policy.keep_unknown_deadline:
        closed = closed | closing.isNull()
    tests.append((closed, "closed"))

    low = F.lit(False)
    if policy.min_value is not None:
        low = F.coalesce(value < policy.min_value, F.lit(False))
    if not policy.keep_unknown_value:
        low = low | value.isNull()
    tests.append((low, "below minimum value"))

    if policy.undated_days is not None:
        stale = closing.isNull() & older_than(posted, policy.undated_days, run_date)
        tests.append((stale, f"undated and published over {policy.undated_days} days ago"))
    if policy.lookback_days is not None:
        tests.append((older_than(posted, policy.lookback_days, run_date), "outside lookback window"))
    if policy.sectors:
        outside = ~F.coalesce(F.col("sector").isin(list(policy.sectors)), F.lit(False))
        tests.append((outside, "sector not targeted"))
    if policy.keywords:
        blob = F.concat_ws(" ", text_or_empty(F.col("title")), text_or_empty(F.col("description")))
        tests.append((F.size(term_hits(blob, policy.keywords)) == 0, "no keyword match"))
    if policy.notice_types:
        given = F.lower(text_or_empty(F.col("notice_type")))
        wanted = F.array(*[F.lit(t.lower()) for t in policy.notice_types])
        tests.append((~F.exists(wanted, lambda t: given.contains(t)), "notice type not targeted"))
    if policy.language_mode == "english_only":
        tests.append((F.coalesce(F.col("language") == "ar", F.lit(False)), "language excluded"))
    if policy.eligibility_mode == "exclude":
        tests.append((text_or_empty(F.col("eligibility")) != "", "eligibility restricted"))
    return tests


def drop_reason(policy: S.FilterPolicy, run_date: date) -> Column:
    """The first failing test in order, or NULL."""
    tests = drop_tests(policy, run_date)
    reason = F.when(tests[0][0], tests[0][1])
    for failed, name in tests[1:]:
        reason = reason.when(failed, name)
    return reason


def flags(policy: S.FilterPolicy) -> Column:
    """Ordered remarks a surviving notice carries."""
    return F.array_compact(F.array(
        F.col("value_note"),
        F.when(F.col("closing_date").isNull(), S.FLAG_NO_DEADLINE),
        F.when(F.col("estimated_value_usd").isNull() & F.col("value_note").isNull(), S.FLAG_NO_VALUE),
        F.when(F.col("language") == "ar", S.FLAG_ARABIC),
        F.when(F.col("eligibility") != "", F.col("eligibility")),
    ))


def judge(df: DataFrame, policy: S.FilterPolicy, run_date: date) -> DataFrame:
    """Every notice with its repaired value, ``flags`` and ``drop_reason``."""
    repaired = repair_value(df, policy)
    remarks = flags(policy)
    if "flags" in df.columns:
        remarks = F.concat(F.coalesce(F.col("flags"), F.array().cast("array<string>")), remarks)
    return repaired.withColumns({
        "flags": remarks,
        "drop_reason": drop_reason(policy, run_date),
    }).drop("value_note")


def survivors(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("drop_reason").isNull()).drop("drop_reason")


def reason_counts(judged: DataFrame) -> DataFrame:
    """How many notices each reason removed; the kept ones are listed as ``kept``."""
    return judged.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(
        F.count("*").alias("n")
    )
