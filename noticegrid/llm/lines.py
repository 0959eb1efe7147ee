"""Boilerplate lines by their frequency on a site (operator 3), in DataFrame functions only.

Per host, the pages that contain a line are divided by the pages of the host; a line on more
than ``ratio`` of them, and on ``least`` pages at least, is boilerplate there and goes from every
page of the host. A page counts once for a line however often it repeats it. Lines are
compared whole, without outer white space; blank lines are never boilerplate.

With ``long`` a line of so many characters also goes if it is on so many pages and on more than so large
a share of them: a short line can be common by chance, but that ten pages happen to word five or
more words alike is not to be expected, so such a line was copied, by the site or as a quotation. A share
well below ``ratio`` would also take the lines that a family of near copies has in common, from all of
them, before the family is reduced to one.

A line of a host is over the ratio on at most 1/ratio of the host's text, so what a host's set
holds is below (mean page length) / (the lower ratio) bytes: the set joins the pages as one value, and
the pages are shuffled once, by host, with hot hosts split by the adaptive join.

Null text stays null and has no lines; a null host is a host of its own. Repeated rows count as
pages of their own, as in the query's SQL; without ``copies`` the pages of a host that have one text count
once, on both sides of the ratio, so a text does not become boilerplate by being copied. Other
columns are carried along unchanged; those named bp_all or bp_dropped are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO = 0.1
LEAST = 3
#: Characters, pages and ratio of a long line.
LONG = (32, 10, 0.05)
BLANK = " \t\r\f\v"


def _key(line) -> Column:
    return F.btrim(line, F.lit(BLANK))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, least: int = LEAST, copies: bool = True,
                long: tuple[int, int, float] | None = None) -> DataFrame:
    """One row per host that has any: bp_host and bp_lines, its boilerplate lines."""
    if not copies:
        pages = pages.select(host, text).distinct()
    lines = F.array_distinct(F.transform(F.split(F.col(text), "\n"), _key))
    # Empty texts and null texts are pages too: a page's own row keeps the total in the same grouping.
    every = pages.select(F.col(host).alias("bp_host"), F.explode(
        F.concat(F.array(F.lit(None).cast("string")), F.coalesce(lines, F.array().cast("array<string>")))).alias("line"))
    counts = every.filter(F.col("line").isNull() | (F.col("line") != "")).groupBy("bp_host", "line").agg(F.count(F.lit(1)).alias("pages"))
    totals = counts.filter(F.col("line").isNull()).select(F.col("bp_host").alias("t_host"), F.col("pages").alias("total"))
    rules = [(0, least, ratio)] if long is None else [(0, least, ratio), long]
    common = counts.filter(F.col("line").isNotNull() & (F.col("pages") >= min(n for _, n, _ in rules)))
    over = common.join(totals, F.col("bp_host").eqNullSafe(F.col("t_host"))).filter(reduce(or_, (
        (F.length("line") >= chars) & (F.col("pages") >= n) & (F.col("pages") > share * F.col("total")) for chars, n, share in rules)))
    return over.groupBy("bp_host").agg(F.collect_list("line").alias("bp_lines"))


def without_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST,
                        copies: bool = True, long: tuple[int, int, float] | None = None) -> DataFrame:
    """``pages`` with the text less its boilerplate lines, and bp_all and bp_dropped, its lines before and those gone."""
    found = boilerplate(pages, host, text, ratio, least, copies, long)
    # The page is one value meanwhile, so that none of its columns clashes with what is added.
    page = pages.select(F.struct(*pages.columns).alias("bp_page"))
    joined = page.join(found, F.col("bp_page")[host].eqNullSafe(F.col("bp_host")), "left")
    body = F.col("bp_page")[text]
    lines = F.split(body, "\n")
    staged = joined.withColumn("bp_known", F.coalesce(F.col("bp_lines"), F.array().cast("array<string>"))).withColumn(
        "bp_left", F.filter(lines, lambda x: ~F.array_contains(F.col("bp_known"), _key(x))))
    kept = F.when(F.size("bp_known") == 0, body).otherwise(F.array_join("bp_left", "\n"))
    return staged.select(
        *[(kept if c == text else F.col("bp_page")[c]).alias(c) for c in pages.columns if c not in ("bp_all", "bp_dropped")],
        F.when(body.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("bp_all"),
        F.when(body.isNull(), 0).otherwise(F.size(lines) - F.size("bp_left")).cast("long").alias("bp_dropped"),
    )
