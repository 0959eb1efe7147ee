"""Multilingual date reading as column expressions.

Every result is a real calendar date within a plausible distance of ``run_date``; text
without a complete date gives NULL.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticegrid import settings as S
from noticegrid.functions.text import WORD, ascii_digits, clean, let, literal_map, literal_rows, quoted

_ISO = rf"(?<!{WORD})(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?!\d)"
_DOTTED = rf"(?<!{WORD})(\d{{1,2}})\.\s*(\d{{1,2}})\.\s*(\d{{4}})(?!{WORD})"
_SLASHED = rf"(?<!{WORD})(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?!{WORD})"
#: A word, a number of up to four digits that is no part of anything else, or any other sign that is no separator.
_TOKEN = rf"(?<![{WORD[1:-1]}:+])\d{{1,4}}(?:st|nd|rd|th)?(?![{WORD[1:-1]}:])|\p{{L}}+|[^\s.,/'’-]"
#: Which components may follow each other: d one or two digits, Y four, m a month's name.
_PATHS = ("d", "m", "Y", "dm", "md", "dd", "Ym", "Yd", "dmY", "dmd", "mdY", "mdd", "Ymd", "Ydd", "ddY", "ddd")
#: Words between two components that are no break.
_FILLERS = ("of", "the", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
            "mon", "tue", "tues", "wed", "thu", "thur", "thurs", "fri", "sat", "sun")


def _month_literals() -> Column:
    ordered = sorted(S.MONTH_NAMES, key=len, reverse=True)
    return literal_rows([{"name": name, "month": S.MONTH_NAMES[name]} for name in ordered])


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """A date from its parts; NULL when a part is missing or the date does not exist."""
    complete = (F.length(year) > 0) & (F.length(month) > 0) & (F.length(day) > 0)
    return F.when(complete, F.concat_ws("-", year, month, day).try_cast("date"))


def plausible(value: Column, run_date: date) -> Column:
    return let(value, lambda d: F.when(F.abs(F.year(d) - F.lit(run_date.year)) <= S.PLAUSIBLE_YEARS, d))


def _parts(text: Column, pattern: str, year: int, month: int, day: int) -> Column:
    ordered = F.regexp_replace(text, rf"(?s)^.*?{pattern}.*$", f"${year}-${month}-${day}")
    return F.when(text.rlike(pattern), ordered.try_cast("date"))


def _day_first(text: Column, pattern: str) -> Column:
    return F.coalesce(_parts(text, pattern, 3, 2, 1), _parts(text, pattern, 3, 1, 2))


def _named_month(text: Column, run_date: date) -> Column:
    """The first (longest-named) month with a day on either side and a year after it."""
    lowered = F.lower(text)

    def read(t: Column) -> Column:
        low = t["low"]
        present = F.filter(_month_literals(), lambda m: low.contains(m["name"]))

        def as_date(m: Column) -> Column:
            at = F.instr(low, m["name"])
            before = F.substring(t["raw"], F.greatest(at - 12, F.lit(1)), F.least(at - 1, F.lit(12)))
            after = F.substring(t["raw"], at + F.length(m["name"]), F.lit(12))
            day_before = F.regexp_extract(before, r"(\d{1,2})\s*[.\-/]?\s*$", 1)
            year_after = F.regexp_extract(after, r"(\d{4})", 1)
            lead = rf"^\s*(\d{{1,2}})(?!{WORD})"
            day_after = F.regexp_extract(after, lead, 1)
            late_year = F.regexp_extract(F.regexp_replace(after, lead, ""), r"(\d{4})", 1)
            on_left = day_before != ""
            month = m["month"].cast("string")
            return plausible(
                F.when(on_left, calendar_date(year_after, month, day_before))
                .otherwise(calendar_date(late_year, month, day_after)),
                run_date,
            )

        return F.filter(F.transform(present, as_date), lambda d: d.isNotNull())

    # Every name has a letter, and most dates have none.
    found = F.when(text.rlike(r"\p{L}"), let(F.struct(text.alias("raw"), lowered.alias("low")), read))
    return F.get(found, F.lit(0))


def _free_form(text: Column, run_date: date) -> Column:
    """The first three components that stand together and make a date, whatever their order.

    Tokens are typed and folded: a filler is passed over, any other word starts anew, a component goes on where
    ``_PATHS`` has a way. So "Mon 5 Jan 27", "12 07 2026" and "2nd of June, 2026" are dates (after a year the month
    comes first, else the day if it can), and a text that lacks a day, a month or a year is none.
    """
    months, paths = literal_map(S.ENGLISH_MONTHS), quoted(list(_PATHS))
    tokens = F.regexp_extract_all(F.lower(text), F.lit(f"({_TOKEN})"))
    start = F.struct(F.lit("").alias("path"), F.array().cast("array<int>").alias("parts"))

    def step(state: Column, token: Column) -> Column:
        digits = F.regexp_extract(token, r"^\d+", 0)
        month = F.try_element_at(months, token)
        kind = F.when(month.isNotNull(), "m").when(F.length(digits) == 4, "Y").when(F.length(digits).between(1, 2), "d")
        value = F.coalesce(month, digits.try_cast("int"))
        longer = F.concat(state["path"], kind)
        after = F.when(F.array_contains(F.expr(paths), longer), F.struct(longer.alias("path"), F.concat(state["parts"], F.array(value)).alias("parts"))).otherwise(
            F.struct(kind.alias("path"), F.array(value).alias("parts")))
        kept = (F.length(state["path"]) == 3) | token.isin(*_FILLERS)
        return F.when(kept, state).when(kind.isNull(), start).otherwise(after)

    def resolve(state: Column) -> Column:
        path = state["path"]
        x, y, z = (F.get(state["parts"], F.lit(i)) for i in range(3))
        when = lambda year, month, day: F.concat_ws("-", F.lpad(full_year(year).cast("string"), 4, "0"), month.cast("string"), day.cast("string"))
        year_first = when(x, y, z)
        day_first = F.when((x > 12) | (y <= 12), when(z, y, x)).otherwise(when(z, x, y))
        read = (
            F.when(path.isin("dmY", "dmd"), F.when(x > 31, when(x, y, z)).otherwise(when(z, y, x)))
            .when(path.isin("mdY", "mdd"), F.when(y > 31, when(y, x, z)).otherwise(when(z, x, y)))
            .when(path == "Ymd", when(x, y, z)).when(path == "Ydd", year_first)
            .when(path == "ddY", day_first).when(path == "ddd", F.when(x > 31, year_first).otherwise(day_first))
        )
        return read.try_cast("date")

    def full_year(year: Column) -> Column:
        near = year + run_date.year // 100 * 100
        turned = F.when(near >= run_date.year + 50, near - 100).when(near < run_date.year - 50, near + 100).otherwise(near)
        return F.when(year < 100, turned).otherwise(year)

    return let(F.aggregate(tokens, start, step), resolve)


def read_date(c: Column, run_date: date) -> Column:
    """As :func:`parse_date` for text that is already clean; usable inside lambdas."""
    def read(text: Column) -> Column:
        value = F.coalesce(
            plausible(_parts(text, _ISO, 1, 2, 3), run_date),
            _named_month(text, run_date),
            plausible(_parts(text, _DOTTED, 3, 2, 1), run_date),
            plausible(_day_first(text, _SLASHED), run_date),
            plausible(_free_form(text, run_date), run_date),
        )
        return F.when(text.rlike(r"\d"), value)

    return let(ascii_digits(c), read)


def parse_date(c: Column, run_date: date) -> Column:
    """The calendar date a text carries, or NULL."""
    return read_date(clean(ascii_digits(c)), run_date)


def days_left(closing: Column, run_date: date) -> Column:
    return F.datediff(closing, F.lit(run_date))


def is_open(closing: Column, run_date: date) -> Column:
    """A notice closing on the run date is open; an unknown deadline is open."""
    return F.coalesce(closing >= F.lit(run_date), F.lit(True))


def display(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "yyyy-MM-dd"), F.lit(S.NOT_PUBLISHED))
