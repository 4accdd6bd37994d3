"""Dates out of report cells and of ISO texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of(text: Column) -> Column:
    """The first ten characters of an ISO date or time."""
    return F.substring(text, 1, 10)


def first_date(cell: Column, formats: list[str]) -> Column:
    """The cell read by the first format that fits, as a date; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(cell), F.lit(f)).cast("date") for f in formats])


def first_time(date: Column, time: Column, time_formats: list[str], date_formats: list[str]) -> Column:
    """Date and time cells together by the first format that fits, else the date alone."""
    both = F.trim(F.concat_ws(" ", date, time))
    return F.coalesce(*[F.try_to_timestamp(both, F.lit(f)) for f in time_formats], *[F.try_to_timestamp(F.trim(date), F.lit(f)) for f in date_formats])


def assembled(year: Column, month: Column, day: Column, end: bool = False) -> Column:
    """A date of year, month and day. Missing parts: the first month and day, or for an end the last."""
    first = F.make_date(year, F.coalesce(month, F.lit(12 if end else 1)), F.coalesce(day, F.lit(1)))
    return F.when(month.isNull() | day.isNull(), F.last_day(first)).otherwise(first) if end else first


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def year_windows(start: Column) -> Column:
    """The year of a date, with the year before for January and the year after for December."""
    year = F.year(start)
    return F.when(F.month(start) == 1, F.array(year, year - 1)).when(F.month(start) == 12, F.array(year, year + 1)).otherwise(F.array(year))


# The months by name; a shorter form is any beginning of at least three letters.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_DAY, _YEAR, _WORD = r"(?<![\dA-Za-z])(\d{1,2})(?:st|nd|rd|th)?(?![\dA-Za-z])", r"(?<!\d)(\d{4})(?!\d)", r"([A-Za-z]{3,})"


def month_number(word: Column) -> Column:
    """1 to 12 for the name of a month or a beginning of it; else null."""
    low = F.lower(word)
    return F.coalesce(*[F.when((F.length(low) >= 3) & F.startswith(F.lit(name), low), F.lit(i + 1)) for i, name in enumerate(MONTHS)])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _tokens(text: Column) -> Column:
    """Struct of the day, month and year that one side of a range names, each null if it is not there, and whether there is nothing else."""
    one = lambda t, pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))

    def made(t: Column) -> Column:
        single = (F.regexp_count(t, F.lit(_DAY)) <= 1) & (F.regexp_count(t, F.lit(_YEAR)) <= 1) & (F.regexp_count(t, F.lit(_WORD)) <= 1)
        nothing_else = (F.regexp_replace(t, rf"{_DAY}|{_YEAR}|{_WORD}|[\s,.]", "") == "") & single
        parts = F.struct(one(t, _DAY).cast("int").alias("day"), one(t, _WORD).alias("word"), month_number(one(t, _WORD)).alias("month"), one(t, _YEAR).cast("int").alias("year"), nothing_else.alias("clean"))
        return _let(parts, lambda p: F.struct(p["day"].alias("day"), p["month"].alias("month"), p["year"].alias("year"), (p["clean"] & (p["word"].isNull() | p["month"].isNotNull())).alias("clean")))

    return _let(text, made)


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date, null if there is no such day."""
    return F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-M-d")).cast("date")


def date_range(cell: Column) -> Column:
    """Struct of start and end (ISO texts) of a free-text range of days, months or years; nulls where nothing fits.

    A grammar of tokens: either side of the dash names a day, a month and a year, or some of them; the left side takes
    what it lacks from the right one, and the right side its month from the left one. Without days a range runs from the
    first to the last day of its months, without months of its years. Clock times and abbreviations of two to four
    capitals that are no months, such as zones, are passed over.
    """
    short = "|".join(name[:3].upper() for name in MONTHS) + "|JUNE|JULY|SEPT"
    bare = F.trim(F.regexp_replace(F.trim(cell), rf"\b(?!(?:{short})\b)[A-Z]{{2,4}}\b|\b\d{{1,2}}:\d{{2}}(?::\d{{2}})?\s*(?:AM|PM|am|pm)?\b", ""))

    def parted(text: Column) -> Column:
        sides = F.split(text, r"\s*[-–—]\s*")
        return _let(F.struct(sides.alias("sides"), _tokens(sides[0]).alias("left"), F.coalesce(F.try_element_at(sides, F.lit(2)), F.lit("")).alias("whole")), lambda p: sided(text, p))

    def sided(text: Column, p: Column) -> Column:
        # What follows the year of a range of months says nothing of its dates.
        some = F.coalesce(F.nullif(F.regexp_extract(p["whole"], r"(?s)^(\D*\d{4})(?!\d)", 1), F.lit("")), p["whole"])
        return _let(_tokens(F.when(p["left"]["day"].isNull(), some).otherwise(p["whole"])), lambda right: assembled_range(text, F.size(p["sides"]), p["left"], right))

    def assembled_range(text: Column, sides: Column, left: Column, right: Column) -> Column:
        year, month, until = F.coalesce(left["year"], right["year"]), F.coalesce(left["month"], right["month"]), F.coalesce(right["month"], left["month"])
        days = left["day"].isNotNull() & right["day"].isNotNull() & month.isNotNull()
        months = left["day"].isNull() & right["day"].isNull() & (left["month"].isNull() == right["month"].isNull())
        ranged = (sides == 2) & left["clean"] & right["clean"] & right["year"].isNotNull() & (days | months)
        first = _date(year, F.coalesce(month, F.lit(1)), F.coalesce(left["day"], F.lit(1))).cast("string")
        last = F.when(days, _date(right["year"], until, right["day"])).otherwise(F.last_day(_date(right["year"], F.coalesce(until, F.lit(12)), F.lit(1)))).cast("string")
        alone = (sides == 1) & left["clean"] & left["year"].isNotNull()
        day = alone & left["day"].isNotNull() & left["month"].isNotNull()
        only_year = alone & left["day"].isNull() & left["month"].isNull()
        iso = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})$", 1)
        span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
        written = first_date(text, ["M/d/yyyy", "d/M/yyyy"]).cast("string")
        return (
            F.when(iso != "", span(iso, iso)).when(ranged, span(first, last)).when(day, span(first, first))
            .when(only_year, span(F.concat(left["year"].cast("string"), F.lit("-01-01")), F.concat(left["year"].cast("string"), F.lit("-12-31")))).otherwise(span(written, written))
        )

    return _let(bare, parted)


_NAMES = "|".join([*(m.capitalize() for m in MONTHS), *(m[:3].capitalize() for m in MONTHS)])
_MENTIONS = rf"(?i)\b(\d{{1,2}}\s+(?:{_NAMES})\s+\d{{4}}|(?:{_NAMES})\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{4}})\b"


#: Stands for a mention while a sentence is cut at them; cutting at one character needs no regular expression a row.
_MARK = "\x01"


def mention_date(said: Column) -> Column:
    """The date of one mention; days come first in figures, unless they cannot."""
    figures = F.regexp_replace(said, "-", "/")
    in_figures = F.coalesce(F.try_to_timestamp(figures, F.lit("d/M/yyyy")).cast("date"), F.try_to_timestamp(figures, F.lit("M/d/yyyy")).cast("date"))
    return F.coalesce(_let(_tokens(said), lambda w: F.when(w["month"].isNotNull(), _date(w["year"], w["month"], w["day"]))), in_figures)


def mentioned_dates(text: Column) -> Column:
    """Every date that a text mentions, in its order, repeats included."""
    return F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(_MENTIONS), 1), mention_date))


def narrative_range(text: Column) -> Column:
    """Struct of the first and last date that a report tells of: a range in brackets if it gives one, else what it mentions.

    A text without any other date counts from the day that it is ``as of``.
    """
    bracket = rf"(?i)\((\d{{1,2}}\s+(?:{_NAMES})\s+\d{{4}})\s*-\s*(\d{{1,2}}\s+(?:{_NAMES})\s+\d{{4}})\)"
    as_of = rf"(?i)as\s+of\s*[(\[]?\s*(?:{_MENTIONS[4:]})"
    ends = F.struct(*[mention_date(F.regexp_extract(text, bracket, i)).alias(n) for i, n in ((1, "a"), (2, "b"))], mentioned_dates(F.regexp_replace(text, as_of, " ")).alias("found"), mention_date(F.regexp_extract(text, as_of, 1)).alias("of"))

    def chosen(e: Column) -> Column:
        whole = e["a"].isNotNull() & e["b"].isNotNull()
        return F.struct(F.when(whole, e["a"]).otherwise(F.coalesce(F.array_min(e["found"]), e["of"])).alias("start"), F.when(whole, e["b"]).otherwise(F.coalesce(F.array_max(e["found"]), e["of"])).alias("end"))

    return _let(ends, chosen)


def nearest_date(text: Column, term: str) -> Column:
    """The date that stands nearest to the first mention of a term within its sentence; null without one."""
    low = term.lower()
    sentence = F.try_element_at(F.filter(F.split(text, r"[.;\n]"), lambda s: F.contains(F.lower(s), F.lit(low))), F.lit(1))

    def distances(found: Column) -> Column:
        # A mention starts where the stretches and mentions before it end.
        before = lambda i: F.length(F.array_join(F.slice(found["gaps"], 1, i), "")) + F.length(F.array_join(F.slice(found["said"], 1, i - 1), ""))
        one = lambda i: F.struct(before(i).alias("at"), F.element_at(found["said"], i).alias("said"))
        far = lambda m: F.greatest(found["place"] - 1 - m["at"] - F.length(m["said"]), m["at"] - found["place"] + 1, F.lit(0))
        listed = F.transform(F.when(F.size(found["said"]) > 0, F.sequence(F.lit(1), F.size(found["said"]))).otherwise(F.array().cast("array<int>")), one)
        near = F.transform(listed, lambda m: F.struct(far(m).alias("far"), mention_date(m["said"]).alias("day")))
        return F.array_min(F.filter(near, lambda d: d["day"].isNotNull()))["day"]

    parts = lambda s: F.struct(F.split(F.regexp_replace(s, _MENTIONS, _MARK), _MARK).alias("gaps"), F.regexp_extract_all(s, F.lit(_MENTIONS), 1).alias("said"), F.locate(low, F.lower(s)).alias("place"))
    return _let(sentence, lambda s: _let(parts(s), distances))


def dated_lines(df, text: str, keys: list[str], order: str):
    """Rows with context_date: the last date that the rows up to this one (by ``order`` within ``keys``) have mentioned."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("context_date", F.last(F.try_element_at(mentioned_dates(F.col(text)), F.lit(-1)), ignorenulls=True).over(w))
