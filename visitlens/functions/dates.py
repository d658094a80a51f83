"""Date Column expressions: flexible parsing, Spanish month names, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.constants import MONTH_NAMES_EN, MONTH_NAMES_ES, WEEKDAY_NAMES_EN, WEEKDAY_NAMES_ES, WHITESPACE_CLASS
from visitlens.functions.text import _c, strip

# The spellings that make up most cells, each tried only on strings of its
# digit shape, so other rows never reach the parser's failure path.
DATE_PATTERNS = {
    "yyyy-M-d": r"\d{4}-\d{1,2}-\d{1,2}",
    "d-M-yyyy": r"\d{1,2}-\d{1,2}-\d{4}",
    "d/M/yyyy": r"\d{1,2}/\d{1,2}/\d{4}",
}

# Everything else is read by a small grammar.  A time of day and its zone are cut out
# (a DATE does not keep them), the rest is taken apart into numbers and words; weekday
# names, ordinal endings and "de", "del", "of", "the" say nothing; a word that is no
# month makes it no date.  What is left is matched by kind: n (one or two digits), y
# (four) and m (month name).  Numeric dates are read day first and, where that is no
# date, month first; year-first dates as year-month-day (a deliberate choice: a free
# day-first parse would read 2026/3/4 as year-day-month); two-digit years from 69 on lie
# in the last century; a missing day is the first.
#: Kinds -> places of year, month and day, tried in turn.
DATE_RULES = {
    "nny": [(2, 1, 0), (2, 0, 1)], "nnn": [(2, 1, 0), (2, 0, 1)], "ynn": [(0, 1, 2)], "yn": [(0, 1, None)],
    "nmy": [(2, 1, 0)], "nmn": [(2, 1, 0)], "mny": [(2, 0, 1)], "mnn": [(2, 0, 1)], "ymn": [(0, 1, 2)],
    "my": [(1, 0, None)], "ym": [(0, 1, None)], "mn": [(1, 0, None)],
}
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:\s?[ap]\.?\s?m\b\.?)?(?:\s?(?:z|utc|gmt)\b|\s?[+-]\d{2}:?\d{2})?"
_TIME = rf"(?:^|(?<=\d)t|[ ,]\s*){_CLOCK}(?=$|[ ,])"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:[t ]?\d{4}(?:\d{2})?z?)?$"
_BETWEEN = r"(?<=\d)(?=[a-z])|(?<=[a-z])(?=\d)"
_SILENT = ["de", "del", "of", "the", "st", "nd", "rd", "th"]


def _whole(body: str) -> str:
    return f"^{WHITESPACE_CLASS}*{body}{WHITESPACE_CLASS}*$"


def _with_short(names: list[str]) -> dict[str, int]:
    """Names in plain lower case and their first three letters -> number."""
    plain = [n.lower().translate(str.maketrans("áéíóú", "aeiou")) for n in names]
    return {k: i for i, n in enumerate(plain, start=1) for k in (n, n[:3])}


def _date(year: Column, month: Column, day: Column) -> Column:
    year = F.when(F.length(year) == 2, F.concat(F.when(year < "69", F.lit("20")).otherwise(F.lit("19")), year)).otherwise(year)
    return F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-M-d"))


def _bind(value: Column, body) -> Column:
    """``body`` of a value that stands in the plan once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _by_grammar(raw: Column) -> Column:
    months = _with_short(MONTH_NAMES_ES) | _with_short(MONTH_NAMES_EN) | {"sept": 9, "set": 9}
    weekdays = [w for w in [*_with_short(WEEKDAY_NAMES_ES), *_with_short(WEEKDAY_NAMES_EN)] if w not in months]
    numbers = F.create_map(*[F.lit(str(x)) for kv in months.items() for x in kv])

    def of_text(text: Column) -> Column:
        plain = F.trim(F.regexp_replace(text, _TIME, " "))
        parts = F.split(F.regexp_replace(F.regexp_replace(plain, _BETWEEN, " "), r"[ ./,\-]+", " "), " ")
        parts = F.filter(parts, lambda p: (p != "") & ~p.isin(_SILENT))
        return F.when(text.rlike(_COMPACT), _date(*[F.regexp_extract(text, _COMPACT, i) for i in (1, 2, 3)])).otherwise(_bind(parts, of_words))

    def of_words(parts: Column) -> Column:
        # one weekday at most
        days = F.size(F.filter(parts, lambda p: p.isin(weekdays)))
        return F.when(days <= 1, _bind(F.filter(parts, lambda p: ~p.isin(weekdays)), of_parts))

    def of_parts(parts: Column) -> Column:
        # "mar" is a month, but a weekday before a whole date
        both = [w for w in _with_short(WEEKDAY_NAMES_ES) if w in months]
        return _bind(F.when((F.size(parts) == 4) & F.get(parts, F.lit(0)).isin(both), F.slice(parts, 2, 3)).otherwise(parts), of_kinds)

    def of_kinds(parts: Column) -> Column:
        kinds = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d{1,2}$"), F.lit("n")).when(p.rlike(r"^\d{4}$"), F.lit("y"))
                                         .when(F.map_contains_key(numbers, p), F.lit("m")).otherwise(F.lit("x"))), "")
        read = F.transform(parts, lambda p: F.coalesce(F.try_element_at(numbers, p), p))
        return _bind(F.struct(kinds.alias("kinds"), read.alias("parts")), of_rules)

    def of_rules(read: Column) -> Column:
        def at(place: int | None) -> Column:
            return F.lit("1") if place is None else F.get(read["parts"], F.lit(place))

        found = F.lit(None).cast("timestamp")
        for kind, rules in DATE_RULES.items():
            found = F.when(read["kinds"] == kind, F.coalesce(*[_date(at(y), at(m), at(d)) for y, m, d in rules])).otherwise(found)
        return found

    return _bind(F.trim(F.translate(F.lower(strip(raw)), "áéíóú", "aeiou")), of_text)


def parse_date_flexible(c) -> Column:
    """Mixed-format text -> DATE; blank or unparseable -> NULL (how many:
    ``parse_date_report``)."""
    raw = _c(c)
    tries = [F.when(raw.rlike(_whole(shape)), F.try_to_timestamp(strip(raw), F.lit(p))) for p, shape in DATE_PATTERNS.items()]
    # one element transformed: the long expression is evaluated only where the
    # tries fail and stays out of the generated code of the common ones
    # (only where there is a digit: a date has one)
    rest = F.when(raw.rlike(r"\d"), F.element_at(F.transform(F.array(raw), _by_grammar), 1))
    return F.coalesce(*tries, rest).cast("date")


def parse_date_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: per column, the non-blank cells that are no date (``<col>``)."""
    return df.agg(*[F.count_if((strip(F.col(f"`{c}`")) != "") & parse_date_flexible(F.col(f"`{c}`")).isNull()).alias(c) for c in cols])


def date_shapes(df: DataFrame, cols: list[str]) -> DataFrame:
    """How a table spells its dates: (column, shape, cells, parsed) of the non-blank
    cells, digits as 9 and words as a."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), strip(F.col(f"`{c}`").cast("string")).alias("cell")) for c in cols])
    rows = df.select(F.explode(cells).alias("c")).select("c.*").filter(F.col("cell") != "")
    shape = F.regexp_replace(F.regexp_replace("cell", r"\d", "9"), r"\p{L}+", "a")
    return (rows.groupBy("column", shape.alias("shape"))
            .agg(F.count(F.lit(1)).alias("cells"), F.count(parse_date_flexible("cell")).alias("parsed")))


def _month_map() -> Column:
    kv = []
    for i, name in enumerate(MONTH_NAMES_ES, start=1):
        kv += [F.lit(i), F.lit(name)]
    return F.create_map(*kv)


def _month_number_map() -> Column:
    kv = []
    for i, name in enumerate(MONTH_NAMES_ES, start=1):
        kv += [F.lit(name), F.lit(i)]
    return F.create_map(*kv)


def month_name_es(month) -> Column:
    """C4: month number -> Spanish name (NULL when no month)."""
    return F.try_element_at(_month_map(), _c(month).cast("int"))


def month_number_es(name) -> Column:
    """Spanish month name -> number (NULL for unknown names)."""
    return F.try_element_at(_month_number_map(), _c(name))


def format_date(c, pattern: str = "dd-MM-yyyy", null_as: str | None = None) -> Column:
    """DATE -> text; NULL stays NULL or becomes ``null_as``."""
    out = F.date_format(_c(c), pattern)
    return F.coalesce(out, F.lit(null_as)) if null_as is not None else out
