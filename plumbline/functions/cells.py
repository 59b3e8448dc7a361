"""Column expressions on single cells: null tests, parse tests, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.defaults import SENTINELS

_FLOATS = (T.FloatType, T.DoubleType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def is_numeric_type(kind: T.DataType) -> bool:
    """Numeric for profiling and consistency: numbers and booleans."""
    return isinstance(kind, (T.NumericType, T.BooleanType))


def is_feature_type(kind: T.DataType) -> bool:
    """Usable by the anomaly models: numbers, but not booleans."""
    return isinstance(kind, T.NumericType)


def is_missing(column: Column, kind: T.DataType) -> Column:
    """Null, or NaN where the type has one. Infinity and '' are values."""
    if isinstance(kind, _FLOATS):
        return column.isNull() | F.isnan(column)
    return column.isNull()


# Nested timestamps keep their microseconds.
_JSON = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def present(column: Column, kind: T.DataType) -> Column:
    """The column with NaN turned into null."""
    if isinstance(kind, _FLOATS):
        return F.when(~F.isnan(column), column)
    return column


def as_text(column: Column, kind: T.DataType) -> Column:
    """The cell as a string, null where missing."""
    column = present(column, kind)
    if isinstance(kind, _NESTED):
        return F.to_json(column, _JSON)
    return column.cast("string")


def numeric_like(text: Column) -> Column:
    """True when a whole string reads as a plain decimal or scientific number.

    The pattern is stricter than ``try_cast``, which accepts ``5d`` and ``NaN``.
    """
    return text.rlike(
        r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
    )


def is_sentinel(text: Column, sentinels: list[str] = SENTINELS) -> Column:
    """Exact, case-sensitive membership; no trimming."""
    return text.isin(sentinels)


# English month names by their three-letter stem.
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_MONTH = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|"
    r"aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,? +)?"
_CLOCK = (
    r"(?:(?:t| +)\d{1,2}(?::\d{2}(?::\d{2}(?:\.\d{1,9})?)?)?(?: ?[ap]m)?"
    r"(?:z| ?utc| ?gmt|[+-]\d{2}:?\d{2})?)?"
)
_GAP = r" ?[-/. ] ?"

# A date text is rewritten to year-month-day by the first pattern that matches
# the whole trimmed, lower-case string.
_YEAR_FIRST = [
    (r"^(\d{4})$", "$1-1-1"),
    (r"^(\d{4})[-/. ](\d{1,2})$", "$1-$2-1"),
    (r"^(\d{1,2})[-/](\d{4})$", "$2-$1-1"),
    (r"^(\d{4})-?q[1-4]$", "$1-1-1"),
    (r"^[1-4]q(\d{4})$", "$1-1-1"),
    (r"^(\d{4})(\d{2})(\d{2})(?:t?\d{4}(?:\d{2})?)?$", "$1-$2-$3"),
    (rf"^{_WEEKDAY}(\d{{4}}){_GAP}(\d{{1,2}}){_GAP}(\d{{1,2}}){_CLOCK}$", "$1-$2-$3"),
]
_NAMED_MONTH = [
    (rf"^{_MONTH}[-/. ]?(\d{{4}})$", "$2-$1-1"),
    (rf"^(\d{{4}})[-/. ]?{_MONTH}$", "$1-$2-1"),
    (
        rf"^{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th)?[-/. ]?{_MONTH}[-/., ] ?(\d{{4}}){_CLOCK}$",
        "$3-$2-$1",
    ),
    (rf"^(\d{{1,2}}){_MONTH}(\d{{4}}){_CLOCK}$", "$3-$2-$1"),
    (
        rf"^{_WEEKDAY}{_MONTH}[-/. ]?(\d{{1,2}})(?:st|nd|rd|th)?(?:, ?|[-/. ])(\d{{4}}){_CLOCK}$",
        "$3-$1-$2",
    ),
]
# Three short numbers: year last, or a two-digit year first.
_SHORT_NUMBERS = [
    (rf"^{_WEEKDAY}(\d{{1,2}}){_GAP}(\d{{1,2}}){_GAP}(\d{{4}}|\d{{1,2}}){_CLOCK}$", "$1-$2-$3"),
    (r"^(\d{2})(\d{2})(\d{2})$", "$1-$2-$3"),
]
# Cheap test every date text passes: digits, separators and known words only.
# Longer words come first and nothing is tried again, so that texts of any
# length are read once.
_DATE_WORDS = (
    rf"[\d ,:./+-]++|{_MONTH}|mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun|day|"
    r"st|nd|rd|th|[ap]m|utc|gmt|[qtz]"
)
_DATE_ALPHABET = rf"^(?=.*\d)(?:{_DATE_WORDS})++$"
# What the first characters of every text with that alphabet pass; the end may cut a word of at most nine letters.
_DATE_HEAD, _DATE_START = 64, rf"^(?:{_DATE_WORDS})*+(?s:.{{0,9}})$"
#: The longest run of digits that is a date.
_DATE_DIGITS = 14
# Plain numbers that no rule below takes for a date.
_BARE_NUMBER = r"^-?\d+(?:\.\d+)?(?:e-?\d+)?$"
_DATE_NUMBER = r"^(?:\d{4}|\d{6}|\d{8}|\d{12}|\d{14}|\d{4}\.\d{1,2})$"


def _bind(value: Column, body) -> Column:
    """Evaluate ``body`` with ``value`` computed once instead of at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    return F.coalesce(
        *[F.when(text.rlike(rule), F.regexp_replace(text, rule, order)) for rule, order in rules]
    )


def _named_to_numbers(rewritten: Column) -> Column:
    """``2024-march-5`` → ``2024-3-5``."""
    stems = F.array(*[F.lit(m) for m in _MONTHS])

    def number(parts: Column) -> Column:
        month = F.array_position(stems, F.substring(parts[1], 1, 3)).cast("string")
        return F.concat(parts[0], F.lit("-"), month, F.lit("-"), parts[2])

    return _bind(F.split(rewritten, "-"), number)


def _full_year(year: Column) -> Column:
    short = F.length(year) <= 2
    value = year.cast("int")
    return F.when(short & (value < 70), value + 2000).when(short, value + 1900).otherwise(value)


def _in_order(parts) -> Column:
    """Order by the first number: above 31 a year, above 12 a day, else a month."""
    first = parts[0].cast("int")
    return (
        F.when(first > 31, F.concat_ws("-", _full_year(parts[0]), parts[1], parts[2]))
        .when(first > 12, F.concat_ws("-", _full_year(parts[2]), parts[1], parts[0]))
        .when(first >= 0, F.concat_ws("-", _full_year(parts[2]), parts[0], parts[1]))
    )


def _triple(rewritten: Column) -> Column:
    return _bind(F.split(rewritten, "-"), _in_order)


def _digits_in_range(digits: Column, first: Column, last: Column) -> Column:
    """What the rules say of digits alone, by their number; null or false if they are no date."""

    def part(start: int, length: int) -> Column:
        return F.substring(digits, start, length)

    def may_be(month: Column, day: Column) -> Column:
        """Most numbers are no date; a parser is slow to say so."""
        return month.between("01", "12") & day.between("01", "31")

    size, short = F.length(digits), [part(1, 2), part(3, 2), part(5, 2)]
    month = F.when(short[0] > "12", short[1]).otherwise(short[0])
    day = F.when(short[0] > "31", short[2]).when(short[0] > "12", short[0]).otherwise(short[1])
    day = F.when((size == 6) & may_be(month, day), _in_order(short)).when(
        size.isin(8, 12, 14) & may_be(part(5, 2), part(7, 2)),
        F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2)),
    )
    # A year alone is its first day.
    return F.when(size == 4, digits.between("1678", "2262")).otherwise(
        F.try_to_date(day, "y-M-d").between(first, last)
    )


def date_like(text: Column) -> Column:
    """True when a whole string reads as a calendar date.

    Mixed formats are accepted; the date must fall in the range of a signed
    64-bit nanosecond clock (21 September 1677 to 11 April 2262), which is
    what keeps lunar-calendar years such as 1446 from counting. Texts that
    only mean something relative to the clock (``now``, ``12:30``) are not
    dates here, so results do not depend on when the job runs.
    """
    first, last = F.lit("1677-09-22").cast("date"), F.lit("2262-04-11").cast("date")

    def parses(candidate: Column) -> Column:
        ordered = F.coalesce(
            _rewrite(candidate, _YEAR_FIRST),
            _named_to_numbers(_rewrite(candidate, _NAMED_MONTH)),
            _triple(_rewrite(candidate, _SHORT_NUMBERS)),
        )
        inside = _bind(F.try_to_date(ordered, "y-M-d"), lambda day: day.between(first, last))
        number = candidate.rlike(_BARE_NUMBER) & ~candidate.rlike(_DATE_NUMBER)
        return F.coalesce(F.when(~number & candidate.rlike(_DATE_ALPHABET), inside), F.lit(False))

    # Long texts are nearly all told by their first characters and are not read further.
    head = F.lower(F.left(F.trim(text), F.lit(_DATE_HEAD)))
    whole = _bind(F.lower(F.trim(text)), parses)
    # Digits alone, as most numbers are, need no rule by rule search.
    digits = F.left(F.trim(text), F.lit(_DATE_DIGITS + 1))
    return F.coalesce(
        F.when(digits.rlike(rf"^\d{{1,{_DATE_DIGITS}}}\z"), _digits_in_range(digits, first, last)).otherwise(
            F.when(head.rlike(_DATE_START), whole)
        ),
        F.lit(False),
    )


_SHORT_TEXT = 64


def text_key(text: Column) -> Column:
    """A short stand-in for a text: itself up to 64 characters, else its SHA-256.

    The prefixed digest is longer than any text kept as it is, so two keys
    agree only if their texts do.
    """
    return F.when(F.length(text) <= _SHORT_TEXT, text).otherwise(
        F.concat(F.lit("sha256:"), F.sha2(text, 256))
    )


def _spelled(cell: Column, kind: T.DataType) -> Column:
    """A text that two cells of one type share exactly if they are equal; null if missing."""
    cell = present(cell, kind)
    if isinstance(kind, _NESTED):
        return F.to_json(cell, _JSON)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(cell.cast("timestamp")).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(cell)
    if isinstance(kind, _FLOATS):
        cell = cell + F.lit(0.0)
    return cell.cast("string")


def row_digest(cells: list[Column]) -> Column:
    """SHA-256 of a row of texts, each with its length in front so that no two
    rows run together; nulls have a mark of their own."""
    parts = [
        F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cells
    ]
    return F.unhex(F.sha2(F.concat(*parts) if parts else F.lit(""), 256))


def row_keys(columns: list[tuple[str, T.DataType]]) -> list[Column]:
    """A grouping column under which exactly the equal rows meet.

    Nulls equal nulls, NaN counts as null, and -0.0 equals 0.0. A row travels
    as one digest however wide it is, so the duplicate search shuffles little.
    """
    cells = [_spelled(F.col(f"`{name}`"), kind) for name, kind in columns]
    return [row_digest(cells).alias("_key")]
