"""Scalar functions over columns: cells, amounts, dates, headers. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import constants as K

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once: Spark repeats an expression wherever it is mentioned, but not a lambda's argument."""
    return F.element_at(F.transform(F.array(value), use), 1)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def squeeze(c: Column | str) -> Column:
    """White space of any kind collapsed to single spaces and cut at both ends; null stays null."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def western_digits(c: Column | str) -> Column:
    return F.translate(_col(c), "٠١٢٣٤٥٦٧٨٩", "0123456789")


def strip_cid(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), K.CID, " ")


def has_cid(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit("")).rlike(K.CID)


def clean_cell(c: Column | str) -> Column:
    """A cell's text without unmapped-glyph marks and with tidy white space; null becomes empty."""
    t = F.coalesce(_col(c), F.lit(""))
    return F.when(~t.rlike(r"[^!-~ ]|  |\(cid:|^ | \z"), t).otherwise(squeeze(strip_cid(t)))


def has_arabic(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit("")).rlike(K.ARABIC)


def fix_arabic(c: Column | str) -> Column:
    """Reverses text that is mostly Arabic (stored in display order); null becomes empty."""
    t = F.coalesce(_col(c), F.lit(""))
    letters = F.length(t) - F.length(F.regexp_replace(t, K.ARABIC, ""))
    return F.when(has_arabic(t) & (letters * 2 >= F.length(t)), F.reverse(t)).otherwise(t)


def file_extension(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(_col(c), F.lit("")), r"(\.[^./\\]+)$", 1))


def is_image(c: Column | str) -> Column:
    return file_extension(c).isin(*K.IMAGE_SUFFIXES)


def is_document(c: Column | str) -> Column:
    return file_extension(c).isin(*K.DOCUMENT_SUFFIXES)


def needs_ocr(text: Column | str, pages: Column | str) -> Column:
    """Text with unmapped glyphs, or with fewer characters than a page of text has, must be recognised from the image."""
    t = F.coalesce(_col(text), F.lit(""))
    return has_cid(t) | (F.length(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")) < K.OCR_CHARS_PER_PAGE * F.greatest(F.lit(1), _col(pages)))


# Amounts


def parse_money(c: Column | str) -> Column:
    """struct<num double, txt string>: an amount, or the text where there is none to read; both null for blanks.

    Codes, symbols, thousands commas and inner spaces go; parentheses and a trailing minus negate. Ten digits or more
    without any currency are an identifier and stay text. An abbreviation's full stop (``L.E.``) goes with its code.
    """
    t = western_digits(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)^\s+|\s+$", ""))

    def without_marks(t: Column) -> Column:
        bare = F.when(_in_parentheses(t), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
        bare = F.regexp_replace(F.regexp_replace(bare, K.CURRENCY_CODE + r"\.?", " "), K.CURRENCY_SYMBOL, " ")
        return F.replace(bare, F.lit(","), F.lit(""))

    def read(t: Column, bare: Column, packed: Column) -> Column:
        minus_last = packed.endswith("-") & (F.length(packed) > 1)
        digits = F.when(minus_last, F.substring(packed, F.lit(1), F.length(packed) - 1)).otherwise(packed)
        return named(F.struct(minus_last.alias("minus"), digits.alias("digits"), digits.rlike(r"^-?[0-9]+(\.[0-9]+)?$").alias("plain")), lambda d: judge(t, bare, d))

    def judge(t: Column, bare: Column, d: Column) -> Column:
        money = t.rlike(K.CURRENCY_CODE) | t.rlike(K.CURRENCY_SYMBOL)
        n = F.when(d["plain"], d["digits"].try_cast("double"))
        name = d["plain"] & ~money & ~d["digits"].contains(".") & (F.abs(n) >= 1e9)
        value = F.when(d["minus"] | _in_parentheses(t), -F.abs(n)).otherwise(n)
        blank = t.isin(*K.BLANK_MARKS)
        text = F.when(name, squeeze(t)).when(~d["plain"], squeeze(bare))
        return F.struct(F.when(~blank & d["plain"] & ~name, value).alias("num"), F.when(~blank, text).alias("txt"))

    # Most amounts are plain whole numbers of up to nine digits: they need none of the steps below.
    whole = lambda t: F.struct(F.replace(t, F.lit(","), F.lit("")).cast("double").alias("num"), F.lit(None).cast("string").alias("txt"))
    loose = lambda t: named(without_marks(t), lambda bare: named(F.regexp_replace(bare, r"(?U)\s+", ""), lambda packed: read(t, bare, packed)))
    return named(t, lambda t: F.when(t.rlike(r"^([0-9]{1,9}|[0-9]{1,3}(,[0-9]{3}){1,2})$"), whole(t)).otherwise(loose(t)))


def _in_parentheses(t: Column) -> Column:
    return t.rlike(r"(?s)^\(.*\)$")


def money_text(c: Column | str) -> Column:
    """``parse_money`` as one text: the number (without a trailing .0), else the text, else empty."""

    def text(p: Column) -> Column:
        whole = p["num"] == F.floor(p["num"])
        number = F.when(whole & (F.abs(p["num"]) < 1e15), p["num"].cast("bigint").cast("string")).otherwise(p["num"].cast("string"))
        return F.coalesce(number, p["txt"], F.lit(""))

    # Whole numbers of up to nine digits are their own text.
    return F.when(_col(c).rlike(r"^(?:0|[1-9][0-9]{0,8})\z"), _col(c)).otherwise(named(parse_money(c), text))


def to_number(c: Column | str) -> Column:
    """A number from loosely written text (commas, spaces around it); null where there is none."""
    t = F.trim(F.replace(_col(c).cast("string"), F.lit(","), F.lit("")))
    return F.when(t.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def to_count(c: Column | str) -> Column:
    """The first run of digits as an integer; 0 where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(western_digits(F.coalesce(_col(c).cast("string"), F.lit(""))), r"([0-9]+)", 1), F.lit("")).try_cast("int"), F.lit(0))


def is_money_header(c: Column | str) -> Column:
    t = F.coalesce(_col(c), F.lit(""))
    return t.rlike(K.CURRENCY_SYMBOL) | any_of([F.lower(t).contains(w) for w in K.MONEY_HEADER_WORDS])


def is_numeric_header(c: Column | str) -> Column:
    """A header that names numbers: amounts or head counts, unless it is a text column's without a money word."""
    t = F.lower(F.coalesce(_col(c), F.lit("")))
    has = lambda words: any_of([t.contains(w) for w in words])
    textual = has(K.TEXT_HEADER_WORDS) & ~has(K.MONEY_OVERRIDE_WORDS)
    return (F.trim(t) != "") & ~textual & (is_money_header(t) | has(K.NUMERIC_HEADER_WORDS))


def header_currency(c: Column | str) -> Column:
    """The currency column that a header implies; null for converter and total headers and for headers without a currency."""
    t = F.coalesce(_col(c), F.lit(""))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(K.CURRENCY_HEADERS):
        out = F.when(t.rlike(pattern), name).otherwise(out)
    return F.when(t.rlike(K.CONVERTER_HEADER) | t.rlike(K.TOTAL_HEADER), F.lit(None).cast("string")).otherwise(out)


def in_egp(egp: Column | str, usd: Column | str, euros: Column | str, gbp: Column | str, rates: dict[str, float] | None = None) -> Column:
    r = rates or K.RATES
    zero = lambda c: F.coalesce(_col(c), F.lit(0.0))
    return zero(egp) + zero(usd) * r["USD"] + zero(euros) * r["Euros"] + zero(gbp) * r["GBP"]


# Headers


def normalize_header(c: Column | str) -> Column:
    """Lower case, punctuation as spaces, single spaces; letters of all scripts stay."""
    t = F.coalesce(_col(c), F.lit(""))
    # Most texts are plain words already; a run of anything else becomes one space.
    plain = t.rlike(r"^(?:[A-Za-z0-9_]++ ){0,12}[A-Za-z0-9_]++\z")
    return F.when(plain, F.lower(t)).otherwise(F.trim(F.regexp_replace(F.lower(t), r"(?U)[^a-z0-9_\w]+", " ")))


def fold_notes(pairs: list[tuple[str | None, Column]]) -> Column:
    """``label: value | label: value`` of the values that aren't blank or a dash; a label of None stands for none."""
    parts = []
    for label, value in pairs:
        v = F.trim(value.cast("string"))
        parts.append(F.when(~v.isin(*K.BLANK_MARKS), F.concat(F.lit(f"{label}: "), v) if label else v))
    return F.concat_ws(" | ", *parts) if parts else F.lit("")


# Dates


def _day(year: Column, month: Column, day: Column) -> Column:
    """The date as text; null where the calendar has no such day."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), text.try_cast("date").cast("string"))


def parse_date(c: Column | str, year_now: int) -> Column:
    """``YYYY-MM-DD`` of a date in one of the usual writings, else the text as it stands; null stays null.

    Day and month name with or without year, day/month/year, year/month/day, and two numbers (month first unless only
    the second can be one). ``year_now`` completes dates without a year.
    """
    t = F.regexp_replace(western_digits(_col(c)), r"(?U)^\s+|\s+$", "")
    t = F.trim(F.regexp_replace(t, r"(?i)^(mon|tues?|wed|thu|thurs|fri|sat|sun)[a-z]*\s+", ""))
    named_day = r"^([0-9]{1,2})[-/\s.]+([A-Za-z]{3,9})(?:[-/\s.]+([0-9]{2,4}))?$"
    dmy, ymd, two = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})$", r"^([0-9]{1,2})/([0-9]{1,2})$"
    part = lambda s, p, i: F.nullif(F.regexp_extract(s, p, i), F.lit(""))
    number = lambda s, p, i: part(s, p, i).try_cast("int")

    def by_name(t: Column) -> Column:
        # What the pattern lets pass falls into its parts where it is split.
        parts = F.split(t, r"[-/\s.]+")
        month = lambda p: F.nullif(F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.substring(F.get(p, F.lit(1)), 1, 3))), F.lit(0)).cast("int")
        year = lambda p: F.coalesce(F.get(p, F.lit(2)).try_cast("int"), F.lit(year_now))
        read = lambda p: F.struct(year(p).alias("y"), month(p).alias("m"), F.get(p, F.lit(0)).try_cast("int").alias("d"))
        day = lambda d: _day(F.when(d["y"] < 100, d["y"] + 2000).otherwise(d["y"]), d["m"], d["d"])
        return F.when(t.rlike(named_day), named(parts, lambda p: named(read(p), day)))

    def short(a: Column, b: Column) -> Column:
        day_first = (a > 12) & (b <= 12)
        return _day(F.lit(year_now), F.when(day_first, b).otherwise(a), F.when(day_first, a).otherwise(b))

    def by_numbers(bare: Column) -> Column:
        full = lambda p, y, m, d: _day(number(bare, p, y), number(bare, p, m), number(bare, p, d))
        return F.coalesce(full(dmy, 3, 2, 1), full(ymd, 1, 2, 3), short(number(bare, two, 1), number(bare, two, 2)))

    slashed = lambda t: F.regexp_replace(F.regexp_replace(t, r"[-./]", "/"), r"(?U)\s+", "")
    iso = lambda t: _day(*[F.substring(t, at, n).try_cast("int") for at, n in ((1, 4), (6, 2), (9, 2))])
    loose = lambda t: F.coalesce(by_name(t), named(slashed(t), by_numbers), t)
    return named(t, lambda t: F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.coalesce(iso(t), t)).otherwise(loose(t)))


def is_date_text(c: Column | str) -> Column:
    t = F.trim(F.coalesce(_col(c), F.lit("")))
    return t.rlike(r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$") | t.rlike(r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}$") | t.rlike(r"(?U)^\d{1,2}[-/.]\w{3,}[-/.]\d{2,4}$") | t.rlike(r"(?U)^\w{3,}\s+\d{1,2},?\s+\d{4}$")


# Packed numbers

_ONE = r"^[+-]?\s*[$€£¥]?\s*-?\d[\d,]*(?:\.\d+)?\s*-?(?:\s*(?:LE|EGP|USD|EUR|GBP))?$"
_RUN = r"[$€£¥]?\s*-?\d[\d,]*(?:\.\d+)?-?"


def split_numbers(c: Column | str) -> Column:
    """The numbers of a box that holds several, as array<string>; other texts as one element, blanks as none.

    Numbers stand apart by spaces (dashes between them don't count) or run together with dashes.
    """

    def split(t: Column) -> Column:
        words = F.filter(F.split(t, r"(?U)\s+"), lambda w: ~w.isin("-", "—", "--"))
        runs = F.transform(F.regexp_extract_all(t, F.lit(_RUN), F.lit(0)), lambda w: F.trim(w))
        return named(F.struct(words.alias("words"), runs.alias("runs")), lambda s: choose(t, s["words"], s["runs"]))

    def choose(t: Column, words: Column, runs: Column) -> Column:
        spaced = (F.size(words) > 1) & F.forall(words, lambda w: w.rlike(_ONE))
        packed = (F.size(runs) > 1) & F.regexp_replace(t, _RUN, "").rlike(r"^[ \-—,\t\r\n]*$")
        bare = F.when(F.forall(runs, lambda w: w.endswith("-")), runs).otherwise(F.transform(runs, lambda w: F.regexp_replace(w, "-$", "")))
        return F.when(t == "", F.array().cast("array<string>")).when(is_date_text(t), F.array(t)).when(spaced, words).when(packed, bare).otherwise(F.array(t))

    # No number has a small letter, and most boxes hold a word or one number: nothing to take apart.
    single = lambda t: t.rlike(r"[a-z]|^[0-9][0-9,]*(?:\.[0-9]+)?$")
    bare = _col(c).rlike(r"^(?:[0-9][0-9,]*(?:\.[0-9]+)?|(?=[^a-z\n\r]*[a-z])[!-~].*[!-~])\z")
    return F.when(bare, F.array(_col(c))).otherwise(named(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)^\s+|\s+$", ""), lambda t: F.when(single(t), F.array(t)).otherwise(split(t))))
