"""String, array and map expressions of the domain: names, tokens, lists of numbers, model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)"


def year_token(path: Column) -> Column:
    """The first underscore-delimited token 20NN of a file name."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_extract(F.concat(F.lit("_"), name), r"_(20[0-9]{2})(?=_|\.|$)", 1).try_cast("int")


def loose_year(path: Column) -> Column:
    """The first all-digit token that begins with 20, the extension left out."""
    return F.get(F.filter(F.split(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.tif$", ""), "_"), lambda t: t.rlike("^20[0-9]*$")), F.lit(0)).try_cast("int")


def numbers(text: Column) -> Column:
    """The numbers in a text as doubles; null text has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_NUMBER), F.lit(1)), lambda n: n.cast("double"))


def bracket_sum(text: Column) -> Column:
    """Sum of a bracketed blank-separated list, without ``none`` and what is no number."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\[\],]", " "), r"\s+")
    return F.aggregate(F.filter(F.transform(parts, lambda p: p.try_cast("double")), lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)


def circle_area(text: Column) -> Column:
    """Sum of the areas of circles whose diameters a text lists."""
    return F.aggregate(numbers(text), F.lit(0.0), lambda a, d: a + F.pi() * F.pow(d / 2, F.lit(2.0)))


def model_answer(text: Column) -> tuple[Column, Column, Column]:
    """``<number>.<name>: <reason>`` as three columns; all null where there is no colon, or the answer is blank or a placeholder."""
    left, why = F.split(text, ":", 2), F.trim(F.get(F.split(text, ":", 2), F.lit(1)))
    head = F.get(left, F.lit(0))
    number, name = F.trim(F.get(F.split(head, r"\.", 2), F.lit(0))), F.trim(F.get(F.split(head, r"\.", 2), F.lit(1)))
    good = text.isNotNull() & text.contains(":") & (F.trim(text) != "") & ~F.ltrim(text).startswith("[")
    some = lambda c: F.when(good & (c != ""), c)
    return some(number).try_cast("int"), some(name), some(why)


def trailing_index(name: Column) -> Column:
    """The digits at the end of a file's stem."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")
    return F.nullif(F.regexp_extract(stem, "([0-9]+)$", 1), F.lit("")).try_cast("bigint")


def leading_index(name: Column) -> Column:
    """The whole number before the first dot; an error if it is none."""
    return F.get(F.split(name, r"\."), F.lit(0)).cast("bigint")


def first_match(text: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern of the list that matches."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def approach(name: Column) -> Column:
    """The token after ``_appr_``."""
    return F.nullif(F.regexp_extract(name, "_appr_([^_]+)_", 1), F.lit(""))


def region_code(key: Column) -> Column:
    """First character of a trimmed id; null for a missing id."""
    c = F.substring(F.trim(key.cast("string")), 1, 1)
    return F.when(~c.isin("", "n", "N"), c)


def rounded_key(value: Column) -> Column:
    """A number as a whole-number string, halves to even; null if it is none."""
    return F.bround(value.try_cast("double")).cast("bigint").cast("string")


def parse_bool(text: Column) -> Column:
    """True or false from common spellings; an error on others."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "t", "yes", "y", "1"), True).when(t.isin("false", "f", "no", "n", "0"), False).when(t.isNull(), F.lit(None).cast("boolean")).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), t)).cast("boolean"))


def tag_label(*tags: Column) -> Column:
    """Present tags joined by a comma and a blank."""
    return F.concat_ws(", ", *tags)


def folder_name(text: Column) -> Column:
    """Letters, digits, dot, dash and underscore stay; the rest becomes an underscore."""
    return F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_")


def or_default(mapping: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(mapping, key), default)
