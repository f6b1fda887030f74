"""Numbers and money in Argentine notation, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcela.functions.text import clean_text, col, found, once, plain_text

NUMBER = "[0-9][0-9.,]*"


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def tail(text: Column, char: str) -> Column:
    return F.length(F.substring_index(text, char, -1))


def without(text: Column, char: str) -> Column:
    return F.replace(text, F.lit(char), F.lit(""))


def comma_to_point(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("."))


def without_markup(text: Column) -> Column:
    """plain_text() of texts that may hold tags or entities, which few do."""
    return F.when(F.contains(text, F.lit("<")) | F.contains(text, F.lit("&")), plain_text(text)).otherwise(text)


def parse_number(c: Column | str) -> Column:
    """The first number outside markup, signed. Points and commas: both mean thousands and decimals; several of one kind are
    thousands; one comma is decimal before at most two digits; one point is thousands before exactly three."""
    return once(read_number, once(lambda text: found(without_markup(text), "-?" + NUMBER), c))


def read_number(n: Column) -> Column:
    """parse_number() of what is a number only. n is named many times: once() binds it, so that it is looked for once."""
    points, commas = occurrences(n, "."), occurrences(n, ",")
    text = (
        F.when((points > 0) & (commas > 0), comma_to_point(without(n, ".")))
        .when(points > 1, without(n, "."))
        .when(commas > 1, without(n, ","))
        .when(commas == 1, F.when(tail(n, ",") <= 2, comma_to_point(n)).otherwise(without(n, ",")))
        .when((points == 1) & (tail(n, ".") == 3), without(n, "."))
        .otherwise(n)
    )
    return text.try_cast("double")


def parse_integer(c: Column | str) -> Column:
    """parse_number(), cut off towards zero."""
    return parse_number(c).try_cast("int")


def parse_card_number(c: Column | str) -> Column:
    """The first number, without sign; a comma is always decimal."""
    return once(read_card_number, found(col(c), NUMBER))


def read_card_number(n: Column) -> Column:
    points = occurrences(n, ".")
    text = F.when(occurrences(n, ",") > 0, comma_to_point(without(n, "."))).when((points > 1) | ((points == 1) & (tail(n, ".") == 3)), without(n, ".")).otherwise(n)
    return text.try_cast("double")


def number_range(c: Column | str) -> Column:
    """struct<low, high> of the first two numbers that can be read; high is low if there is one only."""
    numbers = F.filter(F.transform(F.regexp_extract_all(col(c), F.lit(f"({NUMBER})"), F.lit(1)), read_card_number), lambda x: x.isNotNull())
    return once(lambda some: F.struct(F.get(some, F.lit(0)).alias("low"), F.coalesce(F.get(some, F.lit(1)), F.get(some, F.lit(0))).alias("high")), numbers)


def parse_money(c: Column | str) -> Column:
    """struct<currency, amount, text>. Word bounds are part of the pattern: 'US$ 1' is pesos, 'US$1' dollars."""
    return once(money_of, clean_text(c))


def money_of(text: Column) -> Column:
    """parse_money() of a cleaned text."""
    return F.struct(once(currency_of, F.lower(text)).alias("currency"), parse_number(text).alias("amount"), text.alias("text"))


def currency_of(lower: Column) -> Column:
    return F.when(lower.rlike(r"\b(usd|u\$s|us\$|d[oó]lares?)\b"), "USD").when(lower.rlike(r"\b(ars|pesos?)\b|\$"), "ARS")


def card_money(c: Column | str) -> Column:
    """struct<currency, amount>: pesos unless dollars are named."""
    text = F.nullif(col(c), F.lit(""))
    currency = F.when(text.rlike(r"(?i)US\$|U\$S|USD"), "USD").when(text.isNotNull(), "ARS")
    return F.struct(currency.alias("currency"), parse_card_number(text).alias("amount"))


def per_unit(price: Column, area: Column) -> Column:
    """price / area where both count, unrounded."""
    return F.when((price != 0) & (area > 0), price / area)


def discount_percent(before: Column, now: Column) -> Column:
    return F.when((before > 0) & (now != 0), (before - now) / before * 100)
