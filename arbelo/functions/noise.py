"""Noise of careless typing, as column functions: the same text, written in other ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbelo.functions import text as X


def _choose(style: Column, ways: list[Column]) -> Column:
    return F.element_at(F.array(*ways), (F.pmod(style, F.lit(len(ways))) + 1).cast("int"))


def typo(text: Column, place: Column, kind: Column) -> Column:
    """One inner letter lost, changed with the next one, or doubled (kind 0, 1, 2 modulo 3); texts of fewer than 5 letters stay."""
    i = (F.pmod(place, F.greatest(F.length(text) - 2, F.lit(1))) + 2).cast("int")
    start, here, after = F.substring(text, F.lit(1), i - 1), F.substring(text, i, F.lit(1)), F.substring(text, i + 1, F.length(text))
    swapped = F.concat(start, F.substring(after, 1, 1), here, F.substring(after, F.lit(2), F.length(text)))
    return F.when(F.length(text) < 5, text).otherwise(_choose(kind, [F.concat(start, after), swapped, F.concat(start, here, here, after)]))


# The four ways in which the sources write a street address and a phone, and a tax id with its marks.
ADDRESS_STYLES = ["{street}, {number} - {district}, {city}", "{street} {number}, {city}", "{street}, {number} - {district} - {city}", "{street} nº {number}, {district} ({city})"]
STREET_SHORT = {"Rua ": "R. ", "Avenida ": "Av. "}
PHONE_STYLES = ["({a}) {b}-{c}", "{a}{b}{c}", "{a} {b} {c}", "+55 {a} {b}{c}"]
TAX_ID = "{0}.{1}.{2}/{3}-{4}"


def _fill(style: str, **parts: Column) -> Column:
    """A column of a style whose names in braces stand for columns."""
    out = []
    for piece in style.split("{"):
        name, brace, rest = piece.partition("}")
        out += [parts[name], F.lit(rest)] if brace else [F.lit(piece)]
    return F.concat(*out)


def address(style: Column, street: Column, number: Column, district: Column, city: Column) -> Column:
    short = street
    for long, brief in STREET_SHORT.items():
        short = F.when(street.startswith(long), F.concat(F.lit(brief), F.substring(street, F.lit(len(long) + 1), F.length(street)))).otherwise(short)
    parts = {"number": number.cast("string"), "district": district, "city": city}
    ways = [_fill(s, street=short if k == 1 else street, **parts) for k, s in enumerate(ADDRESS_STYLES)]
    ways[2] = F.upper(X.fold(ways[2]))
    return _choose(style, ways)


def phone(style: Column, digits: Column) -> Column:
    """digits: an area code of two and a number of eight."""
    parts = {"a": F.substring(digits, 1, 2), "b": F.substring(digits, 3, 4), "c": F.substring(digits, 7, 4)}
    return _choose(style, [_fill(s, **parts) for s in PHONE_STYLES])


def tax_id(digits: Column) -> Column:
    return _fill(TAX_ID, **{str(k): F.substring(digits, at, n) for k, (at, n) in enumerate([(1, 2), (3, 3), (6, 3), (9, 4), (13, 2)])})


def wrong_digit(digits: Column, place: Column, step: Column) -> Column:
    """One of the first 12 digits changed; where the check digits still fit, the last digit too."""
    i = (F.pmod(place, F.lit(12)) + 1).cast("int")
    turn = lambda at, by: F.overlay(digits, F.pmod(F.substring(digits, at, F.lit(1)).cast("int") + by, F.lit(10)).cast("string"), at)
    changed = turn(i, F.pmod(step, F.lit(9)) + 1)
    last = F.pmod(F.substring(digits, 14, 1).cast("int") + 1, F.lit(10)).cast("string")
    return F.when(X.check_digits(F.substring(changed, 1, 12)) == F.substring(changed, 13, 2), F.concat(F.substring(changed, 1, 13), last)).otherwise(changed)


def variant(style: Column, trade: Column, core: Column, brief: Column, legal: Column, place: Column) -> Column:
    """A customer's name as people write it: as it is, in small letters, mistyped, without its kind, in capitals, with the kind abbreviated, or the legal name."""
    return _choose(style, [trade, F.lower(trade), typo(trade, place, place), core, F.upper(X.fold(trade)), F.concat_ws(" ", brief, core), legal])
