"""Check digits as expressions. A null or malformed value gives false."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lakeveil.functions.spans import col


def _digits(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: c.cast("int"))


def _safe(text: Column, shape: str, test) -> Column:
    clean = F.upper(F.regexp_replace(col(text), r"[\s-]", ""))
    return F.coalesce(F.when(clean.rlike(shape), test(clean)), F.lit(False))


def _number(c: Column) -> Column:
    """0-9 and A=10 to Z=35."""
    return F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)


def luhn(text: Column | str) -> Column:
    return _safe(text, r"^[0-9]{12,19}$", lambda t: F.call_function("luhn_check", t))


def iban(text: Column | str) -> Column:
    """ISO 13616: the rearranged number is 1 modulo 97."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return _safe(text, r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$", lambda t: F.aggregate(F.split(F.concat(F.substring(t, F.lit(5), F.length(t)), F.substring(t, 1, 4)), ""), F.lit(0), step) == 1)


def _mod_11_10(digits: Column) -> Column:
    """Check digit of ISO 7064 MOD 11,10."""

    def step(p, d):
        s = (d + p) % 10
        return (F.when(s == 0, 10).otherwise(s) * 2) % 11

    return (11 - F.aggregate(digits, F.lit(10), step)) % 10


def tax_id(text: Column | str) -> Column:
    """German tax number of a person: 11 digits, no leading zero, one digit of the first ten two or three times."""

    def test(t):
        ten = F.slice(_digits(t), 1, 10)
        most = F.array_max(F.transform(ten, lambda d: F.size(F.filter(ten, lambda e: e == d))))
        return (_mod_11_10(ten) == F.substring(t, 11, 1).cast("int")) & most.between(2, 3)

    return _safe(text, r"^[1-9][0-9]{10}$", test)


def vat_id(text: Column | str) -> Column:
    return _safe(text, r"^DE[1-9][0-9]{8}$", lambda t: _mod_11_10(F.slice(_digits(F.substring(t, 3, 9)), 1, 8)) == F.substring(t, 11, 1).cast("int"))


def _weighted(numbers: Column, weights: list[int], cross: bool) -> Column:
    w = F.array(*map(F.lit, weights))
    term = (lambda d, x: F.floor(d * x / 10) + d * x % 10) if cross else (lambda d, x: d * x)
    return F.aggregate(F.zip_with(numbers, w, term), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def pension_number(text: Column | str) -> Column:
    """German social security number: the letter as two digits, weights 2 1 2 5 7 1 2 1 2 1 2 1, sums of digits."""

    def test(t):
        letter = F.lpad((F.ascii(F.substring(t, 9, 1)) - 64).cast("string"), 2, "0")
        return _weighted(_digits(F.concat(F.substring(t, 1, 8), letter, F.substring(t, 10, 2))), [2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1], True) % 10 == F.substring(t, 12, 1).cast("int")

    return _safe(text, r"^[0-9]{8}[A-Z][0-9]{3}$", test)


def health_number(text: Column | str) -> Column:
    """German health insurance number: the letter as two digits, weights 1 2 in turn, sums of digits."""

    def test(t):
        letter = F.lpad((F.ascii(t) - 64).cast("string"), 2, "0")
        return _weighted(_digits(F.concat(letter, F.substring(t, 2, 8))), [1, 2] * 5, True) % 10 == F.substring(t, 10, 1).cast("int")

    return _safe(text, r"^[A-Z][0-9]{9}$", test)


def document_number(text: Column | str) -> Column:
    """Machine readable document number of nine characters and a check digit: weights 7 3 1 (ICAO 9303)."""
    return _safe(text, r"^[A-Z0-9]{9}[0-9]$", lambda t: _weighted(F.transform(F.split(F.substring(t, 1, 9), ""), _number), [7, 3, 1] * 3, False) % 10 == F.substring(t, 10, 1).cast("int"))
