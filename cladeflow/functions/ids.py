"""Identifiers in other alphabets, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabets of identifiers, and the letters of pronounceable ones.
HEX = "0123456789ABCDEF"
LATIN36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LATIN32 = "23456789ABCDEFGHJKLMNPQRSTUVWXYZ"
LATIN29 = "23456789BCDFGHJKLMNPQRSTVWXYZ"
URISAFE64 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-"
CONSONANTS = "bdfghjklmnprstvz"
VOWELS = "aiou"


def _quotient(n: Column, by: int) -> Column:
    """Whole quotient without a detour over floating point."""
    return F.call_function("div", n.cast("long"), F.lit(by).cast("long"))


def encode_id(n: Column, alphabet: str = LATIN29) -> Column:
    """A number of 0 or more, written in the alphabet; null stays null."""
    radix = len(alphabet)
    powers = [radix**i for i in range(31, -1, -1) if radix**i < 2**63]
    digits = [F.substring(F.lit(alphabet), (_quotient(n, p) % radix).cast("int") + 1, F.lit(1)) for p in powers]
    padded = F.concat(*digits)
    return F.when(n == 0, F.lit(alphabet[0])).otherwise(F.regexp_replace(padded, f"^{alphabet[0]}+", ""))


def decode_id(x: Column, alphabet: str = LATIN29) -> Column:
    """The number that encode_id() wrote; null for other characters."""
    known = x.rlike("^[" + alphabet.replace("-", r"\-") + "]+$")
    value = F.aggregate(
        F.split(x, ""),
        F.lit(0).cast("long"),
        lambda s, c: s * len(alphabet) + F.position(c, F.lit(alphabet)) - 1,
    )
    return F.when(known, value)


def proquint(n: Column) -> Column:
    """A 32-bit number as two pronounceable five-letter words."""
    letter = lambda of, shift, bits: F.substring(
        F.lit(of), F.shiftright(n, shift).bitwiseAND((1 << bits) - 1).cast("int") + 1, F.lit(1)
    )
    word = lambda low: [
        letter(CONSONANTS, low + 12, 4), letter(VOWELS, low + 10, 2), letter(CONSONANTS, low + 6, 4),
        letter(VOWELS, low + 4, 2), letter(CONSONANTS, low, 4),
    ]
    return F.concat(*word(16), F.lit("-"), *word(0))


def from_proquint(x: Column) -> Column:
    value = F.aggregate(
        F.filter(F.split(x, ""), lambda c: c != "-"),
        F.lit(0).cast("long"),
        lambda s, c: F.when(
            F.position(c, F.lit(VOWELS)) > 0, s * 4 + F.position(c, F.lit(VOWELS)) - 1
        ).otherwise(s * 16 + F.position(c, F.lit(CONSONANTS)) - 1),
    )
    return F.when(x.rlike("^([bdfghjklmnprstvz][aiou][bdfghjklmnprstvz][aiou][bdfghjklmnprstvz]-?){2}$"), value)
