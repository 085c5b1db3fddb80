"""Text, array, date and identifier functions, as Spark expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Letters of the Latin blocks whose decomposition starts with an ASCII letter, and that letter."""
    source, target = [], []
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        first = unicodedata.normalize("NFKD", chr(point))[0]
        if first.isascii() and first.isalpha() and first != chr(point):
            source.append(chr(point))
            target.append(first)
    return "".join(source), "".join(target)


_FROM, _TO = _folding()
# Letters that no decomposition takes apart.
LIGATURES = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "ı": "i"}


def unaccent(x: Column) -> Column:
    """Latin letters without their marks; combining marks dropped, ligatures spelled out."""
    out = F.translate(x, _FROM, _TO)
    for mark, plain in LIGATURES.items():
        out = F.replace(out, F.lit(mark), F.lit(plain))
    return F.regexp_replace(out, r"\p{M}+", "")


def has_content(*columns: Column) -> Column:
    """Whether any of the texts is neither null nor blank."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.trim(c) != "", F.lit(False))
    return out


def equals_ignore_case(a: Column, b: Column) -> Column:
    return F.lower(a).eqNullSafe(F.lower(b))


def equals_ignore_case_and_space(a: Column, b: Column) -> Column:
    return F.lower(remove_space(a)).eqNullSafe(F.lower(remove_space(b)))


def remove_space(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+", "")


def digits_or_ascii_letters(x: Column) -> Column:
    """Runs of other characters become one space; folded, trimmed, upper case; '' becomes null."""
    kept = F.regexp_replace(x, r"[^\p{L}\p{Nd}]+", " ")
    return F.nullif(F.upper(unaccent(F.trim(kept))), F.lit(""))


def equals_digits_or_ascii_letters(a: Column, b: Column) -> Column:
    return digits_or_ascii_letters(a).eqNullSafe(digits_or_ascii_letters(b))


def remove_punctuation_and_space(x: Column) -> Column:
    """Digits and letters only; '' becomes null."""
    return F.nullif(F.regexp_replace(x, r"[^\p{Nd}\p{L}]+", ""), F.lit(""))


def concat_filled(delimiter: str, *columns: Column) -> Column:
    """Joins what is neither null nor empty."""
    return F.concat_ws(delimiter, *(F.nullif(c, F.lit("")) for c in columns))


def split_right(x: Column, delimiter: str) -> Column:
    """What stands before and after the last delimiter; without one, all stands before."""
    last = F.substring_index(x, delimiter, -1)
    found = F.instr(x, delimiter) > 0
    before = F.substring(x, F.lit(1), F.length(x) - F.length(last) - len(delimiter))
    return F.struct(F.when(found, before).otherwise(x).alias("left"), F.when(found, last).alias("right"))


def character_set(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.split(x, "")))


def escape_like(x: Column) -> Column:
    out = x
    for c in ("\\", "%", "_"):
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return out


def blank_space(x: Column) -> Column:
    """Each white-space character becomes one space."""
    return F.regexp_replace(x, r"\s", " ")


def parse_int(x: Column) -> Column:
    """The whole text as a number, else its first four characters, else null."""
    number = lambda c: F.when(F.trim(c).rlike(r"^[+-]?\d+$"), c.try_cast("int"))
    return F.coalesce(number(x), number(F.substring(x, 1, 4)))


def domain_name(x: Column) -> Column:
    """What follows the last @; null without one or with nothing behind it."""
    return F.when(F.instr(x, "@") > 0, F.nullif(F.substring_index(x, "@", -1), F.lit("")))


def agent_text(given: Column, family: Column, organisation: Column | None = None) -> Column:
    parts = [family, given] if organisation is None else [family, given, organisation]
    return F.concat_ws(" ", *parts)


def increase(x: Column) -> Column:
    """The next text in letter order, case by case: Carla, Carlb; Atz, Aua; zZz, aAaa."""
    tail = F.regexp_extract(x, "([zZ]*)$", 1)
    wrapped = F.translate(tail, "zZ", "aA")
    head = F.substring(x, F.lit(1), F.length(x) - F.length(tail))
    last = F.substring(head, -1, 1)
    following = F.translate(
        last, "abcdefghijklmnopqrstuvwxyABCDEFGHIJKLMNOPQRSTUVWXY", "bcdefghijklmnopqrstuvwxyzBCDEFGHIJKLMNOPQRSTUVWXYZ"
    )
    longer = F.concat(wrapped, F.when(F.substring(wrapped, -1, 1).rlike("[A-Z]"), "A").otherwise("a"))
    before = F.substring(head, F.lit(1), F.length(head) - 1)
    return F.when(F.length(head) == 0, longer).otherwise(F.concat(before, following, wrapped))


def pad_zero(x: Column, width: int) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def camel_case(x: Column) -> Column:
    """An enum constant as words run together: TYPE_STATUS becomes TypeStatus."""
    return F.replace(F.initcap(F.replace(x, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def lower_camel_case(x: Column) -> Column:
    camel = camel_case(x)
    return F.concat(F.lower(F.substring(camel, 1, 1)), F.substring(camel, F.lit(2), F.length(camel)))


def byte_size(n: Column, binary: bool = False) -> Column:
    """A count of bytes with its unit, one decimal."""
    base, units = (1024, ("KiB", "MiB", "GiB", "TiB", "PiB")) if binary else (1000, ("kB", "MB", "GB", "TB", "PB"))
    out = F.when(n < base, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(units, 1):
        scaled = F.format_string("%.1f %s", n / float(base**i), F.lit(unit))
        out = out.when(n < base ** (i + 1), scaled) if i < len(units) else out.otherwise(scaled)
    return out


def clean_invisible(x: Column) -> Column:
    """Space-like characters become blanks; control and format characters go."""
    spaces = F.regexp_replace(x, r"[\p{Z}\t\r\n]", " ")
    return F.regexp_replace(spaces, r"[\p{Cc}\p{Cf}]", "")


def clean_cell(x: Column, nulls: tuple[str, ...] = ("\\N", "NULL", "null")) -> Column:
    """A cell of a data file: null markers and blanks become null, white space is collapsed."""
    trimmed = F.trim(F.regexp_replace(F.regexp_replace(x, "\0", ""), r"\s+", " "))
    return F.when((trimmed == "") | trimmed.isin(*nulls), None).otherwise(trimmed)


def extract_email(x: Column) -> Column:
    found = F.regexp_extract(remove_space(x), r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1)
    return F.nullif(found, F.lit(""))


def unescape_verbatim(x: Column) -> Column:
    """The five named character references and numbered spaces of data files, decoded."""
    out = x
    for name, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(plain))
    return out


def strip_html(x: Column) -> Column:
    """Text without tags; links keep their text."""
    no_code = F.regexp_replace(x, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(no_code, r"(?s)<[^>]*>", " "), r"\s+", " "))


def identifiers(x: Column, delimiter: str = r"[|,;]") -> Column:
    """A delimited list of identifiers as scope and id; without a scope, `local`."""
    item = lambda s: F.struct(
        F.when(F.instr(s, ":") > 0, F.lower(F.substring_index(s, ":", 1))).otherwise("local").alias("scope"),
        F.when(F.instr(s, ":") > 0, F.expr("null").cast("string")).otherwise(s).alias("bare"),
        F.regexp_replace(s, "^[^:]*:", "").alias("id"),
    )
    parts = F.filter(F.transform(F.split(x, delimiter), lambda s: F.trim(s)), lambda s: s != "")
    return F.transform(F.transform(parts, item), lambda s: F.struct(s["scope"], s["id"]))


def unmatched_brackets(x: Column) -> Column:
    count = lambda c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    return (count("(") != count(")")) | (count("[") != count("]")) | (count("{") != count("}"))


def no_letter(x: Column) -> Column:
    return ~x.rlike(r"\p{L}")


def multi_word(x: Column) -> Column:
    return F.trim(x).rlike(r"\S\s+\S")


def unlikely_vernacular(x: Column) -> Column:
    return (F.length(x) > 100) | x.rlike("[,;|]")


def homoglyphs(x: Column) -> Column:
    """Cyrillic and Greek letters that look like Latin ones, as these."""
    return F.translate(x, "АВЕКМНОРСТХаеорсухіΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTXaeopcyxiABEZHIKMNOPTYXo")


def array_text(x: Column) -> Column:
    return F.array_join(x, " ")


def json_texts(x: Column) -> Column:
    """The leaf values of a flat JSON document, for full-text search."""
    return F.map_values(F.from_json(x, "map<string,string>"))


def counts_sorted(counts: Column) -> Column:
    """Entries of a count map, the highest first; equal counts by key."""
    entries = F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k")))
    return F.transform(F.array_sort(entries), lambda e: F.struct(e["k"].alias("key"), (-e["n"]).alias("value")))


def add_counts(a: Column, b: Column) -> Column:
    """Key-wise sum of two count maps."""
    zero = F.lit(0)
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def total_count(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda s, x: s + x)
