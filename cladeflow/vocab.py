"""Ranks, statuses and other small vocabularies, as literal maps and dimension tables."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ranks of the nomenclatural codes, from the highest down.
RANKS = (
    "superdomain realm domain superkingdom kingdom subkingdom infrakingdom superphylum phylum subphylum infraphylum "
    "superclass class subclass infraclass parvclass superdivision division subdivision superlegion legion sublegion "
    "supercohort cohort subcohort gigaorder magnorder grandorder mirorder superorder order nanorder hypoorder minorder "
    "suborder infraorder parvorder megafamily grandfamily superfamily epifamily family subfamily infrafamily "
    "supertribe tribe subtribe infratribe suprageneric genus subgenus infragenus supersection section subsection "
    "superseries series subseries infrageneric aggregate species infraspecific grex subspecies cultivargroup "
    "convariety infrasubspecific proles natio aberration morph variety subvariety form subform pathovar biovar "
    "chemovar morphovar phagovar serovar chemoform forma_specialis cultivar strain other unranked"
).split()

# Statuses in their order of presentation.
STATUS = ("ACCEPTED", "PROVISIONALLY_ACCEPTED", "SYNONYM", "AMBIGUOUS_SYNONYM", "MISAPPLIED", "BARE_NAME")
SYNONYM_STATUS = ("SYNONYM", "AMBIGUOUS_SYNONYM", "MISAPPLIED")
#: Ranks that compare as unknown against any other.
VAGUE_RANKS = ("other", "unranked", "infraspecific", "infrageneric", "suprageneric", "infrasubspecific")
CODES = ("bacterial", "botanical", "cultivars", "phyto", "virus", "zoological")


def ordinal(value: Column, names) -> Column:
    """Place of a constant in `names`; null where it is none of them."""
    pairs = chain.from_iterable((F.lit(n), F.lit(i)) for i, n in enumerate(names))
    return F.element_at(F.create_map(*pairs), value)


def rank_ordinal(rank: Column) -> Column:
    return ordinal(F.lower(rank), RANKS)


def status_ordinal(status: Column) -> Column:
    return ordinal(F.upper(status), STATUS)


def is_synonym(status: Column) -> Column:
    return F.upper(status).isin(*SYNONYM_STATUS)


def compare_ranks(a: Column, b: Column) -> Column:
    """EQUAL, DIFFERENT, or UNKNOWN where either rank is missing or vague."""
    a, b = F.lower(a), F.lower(b)
    vague = a.isNull() | b.isNull() | a.isin(*VAGUE_RANKS) | b.isin(*VAGUE_RANKS)
    return F.when(a == b, "EQUAL").when(vague, "UNKNOWN").otherwise("DIFFERENT")


def dimension(spark: SparkSession, names) -> DataFrame:
    """A two-column table of ordinals and names; a handful of rows."""
    return spark.createDataFrame(list(enumerate(names)), "ordinal int, name string")


def resolve_constant(value: str, names) -> str:
    """A constant given by its name, in any case and with spaces or dashes, or by its ordinal."""
    if value.strip().isdigit():
        return names[int(value)]
    wanted = value.strip().replace(" ", "_").replace("-", "_").lower()
    for n in names:
        if n.lower() == wanted:
            return n
    raise ValueError(f"{value!r} is none of {', '.join(names)}")
