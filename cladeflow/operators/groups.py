"""Voting on broad groups and nomenclatural codes by the names, ranks and authors on a path.

A group is a bit of a 64-bit mask, so that what a path votes for is one number
that a walk from the root adds up; groups form a lattice in which one may have
several parents. Which group a mask stands for is worked out once for each
distinct mask of an Arrow batch; everything else is column expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import nomenclatural_code
from ..vocab import CODES, RANKS, VAGUE_RANKS, is_synonym
from .tree import with_paths

# Broad groups, each with those that it is part of, from the widest down.
GROUP_PARENTS = {
    "Viruses": (), "Prokaryotes": (), "Bacteria": ("Prokaryotes",), "Archaea": ("Prokaryotes",), "Eukaryotes": (),
    "Protists": ("Eukaryotes",), "Plants": ("Eukaryotes",), "Algae": ("Plants", "Protists"), "Bryophytes": ("Plants",),
    "Pteridophytes": ("Plants",), "Angiosperms": ("Plants",), "Gymnosperms": ("Plants",), "Fungi": ("Eukaryotes",),
    "Ascomycetes": ("Fungi",), "Basidiomycetes": ("Fungi",), "Pseudofungi": ("Fungi", "Algae"), "OtherFungi": ("Fungi",),
    "Animals": ("Eukaryotes",), "Arthropods": ("Animals",), "Insects": ("Arthropods",), "Coleoptera": ("Insects",),
    "Diptera": ("Insects",), "Lepidoptera": ("Insects",), "Hymenoptera": ("Insects",), "Hemiptera": ("Insects",),
    "Orthoptera": ("Insects",), "Trichoptera": ("Insects",), "OtherInsects": ("Insects",), "Arachnids": ("Arthropods",),
    "Crustacean": ("Arthropods",), "OtherArthropods": ("Arthropods",), "Molluscs": ("Animals",), "Gastropods": ("Molluscs",),
    "Bivalves": ("Molluscs",), "OtherMolluscs": ("Molluscs",), "Chordates": ("Animals",), "OtherAnimals": ("Animals",),
}
GROUPS = list(GROUP_PARENTS)
# The group that a code alone stands for.
CODE_GROUP = {"bacterial": "Prokaryotes", "zoological": "Eukaryotes", "botanical": "Eukaryotes", "virus": "Viruses", "cultivars": "Angiosperms"}
# Endings of names by rank and the groups that they are usual in.
_WIDE, _BOTANY = ("Prokaryotes", "Plants", "Algae", "Fungi"), ("Plants", "Algae", "Fungi")
SUFFIX_GROUPS = {
    "viricetidae": {"subclass": ("Viruses",)}, "viricotina": {"subphylum": ("Viruses",)}, "viricetes": {"class": ("Viruses",)},
    "mycetidae": {"subclass": ("Fungi",)}, "mycotina": {"subphylum": ("Fungi",)}, "phycidae": {"subclass": ("Algae",)},
    "viricota": {"phylum": ("Viruses",)}, "virineae": {"suborder": ("Viruses",)}, "virinae": {"subfamily": ("Viruses",)},
    "viridae": {"family": ("Viruses",)}, "virites": {"subkingdom": ("Viruses",)}, "phyceae": {"class": ("Algae",)},
    "phytina": {"subphylum": ("Plants", "Algae")}, "virales": {"order": ("Viruses",)}, "mycetes": {"class": ("Fungi",)},
    "iformes": {"order": ("Animals",)}, "oideae": {"subfamily": _WIDE}, "ophyta": {"phylum": ("Plants", "Algae")},
    "opsida": {"class": ("Plants",)}, "mycota": {"phylum": ("Fungi",)}, "aceae": {"family": _WIDE}, "oidae": {"epifamily": ("Animals",)},
    "oidea": {"superfamily": ("Animals",)}, "virus": {"genus": ("Viruses",), "subgenus": ("Viruses",)}, "viria": {"realm": ("Viruses",)},
    "virae": {"kingdom": ("Viruses",)}, "ineae": {"suborder": _WIDE}, "acea": {"superfamily": _BOTANY}, "ales": {"order": _WIDE},
    "anae": {"superorder": _BOTANY}, "aria": {"infraorder": _BOTANY}, "idae": {"family": ("Animals",), "subclass": ("Prokaryotes", "Plants")},
    "inae": {"subfamily": ("Animals",), "subtribe": _WIDE}, "vira": {"subrealm": ("Viruses",)}, "eae": {"tribe": _WIDE},
    "ida": {"order": ("Animals",)}, "ina": {"subtribe": ("Animals",)}, "ini": {"tribe": ("Animals",)}, "odd": {"infrafamily": ("Animals",)},
}
#: Ranks that only one code has; a documented subset.
RANK_CODE = {
    **dict.fromkeys(("cultivar", "cultivargroup", "grex", "convariety"), "cultivars"),
    **dict.fromkeys(("pathovar", "biovar", "chemovar", "morphovar", "phagovar", "serovar", "chemoform"), "bacterial"),
    **dict.fromkeys(("supersection", "section", "subsection", "series", "subseries", "proles", "forma_specialis"), "botanical"),
    **dict.fromkeys(("natio", "aberration", "morph"), "zoological"),
}
# Weights of hints from a name's own rank and authorship, and from those above it.
OWN_RANK, OWN_AUTHORS, ABOVE_RANK, ABOVE_AUTHORS = 5, 2, 2, 1


def _up(group: str) -> frozenset:
    """The group and all that it is part of."""
    return frozenset([group]).union(*(_up(p) for p in GROUP_PARENTS[group]))


UP = {g: _up(g) for g in GROUPS}


def bit(group: str) -> int:
    return 1 << GROUPS.index(group)


def disparate(a: str, b: str) -> bool:
    """Whether two groups contradict: neither has all that the other is part of."""
    return not (UP[a] >= UP[b] or UP[b] >= UP[a])


def resolve(mask: int) -> str | None:
    """The group that a set of votes stands for.

    The lowest group, if all others contain it. Else those that agree with fewer
    of the others go, again and again; where none goes, the group that most of
    those left are or are part of, the widest of equal ones.
    """
    votes = [g for g in GROUPS if mask & bit(g)]
    while votes:
        lowest = [g for g in votes if not any(g in UP[other] for other in votes if other != g)]
        if len(lowest) == 1:
            return lowest[0]
        agree = {g: sum(not disparate(g, other) for other in votes) for g in votes}
        left = [g for g in votes if agree[g] == max(agree.values())]
        if len(left) == len(votes):
            shared = {g: sum(g in UP[v] for v in votes) for g in GROUPS}
            return max(GROUPS, key=lambda g: (shared[g], -GROUPS.index(g)))
        votes = left
    return None


@F.pandas_udf(T.StringType())
def resolved(mask: pd.Series) -> pd.Series:
    known = {m: resolve(int(m)) for m in mask.dropna().unique()}
    return mask.map(known).astype(object).where(mask.notna(), None)


def are_disparate(a: Column, b: Column) -> Column:
    """disparate() for columns of group names; false where one is null."""
    up = F.create_map(*(x for g in GROUPS for x in (F.lit(g), F.lit(sum(bit(p) for p in UP[g])))))
    x, y = F.element_at(up, a), F.element_at(up, b)
    both = x.bitwiseAND(y)
    return F.coalesce((both != x) & (both != y), F.lit(False))


def with_groups(nodes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """id and `group` of each node, by the votes of the names on its path, or else by its code.

    nodes: id, parent_id, name, rank, status, code. vocabulary: name, group. Only
    accepted names of no rank, a vague one or one above the genus vote. A name
    that stands for several groups votes for all of them.
    """
    suprageneric = [*RANKS[: RANKS.index("genus")], *VAGUE_RANKS]
    counts = (F.col("status").isNull() | ~is_synonym(F.col("status"))) & (F.col("rank").isNull() | F.lower("rank").isin(*suprageneric))
    known = F.create_map(*(x for g in GROUPS for x in (F.lit(g), F.lit(bit(g)))))
    words = vocabulary.select(F.upper(F.trim("name")).alias("_word"), F.element_at(known, F.col("group")).alias("_bit"))
    words = words.filter("_bit is not null").groupBy("_word").agg(F.bit_or("_bit").alias("_bit"))
    voting = nodes.withColumn("_word", F.when(counts, F.upper(F.trim("name")))).join(words, "_word", "left").drop("_word")
    paths = with_paths(voting.withColumnRenamed("_bit", "vote"), ["vote"])
    mask = F.aggregate("path", F.lit(0).cast("long"), lambda m, p: m.bitwiseOR(F.coalesce(p["vote"], F.lit(0).cast("long"))))
    by_code = F.element_at(F.create_map(*(F.lit(x) for pair in CODE_GROUP.items() for x in pair)), F.lower("code"))
    return paths.select("id", mask.alias("mask"), by_code.alias("by_code")).select("id", F.coalesce(resolved("mask"), "by_code").alias("group"))


def _most(counts: dict[str, Column]) -> Column:
    """The name with the highest count above 0, the first of equal ones; null if there is none."""
    best = F.array_max(F.array(*(F.struct(c.alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, c) in enumerate(counts.items()))))
    return F.when(best["n"] > 0, best["k"])


def vote_code(rank: Column, authorship: Column, path: Column) -> Column:
    """The nomenclatural code that ranks and authorships hint at; path: structs of rank and authorship above the name."""
    by_rank = lambda r: F.element_at(F.create_map(*(F.lit(x) for pair in RANK_CODE.items() for x in pair)), F.lower(r))
    one = lambda cond, weight: F.when(F.coalesce(cond, F.lit(False)), weight).otherwise(0)

    def count(code: str) -> Column:
        own = one(nomenclatural_code(authorship) == code, OWN_AUTHORS) + one(by_rank(rank) == code, OWN_RANK)
        above = F.transform(path, lambda p: one(nomenclatural_code(p["authorship"]) == code, ABOVE_AUTHORS) + one(by_rank(p["rank"]) == code, ABOVE_RANK))
        return own + F.aggregate(F.coalesce(above, F.array().cast("array<int>")), F.lit(0), lambda a, x: a + x)

    return _most({code: count(code) for code in CODES})


def suffix_mask(name: Column, rank: Column) -> Column:
    """Bits of the groups in which names of this rank end so; the longest ending that has the rank counts."""
    out = F.lit(0).cast("long")
    for suffix, ranks in reversed(SUFFIX_GROUPS.items()):
        for at, groups in ranks.items():
            out = F.when(name.endswith(suffix) & (F.lower(rank) == at), F.lit(sum(bit(g) for g in groups)).cast("long")).otherwise(out)
    return F.when(name.isNotNull() & rank.isNotNull(), out).otherwise(F.lit(0).cast("long"))


def vote_suffix(masks: Column) -> Column:
    """The group that most of an array of suffix masks have, the first of equal ones; null without any."""
    usual = sorted({g for ranks in SUFFIX_GROUPS.values() for groups in ranks.values() for g in groups}, key=GROUPS.index)
    having = lambda g: F.size(F.filter(masks, lambda m: m.bitwiseAND(F.lit(bit(g))) != 0))
    return _most({g: having(g) for g in usual})


def drop_disparate(pairs: DataFrame) -> DataFrame:
    """Candidate pairs but those whose groups contradict; columns group, c_group, rank, authorship, ca.

    A pair stays if either group is unknown, and from species down if both
    authorships are the same as written.
    """
    low = [*RANKS[RANKS.index("species") : RANKS.index("other")]]
    same = F.lower("rank").isin(*low) & (F.col("authorship") == F.col("ca"))
    return pairs.filter(F.coalesce(same, F.lit(False)) | ~are_disparate(F.col("group"), F.col("c_group")))
