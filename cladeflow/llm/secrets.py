"""Secret scans with ownership frequency, by DataFrame functions alone.

Places of matches come from the parts that a split by the pattern leaves: the
lengths of the parts and matches before a match add up to its start. Candidate
values are hashed and counted by distinct repositories and owners over the whole
corpus. A value that many owners have is a copied example; one that few have
looks live. Besides the base kinds, which always stay, credentials in other
forms are added where their value looks live.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, join_spread, stage

#: Kinds in the order of the contract, with pattern, capturing group of the value
#: and least length of the value.
BASE_KINDS = {
    "assign": (
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Further credentials: keys of well-known services, signed web tokens, passwords
#: in addresses, private keys, and long words that mix cases and digits.
ADDED_KIND = "live"
#: A private key with its body and footer, or as much of the body as there is.
KEY = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"(?:(?:\s*(?:Proc-Type|DEK-Info):[^\r\n]*){0,2}[^-]*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?:(?:\s{0,4}[A-Za-z0-9+/]{16,}={0,2}){1,512}(?:\s{0,4}[A-Za-z0-9+/]{1,15}={0,2}\s*\z)?)?)"
)
#: What isn't the body of a key.
KEY_FRAME = r"-----(?:BEGIN|END) [A-Z ]{0,20}PRIVATE KEY-----|\s|\\[nr]"
ADDED = (
    KEY +
    r"|\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    r"|\b(?:gh[pousr]_|sk-|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,}"
    r"|(?<=://)[^\s/:@]{1,64}:[^\s/:@]{6,64}(?=@)"
    r"|\b(?=[A-Za-z_]{0,64}[0-9])(?=[A-Z0-9_]{0,64}[a-z])(?=[a-z0-9_]{0,64}[A-Z])[A-Za-z0-9_]{20,}"
)
#: A value that more owners have is a widely copied example.
MOST_OWNERS = 2
REDACTED = "[SECRET]"

_SPAN = "struct<kind: string, rank: int, s: int, e: int, value: string>"


#: A fold copies what it has gathered at each item; over so many items at a time, and then their results, it stays linear.
BLOCK = 256


def _blocks(items: Column) -> Column:
    """The items in arrays of BLOCK."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))


def _let(value: Column, then) -> Column:
    """then(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Spans of `pattern` in `text`, in order, leftmost and not overlapping."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    is_key = lambda x: F.lit(kind == ADDED_KIND) & x.startswith("-----BEGIN ")
    if kind == ADDED_KIND:  # a key's header is the same in all keys, its body is the value
        body = lambda x: F.regexp_replace(x, KEY_FRAME, "")
        values = F.transform(found, lambda x: F.when(is_key(x) & (body(x) != ""), body(x)).otherwise(x))
    empty = F.array().cast(f"array<{_SPAN}>")

    def step(a, x):
        span = F.struct(
            F.lit(kind).alias("kind"),
            F.when(is_key(x["found"]), rank + 1).otherwise(rank).alias("rank"),
            (a["at"] + x["gap"]).alias("s"),
            (a["at"] + x["gap"] + F.length(x["found"])).alias("e"),
            x["value"].alias("value"),
        )
        spans = F.when(F.length(x["value"]) >= least, F.concat(a["out"], F.array(span))).otherwise(a["out"])
        return F.struct((a["at"] + x["gap"] + F.coalesce(F.length(x["found"]), F.lit(0))).alias("at"), spans.alias("out"))

    def block(a, xs):
        inner = F.aggregate(xs, F.struct(a["at"].alias("at"), empty.alias("out")), step)
        return _let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(a["out"], F.array(x["out"])).alias("out")))

    parts = F.arrays_zip(gaps.alias("gap"), found.alias("found"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out"))
    walked = F.aggregate(_blocks(parts), start, block, lambda a: F.flatten(a["out"]))
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def candidates(text: Column) -> Column:
    """All candidate spans of a text: of the base kinds, then of the added one."""
    kinds = [(k, i, *v) for i, (k, v) in enumerate(BASE_KINDS.items())]
    kinds.append((ADDED_KIND, len(kinds), ADDED, 0, 1))
    return F.concat(*(_spans(text, *k) for k in kinds))


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"], x["rank"], x["e"], x["kind"])))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_repos, n_owners and n_found of each candidate; found: value_hash, repo, owner."""
    pairs = found.groupBy("value_hash", "repo", "owner").agg(F.count("*").alias("n"))
    return (
        pairs.groupBy("value_hash", "owner")
        .agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
        .groupBy("value_hash")
        .agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("n").alias("n_found"))
    )


def scan(
    docs: DataFrame,
    repo: str = "source",
    owner: str | None = None,
    most_owners: int = MOST_OWNERS,
    keep: list[str] | None = None,
    name: str = "secret_scan",
) -> DataFrame:
    """The rows of `docs` with the columns `keep`, or all, and a struct in column `name`.

    It holds `base` and `all`, arrays of spans (kind, rank, s, e, value, live) by
    code points with the end excluded, in no certain order. The repository is
    column `repo`; its owner is column `owner` or else the part before the first
    slash of the repository. Null texts are empty and hold nothing; a null
    repository counts as one of its own name, the empty one. Rows that repeat an
    id are scanned each on its own. Other columns pass through unless one is
    named `name`.
    """
    repo_name = F.coalesce(F.col(repo).cast("string"), F.lit(""))
    own = F.coalesce(F.col(owner).cast("string"), F.lit("")) if owner else F.substring_index(repo_name, "/", 1)
    text = F.coalesce("text", F.lit(""))
    kept = columns_of([c for c in keep or docs.columns if c != name])
    rows = docs.select(
        F.struct(*kept).alias("doc"), text.alias("text"), repo_name.alias("repo"), own.alias("owner")
    )
    found = stage(
        rows.withColumn("found", candidates(F.col("text")))
        .drop("text")
        .withColumn("row", F.monotonically_increasing_id())
    )
    with_any = found.filter(F.size("found") > 0)
    each = with_any.select("row", "repo", "owner", F.explode("found").alias("x")).select(
        "row", "repo", "owner", "x.*", F.sha2("x.value", 256).alias("value_hash")
    )
    owners = stage(ownership(each))
    total = owners.agg(F.coalesce(F.sum("n_found"), F.lit(0))).first()[0]
    known = join_spread(each, owners, "value_hash", "n_found", total)
    live = F.col("n_owners") <= most_owners
    added = F.col("rank") >= len(BASE_KINDS)
    span = F.struct("kind", "rank", "s", "e", "value", live.alias("live"))
    grouped = (
        known.filter(~added | live)
        .groupBy("row")
        .agg(F.collect_list(F.when(~added, span)).alias("base"), F.collect_list(F.when(added, span)).alias("added"))
    )
    apart = F.filter(  # what overlaps a base span is found already, but for keys
        F.col("added"),
        lambda x: (x["rank"] > len(BASE_KINDS))
        | ~F.exists(F.col("base"), lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])),
    )
    grouped = grouped.select(
        "row", F.struct(F.col("base").alias("base"), F.concat("base", apart).alias("all")).alias("secret_scan")
    )
    none = F.array().cast("array<struct<kind: string, rank: int, s: int, e: int, value: string, live: boolean>>")
    return with_any.join(grouped, "row", "left").select("doc", "secret_scan").unionByName(
        found.filter(F.size("found") == 0).select("doc", F.lit(None).cast(grouped.schema["secret_scan"].dataType).alias("secret_scan"))
    ).select(
        "doc.*",
        F.struct(
            F.coalesce("secret_scan.base", none).alias("base"), F.coalesce("secret_scan.all", none).alias("all")
        ).alias(name),
    )


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """Counts and digests of the spans, by document; see scan() for the cases."""
    base, every = F.col("secret_scan.base"), F.col("secret_scan.all")
    number = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    return scan(docs, **options, keep=["doc_id"]).select(
        "doc_id",
        *(number(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.size(F.filter(every, lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter(every, lambda x: ~x["live"])).cast("long").alias("n_copied"),
    )


def redact(docs: DataFrame, **options) -> DataFrame:
    """`docs` with each found span replaced by REDACTED, overlapping ones as one.

    Texts without a span, null ones too, stay as they are. n_chars, where there
    is one, follows a changed text.
    """
    name, spans = f"scan_{uuid.uuid4().hex}", f"spans_{uuid.uuid4().hex}"
    ordered = F.array_sort(F.transform(f"{name}.all", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    text = F.col("text")

    def step(a, x, piece, first):
        """a: end of what is done, by code points of `piece`, which begins at `first`, and its parts."""
        begin, end = x["s"] - first, x["e"] - first
        parts = F.concat(a["out"], F.array(F.substring(piece, a["at"] + 1, begin - a["at"]), F.lit(REDACTED)))
        return F.struct(F.greatest(a["at"], end).alias("at"), F.when(begin >= a["at"], parts).otherwise(a["out"]).alias("out"))

    none = F.array().cast("array<string>")

    def block(a, xs):
        """a: end of what is done, the text after it, and the texts before."""
        until = F.greatest(a["at"], F.array_max(F.transform(xs, lambda x: x["e"])))
        piece = F.substring(a["rest"], F.lit(1), until - a["at"])
        cut = F.struct(until.alias("until"), piece.alias("piece"), F.substring(a["rest"], until - a["at"] + 1, F.length(a["rest"])).alias("rest"))
        inner = lambda c: F.aggregate(xs, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda b, x: step(b, x, c["piece"], a["at"]))
        return _let(cut, lambda c: F.struct(c["until"].alias("at"), c["rest"].alias("rest"), F.concat(a["out"], F.array(F.array_join(inner(c)["out"], ""))).alias("out")))

    changed = F.aggregate(
        _blocks(F.col(spans)),
        F.struct(F.lit(0).alias("at"), text.alias("rest"), none.alias("out")),
        block,
        lambda a: F.concat(F.array_join(a["out"], ""), a["rest"]),
    )
    hit = F.size(spans) > 0
    out = scan(docs, **options, name=name).withColumn(spans, ordered)
    new = {"text": F.when(hit, changed).otherwise(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length(changed).cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(columns_of(docs.columns))
