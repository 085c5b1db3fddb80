"""Trees as text: indented lists, Newick, graph descriptions, JSON; and reference lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_indented(spark: SparkSession, path: str) -> DataFrame:
    """id (line number), parent_id, depth, name, kind and extinct of a text tree.

    Two blanks a level. A leading = or * marks a synonym, $ a basionym, a dagger
    an extinct taxon. The tree is one document and is read as one.
    """
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("id", "line"))
    rows = rows.filter(F.trim("line") != "")
    indent = F.length("line") - F.length(F.ltrim("line"))
    body = F.trim("line")
    rows = rows.select(
        "id",
        (F.floor(indent / 2) + 1).cast("int").alias("depth"),
        F.trim(F.regexp_replace(body, "^[=*$†‡]+", "")).alias("name"),
        F.when(body.rlike("^[=*]"), "synonym").when(body.startswith("$"), "basionym").otherwise("accepted").alias("kind"),
        body.rlike("^[=*$]*[†‡]").alias("extinct"),
    )
    # The parent is the last line before that lies one level up: each line stands once
    # for itself, and once as a parent among the lines of the next level.
    parents = rows.select((F.col("depth") + 1).alias("depth"), "id", F.col("id").alias("_parent"))
    both = rows.unionByName(parents, allowMissingColumns=True)
    before = Window.partitionBy("depth").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    placed = both.withColumn("parent_id", F.last("_parent", ignorenulls=True).over(before))
    return placed.filter("_parent is null").drop("_parent")


def render_indented(paths: DataFrame, label: Column, order: list[str]) -> DataFrame:
    """line: labels indented by depth, in depth-first order; carried columns in `order` sort siblings."""
    walk = F.transform("path", lambda p: F.struct(*(p[c] for c in order), p["id"]))
    text = F.concat(F.repeat(F.lit(" "), 2 * (F.col("depth") - 1)), label)
    return paths.orderBy(walk).select(text.alias("line"))


def render_nested(paths: DataFrame, label: Column, leaf: str, joined: str, order: list[str]) -> DataFrame:
    """text: one for each root, folded from the deepest level upwards.

    `leaf` and `joined` are format strings of the label, and of the children's
    texts and the label. A level's children are gathered by parent, in order.
    """
    from ..lineage import settle

    deepest = paths.agg(F.max("depth")).first()[0] or 0
    rows = settle(paths.select("id", "parent_id", "depth", label.alias("label"), F.struct(*order, "id").alias("_o")))
    below = None
    for depth in range(deepest, 0, -1):
        here = rows.filter(F.col("depth") == depth)
        if below is None:
            out = here.withColumn("text", F.format_string(leaf, "label"))
        else:
            gathered = below.groupBy(F.col("parent_id").alias("id")).agg(
                F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "text"))), lambda c: c["text"]), ",").alias("inner")
            )
            out = here.join(gathered, "id", "left").withColumn(
                "text",
                F.when(F.col("inner").isNull(), F.format_string(leaf, "label")).otherwise(F.format_string(joined, "inner", "label")),
            )
        below = settle(out.select("id", "parent_id", "_o", "text"))
    return below.select("text") if below is not None else paths.select(F.lit("").alias("text"))


def newick(paths: DataFrame, label: Column, order: list[str]) -> DataFrame:
    quoted = F.concat(F.lit("'"), F.replace(label, F.lit("'"), F.lit("''")), F.lit("'"))
    return render_nested(paths, F.when(label.rlike(r"[\s()\[\]:;,']"), quoted).otherwise(label), "%s", "(%s)%s", order).select(
        F.concat("text", F.lit(";")).alias("text")
    )


def nested_json(paths: DataFrame, name: str, order: list[str]) -> DataFrame:
    fields = F.regexp_replace(F.to_json(F.struct(F.col("id"), F.col(name).alias("name"))), r"\}$", "")
    return render_nested(paths, fields, "%s}", '%2$s,"children":[%1$s]}', order)


def graph_lines(nodes: DataFrame, label: Column, synonym: Column) -> DataFrame:
    """line: the nodes and edges of a graph description, without its first and last line."""
    own = nodes.select(F.format_string('  n%s [label="%s"]', "id", F.replace(label, F.lit('"'), F.lit('\\"'))).alias("line"))
    kind = F.when(synonym, "synonym_of").otherwise("parent_of")
    edges = nodes.filter("parent_id is not null").select(F.format_string("  n%s -> n%s [type=%s]", "parent_id", "id", kind).alias("line"))
    return own.unionByName(edges)


def parse_newick(text: str) -> list[tuple[int, int | None, str]]:
    """(id, parent, label) of each node of one Newick tree, ids in order of their opening."""
    nodes: list[list] = [[0, None, ""]]
    current = 0
    for token in re.findall(r"'(?:[^']|'')*'|\[[^\]]*\]|[(),;]|[^(),;'\[\]]+", text):
        if token == "(":
            nodes.append([len(nodes), current, ""])
            current = len(nodes) - 1
        elif token == ",":
            nodes.append([len(nodes), nodes[current][1], ""])
            current = len(nodes) - 1
        elif token == ")":
            current = nodes[current][1]
        elif token != ";" and not token.startswith("["):
            plain = token[1:-1].replace("''", "'") if token.startswith("'") else token.strip().partition(":")[0]
            nodes[current][2] = nodes[current][2] or plain
    return [tuple(n) for n in nodes]


@F.udtf(returnType="id int, parent_id int, label string")
class NewickNodes:
    """Table function over Newick texts; a row for each node."""

    def eval(self, text: str):
        if text:
            yield from parse_newick(text)


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """key, kind and a map of fields of the entries of BibTeX files, each file one text."""
    entry = r"(?s)@(\w+)\s*\{\s*([^,\s]+)\s*,(.*?)\n\s*\}"
    texts = spark.read.text(path, wholetext=True)
    entries = texts.select(F.explode(F.regexp_extract_all("value", F.lit(entry), F.lit(0))).alias("e"))
    body = F.regexp_extract("e", entry, 3)
    field = r'(?s)(\w+)\s*=\s*(?:\{((?:[^{}]|\{[^{}]*\})*)\}|"([^"]*)"|(\d+))'
    found = F.regexp_extract_all(body, F.lit(field), F.lit(0))
    pair = lambda f: F.struct(
        F.lower(F.regexp_extract(f, field, 1)),
        F.regexp_replace(F.concat(*(F.regexp_extract(f, field, i) for i in (2, 3, 4))), r"[{}]|\s+(?=\s)", ""),
    )
    return entries.select(
        F.regexp_extract("e", entry, 2).alias("key"),
        F.lower(F.regexp_extract("e", entry, 1)).alias("kind"),
        F.map_from_entries(F.transform(found, pair)).alias("fields"),
    )


def read_json_references(spark: SparkSession, path: str) -> DataFrame:
    """References as JSON, an array or one to a line."""
    return spark.read.json(path, multiLine=True)


def citation_key(citation: Column) -> Column:
    """A citation by its letters and digits, for finding the same reference again."""
    from ..functions.scalars import digits_or_ascii_letters

    return F.replace(digits_or_ascii_letters(citation), F.lit(" "), F.lit(""))
