"""Scalar functions over columns of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, ids, parsers
from ..functions import scalars as f
from .registry import registrar, tables

REGISTRY, query = registrar()


_SPELLED_SQL = "text"
for _mark, _plain in f.LIGATURES.items():
    _SPELLED_SQL = f"replace({_SPELLED_SQL}, '{_mark}', '{_plain}')"


@query(f"SELECT doc_id, strip_accents({_SPELLED_SQL}) AS plain FROM documents")
def unaccented_text(spark, folder):
    """Whole texts of all rows."""
    (docs,) = tables(spark, folder, "documents")
    return docs.select("doc_id", f.unaccent(F.col("text")).alias("plain"))


@query(f"SELECT lang, count(*) AS n, sum(length(strip_accents({_SPELLED_SQL})))::BIGINT AS letters FROM documents GROUP BY 1")
def unaccented_text_all(spark, folder):
    """Lengths of the whole texts without accents, by language."""
    (docs,) = tables(spark, folder, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length(f.unaccent(F.col("text")))).alias("letters"))


@query(r"""SELECT c_custkey, nullif(upper(trim(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g'))), '') AS skeleton, replace(replace(replace(c_name, '\', '\\'), '%', '\%'), '_', '\_') AS escaped,
  regexp_replace(c_name, '[^A-Za-z0-9]+', '', 'g') AS bare, lpad(c_custkey::VARCHAR, 12, '0') AS padded FROM customer""")
def text_skeletons(spark, folder):
    (customer,) = tables(spark, folder, "customer")
    name = F.col("c_name")
    return customer.select(
        "c_custkey", f.digits_or_ascii_letters(name).alias("skeleton"), f.escape_like(name).alias("escaped"),
        f.remove_punctuation_and_space(name).alias("bare"), f.pad_zero(F.col("c_custkey"), 12).alias("padded"),
    )


@query("""SELECT o_orderkey, TRY_CAST(o_orderpriority[1:1] AS INTEGER) AS level, year(o_orderdate)::INTEGER AS year, o_orderpriority NOT LIKE '%-%' AS plain FROM orders""")
def parsed_numbers(spark, folder):
    (orders,) = tables(spark, folder, "orders")
    return orders.select(
        "o_orderkey", f.parse_int(F.substring("o_orderpriority", 1, 1)).alias("level"),
        dates.year(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"), (~F.col("o_orderpriority").contains("-")).alias("plain"),
    )


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, length(url)::INTEGER AS size FROM pages""")
def url_hosts(spark, folder):
    (pages,) = tables(spark, folder, "pages")
    return pages.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.length(parsers.uri(F.col("url"))).alias("size"))


@query("""SELECT p_partkey, hex(p_partkey) AS hexed, p_partkey AS again FROM part""")
def identifier_round_trip(spark, folder):
    """Ids in another alphabet and back."""
    (part,) = tables(spark, folder, "part")
    key = F.col("p_partkey")
    return part.select("p_partkey", ids.encode_id(key, ids.HEX).alias("hexed"), ids.decode_id(ids.encode_id(key)).alias("again"))


@query("SELECT p_partkey, p_partkey AS again FROM part")
def proquint_round_trip(spark, folder):
    (part,) = tables(spark, folder, "part")
    return part.select("p_partkey", ids.from_proquint(ids.proquint(F.col("p_partkey"))).alias("again"))


@query("""SELECT o_orderkey, (year(o_orderdate) * 10000 + month(o_orderdate) * 100)::INTEGER AS code, date_trunc('month', o_orderdate)::DATE AS first_day FROM orders""")
def partial_dates(spark, folder):
    """Dates without a day, as numbers and as their first day."""
    (orders,) = tables(spark, folder, "orders")
    d = dates.fuzzy_date(F.date_format("o_orderdate", "yyyy-MM"))
    return orders.select("o_orderkey", dates.fuzzy_to_int(d).alias("code"), dates.fuzzy_start(d).alias("first_day"))


@query("""SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1997 THEN 'EQUAL' WHEN abs(year(o_orderdate) - 1997) <= 2 THEN 'UNKNOWN' ELSE 'DIFFERENT' END AS same_year FROM orders""")
def compared_years(spark, folder):
    (orders,) = tables(spark, folder, "orders")
    return orders.select("o_orderkey", dates.compare_years(F.year("o_orderdate"), F.lit(1997)).alias("same_year"))


@query("""SELECT p_partkey, list_aggregate(list_sort(list_distinct(string_split(p_name, ''))), 'string_agg', '') AS letters, replace(p_type, ' ', '') AS run FROM part""")
def character_sets(spark, folder):
    (part,) = tables(spark, folder, "part")
    return part.select("p_partkey", F.array_join(f.character_set(F.col("p_name")), "").alias("letters"), f.remove_space(F.col("p_type")).alias("run"))


@query("""SELECT conv_id, turn, length(trim(regexp_replace(text, '\\s+', ' ', 'g')))::INTEGER AS size, regexp_matches(trim(text), '\\S\\s+\\S') AS several FROM conversations""")
def cleaned_cells(spark, folder):
    (rows,) = tables(spark, folder, "conversations")
    return rows.select("conv_id", "turn", F.length(f.clean_cell(F.col("text"))).alias("size"), f.multi_word(F.col("text")).alias("several"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN true ELSE false END AS flag, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE (s_suppkey % 3)::BIGINT END AS n FROM supplier""")
def typed_parsers(spark, folder):
    (supplier,) = tables(spark, folder, "supplier")
    word = F.when(F.col("s_acctbal") > 0, "yes").otherwise("Nein")
    number = F.when(F.col("s_suppkey") % 3 == 0, "x").otherwise((F.col("s_suppkey") % 3).cast("string"))
    return supplier.select("s_suppkey", parsers.boolean(word).alias("flag"), parsers.integer(number).alias("n"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FINAL' WHEN 'O' THEN 'OPEN' END AS status, o_orderstatus NOT IN ('F', 'O') AS bad FROM orders""")
def vocabulary_parser(spark, folder):
    """Texts to constants by a dictionary, with an issue for unknown ones."""
    (orders,) = tables(spark, folder, "orders")
    words = spark.createDataFrame([("f", "FINAL"), ("O", "OPEN"), ("f.", "FINAL")], "text string, constant string")
    return parsers.parse_terms(orders, "o_orderstatus", words, "status", "bad").select("o_orderkey", "status", "bad")
