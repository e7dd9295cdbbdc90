"""Domain views over the generic tables, once as DataFrames and once as SQL of the same names."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF_TEXT = "1998-07-01 12:00:00"


def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("timestamp_ntz")


AS_OF = datetime(1998, 7, 1, 12)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def notice(spark: SparkSession, d: str) -> DataFrame:
    """Orders as notices of four sources, their customers as authorities."""
    o, c, n = (read(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    key = F.col("o_orderkey")
    wait = F.expr("make_dt_interval(cast(10 + o_orderkey % 90 as int), cast(o_orderkey % 24 as int))")
    status = F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("AMENDED")
    return j.select(
        key.alias("id"),
        F.concat(F.lit("n"), key % 5000).alias("source_id"),
        F.concat(F.lit("src"), key % 4).alias("source"),
        ((key % 4 + 1) * 10).alias("priority"),
        F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("title"),
        F.col("c_name").alias("authority"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("national_id"),
        F.col("n_name").alias("country"),
        F.array(F.lpad(key.cast("string"), 8, "0")).alias("cpv_codes"),
        F.to_date("o_orderdate").alias("publication_date"),
        F.when(key % 13 != 0, F.col("o_orderdate") + wait).alias("deadline"),
        F.when(key % 11 != 0, F.col("o_totalprice")).alias("estimated_value"),
        status.alias("status"),
        F.col("o_orderdate").alias("first_seen"),
        F.col("o_orderdate").alias("last_seen_at"),
        F.lit(True).alias("is_primary"),
    )


NOTICE = f"""
notice AS (SELECT o_orderkey AS id, 'n' || (o_orderkey % 5000) AS source_id, 'src' || (o_orderkey % 4) AS source,
  (o_orderkey % 4 + 1) * 10 AS priority, o_orderpriority || ' ' || c_mktsegment AS title, c_name AS authority, n_name AS country,
  lpad(o_orderkey::VARCHAR, 8, '0') AS code, o_orderdate::DATE AS publication_date,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate + to_days((10 + o_orderkey % 90)::INT) + to_hours((o_orderkey % 24)::INT) END AS deadline,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS estimated_value,
  CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'CLOSED' ELSE 'AMENDED' END AS status, o_orderdate AS last_seen_at,
  TIMESTAMP '{AS_OF_TEXT}' AS as_of
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def batch(spark: SparkSession, d: str) -> DataFrame:
    """A second delivery of the notices: some changed, some new."""
    n, key = notice(spark, d), F.col("id")
    return n.withColumns(
        {
            "deadline": F.when(key % 5 == 0, F.col("deadline") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("deadline")),
            "status": F.when(key % 7 == 0, F.lit("AMENDED")).otherwise(F.col("status")),
            "estimated_value": F.when(key % 9 != 0, F.col("estimated_value")),
            "id": F.when(key % 17 == 0, key + 1_000_000_000).otherwise(key),
        }
    )


BATCH = """
batch AS (SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN deadline + INTERVAL 1 DAY ELSE deadline END AS deadline,
  CASE WHEN id % 7 = 0 THEN 'AMENDED' ELSE status END AS status, CASE WHEN id % 9 <> 0 THEN estimated_value END AS estimated_value,
  CASE WHEN id % 17 = 0 THEN id + 1000000000 ELSE id END AS id) FROM notice)"""


def item(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as items of tenders."""
    line, p = read(spark, d, "lineitem"), read(spark, d, "part")
    return line.join(p, line["l_partkey"] == p["p_partkey"]).select(
        F.col("l_orderkey").alias("tender_id"),
        F.col("l_linenumber").alias("ord"),
        F.concat(F.col("l_linenumber"), F.lit("."), F.col("p_size")).alias("position"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("manufacturer"),
        F.col("p_type").alias("model_number"),
        F.col("l_quantity").alias("quantity"),
        F.element_at(F.array(*map(F.lit, ("Stk", "Meter", "kg.", "Kiste", "VPE"))), (F.col("p_size") % 5 + 1).cast("int")).alias("unit_original"),
        (F.col("l_discount") > 0.05).alias("estimated"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
    )


ITEM = """
item AS (SELECT l_orderkey AS tender_id, l_linenumber AS ord, l_linenumber || '.' || p_size AS position, p_name AS title, p_brand AS manufacturer,
  p_type AS model_number, l_quantity AS quantity, (['Stk', 'Meter', 'kg.', 'Kiste', 'VPE'])[p_size % 5 + 1] AS unit_original,
  (['STK', 'M', 'KG', NULL, 'PCK'])[p_size % 5 + 1] AS unit, l_discount > 0.05 AS estimated FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def quote(spark: SparkSession, d: str) -> DataFrame:
    """What each supplier asks for a part, with two tiers."""
    line, p = read(spark, d, "lineitem"), read(spark, d, "part")
    per = line.groupBy("l_partkey", "l_suppkey").agg(F.min("l_tax").alias("tax")).join(p, F.col("l_partkey") == p["p_partkey"])
    amount = F.col("p_retailprice") + (F.col("l_suppkey") * 37 % 200)
    basis = F.when(F.col("l_suppkey") % 3 == 0, "NET").when(F.col("l_suppkey") % 3 == 1, "GROSS").otherwise("UNKNOWN")
    tier = lambda q, f: F.struct(F.lit(float(q)).alias("min_quantity"), (F.col("amount") * f).alias("amount"))
    return per.select(
        F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), amount.alias("amount"), basis.alias("basis"),
        F.when(F.col("l_suppkey") % 7 != 0, F.col("tax")).alias("vat_rate"),
    ).withColumn("tiers", F.array(tier(20, 0.95), tier(40, 0.90)))


QUOTE = """
quote AS (SELECT l_partkey AS partkey, l_suppkey AS suppkey, any_value(p_retailprice) + (l_suppkey * 37 % 200) AS amount,
  CASE l_suppkey % 3 WHEN 0 THEN 'NET' WHEN 1 THEN 'GROSS' ELSE 'UNKNOWN' END AS basis, CASE WHEN l_suppkey % 7 <> 0 THEN min(l_tax) END AS vat_rate
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey, l_suppkey)"""


def product(spark: SparkSession, d: str) -> DataFrame:
    """Parts as items to be priced."""
    return read(spark, d, "part").select(
        F.col("p_partkey").alias("item_id"),
        (F.col("p_partkey") % 97).alias("tender_id"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("manufacturer"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("model_number"),
        F.lit(None).cast("string").alias("article_number"),
        F.when(F.col("p_partkey") % 10 == 0, "M").otherwise("STK").alias("unit"),
        (F.col("p_partkey") % 2 == 1).alias("brand_locked"),
        F.col("p_size").cast("double").alias("quantity"),
    )


def offer(spark: SparkSession, d: str) -> DataFrame:
    """A price list: one entry for each maker and model."""
    per = read(spark, d, "part").groupBy("p_brand", "p_type").agg(
        F.min("p_name").alias("product_name"), F.min("p_retailprice").alias("amount"), F.max("p_size").alias("size"), F.count(F.lit(1)).alias("n")
    )
    return per.select(
        F.concat_ws("|", "p_brand", "p_type").alias("quote_id"),
        "product_name",
        F.col("p_brand").alias("manufacturer"),
        F.col("p_type").alias("model_number"),
        F.lit(None).cast("string").alias("article_number"),
        F.when(F.col("n") % 5 != 0, F.col("amount")).alias("amount"),
        F.when(F.col("n") % 4 == 0, "USD").otherwise("EUR").alias("currency"),
        F.when(F.col("size") % 3 == 0, "NET").when(F.col("size") % 3 == 1, "GROSS").otherwise("UNKNOWN").alias("basis"),
        F.when(F.col("size") % 2 == 0, F.lit(0.25)).alias("vat_rate"),
        F.lit("STK").alias("q_unit"),
    )


#: Items and offers as SQL; names here are two words, so that tokens are their stems.
PRODUCT = """
product AS (SELECT p_partkey AS item_id, p_partkey % 97 AS tender_id, p_name AS title, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS maker,
  CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS model, CASE WHEN p_partkey % 10 = 0 THEN 'M' ELSE 'STK' END AS unit,
  p_partkey % 2 = 1 AS brand_locked, p_size::DOUBLE AS quantity FROM part),
offer AS (SELECT p_brand || '|' || p_type AS quote_id, min(p_name) AS product_name, p_brand AS q_maker, p_type AS q_model,
  CASE WHEN count(*) % 5 <> 0 THEN min(p_retailprice) END AS amount, CASE WHEN count(*) % 4 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
  CASE max(p_size) % 3 WHEN 0 THEN 'NET' WHEN 1 THEN 'GROSS' ELSE 'UNKNOWN' END AS basis,
  CASE WHEN max(p_size) % 2 = 0 THEN 0.25::DOUBLE END AS vat_rate FROM part GROUP BY p_brand, p_type)"""


def sql_norm(x: str) -> str:
    """``normalize_text`` for DuckDB: groups of digits are marked before the separators go, twice for chains."""
    y = f"lower(coalesce({x}, ''))"
    for a, b in (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        y = f"replace({y}, '{a}', '{b}')"
    y = f"strip_accents({y})"
    for _ in range(2):
        y = f"regexp_replace({y}, '(\\d)[.  ](\\d{{3}})([^\\d]|$)', '\\1' || chr(1) || '\\2\\3', 'g')"
    y = f"regexp_replace(replace({y}, chr(1), ''), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
    return f"trim(regexp_replace({y}, '\\s+', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    """``tokens`` for DuckDB."""
    from procura.functions import constants as C

    words = ", ".join(f"'{w}'" for w in C.STOPWORDS)
    ends = " ".join(f"WHEN length(t) - {len(e)} >= 4 AND t LIKE '%{e}' THEN left(t, length(t) - {len(e)})" for e in C.ENDINGS)
    some = f"list_filter(regexp_extract_all({sql_norm(x)}, '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({words}))"
    return f"list_distinct(list_transform({some}, lambda t: CASE WHEN length(t) <= 4 THEN t {ends} ELSE t END))"
