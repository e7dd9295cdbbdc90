"""Offers for items: candidates by equi joins, an explained score, ranks, net price statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from procura.functions.amounts import amount_for, net_amount
from procura.functions.text import normalize_identifier, normalize_text, overlap, tokens
from procura.params import DEFAULTS, Params


def with_item_keys(items: DataFrame) -> DataFrame:
    return items.withColumns(
        {
            "i_article": F.nullif(normalize_identifier(F.col("article_number")), F.lit("")),
            "i_model": F.nullif(normalize_identifier(F.col("model_number")), F.lit("")),
            "i_maker": F.nullif(normalize_text(F.col("manufacturer")), F.lit("")),
            "i_name": normalize_text(F.col("title")),
            "i_tokens": tokens(F.col("title")),
        }
    )


def with_quote_keys(quotes: DataFrame) -> DataFrame:
    return quotes.withColumns(
        {
            "q_article": F.nullif(normalize_identifier(F.col("article_number")), F.lit("")),
            "q_model": F.nullif(normalize_identifier(F.col("model_number")), F.lit("")),
            "q_maker": F.nullif(normalize_text(F.col("manufacturer")), F.lit("")),
            "q_name": normalize_text(F.col("product_name")),
            "q_tokens": tokens(F.col("product_name")),
        }
    )


def candidates(items: DataFrame, quotes: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Pairs ``(item_id, quote_id)`` that share an article number, a model, or enough words.

    Three equi joins instead of all pairs.  Words are joined by distinct name, not by row: an inverted index of the
    names' tokens counts what two names share, and only then rows come in.
    """
    i, q = with_item_keys(items), with_quote_keys(quotes)
    pair = ["item_id", "quote_id"]
    by_article = i.select("item_id", "i_article").join(q.select("quote_id", "q_article"), F.col("i_article") == F.col("q_article")).select(*pair)
    by_model = i.select("item_id", "i_model").join(q.select("quote_id", "q_model"), F.col("i_model") == F.col("q_model")).select(*pair)
    left = i.select("i_name", F.array_sort("i_tokens").alias("i_tokens")).distinct()
    right = q.select("q_name", F.array_sort("q_tokens").alias("q_tokens")).distinct()
    names = (
        left.select("i_name", F.size("i_tokens").alias("n_i"), F.explode("i_tokens").alias("token"))
        .join(right.select("q_name", F.size("q_tokens").alias("n_q"), F.explode("q_tokens").alias("token")), "token")
        .groupBy("i_name", "q_name", "n_i", "n_q")
        .agg(F.count(F.lit(1)).alias("shared"))
        .where(F.col("shared") / F.least("n_i", "n_q") >= p.minimum_similarity)
        .select("i_name", "q_name")
    )
    by_name = i.select("item_id", "i_name").join(names, "i_name").join(q.select("quote_id", "q_name"), "q_name").select(*pair)
    return by_article.union(by_model).union(by_name).distinct()


def _truth(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def score(pairs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds ``score, reasons, concerns`` to item-quote rows that have both sides' keys.

    Needs ``brand_locked, unit, q_unit, amount, currency, basis, vat_rate`` besides.
    """
    article = _truth(F.col("i_article") == F.col("q_article"))
    maker = _truth(F.col("i_maker") == F.col("q_maker"))
    model = _truth(F.col("i_model") == F.col("q_model"))
    ov = overlap(F.col("i_tokens"), F.col("q_tokens"))
    pairs = pairs.withColumn("overlap", ov)
    o = F.col("overlap")
    # Points of what agrees, and caps of what does not.
    ladder = F.when(article, 95).when(maker & model, 85).when(model, 65).when(maker, 35).otherwise(0)
    pairs = pairs.withColumn("ladder", ladder)
    base = F.col("ladder")
    similar = o >= p.minimum_similarity
    same_name = (F.col("i_name") != "") & (F.col("i_name") == F.col("q_name"))
    with_name = (
        F.when(similar & (base == 0) & same_name, 75)
        .when(similar & (base == 0), F.least(F.lit(60), F.bround(o * 60, 0).cast("int")))
        .when(similar, F.least(F.lit(p.max_confidence), base + 5))
        .otherwise(base)
    )
    brand = _truth(F.col("brand_locked") & F.col("i_maker").isNotNull() & F.col("q_maker").isNotNull() & ~maker)
    unit = _truth(F.col("unit") != F.col("q_unit"))
    s = F.when(brand, F.least(with_name, F.lit(20))).otherwise(with_name)
    s = F.when(unit, F.least(s, F.lit(55))).otherwise(s)
    priced = F.col("amount").isNotNull() & F.col("currency").isNotNull()
    net = net_amount(F.col("amount"), F.col("basis"), F.col("vat_rate"))
    reasons = F.array_compact(
        F.array(
            F.when(article, "article number equal").when(maker & model, "maker and model equal").when(model, "model equal").when(maker, "maker equal"),
            F.when(similar & (base == 0) & same_name, "name equal").when(similar & (base == 0), "name similar").when(similar, "name supports"),
        )
    )
    concerns = F.array_compact(
        F.array(
            F.when(~similar & (base > 0), "names differ"),
            F.when(brand, "brand lock not met"),
            F.when(unit, "unit differs"),
            F.when(~priced, "no price").when(net["reason"].isNotNull(), net["reason"]),
        )
    )
    return pairs.withColumns({"score": F.greatest(F.lit(0), F.least(F.lit(p.max_confidence), s)), "reasons": reasons, "concerns": concerns})


def rank(scored: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The best ``max_offers`` offers of each item: score, then amount, where none and zero come last, then the quote."""
    price = F.when(F.coalesce("amount", F.lit(0.0)) == 0, F.lit(float("inf"))).otherwise(F.col("amount"))
    w = W.partitionBy("item_id").orderBy(F.col("score").desc(), price, "quote_id")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= p.max_offers)


def best_match(ranked: DataFrame) -> DataFrame:
    """The offer with a price that has the highest score, then the least amount (zero counts as zero), then rank."""
    b = ranked.where("amount IS NOT NULL").groupBy("item_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "amount", "rank", "quote_id")).alias("b"))
    return b.select("item_id", "b.quote_id", (-F.col("b.s")).alias("score"), "b.amount")


def net_for_quantity(amount: Column, tiers: Column, quantity: Column, basis: Column, vat: Column) -> Column:
    return net_amount(amount_for(amount, tiers, quantity), basis, vat)["net"]


def price_statistics(ranked: DataFrame, p: Params = DEFAULTS, currencies: tuple[str, ...] = ()) -> DataFrame:
    """A row an item: offers, usable ones, leading currency, least, median, greatest net price, spread, warnings.

    ``ranked`` has ``item_id, rank, score, net, currency``.  Usable is an offer of the least score with a net price and
    an allowed currency; the most frequent currency leads (the first in rank among equals), others are left out.
    """
    cur = F.upper("currency")
    ok = (F.col("score") >= p.minimum_confidence) & F.col("net").isNotNull() & cur.isNotNull()
    if currencies:
        ok = ok & cur.isin(*[c.upper() for c in currencies])
    rows = ranked.withColumns({"cur": cur, "ok": F.coalesce(ok, F.lit(False))})
    w = W.partitionBy("item_id", "cur")
    rows = rows.withColumns({"n_cur": F.sum(F.col("ok").cast("int")).over(w), "first": F.min(F.when(F.col("ok"), F.col("rank"))).over(w)})
    lead = F.min(F.when(F.col("ok"), F.struct(-F.col("n_cur"), "first", "cur"))).over(W.partitionBy("item_id"))["cur"]
    rows = rows.withColumn("lead", lead)
    used = F.when(F.col("ok") & (F.col("cur") == F.col("lead")), F.col("net"))
    out = rows.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("offer_count"),
        F.count(used).alias("usable_count"),
        F.max("lead").alias("currency"),
        F.min(used).alias("minimum"),
        F.median(used).alias("median"),
        F.max(used).alias("maximum"),
        F.max("score").alias("best_score"),
    )
    out = out.withColumn("spread_ratio", F.when(F.col("median") != 0, (F.col("maximum") - F.col("minimum")) / F.col("median")))
    warnings = F.array_compact(
        F.array(
            F.when((F.col("usable_count") == 0) & (F.col("best_score") < p.minimum_confidence), "best offer is under the least score")
            .when(F.col("usable_count") == 0, "no offer can be calculated with")
            .when(F.col("usable_count") == 1, "single offer"),
            F.when(F.col("spread_ratio") > p.spread_warning, "prices spread widely"),
        )
    )
    return out.withColumn("warnings", warnings)


def coverage(items: DataFrame, stats: DataFrame) -> DataFrame:
    """A row a tender: items, priced and usable ones, coverage in percent (half to even)."""
    j = items.select("tender_id", "item_id").join(stats, "item_id", "left")
    usable = F.count_if(F.coalesce("usable_count", F.lit(0)) > 0)
    out = j.groupBy("tender_id").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.coalesce("offer_count", F.lit(0)) > 0).alias("n_priced"), usable.alias("n_usable"))
    return out.withColumn("coverage_percent", F.bround(F.col("n_usable") * 100 / F.col("n_items"), 0).cast("int"))
