"""Secret scan with corpus-wide ownership frequency, inside the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.llm.common import cut, table

#: Kinds in the order that breaks ties of a start: pattern, group with the credential, least length of that group.
#: Letter classes are spelled out, so that no other letter folds into them.
_KEY = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
BASE = {
    "assign": (rf"(?:{_KEY}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 16),
    "hex": (r"([0-9a-f]{32,})", 1, 32),  # a maximal run of 32 or more, as a longest match is
}
#: What the method adds.
MORE = {
    # At the start of a token only, and without going back: linear in any text.
    "jwt": (r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++)", 1, 20),
    "vendor": (r"(?<![A-Za-z0-9_-])((?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_)[A-Za-z0-9_-]{16,}+)", 1, 16),
    "pem": (r"(-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----)", 1, 20),
}
KINDS = {**BASE, **MORE}
#: A value that this many owners have, or this many repositories of one owner, is an example or a template that people copy.
COPIED_OWNERS, COPIED_REPOS = 2, 3
#: A value of one owner looks live if it has bits of entropy enough a character, and no word of a placeholder.
MIN_ENTROPY = 3.0
PLACEHOLDER = "(?i)" + "|".join(
    ("example", "sample", "change_?me", "placeholder", "dummy", "fake", "insert", "replace", "your_?", "xxxx", "test", "todo", "redacted")
    + ("abcdefgh", "12345678", "password", "passwd", "secret")
)


#: The characters that values are made of; others are counted one by one too.
ALPHABET = string.ascii_letters + string.digits + "+/_.=-"
#: Entropy is judged on this many characters of a value: all of them.
LOOKED_AT = None


def entropy(value: Column) -> Column:
    """Shannon's entropy of a whole value in bits a character; a search for each character, no array of them all."""
    others = F.filter(F.split(F.translate(value, ALPHABET, ""), ""), lambda c: c != "")
    chars = F.concat(F.array(*[F.lit(c) for c in ALPHABET]), F.array_distinct(others))
    n = F.length(value)
    counts = F.filter(F.transform(chars, lambda c: n - F.length(F.replace(value, c, F.lit("")))), lambda x: x > 0)
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a - x / n * F.log2(x / n))


def looks_live(value: Column, kind: Column) -> Column:
    """A key's header says nothing of the key and always counts; other values by placeholder words and entropy."""
    return F.when(kind == "pem", F.lit(True)).otherwise(~value.rlike(PLACEHOLDER) & (entropy(value) >= MIN_ENTROPY))


def _found(kind: str) -> Column:
    """``array<struct<start, stop, value>>`` of a kind in ``text``; offsets are code points.

    What lies between matches and the matches themselves come from the same expression, so that running sums of
    their lengths are the offsets.  Sums go over blocks of 256 first: linear in the matches but for that factor.
    """
    pattern, group, _ = KINDS[kind]
    return F.when(
        F.col("text").rlike(pattern),
        F.arrays_zip(
            F.transform(F.split("text", pattern, -1), F.length).alias("gap"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("match"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("value"),
        ),
    )


def spans(docs: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """``doc_id, th, repo, owner, spans``: ``spans`` is ``array<struct<start, kind, stop, name, digest, live>>`` in order."""
    keep = ["doc_id", "th", "repo", "owner"]
    d = docs.select(
        "doc_id",
        repo.alias("repo"),
        owner.alias("owner"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("th", F.xxhash64("text"))
    d = d.select(*keep, F.inline(F.array(F.struct(*[_found(k).alias(k) for k in KINDS]))))

    def placed(i: int, kind: str) -> Column:
        least = KINDS[kind][2]
        step = lambda x: x["gap"] + F.coalesce(F.length(x["match"]), F.lit(0))
        whole = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + step(x))
        block = F.sequence(F.lit(0), F.floor((F.size(kind) - 1) / 256).cast("int"))
        sums = F.aggregate(
            F.transform(block, lambda b: whole(F.slice(kind, b * 256 + 1, 256))),
            F.array(F.lit(0)),
            lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)),
        )
        # One pass: struct(blocks' offsets) is evaluated once per row, as the only element of an outer array.
        inner = F.transform(
            F.array(sums),
            lambda s: F.transform(
                kind,
                lambda x, j: F.struct(
                    (
                        F.get(s, F.floor(j / 256).cast("int"))
                        + whole(F.slice(kind, F.floor(j / 256).cast("int") * 256 + 1, j % 256))
                        + x["gap"]
                    ).alias("start"),
                    x["match"].alias("match"),
                    x["value"].alias("value"),
                ),
            ),
        )
        good = F.filter(F.get(inner, F.lit(0)), lambda x: F.length(x["value"]) >= least)
        return F.when(
            F.col(kind).isNotNull(),
            F.transform(
                good,
                lambda x: F.struct(
                    x["start"].alias("start"),
                    F.lit(i).alias("kind"),
                    (x["start"] + F.length(x["match"])).alias("stop"),
                    F.lit(kind).alias("name"),
                    F.sha2(x["value"], 256).alias("digest"),
                    looks_live(x["value"], F.lit(kind)).alias("live"),
                ),
            ),
        )

    arrays = [placed(i, k) for i, k in enumerate(KINDS)]
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,name:string,digest:string,live:boolean>>")
    return d.select(*keep, F.array_sort(F.concat(*[F.coalesce(a, none) for a in arrays])).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """``digest, n_places, n_repos, n_owners`` of the candidate hashes of ``spans()``.

    Places are counted per repository and owner before the shuffle, so that a value that a third of all documents
    hold costs a row for each task and owner.  A null repository or owner counts as one of its own.
    """
    by_owner = found.groupBy("digest", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit("\0")
    return by_owner.groupBy("digest").agg(
        F.sum("n").alias("n_places"),
        F.count_distinct(F.coalesce("repo", none)).alias("n_repos"),
        F.count_distinct(F.coalesce("owner", none)).alias("n_owners"),
    )


def scan(docs: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """Secrets of each row of ``docs(doc_id, text, ...)`` and what the corpus says of their values.

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` and, by ownership and looks, how many spans are
    ``n_copied`` (several owners have the value, or ``COPIED_REPOS`` repositories of one), ``n_live`` (one owner's, and it
    looks like a credential) and ``n_weak`` (one owner's, but a placeholder or of little entropy); ``live_spans``; and
    ``owners``, the distinct ``repositories/owners`` of each span's value, in the order of ``spans``.  Null texts are empty
    and have no span; a null repository or owner counts as one of its own; rows of one id and text give the same; other
    columns are ignored; an empty table gives an empty one.
    """
    rows = cut(spans(docs, repo, owner), "secret-spans")
    found = rows.where(F.size("spans") > 0).select("doc_id", "th", "repo", "owner", F.inline("spans"))
    copied = (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repos") >= COPIED_REPOS)
    stats = ownership(found).select("digest", copied.alias("copied"), F.concat_ws("/", "n_repos", "n_owners").alias("owners"))
    places = found.select("doc_id", "th", "start", "kind", "stop", "name", "digest", "live").join(stats, "digest")
    text = F.concat_ws(":", "name", "start", "stop")
    by_doc = (
        places.groupBy("doc_id", "th")
        .agg(F.collect_set(F.struct("start", "kind", text.alias("span"), "copied", "live", "owners")).alias("all"))
        .select("doc_id", "th", F.array_sort("all").alias("all"))
    )
    r, p = rows.alias("r"), by_doc.alias("p")
    on = F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("r.th") == F.col("p.th"))
    joined = r.join(p, on, "left").select("r.doc_id", "spans", "all")

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def listed(only: int) -> Column:
        some = F.filter("spans", lambda s: s["kind"] < only)
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["name"], s["start"], s["stop"])), ",")

    every = F.coalesce("all", F.array().cast("array<struct<start:int,kind:int,span:string,copied:boolean,live:boolean,owners:string>>"))
    own = F.filter(every, lambda s: ~s["copied"])
    live = F.filter(own, lambda s: s["live"])
    return joined.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(len(BASE)), 256).alias("base_sha256"),
        listed(len(KINDS)).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        (F.size(own) - F.size(live)).cast("long").alias("n_weak"),
        (F.size(every) - F.size(own)).cast("long").alias("n_copied"),
        F.array_join(F.transform(live, lambda s: s["span"]), ",").alias("live_spans"),
        F.array_join(F.transform(every, lambda s: s["owners"]), ",").alias("owners"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source owns it; a source's languages stand for its repositories."""
    repo = F.concat_ws("/", F.coalesce("source", F.lit("\0")), F.coalesce("lang", F.lit("\0")))
    return scan(table(spark, sf_dir, "documents"), repo, F.col("source"))
