"""Line-first quality rules."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.llm.common import pieces, table, utf8

MIN_WORDS = 20
REPEAT_PERCENT = 30
GRAM = 8
LOST_PERCENT = 50  # of a text's word characters; a document whose failing lines hold more is rejected
SYMBOL_PERCENT = 10  # of a line's word characters

SYMBOLS = re.compile(rb"[#*$%&|<>]")
NAVIGATION = re.compile(
    rb"(?i)^[\x20\t]*((home|about us|about|contact|log ?in|sign ?up|search|menu|next|previous|back to top|sitemap)"
    rb"[\x20\t|>/,-]*)+$"
)
BOILERPLATE = re.compile(
    rb"(?i)all rights reserved|cookie policy|privacy policy|terms of (use|service)|subscribe to our|enable javascript"
    rb"|click here|lorem ipsum"
)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STARTS = np.ones(256, bool)
_STARTS[0x80:0xC0] = False  # continuation bytes start no code point
_CHAR = _STARTS & ~_BLANK


def repeat_words(words: list[bytes]) -> int:
    """Words in 8-word windows that occur twice or more in the text, first occurrences included; exact."""
    m = len(words) - GRAM + 1
    if m < 2:
        return 0
    ids: dict[bytes, int] = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    if len(ids) == len(words):
        return 0
    # Windows of 2, 4 and 8 words get numbers that are equal exactly if the windows are.
    width = 1
    while width < GRAM:
        pair = x[: len(x) - width] * (int(x.max()) + 1) + x[width:]
        _, x = np.unique(pair, return_inverse=True)
        width *= 2
    often = np.bincount(x)[x] > 1
    if not often.any():
        return 0
    step = np.zeros(len(words) + 1, np.int64)
    at = np.nonzero(often)[0]
    step[at] += 1
    np.subtract.at(step, at + GRAM, 1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def bad_line(line: bytes, n_words: int, chars: int) -> bool:
    """Punctuation (symbols, separators, shouting), navigation or boilerplate; ``line`` has a word."""
    if 100 * len(SYMBOLS.findall(line)) > SYMBOL_PERCENT * chars:
        return True
    pipes = line.count(b"|")
    if pipes >= 2 and 3 * pipes >= n_words:
        return True
    if n_words >= 4 and 2 * (line.count(b"!") + line.count(b"?")) > n_words:
        return True
    return bool(NAVIGATION.search(line) or BOILERPLATE.search(line))


def judge(text: bytes) -> tuple[tuple, list[bytes]]:
    """The columns of ``op3`` after the id, and the lines that stay."""
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    chars, symbols = int(_CHAR[raw].sum()), int(_SYMBOL[raw].sum())
    repeats = repeat_words(words)
    lines, seen, dup, bad, lost = [], set(), 0, 0, 0
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            dup += line in seen
            seen.add(line)
            own = int(_CHAR[np.frombuffer(line, np.uint8)].sum())
            if bad_line(line, n, own):
                bad, lost = bad + 1, lost + own
                continue
        lines.append(line)
    failed = len(words) < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * len(words)
    kept = not failed and 100 * lost <= LOST_PERCENT * chars
    return (len(words), chars, symbols, dup, repeats, failed, kept, bad, lost), lines


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines", "lost_chars"]
KINDS = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2
SCHEMA = ", ".join(f"{n} {'boolean' if k == pa.bool_() else 'long'}" for n, k in zip(NAMES, KINDS))


def _judged(batches):
    for b in pieces(batches):
        rows = [judge(t)[0] for t in b.column(1).to_pylist()]
        cols = list(zip(*rows)) if rows else [[]] * len(NAMES)
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), k) for c, k in zip(cols, KINDS)]], ["doc_id", *NAMES])


def rules(docs: DataFrame) -> DataFrame:
    """Counts and verdict for each row of ``docs(doc_id, text)``; other columns are ignored.

    Lines that fail a rule go; a document whose lines lose over half of its word characters is rejected, and one that
    fails the base rules is too.  Null and empty texts have no word and fail the base rules.
    """
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    return some.mapInArrow(_judged, f"doc_id long, {SCHEMA}")


def _cleaned(batches):
    for b in pieces(batches):
        texts, keep = [], []
        for t in b.column(1).to_pylist():
            found, lines = judge(t)
            keep.append(found[6])
            if found[6]:
                texts.append(b"\n".join(lines) if found[7] else t)
        out = b.filter(pa.array(keep, pa.bool_()))
        text = pa.array([t.decode() for t in texts], pa.string())
        size = pa.array([len(x) for x in text.to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([out.column(0), text, out.column(2), out.column(3), size], ["doc_id", "text", "lang", "source", "n_chars"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines.

    Null and empty texts fail and go; repeated rows are judged one by one; ``n_chars`` is that of the cleaned text.
    """
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"), "lang", "source")
    return some.mapInArrow(_cleaned, "doc_id long, text string, lang string, source string, n_chars long")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
grams AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM win),
often AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM often, range(0, 8) t(j) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM d),
ll AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
       length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
       length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
       length(regexp_replace(line, '[^|]', '', 'g')) AS pipes,
       length(regexp_replace(line, '[^!?]', '', 'g')) AS shouts,
       row_number() OVER (PARTITION BY r, line ORDER BY p) AS nth FROM l),
judged AS (SELECT *, (100 * symbols > 10 * chars OR (pipes >= 2 AND 3 * pipes >= n) OR (n >= 4 AND 2 * shouts > n)
  OR regexp_matches(line, '(?i)^[\x20\t]*((home|about us|about|contact|log ?in|sign ?up|search|menu|next|previous|back to top|sitemap)[\x20\t|>/,-]*)+$')
  OR regexp_matches(line, '(?i)all rights reserved|cookie policy|privacy policy|terms of (use|service)|subscribe to our|enable javascript|click here|lorem ipsum')
  ) AS bad FROM ll WHERE n > 0),
per AS (SELECT r, count(*) FILTER (nth > 1) AS dup, sum(chars) AS chars, sum(symbols) AS symbols, sum(n) AS n,
        count(*) FILTER (bad) AS bad, coalesce(sum(chars) FILTER (bad), 0) AS lost FROM judged GROUP BY r),
f AS (SELECT d.doc_id, coalesce(p.n, 0)::BIGINT AS n_words, coalesce(p.chars, 0)::BIGINT AS word_chars, coalesce(p.symbols, 0)::BIGINT AS n_symbols,
      coalesce(p.dup, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(p.bad, 0)::BIGINT AS n_bad_lines,
      coalesce(p.lost, 0)::BIGINT AS lost_chars FROM d LEFT JOIN per p USING (r) LEFT JOIN covered c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_chars <= 50 * word_chars AS kept,
  n_bad_lines, lost_chars FROM f
"""
