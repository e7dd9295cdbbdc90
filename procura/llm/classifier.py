"""Quality classifier: an additive model of per-feature lookup tables and a few pairwise ones."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.llm.common import pieces, table, utf8
from procura.llm.quality_rules import judge

SAMPLE = 12_000  # labelled rows that a model is fitted on at most
BINS = 32
ROUNDS = 120
RATE = 0.15
LEAVES = 3
PAIRS = 6
PAIR_BINS = 8
LAMBDA = 2.0

FEATURES = (
    "log_words chars_per_word symbols_per_word shouts_per_word pipes_per_word commas_per_word stops_per_word upper_share "
    "digit_share wide_share distinct_share top_word_share repeat_share dup_line_share bad_line_share lost_share "
    "words_per_line capital_words line_end_share"
).split()
_KIND = np.zeros(256, np.int64)
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("a") : ord("z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[0xC0:] = 4
for _c, _n in ((b"!?", 5), (b"|", 6), (b",;", 7), (b".", 8)):
    _KIND[list(_c)] = _n


def features(text: bytes) -> list[float]:
    """What a score may see: the whole text and nothing else; all finite, also for empty texts."""
    (n, chars, symbols, dup, repeats, _, _, bad, lost), _ = judge(text)
    words = text.split()
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    k = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=9)
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in lines)
    w, c, r = max(n, 1), max(chars, 1), max(len(lines), 1)
    return [
        float(np.log1p(n)),
        chars / w,
        symbols / w,
        k[5] / w,
        k[6] / w,
        k[7] / w,
        k[8] / w,
        k[1] / max(k[1] + k[2], 1),
        k[3] / c,
        k[4] / c,
        len(count) / w,
        max(count.values(), default=0) / w,
        repeats / w,
        dup / r,
        bad / r,
        lost / c,
        n / r,
        sum(x[:1].isupper() for x in count) / max(len(count), 1),
        ends / r,
    ]


@dataclass
class Model:
    """``sigmoid(base + sum of tables[feature][bin] + sum of pairs[(f, g)][bin, bin])``."""

    base: float
    edges: list[np.ndarray]
    tables: np.ndarray  # (features, BINS)
    pairs: list[tuple[int, int, np.ndarray]]  # (f, g, (PAIR_BINS, PAIR_BINS))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = self.base + self.tables[np.arange(b.shape[1])[None, :], b].sum(axis=1)
        for f, g, t in self.pairs:
            total = total + t[b[:, f] * PAIR_BINS // BINS, b[:, g] * PAIR_BINS // BINS]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of ``LEAVES`` leaves grown on one feature's gradient sums: best split first."""
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    leaves = [(0, len(g))]
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + LAMBDA)
    while len(leaves) < LEAVES:
        best = (1e-9, None, None)
        for i, (a, b) in enumerate(leaves):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gains = gain(a, at) + gain(at, b) - gain(a, b)
                j = int(gains.argmax())
                best = max(best, (float(gains[j]), i, int(at[j])), key=lambda t: t[0])
        if best[1] is None:
            break
        a, b = leaves[best[1]]
        leaves[best[1]] = (a, best[2])
        leaves.append((best[2], b))
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + LAMBDA)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values by two features' bins of a tree that splits one and then, on either side, the other; and its gain."""
    best = (np.zeros_like(g), 0.0)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        ca, cb = a.cumsum(0).cumsum(1), b.cumsum(0).cumsum(1)
        for s in range(PAIR_BINS - 1):
            out, total = np.zeros_like(a), 0.0
            for lo, hi in ((0, s + 1), (s + 1, PAIR_BINS)):
                sa = (ca[hi - 1] - (ca[lo - 1] if lo else 0))[None, :][0]
                sb = (cb[hi - 1] - (cb[lo - 1] if lo else 0))[None, :][0]
                left, right = sa[:-1] ** 2 / (sb[:-1] + LAMBDA), (sa[-1] - sa[:-1]) ** 2 / (sb[-1] - sb[:-1] + LAMBDA)
                j = int((left + right).argmax())
                total += float(left[j] + right[j])
                out[lo:hi, : j + 1] = sa[j] / (sb[j] + LAMBDA)
                out[lo:hi, j + 1 :] = (sa[-1] - sa[j]) / (sb[-1] - sb[j] + LAMBDA)
            if total > best[1]:
                best = (out.T.copy() if turned else out, total)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting: each round fits one small tree a feature on the current gradient, at a small rate.

    Pairs come after the single features: those whose tree gains most on what is left, each as a table over coarser
    bins.  Without rows of both labels the model is the share of 1 (a half without rows).
    """
    n, k = len(y), len(FEATURES)
    p = (y.sum() + 1) / (n + 2)
    model = Model(float(np.log(p / (1 - p))), [np.empty(0)] * k, np.zeros((k, BINS)), [])
    if n == 0 or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(k)]
    b = model.bins(x)
    total = np.full(n, model.base)
    for _ in range(ROUNDS):
        for f in range(k):
            q = 1 / (1 + np.exp(-total))
            g = np.bincount(b[:, f], y - q, BINS)
            h = np.bincount(b[:, f], q * (1 - q), BINS)
            step = RATE * _tree(g, h)
            model.tables[f] += step
            total += step[b[:, f]]
    c = b * PAIR_BINS // BINS

    def sums(f: int, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        cell = c[:, f] * PAIR_BINS + c[:, g]
        shape = (PAIR_BINS, PAIR_BINS)
        size = PAIR_BINS * PAIR_BINS
        return cell, np.bincount(cell, y - q, size).reshape(shape), np.bincount(cell, q * (1 - q), size).reshape(shape)

    gains = sorted(((_pair_tree(*sums(f, g)[1:])[1], f, g) for f in range(k) for g in range(f)), reverse=True)
    model.pairs = [(f, g, np.zeros((PAIR_BINS, PAIR_BINS))) for _, f, g in gains[:PAIRS]]
    for _ in range(ROUNDS // 3):
        for f, g, t in model.pairs:
            cell, gs, hs = sums(f, g)
            step = RATE * _pair_tree(gs, hs)[0]
            t += step
            total += step.ravel()[cell]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _vectors(batches):
    for b in pieces(batches):
        x = [features(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``labels.quality``, of at most ``sample`` labelled rows that are not held out.

    The sample is the ids of the smallest hashes, the same in each run.  It is a few hundred kB of ids, which is why it
    may be broadcast; its texts are turned into features on the executors, and only those are collected.  Null ids and
    labels are left out; an id with several labels has its highest, and one with several rows the text of the smallest
    hash, so that what is collected is ``sample`` rows at most.
    """
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    some = some.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id")))
    some = some.groupBy("doc_id").agg(F.max("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    of_id = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    one = of_id.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("label", "text"), F.xxhash64("text")).alias("r"))
    rows = one.select("r.label", "r.text")
    got = rows.mapInArrow(_vectors, "label int, x array<double>").toArrow().to_pydict()
    if not got["label"]:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    # Rows come in any order; sums of floats follow it.
    x, y = np.array(got["x"], float), np.array(got["label"], float)
    order = np.lexsort(np.concatenate((x.T, y[None, :])))
    return fit(x[order], (y[order] > 0).astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row, repeated ones too.

    Null and empty texts have finite features and a score like any other; rows of a null id are not held out; an integer
    ``doc_id`` of any width will do; other columns are ignored; an empty table gives an empty one.
    """

    def scored(batches):
        for b in pieces(batches):
            x = np.array([features(t) for t in b.column(2).to_pylist()], float).reshape(-1, len(FEATURES))
            s = model.score(x)
            hit = pa.array((s >= 0.5).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), hit], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
