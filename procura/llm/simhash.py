"""SimHash near-duplicates joined on Golay codeword indices."""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.llm.common import connected_components, cut, merged, pieces, spent, table, text_key, utf8

SHINGLE = 3
MAX_BITS = 2
BLOCK = 1 << 15  # shingles counted at once; bounds memory for very long texts
#: A bucket of more fingerprints than this is not paired but linked through flipped fingerprints, which is exact too.
PAIRED = 24
#: The 64 bits in three segments (lowest bit, width), each short enough for a word of the (23, 12) Golay code.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def simhash(text: bytes, k: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of whole ``text``: a bit is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()  # bytes.lower() folds A-Z only
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_digest
    if n <= k:
        return int.from_bytes(digest(b" ".join(words), 42), "big", signed=True)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - k + 1].tolist()
    stops = ends[k - 1 :].tolist()
    m, counts = len(starts), np.zeros(64, np.int64)
    for at in range(0, m, BLOCK):
        some = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])])
        counts += np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > m).tobytes(), "big", signed=True)


def _fingerprints(batches):
    for b in pieces(batches):
        fp = pa.array([simhash(t) for t in b.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``, a row for each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text")).mapInArrow(
        _fingerprints, "doc_id long, fp long"
    )


@cache
def _error_of_syndrome() -> np.ndarray:
    """The one pattern of at most three errors for each of the 2048 syndromes: the code is perfect."""
    v = np.arange(23)
    one = 1 << v
    two = (one[:, None] | one[None, :])[np.triu_indices(23, 1)]
    three = np.array([a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]])
    errors = np.concatenate(([0], one, two, three)).astype(np.int64)
    out = np.zeros(2048, np.int64)
    out[_syndrome(errors)] = errors
    return out


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of the polynomials ``x`` (degree under 23) by the generator."""
    r = x.copy()
    for bit in range(22, 10, -1):
        r = np.where((r >> bit) & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


def codeword_indices(x: np.ndarray) -> np.ndarray:
    """``(n, 24)``: 12-bit indices of the codewords nearest to each word and to each of its 23 one-bit changes.

    Words that differ in one or two bits have a change in common (one's own word counts), so that they share an index.
    Equal indices in a row repeat; at most six differ.
    """
    near = np.concatenate((x[:, None], x[:, None] ^ (1 << np.arange(23))[None, :]), axis=1)
    return (near ^ _error_of_syndrome()[_syndrome(near)]) >> 11


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(key, row)``: two fingerprints at two or fewer differing bits share a key.

    Two errors leave one of three segments whole; the next segment then has two at most, and its codeword indices
    meet.  A key is the whole segment with one index of the next: 33 bits or more, so that buckets stay small however
    many fingerprints there are.
    """
    u, keys, rows = fp.astype(np.int64).view(np.uint64), [], []
    parts = [((u >> np.uint64(low)) & np.uint64((1 << wide) - 1)).astype(np.int64) for low, wide in SEGMENTS]
    for j in range(3):
        near = np.sort(codeword_indices(parts[(j + 1) % 3]), axis=1)
        first = np.concatenate((np.ones((len(fp), 1), bool), near[:, 1:] != near[:, :-1]), axis=1)
        row, at = np.nonzero(first)
        keys.append((j << 34) | (parts[j][row] << 12) | near[row, at])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _keys(batches):
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        if len(fp):
            key, row = golay_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(fp[row], pa.int64())], ["key", "fp"])


def _flips(batches):
    one = np.concatenate(([0], (np.uint64(1) << np.arange(64, dtype=np.uint64)).view(np.int64)))
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        key = (fp[:, None] ^ one[None, :]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(np.repeat(fp, 65), pa.int64())], ["key", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect whatever fingerprints differ in two or fewer bits.

    Buckets of up to ``PAIRED`` fingerprints are paired and verified.  Fingerprints of larger buckets are joined on
    themselves with each single bit changed: two share such a key exactly if they differ in two or fewer bits, a key
    has at most 65 of them, and each is linked to the smallest; the cost is in proportion to the fingerprints.
    """
    keys = cut(fps.select("fp").mapInArrow(_keys, "key long, fp long"), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = merged(keys, sizes, "key")
    pairs = (
        shared.where(F.col("n") <= PAIRED)
        .groupBy("key")
        .agg(F.array_sort(F.collect_list("fp")).alias("m"))
        .select(F.explode("m").alias("a"), "m")
        .select("a", F.explode("m").alias("b"))
        .where("a < b AND bit_count(a ^ b) <= 2")
    )
    crowded = shared.where(F.col("n") > PAIRED).select("fp").distinct().mapInArrow(_flips, "key long, fp long")
    stars = crowded.groupBy("key").agg(F.collect_list("fp").alias("m")).where(F.size("m") > 1)
    stars = stars.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a < b")
    found = cut(pairs.union(stars).distinct(), "links")
    spent(keys)
    return found


def components(prints: DataFrame) -> DataFrame:
    """``(fp, component_id)`` for the distinct fingerprints of ``(doc_id, fp)``: the smallest doc_id reachable."""
    fps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = connected_components(links(fps)).withColumnRenamed("node", "fp")
    rooted = merged(fps, roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return merged(rooted, smallest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs(doc_id, text)``; other columns are ignored.

    Null and empty texts have fingerprint zero and are linked like any other.  Null ids never become a component's
    id unless all its ids are null; repeated rows repeat.  An empty table gives an empty one.
    """
    prints = cut(fingerprints(docs), "prints")
    found = merged(prints, components(prints), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# --- texts of similar shingles ---------------------------------------------------------------------------------------
#: Two or fewer bits of one 64-bit fingerprint are next to equal texts.  Texts that share four fifths of their five-word
#: shingles differ in about one bit of fifteen of a fingerprint of their distinct words, so that among many segments
#: some pair has a whole one beside one of two errors at most.
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
WIDE_SEGMENTS, WIDE = 12, 21  # of 256 bits
SEEDS = 4
FAR_BITS = 64  # of 256: pairs of a bucket beyond that are left to the prefix filter
IN_BLOCK = 384  # members of a shingle that a task compares at once
#: Shingles that this many of a sixteenth of the texts have come last in the order of prefixes, at most ``HOT`` of them.  Any
#: order finds every pair; this one keeps common shingles out of prefixes.
HOT_IN_SAMPLE, SAMPLED, HOT = 3, 16, 1 << 20
SCANNED = 1 << 16  # rows of prefixes looked at together


def word_print(text: bytes, memo: dict[bytes, bytes]) -> bytes:
    """256-bit fingerprint of the distinct lower-cased words."""
    words = set(text.lower().split())
    if len(memo) > 100_000:
        memo.clear()
    some = []
    for w in words:
        d = memo.get(w)
        if d is None:
            d = memo[w] = b"".join([xxhash.xxh64_digest(w, s) for s in range(SEEDS)])
        some.append(d)
    counts = np.zeros(64 * SEEDS, np.int64)
    for at in range(0, len(some), BLOCK):
        block = np.frombuffer(b"".join(some[at : at + BLOCK]), np.uint8).reshape(-1, 8 * SEEDS)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(some)).tobytes()


def _word_prints(batches):
    memo: dict[bytes, bytes] = {}
    for b in pieces(batches):
        texts = b.column(1).to_pylist()
        th = pa.array([hashlib.md5(t).digest() for t in texts], pa.binary())  # as the JVM's
        wide = pa.array([word_print(t, memo) for t in texts], pa.binary())
        narrow = pa.array([simhash(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), th, narrow, wide], ["doc_id", "th", "fp", "wide"])


def wide_keys(wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, row)`` of ``(n, 32)`` bytes: a segment whole with a codeword index of the next, for each segment."""
    n = len(wide)
    bits = np.unpackbits(wide, axis=1)[:, : WIDE_SEGMENTS * WIDE].reshape(n, WIDE_SEGMENTS, WIDE)
    part = bits.astype(np.int64) @ (1 << np.arange(WIDE))
    near = np.sort(codeword_indices(np.roll(part, -1, axis=1).ravel()), axis=1)
    first = np.concatenate((np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]), axis=1)
    at, col = np.nonzero(first)
    seg = at % WIDE_SEGMENTS
    return (seg << 34) | (part.ravel()[at] << 12) | near[at, col], at // WIDE_SEGMENTS


def _wide_keys(batches):
    for b in pieces(batches, 4096):
        if not b.num_rows:
            continue
        wide = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, 8 * SEEDS)
        bucket, row = wide_keys(wide)
        key = b.column(0).to_numpy(zero_copy_only=False)[row]
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(key, pa.int64())], ["bucket", "key"])


def shingles(text: bytes, k: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of the whole text."""
    words = text.lower().split()
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64).view(np.int64)
    h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)], np.uint64)
    return np.unique(h).view(np.int64)


def _shingled(batches):
    for b in pieces(batches):
        h = [shingles(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.list_(pa.int64()))], ["key", "h"])


def _similar(batches):
    for b in pieces(batches):
        good = []
        x, y = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
        ends = [np.concatenate(([0], np.cumsum(pc.list_value_length(b.column(i)).to_numpy(zero_copy_only=False)))) for i in (2, 3)]
        for i in range(b.num_rows):
            u, v = x[ends[0][i] : ends[0][i + 1]], y[ends[1][i] : ends[1][i + 1]]
            both = len(np.intersect1d(u, v, assume_unique=True))
            good.append(len(u) + len(v) > 0 and both >= SIMILARITY * (len(u) + len(v) - both))
        yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))


def bucket_pairs(wide: DataFrame) -> DataFrame:
    """Of ``(key, wide)``: pairs ``(a, b)`` of each member of a bucket with the smallest and the largest there, within ``FAR_BITS``.

    One rule for buckets of any size; pairs grow with the members, and copies of one text have most buckets, and so these
    two members, in common.
    """
    keys = wide.mapInArrow(_wide_keys, "bucket long, key long")
    least = keys.groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a < z")
    met = merged(keys, least, "bucket")
    ends = F.inline(F.array(F.struct(F.col("a").alias("a"), F.col("key").alias("b")), F.struct(F.col("key").alias("a"), F.col("z").alias("b"))))
    pairs = met.select(ends).where("a < b").distinct()
    x = merged(merged(pairs, wide.toDF("a", "wa"), "a"), wide.toDF("b", "wb"), "b")
    word = lambda c, i: F.conv(F.hex(F.substring(c, 1 + 4 * i, 4)), 16, 10).cast("long")
    apart = sum((F.bit_count(word("wa", i).bitwiseXOR(word("wb", i))) for i in range(2 * SEEDS)), F.lit(0))
    return x.where(apart <= FAR_BITS).select("a", "b")


def rolled(text: bytes, memo: dict[bytes, int], k: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Sorted hashes of the same shingles as ``shingles``, other values, from the hashes of words."""
    words = text.lower().split()
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)
    if len(memo) > 200_000:
        memo.clear()
    ids = []
    for w in words:
        x = memo.get(w)
        if x is None:
            x = memo[w] = xxhash.xxh64_intdigest(w)
        ids.append(x)
    t, m = np.array(ids, np.uint64), len(words) - k + 1
    roll = np.zeros(m, np.uint64)
    for j in range(k):
        roll = roll * np.uint64(0x9E3779B97F4A7C15) + t[j : j + m]
    roll = (roll ^ (roll >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(roll ^ (roll >> np.uint64(27)))


def _rolled(batches):
    memo: dict[bytes, int] = {}
    for b in pieces(batches):
        h = [rolled(t, memo) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64) if h else [], pa.int64())], ["h"])


def _prefixes(held):
    """Of each text its first shingles in the order of ``held`` (hot hashes, their counts), as many as may all be missing
    from a similar text and one more: similar texts have one of these in common, whatever the order."""

    def run(batches):
        hot, count = held.value
        memo: dict[bytes, int] = {}
        for b in pieces(batches):
            hs, sizes = [], []
            for t in b.column(2).to_pylist():
                h = rolled(t, memo)
                n = len(h)
                if len(hot):
                    i = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    h = h[np.argsort(np.where(hot[i] == h, count[i], 0), kind="stable")]
                h = h[: n - math.ceil(SIMILARITY * n - 1e-9) + 1] if n else h
                hs.append(h.view(np.int64))
                sizes.append(n)
            cols = [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(hs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "n", "h"])

    return run


def _meetings(batches):
    """Of rows sorted by ``h``: the members ``(key, root, at)`` of each shingle that several roots have, smaller texts first.

    The first ``own`` members of a row are to meet each other and the rest.  Members over ``IN_BLOCK`` are split in
    blocks, a row for each two that have texts of similar length.
    """

    def rows(c: np.ndarray):
        starts = np.flatnonzero(np.concatenate(([True], c[0][1:] != c[0][:-1])))
        low, high = np.minimum.reduceat(c[2], starts), np.maximum.reduceat(c[2], starts)
        stops = np.append(starts[1:], c.shape[1])
        for s, e in zip(starts[low != high].tolist(), stops[low != high].tolist()):
            m = c[1:, s:e][:, np.argsort(c[3, s:e])]
            if e - s <= IN_BLOCK:
                yield e - s, m
                continue
            size = m[2] >> 32
            for i in range(0, e - s, IN_BLOCK):
                own = m[:, i : i + IN_BLOCK]
                yield own.shape[1], own
                for j in range(i + IN_BLOCK, e - s, IN_BLOCK):
                    if size[i + own.shape[1] - 1] < SIMILARITY * size[j] - 1e-6:
                        break
                    yield own.shape[1], np.concatenate((own, m[:, j : j + IN_BLOCK]), axis=1)

    def packed(c: np.ndarray):
        some: list[tuple[int, np.ndarray]] = []
        for own, m in rows(c):
            some.append((own, m))
            if len(some) == 512:
                yield batch(some)
                some = []
        if some:
            yield batch(some)

    def batch(some: list) -> pa.RecordBatch:
        at = pa.array(np.concatenate(([0], np.cumsum([m.shape[1] for _, m in some]))), pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([m[i] for _, m in some]), pa.int64())) for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array([o for o, _ in some], pa.int32()), *lists], ["own", "key", "root", "at"])

    held, n = [], 0
    for b in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
        n += b.num_rows
        if n < SCANNED:
            continue
        c = np.concatenate(held, axis=1)
        last = int(np.searchsorted(c[0], c[0, -1]))  # rows of the last shingle may go on
        if last:
            yield from packed(c[:, :last])
        held, n = [c[:, last:]], c.shape[1] - last if last else 0
    if held:
        c = np.concatenate(held, axis=1)
        if c.shape[1]:
            yield from packed(c)


def _met(batches):
    """Pairs of different roots whose lengths and places of the shingle allow the similarity."""
    for b in batches:
        pairs: set[tuple[int, int]] = set()
        for own, *lists in zip(*(c for c in b.columns)):
            own = own.as_py()
            key, root, at = (x.values.to_numpy(zero_copy_only=False) for x in lists)
            size, place = at >> 32, at & 0xFFFFFFFF
            left = size - place  # shingles from this one on
            need = SIMILARITY / (1 + SIMILARITY) * (size[:own, None] + size[None, :]) - 1e-6
            near = (root[:own, None] != root[None, :]) & (np.minimum(left[:own, None], left[None, :]) >= need)
            i, j = np.nonzero(near)
            pairs |= set(zip(np.minimum(key[i], key[j]).tolist(), np.maximum(key[i], key[j]).tolist()))
        cols = list(zip(*pairs)) if pairs else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["a", "b"])


def pairs_of_prefixes(texts: DataFrame, rooted: DataFrame) -> DataFrame:
    """All pairs ``(a, b)`` of keys with different roots that may have a similarity of ``SIMILARITY``.

    ``texts`` has ``(doc_id, th, text)``, ``rooted`` has ``(key, th, id, root)``.  An exact prefix filter over the five-word
    shingles: no similar pair is left out.  Rows are the prefixes, a fifth of the shingles, joined with roots before they
    are dealt, so that no text is; a shingle's members are held by one task as numbers, and others compare blocks of them.
    """
    spark = texts.sparkSession
    sample = texts.where(F.pmod(F.xxhash64("th"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(_rolled, "h long")
    hot = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_IN_SAMPLE).orderBy(F.desc("n"), "h").limit(HOT).toArrow()
    h, n = (hot.column(i).to_numpy() for i in range(2))
    order = np.argsort(h.view(np.uint64))
    held = spark.sparkContext.broadcast((h.view(np.uint64)[order], n[order]))
    p = texts.select("doc_id", "th", "text").mapInArrow(_prefixes(held), "doc_id long, th binary, n long, h array<long>").alias("p")
    on = (F.col("p.th") == F.col("r.th")) & F.col("p.doc_id").eqNullSafe(F.col("r.id"))
    rows = merged(p, rooted.alias("r"), on).select("r.key", "root", "n", F.posexplode("h").alias("place", "h"))
    rows = rows.select("h", "key", "root", F.shiftleft("n", 32).bitwiseOR(F.col("place").cast("long")).alias("at"))
    rows = rows.repartition("h").sortWithinPartitions("h")
    met = rows.mapInArrow(_meetings, "own int, key array<long>, root array<long>, at array<long>")
    return met.repartition(F.xxhash64("key")).mapInArrow(_met, "a long, b long").distinct()


def groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, group)`` of each row: groups of equal texts, of fingerprints two bits apart, and of texts with a
    similarity of 0.8 or more, verified on all their five-word shingles; ``group`` is the smallest doc_id reachable.

    Golay keys of a fingerprint of words join most near copies first.  An exact prefix filter over the shingles finds every
    similar pair that these leave apart, trimmed and extended copies too, so that groups do not hang on the keys.  All
    pairs are verified on whole texts.  Texts are equal by 128 bits; null and empty texts are equal; null ids are in
    groups but never name one, unless all its ids are null; repeated rows repeat.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    prints = cut(texts.mapInArrow(_word_prints, "doc_id long, th binary, fp long, wide binary"), "word-prints")
    classes = prints.groupBy("th").agg(F.min("doc_id").alias("id"), F.first("fp").alias("fp"), F.first("wide").alias("wide"))
    classes = cut(classes.withColumn("key", F.monotonically_increasing_id()), "text-classes")  # numbered once, as written
    pairs = cut(bucket_pairs(classes.select("key", "wide")), "pairs")
    t = texts.withColumn("th", text_key(F.col("text"))).alias("t")

    def verified(some: DataFrame) -> DataFrame:
        needed = some.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        n = merged(needed, classes.select("key", "th", "id"), "key").alias("n")
        on = (F.col("t.th") == F.col("n.th")) & F.col("t.doc_id").eqNullSafe(F.col("n.id"))
        sets = merged(t, n, on).select("n.key", "text").mapInArrow(_shingled, "key long, h array<long>")
        sets = cut(sets.dropDuplicates(["key"]), "shingles")
        x = merged(merged(some, sets.toDF("a", "ha"), "a"), sets.toDF("b", "hb"), "b")
        found = cut(x.select("a", "b", "ha", "hb").mapInArrow(_similar, "a long, b long"), "similar")
        spent(sets)
        return found

    # Fingerprints two bits apart join their classes by the class of the smallest key.
    narrow = classes.groupBy("fp").agg(F.min("key").alias("first"))
    same = merged(classes, narrow, "fp").select(F.col("first").alias("a"), F.col("key").alias("b"))
    close = links(narrow.select("fp")).alias("l")
    f, g = narrow.alias("f"), narrow.alias("g")
    close = merged(merged(close, f, F.col("l.a") == F.col("f.fp")), g, F.col("l.b") == F.col("g.fp")).select(F.col("f.first").alias("a"), F.col("g.first").alias("b"))
    roots = connected_components(verified(pairs).union(same).union(close)).withColumnRenamed("node", "key")
    rooted = merged(classes.select("key", "th", "id"), roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = cut(rooted, "first-roots")
    # What Golay keys left apart, between roots.
    rest = cut(pairs_of_prefixes(t, rooted), "prefix-pairs")
    r = rooted.select("key", "root")
    found = merged(merged(verified(rest), r.toDF("a", "ra"), "a"), r.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    last = connected_components(found).toDF("root", "last")
    rooted = merged(rooted, last, "root", "left").select("th", "id", F.coalesce("last", "root").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("id").alias("group"))
    return merged(prints.select("doc_id", "th"), merged(rooted, lowest, "root").select("th", "group"), "th")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; where rows share that id, one of each text."""
    stay = groups(docs).where(F.col("doc_id").eqNullSafe(F.col("group")))
    # Null ids are marked apart, so that the join and the removal of repeated rows share one exchange of the texts.
    row = {"id0": F.coalesce("doc_id", F.lit(0)), "no_id": F.col("doc_id").isNull()}
    d = docs.select("doc_id", "text", "lang", "source", "n_chars", text_key(F.col("text")).alias("th")).withColumns(row)
    kept = merged(d, stay.withColumns(row).select(*row, "th").distinct(), [*row, "th"], "left_semi")
    return kept.dropDuplicates([*row, "th"]).select("doc_id", "text", "lang", "source", "n_chars")
