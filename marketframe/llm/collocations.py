"""Phrase collocation mining with mergeable Misra-Gries summaries.

Words are read by lang within pieces of text; f counts the places of an n-gram. Phrases of 2 to MOST words with
f >= `least` are candidates, scored by their weakest cut in two parts.

First pass, in two rounds (n-grams of one and two words, then longer ones, of which only those whose
word pairs all survived the first round can be frequent). A task counts the 64-bit hashes of its n-grams, cut to
32 bits within one of `buckets` hash partitions, and sends each partition a summary. Summaries of a
partition are merged into one of K counters, K > mass / least, where mass is the exact number of n-grams
counted in it: what exceeds K counters is evicted by subtracting the next one's count from all. An
n-gram loses less than `least` in all, so every frequent one keeps a counter; n-grams that share
a hash only add to each other. Survivors are marked in a bitmap of fixed size, which lets some others
through and no frequent one drop out.

Second pass: n-grams that the bitmap lets through are counted exactly, by lang and words, and those below
`least` dropped. (Within a task they are told apart by 64-bit hash: for 10^8 different n-grams of a task
the odds that any two clash are 1 in 3,700.) All else are joins and aggregates of the frequent n-grams.

The summaries' memory is bounded: `buckets` grows with the table, so that a partition's mass, and with it K,
stays near MASS (up to MOST_BUCKETS; beyond that K grows). A word that is a third of a lang's words is one counter.

A null lang counts as `und`, together with that lang; a null text as the empty one. Repeated rows count again.
A very long text is read in parts of whole pieces; one piece is read whole. Only text and lang are read. An
empty table, or one without frequent n-grams, gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm.common import free_worker, map_arrow, settle

LEAST, MOST, TOP = 100, 5, 2000
ROUNDS = ((1, 2), (3, MOST))
#: N-grams of a hash partition, roughly, and the most partitions.
MASS, MOST_BUCKETS = 1 << 25, 1 << 16
LEAST_BUCKETS = 64
BITMAP_BITS = 27
PART_BYTES = 4 << 20  # of text that is read at a time
HELD = 4_000_000  # hashes, or counters, before they are reduced
MEMO_WORDS, PHRASES = 300_000, 200_000
SALTS = 16
_C, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Signs that end a piece; a tab parts words as a space does, A-Z count as a-z.
_END = b".,;:!?\n\x0b\x0c\r"
_STOP = b"\xff"  # stands in no UTF-8 text
_TABLE = bytes(0xFF if b in _END else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def parts(texts: list[str | None], size: int = PART_BYTES) -> Iterator[list[bytes]]:
    """Words of the texts, with a stop between pieces, in lists of about `size` bytes of text."""
    held, n = [], 0
    for t in texts:
        data, at = (t or "").encode().translate(_TABLE), 0
        while at < len(data):
            end = len(data)
            if end - at > size - n:  # a piece's end within what still fits, else the next one
                end = data.rfind(_STOP, at, at + max(size - n, 0))
                end = data.find(_STOP, at + max(size - n, 0)) if end < 0 else end
                end = len(data) if end < 0 else end
            held.append(data[at:end])
            n, at = n + end - at, end + 1
            if n >= size:
                yield b" \xff ".join(held).replace(_STOP, b" \xff ").split()
                held, n = [], 0
    if held:
        yield b" \xff ".join(held).replace(_STOP, b" \xff ").split()


class Hashes(dict):
    """64-bit hashes of words, remembered; 0 for a stop."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = 0 if word == _STOP else xxhash.xxh3_64_intdigest(word) or 1
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Bitmap:
    """A set of hashes by their leading bits: none of the set is missing."""

    def __init__(self, data: np.ndarray):
        self.data = data

    def has(self, h: np.ndarray) -> np.ndarray:
        x = (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
        return (self.data[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool)


def grams(words: np.ndarray, lang: str, low: int, high: int, alive: dict[int, Bitmap]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, starts, hashes) of the n-grams of `low` to `high` words within pieces; of those sizes that
    `alive` has, only what it lets through, and longer ones only if all their word pairs are let through."""
    h, at = mixed(words ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), 7))), np.flatnonzero(words)
    base, pair = words, None
    h = h[at]
    for n in range(1, high + 1):
        if n > 1:
            on = at + n - 1 < len(base)
            at, h = at[on], h[on]
            last = base[at + n - 1]
            on = last != 0
            if n > 2 and pair is not None:
                on &= pair[at + n - 2]
            at, h = at[on], mixed(h[on] * _C + last[on])
        if n in alive:
            on = alive[n].has(h)
            at, h = at[on], h[on]
            if n == 2:
                pair = np.zeros(len(base), dtype=bool)
                pair[at] = True
        if n >= low:
            yield n, at, h


def by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, words) of bounded parts of the texts."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column(1).filter(pa.array(codes == k)).to_pylist()
            for words in parts(texts):
                yield lang, words


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending 32-bit keys with their counts: differences and counts by byte planes, compressed."""
    numbers = np.stack((np.diff(keys, prepend=np.uint32(0)), np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1)
    steps, counts = np.ascontiguousarray(numbers.T).view(np.uint32).reshape(2, -1)
    return np.cumsum(steps, dtype=np.uint32), counts.astype(np.int64)


class MisraGries:
    """At most `capacity` counters; each is short of the true count by `lost` at most."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, at = np.unique(np.concatenate((self.keys, keys)), return_inverse=True)
        self.counts = np.bincount(at, weights=np.concatenate((self.counts, counts)), minlength=len(self.keys)).astype(np.int64)
        if len(self.keys) > self.capacity:
            k = len(self.keys) - self.capacity - 1
            cut = int(np.partition(self.counts, k)[k])  # the first count that finds no room
            self.lost += cut
            stay = self.counts > cut
            self.keys, self.counts = self.keys[stay], self.counts[stay] - cut

    def frequent(self, least: int) -> np.ndarray:
        """Every key that may have stood `least` times."""
        return self.keys[self.counts + self.lost >= least]


def summaries(texts: DataFrame, low: int, high: int, buckets: int, alive: dict[int, Bitmap]) -> DataFrame:
    """bucket, mass and packed counts of n-grams, as each task finds them."""
    shared = texts.sparkSession.sparkContext.broadcast(alive)  # bitmaps of fixed size
    shift = np.uint64(32 - int(math.log2(buckets)))
    bounds = np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        hashes, held, n_held = Hashes(), [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            ends = np.searchsorted(keys, bounds)
            total, low_bits = np.concatenate(([0], np.cumsum(counts))), keys.astype(np.uint32)
            full = np.flatnonzero(np.diff(ends)).tolist()
            data = [packed(low_bits[ends[b] : ends[b + 1]], counts[ends[b] : ends[b + 1]]) for b in full]
            mass = total[ends[1:]] - total[ends[:-1]]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(mass[full], pa.int64()), pa.array(data, pa.binary())], names=["bucket", "mass", "data"])

        for lang, words in by_lang(batches):
            for _, _, h in grams(hashes.of(words), lang, low, high, shared.value):
                held.append(h >> shift)
                n_held += len(h)
            if n_held >= HELD:
                yield flush()
                n_held = 0
        if n_held:
            yield flush()

    return map_arrow(texts, run, "bucket int, mass bigint, data binary")


def survivors(found: DataFrame, buckets: int, least: int) -> DataFrame:
    """x: the leading BITMAP_BITS bits of the hashes that a merged summary of each bucket holds."""
    mass = F.sum("mass").over(Window.partitionBy("bucket"))  # packed summaries, a few hundred bytes to kilobytes each
    shift = 32 + int(math.log2(buckets)) - BITMAP_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        bucket, summary, held, n_held = None, None, [], 0

        def merge() -> None:
            nonlocal n_held
            if held:
                summary.merge(*map(np.concatenate, zip(*held)))
            held.clear()
            n_held = 0

        def last() -> pa.RecordBatch:
            merge()
            h = (np.int64(bucket) << 32) + summary.frequent(least).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.unique(h >> shift), pa.int64())], names=["x"])

        for batch in batches:
            for b, total, data in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    if summary is not None:
                        yield last()
                    bucket, summary = b, MisraGries(total // least + 1)
                held.append(unpacked(data))
                n_held += len(held[-1][0])
                if n_held >= HELD:
                    merge()
        if summary is not None:
            yield last()

    # rows come by bucket, as the window has sorted them
    return map_arrow(found.select("bucket", mass.alias("mass"), "data"), run, "x bigint")


def bitmap(found: DataFrame) -> Bitmap:
    """2^BITMAP_BITS bits in all, whatever the number of rows."""
    x = F.col("x") + 1
    rows = found.groupBy(F.bitmap_bucket_number(x).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("map")).collect()
    out = np.zeros((1 << BITMAP_BITS) // 8, dtype=np.uint8)
    for k, part in rows:
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(bytes(part), dtype=np.uint8)
    return Bitmap(out)


def exact(texts: DataFrame, most: int, least: int, buckets: int, alive: dict[int, Bitmap]) -> DataFrame:
    """lang, k (words), phrase and f of the n-grams that `alive` lets through and that stand `least` times or
    more; with k = 0 the number of words. A task's counts go out by lang and hash partition, as arrays: so few
    rows are shuffled, and what is merged at a time is one partition's part of one lang."""
    shared = texts.sparkSession.sparkContext.broadcast(alive)  # bitmaps of fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        hashes, counts, n = Hashes(), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                dealt: list[tuple[list, list]] = [([], []) for _ in range(buckets)]
                for phrase, f in own.items():
                    names, numbers = dealt[xxhash.xxh3_64_intdigest(phrase) & (buckets - 1)]
                    names.append(phrase.decode()), numbers.append(f)
                full = [b for b in range(buckets) if dealt[b][0]]
                columns = [pa.array([lang] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array([dealt[b][0] for b in full], pa.list_(pa.string())), pa.array([dealt[b][1] for b in full], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "phrases", "f"])
            counts.clear()

        for lang, words in by_lang(batches):
            w, own = hashes.of(words), counts.setdefault(lang, Counter())
            own[b""] += int(np.count_nonzero(w))
            for k, at, h in grams(w, lang, 1, most, shared.value):
                _, first, f = np.unique(h, return_index=True, return_counts=True)
                for i, c in zip(at[first].tolist(), f.tolist()):
                    own[b" ".join(words[i : i + k])] += c
            if sum(map(len, counts.values())) > PHRASES:
                yield from flush()
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        key, counts = None, Counter()

        def done() -> pa.RecordBatch:
            rows = [(p, f) for p, f in counts.items() if f >= least or not p]
            counts.clear()
            columns = [pa.array([key[0]] * len(rows), pa.string()), pa.array([p.count(" ") + 1 if p else 0 for p, _ in rows], pa.int32()), pa.array([p for p, _ in rows], pa.string()), pa.array([f for _, f in rows], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "k", "phrase", "f"])

        for batch in batches:
            for lang, bucket, phrases, f in zip(*batch.columns):
                new = (lang.as_py(), bucket.as_py())
                if new != key:
                    if counts:
                        yield done()
                    key = new
                for p, c in zip(phrases.as_py(), f.as_py()):
                    counts[p] += c
        if counts:
            yield done()

    found = map_arrow(texts, count, "lang string, bucket int, phrases array<string>, f array<bigint>")
    return map_arrow(found.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket"), merge, "lang string, k int, phrase string, f bigint")


def frequent(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """lang, k, phrase, f of all n-grams of up to `most` words that stand `least` times or more, and with k = 0
    the number of words of each lang."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(int(math.log2(LEAST_BUCKETS)), min(int(math.log2(MOST_BUCKETS)), math.ceil(math.log2(size / MASS + 1))))
    alive: dict[int, Bitmap] = {}
    for low, high in ROUNDS:
        if low <= most:
            held = bitmap(survivors(summaries(texts, low, min(high, most), buckets, alive), buckets, least))
            alive = {**alive, **{n: held for n in range(low, min(high, most) + 1)}}
    return settle(exact(texts, most, least, buckets, alive), "frequent")


def _whole(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n and score of every candidate; `found` from frequent()."""
    words = F.split("phrase", " ")
    total = F.broadcast(found.filter("k = 0").select("lang", F.col("f").alias("n")))  # a row per lang
    each = found.filter("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("ws"))
    cuts = each.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")  # common first and last words stand in many phrases
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", salt.alias("salt"), F.array_join(F.slice("ws", F.lit(1), F.col("cut")), " ").alias("p"), F.array_join(F.slice("ws", F.col("cut") + 1, F.col("k")), " ").alias("q"))
    # merged: Spark takes a table for as large as before explode(), and would send SALTS copies of all n-grams to every executor
    known = found.filter("k >= 1").select("lang", "phrase", "f", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")).hint("merge")
    left, right = (known.select("lang", "salt", F.col("phrase").alias(x), F.col("f").alias(y)) for x, y in (("p", "l"), ("q", "r")))
    both = cuts.join(left, ["lang", "salt", "p"]).join(right, ["lang", "salt", "q"]).join(total, "lang")
    score = F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "k", "a", "b.l", "b.r", "n", "b.score")


def kept(candidates: DataFrame) -> DataFrame:
    """The candidates that stand more often than every longer one that holds them. A longer one of equal
    count implies one that is longer by one word only."""
    words, n = F.split("phrase", " "), F.col("k")
    inner = candidates.filter("k >= 3").select("lang", "a", F.explode(F.array(F.array_join(F.slice(words, F.lit(1), n - 1), " "), F.array_join(F.slice(words, F.lit(2), n - 1), " "))).alias("phrase"))
    over = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return candidates.join(over, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < a").drop("longer")


def mine(docs: DataFrame, least: int = LEAST, most: int = MOST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first `top` phrases."""
    found = kept(scored(frequent(docs, least, most)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    first = found.withColumn("__k", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("__k") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))  # SALTS times `top` rows
    return first.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def digest(docs: DataFrame) -> DataFrame:
    return mine(docs)


ORACLE = r"""
WITH p AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
u AS (SELECT c.*, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.k, u.a, u.cut, x.f AS l, y.f AS r, t.n, (1000 * u.a * t.n) // (x.f * y.f) AS score
  FROM u JOIN f AS x ON x.lang = u.lang AND x.phrase = array_to_string(u.ws[1:u.cut], ' ') JOIN f AS y ON y.lang = u.lang AND y.phrase = array_to_string(u.ws[u.cut + 1:], ' ') JOIN t ON t.lang = u.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.a >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) WHERE rank <= 2000
"""
