"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Documents with equal sets form one class at once. For classes, shingles are ordered by rarity (a
fixed-size sketch of corpus counts, ties by hash; any one order is right, rarity makes it fast).
Two sets of similarity t share at least c of the first |x| - ceil(t |x|) + c shingles each, so

* small sets emit every pair (c = 2) of those first shingles: a shared subset makes a candidate;
* large sets emit single shingles (c = 1): their inverted lists are scanned; small sets that a
  large one may match stand in these lists too.

The boundary between small and large is the largest size whose subsets cost no more rows than
its list entries and the partners that those lists hold on average.

Lists are not expanded into all pairs. In each round a list that holds different components pairs its
members with its most central one, which then has met them all and leaves the list; what verifies is
linked, and linked documents are contracted. Lists of which one member is left are done. After PIVOT_ROUNDS rounds they go on, up to MOST_ROUNDS, while the members
that are left would make more pairs than PAIRS_AN_ENTRY for each entry of a list, and a round still takes a
good share of these away. What is left pairs
the members of different components, long lists in blocks of BLOCK members, so that no list is one
task. A pair is a candidate only where what both sets hold behind the common key suffices (the first
common key of similar sets always passes). Every candidate is verified on the whole sets. Shingles
count by 64-bit hash and equal sets by a 128-bit digest: for sets of 10,000 shingles the odds that two
of theirs clash are about 1 in 10^11, and that two of 10^10 sets share a digest 1 in 10^18; but for
that, links and components are exact.

A row without words or text has an empty set and links with nothing. Rows without doc_id take no
part and get no component. Rows that repeat doc_id are one document: links of any of them count.
A very long text is one set like others. doc_id is a whole number. Other columns are ignored, and
kept by keep_one(). An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.bpe import slices
from marketframe.llm.common import free_worker, map_arrow, settle
from marketframe.llm.components import components

SKETCH_BITS = 22
SKETCH_BLOCKS = 128
PIVOT_ROUNDS, MOST_ROUNDS, PAIRS_AN_ENTRY = 2, 8, 4
GAIN = 0.8  # a round that leaves more of the pairs than this is the last
BLOCK = 256
SALTS = 8
BROADCAST_IDS = 500_000  # doc_ids (8 bytes each) that are sent to every executor
LEAST_HASHES = 4096  # shingles whose counts are kept exactly, for the mean list length
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """Scatters 64-bit integers (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; A-Z count as a-z, words are parted by
    white space of ASCII. A text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    m = min(k, len(w))
    h = np.full(len(w) - m + 1, m, dtype=np.uint64)
    for j in range(m):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - m + 1 + j])
    return np.unique(h)


class Similarity:
    """Jaccard at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, n: int) -> int:
        """Shingles of a set of n that any similar set holds at least."""
        return -(-self.num * n // self.den)

    def prefix(self, n: int) -> int:
        return n - self.overlap(n) + 1

    def least_size(self) -> int:
        """Sets below this size are similar to equal sets only."""
        return max(1, -(-self.num // (self.den - self.num))) if self.num < self.den else 1 << 60

    def holds(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)


def boundary(sim: Similarity, partners: float) -> int:
    """The largest small size, by cost: subsets of two against list entries and their partners."""
    n = sim.least_size()
    while n < 10_000 and math.comb(sim.prefix(n + 1) + 1, 2) <= sim.prefix(n + 1) * (1 + partners):
        n += 1
    return n


def keys(h: np.ndarray, rarity: np.ndarray, sim: Similarity, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The subset and list keys that a set emits, and their places: of a list key its place in the
    order of rarity, of a subset the place of its later shingle less 1. Behind a common key at
    place p, and before it if it is the first common one, a set of n can share n - p shingles."""
    n = len(h)
    if n < sim.least_size():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)
    p = sim.prefix(n)
    first = h[np.lexsort((h, rarity))[: p + 1]]
    out, at = [], []
    if n <= limit:
        i, j = np.triu_indices(len(first), 1)
        a, b = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
        out.append(mixed(mixed(a) + b)), at.append(j - 1)
    if n > limit or sim.den * n >= sim.num * (limit + 1):  # large, or within reach of a large one
        out.append(first[:p]), at.append(np.arange(p))
    return np.concatenate(out).view(np.int64), np.concatenate(at).astype(np.int32)


def sketch(docs: DataFrame, k: int) -> tuple[np.ndarray, float]:
    """Counts of all documents' shingles by hash (2^SKETCH_BITS buckets), and the mean number of
    partners on the list of a rare shingle. Both have a fixed size at any input."""
    size, width = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SKETCH_BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        counts, least, some = np.zeros(size, dtype=np.uint32), (np.empty(0, np.uint64), np.empty(0, np.uint64)), False
        held: list[np.ndarray] = []

        def flush() -> None:
            nonlocal least, some
            h = np.concatenate(held) if held else np.empty(0, np.uint64)
            held.clear()
            if len(h):
                some = True
                np.add.at(counts, (h & np.uint64(size - 1)).astype(np.int64), np.uint32(1))
                least = _least(np.concatenate((least[0], h)), np.concatenate((least[1], np.ones(len(h), np.uint64))))

        waiting = 0
        for batch in batches:
            for text in batch.column(0):
                held.append(shingles(text.as_py(), k))
                waiting += len(held[-1])
                if waiting > 500_000:
                    flush()
                    waiting = 0
        flush()
        if some:
            pack = zstandard.ZstdCompressor(level=1).compress
            rows = [(i, pack(counts[i * width : (i + 1) * width].tobytes())) for i in range(SKETCH_BLOCKS)] + [(-1, np.stack(least).tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "part"])

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        (block,), total = key, None
        for part in parts["part"]:
            if block < 0:
                new = np.frombuffer(part, dtype=np.uint64).reshape(2, -1)
                total = new if total is None else np.stack(_least(np.concatenate((total[0], new[0])), np.concatenate((total[1], new[1]))))
            else:
                new = np.frombuffer(zstandard.ZstdDecompressor().decompress(part), dtype=np.uint32)
                total = new.copy() if total is None else total + new
        return pd.DataFrame({"block": [block], "part": [total.tobytes()]})

    parts = map_arrow(docs.select(F.col("text").cast("string")), run, "block int, part binary").groupBy("block").applyInPandas(add, "block int, part binary")
    counts, partners = np.zeros(size, dtype=np.uint32), 0.0
    for block, part in parts.collect():  # 4 * 2^SKETCH_BITS bytes in all
        if block >= 0:
            counts[block * width : (block + 1) * width] = np.frombuffer(bytes(part), dtype=np.uint32)
        else:
            n = np.sort(np.frombuffer(bytes(part), dtype=np.uint64).reshape(2, -1)[1].astype(float))
            partners = float(n[: (len(n) + 1) // 2].mean() - 1)  # prefixes take the rarer shingles
    return counts, partners


def _least(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The LEAST_HASHES smallest different hashes with the sums of their counts."""
    if len(h) > 4 * LEAST_HASHES:
        cut = np.partition(h, 4 * LEAST_HASHES)[4 * LEAST_HASHES]
        few = np.unique(h[h <= cut])
        if len(few) > LEAST_HASHES:
            at = h <= few[LEAST_HASHES]
            h, n = h[at], n[at]
    few, inverse = np.unique(h, return_inverse=True)
    total = np.bincount(inverse, weights=n.astype(float), minlength=len(few)).astype(np.uint64)
    return few[:LEAST_HASHES], total[:LEAST_HASHES]


def sets(docs: DataFrame, k: int, sim: Similarity) -> DataFrame:
    """doc_id, n, s1, s2 (128 bits of the set) and its keys."""
    counts, partners = sketch(docs, k)
    limit = boundary(sim, partners)
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    mask = np.uint64((1 << SKETCH_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        rarity = shared.value
        for batch in batches:
            for b in slices(batch):
                n, s1, s2, out = [], [], [], []
                for text in b.column(1).to_pylist():
                    h = shingles(text, k)
                    d = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), dtype=np.int64)
                    n.append(len(h)), s1.append(int(d[0])), s2.append(int(d[1]))
                    out.append(keys(h, rarity[(h & mask).astype(np.int64)], sim, limit))
                ends = np.cumsum([0, *(len(x) for x, _ in out)]).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(np.concatenate([x for x, _ in out])), pa.array(np.concatenate([x for _, x in out]))], names=["key", "pos"])
                lists = pa.ListArray.from_arrays(pa.array(ends), values)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists], names=["doc_id", "n", "s1", "s2", "keys"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run, "doc_id bigint, n bigint, s1 bigint, s2 bigint, keys array<struct<key:bigint,pos:int>>")


def id_filter(ids: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(bits, bitmap) of n hashed ids, at most 2^27 bits: a row whose bit is unset is none of them."""
    bits = min(27, max(16, math.ceil(math.log2(16 * max(1, n)))))
    x = F.pmod(F.xxhash64("id"), F.lit(1 << bits)) + 1
    rows = ids.select(x.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("map")).collect()
    out = np.zeros(max(1, (1 << bits) // 32768) * 4096, dtype=np.uint8)
    for k, part in rows:
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(bytes(part), dtype=np.uint8)
    return bits, out


def verified(pairs: DataFrame, docs: DataFrame, k: int, sim: Similarity) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sets are similar."""
    ids = settle(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    n = ids.count()
    some = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if n <= BROADCAST_IDS:  # only the texts of pairs go to Python
        some = some.join(F.broadcast(ids.withColumnRenamed("id", "doc_id")), "doc_id", "left_semi")
        bits, bitmap = 0, np.ones(1, dtype=np.uint8)
    else:
        bits, bitmap = id_filter(ids, n)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        unset = shared.value
        for batch in batches:
            x = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((unset[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool)))
            for b in slices(batch):
                h = [shingles(t, k).tobytes() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.binary())], names=["id", "set"])

    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    rows = map_arrow(some.select("doc_id", "text", bit), read, "id bigint, set binary")
    both = pairs.join(rows.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").join(rows.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(s.as_py(), dtype=np.uint64) for s in (x, y))
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                good.append(len(p) > 0 and len(q) > 0 and sim.holds(int(np.count_nonzero(q[at] == p)), len(p), len(q)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return map_arrow(both.select("a", "b", "sa", "sb"), compare, "a bigint, b bigint").distinct()


def near(x: str, y: str, sim: Similarity):
    """Whether two sizes allow similar sets."""
    return F.least(x, y) * sim.den >= F.greatest(x, y) * sim.num


def _ceil(a, b: int):
    return F.floor((a + (b - 1)) / b)


def _reaches(pos: str, n: str, other, sim: Similarity):
    """Whether what is left of a set at a common key suffices for a similar set of size `other`."""
    return F.col(pos) <= F.col(n) - _ceil((F.col(n) + other) * sim.num, sim.num + sim.den)


def _contracted(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """`entries` with root replaced by the smallest root within two links (`edges`: ra, rb) of it. Equal roots
    are linked documents; that some linked ones keep different roots costs pairs, not links. A component may
    hold a third of all entries, so they are dealt over SALTS keys."""
    both = edges.select(F.col("ra").alias("u"), F.col("rb").alias("v")).unionByName(edges.select(F.col("rb").alias("u"), F.col("ra").alias("v"))).distinct()
    one = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    two = both.join(one.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.least(F.min("m"), F.col("u")).alias("m")).filter("m < u")
    salted = two.select(F.col("u").alias("root"), "m", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    out = entries.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["root", "salt"], "left")
    return settle(out.withColumn("root", F.coalesce("m", "root")).drop("m", "salt"), "placed")


def _pairs_left(placed: DataFrame) -> float:
    """Pairs of different components that members left on lists would make."""
    sides = placed.groupBy("key", "root").agg(F.count(F.lit(1)).cast("double").alias("k"))
    lists = sides.groupBy("key").agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("same"))
    return lists.agg(F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("same")) / 2), F.lit(0.0))).first()[0]


def join(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id for every row; k words, similarity num / den."""
    sim = Similarity(num, den)
    every = settle(sets(docs, k, sim), "sets")
    full = every.filter("n > 0 AND doc_id IS NOT NULL")
    # copies of one text, however many, are dealt over SALTS keys: classes are counted and met in parts
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    parts = full.groupBy("s1", "s2", "n", salt.alias("salt")).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    classes = settle(parts.groupBy("s1", "s2", "n").agg(F.min("rep").alias("rep"), F.sum("rows").alias("rows")), "classes")
    copies = classes.filter("rows > 1").select("s1", "s2", "n", "rep", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    found = full.select("doc_id", "s1", "s2", "n", salt.alias("salt")).join(copies, ["s1", "s2", "n", "salt"], "left")
    members = settle(found.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "members")
    again = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z")
    own = members.join(again, "doc_id").select("a", F.col("rep").alias("b"))  # texts of one doc_id

    reps = full.join(classes.filter(F.col("n") >= sim.least_size()).select(F.col("rep").alias("doc_id"), "s1", "s2", "n"), ["doc_id", "s1", "s2", "n"], "left_semi")
    reps = settle(reps.select("doc_id", "n", "keys"), "representatives")
    entries = reps.select("doc_id", "n", F.inline("keys"))
    lists = entries.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.min("n").alias("low")).filter("a < z").select("key", "low")
    placed = entries.join(lists, "key").filter(_reaches("pos", "n", F.greatest("low", _ceil(F.col("n") * num, den)), sim))
    placed = settle(placed.select("key", "pos", "doc_id", "n", F.col("doc_id").alias("root")), "lists")
    links = tested = None
    entries_in_lists, before = placed.count(), math.inf
    for k_round in range(MOST_ROUNDS):
        if k_round >= PIVOT_ROUNDS:
            left = _pairs_left(placed)
            if left <= PAIRS_AN_ENTRY * entries_in_lists or left > GAIN * before:
                break
            before = left
        # the member for which the key is the rarest is the least edited one: it hardly has shingles of
        # its own, so the others are likeliest to be similar to it
        entry = F.struct("pos", "doc_id", "n", "root")  # as rows may share doc_id
        pivots = placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("z"), F.min(entry).alias("p"), F.count(F.lit(1)).alias("members"))
        x = settle(placed.join(pivots.filter("r < z").select("key", "p", "members"), "key"), "pivots")  # a list of one component is done
        fit = _reaches("pos", "n", F.col("p.n"), sim) & _reaches("p.pos", "p.n", F.col("n"), sim)
        pairs = x.filter("root <> p.root").filter(near("n", "p.n", sim) & fit)
        pairs = pairs.select(F.least("p.doc_id", "doc_id").alias("a"), F.greatest("p.doc_id", "doc_id").alias("b"), F.least("p.root", "root").alias("ra"), F.greatest("p.root", "root").alias("rb")).distinct()
        pairs = settle(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = settle(verified(pairs.select("a", "b"), docs, k, sim), "verified")
        links = found if links is None else links.unionByName(found)
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        # the pivot has met every member, so a list of two is done; only those that stay need their roots
        stay = x.filter((F.col("members") > 2) & (F.col("p") != entry))
        placed = _contracted(stay.drop("p", "members"), pairs.join(found, ["a", "b"], "left_semi"))

    open_ = placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("z")).filter("r < z").select("key")
    rest = placed.join(open_, "key")
    # each member meets each block of its list once: it stands in its own row of blocks, and once in
    # every column
    size = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rest = rest.join(size, "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    left = rest.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.col("own") * F.col("blocks") + j)))
    right = rest.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i * F.col("blocks") + F.col("own"))))
    # members against members of other components; pairs with a pivot are verified already
    fit = _reaches("x.pos", "x.n", F.col("y.n"), sim) & _reaches("y.pos", "y.n", F.col("x.n"), sim)
    other = F.expr("x.key = y.key AND x.cell = y.cell AND x.doc_id < y.doc_id AND x.root <> y.root")
    more = left.alias("x").join(right.alias("y"), other & near("x.n", "y.n", sim) & fit)
    more = settle(more.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    roots = components(links.unionByName(verified(more, docs, k, sim)).unionByName(own), "a", "b")

    found = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n", F.coalesce("root", "rep").alias("component_id"))
    alone = every.filter("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return join(docs, k=4, num=17, den=20)


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its component, and those without doc_id."""
    gone = join(docs, k, num, den).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, greatest(len(ws) - 3, 1) + 1)]) AS sh FROM w WHERE len(ws) > 0),
c AS (SELECT sh, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(sh) AS sh FROM s) GROUP BY sh),
e AS (SELECT rep, len(sh) AS n, unnest(sh) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS m FROM e AS a JOIN e AS b ON a.g = b.g AND a.rep < b.rep AND least(a.n, b.n) * 100 >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * m >= 85 * (na + nb - m)),
b AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep, rep AS c FROM c),
k AS (WITH RECURSIVE t(rep, c) AS (SELECT rep, rep FROM c UNION SELECT b.b, t.c FROM t JOIN b ON t.rep = b.a WHERE t.c < b.b) SELECT rep, min(c) AS c FROM t GROUP BY rep),
m AS (SELECT s.doc_id, len(s.sh) AS n, k.c FROM s JOIN c ON list_sort(s.sh) = c.sh JOIN k ON k.rep = c.rep)
SELECT w.doc_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id FROM w LEFT JOIN m ON w.doc_id = m.doc_id
"""
