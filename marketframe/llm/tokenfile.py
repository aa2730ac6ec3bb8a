"""Token-ID output: a wavelet matrix per shard.

Documents are encoded, an end id is appended to each, and the ids of consecutive documents (by
ascending doc_id, nulls first) form shards of about `shard_tokens` ids; a document stands whole
in one shard. A shard is one row of one Parquet file:

    part, seq, before   its place: `before` ids of the same part precede it
    n_docs, n_tokens    its size
    documents           zstd( doc_ids, which of them are known, lengths )
    alphabet            the distinct ids in order
    zeros, ranks, planes  per bit plane: its zeros, ones before every 512th bit, its bits

An id is stored as its place in the alphabet, in bit planes, highest bit first, every plane in the
order of the stable partition by the plane before: 17 bits and a sixteenth for 50,000 ids. Planes are
not compressed further, so access(), count() and occurrences() answer from the planes and directories
of the shards that a question concerns, by Spark, and never decode a shard; read() decodes all.
Files are written by Spark, so a lost task leaves no partial file.

A null text is an empty text: its ids are the end id alone. Rows that repeat a doc_id are
documents of their own, one after the other. An empty table gives no shard and no rows. A very long
text makes one longer shard. doc_id is a whole number; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm.bpe import coder, default_tokenizer, pieces
from marketframe.llm.common import map_arrow, shared_dir

BLOCK = 512  # bits between entries of the rank directory
SHARD_TOKENS = 2_000_000
#: Positions that one task looks up in a shard at a time.
POSITIONS = 10_000


class WaveletMatrix:
    """Bit planes with rank and select over a sequence of ids."""

    def __init__(self, n: int, alphabet: np.ndarray, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.alphabet, self.planes, self.zeros, self.ranks = n, alphabet, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        present = np.zeros(int(ids.max()) + 1 if len(ids) else 0, dtype=bool)
        present[ids] = True
        alphabet = np.flatnonzero(present).astype("<u4")
        place = np.cumsum(present, dtype=np.int64) - 1
        cur = place[ids].astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for k in reversed(range(max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0)):
            ones = (cur & cur.dtype.type(1 << k)) != 0
            packed = np.packbits(ones)
            planes.append(packed)
            ranks.append(cls._directory(packed))
            zeros.append(len(cur) - int(np.count_nonzero(ones)))
            cur = np.concatenate((cur[~ones], cur[ones]))
        return cls(len(ids), alphabet, planes, zeros, ranks)

    @staticmethod
    def _directory(packed: np.ndarray) -> np.ndarray:
        """Ones before each block, as unsigned 32-bit integers."""
        padded = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), dtype=np.uint8)
        padded[: len(packed)] = packed
        per = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        return np.concatenate(([0], np.cumsum(per, dtype=np.uint32))).astype("<u4")

    def sequence(self) -> np.ndarray:
        """All ids in order, from the last plane up."""
        val = np.zeros(self.n, dtype=np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for bit, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            ones = np.unpackbits(plane, count=self.n).view(bool)
            up = np.empty_like(val)
            up[~ones] = val[:z]
            up[ones] = val[z:] | val.dtype.type(1 << bit)
            val = up
        return self.alphabet[val]

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each of the given places of a plane: the directory's count and the bits since."""
        block = at // BLOCK
        plane = self.planes[level]
        bytes_ = block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8)
        held = plane[np.minimum(bytes_, len(plane) - 1)]
        bits = np.clip(at[:, None] - bytes_ * 8, 0, 8).astype(np.uint8)
        held &= (0xFF00 >> bits.astype(np.uint16)).astype(np.uint8)  # the first `bits` bits of each byte
        return self.ranks[level][block].astype(np.int64) + np.bitwise_count(held).sum(axis=1, dtype=np.int64)

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        at = np.asarray(places, dtype=np.int64)
        if len(at) and not (0 <= at.min() and at.max() < self.n):
            raise IndexError("place outside of the sequence")
        code = np.zeros(len(at), dtype=np.int64)
        for level, z in enumerate(self.zeros):
            bit = self.planes[level][at // 8] >> (7 - at % 8).astype(np.uint8) & 1
            ones = self._ones(level, at)
            at = np.where(bit, z + ones, at - ones)
            code = code << 1 | bit
        return self.alphabet[code]

    def _code(self, token: int) -> int | None:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and int(self.alphabet[k]) == token else None

    def _down(self, code: int, at: np.ndarray) -> np.ndarray:
        """Where places of the sequence arrive behind the last plane on the way of a code."""
        for level, z in enumerate(self.zeros):
            ones = self._ones(level, at)
            at = z + ones if code >> (len(self.zeros) - 1 - level) & 1 else at - ones
        return at

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token among the first i ids."""
        code = self._code(token)
        if code is None:
            return 0
        lo, hi = self._down(code, np.asarray([0, min(i, self.n)]))
        return int(hi - lo)

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, which: np.ndarray | None = None) -> np.ndarray:
        """The places of the given occurrences (from 0) of a token, or of all, in order."""
        code = self._code(token)
        if code is None:
            if which is not None and len(which):
                raise IndexError("no such occurrence")
            return np.empty(0, dtype=np.int64)
        lo, hi = (int(x) for x in self._down(code, np.asarray([0, self.n])))
        which = np.arange(hi - lo) if which is None else np.asarray(which, dtype=np.int64)
        if len(which) and not (0 <= which.min() and which.max() < hi - lo):
            raise IndexError("no such occurrence")
        at = lo + which
        for level in reversed(range(len(self.zeros))):
            bit = code >> (len(self.zeros) - 1 - level) & 1
            at = self._select_bits(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _select_bits(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """The places of the k-th zeros or ones of a plane: bisection of the directory, then a block."""
        ranks, plane = self.ranks[level], self.planes[level]
        before = lambda block: ranks[block].astype(np.int64) if bit else block * BLOCK - ranks[block].astype(np.int64)
        lo, hi = np.zeros(len(k), dtype=np.int64), np.full(len(k), len(ranks) - 1, dtype=np.int64)
        while (hi - lo > 1).any():  # the last block with no more than k of them before it
            mid = (lo + hi) // 2
            left = before(mid) <= k
            lo, hi = np.where(left, mid, lo), np.where(left, hi, mid)
        out = np.empty(len(k), dtype=np.int64)
        for i in range(0, len(k), 10_000):
            block = lo[i : i + 10_000]
            held = np.unpackbits(plane[np.minimum(block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8), len(plane) - 1)], axis=1) == bit
            nth = (k[i : i + 10_000] - before(block))[:, None] + 1
            out[i : i + 10_000] = block * BLOCK + np.argmax(np.cumsum(held, axis=1, dtype=np.int32) >= nth, axis=1)
        return out


SHARDS = "part int, seq int, before bigint, n_docs bigint, n_tokens bigint, documents binary, alphabet binary, zeros array<bigint>, ranks array<binary>, planes array<binary>"
ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("documents", pa.binary()), ("alphabet", pa.binary()), ("zeros", pa.list_(pa.int64())), ("ranks", pa.list_(pa.binary())), ("planes", pa.list_(pa.binary()))])
#: The columns that hold a wavelet matrix.
MATRIX = ["n_tokens", "alphabet", "zeros", "ranks", "planes"]


def pack_documents(doc_ids: pa.Array, lengths: np.ndarray) -> bytes:
    ids = doc_ids.fill_null(0).to_numpy().astype("<i8")
    known = np.packbits(doc_ids.is_valid().to_numpy(zero_copy_only=False))
    return zstandard.ZstdCompressor(level=1).compress(ids.tobytes() + lengths.astype("<u4").tobytes() + known.tobytes())


def unpack_documents(data: bytes, n: int) -> tuple[pa.Array, np.ndarray]:
    """(doc_ids, lengths)"""
    raw = zstandard.ZstdDecompressor().decompress(data)
    known = np.unpackbits(np.frombuffer(raw, "u1", offset=12 * n), count=n).astype(bool)
    return pa.array(np.frombuffer(raw, "<i8", n), pa.int64(), mask=~known), np.frombuffer(raw, "<u4", n, offset=8 * n)


def matrix_of(row: dict) -> WaveletMatrix:
    """The wavelet matrix in the columns MATRIX of a shard, given as Arrow scalars."""
    view = lambda x, kind: np.frombuffer(x.as_buffer(), dtype=kind)
    return WaveletMatrix(row["n_tokens"].as_py(), view(row["alphabet"], "<u4"), [view(p, "u1") for p in row["planes"]], row["zeros"].as_py(), [view(r, "<u4") for r in row["ranks"]])


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[dict, WaveletMatrix]]:
    """The rows of a batch that holds the columns MATRIX, as Arrow scalars by name, with their matrices."""
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i] for c in batch.schema.names}
        yield row, matrix_of(row)


def write(docs: DataFrame, path: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS, tokenizer: str | None = None) -> None:
    """Writes the shards of doc_id and text to `path`, one file each."""
    file = tokenizer or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # the hash parts rows that repeat an id
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, part = coder(file), TaskContext.get().partitionId()
        doc_ids: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        seq = before = held = 0

        def shard() -> pa.RecordBatch:
            nonlocal seq, before, held
            wm = WaveletMatrix.build(np.concatenate(ids))
            documents = pack_documents(pa.concat_arrays(doc_ids), np.concatenate(lengths))
            row = [part, seq, before, sum(map(len, doc_ids)), wm.n, documents, wm.alphabet.tobytes(), wm.zeros, [r.tobytes() for r in wm.ranks], [p.tobytes() for p in wm.planes]]
            seq, before, held = seq + 1, before + wm.n, 0
            for x in (doc_ids, lengths, ids):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, ARROW)], schema=ARROW)

        for batch in batches:
            for b in pieces(batch, 1):
                found = c.encode_column(b.column(1))
                ends = np.frombuffer(found.buffers()[1], "<i4")[found.offset : found.offset + len(found) + 1] // 4
                flat = np.frombuffer(found.buffers()[2] or b"", "<u4")[ends[0] : ends[-1]]
                n = np.diff(ends) + 1
                with_ends = np.insert(flat, ends[1:] - ends[0], end_id)
                done = np.concatenate(([0], np.cumsum(n)))
                # documents fill the shard up to its bound; a piece may fill several
                start = 0
                while start < len(n):
                    stop = min(len(n), int(np.searchsorted(done, done[start] + shard_tokens - held)))
                    stop = max(stop, start + 1)
                    doc_ids.append(b.column(0).slice(start, stop - start))
                    lengths.append(n[start:stop])
                    ids.append(with_ends[done[start] : done[stop]])
                    held += int(done[stop] - done[start])
                    start = stop
                    if held >= shard_tokens:
                        yield shard()
        if doc_ids:
            yield shard()

    map_arrow(rows, run, SHARDS).write.option("maxRecordsPerFile", 1).option("compression", "uncompressed").parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards of `path` with `first`, the number of ids in all shards before each."""
    rows = spark.read.schema(SHARDS).parquet(path)
    base, starts = 0, []
    for part, n in sorted(map(tuple, rows.groupBy("part").agg(F.sum("n_tokens")).collect())):  # a row for each partition of the writer
        starts.append({"part": part, "base": base})
        base += n
    bases = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(starts)), "array<struct<part int, base bigint>>")))
    return rows.join(F.broadcast(bases), "part").withColumn("first", F.col("base") + F.col("before")).drop("base")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start long, n_tokens long, ids binary and ids_crc32 long of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, wm in matrices(batch):
                doc_ids, lengths = unpack_documents(row["documents"].as_py(), row["n_docs"].as_py())
                data = wm.sequence().astype("<u4").tobytes()
                ends = np.cumsum(lengths, dtype=np.int64)
                starts, first = ends - lengths, row["first"].as_py()
                for i in range(0, len(ends), 2000):
                    own = [data[4 * a : 4 * b] for a, b in zip(starts[i : i + 2000].tolist(), ends[i : i + 2000].tolist())]
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(i, 2000), pa.array(first + starts[i : i + 2000], pa.int64()), pa.array(lengths[i : i + 2000].astype(np.int64)), pa.array(own, pa.binary()), pa.array(list(map(zlib.crc32, own)), pa.int64())], names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    source = shards(spark, path).select("first", "n_docs", "documents", *MATRIX)
    return map_arrow(source, run, "doc_id bigint, start bigint, n_tokens bigint, ids binary, ids_crc32 bigint")


def count(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token int and n long, its occurrences in all shards, for each of the given tokens."""
    asked = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, wm in matrices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int32()), pa.array([wm.count(t) for t in asked], pa.int64())], names=["token", "n"])

    every = spark.createDataFrame([(t,) for t in asked], "token int").withColumn("n", F.lit(0).cast("bigint"))
    found = map_arrow(spark.read.schema(SHARDS).parquet(path).select(*MATRIX), run, "token int, n bigint")
    return found.unionByName(every).groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token int, pos long (from 0 over all shards) and doc_id of every occurrence of the given tokens."""
    asked = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, wm in matrices(batch):
                doc_ids, lengths = unpack_documents(row["documents"].as_py(), row["n_docs"].as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                for t in asked:
                    for i in range(0, n := wm.count(t), POSITIONS):
                        at = wm.select(t, np.arange(i, min(n, i + POSITIONS)))
                        own = doc_ids.take(pa.array(np.searchsorted(ends, at, side="right")))
                        yield pa.RecordBatch.from_arrays([pa.array([t] * len(at), pa.int32()), pa.array(row["first"].as_py() + at, pa.int64()), own], names=["token", "pos", "doc_id"])

    source = shards(spark, path).select("first", "n_docs", "documents", *MATRIX)
    return map_arrow(source, run, "token int, pos bigint, doc_id bigint")


def access(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """pos long and token int for every different place in `positions` (column pos, from 0 over all
    shards); places outside of the sequence, and null, give no row.

    Places meet their shard on equal steps of SHARD_TOKENS ids, then by its bounds, and go to it in
    blocks of about POSITIONS."""
    rows = shards(spark, path)
    step = F.lit(SHARD_TOKENS)
    bounds = rows.select("part", "seq", "first", "n_tokens")
    bounds = bounds.withColumn("step", F.explode(F.sequence(F.floor(F.col("first") / step), F.floor((F.col("first") + F.col("n_tokens") - 1) / step))))
    asked = positions.select(F.col("pos").cast("bigint").alias("pos")).distinct().withColumn("step", F.floor(F.col("pos") / step))
    placed = asked.join(bounds, "step").filter((F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("first") + F.col("n_tokens")))
    block = F.floor((F.col("pos") - F.col("first")) / POSITIONS)
    packs = placed.groupBy("part", "seq", "first", block.alias("block")).agg(F.collect_list((F.col("pos") - F.col("first")).cast("int")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, wm in matrices(batch):
                at = np.asarray(row["places"].values, dtype=np.int64)
                for i in range(0, len(at), POSITIONS):
                    some = at[i : i + POSITIONS]
                    yield pa.RecordBatch.from_arrays([pa.array(row["first"].as_py() + some, pa.int64()), pa.array(wm.access(some).astype(np.int32))], names=["pos", "token"])

    source = rows.drop("first").join(packs, ["part", "seq"]).select("first", "places", *MATRIX)
    return map_arrow(source, run, "pos bigint, token int")


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, read back from files in the shared folder."""
    path = shared_dir(docs.sparkSession, "token-shards")
    write(docs, path, tokenizer=tokenizer)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", "ids_crc32")
