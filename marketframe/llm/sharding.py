"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A row's place on the ring is a hash of its doc_id (of its text where the id is null), read in
`slots` equal steps. Every shard owns the arcs that end in one of its virtual nodes and takes the
rows of its arcs in ring order until it is full; rows that find their shard full go on clockwise
to the next virtual node of a shard with room. A shard's bound is the mean count, rounded so that
the bounds sum to the number of rows: counts are at most one apart (the law `rows`).

Only the counts by slot (at most `slots` rows) reach the driver; it lays the arcs out, and the
rows join that layout by slot. A slot with far more rows than the mean (one doc_id that repeats, or
rows without one) is ranked in SALTS parts.

Equal texts are not kept together: only doc_id decides a row's place, as copies in one shard could
break the law. Repeated rows are rows of their own; among equal rows any may get any of their slots.
A null text counts as the empty text; a very long one is a row like others. Columns but doc_id and
text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketframe.llm.common import settle

SLOTS = 16_384
VIRTUAL_NODES = 64
SALTS = 64
HOT_ROWS = 100_000  # a slot of more rows, and of more than four times the mean, is ranked in parts


def ring(n_shards: int, virtual_nodes: int = VIRTUAL_NODES, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(slot, shard) of all virtual nodes, clockwise."""
    place = lambda s, v: int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:8], 16)
    return sorted((place(s, v) * slots >> 32, s) for s in range(n_shards) for v in range(virtual_nodes))


def bounds(rows: int, n_shards: int) -> list[int]:
    """Rows a shard may hold."""
    return [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]


def lay_out(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(slot, first rank, end rank, shard, shard's slot of the first) of every stretch of rows.

    Arcs fill their own shards first; what is left then moves on clockwise."""
    left, taken = list(room), [0] * len(room)
    out, over = [], []
    starts = [p for p, _ in nodes]

    def take(slot: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, left[shard])
        if n:
            out.append((slot, lo, lo + n, shard, taken[shard]))
            left[shard] -= n
            taken[shard] += n
        return lo + n

    for slot in sorted(counts):
        at = bisect_left(starts, slot) % len(nodes)
        lo = take(slot, 0, counts[slot], nodes[at][1])
        if lo < counts[slot]:
            over.append((slot, lo, counts[slot], at))
    for slot, lo, hi, at in over:
        while lo < hi:
            at = (at + 1) % len(nodes)
            lo = take(slot, lo, hi, nodes[at][1])
    return out


def assign(docs: DataFrame, n_shards: int = 8, virtual_nodes: int = VIRTUAL_NODES, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, shard int and slot long (gapless from 0 in each shard)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(" ", F.lit("no id"), "text_crc32", "size"))
    rows = rows.withColumn("__h", F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"))
    rows = rows.withColumns({"__p": F.shiftright(F.col("__h") * slots, 32).cast("int"), "__i": F.monotonically_increasing_id()})
    rows = settle(rows, "ring")  # the numbers of rows stay the same in all that follows
    counts = {r[0]: r[1] for r in rows.groupBy("__p").count().collect()}  # at most `slots` rows
    total = sum(counts.values())
    layout = lay_out(counts, ring(n_shards, virtual_nodes, slots), bounds(total, n_shards))
    spark = docs.sparkSession
    stretches = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip("pabst", x)) for x in layout])), "array<struct<p int, a bigint, b bigint, s int, t bigint>>")))
    hot = [p for p, n in counts.items() if n > max(HOT_ROWS, 4 * total / slots)]
    rows = rows.withColumn("__s", F.when(F.col("__p").isin(hot), F.pmod("__i", F.lit(SALTS))).otherwise(0)) if hot else rows.withColumn("__s", F.lit(0))
    rank = F.row_number().over(Window.partitionBy("__p", "__s").orderBy("__h", "doc_id", "text_crc32", "size", "__i")).cast("bigint") - 1
    ranked = rows.withColumn("__r", rank)
    if hot:  # ranks go on from part to part of a hot slot
        before = F.coalesce(F.sum("count").over(Window.partitionBy("__p").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = rows.filter(F.col("__p").isin(hot)).groupBy("__p", "__s").count().withColumn("__b", before).drop("count")  # at most SALTS rows for each hot slot
        ranked = ranked.join(F.broadcast(parts), ["__p", "__s"], "left").withColumn("__r", F.col("__r") + F.coalesce("__b", F.lit(0)))
    at = (F.col("__p") == F.col("p")) & (F.col("__r") >= F.col("a")) & (F.col("__r") < F.col("b"))
    joined = ranked.join(F.broadcast(stretches), at)  # at most `slots` stretches and n_shards more for each full shard
    return joined.select("doc_id", "size", "text_crc32", F.col("s").alias("shard"), (F.col("t") + F.col("__r") - F.col("a")).alias("slot"))


def digest(docs: DataFrame) -> DataFrame:
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
