"""Mixing sources to target weights by entropy balancing.

A document's size is its number of words. Sources, in code-point order and null last, take weights in
turn; together they get `share` of all sizes by weight. A target stops at `most` times its source's size
and the excess is shared anew by weight, until none is above (the level of a water-filling).

Document rates w are those nearest to one copy of everything (least relative entropy) that meet the word
constraint of every source, with at most `most` copies: w = min(most, exp(lambda * size)), one lambda a
source. The dual in lambda is convex; Newton steps, kept inside a bracket, solve it for all sources at
once, each step one aggregation over the table. Rates depend on source and size only, so the
table is first reduced to cells (source, size class); a class is one size below FINE words, and above
that the sizes that share their ten leading bits. A class's documents share the rate of its mean size. Where a source
must shrink, lambda is negative and long documents go first; where it must grow, they are repeated first.

Rates become copies by error diffusion: from the largest class down, a cell's number of copies is rounded
so that the words missed so far are made up for by the classes below. Copies are dealt evenly; which
documents get one more is decided by a hash of doc_id and text. Every cell is ranked in SALTS parts by
that hash, so that one of many documents is no single task.

Everything is DataFrame functions. One row for each source goes through the driver (names, sizes, targets,
lambda: what a user lists in a mixture); a row for each cell of one source, 1,024 and 512 for each doubling
of the size above, stands in one array.

A null text has size 0, so have texts without words: they stay once (rate 1) and take no words. A very
long text is one document. Rows that repeat are rows of their own; equal ones may swap copies. Equal sizes
are chosen by hash; reruns agree. A null doc_id is a value. Other columns are ignored, and kept by mixed().
An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm.common import settle

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2
FINE_BITS = 10
FINE = 1 << FINE_BITS
SALTS = 256
STEPS, CLOSE = 60, 1e-7  # Newton steps at most, and the relative miss they stop at
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words each source shall give; `sizes` in the order of the sources."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0], share * sum(sizes)
    while open_:
        level = left / sum(w[i] for i in open_)
        full = [i for i in open_ if level * w[i] >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = level * w[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


class Dual:
    """The multiplier of one source: a bracketed Newton iteration on an increasing function."""

    def __init__(self, size: int, target: float, most: float):
        self.target, self.lam, self.low, self.high = target, 0.0, -math.inf, math.inf
        self.done = size == 0 or target == size
        if size and target >= most * size:
            self.lam, self.done = math.inf, True

    def step(self, words: float, slope: float) -> None:
        """From the words that the present multiplier gives, and their derivative."""
        miss = words - self.target
        if self.done or abs(miss) <= CLOSE * self.target:
            self.done = True
            return
        if miss > 0:
            self.high = self.lam
        else:
            self.low = self.lam
        new = self.lam - miss / slope if slope > 0 else math.nan
        if not self.low < new < self.high:
            if math.isinf(self.low) or math.isinf(self.high):
                new = self.lam + math.copysign(max(1.0, abs(self.lam)), -miss)
            else:
                new = (self.low + self.high) / 2
        self.done = new == self.lam
        self.lam = new


def keyed(docs: DataFrame) -> DataFrame:
    """docs with __s (source, null last), __size, __c (size class), __h (hash) and __salt."""
    text, source = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("source").cast("string")
    out = docs.withColumns({
        "__s": F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)),
        "__size": F.regexp_count(text, F.lit(WORD)).cast("bigint"),
        "__h": F.xxhash64(F.col("doc_id"), text),
    })
    drop = f"greatest(length(bin(__size)) - {FINE_BITS}, 0)"
    return out.withColumns({"__c": F.expr(f"shiftleft(shiftright(__size, {drop}), {drop})"), "__salt": F.pmod("__h", F.lit(SALTS)).cast("int")})


def _literal(docs: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A small table as a literal of the plan."""
    return docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _rate(lam: Column, x: Column, most: float) -> Column:
    """min(most, exp(lam x)) without overflow; a null multiplier stands for an infinite one."""
    return F.when(x == 0, F.lit(1.0)).when(lam.isNull() | (lam * x >= math.log(most)), F.lit(float(most))).otherwise(F.exp(lam * x))


def rates(cells: DataFrame, sources: list[dict], most: float) -> DataFrame:
    """A row per source: its size, target and, scaled by its mean size, the multiplier of its rates."""
    duals = {r["s"]: Dual(r["size"], r["target"], most) for r in sources}
    # sums of doubles come in any order: what they leave in the last digits is cut off, so that reruns agree
    finite = lambda lam: None if math.isinf(lam) else float(f"{lam:.9g}")
    for _ in range(STEPS):
        open_ = [{"s": s, "lam": d.lam, "scale": r["scale"]} for r in sources for s, d in [(r["s"], duals[r["s"]])] if not d.done]
        if not open_:
            break
        x = F.col("__words") / F.col("__n") / F.col("scale")
        w = _rate(F.col("lam"), x, most)
        at = cells.join(F.broadcast(_literal(cells, open_, "s string, lam double, scale double")), F.col("__s") == F.col("s"))  # a row per source
        slope = F.when(w < most, F.col("__words") * x * w).otherwise(0.0)
        for s, words, slopes in at.groupBy("s").agg(F.sum(F.col("__words") * w), F.sum(slope)).collect():
            duals[s].step(words, slopes)
    rows = [{**r, "lam": finite(duals[r["s"]].lam)} for r in sources]
    return _literal(cells, rows, "s string, size bigint, target double, scale double, lam double")


def rounded(cells: DataFrame, found: DataFrame, most: float) -> DataFrame:
    """Per cell: rate, copies of every document, and how many documents get one more (extra); with the
    size and target of the source."""
    x = F.col("__words") / F.col("__n")
    every = cells.join(F.broadcast(found), F.col("__s") == F.col("s")).withColumn("rate", _rate(F.col("lam"), x / F.col("scale"), most))  # a row per source
    one = F.struct(F.col("__c").alias("c"), F.col("__n").cast("double").alias("n"), x.alias("x"), F.col("rate").alias("rate"))
    listed = every.groupBy("__s").agg(F.sort_array(F.collect_list(one), asc=False).alias("cells"), F.first("size").alias("size"), F.first("target").alias("target"), F.round(F.sum(F.col("__words") * F.col("rate")), 2).alias("words"))

    def diffuse(acc, r):
        want = r["n"] * r["rate"]
        made = F.when(r["x"] > 0, F.least(r["n"] * most, F.greatest(F.lit(0.0), F.floor(want + acc["carry"] / r["x"] + 0.5).cast("double")))).otherwise(want)
        each = F.floor(made / r["n"])
        cell = F.struct(r["c"].alias("c"), r["rate"].alias("rate"), each.cast("int").alias("copies"), (made - each * r["n"]).cast("bigint").alias("extra"))
        return F.struct((acc["carry"] + (want - made) * r["x"]).alias("carry"), F.concat(acc["out"], F.array(cell)).alias("out"))

    start = F.struct((F.col("target") - F.col("words")).alias("carry"), F.array().cast("array<struct<c:bigint,rate:double,copies:int,extra:bigint>>").alias("out"))
    return listed.select("__s", F.col("size").alias("source_size"), "target", F.inline(F.aggregate("cells", start, diffuse, lambda acc: acc["out"]))).withColumnRenamed("c", "__c")


def _plan(docs: DataFrame, rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """A row per part (source, class, salt): copies of every document, and how many by hash get one more."""
    parts = settle(rows.groupBy("__s", "__c", "__salt").agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__words")), "mix-parts")
    cells = settle(parts.groupBy("__s", "__c").agg(F.sum("__n").alias("__n"), F.sum("__words").alias("__words")), "mix-cells")
    sums = cells.groupBy("__s").agg(F.sum("__words"), F.sum("__n")).collect()  # a row per source
    sums = sorted(tuple(r) for r in sums)  # code points, null last
    aims = targets([r[1] for r in sums], weights, share, most)
    sources = [{"s": s, "size": size, "target": t, "scale": max(size, 1) / n} for (s, size, n), t in zip(sums, aims)]
    planned = rounded(cells, rates(cells, sources, most), most)
    before = F.sum("__n").over(Window.partitionBy("__s", "__c").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))  # SALTS rows at most
    split = parts.join(planned, ["__s", "__c"]).withColumn("__b", F.coalesce(before, F.lit(0)))
    extra = F.greatest(F.lit(0), F.least(F.col("__n"), F.col("extra") - F.col("__b")))
    return settle(split.select("__s", "__c", "__salt", "source_size", "target", "rate", "copies", extra.alias("__extra")), "mix-plan")


def _mix(docs: DataFrame, rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """`rows`, from keyed(), with size, source_size, target, rate, copies and taken."""
    plan = _plan(docs, rows, weights, share, most)
    rank = F.row_number().over(Window.partitionBy("__s", "__c", "__salt").orderBy("__h", "doc_id"))
    joined = rows.join(plan, ["__s", "__c", "__salt"]).withColumn("copies", F.col("copies") + F.when(rank <= F.col("__extra"), 1).otherwise(0))
    return joined.withColumns({"size": F.col("__size"), "taken": F.col("copies") * F.col("__size")}).drop("__s", "__c", "__salt", "__h", "__size", "__extra")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target (of the source), rate, copies int and taken (words)."""
    rows = settle(keyed(docs.select("doc_id", "text", "source")).drop("text"), "mix-rows")
    return _mix(docs, rows, weights, share, most).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of `docs`, with all their columns, each as often as the mix takes it."""
    rows = keyed(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("__row")))
    out = _mix(docs, rows, weights, share, most).filter("copies > 0")
    return out.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
