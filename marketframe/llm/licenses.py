"""License scans by diagonal voting.

All rolling word k-grams of the documents are joined in Spark, by hash and by their words, to the
places that they have in license templates (a small table, broadcast within BROADCAST_PLACES rows and
joined by shuffle beyond). A hit votes for the diagonal document place minus template place; votes are
counted by (document, template, diagonal), and neighbouring diagonals are merged (an inserted or missing
passage shifts the diagonal by its length: up to `gap` words, or a quarter of a long template). Runs whose
votes cover enough of the template are candidates, and their spans are verified in place: of the votes in a
stretch of the document no longer than the template and one such shift, those of the best chain count,
which goes forward in document and template alike, with no more foreign words than such a shift. The template
words under its k-grams must make up a share of the template, `cover` for templates of LONG words or more and `short_cover` for shorter ones, of which
one is easily another with a word changed. So template words in another order, or strewn over a document,
are no span.

Templates are a table (label, text), by default the wording in license_texts. Headers of related
licenses hold most of each other's words, so a document of one may get the labels of both.

The score is the largest share of a template found, 0.5 at least where a base phrase stands. Null and
empty texts have no words, no places, no labels and score 0. Repeated rows give repeated results; rows
that share doc_id but not the text count apart. A very long text is scanned whole, and a passage that
stands in it many times counts once for each place. Other columns are ignored, an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketframe.llm.bpe import slices
from marketframe.llm.common import alnum_words, free_worker, map_arrow, settle
from marketframe.llm.license_texts import TEXTS

K = 4
GAP = 3
COVER, SHORT_COVER, LONG = 0.6, 0.85, 20
BROADCAST_PLACES = 100_000

# Phrases that name a license.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTS, "label string, text string")


def with_grams(rows: DataFrame, k: int) -> DataFrame:
    """`rows` with `ws`, a row for each k-gram of it: pos (from 0), gram (its words) and hash; `ws` is dropped."""
    starts = F.sequence(F.lit(0), F.size("ws") - k)
    each = rows.filter(F.size("ws") >= k).withColumn("pos", F.explode(starts))
    each = each.withColumn("gram", F.array_join(F.slice("ws", F.col("pos") + 1, F.lit(k)), " "))
    return each.withColumn("hash", F.xxhash64("gram")).drop("ws")


def positions(templates: DataFrame, k: int = K) -> DataFrame:
    """template, label, length, tpos, gram and hash of all k-grams of the templates."""
    rows = templates.select("label", alnum_words(F.col("text")).alias("ws")).distinct()
    rows = rows.withColumns({"template": F.xxhash64("label", "ws"), "length": F.size("ws")})
    return with_grams(rows, k).withColumnRenamed("pos", "tpos")


def base_places(docs: DataFrame) -> DataFrame:
    """For every row its number of words and the places of the phrases."""
    source = docs.select("doc_id", F.xxhash64("text").alias("__h"), F.col("text").cast("string").alias("text"))
    phrases = [(b" " + p.encode() + b" ", label) for p, label in PHRASES.items()]

    def one(text: str | None):
        ws = (text or "").encode().translate(_LOWER).split()
        joined = b" " + b" ".join(ws) + b" "
        places, labels = [], set()
        for p, label in phrases:
            at = joined.find(p)
            while at >= 0:
                places.append(at)
                labels.add(label)
                at = joined.find(p, at + 1)
        word = lambda at: None if at is None else joined.count(b" ", 0, at)
        return len(ws), len(places), word(min(places, default=None)), word(max(places, default=None)), sorted(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            for b in slices(batch):
                *numbers, labels = zip(*map(one, b.column(2).to_pylist()))
                columns = [b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in numbers), pa.array(labels, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "__h", "n_words", "n_base", "first_word", "last_word", "base_labels"])

    return map_arrow(source, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, __h bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>")


def chain(pos: np.ndarray, tpos: np.ndarray, k: int) -> tuple[int, int]:
    """Template words that the best chain of k-gram hits covers, and its last place in the document. Hits
    stand by pos; a chain goes on along a diagonal, or to another one behind all words it has used."""
    best, last = np.full(len(pos), k), 0
    for i in range(1, len(pos)):
        step, far = tpos[i] - tpos[:i], pos[i] - pos[:i]
        before = (step > 0) & ((step == far) | ((step >= k) & (far >= k)))
        if before.any():
            best[i] = max(k, int((best[:i] + np.minimum(k, step))[before].max()))
        if best[i] > best[last]:
            last = i
    return int(best[last]), int(pos[last])


def verified(pos: np.ndarray, tpos: np.ndarray, length: int, k: int, reach: int, least: float) -> list[tuple[int, int, float]]:
    """(first word, end word, coverage) of the stretches, of at most `length` + `reach` words and one behind
    the other, in which the template stands with `reach` foreign words at most."""
    order = np.lexsort((tpos, pos))
    pos, tpos = pos[order], tpos[order]
    out, free = [], -1
    for first in np.unique(pos).tolist():
        if first < free:
            continue
        i, j = np.searchsorted(pos, (first, first + length + reach - k + 1))
        if len(np.unique(tpos[i:j, None] + np.arange(k))) < least * length:
            continue  # whatever the order
        words, last = chain(pos[i:j], tpos[i:j], k)
        if words >= least * length and last + k - first - words <= reach:
            out.append((first, last + k, words / length))
            free = last + k
    return out


def spans(docs: DataFrame, places: DataFrame, k: int = K, gap: int = GAP, cover: float = COVER, short_cover: float = SHORT_COVER) -> DataFrame:
    """doc_id, __h, label, first word, end word and coverage of every verified span."""
    grams = with_grams(docs.select("doc_id", F.xxhash64("text").alias("__h"), alnum_words(F.col("text").cast("string")).alias("ws")), k)
    small = F.broadcast(places) if places.count() <= BROADCAST_PLACES else places
    votes = grams.join(small, ["hash", "gram"]).dropDuplicates(["doc_id", "__h", "template", "pos", "tpos"])
    key = ["doc_id", "__h", "template", "label", "length"]
    lines = votes.groupBy(*key, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_list(F.struct("pos", "tpos")).alias("hits"))
    w = Window.partitionBy("doc_id", "__h", "template").orderBy("diagonal")
    reach = F.greatest(F.lit(gap), F.floor(F.col("length") / 4))
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > reach, F.lit(True)).cast("int")
    merged = lines.withColumn("__far", far).withColumn("__run", F.sum("__far").over(w))
    merged = merged.groupBy(*key, "__run").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda p: F.sequence(p["tpos"], p["tpos"] + k - 1)))))
    least = F.when(F.col("length") >= LONG, cover).otherwise(short_cover)
    some = merged.filter(covered / F.col("length") >= least)
    some = some.select("doc_id", "__h", "label", F.col("length").cast("int").alias("length"), reach.cast("int").alias("reach"), least.alias("least"), F.col("hits.pos").alias("pos"), F.col("hits.tpos").alias("tpos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, (length, near, share, pos, tpos) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("length", "reach", "least", "pos", "tpos")))):
                one = verified(np.asarray(pos, np.int64), np.asarray(tpos, np.int64), length, k, near, share)
                at += [i] * len(one)
                found += one
            rows = batch.select(["doc_id", "__h", "label"]).take(pa.array(at, pa.int32()))
            first, end, share = zip(*found) if found else ((), (), ())
            columns = [pa.array(first, pa.int64()), pa.array(end, pa.int64()), pa.array(share, pa.float64())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=["doc_id", "__h", "label", "first", "end", "coverage"])

    return map_arrow(some, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, __h bigint, label string, first bigint, end bigint, coverage double")


def scan(docs: DataFrame, templates: DataFrame | None = None, k: int = K, gap: int = GAP, cover: float = COVER, short_cover: float = SHORT_COVER) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (sorted arrays), score."""
    places = positions(default_templates(docs.sparkSession) if templates is None else templates, k)
    best = settle(spans(docs, places, k, gap, cover, short_cover).groupBy("doc_id", "__h").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("best")), "license-spans").alias("s")
    f = base_places(docs).alias("f")
    same = F.col("f.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("f.__h") == F.col("s.__h"))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("f.base_labels", F.coalesce("s.more", none)))
    score = F.greatest(F.when(F.col("f.n_base") > 0, 0.5).otherwise(0.0), F.coalesce("s.best", F.lit(0.0)))
    return f.join(best, same, "left").select("f.doc_id", "f.n_words", "f.n_base", "f.first_word", "f.last_word", "f.base_labels", labels.alias("labels"), score.alias("score"))


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs).withColumn("base_labels", F.array_join("base_labels", ",")).withColumn("labels", F.array_join("labels", ","))
