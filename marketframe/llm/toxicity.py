"""Toxicity by weak supervision.

1. Voters. On labelled training rows every word, every word start of 3 to 6 letters and every start
   that two or three different words of the text share is counted by mark. Those that lean clearly to
   the toxic mark, and stand in at least as many toxic rows as others, become voters: words are
   lexicon voters, the others pattern voters.
2. Label model. It sees the votes, never the marks. Correlated voters form families; a family votes
   with one of LEVELS + 1 levels, the number of its voters that fire (none included, so silence speaks
   for clean). The generative model has a clean class and one toxic class per family, as families
   (the lexicons of different languages, say) exclude each other; expectation maximisation estimates
   how often each class shows each level. Marks choose the voters and start the first round, no more.
   `rates` has each voter's estimated share of votes in toxic and in clean texts.
3. Classifier. A linear (logistic) model on all leaning features is fitted to the posterior labels,
   and scores every whole text.

The fit uses at most about SAMPLE_ROWS labelled rows (a stated bound, drawn by a hash of doc_id); all
features that these rows hold are counted and all that lean are used. Labels, lang, source and doc_id
are no inputs of a score. Where no feature reaches MIN_LEAN standard errors, as with few labels, the
bound is FEW_LEAN instead.

A null or empty text gets the score of a text without any feature. Several labels of one doc_id
count as their largest. Without usable toxic marks every score is 0, without clean ones 1, and without
leaning features it is the share of toxic marks. Repeated rows give repeated results, an empty table
none; a very long text is scored whole. A kept column named like the score gives way to it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.bpe import slices
from marketframe.llm.common import bounded_batches, free_driver, free_worker, map_arrow, settle

SAMPLE_ROWS = 20_000
STARTS = (3, 4, 5, 6)
SHARED = (2, 3)
MIN_LEAN, FEW_LEAN = 5.0, 1.5  # standard errors by which a feature leans to the toxic mark
CORRELATED = 0.25  # voters of a family
LEVELS = 6
ROUNDS = 5
REGULAR = 1e-4  # of the linear model
MEMO_WORDS = 200_000
PAIRS = 2_000_000  # of voters, before they are counted

_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """The word itself and its starts, marked apart."""
    return [f"w:{word}", *(f"p:{word[:n]}" for n in STARTS if len(word) > n)]


def words_in(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def with_shared(counts: Counter) -> set[str]:
    """Features of a text from how many of its different words have each: starts that two or three
    words share are features of their own."""
    found = set(counts)
    for f, n in counts.items():
        if n > 1 and f[0] == "p":
            found.update(f"{f}#{k}" for k in SHARED if n >= k)
    return found


def text_features(text: str | None) -> set[str]:
    return with_shared(Counter(f for w in words_in(text) for f in features_of(w)))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and y of at most about `rows` labelled rows that may be learnt from."""
    may = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 != 0)
    marks = may.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    share = min(1.0, rows / max(marks.count(), 1))
    drawn = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").select("text", "y")  # about `rows` rows


def count_features(sample: DataFrame) -> DataFrame:
    """feature, n1 and n0: rows with either mark that hold it, counted per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 500):
                counts = (Counter(), Counter())
                for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    counts[y].update(text_features(text))
                names = list(counts[0] | counts[1])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[y][f] for f in names], pa.int64()) for y in (1, 0))], names=["feature", "n1", "n0"])

    return map_arrow(sample, run, "feature string, n1 bigint, n0 bigint").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


class LabelModel:
    """Latent classes of texts by the votes of families of correlated voters. Only votes that fire are held."""

    def __init__(self, text: np.ndarray, voter: np.ndarray, n: int, voters: int):
        """Votes: numbers of texts (ascending, below n) and of the voters (below `voters`) that fire in them."""
        self.text, self.voter, self.n, self.voters = text, voter, n, voters
        self.family = self._families()
        families = int(self.family.max()) + 1
        held, sums = np.unique(text * families + self.family[voter], return_counts=True)
        #: the families that vote in a text, and with which level
        self.of, self.by, self.level = held // families, held % families, np.minimum(sums, LEVELS)
        first = np.lexsort((self.by, -sums, self.of))
        texts, at = np.unique(self.of[first], return_index=True)
        self.strongest = np.full(n, -1)
        self.strongest[texts] = self.by[first][at]
        self.rates: np.ndarray | None = None

    def _together(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pairs of voters that fire in one text, and in how many."""
        codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        held: list[np.ndarray] = []

        def reduce(codes, counts):
            new, at = np.unique(np.concatenate([codes, *held]), return_inverse=True)
            weights = np.concatenate((counts, np.ones(sum(map(len, held)), np.int64)))
            held.clear()
            return new, np.bincount(at, weights, len(new)).astype(np.int64)

        for d in range(1, len(self.text)):
            same = self.text[d:] == self.text[:-d]
            if not same.any():
                break
            a, b = self.voter[:-d][same], self.voter[d:][same]
            held.append(np.minimum(a, b) * self.voters + np.maximum(a, b))
            if sum(map(len, held)) > PAIRS:
                codes, counts = reduce(codes, counts)
        return reduce(codes, counts)

    def _families(self) -> np.ndarray:
        """A number per voter: connected components of voters whose votes correlate over all texts. Voters
        that fire in no text together can't."""
        mean = np.bincount(self.voter, minlength=self.voters) / self.n
        sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
        codes, counts = self._together()
        a, b = codes // self.voters, codes % self.voters
        near = (counts / self.n - mean[a] * mean[b]) / (sd[a] * sd[b]) > CORRELATED
        a, b, label = a[near], b[near], np.arange(self.voters)
        while True:
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            if (new == label).all():
                return np.unique(label, return_inverse=True)[1]
            label = new

    def fit(self, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """The posteriors of the toxic classes together; `start` are the first ones."""
        families, levels = int(self.family.max()) + 1, LEVELS + 1
        cell = self.by * levels + self.level  # a family's level 0, silence, is what is left of its texts
        voted = self.strongest >= 0
        share = np.bincount(self.strongest[voted], start[voted], families) + 1.0
        q = np.zeros((self.n, families + 1))
        q[:, 0] = 1 - start
        q[voted, 1 + self.strongest[voted]] = start[voted]
        q[~voted, 1:] = np.outer(start[~voted], share / share.sum())
        for _ in range(rounds):
            total = q.sum(axis=0)
            odds = np.empty_like(q)
            for k in range(families + 1):
                held = np.bincount(cell, q[self.of, k], families * levels).reshape(families, levels)
                held[:, 0] = total[k] - held.sum(axis=1)
                logs = np.log(held + 0.1)
                logs -= np.log((held + 0.1).sum(axis=1, keepdims=True))
                odds[:, k] = np.log((total[k] + 1) / (self.n + families + 1)) + logs[:, 0].sum()
                odds[:, k] += np.bincount(self.of, (logs - logs[:, :1]).reshape(-1)[cell], self.n)
            q = np.exp(odds - odds.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
        toxic = 1 - q[:, 0]
        self.rates = np.stack([(np.bincount(self.voter, w[self.text], self.voters) + 0.5) / (w.sum() + 1) for w in (toxic, 1 - toxic)])
        return toxic


class Classifier:
    """Feature weights and an intercept."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept
        self.plain = {f.partition("#")[0] for f in weights}
        self.memo: dict[str, tuple[str, ...]] = {}

    def __getstate__(self):
        return {**self.__dict__, "memo": {}}

    def _found(self, word: str) -> tuple[str, ...]:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        own = self.memo[word] = tuple(f for f in features_of(word) if f in self.plain)
        return own

    def score(self, text: str | None) -> float:
        memo, found = self.memo, []
        for w in words_in(text):
            own = memo.get(w)
            found += self._found(w) if own is None else own
        z = self.intercept
        if found:
            z += sum(self.weights.get(f, 0.0) for f in sorted(with_shared(Counter(found))))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def present(sample: DataFrame, chosen: list[str]) -> DataFrame:
    """y and, as numbers, the chosen features of each row."""
    number = {f: i for i, f in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            found = [sorted(number[f] for f in text_features(t) if f in number) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["y", "found"])

    return map_arrow(sample, run, "y int, found array<int>")


def leaning(sample: DataFrame, all1: int, all0: int) -> list:
    """feature, n1, n0 of the features that lean to the toxic mark, by name."""
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    odds = F.log(a / (F.lit(all1) - F.col("n1") + 0.5)) - F.log(b / (F.lit(all0) - F.col("n0") + 0.5))
    ranked = settle(count_features(sample).withColumn("z", odds / F.sqrt(1 / a + 1 / b)).filter(F.col("z") >= FEW_LEAN), "features")
    for least in (MIN_LEAN, FEW_LEAN):
        found = ranked.filter(F.col("z") >= least).orderBy("feature").collect()  # of the words of a bounded sample
        if found:
            break
    return found


def posteriors(held: pa.Table, voters: np.ndarray, n_features: int) -> np.ndarray:
    """The label model's posteriors of the rows of present(); `voters` are the numbers of features that vote."""
    y, found = held.column("y").to_numpy(), held.column("found").combine_chunks()
    number = np.full(n_features, -1)
    number[voters] = np.arange(len(voters))
    voter = number[found.flatten().to_numpy()]
    text = np.repeat(np.arange(len(y)), np.asarray(found.value_lengths()))
    return LabelModel(text[voter >= 0], voter[voter >= 0], len(y), len(voters)).fit(np.where(y == 1, 0.95, 0.05))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Classifier:
    spark = docs.sparkSession
    sample = training_rows(docs, labels, rows)
    marks = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    all1, all0 = marks.get(1, 0), marks.get(0, 0)
    if not all1 or not all0:
        return Classifier({}, -500.0 if not all1 else 500.0)
    found = leaning(sample, all1, all0)
    voters = np.flatnonzero([r["n1"] >= r["n0"] for r in found])
    if not len(voters):
        return Classifier({}, math.log(all1 / all0))
    names = [r["feature"] for r in found]
    held = present(sample, names).toArrow()  # about SAMPLE_ROWS short rows
    q = posteriors(held, voters, len(names))
    free_worker()  # the votes were the driver's
    free_driver(spark)
    features = pa.chunked_array([held.column("found").combine_chunks().cast(pa.list_(pa.string()))])
    sides = [pa.table({"found": features, "y": pa.array(np.full(len(q), y)), "p": pa.array(p)}) for y, p in ((1.0, q), (0.0, 1 - q))]
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(names))], inputCol="found", outputCol="features", minTF=1.0)
    examples = vectors.transform(spark.createDataFrame(pa.concat_tables(sides)).filter("p > 1e-6").repartition(6)).cache()
    fitted = LogisticRegression(weightCol="p", labelCol="y", regParam=REGULAR, maxIter=100, standardization=False).fit(examples)
    examples.unpersist()
    free_driver(spark)
    weights = {f: float(w) for f, w in zip(names, fitted.coefficients.toArray()) if w}
    return Classifier(weights, float(fitted.intercept))


def score(docs: DataFrame, classifier: Classifier, keep: tuple[str, ...] = ("doc_id",), out_col: str = "score") -> DataFrame:
    """The columns of `keep` and `out_col` double; only the text is read. A kept column of that
    name gives way."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # weights of the features of a bounded sample
    kept = [c for c in keep if c != out_col]
    source = docs.select(*kept, F.col("text").cast("string").alias("__text"))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{out_col}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        c = shared.value
        for batch in batches:
            for b in slices(batch):
                scores = [c.score(t) for t in b.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(scores, pa.float64())], names=[*kept, out_col])

    return map_arrow(source, run, schema)


def clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below `limit`, with all their columns; only texts go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("double")
    def toxicity(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        free_worker()
        for part in texts:
            yield pd.Series([shared.value.score(t) for t in part], dtype="float64")

    bounded_batches(docs)
    return docs.filter(toxicity(F.col("text").cast("string")) < limit)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
    return score(docs, train(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
