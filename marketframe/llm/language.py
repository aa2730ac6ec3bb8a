"""Language identification, word first with back-off to character n-grams.

A known word is scored by its log frequency in each language. An unseen word is scored by its
characters: at every place the longest known n-gram (`MAX_GRAM` down to one character) gives the
log frequencies. A text's languages are compared by the sum over its words.

Training counts all words, and all n-grams of the distinct words, of a sample of the labelled rows in
Spark. The sample holds at most about SAMPLE_ROWS rows and SAMPLE_BYTES of text (stated bounds, drawn
by a hash of doc_id and shared out evenly by language: what a small language leaves over goes to the
larger ones, so none is crowded out); nothing that it holds is left out of the model. Words are kept
by 64-bit hash. Only text and lang of the training rows are learnt from.

A null text, a text without a letter and any text where nothing could be learnt get `und` and
score 0. Ties go to the language that sorts first. Repeated rows give repeated results, an empty table
none; a very long text is scored whole. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.bpe import slices
from marketframe.llm.common import free_worker, map_arrow, settle

#: Bounds of the labelled rows that the model is fitted on, and of its n-grams' length.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 << 20
MAX_GRAM = 4
#: Words a worker remembers the scores of before it starts anew.
MEMO_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")  # words, some of them with signs like a raised two, which words_of() takes out


def level(sizes: list[int], total: int) -> int:
    """The most that each of `sizes` may keep, so that together they keep at most `total`; 1 at least."""
    left = total
    for i, n in enumerate(sorted(sizes)):
        if n > left // (len(sizes) - i):
            return max(1, left // (len(sizes) - i))
        left -= n
    return max(1, *sizes, 1)


def training_rows(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> DataFrame:
    """text and lang of at most about `rows` rows and `size` bytes that may be learnt from, shared out
    by language."""
    may = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 != 1)
    sizes = may.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + 1).alias("bytes"))
    found = sizes.collect()  # a row for each language
    most, much = level([r["n"] for r in found], rows), level([r["bytes"] for r in found], size)
    share = F.least(F.lit(1.0), F.lit(float(most)) / F.col("n"), F.lit(float(much)) / F.col("bytes"))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.ceil(share * 1_000_000)
    return may.select("doc_id", "text", "lang").join(F.broadcast(sizes), "lang").filter(drawn).select("text", "lang")


def log_shares(counts: np.ndarray) -> np.ndarray:
    """Smoothed log share of each language's total, less the mean over languages; counts: (keys, languages)."""
    logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts)))
    return (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


def words_of(text: str | None) -> Counter:
    """How often each word, a run of letters, stands in a text, in lower case: as the training counts them."""
    counts = Counter(_WORD.findall(text.lower())) if text else Counter()
    for w in [w for w in counts if not w.isalpha()]:
        n = counts.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            counts[part] += n
    return counts


class Model:
    """Log frequencies by language of words, by their hash, and of n-grams."""

    def __init__(self, langs: list[str], words: pa.Table, grams: pa.Table):
        """words: h, lang (a number), n; grams: gram, lang, n."""
        self.langs = langs

        def table(keys: np.ndarray, n_keys: int, found: pa.Table) -> np.ndarray:
            counts = np.zeros((n_keys, len(langs)))
            np.add.at(counts, (keys, found.column("lang").to_numpy()), found.column("n").to_numpy())
            return log_shares(counts) if n_keys else counts.astype(np.float32)

        self.hashes, at = np.unique(words.column("h").to_numpy().view(np.uint64), return_inverse=True)
        self.word_logs = table(at, len(self.hashes), words)
        coded = grams.column("gram").combine_chunks().dictionary_encode()
        self.grams = {g: i for i, g in enumerate(coded.dictionary.to_pylist())}
        self.gram_logs = table(coded.indices.to_numpy(), len(self.grams), grams)

    def score_words(self, words: list[str]) -> np.ndarray:
        """(words, languages): of known words their logs, of others what their n-grams say."""
        h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), dtype=np.uint64, count=len(words))  # as Spark's xxhash64
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), dtype=bool)
        out = np.zeros((len(words), len(self.langs)), dtype=np.float32)
        out[known] = self.word_logs[at[known]]
        grams, logs = self.grams, self.gram_logs
        for k in np.flatnonzero(~known).tolist():
            padded, i, held = f" {words[k]} ", 0, []
            while i < len(padded) - 1:
                for n in range(min(MAX_GRAM, len(padded) - i), 0, -1):
                    g = grams.get(padded[i : i + n])
                    if g is not None:
                        held.append(g)
                        break
                i += max(1, n - 1)  # neighbouring grams share a character
            if held:
                out[k] = np.clip(logs[held].sum(axis=0), -6.0, 6.0)
        return out


class Scorer:
    """Scores texts with a model; remembers words."""

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[str, int] = {}
        self.logs = np.empty((0, len(model.langs)), dtype=np.float32)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        """Remembers the scores of words that are new."""
        need = self.used + len(words)
        if need > len(self.logs):
            grown = np.empty((max(need, 2 * len(self.logs), 1024), self.logs.shape[1]), dtype=np.float32)
            grown[: self.used] = self.logs[: self.used]
            self.logs = grown
        self.logs[self.used : need] = self.model.score_words(words)
        self.memo.update(zip(words, range(self.used, need)))
        self.used = need

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
            self.used = 0
        counts = [words_of(t) for t in texts]
        if self.model.langs:
            self._learn([w for w in dict.fromkeys(w for c in counts for w in c) if w not in self.memo])
        langs, scores = [], []
        for c in counts:
            if not self.model.langs or not c:
                langs.append("und"), scores.append(0.0)
                continue
            total = np.fromiter(c.values(), dtype=np.float64, count=len(c)) @ self.logs[[self.memo[w] for w in c]]
            best = int(np.argmax(total))
            p = np.exp((total - total[best]) / math.sqrt(c.total()))
            langs.append(self.model.langs[best]), scores.append(float(1.0 / p.sum()))
        return langs, scores


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """Counts words and n-grams of the training rows in Spark; the tables that reach the driver are
    those of a bounded sample."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    counts = settle(training_rows(docs, rows, size).select("lang", F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    number = F.coalesce(*(F.when(F.col("lang") == name, i) for i, name in enumerate(langs)), F.lit(0)).cast("int").alias("lang")
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    starts = lambda n: F.sequence(F.lit(1), F.length(padded) - (n - 1))
    cut = lambda n: lambda i: F.substring(padded, i, F.lit(n))
    none = F.array().cast("array<string>")
    grams = F.concat(*(F.when(F.length(padded) >= n, F.transform(starts(n), cut(n))).otherwise(none) for n in range(1, MAX_GRAM + 1)))
    weight = F.log2(F.col("n") + 1.0)
    found = counts.select("lang", weight.alias("n"), F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return Model(langs, counts.select(F.xxhash64("word").alias("h"), number, F.col("n").cast("double")).toArrow(), found.select("gram", number, "n").toArrow())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score; only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the words and n-grams of a bounded sample
    source = docs.select("doc_id", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        scorer = Scorer(shared.value)
        for batch in batches:
            for b in slices(batch):
                langs, scores = scorer.texts(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_arrow(source, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
    return predict(docs, train(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
