"""Benchmark decontamination: a prefix-filtered join of item windows with document words.

A window is `window` consecutive words of an item; an item with fewer words is one window. A
window is contained in a document only if all its words are, so its rarest word by corpus count
is prefix enough: windows and document words join on that one token, the place of the token in
the window bounds where the window may start (and its length where it must end), and the window
is then compared word by word with the document's words there. Windows that hold a word the
corpus lacks can't occur and are dropped.

Everything is DataFrame functions. The windows are broadcast only if the benchmark is within
BROADCAST_WINDOWS; a larger one joins by shuffle: words that are no window's prefix are left out
first, and the others then carry their surroundings, never the whole document.

Null and empty texts have no words: such items have no windows, such documents no hits. Repeated
rows give repeated results; rows that share doc_id but not the text count apart. A very long text is
searched whole. Columns other than the id and text are ignored; clean() returns them as they are. An
empty table of documents gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import ALNUM_GAP, alnum_pieces, alnum_words, settle

WINDOW = 10
#: Most windows that are sent to every executor (about 200 bytes each; items stay behind).
BROADCAST_WINDOWS = 200_000
#: Most prefix words, or pairs of a window and an item (about 40 bytes each), that are sent to every executor.
BROADCAST_TOKENS = 1_000_000
SALTS = 16


def item_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """win array<string> and its number wid, a row for each distinct window; and a row (wid, item_id) for
    each item that it stands in. Only windows take part in the search, however many items share one."""
    words = items.select("item_id", alnum_words(F.col("text")).alias("ws")).filter("size(ws) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1)))
    wins = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("ws", i, window))).alias("win")).distinct()
    windows = settle(wins.select("win").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    return windows, settle(wins.join(windows, "win").select("wid", "item_id"), "owners")


def prefixes(docs: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """windows with their prefix: `token`, the rarest word, and `off`, its place in the window."""
    at = windows.select("win", F.posexplode("win").alias("off", "token"))
    vocabulary = at.select("token").distinct()
    words = docs.select(F.explode(alnum_pieces(F.col("text"))).alias("token"))
    counts = words.join(F.broadcast(vocabulary) if small else vocabulary, "token").groupBy("token").count()
    ranked = at.join(F.broadcast(counts) if small else counts, "token", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token", "off")).alias("p"))
    return windows.join(ranked.filter("p.n > 0"), "win").select("win", "wid", F.size("win").alias("wn"), "p.token", "p.off")


def occurrences(docs: DataFrame, windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, __h (hash of the text), start (in alnum_pieces()), wn and wid of every place of a window."""
    small = windows.count() <= BROADCAST_WINDOWS
    prefix = settle(prefixes(docs, windows, small), "prefixes")
    words = docs.select("doc_id", F.xxhash64("text").alias("__h"), alnum_pieces(F.col("text")).alias("__ws"))
    # for posexplode() Spark would infer a filter on the size of __ws, and part each text twice
    at = F.posexplode_outer("__ws").alias("__pos", "token")
    if small:
        each = words.select("doc_id", "__h", "__ws", at)
        first, context, n = F.col("__pos") - F.col("off"), F.col("__ws"), F.size("__ws")
        shift = first
        prefix = F.broadcast(prefix)
    else:
        each = words.select("doc_id", "__h", F.size("__ws").alias("__n"), "__ws", at)
        tokens = settle(prefix.select("token").distinct(), "prefix-words")
        if tokens.count() <= BROADCAST_TOKENS:
            each = each.join(F.broadcast(tokens), "token", "left_semi")
        # a common word, where no window's rarest word is rarer, is dealt over SALTS keys
        prefix = prefix.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        around = F.slice("__ws", F.greatest(F.col("__pos") - (window - 1), F.lit(0)) + 1, 2 * window - 1)
        each = each.select("doc_id", "__h", "__n", "__pos", "token", around.alias("__ctx"), F.pmod(F.xxhash64("__h", "__pos"), F.lit(SALTS)).cast("int").alias("__part"))
        first, context, n = F.col("__pos") - F.col("off"), F.col("__ctx"), F.col("__n")
        shift = F.least(F.col("__pos"), F.lit(window - 1)) - F.col("off")
    inside = (first >= 0) & (first + F.col("wn") <= n)
    equal = F.slice(context, F.greatest(shift, F.lit(0)) + 1, F.col("wn")) == F.col("win")
    on = (each["token"] == prefix["token"]) & inside & equal
    found = each.join(prefix, on if small else on & (each["__part"] == prefix["__salt"]))
    return found.select("doc_id", "__h", first.alias("start"), "wn", "wid")


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, __h, n_words, n_hit (words inside an occurrence), item_ids (sorted as strings)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    items = items.select("item_id", F.col("text").cast("string").alias("text"))
    windows, owners = item_windows(items, window)
    found = settle(occurrences(docs, windows, window), "hits")
    per = found.groupBy("doc_id", "__h").agg(F.array_sort(F.collect_set(F.struct("start", "wn"))).alias("spans"))
    owners = F.broadcast(owners) if owners.count() <= BROADCAST_TOKENS else owners
    ids = found.select("doc_id", "__h", "wid").distinct().join(owners, "wid").groupBy("doc_id", "__h").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(acc, s):  # spans come by start: each adds what lies behind the end so far
        end = s["start"] + s["wn"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(s["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    per = per.select("doc_id", "__h", F.aggregate("spans", zero, add)["n"].alias("n_hit"))
    both = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.__h") == F.col("b.__h"))
    per = per.alias("a").join(ids.alias("b"), both).select("a.doc_id", "a.__h", "n_hit", "item_ids")
    pieces = F.split(F.coalesce("text", F.lit("")), ALNUM_GAP)
    n_words = F.size(pieces) - (F.element_at(pieces, 1) == "").cast("int") - ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")
    every = docs.select("doc_id", F.xxhash64("text").alias("__h"), n_words.alias("n_words")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.__h") == F.col("p.__h"))
    joined = every.join(per.alias("p"), same, "left")
    return joined.select("d.doc_id", "d.__h", F.col("d.n_words").cast("bigint").alias("n_words"), F.coalesce("p.n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("p.item_ids", F.array().cast("array<string>")).alias("item_ids"))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    ids = F.col("item_ids")
    return scan(docs, items).select("doc_id", "n_words", "n_hit", F.size(ids).cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` that hold no window of an item, with all their columns."""
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    windows, _ = item_windows(items.select("item_id", F.col("text").cast("string").alias("text")), window)
    hit = occurrences(text, windows, window).select(F.col("doc_id").alias("__d"), F.col("__h").alias("__x")).distinct()
    same = docs["doc_id"].eqNullSafe(hit["__d"]) & (F.xxhash64(docs["text"].cast("string")) == hit["__x"])
    return docs.join(hit, same, "left_anti")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(ws[k:k + 9], ' ') AS g, least(len(ws), 10) AS n FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
gram AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, lens)),
hit AS (SELECT DISTINCT gram.doc_id, gram.k, gram.n, win.item_id FROM gram JOIN win ON gram.g = win.g AND gram.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id LEFT JOIN ids ON w.doc_id = ids.doc_id
"""
