"""Personal data: base patterns and information-theoretic sanitisation.

Base: e-mail addresses, IP addresses, card and phone numbers by pattern and check, as places in the
text. Method: every base value is a protected entity. The whole words, of `letters` letters at least,
of every document that holds it are its terms; over the whole corpus the share of an entity's
information that a term gives away is

    disclosure(term, entity) = log2(N n(t,e) / (n(t) n(e))) / log2(N / n(e))

with n the numbers of documents. A term whose disclosure reaches `threshold`, beside the entity in
at least `support` different texts, is a span of kind `term` wherever it stands in any document,
unless a base span covers part of it. sanitise() removes base values and generalises terms to a mark
of their kind.

All of it is DataFrame functions. Pairs are left out before they are counted only where bounds of
their counts rule the threshold or `support` out. What is joined is broadcast within BROADCAST_TERMS
rows and joined by shuffle beyond.

A null text counts as the empty text in scan() and stays null in sanitise(). Repeated rows give
repeated results, and count apart in n (not in `support`). An empty table gives an empty result; a
very long text is searched whole. Other columns stay as they are, whatever their names, unless they
start with __pii_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import settle

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 3
THRESHOLD = 0.9
LETTERS = 4  # of the shortest word that can be a term
BROADCAST_TERMS = 200_000
SALTS = 16

# The patterns, written so that no start inside a run is tried again and no repetition backtracks:
# the same matches in time proportional to the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

SPAN = "array<struct<start:int,ord:int,end:int>>"


def places(text: Column, hits: Column, gaps: Column, order: int) -> Column:
    """(start, ord, end, value) of hits, whose gaps are what stands before and behind each."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,ord:int,end:int,value:string>>").alias("out"))

    def add(acc, i):
        start = acc["at"] + F.length(F.element_at(gaps, i))
        value = F.element_at(hits, i)
        end = start + F.length(value)
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), value.alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.when(F.size(hits) > 0, F.aggregate(F.sequence(F.lit(1), F.size(hits)), zero, add)["out"]).otherwise(zero["out"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""

    def add(acc, i):
        d = F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        n = digits(value)
        return F.length(n).between(12, 19) & F.when(F.length(n).between(12, 19), luhn(n)).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def _valid(kind: str):
    return lambda s: _holds(kind, s["value"])


def _of(order: int):
    return lambda s: s["ord"] == order


def with_base(docs: DataFrame) -> DataFrame:
    """All columns of `docs`, __pii_text (never null) and __pii_base: (start, ord, end, value) of the base
    spans by start, then kind."""
    out = docs.withColumn("__pii_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    signs = {"email": F.contains("__pii_text", F.lit("@")), "phone": F.contains("__pii_text", F.lit("+"))}
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))
    none = F.array().cast("array<string>")
    for kind, pattern in patterns.items():
        hits = F.regexp_extract_all("__pii_text", F.lit(pattern), F.lit(0))
        out = out.withColumn(f"__pii_{kind}", F.when(signs[kind], hits).otherwise(none) if kind in signs else hits)
    for kind, pattern in patterns.items():
        out = out.withColumn(f"__pii_g{kind}", F.when(F.size(f"__pii_{kind}") > 0, F.split("__pii_text", pattern, -1)).otherwise(none))
    spans = []
    for order, kind in enumerate(patterns):
        found = places(F.col("__pii_text"), F.col(f"__pii_{kind}"), F.col(f"__pii_g{kind}"), order)
        spans.append(F.filter(found, _valid(kind)))
    out = out.withColumn("__pii_base", F.array_sort(F.concat(*spans)))
    return out.drop(*(f"__pii_{kind}" for kind in patterns), *(f"__pii_g{kind}" for kind in patterns))


def words(text: str, letters: int) -> Column:
    """The different words of a text, lower-cased."""
    pattern = rf"\p{{L}}{{{letters},}}"
    return F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0)))


def few(df: DataFrame) -> DataFrame:
    """`df`, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def disclosive(marked: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD, letters: int = LETTERS) -> DataFrame:
    """entity and term of every pair whose disclosure reaches the threshold. `marked` has one row for
    each document: __pii_row, __pii_text and __pii_base."""
    value = F.concat_ws(":", F.col("s.ord").cast("string"), F.lower("s.value"))
    found = marked.filter("size(__pii_base) > 0").withColumn("__pii_x", F.xxhash64("__pii_text"))
    own = settle(found.select("__pii_row", "__pii_x", F.explode("__pii_base").alias("s")).select("__pii_row", "__pii_x", value.alias("entity")).distinct(), "owners")
    n = float(marked.count())
    # n(t,e) is at most n(e), and what `support` texts tell stands in as many documents: all else
    # can't reach the threshold, whatever its counts
    entities = own.groupBy("entity", "__pii_x").agg(F.count(F.lit(1)).alias("k")).groupBy("entity").agg(F.sum("k").alias("n_e"), F.count(F.lit(1)).alias("texts"))
    slack = F.pow(F.lit(n) / F.col("n_e"), F.lit(1 - threshold)) * (1 + 1e-9)
    entities = settle(entities.filter((F.col("texts") >= support) & (F.col("n_e") < n)).select("entity", "n_e", slack.alias("slack")), "entities")
    most = entities.agg(F.max(F.col("n_e") * F.col("slack"))).first()[0]
    if most is None:
        return entities.select("entity", F.lit("").alias("term"))
    # an entity of many documents is dealt over SALTS keys where entities are not broadcast
    salted = entities.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    own = own.withColumn("salt", F.pmod("__pii_row", F.lit(SALTS)).cast("int")).join(few(salted), ["entity", "salt"])
    own = settle(own.select("__pii_row", "__pii_x", "entity", "n_e", "slack"), "live-owners")
    live = found.join(few(own.select("__pii_row").distinct()), "__pii_row", "left_semi").select("__pii_row", F.explode(words("__pii_text", letters)).alias("term"))
    live = settle(live, "live-words")
    # a word stands in as many documents at least as it stands in beside entities
    seen = live.groupBy("term").agg(F.count(F.lit(1)).alias("n_near")).filter(F.col("n_near").between(support, most)).select("term")
    seen = settle(seen, "terms")
    counts = marked.select(F.explode(words("__pii_text", letters)).alias("term")).join(few(seen), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    counts = settle(counts.filter(F.col("n_t") <= most), "term-counts")
    pairs = live.join(few(counts), "term").join(own, "__pii_row").filter(F.col("n_t") <= F.col("n_e") * F.col("slack"))
    pairs = pairs.groupBy("entity", "term", "n_e", "n_t", "__pii_x").agg(F.count(F.lit(1)).alias("k"))
    pairs = pairs.groupBy("entity", "term", "n_e", "n_t").agg(F.sum("k").alias("n_te"), F.count(F.lit(1)).alias("texts"))
    share = F.log2(n * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.log2(n / F.col("n_e"))
    return pairs.filter((F.col("texts") >= support) & (share >= threshold)).select("entity", "term")


def with_spans(docs: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD, letters: int = LETTERS) -> DataFrame:
    """All columns of `docs`, __pii_text, __pii_base and __pii_spans: base and term spans as (start, ord, end)."""
    marked = settle(with_base(docs).withColumn("__pii_row", F.monotonically_increasing_id()), "marked")
    told = settle(disclosive(marked, support, threshold, letters).select("term").distinct(), "told")
    terms = marked.select("__pii_row", F.explode(words("__pii_text", letters)).alias("term")).join(few(told), "term")
    terms = settle(terms.groupBy("__pii_row").agg(F.array_sort(F.collect_set("term")).alias("__pii_terms")), "row-terms")
    rows = marked.join(few(terms), "__pii_row", "left")
    # the terms are letters only, so they stand for themselves in a pattern
    rows = rows.withColumn("__pii_p", F.when(F.size("__pii_terms") > 0, F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("__pii_terms", "|"), F.lit(r")(?!\p{L})"))))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("__pii_h", F.when(F.col("__pii_p").isNotNull(), F.regexp_extract_all("__pii_text", F.col("__pii_p"), F.lit(0))).otherwise(none))
    rows = rows.withColumn("__pii_g", F.when(F.size("__pii_h") > 0, F.split("__pii_text", F.col("__pii_p"), -1)).otherwise(none))
    rows = rows.withColumn("__pii_t", places(F.col("__pii_text"), F.col("__pii_h"), F.col("__pii_g"), 4))
    rows = rows.withColumn("__pii_t", F.filter("__pii_t", lambda t: ~F.exists("__pii_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))))
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end")))
    return rows.select(*docs.columns, "__pii_text", "__pii_base", F.array_sort(F.concat(bare("__pii_base"), bare("__pii_t"))).cast(SPAN).alias("__pii_spans"))


def joined(spans: Column | str) -> Column:
    """kind:start:end of spans, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    rows = with_spans(docs.select("doc_id", "text"))
    counts = [F.size(F.filter("__pii_base", _of(o))).cast("bigint").alias(f"n_{k}") for o, k in enumerate(KINDS[:4])]
    return rows.select("doc_id", *counts, F.sha2(joined("__pii_base"), 256).alias("base_sha256"), joined("__pii_spans").alias("spans"), F.size("__pii_spans").cast("bigint").alias("n_spans"))


def sanitise(docs: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD, letters: int = LETTERS) -> DataFrame:
    """`docs` with the text's spans replaced by [EMAIL], [IP], [CARD], [PHONE] and [TERM]; spans that
    overlap become one, marked as the first. All columns stay as they are, but n_chars follows."""
    rows = with_spans(docs, support, threshold, letters)
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc, s):
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(F.col("__pii_text"), acc["at"] + 1, s["start"] - acc["at"]), F.element_at(marks, s["ord"] + 1))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("__pii_spans", zero, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("__pii_text"), acc["at"] + 1, F.length("__pii_text"))))
    text = F.when(F.size("__pii_spans") > 0, done).otherwise(F.col("text"))
    out = rows.withColumn("__pii_new", text)
    changed = {"text": F.col("__pii_new").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("__pii_spans") > 0, F.length("__pii_new")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns))
