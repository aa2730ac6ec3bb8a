"""Decontamination, licenses, language, toxicity and the set join against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from marketframe.llm import decontamination, language, licenses, setjoin, toxicity
from marketframe.llm.common import alnum_pieces, alnum_words
from test_pipeline import alnum, groups, shingle_set

DIR = "/root/testdata/sf0.01"
CLASH = ["'q' as n", "'q' as key", "'q' as token", "'q' as items", "'q' as score", "'q' as root", "'q' as start", "'q' as label"]


def read(spark, name):
    return spark.read.parquet(f"{DIR}/{name}.parquet")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", *CLASH)


def odd_texts():
    rng = random.Random(8)
    words = ["A", "b", "cé", "d9", "É", "the", "x-y"]
    out = [None, "", "  \t ", "...", "a" * 200_000, "one " * 30_000]
    out += [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(120)]
    return out


# ---- decontamination --------------------------------------------------------------------------

def brute_hits(texts, items, n=10):
    wins = {}
    for i, x in items:
        w = alnum(x)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for x in texts:
        w, hit, ids = alnum(x), set(), set()
        for size in {len(k) for k in wins}:
            for k in range(len(w) - size + 1):
                found = wins.get(tuple(w[k : k + size]))
                if found:
                    hit.update(range(k, k + size))
                    ids |= found
        ids = sorted(map(str, ids))
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_decontamination(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", broadcast)
    texts = odd_texts()
    items = [(1, texts[20]), (2, (texts[21] or "") + " new words " + (texts[22] or "")), (3, "the the"), (4, None), (5, "!"), (6, texts[20]), (6, texts[20]), (12, "b É")]
    rows = list(enumerate(texts)) + [(3, texts[20]), (None, texts[20]), (7, texts[7])]
    got = decontamination.digest(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as win"))
    want = sorted(((-1 if d is None else d), *b) for (d, _), b in zip(rows, brute_hits([x for _, x in rows], items)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == want
    kept = decontamination.clean(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(not w[-1] for w in want)


def test_decontamination_empty(spark):
    items = read(spark, "benchmark")
    assert decontamination.digest(frame(spark, []), items).count() == 0
    assert decontamination.digest(frame(spark, [(1, "a b")]), items.limit(0)).first()["n_hit"] == 0


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_texts_are_parted_once(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", broadcast)
    windows, _ = decontamination.item_windows(read(spark, "benchmark"))
    plan = decontamination.occurrences(read(spark, "documents"), windows)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"split\(|regexp_extract_all\(", plan)) == 1


def test_words_and_pieces(spark):
    texts = [chr(c) * 2 + x + chr(c) for c in [*range(0x180), 0x3A3, 0x7FF, 0x800, 0x2160, 0x24B6, 0xFFFD, 0xFFFF, 0x10000, 0x10FFFF] for x in ("a", "Z9", "é", "")]
    for r in frame(spark, list(enumerate(texts + odd_texts()))).select("text", alnum_words(F.col("text")).alias("w"), alnum_pieces(F.col("text")).alias("p")).collect():
        assert r.w == alnum(r.text) == [x for x in r.p if x] and "" not in r.p[1:-1]


# ---- licenses ---------------------------------------------------------------------------------

def aligned(w, t, k):
    """The most words of t in one alignment with w of equal runs of k words at least, and the least
    number of words of w that does it."""
    best = [[0] * (len(t) + 1) for _ in range(len(w) + 1)]
    run = [[0] * (len(t) + 1) for _ in range(len(w) + 1)]
    for i in range(1, len(w) + 1):
        for j in range(1, len(t) + 1):
            run[i][j] = run[i - 1][j - 1] + 1 if w[i - 1] == t[j - 1] else 0
            best[i][j] = max([best[i - 1][j], best[i][j - 1], *(best[i - m][j - m] + m for m in range(k, run[i][j] + 1))])
    most = best[-1][-1]
    return most, min(i for i in range(len(w) + 1) if best[i][-1] == most)


def brute_labels(text, templates, k=4):
    """Labels and largest coverage by aligning stretches of the text with every template."""
    w, out, best = alnum(text), set(), 0.0
    for label, wording in templates:
        t = alnum(wording)
        least = (licenses.COVER if len(t) >= licenses.LONG else licenses.SHORT_COVER) * len(t)
        grams = {}
        for j in range(len(t) - k + 1):
            grams.setdefault(tuple(t[j : j + k]), []).append(j)
        free = 0
        for i in range(len(w)):
            if i < free or tuple(w[i : i + k]) not in grams:
                continue
            part = w[i : i + len(t) + max(licenses.GAP, len(t) // 4)]
            if len({j + n for x in range(len(part) - k + 1) for j in grams.get(tuple(part[x : x + k]), []) for n in range(k)}) < least:
                continue
            most, end = aligned(part, t, k)
            if most >= least and end - most <= max(licenses.GAP, len(t) // 4):
                out.add(label)
                best, free = max(best, most / len(t)), i + end
    return out, best


def test_reordered_and_strewn_templates(spark):
    """The words of a template in another order, or strewn over a text, are no license."""
    paragraph = next(t for _, t in licenses.TEXTS if len(alnum(t)) >= 60)
    w = paragraph.split()
    pieces = [" ".join(w[i : i + 8]) for i in range(0, len(w), 8)]
    foreign = " ".join(f"foreign{i}" for i in range(10))
    edited = " ".join([*w[:20], "changed", *w[21:40], "two more", *w[40:]])
    rows = ["intro " + paragraph, " ".join(reversed(pieces)), f" {foreign} ".join(pieces), "x " + edited, (paragraph + " and ") * 3, " ".join(f"{p} {foreign * 9}" for p in pieces * 6)]
    got = {r.doc_id: (list(r.labels), r.score) for r in licenses.scan(frame(spark, list(enumerate(rows)))).collect()}
    label = next(x for x, t in licenses.TEXTS if t == paragraph)
    for i, text in enumerate(rows):
        labels, best = brute_labels(text, licenses.TEXTS)
        assert got[i] == (sorted(labels), pytest.approx(best))
    assert [label in got[i][0] for i in range(6)] == [True, False, False, True, True, False]
    places = licenses.positions(licenses.default_templates(spark))
    three = licenses.spans(frame(spark, [(4, rows[4])]), places).filter(F.col("label") == label).collect()
    assert sorted((r.first, r.end) for r in three) == [(n * (len(alnum(paragraph)) + 1), n * (len(alnum(paragraph)) + 1) + len(alnum(paragraph))) for n in range(3)]


@pytest.mark.parametrize("broadcast", [licenses.BROADCAST_PLACES, 0])
def test_licenses(spark, monkeypatch, broadcast):
    monkeypatch.setattr(licenses, "BROADCAST_PLACES", broadcast)
    rows = list(enumerate(odd_texts()))
    templates = licenses.TEXTS
    assert len({label for label, _ in templates}) >= 10
    long = templates[0][1].split()
    cut = " ".join(w for i, w in enumerate(long) if i not in (9, 30))  # two words missing
    named = " ".join([*long[:40], "a company of eight words that stands here", *long[40:]])
    more = ["The MIT License, mit license", "apache-license gnu General Public LICENSE mit  license", "x " * 50 + cut + " y", " ".join(long[:10]), "permission is hereby granted", named, (cut + " z ") * 3]
    more += [f"a b c {t} d" for _, t in templates]
    rows += list(enumerate(more, 1000)) + [(1000, more[0]), (1002, more[2]), (None, more[0])]
    got = licenses.digest(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 6)))
    for d, x in rows:
        w = alnum(x)
        at = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        base = {label for _, label in at}
        labels, best = brute_labels(x, templates)
        want = (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted(base)), ",".join(sorted(base | labels)), round(max(best, 0.5 if at else 0), 6))
        assert want in by[d], (x, by[d])
    labels = {d: {t[5] for t in v} for d, v in by.items()}
    assert labels[1000] == {"mit"} and labels[1001] == {"apache,gpl,mit"} and labels[1002] == {"mit"} and labels[1003] == {""} and labels[1004] == {""} and labels[1005] == {"mit"}
    assert all(label in labels[1007 + i].pop().split(",") for i, (label, _) in enumerate(templates))
    assert licenses.digest(frame(spark, [])).count() == 0


def test_licenses_by_own_templates(spark):
    df = spark.createDataFrame([("a", "one two three four five six"), (None, "one two three")], "doc_id string, text string")
    own = spark.createDataFrame([("own", "two three four five"), ("short", "one two"), ("none", None)], "label string, text string")
    assert sorted((r.doc_id or "", list(r.labels), r.score) for r in licenses.scan(df, own).collect()) == [("", [], 0.0), ("a", ["own"], 1.0)]


# ---- language ---------------------------------------------------------------------------------

def test_language(spark):
    docs = read(spark, "documents")
    got = language.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, all_ = got.agg(F.count_if(F.col("lang_pred") == F.col("lang")), F.count(F.lit(1))).first()
    assert right >= 0.97 * all_ > 0
    # labels of held-out rows, source and doc_id don't matter
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "xx").otherwise(F.col("lang")))
    same = language.digest(other).exceptAll(language.digest(docs))
    assert same.count() == 0


def test_language_odd(spark):
    rows = [(i, x, "en" if i % 2 else None, 1) for i, x in enumerate(odd_texts())] + [(None, "the", "fr", 1), (5, "12 34 ²", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    got = language.digest(df).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2, 3)} == {"und"}
    assert language.digest(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language.digest(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ---- toxicity ---------------------------------------------------------------------------------

def test_toxicity(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.digest(docs, labels).join(labels, "doc_id").filter("held_out")
    n, right, toxic, caught = got.agg(F.count(F.lit(1)), F.count_if(F.col("predicted") == F.col("toxic")), F.count_if(F.col("toxic") == 1), F.count_if((F.col("toxic") == 1) & (F.col("predicted") == 1))).first()
    assert right >= 0.97 * n and caught >= 0.8 * toxic > 0


def test_toxicity_odd(spark):
    rows = list(enumerate(odd_texts())) + [(None, "x"), (3, "again")]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(2, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    for marks in (labels, labels.limit(0), labels.filter("toxic = 1")):
        got = toxicity.digest(df, marks).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.digest(df.limit(0), labels).count() == 0


def test_label_model_judges_by_votes_alone():
    import numpy as np

    rng = np.random.default_rng(0)
    n = 4000
    y, other = rng.random(n) < 0.2, rng.random(n) < 0.4  # toxic texts, and the language they are in
    fires = lambda in_toxic, in_clean: np.where(y, rng.random(n) < in_toxic, rng.random(n) < in_clean)
    votes = np.stack([fires(0.7, 0.02) & (other == (k >= 6)) for k in range(12)], axis=1)
    votes = np.column_stack([votes, votes[:, 0]])  # a copied voter
    wrong = np.where(rng.random(n) < 0.1, ~y, y)  # marks of which a tenth is wrong
    model = toxicity.LabelModel(*np.nonzero(votes), *votes.shape)
    assert model.family[12] == model.family[0] and len(set(model.family)) == 2
    q = model.fit(np.where(wrong, 0.95, 0.05))
    assert ((q > 0.5) == y).mean() > 0.985  # nearer to the truth than the marks that it started from
    flipped = y & ~wrong
    assert flipped.sum() > 40 and (q[flipped] > 0.5).mean() > 0.9
    same = {}
    for row, p in zip(map(bytes, votes.astype(np.uint8)), q):  # equal votes have equal posteriors, whatever their marks
        assert abs(same.setdefault(row, p) - p) < 1e-12
    assert model.rates[0, 0] > 0.2 > 0.05 > model.rates[1, 0]


# ---- set join ---------------------------------------------------------------------------------

def test_two_texts_of_one_doc_id(spark):
    """Each text of a doc_id keeps its own links, also where both stand in one list."""
    rng = random.Random(9)
    for trial in range(3):
        base = [f"w{trial}{i}" for i in range(60)]
        near = lambda n: " ".join(x if i not in set(rng.sample(range(60), n)) else f"new{rng.random()}" for i, x in enumerate(base))
        rows = [(1, " ".join(base)), (1, near(2)), (2, near(1)), (3, near(1)), (4, near(2)), (5, " ".join(base[:59])), (2, "nothing like it at all here")]
        got = {(r.doc_id, r.component_id) for r in setjoin.join(frame(spark, rows), 2, 4, 5).collect()}
        texts = dict(enumerate(t for _, t in rows))
        root = groups(list(texts.items()), 2, 4, 5)
        links = [{i for i in texts if root[i] == r} for r in set(root.values())]
        ids = [{rows[i][0] for i in link} for link in links]
        while any(a is not b and a & b for a in ids for b in ids):  # rows of one doc_id are one document
            a, b = next((a, b) for a in ids for b in ids if a is not b and a & b)
            ids = [x for x in ids if x is not a and x is not b] + [a | b]
        assert got == {(d, min(x)) for x in ids for d in x}


@pytest.mark.parametrize("k,num,den,rounds,limit", [(4, 17, 20, 2, None), (5, 4, 5, 1, 40), (2, 4, 5, 1, 12)])
def test_set_join(spark, monkeypatch, k, num, den, rounds, limit):
    monkeypatch.setattr(setjoin, "PIVOT_ROUNDS", rounds)
    monkeypatch.setattr(setjoin, "SKETCH_BITS", 12)
    if limit:
        monkeypatch.setattr(setjoin, "boundary", lambda sim, partners: limit)
    rng = random.Random(k)
    vocabulary = [f"W{i}" for i in range(300)] + ["é", "É"]
    texts = [None, "", " \n", "a", "A", "a b c", "x" * 50_000, "ab cd " * 4000]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((6, 9, 14, 30, 60, 120)))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice(("  ", " ", "\n")).join(copy))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = setjoin.join(frame(spark, rows + [(None, "a b"), rows[0]]), k, num, den).collect()
    want = groups(rows, k, num, den)
    assert len(got) == len(rows) + 2
    text = dict(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.component_id, r.n_shingles) == (want[r.doc_id], len(shingle_set(text[r.doc_id], k))), r
    assert setjoin.join(frame(spark, []), k, num, den).count() == 0


def test_lists_that_are_done_are_not_contracted(spark, monkeypatch):
    """Pivots leave their lists, and lists of two are done with their round, linked or not."""
    entries, contracted = [], setjoin._contracted
    monkeypatch.setattr(setjoin, "_contracted", lambda rows, edges: entries.append(rows.count()) or contracted(rows, edges))
    near = lambda c, n: [" ".join([*(f"{c}{i}" for i in range(40)), *(f"{c}{i}x{j}" for j in range(3))]) for i in range(n)]
    text = lambda c, *tail: " ".join([*(f"{c}{i}" for i in range(40)), *tail])
    pairs = [text(c, x) for c in "abcdef" for x in "yz"] + [text("g", "y"), text("g", *map(str, range(30)))]  # the last two are not similar
    for texts, many in ((pairs, False), (pairs + near("h", 5), True)):
        entries.clear()
        rows = list(enumerate(texts))
        got = {r.doc_id: r.component_id for r in setjoin.join(frame(spark, rows), 2, 4, 5).collect()}
        assert got == groups(rows, 2, 4, 5)
        assert (entries[0] > 0) == many and entries == sorted(entries, reverse=True)


def test_words_of_the_join():
    for x in odd_texts()[:60]:
        assert len(setjoin.shingles(x, 4)) == len(shingle_set(x, 4))
    assert re.findall(r"[^\x20\x09-\x0D]+", "a\x1cb\x85c\xa0d") == ["a\x1cb\x85c\xa0d"] and len(setjoin.shingles("a\x1cb\x85c\xa0d", 1)) == 1
