"""Mixing, infilling and collocations against brute force, on odd rows and on whole small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.llm import collocations, infilling, mixing
from marketframe.llm import queries as registered
from oracle import compare

DIR = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
CLASH = ["'q' as n", "'q' as size", "'q' as rate", "'q' as copies", "'q' as __s", "'q' as k", "'q' as phrase", "'q' as frames", "'q' as form", "'q' as f", "'q' as target"]


# ---- mixing -----------------------------------------------------------------------------------

def brute_targets(sizes):
    """The excess over a source's bound shared anew by weight, in whole fractions."""
    w = [Fraction((5, 2, 1)[i % 3]) for i in range(len(sizes))]
    most, out = [Fraction(2 * n) for n in sizes], [Fraction(0)] * len(sizes)
    left = Fraction(3 * sum(sizes), 2)
    while left > 0 and any(o < m for o, m in zip(out, most)):
        room = [i for i in range(len(sizes)) if out[i] < most[i]]
        share, total = left, sum(w[i] for i in room)
        for i in room:
            add = min(share * w[i] / total, most[i] - out[i])
            out[i] += add
            left -= add
    return [float(x) for x in out]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mix(rows, got):
    """rows: (doc_id, text, source), any number of times; got: rows of mix()."""
    assert Counter((d, words(t), s) for d, t, s in rows) == Counter((r.doc_id, r.size, r.source) for r in got)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute_targets([sizes[s] for s in order])))
    taken, smallest = Counter(), defaultdict(lambda: 10**9)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        if r.size:
            smallest[r.source] = min(smallest[r.source], r.size)
    # the rates solve the dual: exp(lambda size), cut off at two, and their words are the target
    by_source = defaultdict(list)
    for r in got:
        by_source[r.source].append((r.size, r.rate))
    for s, held in by_source.items():
        total = sum(n * w for n, w in held)
        assert math.isclose(total, want[s], rel_tol=1e-4, abs_tol=1e-6)
        slopes = [math.log(w) / n for n, w in held if 0 < n < mixing.FINE and w < 2]
        assert not slopes or max(slopes) - min(slopes) < 1e-6 * max(1e-6, max(map(abs, slopes))) + 1e-12
    return taken, want


def test_mix_of_the_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = mixing.mix(docs).collect()
    taken, want = check_mix([(r.doc_id, r.text, r.source) for r in docs.collect()], got)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.01 * t
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.size, r.source, r.copies)
    assert Counter(map(key, got)) == Counter(map(key, again))
    assert set(registered.queries()["op11_mixing"](spark, SMALL).columns) >= {"doc_id", "size", "source_size", "target", "taken"}


def odd_docs():
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 60))), f"s{i % 4}") for i in range(300)]
    rows += [(400 + i, "the same few words", "hot") for i in range(900)]  # one cell of many copies
    rows += [(2000, None, "s1"), (2001, "", "s2"), (None, "no id here", "s3"), (2002, "x " * 5000, "s1"), (2003, "no source", None), (2004, "none either \t\n x", None)]
    return rows + [(7, rows[7][1], "s3")] * 3 + [(2005, "", "empty")]


def test_mix_of_odd_rows(spark):
    rows = odd_docs()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", *(x for x in CLASH if "source" not in x))
    got = mixing.mix(docs).collect()
    taken, want = check_mix(rows, got)
    assert all(abs(taken[s] - t) <= max(4, 0.01 * t) for s, t in want.items() if s is not None)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.filter("source = 'empty'")).count() == 1


def test_weights_and_dual():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 5, 100, rng.randrange(10**6)]) for _ in range(rng.randrange(1, 12))]
        got = mixing.targets(sizes)
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, brute_targets(sizes)))
    for target in (1.0, 40.0, 99.0, 150.0, 199.9):  # Newton against bisection
        x = np.array([0.01, 0.5, 1.0, 3.0, 60.0])
        x *= 100 / x.sum()
        d = mixing.Dual(100, target, 2)
        for _ in range(mixing.STEPS):
            w = np.minimum(2, np.exp(np.minimum(d.lam * x, 1)))
            d.step(float((x * w).sum()), float((x * x * w)[w < 2].sum()))
        assert math.isclose((x * np.minimum(2, np.exp(np.minimum(d.lam * x, 1)))).sum(), target, rel_tol=1e-6)


# ---- infilling --------------------------------------------------------------------------------

def brute_infill(doc_id, text):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    if h4 % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(6)
    signs = ["a", "Zz", "é", "😀", " ", "\n", "<", "<S", "P>", "x" * 30, ">", "0", " ", "\x00"]
    out = [None, "", "<P>", "a<M>b", "x", "é", "abc" * 50_000, "a1" * 40_000, "\n\n", "<<S", "S>"]
    return out + ["".join(rng.choice(signs) for _ in range(rng.randrange(300))) for _ in range(150)]


@pytest.mark.parametrize("size", [7, 64, infilling.FRAME_CHARS])
def test_infilling(spark, size):
    texts = odd_texts() if size > 7 else [t if t is None else t[:3000] for t in odd_texts()]
    rows = list(enumerate(texts)) + [(20, texts[20]), (20, texts[21]), (None, "no id but text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", *CLASH)
    made = infilling.examples(infilling.store(docs, size))
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(((d, *brute_infill(d, t)) for d, t in rows), key=key)
    assert sorted(map(tuple, infilling.texts(made).collect()), key=key) == want
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    found = infilling._per_example(made, {"o": "string", "r": "string"}, infilling._digests).collect()
    assert Counter(r.r for r in found) == Counter(sha(t) for _, t in rows) and Counter(r.o for r in found) == Counter(sha(w[-1]) for w in want)
    assert infilling.digest(docs.limit(0)).count() == 0


def test_only_cut_frames_are_opened(monkeypatch):
    text = "word " * 20_000
    stored, opened = infilling.Stored(infilling.framed(text, 1000)), []
    real = infilling.unpacked
    monkeypatch.setattr(infilling, "unpacked", lambda f: opened.append(f) or real(f))
    form, *_, frames = infilling.example(stored, False, 1)
    assert form != "plain" and len(stored.data) == 100 and 0 < len(opened) <= 6
    assert sum(f in set(stored.data) for f in frames) >= 97


# ---- collocations -----------------------------------------------------------------------------

def brute_mine(rows, least, most, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand, found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}, []
        for p, a in cand.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def odd_prose(n=250):
    rng = random.Random(5)
    vocab = ["The", "the", "of", "a", "cé", "É", "new", "york", "x-y", " z", "\x00", "<S>"]
    glue = [" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", "!"]
    rows = [("".join(rng.choice(vocab) + rng.choice(glue) for _ in range(rng.randrange(120))), rng.choice(["en", "de", None, "und", ""])) for _ in range(n)]
    return rows + [(None, "en"), ("", "en"), ("..;", None), ("new york " * 3000, "en"), ("b" * 100_000, "de"), ("one piece, " * 2000, "en")] + [rows[0]] * 5


def collect(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("held, part, phrases", [(collocations.HELD, collocations.PART_BYTES, collocations.PHRASES), (500, 300, 50)])
def test_collocations(spark, monkeypatch, held, part, phrases):
    for name, value in (("HELD", held), ("PHRASES", phrases)):
        monkeypatch.setattr(collocations, name, value)
    monkeypatch.setattr(collocations.parts, "__defaults__", (part,))
    rows = odd_prose()
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", *CLASH)
    for least, most, top in ((20, 5, 2000), (60, 3, 4)):
        want = brute_mine(rows, least, most, top)
        assert want and collect(collocations.mine(docs, least, most, top)) == want
    assert collocations.mine(docs.limit(0)).count() == 0 and collocations.mine(docs.limit(3)).count() == 0


def test_collocations_of_the_tables(spark):
    name = "op13_collocations"
    assert compare(spark, DIR, registered.queries()[name], registered.oracle_sql()[name]) is None
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert collect(collocations.mine(docs, 12)) == brute_mine([(r.text, r.lang) for r in docs.collect()], 12, 5, 2000)


def test_ngrams_are_not_broadcast(spark):
    found = collocations.frequent(spark.read.parquet(f"{SMALL}/documents.parquet"), 12)
    plan = collocations.scored(found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 2  # words of each lang


def test_infilling_of_the_table(spark):
    name = "op12_infilling"
    assert compare(spark, DIR, registered.queries()[name], registered.oracle_sql()[name]) is None


def test_summaries_lose_no_frequent_key():
    rng = np.random.default_rng(3)
    for trial in range(30):
        least = int(rng.integers(2, 30))
        stream = np.concatenate([rng.zipf(1.3, 4000) % 3000, np.repeat(rng.integers(0, 3000, 20), least)]).astype(np.uint32)
        rng.shuffle(stream)
        pieces = np.array_split(stream, int(rng.integers(1, 40)))
        m = collocations.MisraGries(len(stream) // least + 1)
        for p in pieces:
            k, c = np.unique(p, return_counts=True)
            keys, counts = collocations.unpacked(collocations.packed(k, c))
            assert (keys == k).all() and (counts == c).all()
            m.merge(keys, counts)
            assert len(m.keys) <= m.capacity
        k, c = np.unique(stream, return_counts=True)
        assert set(k[c >= least].tolist()) <= set(m.frequent(least).tolist()) and m.lost < least
