"""Personal data against Python's re and a plain count of disclosures."""

import hashlib
import math
import random
import re
from collections import defaultdict

import regex

from marketframe.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(n):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(n))) % 10 == 0


def base(text):
    out = []
    for order, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), order, m.end(), m[0]))
    return sorted(out)


def brute(rows, support=pii.SUPPORT, threshold=pii.THRESHOLD, letters=pii.LETTERS):
    """Spans of each document: a word counts beside a value wherever in a document both stand, and a
    word that tells a value is a span in every document."""
    n_te, n_e, texts, n_t = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for i, x in enumerate(rows):
        words = set(regex.findall(rf"\p{{L}}{{{letters},}}", (x or "").lower()))
        for w in words:
            n_t[w].add(i)
        for ent in {(o, v.lower()) for _, o, _, v in base(x)}:
            n_e[ent].add(i)
            for w in words:
                n_te[ent, w].add(i)
                texts[ent, w].add(x)
    n, told = len(rows), set()
    for (ent, w), docs in n_te.items():
        info = math.log2(n / len(n_e[ent]))
        if len(texts[ent, w]) >= support and info > 0 and math.log2(n * len(docs) / (len(n_t[w]) * len(n_e[ent]))) / info >= threshold:
            told.add(w)
    out = []
    for x in rows:
        b = base(x)
        extra = [(m.start(), 4, m.end()) for m in regex.finditer(r"(?<!\p{L})(?:" + "|".join(sorted(told)) + r")(?!\p{L})", x or "", regex.I)] if told else []
        extra = [t for t in extra if not any(s < t[2] and t[0] < e for s, _, e, _ in b)]
        out.append(sorted([(s, o, e) for s, o, e, _ in b] + extra))
    return out


def said(spans):
    return ",".join(f"{pii.KINDS[o]}:{s}:{e}" for s, o, e in spans)


def texts():
    rng = random.Random(3)
    out = [None, "", "x" * 30000, "1" * 30000, "1-" * 20000, "a." * 20000, "a@" + "b." * 9000 + "c", "+1" + "(" * 30000, "256.1.1.1 1.1.1.001 0000255.1.1.1 1.2.3.4.5.6.7.8", "a@b.c_d@e.f a@b a@.c é@é.de +12 345-678(90)1", "🙂 4111 1111 1111 1111 x@y.zz", "4111-1111-1111-1111-1 12 3456"]
    signs = ["1", "2", "45", ".", "-", " ", "+", "@", "a", "b.c", "é", "(", "4111111111111111", "255", "_", "%"]
    out += ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(800)]
    for i in range(6):  # an entity told by a word of its own
        out.append(f"some filler{i} text reach Zorblatt under zed@example.org or zorblatt again {i}")
    # a term far from the value, beside another value's words, and in documents without the value
    far = " plain words between" * 5
    out += [f"Quillbrane {i}{far} ask 10.20.30.40, or call +49 30 12345678" for i in range(8)]
    out += ["quillbrane alone", "Quillbraner, quillbran", "QUILLBRANE_x ask zed@example.org"]
    return out + ["nothing here"] * 300


def test_spans(spark):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").selectExpr("*", "'z' as value", "1 as start")
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    want = brute(rows)
    assert any("term" in said(w) for w in want) and any(said(w).startswith("term") and "," not in said(w) for w in want)
    for i, x in enumerate(rows):
        b = base(x)
        assert [got[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(o == k for _, o, _, _ in b) for k in range(4)], repr(x)[:200]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[o]}:{s}:{e}" for s, o, e, _ in b).encode()).hexdigest()
        assert got[i].spans == said(want[i]), repr(x)[:200]


def test_sanitise(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(rows)], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    for i, (x, spans) in enumerate(zip(rows, brute(rows))):
        out, at = "", 0
        for s, o, e in spans:
            if s >= at:
                out += x[at:s] + f"[{pii.KINDS[o].upper()}]"
            at = max(at, e)
        want = out + x[at:] if spans else x
        assert got[i].text == want and got[i].n_chars == len(want or "")
    assert pii.digest(df.limit(0)).count() == 0


def test_terms_of_whole_documents(spark):
    """A term far from the value is found, whole, and generalised in documents without the value too."""
    far = " plain words between" * 5
    rows = [f"Quillbrane {i}{far} ask zed@example.org" for i in range(6)]
    rows += ["quillbrane alone", "Quillbraner, quillbran"] + ["plain words between, nothing else"] * 300
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in pii.digest(df).collect()}
    assert all(got[i].split(",")[0] == "term:0:10" for i in range(7))
    assert got[7] == got[8] == ""
    told = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert told[6] == "[TERM] alone" and told[0] == f"[TERM] 0{far} ask [EMAIL]"
    short = {r.doc_id: r.text for r in pii.sanitise(df, letters=1).collect()}
    assert short[0] == f"[TERM] 0{far} [TERM] [EMAIL]"
