"""The language model: bounded samples, no cut vocabulary, and a language of few rows beside a large one."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

from marketframe.llm import language


def known(model, word):
    return xxhash.xxh64_intdigest(word, 42) in set(model.hashes.tolist())


def test_small_language_keeps_a_vocabulary(spark):
    hot = [(i, " ".join(f"{a}{b}" for a in "abcdefgh" for b in "mnopqrst"), "aa") for i in range(300)]
    rows = hot + [(1000 + i, "xuxu zyzy", "zz") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for bounds in ({"size": 2000}, {"rows": 12}, {}):
        model = language.train(df, **bounds)
        assert model.langs == ["aa", "zz"]
        assert known(model, "xuxu") and known(model, "zyzy")
    assert len(model.hashes) == 66  # every word of the sample


def test_model_equals_plain_counts(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("Ab ab äb c", "x"), ("ab d 1a", "y"), ("ß日本 d", "y"), ("zz", "x")] * 9)]
    model = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    may = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    words = Counter((lang, w) for t, lang in may for w in re.findall(r"[^\W\d_]+", t.lower()))
    grams = Counter()
    for (lang, w), n in words.items():
        p = f" {w} "
        for i in range(len(p)):
            for k in range(1, language.MAX_GRAM + 1):
                if i + k <= len(p):
                    grams[lang, p[i : i + k]] += math.log2(1 + n)

    def logs(counts):
        keys = sorted({k for _, k in counts})
        m = np.asarray([[counts[lang, k] for lang in model.langs] for k in keys], dtype=float)
        x = np.log((m + 0.5) / (m.sum(axis=0) + 0.5 * len(m)))
        return dict(zip(keys, x - x.mean(axis=1, keepdims=True)))

    want, want_grams = logs(words), logs(grams)
    assert len(model.hashes) == len(want) and set(model.grams) == set(want_grams)
    for w, x in want.items():
        assert np.allclose(model.score_words([w])[0], x, atol=1e-5)
    for g, i in model.grams.items():
        assert np.allclose(model.gram_logs[i], want_grams[g], atol=1e-5)
    assert np.allclose(model.score_words(["qä"])[0], want_grams[" "] + want_grams["ä"], atol=1e-5)  # the n-grams that are known


def test_level():
    assert language.level([5, 100, 3], 20) == 12
    assert language.level([5, 100, 3], 200) == 100
    assert language.level([], 20) == 1


def brute_predictions(model, texts):
    """Languages word by word and letter by letter, in plain Python."""
    word = dict(zip(model.hashes.tolist(), model.word_logs.astype(float)))
    gram = {g: model.gram_logs[i].astype(float) for g, i in model.grams.items()}
    out = []
    for text in texts:
        ws = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        if not ws or not model.langs:
            out.append("und")
            continue
        total = np.zeros(len(model.langs))
        for w in ws:
            h = xxhash.xxh64_intdigest(w, 42)
            if h in word:
                total += word[h]
                continue
            p, i, own, held = f" {w} ", 0, np.zeros(len(model.langs)), False
            while i < len(p) - 1:
                n = next((n for n in range(min(language.MAX_GRAM, len(p) - i), 0, -1) if p[i : i + n] in gram), 1)
                if p[i : i + n] in gram:
                    own, held = own + gram[p[i : i + n]], True
                i += max(1, n - 1)
            total += np.clip(own, -6, 6) if held else 0
        out.append(model.langs[int(np.argmax(np.round(total, 3)))] if np.ptp(np.round(total, 3)) else None)
    return out


def test_predictions_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs)
    odd = [None, "", "12 ²³ ½", "m²", "H₂O", "x½", "CO₂ H₂O", "²house²", "the²and", "ǅ ʰ ª", "日本", "a_b", "the of́ and", "the " * 20_000]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + i, t) for i, t in enumerate(odd)]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    for (i, text), want in zip(rows, brute_predictions(model, [t for _, t in rows])):
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in text or "")), repr(text)[:80]
        assert want is None or got[i].lang_pred == want, repr(text)[:80]
        assert 0 <= got[i].score <= 1


def test_letters_beside_signs_are_words(spark):
    rows = [(i, "my house is old" if i % 2 else "mein haus ist alt", "en" if i % 2 else "de") for i in range(60)]
    model = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert language.words_of("House² h₂o ½ 7") == Counter({"house": 1, "h": 1, "o": 1})
    assert language.Scorer(model).texts(["house²", "²haus", "m²", "½ 7²"])[0][:2] == ["en", "de"]
    assert language.Scorer(model).texts(["m²", "½ 7²"])[0][1] == "und" != language.Scorer(model).texts(["m²"])[0][0]
