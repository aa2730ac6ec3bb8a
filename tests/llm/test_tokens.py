"""BPE, token files and sharding against the library and plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from marketframe.llm import bpe, sharding, tokenfile

DIR = "/root/testdata/sf0.001"
ODD = ["", None, " ", "a", "  a  b\n\n c\t d ", "it's 'S '' $'s", "x<|endoftext|>y <|endoftext|>", "éa çé×÷ é'é 12é", "  b  c", "日本 語 a", "a" * 5000, "\x00\x01 \x1f b", "🙂🙂 éa"]
EXTRA = "doc_id bigint, text string, ids string, n_tokens string, decoded string, shard string, slot string"


def library():
    t = Tokenizer.from_file(bpe.default_tokenizer())
    t.no_truncation(), t.no_padding()
    return t


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in enumerate(texts)], EXTRA)


def texts(spark):
    return ODD + [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]


def test_bpe_equals_library(spark):
    t, every = library(), texts(spark)
    rng = random.Random(5)
    signs = "aé ß'\n\t×.,1sß  TA 日"
    every += ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(2000)]
    once = {r.doc_id: r for r in bpe.encode(docs(spark, every), decoded_col="decoded").collect()}
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs(spark, every))).collect()}
    assert once == got
    for i, x in enumerate(every):
        want = t.encode(x or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == want, repr(x)
        assert got[i].n_tokens == len(want)
        assert got[i].decoded == t.decode(want, skip_special_tokens=False)


def test_memo_bound_changes_nothing(monkeypatch, spark):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 500)
    c, t = bpe.FragmentCoder(bpe.default_tokenizer()), library()
    every = texts(spark)[:60]
    for i in range(0, 60, 7):
        for x, ids in zip(every[i : i + 7], c.encode_column(pa.array(every[i : i + 7])).to_pylist()):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_odd_ids_decode_as_in_the_library():
    c, t = bpe.FragmentCoder(bpe.default_tokenizer()), library()
    rng = random.Random(3)
    rows = [[rng.randrange(51000) for _ in range(rng.randrange(30))] for _ in range(300)] + [[], [50999], [0]]
    got = c.decode_column(pa.array([np.asarray(r, "<u4").tobytes() for r in rows] + [None], pa.binary())).to_pylist()
    size = t.get_vocab_size()
    assert got == [t.decode([i for i in r if i < size], skip_special_tokens=False) for r in rows] + [""]


def test_token_files(spark, tmp_path):
    t, every = library(), texts(spark)
    order = list(range(len(every)))
    random.Random(1).shuffle(order)
    rows = [(i, every[i]) for i in order] + [(None, "no id"), (3, "again")]
    tokenfile.write(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), str(tmp_path / "x"), shard_tokens=3000)
    got = tokenfile.read(spark, str(tmp_path / "x")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    at = 0
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(bytes(r.ids)))
        assert ids in [t.encode(x or "", add_special_tokens=False).ids + [2] for d, x in rows if d == r.doc_id]
        at += len(ids)
    assert at == sum(len(t.encode(x or "", add_special_tokens=False)) + 1 for _, x in rows)
    assert tokenfile.digest(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_lookups_in_token_files(spark, tmp_path):
    every = [x for x in texts(spark)] + ["word " * 20_000]
    path = str(tmp_path / "x")
    df = spark.createDataFrame(list(enumerate(every)), "doc_id bigint, text string").selectExpr("*", "1 as part", "2 as seq", "3 as n_tokens")
    tokenfile.write(df.repartition(3), path, shard_tokens=5000)
    rows = tokenfile.read(spark, path).orderBy("start").collect()
    ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in rows])
    owner = np.repeat([r.doc_id for r in rows], [r.n_tokens for r in rows])
    asked = [2, 13, int(ids[0]), int(ids[-2]), 49_999]
    assert {r.token: r.n for r in tokenfile.count(spark, path, asked).collect()} == {t: int((ids == t).sum()) for t in asked}
    found = sorted(map(tuple, tokenfile.occurrences(spark, path, asked).collect()))
    assert found == sorted((t, int(i), int(owner[i])) for t in set(asked) for i in np.flatnonzero(ids == t))
    places = [(i,) for i in range(0, len(ids), 37)] + [(0,), (len(ids) - 1,), (len(ids),), (-1,), (None,)]
    got = {r.pos: r.token for r in tokenfile.access(spark, path, spark.createDataFrame(places, "pos bigint")).collect()}
    assert got == {i: int(ids[i]) for (i,) in places if i is not None and 0 <= i < len(ids)}


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for ids in (rng.integers(0, 50257, 3000), rng.integers(0, 3, 2048), np.full(700, 9), np.asarray([5]), np.asarray([], dtype=int)):
        ids = ids.astype("<u4")
        wm = tokenfile.WaveletMatrix.build(ids)
        assert (wm.sequence() == ids).all() and (wm.access(np.arange(len(ids))) == ids).all()
        for i in range(0, len(ids), 97):
            assert wm.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
            at = np.flatnonzero(ids == ids[i])
            assert wm.count(int(ids[i])) == len(at) and (wm.select(int(ids[i])) == at).all()
            assert wm.select(int(ids[i]), np.asarray([len(at) // 2])) == at[len(at) // 2]
        assert wm.count(60000) == 0 and not len(wm.select(60000))


def test_sharding(spark):
    rows = [(i, "x" * (i % 50)) for i in range(1003)] + [(None, None), (7, "b"), (7, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'z' as shard", "1 as size")
    got = sharding.assign(df, slots=256).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((d or -1, len(x or "") + 1, zlib.crc32((x or "").encode())) for d, x in rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert sharding.digest(df.limit(0)).count() == 0
    assert sharding.digest(df.limit(3)).count() == 3


def test_sharding_follows_a_plain_ring(spark):
    """Rows one by one on a ring with bounds, and how many move for one more shard."""
    n, slots = 20_000, 1024
    df = spark.range(n).selectExpr("id AS doc_id", "'t' AS text")
    places = {}
    for shards in (8, 9):
        nodes = sorted((int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:8], 16) * slots >> 32, s) for s in range(shards) for v in range(sharding.VIRTUAL_NODES))
        keys = sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), i) for i in range(n))
        room = [n // shards + (s < n % shards) for s in range(shards)]
        want, late = {}, []
        for h, i in keys:
            at = next((k for k, (p, _) in enumerate(nodes) if p >= h * slots >> 32), 0)
            if room[nodes[at][1]]:
                room[nodes[at][1]] -= 1
                want[i] = nodes[at][1]
            else:
                late.append((i, at))
        for i, at in late:
            while not room[nodes[at][1]]:
                at = (at + 1) % len(nodes)
            room[nodes[at][1]] -= 1
            want[i] = nodes[at][1]
        places[shards] = {r.doc_id: r.shard for r in sharding.assign(df, n_shards=shards, slots=slots).collect()}
        assert places[shards] == want
    moved = sum(places[8][i] != places[9][i] for i in range(n))
    assert n / 9 <= moved <= n / 9 + 0.08 * n  # the least possible, and some that the bounds push on


def test_sharding_of_one_key(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 50)
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN NULL ELSE id END AS doc_id", "'same' AS text")
    got = sharding.assign(df).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == 3000 and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(counts[s])) for s in counts)
    long = spark.createDataFrame([(1, "x" * 3_000_000), (2, None)], "doc_id bigint, text string").selectExpr("*", "'a' AS law", "1 AS slot", "2 AS grown_shard")
    assert sorted((r.doc_id, r["size"]) for r in sharding.digest(long).collect()) == [(1, 3_000_001), (2, 1)]
