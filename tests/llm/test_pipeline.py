"""The pipeline against plain Python, stage by stage, on whole small tables."""

import re

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from marketframe.llm import bpe, toxicity
from test_pii import brute as spans_of
from marketframe.llm.pii import KINDS

DIR = "/root/testdata/sf0.01"


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def groups(rows, k, num, den):
    """doc_id -> smallest doc_id reachable by links."""
    sets, root = {i: shingle_set(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in ids}


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(text, n=10):
    w = alnum(text)
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    rows = [r for r in rows if model.score(r[1]) < 0.5]
    assert 0 < len(rows) < docs.count()
    root = groups(rows, 5, 4, 5)
    rows = [r for r in rows if root[r[0]] == r[0]]
    items = set().union(*(windows(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()))
    rows = [r for r in rows if not any(f" {w} " in " " + " ".join(alnum(r[1])) + " " for w in items)]
    t = Tokenizer.from_file(bpe.default_tokenizer())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DIR).collect()}
    assert got.keys() == {i for i, _ in rows}
    for (i, x), spans in zip(rows, spans_of([x for _, x in rows])):
        out, at = "", 0
        for s, o, e in spans:
            if s >= at:
                out += x[at:s] + f"[{KINDS[o].upper()}]"
            at = max(at, e)
        x = out + x[at:] if spans else x
        assert got[i].text == x and got[i].n_tokens == len(t.encode(x, add_special_tokens=False).ids)


def test_columns_stay(spark):
    small = DIR.replace("0.01", "0.001")
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("*", "1 as score", "2 as root", "3 as key", "4 as __h", "5 as n")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), small).count() == 0


def test_odd_documents_go_through(spark, tmp_path):
    """Nulls in every column, empty, repeated and very long texts, ties and clashing names, to the end."""
    small = DIR.replace("0.01", "0.001")
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    odd = [(9001, None), (9002, ""), (None, "a text without a number"), (None, None), (9003, long), (9004, long + " and more"), (9005, "same words here for all of them now"), (9006, "same words here for all of them now"), (9006, "same words here for all of them now")]
    nulls = [f"CAST(NULL AS {k}) AS `{c}`" for c, k in kinds.items() if c not in ("doc_id", "text")]
    more = spark.createDataFrame(odd, f"doc_id {kinds['doc_id']}, text string").selectExpr("doc_id", "text", *nulls).select(docs.columns)
    path = str(tmp_path / "in")
    docs.unionByName(more).write.parquet(f"{path}/documents.parquet")
    for t in ("labels", "benchmark"):
        rows = spark.read.parquet(f"{small}/{t}.parquet")
        rows.unionByName(rows.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema))).write.parquet(f"{path}/{t}.parquet")
    got = corpus_pipeline.run(spark, path).collect()
    ids = [r.doc_id for r in got]
    assert {9001, 9002, 9003, 9005} <= set(ids) and not {9004, 9006} & set(ids) and ids.count(None) == 2
    by = {r.doc_id: r for r in got}
    assert by[9003].text == long and by[9001].n_tokens == by[9002].n_tokens == 0
