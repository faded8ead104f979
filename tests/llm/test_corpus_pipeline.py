"""The corpus pipeline stage by stage against brute force."""
import re
from collections import Counter, defaultdict

import corpus_pipeline as C
from metrilake.llm.common import shared_table
from test_corpus_dedup import classes, sets

SMALL = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def step(spark, k, docs):
    return shared_table(C.STAGES[k][1](spark, docs, SMALL), "test")


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = [(10 ** 6 + i, t, None, None, 1) for i, t in enumerate([None, "", "12 34", "Привет мир, это другой язык " * 9])]
    extra += [(10 ** 6 + 50, None, None, None, None), (None, docs.first().text, "en", "x", 1), (None, docs.first().text, "en", "x", 1)]
    a = step(spark, 0, docs.select(*C.COLUMNS).unionByName(spark.createDataFrame(extra, DDL)))
    assert a.columns == C.COLUMNS and a.filter("doc_id < 1000000 or doc_id is null").count() == docs.count() + 2
    assert a.filter("doc_id >= 1000000").count() == 0

    b = step(spark, 1, a)
    groups = defaultdict(list)
    for r in a.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text)].append(r.doc_id)
    want = Counter(min((x for x in g if x is not None), default=None) for g in groups.values())
    assert Counter(r.doc_id for r in b.collect()) == want

    c = step(spark, 2, b)
    s = {r.doc_id: sets(r.text) for r in b.collect()}
    links = [(x, y) for x in s for y in s if x < y and 100 * len(s[x] & s[y]) >= 80 * len(s[x] | s[y])]
    assert sorted(r.doc_id for r in c.collect()) == sorted(set(classes(s, links).values()))

    d = step(spark, 3, c)
    words = {r.doc_id: len(r.text.split()) for r in c.collect()}
    times = Counter(r.doc_id for r in d.collect())
    assert d.columns == C.COLUMNS and max(times.values()) <= 2
    assert abs(sum(words[i] * n for i, n in times.items()) - 1.5 * sum(words.values())) < 0.05 * sum(words.values())

    e = step(spark, 4, d).toPandas()
    assert e.uid.nunique() == d.count() and e.groupby("uid").length.sum().eq(e.groupby("uid").doc_tokens.first()).all()
    assert Counter(e.drop_duplicates("uid").doc_id) == times


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b c d e f", "en", "s", 1)] * 3 + [(1, "other words here now ok yes", "en", "s", 1), (2, "a b  c d e f", "en", "s", 1), (None, "q r s t u v", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DDL)
    for k in (1, 2):
        got = sorted((r.doc_id or 0, " ".join(r.text.split())) for r in step(spark, k, docs).collect())
        assert got == [(0, "q r s t u v"), (1, "a b c d e f"), (1, "other words here now ok yes")]


def test_empty_table_passes(spark):
    docs = spark.createDataFrame([], DDL)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
