"""Suffix tree scores, whitening and conversation repair against brute force."""
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from metrilake.llm import sql, suffix_tree, turns, whitening
from metrilake.session import shared_dir

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = b""


# --- suffix tree ----------------------------------------------------------------------------
def words(text):
    return [*(text or "").encode("utf-8", "surrogatepass").translate(LOWER).split(), END]


class PlainTree:
    """The same tree from dictionaries of tuples of words."""

    def __init__(self, texts, depth, string_bits, price):
        docs = [words(t) for t in texts]
        self.c = Counter(w for d in docs for w in d)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.states = {}
        least = max(2, math.ceil(self.n / 2 ** string_bits))
        kept = {(w,): n for w, n in self.c.items() if n >= least}
        for k in range(1, depth + 1):
            longer = Counter()
            for d in docs:
                h = [END, *d]
                for i in range(max(1, k), len(h)):
                    s = tuple(h[i - k:i + 1])
                    if s[:-1] in kept and s[1:] in kept:
                        longer[s] += 1
            longer = {s: n for s, n in longer.items() if n >= least}
            by = defaultdict(dict)
            for s, n in longer.items():
                by[s[:-1]][s[-1]] = n
            new = {}
            for s, nxt in by.items():
                taken = {w: max(n - suffix_tree.DISCOUNT, 0) for w, n in nxt.items()}
                rest = kept[s] - sum(taken.values())
                p = {w: (t + rest * self.p(s[1:], w)) / kept[s] for w, t in taken.items()}
                gain = sum(q * math.log2(q / self.p(s[1:], w)) for w, q in p.items()) + max(0, 1 - sum(p.values())) * math.log2(rest / kept[s])
                if gain * kept[s] >= price * (len(p) + 1):
                    new[s] = (p, rest / kept[s])
            self.states |= new
            kept = longer

    def p(self, history, w):
        if not history:
            return (self.c[w] + 1) / (self.n + self.v + 1)
        if history in self.states:
            p, rest = self.states[history]
            return p[w] if w in p else rest * self.p(history[1:], w)
        return self.p(history[1:], w)

    def score(self, text, depth):
        h = [END, *words(text)]
        return sum(math.log10(self.p(tuple(h[max(0, i - depth):i]), h[i])) for i in range(1, len(h)))


def prose(n=120, seed=3):
    rnd = random.Random(seed)
    vocab = [f"W{i}" if i % 3 else f"w{i}é" for i in range(60)]
    out = [None, "", " \t", "one", "One\x0bONE one", "x " * 500, "it's \x1c odd word"]
    phrases = [[rnd.choice(vocab) for _ in range(4)] for _ in range(12)]
    for _ in range(n):
        out.append(rnd.choice([" ", "\n", "  "]).join(w for _ in range(rnd.randrange(1, 25)) for w in rnd.choice(phrases)[:rnd.randrange(1, 5)]))
    return out + out[-9:]


@pytest.mark.parametrize("depth,string_bits,word_bits,price", [(2, 20, 22, 4.0), (3, 8, 9, 1.0), (1, 5, 5, 2.0)])
def test_scores_match_a_plain_tree(spark, depth, string_bits, word_bits, price):
    texts = prose()
    rows = [(i, t, 1, "k", 2.0, 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, key string, base double, uid int").repartition(3)
    train = [t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    plain = PlainTree(train, depth, string_bits, price)
    assert plain.states
    tree, counts = suffix_tree.fit(docs.filter(~suffix_tree.held_out("doc_id")), depth=depth, string_bits=string_bits, word_bits=word_bits, price=price)
    got = {r["doc_id"]: r for r in suffix_tree.score(docs, tree, counts, keep=["doc_id", "n", "key", "base", "uid"]).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        w = words(t)
        assert (got[i]["n"], got[i]["key"], got[i]["base"], got[i]["uid"]) == (1, "k", 2.0, 3)
        assert got[i]["n_tokens"] == len(w) and got[i]["n_known"] == sum(x in plain.c for x in w) and got[i]["train_tokens"] == plain.n
        assert got[i]["base_score"] == pytest.approx(sum(math.log10(plain.p((), x)) for x in w), rel=1e-9)
        assert got[i]["score"] == pytest.approx(plain.score(t, depth), rel=1e-9), t


def test_strings_that_occur_twice_count_in_a_corpus_of_millions_of_tokens(spark):
    rnd = random.Random(8)
    twice = [" ".join(f"t{rnd.randrange(400)}" for _ in range(300)) for _ in range(3)]
    texts = ["x " * 40_000] * 60 + twice * 2                # above 2**21 tokens
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    plain = PlainTree(texts, 2, 60, suffix_tree.PRICE)
    assert plain.n > 1 << 21 and any(s[-1] != b"x" for s in plain.states)
    tree, counts = suffix_tree.fit(docs)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(docs.filter("doc_id >= 59"), tree, counts).collect()}
    assert len(got) == 7
    for i, score in got.items():
        assert score == pytest.approx(plain.score(texts[i], 2), rel=1e-9, abs=1e-6), i


def test_tables_of_strings_are_deleted_when_nothing_reads_them(spark):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(prose())], "doc_id long, text string").repartition(3)
    tree, counts = suffix_tree.fit(docs)
    assert suffix_tree.score(docs, tree, counts).count() == len(prose())
    assert {d.name.split("-")[1] for d in set(folder.iterdir()) - before} == {"words", "worth", "scores"}


def test_a_coarse_tree_answers_many_blocks(spark, monkeypatch):
    texts = prose()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tree, counts = suffix_tree.fit(docs)
    monkeypatch.setattr(suffix_tree, "OWNED", 8)              # owners of finer ranges than the tree's runs
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 1 << 10)
    plain = PlainTree(texts, 2, 60, suffix_tree.PRICE)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(docs, tree, counts).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain.score(t, 2), rel=1e-9), t


def test_states_are_distributions():
    plain = PlainTree(prose(), 2, 20, 4.0)
    for s in plain.states:
        assert sum(plain.p(s, w) for w in plain.c) + plain.p(s, b"never seen") == pytest.approx(1)


def test_scores_of_no_rows_and_of_no_training(spark):
    ddl = "doc_id long, text string"
    none = spark.createDataFrame([], ddl)
    tree, counts = suffix_tree.fit(none)
    assert suffix_tree.score(none, tree, counts).collect() == []
    got = suffix_tree.score(spark.createDataFrame([(1, "a b"), (None, None)], ddl), tree, counts).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]


def test_held_out_prose_is_more_likely_than_by_its_words_alone(spark):
    from conftest import SF_MED
    docs = spark.read.parquet(f"{SF_MED}/documents.parquet").withColumn("held_out", suffix_tree.held_out("doc_id"))
    tree, counts = suffix_tree.fit(docs.filter("not held_out"))
    r = suffix_tree.score(docs.filter("held_out"), tree, counts).selectExpr("sum(score)", "sum(base_score)", "avg(cast(score > base_score as int))").first()
    assert r[0] > r[1] and r[2] > 0.8


# --- whitening -------------------------------------------------------------------------------
def vectors(seed=5, d=20, n=300):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d))
    return [list(map(float, np.float32(v))) for v in (rng.normal(size=(n, d)) @ mix * 0.2 + 3)]


def test_whitening_matches_numpy(spark):
    good = vectors()
    rows = [(i, v) for i, v in enumerate(good)] + [(1000 + i, good[i]) for i in range(0, 300, 7)]
    bad = [(5000, None), (5001, []), (5002, [None] * 20), (5003, [float("nan")] + good[0][1:]), (5004, [float("inf")] + good[0][1:]), (5005, good[0][:3])]
    df = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, n int, whitened double, x string").repartition(4)
    got = whitening.whiten(df, keep=["vec_id"]).collect()
    x = {i: [math.floor(64 * c) + 1000000 for c in v] for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    c = (fit - s / n).astype(np.float64)
    cov = c.T @ c / n
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    rows_of = defaultdict(dict)
    for r in got:
        rows_of[r["vec_id"]][r["component"]] = r
        assert r["n"] == n and r["identity_error"] < 1e-10
    assert set(rows_of) == set(x) and all(sorted(v) == list(range(1, 17)) for v in rows_of.values())
    sign = {k: np.sign(sum(rows_of[i][k]["whitened"] * float(((np.array(x[i]) - s / n).astype(float) @ vector[:, k - 1])) for i in x)) for k in range(1, 17)}
    for i in x:
        for k, r in rows_of[i].items():
            assert r["deviation"] == r["deviation_exact"] == sum((n * a - b) ** 2 for a, b in zip(x[i], s))
            assert r["explained"] == pytest.approx(value[k - 1] / np.trace(cov), rel=1e-9)
            assert r["whitened"] == pytest.approx(sign[k] * float((np.array(x[i]) - s / n).astype(float) @ vector[:, k - 1]) / math.sqrt(value[k - 1]), abs=1e-8)


@pytest.mark.parametrize("spread", [[5.0] * 3 + [5 + 1e-9] * 2 + [1 + 1e-6 * i for i in range(15)], [3, 3, 3, 1, 1, 1e-8, 0, 0], list(10.0 ** -np.linspace(0, 12, 24)), [1.0] * 6])
def test_refined_eigenvectors_of_clustered_eigenvalues(spread):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(len(spread),) * 2))
    a = (q * np.array(spread)) @ q.T
    a = (a + a.T) / 2
    value, x = whitening.refined_eigh(a)
    wide = x.astype(np.longdouble)
    assert np.abs(a.astype(np.longdouble) @ wide - wide * value).max() < 2e-15 * max(spread)
    assert np.abs(wide.T @ wide - np.eye(len(spread))).max() < 1e-15
    assert value == pytest.approx(np.sort(spread)[::-1], abs=1e-14 * max(spread))


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for low, high in ((-100, 100), (-2 ** 40, 0), (-10 ** 12, 10 ** 12)):
        y = rng.integers(low, high, size=(1500, 3))
        assert (whitening.products(y) == y.astype(object).T @ y.astype(object)).all()


def test_whitening_without_variance(spark):
    ddl = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, ddl)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (None, [1.5, 2.0])], ddl)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (1, 1), (2, 1)] and {r["explained"] for r in got} == {1.0}


def test_deviation_beyond_a_long(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [1e9, 0.0]), (2, [0.0, 1e9]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert all(r["deviation"] is None and r["deviation_exact"] > 1 << 63 for r in got if r["vec_id"] < 3)


# --- conversation repair ------------------------------------------------------------------------
def cheapest(marks):
    """(cost, audit) of the cheapest repair by trying every edit from every state."""
    best = {}
    n = len(marks) // 2

    def go(i, state, inserts):
        """All ways to the end, at most two insertions in a row."""
        out = [(0, "")] if i == n and state in ("", "a") else []
        after = "a" if state == "u" else "u"
        if inserts < 2:
            out += [(5 + c, "I" + a) for c, a in go(i, after, inserts + 1)]
        if i < n:
            letter, fault = marks[2 * i], marks[2 * i + 1]
            out += [(2 + c, "D" + a) for c, a in memo(i + 1, state)]
            if fault not in "bd":
                late = 5 if fault == "t" else 0
                out += [((late if letter == after else 1 + late) + c, ("K" if letter == after else "R") + a) for c, a in memo(i + 1, after)]
                if letter == "s" and state == "":
                    out += [(late + c, "K" + a) for c, a in memo(i + 1, "s")]
        return out

    def memo(i, state):
        if (i, state) not in best:
            best[i, state] = [min(go(i, state, 0))]
        return best[i, state]

    return memo(0, "")[0]


def test_alignment_matches_every_edit():
    kinds = [a + b for a in "suat" for b in "-tbd"]
    for n in range(4):
        for marks in map("".join, itertools.product(kinds, repeat=n)):
            assert min(turns.exits(marks, turns.START, True).values()) == cheapest(marks), marks
    rnd = random.Random(7)
    for _ in range(400):
        marks = "".join(rnd.choice(["u-", "a-", "u-", "a-", rnd.choice(kinds)]) for _ in range(rnd.randrange(4, 40)))
        assert min(turns.exits(marks, turns.START, True).values()) == cheapest(marks), marks


DDL = "conv_id long, turn long, role string, text string, n long, cost string, part int"
SAYS = ["Yes.", "No!", "Why?", "open end", "", " \t", "Yes.", "x" * 3000 + ".", "ends. \n", "é", None]


def chats(seed=11):
    rnd = random.Random(seed)
    out = []
    for conv in [*range(40), None]:
        size = rnd.choice([1, 2, 3, 8, 30, 90])
        for t in range(size):
            role = rnd.choice(["user", "assistant"][t % 2:] or ["user"]) if rnd.random() < 0.9 else rnd.choice(["system", "tool", "", None, "User", "usher"])
            out.append((conv, t if rnd.random() < 0.95 else rnd.choice([None, t + 3]), "system" if t == 0 and rnd.random() < 0.5 else role, rnd.choice(SAYS) if rnd.random() < 0.5 else f"{rnd.random()}."))
    out += [(77, 1, "user", "Twice."), (77, 1, "user", "Twice."), (77, 1, "assistant", "Same turn."), (88, None, "user", "No turn."), (88, None, "assistant", "None.")]
    return out


def both(spark, rows, block):
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], DDL).repartition(3)
    got = sorted((str(r["conv_id"]), *r[1:]) for r in turns.repair(turns.damaged(df), block=block).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return got, sorted((str(r[0]), *r[1:]) for r in con.execute(sql.OP13).fetchall())


@pytest.mark.parametrize("block", [turns.BLOCK, 7, 1])
def test_repair_matches_sql_whatever_the_blocks(spark, block):
    got, expected = both(spark, chats(), block)
    assert len(expected) == 43
    assert got == expected


def test_repair_of_no_rows_and_of_a_dropped_conversation(spark):
    assert both(spark, [], 4) == ([], [])
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got, expected = both(spark, [(conv, 0, "user", "Gone.")], 4)
    assert got == expected == [(str(conv), 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_a_conversation_over_many_partitions_is_one(spark):
    """A long conversation is dealt over partitions and blocks, with one row repeated often."""
    rows = [(5, t, ["user", "assistant"][t % 2], f"Line {t}." if t % 11 else "Again.") for t in range(700)] + [(5, 3, "assistant", "Over and over.")] * 150
    got, expected = both(spark, rows, 16)
    assert got == expected and len(got) == 1
