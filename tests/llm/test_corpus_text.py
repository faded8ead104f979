"""Language, licence, token, HTML, mixing, sharding and packing operators."""
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrilake.llm import lengths, licenses, mixing, packing, ppm, shards
from metrilake.llm.html_text import extract, main_text
from metrilake.llm.tokens import default_path, encoder

MED = "/root/testdata/sf0.01"
ODD = [None, "", " ", "a", "a", "\n\n", "  two  spaces ", "don't we'll 12,345 — ünï ñ 漢字  x y 🙂", "word " * 3000, "áb ʼn ﬁ"]


def table(spark, rows, ddl="doc_id long, text string, source string, size int, place int, topic int"):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], ddl).repartition(3)


def test_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    enc = encoder(default_path())
    rnd = random.Random(1)
    made = ["".join(rnd.choice("ab Ab \n\t'.,1é漢 ́") for _ in range(60)) for _ in range(300)]
    for t in [*[x for x in ODD if x], *made, "<|endoftext|> x", "a<|endoftext|>b", "two <|endoftext|>\n\n <|endoftext|>  x", "<|endoftext", "a<|endoftext|>" * 3]:
        assert np.frombuffer(enc(t), np.uint16).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)
    assert enc(None) == enc("") == b""


def test_packing_places_every_id_once(spark):
    rnd = random.Random(2)
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(None, "no key", "s"), (3, "a", "s")]
    rows += [(100 + i, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "rho", "tau"]) + str(rnd.randrange(50)) for _ in range(rnd.randrange(1, 200))), "s") for i in range(80)]
    got = packing.pack(table(spark, rows), window=64, shard_tokens=3000, with_ids=True).toPandas()
    enc = encoder(default_path())
    want = Counter((i if i is not None else -1, enc(t) + b"\0\0") for i, t, _ in rows)
    docs = defaultdict(list)
    for r in got.itertuples():
        docs[r.uid].append(r)
        ids = np.frombuffer(r.ids, np.uint16)
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
    have = Counter()
    for parts in docs.values():
        parts.sort(key=lambda r: r.start)
        assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        body = b"".join(p.ids for p in parts)
        assert len(body) // 2 == parts[0].doc_tokens
        have[(int(parts[0].doc_id) if parts[0].doc_id == parts[0].doc_id else -1, body)] += 1
    assert have == want
    seq = defaultdict(list)
    for r in got.itertuples():
        seq[r.sequence_id].append((r.offset, r.length))
    total = {s: sum(n for _, n in v) for s, v in seq.items()}
    for v in seq.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))]
    assert max(total.values()) == 64 and sum(n < 64 for n in total.values()) <= 8
    assert packing.pack(table(spark, []).filter("false")).count() == 0


def test_windows_fill_with_lexical_neighbours():
    idf = np.ones(packing.VOCABULARY, np.float32)
    rests = [np.array([1, 2, 3], np.uint16), np.array([7, 8, 9], np.uint16), np.array([1, 2, 4], np.uint16), np.array([7, 8, 5, 6], np.uint16)]
    assert packing.fill(rests, idf, 6) == [[(0, 0, 3, False), (2, 0, 3, True)], [(1, 0, 3, False), (3, 0, 3, True)], [(3, 3, 1, True)]]


def plain_scores(rests, idf):
    """BM25 of each rest for each other as a query, term by term."""
    mean = sum(map(len, rests)) / len(rests)
    count = [Counter(r.tolist()) for r in rests]
    return [[sum(float(idf[t]) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(r) / mean)) for t in q if t in c) for r, c in zip(rests, count)] for q in count]


@pytest.mark.parametrize("seed,window,words", [(1, 40, 60), (2, 64, 300), (3, 16, 8), (4, 1024, 2000)])
def test_windows_are_filled_as_a_plain_bm25_search_fills_them(seed, window, words):
    rnd = np.random.default_rng(seed)
    idf = rnd.uniform(0.1, 6, packing.VOCABULARY).astype(np.float32)
    rests = [np.minimum(rnd.zipf(1.3, rnd.integers(1, min(window, 300))), words).astype(np.uint16) for _ in range(260)]
    rests += [rests[5], rests[5], rests[7], np.array([0], np.uint16), np.array([0], np.uint16)]
    score = plain_scores(rests, idf)
    unused, seed_at, by_search = set(range(len(rests))), None, 0
    for pieces in packing.fill(rests, idf, window):
        (i, at, size, _), *others = pieces
        assert size == len(rests[i]) - at
        if seed_at is None:
            assert i == min(unused) and at == 0
            unused.remove(i)
        else:
            assert (i, at) == seed_at
        room, seed_at = window - size, None
        for j, start, n, found in others:
            best = max(score[i][x] for x in unused)
            assert start == 0 and n == min(room, len(rests[j])) and found == (best > 0)
            if best > 0:
                assert score[i][j] == pytest.approx(best, rel=1e-5)
                assert all(len(rests[x]) != len(rests[j]) or (rests[x] != rests[j]).any() for x in unused if x < j)  # of equal rests the earlier one
                by_search += 1
            else:
                assert j == min(unused)
            unused.remove(j)
            room -= n
            seed_at = (j, n) if n < len(rests[j]) else None
        assert room == 0 or not unused
    assert not unused and seed_at is None and by_search > 50


def test_falling_scores_with_ties():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 31, 32, 33, 500):
        for kinds in (3, 1000):
            score = rnd.integers(0, kinds, n).astype(float)
            assert list(packing.falling(score)) == sorted(np.flatnonzero(score > 0).tolist(), key=lambda i: (-score[i], i))


def test_length_histogram_answers(spark):
    rows = [(i, t, "s") for i, t in enumerate([*ODD, "x y z", "x y z"])]
    hist = lengths.length_histogram(table(spark, rows)).cache()
    enc = encoder(default_path())
    n = [len(enc(t)) // 2 for _, t, _ in rows]
    for r in hist.collect():
        at = r.n_tokens
        assert (r.n_docs, r.docs_upto, r.docs_over) == (n.count(at), sum(x <= at for x in n), sum(x > at for x in n))
        assert (r.tokens_upto, r.tokens_over, r.truncated_total) == (sum(x for x in n if x <= at), sum(x for x in n if x > at), sum(min(x, at) for x in n))
    assert lengths.total(hist) == sum(n)
    limits = [0, 1, 2, 3, 700, 2999, 10 ** 6]
    got = dict(lengths.truncated(hist, spark.createDataFrame([(x,) for x in limits], "limit long")).collect())
    assert got == {x: sum(min(y, x) for y in n) for x in limits}
    for q in (0.01, 0.5, 0.9, 1.0):
        assert lengths.quantile(hist, q) == sorted(n)[max(0, int(np.ceil(q * len(n))) - 1)]
    assert lengths.length_histogram(table(spark, []).filter("false")).count() == 0


def fill_level(sizes, weights, share, epochs):
    """Targets by clamping one round at a time."""
    held = set()
    while True:
        free = [s for s in sizes if s not in held]
        if not free:
            return {s: epochs * sizes[s] for s in sizes}
        level = (share * sum(sizes.values()) - sum(epochs * sizes[s] for s in held)) / sum(weights[s] for s in free)
        over = [s for s in free if epochs * sizes[s] < level * weights[s]]
        if not over:
            return {s: epochs * sizes[s] if s in held else level * weights[s] for s in sizes}
        held.update(over)


@pytest.mark.parametrize("share", [0.4, 1.5, 3.0])
def test_mixing_hits_its_targets(spark, share):
    rnd = random.Random(3)
    rows = [(i, " ".join(["w"] * rnd.randrange(1, 30)), rnd.choice(["b", "b", "b", "a", "é", "Z", None])) for i in range(600)]
    rows += [(900, None, "empty"), (901, " ", "empty"), (None, "w w", "b"), (None, "w w", "b"), (5, "w w w", "b")]
    got = mixing.mix(table(spark, rows), share=share).toPandas()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = fill_level(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, share, 2)
    took = Counter()
    for r in got.itertuples():
        s = None if r.source is None or r.source != r.source else r.source
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        took[s] += r.taken
    assert len(got) == len(rows) and all(abs(took[s] - target[s]) <= 30 for s in sizes)
    again = mixing.mix(table(spark, rows).repartition(2), share=share).toPandas()
    assert sorted(zip(got.doc_id.fillna(-1), got["size"], got.taken)) == sorted(zip(again.doc_id.fillna(-1), again["size"], again.taken))
    whole = mixing.mixed(table(spark, rows), share=share)
    assert whole.columns == ["doc_id", "text", "source", "size", "place", "topic"] and whole.count() == got.repeats.sum()
    assert mixing.mix(table(spark, []).filter("false")).count() == 0


def least_capacity(sizes, k):
    """Smallest possible largest part of a contiguous partition into k, by dynamic programming."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(k):
        best = [0] + [min(max(best[j], sum(sizes[j:i])) for j in range(i)) for i in range(1, len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 7), (3, 40)])
def test_shards_are_minimax(spark, seed, k):
    rnd = random.Random(seed)
    sizes = [rnd.choice([5, 9, 40, 200]) + rnd.randrange(30) for _ in range(25)]
    atoms = spark.createDataFrame([(i * 3, x) for i, x in enumerate(sizes)], "atom long, bytes long")
    cap, cuts = shards.capacity_and_cuts(atoms, k)
    assert cap == least_capacity(sizes, k) and len(cuts) < k and cuts == sorted(set(cuts))
    part = Counter()
    for i, x in enumerate(sizes):
        part[sum(c <= i * 3 for c in cuts)] += x
    assert max(part.values()) == cap


def test_shards_keep_groups_and_number_rows(spark):
    rows = [(i, f"text {i % 50} " + "é" * (i % 50), "s") for i in range(300)] + [(i, "hot", "s") for i in range(300, 900)] + [(900, None, "s"), (901, "", "s"), (None, "hot", "s"), (7, "hot", "s")]
    got = shards.shard(table(spark, rows), shards=8).toPandas()
    assert len(got) == len(rows) and set(got["shard"]) <= set(range(8)) and got.grown_shard.isna().all() and set(got.law) == {"bytes"}
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    for i, t, _ in rows:
        if i is not None and i not in (7,):
            r = got[got.doc_id == i].iloc[0]
            assert (r["size"], r.text_crc32) == (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert got[got.text_crc32 == zlib.crc32(b"hot")]["shard"].nunique() == 1
    assert shards.shard(table(spark, []).filter("false")).count() == 0


def test_licenses_of_notices_and_full_texts(spark):
    mit = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files\n(the "Software"), to deal in the '
           "Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to\n"
           "permit persons to whom the Software is furnished to do so, subject to the following conditions.\n\nThe above copyright notice and this permission notice shall be included in all "
           'copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
           "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.")
    rows = [(1, "Some prose.\nReleased under the MIT License.\nMore.", "s"), (2, "no stop\nLicensed under the Apache License, Version 2.0.\nêonaux | x", "s"), (3, mit, "s"),
            (4, "Licensed under CC BY-NC 4.0. This work is licensed under the GNU General Public License, version 3.", "s"), (5, "He had a licence to walk.", "s"), (6, None, "s"),
            (7, "", "s"), (8, "// SPDX-License-Identifier: MIT\nint x;", "s"), (9, "see the GNU General Public License for more details.", "s"),
            (10, "words " * 50_000 + ". Released under the MIT License.", "s")]
    got = {r.doc_id: r for r in licenses.scan(table(spark, rows)).collect()}
    want = {1: ["MIT"], 2: ["Apache-2.0"], 3: ["MIT"], 4: ["GPL-3.0", "CC-BY-NC-4.0"], 5: [], 6: [], 7: [], 8: ["MIT"], 9: [], 10: ["MIT"]}
    assert {k: r.licenses for k, r in got.items()} == want
    assert got[9].unmatched == 1 and got[3].unmatched == 0 and got[6].sentence_ids == []
    assert all(re.search(licenses.STEMS, s) for s in licenses.SENTENCES.values())
    plan = licenses.scan(table(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{MED}/documents.parquet")
    model = ppm.fit(docs.filter(~ppm.held_out()), key=F.col("doc_id"), sample_rows=200)
    got = ppm.identify(docs, model, keep=["doc_id", "lang"]).withColumn("out", ppm.held_out()).toPandas()
    held = got[got.out]
    assert len(got) == docs.count() and len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, "the of and " * 40_000), (4, "the of and")], "doc_id long, text string")
    pred = [(r.lang_pred, r.score > 0) for r in ppm.identify(odd, model).orderBy("doc_id").collect()]
    assert pred == [("und", False)] * 3 + [("en", True)] * 2
    none = ppm.fit(docs.filter("false"))
    assert {r.lang_pred for r in ppm.identify(odd, none).collect()} == {"und"}
    assert ppm.identify(docs.filter("false"), model).count() == 0


def test_code_lengths_match_a_plain_ppm():
    """Against a per-byte escape chain over dictionaries."""
    rnd = random.Random(4)
    train = ["".join(rnd.choice("abc d") for _ in range(400)), "".join(rnd.choice("bcde ") for _ in range(300))]
    lang, code, count = [], [], []
    tables = []
    for i, t in enumerate(train):
        s = b" " * ppm.ORDER + bytes(ppm.fold(t.encode()))
        grams = Counter(s[j:j + ppm.ORDER + 1] for j in range(len(t)))
        tables.append({k: Counter() for k in range(ppm.ORDER + 1)})
        for g, c in grams.items():
            lang.append(i)
            code.append(int.from_bytes(g, "big"))
            count.append(c)
            for k in range(ppm.ORDER + 1):
                tables[i][k][g[ppm.ORDER - k:]] += c
    model = ppm.build(["x", "y"], np.array(lang), np.array(code, np.int64), np.array(count, float))
    alphabet = {b for t in tables for g in t[0] for b in g} | {32}
    often = {g[:-1] for t in tables for g in t[ppm.ORDER]}
    often = {c for c in often if max(sum(v for g, v in t[ppm.ORDER].items() if g[:-1] == c) for t in tables) >= ppm.LEAST}
    known = {k: {g[:-1] for t in tables for g in t[k]} for k in range(ppm.ORDER)} | {ppm.ORDER: often}

    def bits(i, context, sym, k):
        if k < 0:
            return np.log2(len(alphabet) + 1)
        c = context[len(context) - k:]
        if c not in known[k]:
            return bits(i, context, sym, k - 1)
        seen = {g[-1]: v for g, v in tables[i][k].items() if g[:-1] == c}
        n, d = sum(seen.values()), len(seen)
        if sym in seen:
            return -np.log2(seen[sym] / (n + d))
        return (-np.log2(d / (n + d)) if n else 0) + bits(i, context, sym, k - 1)

    text = b"abcd dcba eeb cabba"
    s = b" " * ppm.ORDER + text
    want = [sum(bits(i, s[j:j + ppm.ORDER], s[j + ppm.ORDER], ppm.ORDER) for j in range(len(text))) for i in range(2)]
    assert model.code_lengths([text])[0] == pytest.approx(want, rel=1e-4)


def gnu(name, short, versions):
    return (f"This {short} is free software{versions[0]} you can redistribute it and/or modify\nit under the terms of the GNU {name} General Public License as published by\n"
            f"the Free Software Foundation{versions[1]}\n\nThis {short} is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\n"
            f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\n{name} General Public License for more details.\n\n"
            f"You should have received a copy of the GNU {name} General Public License\nalong with this {short}; if not, see <https://www.gnu.org/licenses/>.\n").replace("GNU  General", "GNU General").replace("\n General", "\nGeneral")


BSD = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
       "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n"
       "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n")
OWN = "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
AS_IS = ('\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\n'
         "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE\n"
         "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL\nDAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR\nSERVICES; LOSS OF USE, DATA, OR PROFITS.\n")
APACHE = ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n'
          "    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\n"
          "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.\n")
ISC = ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n"
       'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND\n'
       "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,\nINDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS\n"
       "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER\nTORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF\nTHIS SOFTWARE.\n")
NOTICES = [
    ("Apache-2.0", APACHE), ("BSD-2-Clause", BSD + AS_IS), ("BSD-3-Clause", BSD + OWN + AS_IS), ("ISC", ISC),
    ("GPL-3.0-or-later", gnu("", "program", (":", ", either version 3 of the License, or\n(at your option) any later version."))),
    ("GPL-2.0-or-later", gnu("", "program", (";", "; either version 2 of the License, or\n(at your option) any later version."))),
    ("LGPL-2.1-or-later", gnu("Lesser", "library", (";", "; either\nversion 2.1 of the License, or (at your option) any later version."))),
    ("LGPL-3.0-or-later", gnu("Lesser", "program", (":", ", either version 3 of the License, or\n(at your option) any later version."))),
    ("AGPL-3.0-or-later", gnu("Affero", "program", (":", ", either version 3 of the License, or\n(at your option) any later version."))),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it.\n\nFor more information, please refer to <https://unlicense.org/>"),
    ("EPL-2.0", "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/\n"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright\nand related and neighboring rights to this software to the public domain\nworldwide. This software is distributed without any warranty.\n\n"
                "You should have received a copy of the CC0 Public Domain Dedication along with\nthis software."),
    *[(name, f"// SPDX-License-Identifier: {i}") for i, name in licenses.SPDX.items()],
]


def test_notices_of_all_licences_are_matched_whole(spark):
    """As they stand, behind comment marks, and with empty tables, repeated rows and clashing names."""
    marked = [(name, "\n".join(" * " + x if x else " *" for x in t.split("\n"))) for name, t in NOTICES if "\n" in t]
    rows = [(i, t, name) for i, (name, t) in enumerate([*NOTICES, *marked])]
    rows += rows[:3]
    docs = spark.createDataFrame([(i, t, [], 1) for i, t, _ in rows], "doc_id long, text string, licenses array<string>, unmatched int")
    got = sorted((r.doc_id, r.licenses, r.unmatched) for r in licenses.scan(docs).collect())
    assert got == sorted((i, [name], 0) for i, _, name in rows)
    assert licenses.scan(docs.filter("false")).count() == 0


def test_the_licence_scan_matches_its_sql(spark, duck):
    import pandas as pd
    from metrilake.llm import queries, sql
    rows = [(i, t) for i, (_, t) in enumerate([*NOTICES, *[("", " * " + x.replace("\n", "\n * ")) for _, x in NOTICES], ("", None), ("", ""), ("", "licence; \n#\n permission. x")])]
    spark.createDataFrame(rows, "doc_id long, text string").createOrReplaceTempView("notices")
    got = licenses.scan(spark.table("notices")).select("doc_id", F.array_join("licenses", ",").alias("licenses"),
                                                      F.concat_ws(",", F.transform("sentence_ids", lambda i: i.cast("string"))).alias("sentence_ids"), "unmatched")
    con = duck.cursor()
    con.execute("CREATE TEMP TABLE documents AS SELECT * FROM (VALUES " + ", ".join(["(?::BIGINT, ?::VARCHAR)"] * len(rows)) + ") t(doc_id, text)", [x for r in rows for x in r])
    want = con.execute(sql.OP8).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies, a lot.</div>
<div id="main-content"><h1>Head &amp; tail</h1><p>First paragraph, long enough to score, with some commas, and <b>bold&nbsp;text</b> that goes on.
<p>Short.<br>Line two <!-- gone --><p>Another paragraph, also long, so that the container wins, doesn&#39;t it?</p>
<div class="ad">Buy now, cheap, cheap</div><ul><li>one item</li><li>two <i>items</i></li></ul><form><p>Your mail</p><input></form></div>
<div class="sidebar"><p>Related things, many of them, listed here, at length, to attract points.</p></div>
<section id="comments"><p>Great post, I agree, truly, with all of it, every word, thanks, bye.</p></section><footer>&copy; us</footer></body></html>"""


def test_main_text_of_a_page():
    assert main_text(PAGE) == ("Head & tail\nFirst paragraph, long enough to score, with some commas, and bold text that goes on.\nShort. Line two\n"
                               "Another paragraph, also long, so that the container wins, doesn't it?\none item\ntwo items")
    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == main_text("<script>x</script>") == ""
    assert main_text("just text & more") == "just text & more"
    assert main_text("<p>cut off at <a href=\"x") == "cut off at"
    long = "<article><p>" + "word, " * 50_000 + "</p></article>"
    assert len(main_text(long)) == 6 * 50_000 - 1
    deep = "<div>" * 300 + "<p>deep text, with a comma, long enough</p>"
    assert main_text(deep) == "deep text, with a comma, long enough"


def test_pages_give_their_article(spark):
    import html as h

    pages = spark.read.parquet(f"{MED}/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(h.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:h1|p|ul|li)>", body))
        assert got[r.page_id].text == "\n".join(x for x in parts if x) and got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", "<p>x")], "page_id long, url string, html string")
    assert sorted(r.text for r in extract(odd).collect()) == ["", "", "x"]
    assert extract(odd.filter("false")).count() == 0


def test_short_parts_beside_long_ones_are_kept():
    par = "a long paragraph, with commas, four of them, all in all, " + "and words " * 24
    line = " ".join(par.split())
    long, short = f"<p>{par}" * 10, f"<p>{par}"
    both = "\n".join([line] * 11)
    for page in (f"<article><section>{long}</section><section>{short}</section></article>",
                 f"<body><div>{long}</div><div>{short}</div></body>",
                 f"<body><div><div><section>{long}</section></div><div><section>{short}</section></div></div></body>"):
        assert main_text(page) == both
    parts = "<h2>Head</h2><ul><li>item</ul><table><tr><td>cell</table><blockquote>said</blockquote><pre>code</pre>"
    links = "<div><a href=a>One</a> <a href=b>Two</a></div><a href=c>Three</a>"
    page = f"<body>{links}<div>{long}</div>{parts}loose <b>text</b> and <a href=d>a link</a></body>"
    assert main_text(page) == "\n".join([line] * 10 + ["Head", "item", "cell", "said", "code", "loose text and a link"])


def test_marks_do_not_cut_article_text():
    line = "A sentence of the text, which is long enough to count, stands here."
    p = f"<p>{line}"
    parts = (f"<h2 id=related-work>Related work</h2>{p}<section id=search-algorithms>{p}</section><section id=discussion><h3 id=form-validation>Forms</h3>{p}</section>"
             f"<ul><li><a href=a>First reference</a><li><a href=b>Second reference</a></ul>")
    want = "\n".join([line] * 4 + ["Related work", line, line, "Forms", line, "First reference", "Second reference"])
    gone = "<div class='box ad'>Buy now</div><div class=comments>Great, thanks.</div>"
    outside = f"<div class=left-sidebar>{p}</div><ul><li><a href=a>Home</a><li><a href=b>All pages</a></ul>"
    for page in (f"<article>{p * 4}{parts}{gone}</article>{outside}", f"<body>{outside}<div>{p * 4}{parts}{gone}</div></body>",
                 f"<body>{outside}<div class='content has-sidebar'>{p * 4}{parts}{gone}</div></body>",
                 f"<body><div id=page class=no-sidebar>{outside}<div>{p * 4}{parts}{gone}</div></div></body>",
                 f"<body><form id=form1><div class=with-sidebar>{outside}<div>{p * 4}{parts}{gone}</div></div></form></body>"):
        assert main_text(page) == want


LINE = "A sentence of the text, which is long enough to count, stands here."
TALK = "I agree with all of it, truly, every single word, thanks and bye."


@pytest.mark.parametrize("junk", ["section class=comments-section", "section id=comments", "div class=post-comments", "div class=ad-slot", "div class=share-buttons",
                                  "div class=newsletter-signup", "div class=cookie-banner", "div class=related-posts", "ol class=commentlist", "div class=copyright",
                                  "div class=cookieBanner", "div id=comments", "article class=comment", "div class='post comments'", "div class=sidebar", "section class='related section'"])
@pytest.mark.parametrize("n,m", [(8, 14), (2, 6), (8, 2)])
def test_marked_parts_go_whatever_their_length(junk, n, m):
    text, talk = f"<h1>Head</h1>{f'<p>{LINE}' * n}", f"<{junk}>{f'<p>{TALK}' * m}</{junk.split()[0]}>"
    want = "\n".join(["Head"] + [LINE] * n)
    for page in (f"<main>{text}{talk}</main>", f"<article>{text}{talk}</article>", f"<body><article>{text}</article>{talk}</body>", f"<body>{talk}<article>{text}</article></body>",
                 f"<body>{talk}<div>{text}</div></body>", f"<body><div class=content>{text}</div>{talk}</body>", f"<main><div>{text}</div>{talk}</main>",
                 f"<body><form><div>{text}</div>{talk}</form></body>"):
        assert main_text(page) == want, page


def test_a_marked_wrapper_around_all_text_stays():
    p = f"<p>{LINE}" * 5
    want = "\n".join([LINE] * 5)
    for page in (f"<div class=modal>{p}</div>", f"<form>{p}</form>", f"<div class=widget><article>{p}</article></div>", f"<div class=page-sidebar><h1>Head</h1>{p}</div><p>All rights are with their owners, as ever."):
        assert want in main_text(page)


@pytest.mark.parametrize("bad", ["<a ", "<a \"", "<a '\"", "<!x ", "</b ", "<", "<b></i>", "<i><table><div></i>", "<b><li></li>", "<li><ul><div><li></li>", "<p><li><b><hr>", "&amp", "<!--", "<b x='>", "<p>x<q>y"])
def test_a_malformed_page_of_a_million_characters_is_read_in_a_pass(bad):
    import time

    at = time.process_time()
    main_text(f"<p>{LINE}</p>" + bad * (1_000_000 // len(bad)))
    main_text(bad * (1_000_000 // len(bad)) + f"> '> \"><p>{LINE}</p>")
    assert time.process_time() - at < 60


def test_tags_that_are_cut_off_or_badly_quoted():
    assert main_text("<p>one <a href='x>two</a> three") == "one two three"
    assert main_text("a < b and c > d <b>e</b>") == "a < b and c > d e"
    assert main_text("<p title='a > b'>text</p>") == "text"


@pytest.mark.parametrize("tag", ["span", "div", "font", "b"])
def test_ten_thousand_unclosed_tags(tag):
    assert main_text(f"<{tag}>" * 10_000 + "<p>deep text, with a comma, long enough</p>tail") == "deep text, with a comma, long enough\ntail"
    assert main_text(f"<{tag}>x" * 10_000).replace("\n", "") == "x" * 10_000


def test_commoner_shared_terms_decide_beyond_the_rarest():
    idf = np.ones(packing.VOCABULARY, np.float32)
    idf[100:200] = 5
    rare = [list(range(100 + 20 * i, 120 + 20 * i)) for i in range(4)]  # 20 terms that no other rest has
    rests = [np.array(r + [*common, 0], np.uint16) for r, common in zip(rare, ([1, 2, 3], [7, 8, 9], [4, 5, 6], [1, 2, 3]))]
    got = packing.fill(rests, idf, 48)
    assert [[p[0] for p in s] for s in got] == [[0, 3], [1, 2]]


def test_large_topics_are_dealt_by_their_second_term(spark):
    rows = [(i, 7, i % 5, bytes(200)) for i in range(50)] + [(50 + i, 7, 9, bytes(200)) for i in range(30)]
    hot = spark.createDataFrame([(u, None, 100, r, t, s, 10, 8) for u, t, s, r in rows],
                                "uid long, key long, n long, rest binary, topic int, second int, first long, parts long").repartition(3)
    shard = {r.uid: r.shard for r in packing._split(hot, 1000).collect()}
    assert set(shard) == set(range(80))
    for second in range(5):
        assert {shard[u] for u, _, s, _ in rows if s == second} == {10 + second}
    assert {shard[u] for u, _, s, _ in rows if s == 9} == {15, 16, 17}
