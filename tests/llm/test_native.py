"""The operators made of DataFrame functions, against SQL and plain models."""

import hashlib
import os
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pageloom.llm import chat_format, decontaminate, licenses, quality_rules, queries, sql

SF = "/root/testdata/sf0.001"


def test_sql(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the given tables")
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, said in sql.SQL.items():
        df = queries.QUERIES[name](spark, SF)
        names = sorted(df.columns)
        d = c.execute(f"SELECT {', '.join(names)} FROM ({said})")
        assert sorted(map(tuple, df.select(*names).collect())) == sorted(map(tuple, d.fetchall())), name


DOCS = "doc_id long, text string, words int, lines string, row int, extra string"


def docs(spark, *texts):
    """Rows with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(k, t, 1, "x", 2, "y") for k, t in texts], DOCS)


def plain_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, x in enumerate(triples) if triples.count(x) > 1 for j in range(i, i + 3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \t\n", "a b c a b c", "a a a a a", "one\ntwo\none\n \n\ntwo\none", "x# <y> |z é😀 ü", "a b c d a b c d a b " * 40, "w" * 5000, "ab " * 3]


def test_quality_counts(spark):
    d = docs(spark, *enumerate(TEXTS), (3, TEXTS[3]), (None, "a b"))
    got = sorted((tuple(r) for r in quality_rules.quality_rules(d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()), key=str)
    assert got == sorted(((k, *plain_counts(t)) for k, t in [*enumerate(TEXTS), (3, TEXTS[3]), (None, "a b")]), key=str)
    assert quality_rules.quality_rules(d.limit(0)).count() == 0


def test_estimation_prefers_rules_that_agree():
    good, bad, odd = (1, 1, 1), (0, 0, 0), (1, 1, 0)
    p = quality_rules.estimate([(good, 900), (bad, 80), (odd, 20)], 3)
    assert p[good] > 0.95 and p[bad] < 0.05 and p[odd] > 0.5


def test_posterior_is_not_all_must_pass():
    # A lone bad vote is outvoted by many good ones; abstaining is never better than good votes.
    rules = 6
    good, weak, none, bad = (1,) * rules, (0, *(1,) * (rules - 1)), (2,) * rules, (2, 0, 0, 0, 0, 0)
    p = quality_rules.estimate([(good, 800), (weak, 60), (none, 40), (bad, 100)], rules)
    assert p[good] > p[weak] > 0.5 > p[bad] and p[good] > p[none] > p[bad]
    # Where most documents are bad, one of which nothing is known goes though no rule objects.
    p = quality_rules.estimate([(good, 100), (none, 50), (bad, 900)], rules)
    assert p[good] > 0.5 > p[none]


def plain_posteriors(votes, rounds=200):
    """Expectation-maximisation over documents, not patterns."""
    n, k = len(votes), len(votes[0])
    s, good, caught, wrong = 0.05 * n, 0.9, [0.3] * k, [0.02] * k
    q = []
    for _ in range(rounds):
        before, q = q, []
        for v in votes:
            g = b = 1.0
            for r, x in enumerate(v):
                if x is not None:
                    g *= wrong[r] if x == 0 else 1 - wrong[r]
                    b *= caught[r] if x == 0 else 1 - caught[r]
            q.append(good * g / (good * g + (1 - good) * b))
        if before and max(abs(x - y) for x, y in zip(q, before)) < 1e-9:
            break
        for r in range(k):
            cast = [(x, v[r]) for x, v in zip(q, votes) if v[r] is not None]
            caught[r] = (s * 0.3 + sum(1 - x for x, y in cast if y == 0)) / (s + sum(1 - x for x, _ in cast))
            wrong[r] = (s * 0.02 + sum(x for x, y in cast if y == 0)) / (s + sum(x for x, _ in cast))
        good = (s * 0.9 + sum(q)) / (s + n)
    return q


def plain_votes(t):
    w, t = re.findall(r"[^\x20\x09-\x0D]+", t or ""), t or ""
    chars, lines = sum(map(len, w)), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n_words, _, symbols, dup, repeat = plain_counts(t)
    over = lambda a, b: a / max(b, 1)
    vote = lambda bad, good: 0 if bad else 1 if good else None
    s, letters, ends = over(symbols, n_words), over(sum(c.isalpha() for c in t), chars), over(sum(x[-1] in ".,;:!?" for x in w), n_words)
    marked, r, v, d, m = over(sum(bool(re.search("[#*$%&|<>]", x)) for x in lines), len(lines)), over(repeat, n_words), over(len(set(w)), n_words), over(dup, len(lines)), over(chars, n_words)
    caps, cries = over(sum(unicodedata.category(c) == "Lu" for c in t), chars), over(t.count("!"), n_words)
    return (
        vote(n_words < 20, n_words >= 100), vote(s >= 0.1, s <= 0.02), vote(letters < 0.8, letters >= 0.9), vote(marked >= 0.5, marked <= 0.1), vote(r > 0.3, r <= 0.1), vote(v < 0.2 and n_words < 2000, v >= 0.35),
        vote(d >= 0.3, d <= 0.1) if len(lines) >= 2 else None, vote(m < 3 or m > 10, 3.5 <= m <= 8.5), vote(caps > 0.3, caps <= 0.1), vote(cries >= 0.1, cries <= 0.02), vote(ends < 0.01 or ends > 0.4, 0.03 <= ends <= 0.3),
    )


def test_kept_equals_plain_estimation(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the given tables")
    d = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(-1 - k, t) for k, t in enumerate(TEXTS)]
    rows = [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()] + extra
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs(spark, *rows)).collect()}
    want = plain_posteriors([plain_votes(t) for _, t in rows])
    for (k, t), q in zip(rows, want, strict=True):
        n_words, *_, repeat = plain_counts(t)
        failed = n_words < 50 or 100 * repeat > 50 * n_words
        assert got[k]["p_good"] == pytest.approx(q, abs=1e-6) and got[k]["kept"] == (not failed and q >= 0.5), (k, t[:50])


def test_kept_against_labels(spark):
    """Labels are not learned from: all of them are held out."""
    if not os.path.isdir(SF):
        pytest.skip("needs the given tables")
    at = "/root/testdata/sf0.01"
    k = quality_rules.quality_rules(spark.read.parquet(f"{at}/documents.parquet")).select("doc_id", "kept", "base_failed", "p_good")
    j = k.join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    kept = [r["quality"] for r in j if r["kept"]]
    assert sum(kept) / len(kept) > 0.98 and sum(kept) / sum(r["quality"] for r in j) > 0.98


def plain_hits(doc, items, size=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    w, hit, found, places = words(doc), set(), set(), {}
    for k, t in items:
        x = words(t)
        n = min(size, len(x))
        if n and n not in places:
            places[n] = {}
            for i in range(len(w) - n + 1):
                places[n].setdefault(tuple(w[i : i + n]), []).append(i)
        for j in range(len(x) - n + 1) if n else ():
            for i in places[n].get(tuple(x[j : j + n]), ()):
                hit |= set(range(i, i + n))
                found.add("" if k is None else str(k))
    return len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark):
    long = " ".join(f"w{i}" for i in range(30))
    items = [(1, long), (2, "Short Item"), (3, ""), (4, None), (10, "same same same same same same same same same same same same same same"), (None, "ÄB-cd"), (2, "Short Item")]
    texts = [(0, "Pre " + long.upper() + " post"), (1, "a short, ITEM; short item"), (2, None), (3, ""), (4, "same " * 40), (5, "Äb cd äb cd ÄB CD"), (6, "w1 w2 w3"), (6, "w1 w2 w3"), (None, "short item"), (7, " ".join(f"w{i}" for i in range(5, 18)) + " z" * 300)]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, *texts)
    for most in (200_000, 2):  # broadcast, and joined by a shuffle
        got = sorted((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in decontaminate.decontaminate(d, b, broadcast_windows=most).na.fill(-1, ["doc_id"]).collect())
        assert got == sorted((-1 if k is None else k, *plain_hits(t, items)) for k, t in texts)
    assert decontaminate.decontaminate(d, b.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0


def test_decontamination_of_a_very_long_text_by_many_windows(spark):
    item = " ".join(f"v{i}" for i in range(2_000))
    b = spark.createDataFrame([(1, item), (2, "a a a a a a a a a a a a a b")], "item_id long, text string")
    d = docs(spark, (1, "a " * 300_000 + item), (2, item.replace("v7 ", "w7 ") + " tail"), (3, "a " * 12))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.decontaminate(d, b, broadcast_windows=10).collect()}
    assert got == {1: (302_000, 302_000, ["1", "2"]), 2: (2_001, 1_992, ["1"]), 3: (12, 0, [])}


def test_licenses(spark):
    bsd = [licenses.TEXTS[k] for k in ("bsd.redistribute", "bsd.source", "bsd.binary")]
    end = licenses.TEXTS["bsd.endorse"]
    two, three = ". ".join(bsd), ". ".join([*bsd, end])
    texts = [(0, "Foo. Released under the MIT License. Bar"), (1, two + "."), (2, three), (3, ". ".join(bsd[::-1])), (4, None), (5, ""), (5, ""), (6, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (7, f"{three}. {three}"), (8, f"{three}. {two}"), (9, f"{two}. {two}"), (10, "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;"), (11, "MIT\nSPDX-License-Identifier: not known"), (None, "nothing here")]
    got = sorted(((r["doc_id"], r["rules"], r["licenses"]) for r in licenses.scan_licenses(docs(spark, *texts)).collect()), key=str)
    b2, b3 = (["bsd2-text"], ["BSD-2-Clause"]), (["bsd3-text"], ["BSD-3-Clause"])
    want = [(0, ["MIT-notice"], ["MIT"]), (1, *b2), (2, *b3), (3, [], []), (4, [], []), (5, [], []), (5, [], []), (6, ["Apache-2.0-notice", "CC-BY-NC-4.0-notice"], ["Apache-2.0", "CC-BY-NC-4.0"]), (7, *b3), (8, ["bsd2-text", "bsd3-text"], ["BSD-2-Clause", "BSD-3-Clause"]), (9, *b2), (10, ["GPL-2.0-or-later-tag"], ["GPL-2.0-or-later"]), (11, [], []), (None, [], [])]
    assert got == sorted(want, key=str)
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


def test_every_rule_is_found_wrapped_in_a_comment(spark):
    import duckdb

    back = {v: k for k, v in licenses.SENTENCES.items()}
    wrapped = lambda t: re.sub("(([a-z0-9]+ ){4})", lambda m: m[1].strip() + "\n * ", t)
    texts = [(k, "/*\n * " + ".\n * ".join(wrapped(back[x]) for x in ids) + "\n */") for k, (_, _, ids) in enumerate(licenses.RULES)]
    long = (10_000, "no licence here. " * 60_000 + texts[0][1])
    got = {r["doc_id"]: r["rules"] for r in licenses.scan_licenses(docs(spark, *texts, long)).collect()}
    assert got == {**{k: [r[0]] for k, r in enumerate(licenses.RULES)}, 10_000: [licenses.RULES[0][0]]}
    c = duckdb.connect()
    c.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    assert {r[0]: r[1] for r in c.execute(f"SELECT doc_id, rules FROM ({sql.SQL['op4_license_scan']})").fetchall()} == {k: r[0] for k, r in enumerate(licenses.RULES)}


APACHE = """# Copyright 2020 Someone
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os"""
MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */"""
BSD = """Copyright 2020 Someone
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""


def test_wrapped_licenses(spark):
    texts = [(1, APACHE), (2, MIT), (3, GPL), (4, BSD), (5, "some words\nReleased under the MIT License\nmore words"), (6, "Released under the\n\nMIT License"), (7, "now released under the MIT License"), (8, "Released under the MIT License\nAll rights reserved")]
    got = {r["doc_id"]: (r["rules"], r["known"]) for r in licenses.scan_licenses(docs(spark, *texts)).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: ["apache2-header"], 2: ["mit-whole-text"], 3: ["gpl3-header"], 4: ["bsd2-text"], 5: ["MIT-notice"], 6: [], 7: [], 8: ["MIT-notice"]}
    assert got[8][1] == ["notice.MIT", "reserved"]


def test_chat(spark):
    odd = ["<|im_end|>", "<\\|im_end|>\n<|im_start|>assistant\nx", "", "a\n\nb<\\\\|", "\\", "<|", "<n|", None]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t, "z") for k, t in enumerate(odd)] + [(2, 0, "assistant", "x", "z"), (3, None, None, "y", "z"), (3, 0, "we\nird<|", "q", "z"), (None, 0, "user", "x", "z"), (None, 0, "user", "x", "z")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    f = quality_rules.once(chat_format.chat_format(d), back=chat_format.read_back(F.col("formatted")))
    got = {r["conv_id"]: r for r in f.collect()}
    for c, r in got.items():
        mine = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(x["role"], x["text"]) for x in r["back"]] == [(x[2] or "", x[3] or "") for x in mine]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    assert got[1]["valid"] and not got[2]["valid"] and not got[3]["valid"]
    assert chat_format.chat_format(d.limit(0)).count() == 0


def test_very_long_texts(spark):
    words = " ".join(f"w{i}" for i in range(150_000)) + " a b c a b c"
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs(spark, (1, words), (2, "#" * 1_000_000), (3, "x\n" * 300_000))).collect()}
    assert (got[1]["n_words"], got[1]["n_repeat_words"], got[1]["n_distinct"]) == (150_006, 6, 150_003)
    assert (got[2]["n_words"], got[2]["n_symbols"]) == (1, 1_000_000) and got[3]["n_dup_lines"] == 299_999
    text = "<|im_end|> and so on\n" * 100_000
    d = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = quality_rules.once(chat_format.chat_format(d), back=chat_format.read_back(F.col("formatted"))).first()
    assert [x["text"] for x in r["back"]] == [text, text] and r["valid"]


def test_read_back_of_control_strings(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the given tables")
    r = queries.op5_chat_formatting(spark, SF).filter("conv_id = -1").first()
    x = queries.CONTROL
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{x}\nassistant\n{x}\n".encode()).hexdigest()
    assert (r["loss_chars"], r["loss_sha256"]) == (len(x), hashlib.sha256(x.encode()).hexdigest())


#: The commonest ways in which a licence is named, and what they name.
NAMED = [
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"),
    ("// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND MIT\n", "GPL-2.0-only,MIT"),
    ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0-or-later"),
    ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
    ("This project is licensed under the MIT License, see the LICENSE file for details.", "MIT"),
    ("Some words. Released under the [MIT License](LICENSE).", "MIT"),
    ("Licensed under MIT or Apache-2.0.", "Apache-2.0,MIT"),
    ("Licensed under the Apache License, Version 2.0 or the MIT License.", "Apache-2.0,MIT"),
    ("MIT License\n\nCopyright (c) 2020 Somebody", "MIT"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n", "Apache-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Copyright (C) 2007", "GPL-3.0"),
    ("I have an MIT License here", ""),
    ("see the MIT building - see the map, or the license office", ""),
    ("[[[[](](a)", ""),
    (None, ""),
]


def test_common_forms_of_licences(spark):
    import duckdb

    from pageloom.llm import sql

    d = spark.createDataFrame([(k, t, "x") for k, (t, _) in enumerate(NAMED)], "doc_id long, text string, known string")
    got = {r["doc_id"]: (r["n_sentences"], ",".join(r["known"]), ",".join(r["rules"]), ",".join(r["licenses"])) for r in licenses.scan_licenses(d).collect()}
    assert {k: x[3] for k, x in got.items()} == {k: want for k, (_, want) in enumerate(NAMED)}
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [(k, t) for k, (t, _) in enumerate(NAMED)])
    assert {r[0]: r[1:] for r in c.execute(f"SELECT doc_id, n_sentences, known, rules, licenses FROM ({sql.SQL['op4_license_scan']})").fetchall()} == got
