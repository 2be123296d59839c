"""The other operators, against brute force, exact round trips and held-out labels."""

import hashlib
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.llm import language_id, near_duplicates, pii, quality_classifier, queries, repeats, sentencepiece_scan

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
DOCS = "doc_id long, text string, ids string, id long, n long, h long"


def docs(spark, *rows):
    return spark.createDataFrame([(k, t, "x", 1, 2, 3) for k, t in rows], DOCS)


def word_sets(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(rows):
    s, root = {k: word_sets(t) for k, t in rows}, {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and 3 * len(s[a]) <= 4 * len(s[b]) and 3 * len(s[b]) <= 4 * len(s[a]) and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((k, len(s[k]), find(k)) for k in s)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice("xyz") * rng.randint(1, 4)
    return " ".join(w)


def near_rows(rng):
    out, base = [], ["common words that every text of this kind has in one line"]
    for g in range(12):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 6, 40, 120, 400]))]
        out += [" ".join(w).upper() if k == 1 else edited(rng, w, rng.randrange(0, 1 + len(w) // 18)) for k in range(rng.choice([1, 2, 3, 9]))]
    return [*out, *(f"{base[0]} {' '.join(f'u{i}v{j}' for j in range(i % 9))}" for i in range(40)), "", " ", None, "one", "ONE", "one two", "ünï cödé wörds hére nöw", "ÜNÏ cödé wörds hére nöw"]


@pytest.mark.parametrize(("most", "hot"), [(4096, 256), (3, 256), (4096, 2)])
def test_near_duplicates(spark, most, hot):
    rng = random.Random(5)
    rows = list(enumerate(near_rows(rng)))
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in near_duplicates.near_duplicates(docs(spark, *rows), most=most, hot=hot).collect())
    assert got == plain_components(rows)


@pytest.mark.parametrize("most", [4096, 3])
def test_links(spark, most):
    rows = list(enumerate(near_rows(random.Random(6))))
    s = {k: word_sets(t) for k, t in rows}
    want = {a: sum(a != b and bool(s[a]) and 175 * len(s[a] & s[b]) >= 75 * (len(s[a]) + len(s[b])) for b in s) for a in s}
    random.Random(7).shuffle(rows)
    got = {r["doc_id"]: r["n_links"] for r in near_duplicates.links(docs(spark, *rows, (None, rows[0][1])), most=most).collect()}
    assert got == {**want, None: 0} and max(want.values()) > 3


def test_near_duplicates_edges(spark):
    same = "a b c d e f"
    got = sorted((tuple(r) for r in near_duplicates.near_duplicates(docs(spark, (5, same), (5, same), (2, same), (None, same), (None, "lonely text"))).collect()), key=str)
    assert got == sorted([(5, 2, 2), (5, 2, 2), (2, 2, 2), (None, 2, 2), (None, 1, None)], key=str)
    assert near_duplicates.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    n = np.sort(rng.integers(20, 90, 700))
    tokens = [set(rng.integers(0, 60, int(k // 3)).tolist()) for k in n]
    bits = np.zeros((len(n), 4), np.uint64)
    for i, t in enumerate(tokens):
        for x in t:
            bits[i, (x * 7 % 256) >> 6] |= np.uint64(1) << np.uint64(x * 7 % 64)
    g = near_duplicates.Group(n, np.array([len(t) for t in tokens]), rng.integers(0, 300, len(n)), rng.integers(0, 3, len(n)), bits, False)
    i, j = np.triu_indices(len(n), 1)
    ok = g.fits(i, j)
    a, b = g.pairs()
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(zip(i[ok].tolist(), j[ok].tolist(), strict=True)) and len(a) > 50


def plain_repeats(rows, size=50):
    first, out = {}, []
    for k, t in sorted(rows):
        b, seen = (t or "").encode(), []
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            s = b[i : i + size]
            if first.get(s, k) < k:
                gone[i : i + size] = [True] * size
            seen.append(s)
        for s in seen:
            first.setdefault(s, k)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def test_repeats(spark):
    rng = random.Random(1)
    some = ["".join(rng.choice("abcdefg hijk") for _ in range(rng.choice([49, 50, 51, 60, 75, 130, 400]))) for _ in range(25)]
    texts = ["".join(rng.choice(some)[rng.randrange(20) :] + "é" * rng.randrange(3) for _ in range(rng.randrange(1, 6))) for _ in range(120)] + [None, "", "x" * 300, "x" * 120, "ab" * 200, "ü" * 80, "ü" * 90]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    d = repeats.remove_repeats(docs(spark, *rows))
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in d.collect())
    assert got == plain_repeats(rows)


def test_repeats_shuffle_a_share_of_the_anchors_at_a_time(spark):
    """No stage writes more than six tenths as many rows as there are anchors: what lies on disk at once is a slice of a round."""
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice("abcdefghij ") for _ in range(2000))) for k in range(400)]
    anchors = sum(b.num_rows for b in repeats._anchors(iter([pa.RecordBatch.from_pydict({"doc_id": [k for k, _ in rows], "text": [t for _, t in rows]})])))
    sc = spark.sparkContext
    none, some = sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()
    stages = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(listed.apply, range(listed.size()))}
    listed = sc._jsc.sc().statusStore().stageList(some, False, False, none, some)
    before = max(stages(), default=(-1, 0))
    repeats.remove_repeats(docs(spark, *rows)).count()
    time.sleep(1)  # for the listener
    listed = sc._jsc.sc().statusStore().stageList(some, False, False, none, some)
    wrote = [n for k, n in stages().items() if k > before]
    assert anchors > 20_000 and anchors // 10 < max(wrote) < 0.6 * anchors


def test_repeats_in_long_texts(spark, monkeypatch):
    rng = random.Random(4)
    a, b = ("".join(rng.choice("abcdefghij ") for _ in range(700_000)) for _ in range(2))
    rows = [(1, a), (2, b[:300_000] + a[100_000:650_000] + b[300_000:]), (3, "q" + a)]
    got = {r["doc_id"]: (r["n_removed"], [tuple(s) for s in r["spans"]]) for r in repeats.remove_repeats(docs(spark, *rows)).collect()}
    assert got == {1: (0, []), 2: (550_000, [(300_000, 850_000)]), 3: (700_000, [(1, 700_001)])}


def test_repeats_edges(spark):
    t = "z" * 30 + "y" * 30
    got = sorted(((r["doc_id"], r["n_removed"]) for r in repeats.remove_repeats(docs(spark, (1, t), (1, t), (None, t), (2, t))).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (None, 0), (2, 60)], key=str)
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_repeats_of_many_contexts_and_regular_texts(spark):
    # One passage in very many contexts; texts that defeat sums of powers modulo 2**64 when long; constant texts.
    rng = random.Random(11)
    anchor = "This line stands in every document of the site. All rights"
    rows = [(k, f"{rng.getrandbits(60):x} {anchor if k % 3 else anchor[:30]} {rng.getrandbits(60):x}") for k in range(100_000)]
    morse = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    rows += [(200_000 + k, t) for k, t in enumerate([morse, morse.translate(str.maketrans("ab", "ba")), morse[1000:1100], "a" * 5000, "a" * 49 + "b", "b" * 70, "ab" * 600])]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in repeats.remove_repeats(docs(spark, *rows)).collect())
    assert got == plain_repeats(rows)


def test_repeats_of_names_with_32_equal_bits(spark):
    # One anchor, different contexts whose names agree in their upper 32 bits.
    pairs = [("a passage that very many documents sha422944474821", "a passage that very many documents sha793055076757"), ("a passage that very many documents sha275272269763", "a passage that very many documents sha672054690182")]
    rows = [(k, t) for k, t in enumerate(t for p in pairs for t in p)]
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(docs(spark, *rows, (9, pairs[0][0]))).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: 50}


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail bob [at] example [dot] com now", ["bob [at] example [dot] com"]),
        ("bob.smith at mail dot example dot com", ["bob.smith at mail dot example dot com"]),
        ("call plus four one five five five five one two three four ok", ["plus four one five five five five one two three four"]),
        ("bоb@exаmple.com", ["bоb@exаmple.com"]),
        ("a@b.c_d@e.f", ["a@b.c", "_d@e.f"]),
        ("1.2.3.256 and 1.2.3.4.5", ["1.2.3.4"]),
        ("4111 1111 1111 1111 and 4111 1111 1111 1112", ["4111 1111 1111 1111"]),
        ("b​ob@ex.org", ["b​ob@ex.org", "ob@ex.org"]),
        ("we met at the dot of noon, one two three times", []),
        ("bob at example.com", ["bob at example.com"]),
        ("he looked at home. It was", []),
        (None, []),
        ("", []),
    ],
)
def test_pii(text, found):
    base, spans = pii.find(text)
    assert [text[i:j] for _, i, j in spans] == found and set(base) <= set(spans)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("call plus 49 170 1234567 now", ["plus 49 170 1234567"]),
        ("from +৪৯ ১৭০ ১২৩৪৫৬৭ ok", ["+৪৯ ১৭০ ১২৩৪৫৬৭"]),
        ("host ๑๙๒.๑๖๘.๑.๑ up", ["๑๙๒.๑๖๘.๑.๑"]),
        ("host 𝟏𝟗𝟐.168.1.1 up", ["𝟏𝟗𝟐.168.1.1", "168.1.1"][:1]),
        *[(f"anna at mail dot {top} wrote", [f"anna at mail dot {top}"]) for top in ("ru", "pl", "se", "jp", "in", "br", "biz", "museum")],
        ("bob at web.mail punkt pl", ["bob at web.mail punkt pl"]),
        ("they met at some point in March, at the dot of noon and at one point on", []),
        ("one ſix seven eight", []),
    ],
)
def test_pii_alone_in_a_text(text, found):
    assert [text[i:j] for _, i, j in pii.find(text)[1]] == found


def test_pii_gate_is_that_of_the_rules():
    rng = random.Random(8)
    bits = [" at ", "\tat\t", " dot ", "point", "[", "]", "(at)", "<.>", "one", "two ", "-six", " ", ",", "plus ", "PLUS\t4", "7", "a", "é", "ſ", "ı", "İ", "K", "٣", "৪", "Ａ", "\u200b", "mail", "ru", "com", "."]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        assert pii.suspicious(t) == any([pii.normalise(t)[0] != t, *pii.normalise(t)[3]]), t


def plain_spans(text):
    """The contract's patterns as they are written."""
    luhn = lambda d: sum((x * (1 + i % 2) - 9 * (x * (1 + i % 2) > 9)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    only = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(only(s)) <= 19 and luhn(only(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(only(s)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in kinds.items()}


def test_pii_equals_patterns():
    rng = random.Random(12)
    bits = ["a", "b.c", "@", ".", "-", "_", "d@e.f", "1.2.3.4", "255", "0", "00", "+49", "4111 1111 1111 1111", "4111", " ", "(", ")", "%", "7", "+", "é", "\n"]
    for _ in range(30_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert pii.detect(t) == [(pii.KINDS.index(k), i, j) for k, found in plain_spans(t).items() for i, j in found], t


def test_pii_of_a_megabyte():
    began = time.time()
    for t in ("7" * 1_000_000, "a" * 1_000_000 + "@", "1." * 500_000, "a@" * 500_000, "+1" + "(" * 1_000_000, "0" * 1_000_000 + ".0.0.1", "a.b@c." * 200_000):
        pii.find(t)
    assert time.time() - began < 30
    assert pii.find("0" * 9000 + "1.0.0.255")[0] == [(1, 0, 9009)]


@given
def test_pii_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op1_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        said = [f"{k}:{i}:{j}" for k, found in base.items() for i, j in found]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest() and [r[f"n_{k}"] for k in base] == [len(x) for x in base.values()]
        assert set(said) <= set(r["spans"].split(",")) | {""} and (not said or len(r["spans"].split(",")) >= len(said))


def test_pii_ties():
    base, spans = pii.find("+49151123456@ex.org")
    assert base == spans == [(0, 0, 19), (3, 0, 12)]
    assert pii.masked("+49151123456@ex.org, +49151123456", [*spans, (3, 21, 33)]) == "[EMAIL], [PHONE]"


def test_pii_frames(spark):
    d = docs(spark, (1, "a@b.co x"), (1, "a@b.co x"), (None, None), (2, "no"))
    assert sorted(str(r["text"]) for r in pii.mask_pii(d).collect()) == ["None", "[EMAIL] x", "[EMAIL] x", "no"]
    assert pii.find_pii(d).count() == 4 and pii.find_pii(spark.createDataFrame([], DOCS)).count() == 0


@given
def test_language_id(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    j = queries.op7_language_id(spark, SF).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert j.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    got = language_id.language_id(d.limit(0))
    assert got.count() == 0
    odd = d.select("doc_id", "text", "lang").limit(60).unionByName(spark.createDataFrame([(None, None, None), (-5, "123 !", "en"), (-6, "", None)], "doc_id long, text string, lang string"))
    und = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.language_id(odd).filter("doc_id is null or doc_id < 0").collect()}
    assert und == {None: ("und", 0.0), -5: ("und", 0.0), -6: ("und", 0.0)}


def plain_languages(rows, query):
    """Predictions by counts in plain dictionaries; rows: (lang, text)."""
    letters = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    parts = lambda w, n: [x[i : i + n] for x in [f"<{w}>" if n > 1 else w] for i in range(len(x) - n + 1)]
    seen = {}
    for lang, t in rows:
        for w in letters(t):
            seen.setdefault(lang, {}).setdefault(w, 0)
            seen[lang][w] += 1
    langs = sorted(seen)
    known = set().union(*seen.values())
    word = {x: {w: seen[x].get(w, 0) for w in known} for x in langs}
    gram = {x: {} for x in langs}
    for x in langs:
        for w in known & set(seen[x]):
            for n in (1, 2, 3, 4):
                for g in parts(w, n):
                    gram[x][g] = gram[x].get(g, 0) + 1
    kept = set().union(*gram.values())
    gram = {x: {g: gram[x].get(g, 0) for g in kept} for x in langs}
    log = lambda c, k: math.log(c[k] + 0.5) - math.log(sum(c.values()) + 0.5 * len(c))
    out = []
    for t in query:
        total, n = dict.fromkeys(langs, 0.0), 0
        for w in letters(t or ""):
            hits = [w] if w in known else next((h for k in (4, 3, 2, 1) if (h := [g for g in parts(w, k) if g in kept])), [])
            n += bool(hits)
            for x in langs:
                total[x] += sum(log(word[x] if w in known else gram[x], h) for h in hits) / max(1, len(hits))
        best = max(langs, key=lambda x: total[x])
        share = 1 / sum(math.exp((total[x] - total[best]) / max(1.0, n / 30)) for x in langs)
        out.append((best, share) if letters(t or "") else ("und", 0.0))
    return out


def test_language_id_equals_counts(spark):
    rng = random.Random(3)
    syllables = {"aa": "ka to mi ra", "bb": "sch un der ä", "cc": "qu le au é"}
    said = lambda x, n: " ".join("".join(rng.choice(syllables[x].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(k, x, said(x, rng.randint(1, 20))) for k in range(90) for x in [rng.choice(["aa", "aa", "aa", "bb", "cc"])]]
    query = [said("bb", 3), said("cc", 1) + " zzz", "½ ² Ⅷ", "Ⅷka½to", "xyz", "", None, "KATO", "katoÉ m²ra"]
    d = spark.createDataFrame([(k, t, x) for k, x, t in rows] + [(1000 + k, t, None) for k, t in enumerate(query)], "doc_id long, text string, lang string")
    want = plain_languages([(x, t) for _, x, t in rows], query)
    for layout in (d.coalesce(1), d.repartition(64)):
        m = language_id.fit(layout)
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(layout, m, F.lit(False)).filter("doc_id >= 1000").collect()}
        for k, (lang, score) in enumerate(want):
            assert got[1000 + k] == (lang, pytest.approx(score, rel=1e-9)), query[k]


def test_language_id_frames(spark):
    d = spark.createDataFrame([(1, "le la", "fr", 1), (1, "le la", "fr", 1), (2, "the of", "en", 2), (None, "the of", "en", 3), (3, "both", "en", 4), (3, "both", "fr", 4)], "doc_id long, text string, lang string, score long")
    m = language_id.fit(d)
    got = sorted((str(r["doc_id"]), r["lang_pred"]) for r in language_id.identify(d, m, F.lit(None).cast("boolean")).collect())
    assert got == [("1", "fr"), ("1", "fr"), ("2", "en"), ("3", "en"), ("3", "en"), ("None", "en")]  # a tie goes to the first language


def test_quality_classifier_frames(spark):
    d = docs(spark, *[(k, "good words here " * 9 if k % 2 else "x y " * 3) for k in range(40)], (0, "x y " * 3), (None, None))
    labels = spark.createDataFrame([(k, k % 2, "z") for k in range(40)] + [(0, 0, "z"), (5, None, "z")], "doc_id long, quality int, text string")
    got = quality_classifier.classify(d, labels).collect()
    assert len(got) == 42 and {r["score"] for r in got if r["doc_id"] == 0} == {got[0]["score"]} and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert quality_classifier.classify(d.limit(0), labels).count() == 0


@given
def test_quality_classifier(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    j = quality_classifier.classify(d, labels).join(labels, "doc_id").filter("held_out")
    share = {r[0]: r[1] for r in j.groupBy("quality").agg(F.avg("predicted")).collect()}
    assert share[1] > 0.95 and share[0] < 0.3
    none = quality_classifier.classify(docs(spark, (1, None), (None, "x"), (2, "")), labels.limit(0)).collect()
    assert [r["score"] for r in none] == [0.5] * 3


def test_quality_classifier_in_any_layout(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(30)) + (" !!! ### buy" if k % 3 == 0 else " and so on.")) for k in range(120)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(120)], "doc_id long, quality int, toxic int")
    d = docs(spark, *rows)
    one, many = ({r["doc_id"]: r["score"] for r in quality_classifier.classify(x, labels).collect()} for x in (d.coalesce(1), d.repartition(40)))
    assert one == pytest.approx(many, rel=1e-9)  # (sums of a batch are rounded by its size)


@pytest.fixture(scope="module")
def pieces():
    if not os.path.exists(queries.MODEL):
        pytest.skip("needs a SentencePiece model")
    return sentencepiece_scan.pieces_of(queries.MODEL)


def best_by_trial(p, u):
    """(score, pieces' ends) of the best of all segmentations; of equal ones that whose last piece that differs is the longer."""
    if not u:
        return 0, ()
    found = []
    for i in range(len(u)):
        part = u[i:]
        s = p.scored[part][0] if part in p.scored else p.byte_score if len(part) == 1 else None
        if s is not None:
            before = best_by_trial(p, u[:i])
            found.append((before[0] + s, -i, before[1] + (i,)))
    top = max(found)
    return top[0], top[2]


def scanned(p, t, chunk):
    u = sentencepiece_scan.marked(" " + t)
    parts = [(u[i : i + chunk + p.reach - 1], min(chunk, len(u) - i)) for i in range(0, len(u), chunk)]
    v = sentencepiece_scan.arrived([p.matrix(x, n) for x, n in parts])
    s = sentencepiece_scan.followed([p.enters(x, n, w) for (x, n), w in zip(parts, v, strict=True)])
    return b"".join(p.trace(x, n, j, w) for (x, n), j, w in zip(parts, s, v, strict=True))


def test_search_equals_trial(pieces):
    rng = random.Random(2)
    for _ in range(150):
        t = "".join(rng.choice("aaabthe\n▁ é") for _ in range(rng.randint(1, 11)))
        u = sentencepiece_scan.marked(" " + t)
        best, starts = best_by_trial(pieces, u)
        ends = [*starts[1:], len(u)]
        ids = [x for i, j in zip(starts, ends, strict=True) for x in ([pieces.scored[u[i:j]][1]] if u[i:j] in pieces.scored else pieces.spelt(u[i:j])[1])]
        assert np.frombuffer(pieces.encode(t), np.int32).tolist() == ids and pieces.forward(u, len(u), [0])[len(u)][0] == best


def test_one_encoding_at_any_size(pieces):
    rng = random.Random(1)
    for k in range(300):
        t = "".join(rng.choice("abc  the\n▁éß你\U0010ffff.1") for _ in range(rng.randint(1, 60))) if k % 3 == 0 else "".join(rng.choice("abethino") for _ in range(rng.randint(1, 80))) if k % 3 == 1 else "a" * rng.randint(1, 90)
        whole = pieces.encode(t)
        assert whole == pieces.plain(sentencepiece_scan.marked(" " + t)) and pieces.decode(np.frombuffer(whole, np.int32).tolist()) == t
        for chunk in (1, 3, 20):
            assert scanned(pieces, t, chunk) == whole, (t, chunk)


@given
def test_encoding_of_documents(spark, pieces):
    import sentencepiece

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    small, scan = ({r["doc_id"]: r["ids"] for r in sentencepiece_scan.encode(d, queries.MODEL, giant=g, chunk=700).collect()} for g in (1 << 30, 100))
    assert small == scan
    model = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    for k in list(texts)[:100]:  # ids of greedy merges are read back too
        assert pieces.decode(small[k]) == texts[k] == pieces.decode(model.encode(texts[k]))


def test_encoding_frames(spark, pieces):
    long = "The quick brown fox, " * 2000 + "x" * 30_000 + " ▁ ende"
    rows = [(1, "hello world"), (1, "hello world"), (None, None), (2, ""), (3, long), (4, long), (5, " lead▁ing  ")]
    e = sentencepiece_scan.encode(docs(spark, *rows), queries.MODEL, giant=1000, chunk=777)
    assert e.columns == ["doc_id", "text", "id", "n", "h", "ids"]
    back = sentencepiece_scan.decode(e.withColumnRenamed("text", "source"), queries.MODEL)
    got = sorted(((r["doc_id"], r["source"], r["text"]) for r in back.collect()), key=str)
    assert got == sorted(((k, t, t) for k, t in rows), key=str)
    assert sentencepiece_scan.encode(spark.createDataFrame([], DOCS), queries.MODEL).count() == 0


#: Plain sentences that hold no address, and addresses in disguise.
NO_ADDRESS = [
    "look at example.com for more", "it is available at github.com", "Buy it at amazon.com today", "live at home dot honestly", "they arrive at berlin dot germany", "We met at stackoverflow.com", "read the docs at python.org", "the code is hosted at gitlab.com", "visit us at example.org", "more at bbc.co.uk",
    "see it at nasa.gov", "look at the dot in the corner", "at this point in time", "a talk at some point com", "he stared at every dot in it", "They looked at home. It was late", "working at openai.com since May", "she works at web.de", "download it at kernel.org", "find them here at heise.de",
    "shop online at ikea.com", "at one point or another", "I read about it at lemonde.fr", "the site is down at archive.org", "sign up at example.com", "Meet me at noon. Is it ok", "posted yesterday at reddit.com", "try it out at example.net", "you can apply at jobs.example.com", "we sat at a punkt concert",
    "log in at portal.example.edu", "prices start at 10 dot com", "me @ work . Then we left", "a dog @ home . It barked",
]
ADDRESSES = [
    "anna at gmail dot com", "bob.smith at mail dot example dot com", "anna7 at example.com", "info at example.com", "bob [at] example [dot] com", "bob (at) example.com", "bob&#64;example&#46;com", "anna&commat;example.com", "anna_at_example_dot_com", "user @ example . com",
    "carl at mail dot ru", "dora at yahoo.com", "eva-maria at example dot org", "fritz at posteo.de", "greta arroba example punto es", "hans at web dot de", "ida at gmx dot net", "jan <at> example <dot> org", "kai {at} example {dot} org", "lea@ехample.com",
    "ｍａｘ＠example.com", "nina at uni dot example dot edu", "otto at outlook.com", "paul at t-online.de", "rita at protonmail dot com", "sven(at)example(dot)net", "tom at example dot co dot uk", "uwe arobase orange point fr", "vera at icloud.com", "support at shop.example.com",
]


def test_pii_disguises_and_plain_sentences():
    invented = [t for t in NO_ADDRESS if pii.find(t)[1]]
    missed = [t for t in ADDRESSES if [k for k, i, j in pii.find(t)[1] if (i, j) == (0, len(t))] != [0]]
    assert not invented and not missed, (invented, missed)
    assert all(pii.masked(t, pii.find(t)[1]) == t for t in NO_ADDRESS)


def test_language_id_keeps_every_word(spark):
    """A vocabulary of over 20,000 words a language, each of which decides a text alone."""
    rng = random.Random(5)
    words = [f"{''.join(rng.choice('abcdefghij') for _ in range(9))}" for _ in range(50_000)]
    rows = [(k, " ".join(words[k * 100 : k * 100 + 100]), "aa" if k < 250 else "bb") for k in range(500)]
    asked = [(1000 + k, words[k], None) for k in (0, 24_999, 25_000, 49_999, 7_777)]
    d = spark.createDataFrame(rows + asked, "doc_id long, text string, lang string")
    m = language_id.fit(d)
    assert len(m.words) == len(set(words)) and m.word_logs.shape == (len(m.words), 2)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(d, m, F.lit(False)).filter("doc_id >= 1000").collect()}
    assert got == {1000: "aa", 1000 + 24_999: "aa", 1000 + 25_000: "bb", 1000 + 49_999: "bb", 1000 + 7_777: "aa"}


def plain_index(key, size=32):
    out, h = [0.0] * size, key
    for _ in range(4):
        h = (h * 0x5851F42D4C957F2D + 0x14057B7EF767814F) % 2**64
        out[(h >> 33) % size] += 1 if h >> 63 else -1
    return out


def plain_features(text, context, size=32):
    """Figures of a text, word by word."""
    words = re.findall(r"[^\x01\x20\x09-\x0D]+", text)

    def vector(w):
        b, v = b"\x01" + w.encode() + b"\x01", [0.0] * size
        for i in range(len(b) - 2):
            code = ((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1 % 2**32) >> 17
            v = [x + y for x, y in zip(v, plain_index(code + 1), strict=True)]
        length = max(1e-6, math.sqrt(sum(x * x for x in v)))
        return [x / length + y for x, y in zip(v, context.get(w, [0.0] * size), strict=True)]

    vs, n = [vector(w) for w in words], len(words)
    mean = [sum(v[i] for v in vs) / n for i in range(size)]
    spread = [math.sqrt(max(0.0, sum(v[i] ** 2 for v in vs) / n - mean[i] ** 2)) for i in range(size)]
    pairs = [(a, b) for a in range(n) for b in range(n) if a != b]
    same = sum(words[a] == words[b] for a, b in pairs) / max(1, len(pairs))
    different = [(a, b) for a, b in pairs if words[a] != words[b]]
    alike = sum(sum(x * y for x, y in zip(vs[a], vs[b], strict=True)) for a, b in different) / max(1, len(different))
    most = max(words.count(w) for w in words) / n - 1 / math.sqrt(n)
    return [*(x * math.sqrt(min(n, 30)) for x in mean), *spread, math.log1p(n) / 5, 1 / math.sqrt(n), len(set(words)) / n, math.sqrt(same), alike, most]


def plain_context(texts, least=3, reach=2, size=32):
    """Unit vectors (halved) of the sums of each word's neighbours' index vectors."""
    sums, times = {}, {}
    for t in texts:
        words = re.findall(r"[^\x01\x20\x09-\x0D]+", t)
        for i, w in enumerate(words):
            times[w] = times.get(w, 0) + 1
            near = [words[j] for j in range(max(0, i - reach), min(len(words), i + reach + 1)) if j != i]
            for x in near:
                v = plain_index((zlib.crc32(x.encode()) & 0x7FFF) + (1 << 20))
                sums[w] = [a + b for a, b in zip(sums.get(w, [0.0] * size), v, strict=True)]
    halved = lambda v: [x / max(1e-6, math.sqrt(sum(y * y for y in v))) * 0.5 for x in v]
    return {w: halved(sums.get(w, [0.0] * size)) for w, n in times.items() if n >= least}


def plain_training(x, y, hidden, rounds, seed):
    """The network of quality_classifier.train, number by number: parameters after Adam's steps, and the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    held, rest = order[:cut], order[cut:]
    width = len(x[0])
    mean = [sum(x[i][k] for i in rest) / len(rest) for k in range(width)]
    scale = [math.sqrt(sum((x[i][k] - mean[k]) ** 2 for i in rest) / len(rest)) for k in range(width)]
    z = [[(r[k] - mean[k]) / (scale[k] if scale[k] > 1e-6 else 1.0) for k in range(width)] for r in x]
    w1, w2 = rng.normal(0, 0.1, (width, hidden)).tolist(), rng.normal(0, 0.1, hidden).tolist()
    p = {("w1", k, h): w1[k][h] for k in range(width) for h in range(hidden)} | {("b1", h): 0.0 for h in range(hidden)} | {("w2", h): w2[h] for h in range(hidden)} | {"b2": 0.0}
    m, v, step = dict.fromkeys(p, 0.0), dict.fromkeys(p, 0.0), 0
    hid = lambda i: [math.tanh(sum(z[i][k] * p["w1", k, h] for k in range(width)) + p["b1", h]) for h in range(hidden)]
    logit = lambda i: sum(a * p["w2", h] for h, a in enumerate(hid(i))) + p["b2"]
    softplus = lambda a: max(a, 0.0) + math.log1p(math.exp(-abs(a)))
    loss = lambda t=1.0: sum(softplus(logit(i) / t) - y[i] * logit(i) / t for i in held) / len(held)
    best, kept = math.inf, None
    for _ in range(rounds):
        rng.shuffle(rest)
        for part in np.array_split(rest, max(1, len(rest) // 64)):
            g = dict.fromkeys(p, 0.0)
            for i in part:
                a, d = hid(i), (1 / (1 + math.exp(-logit(i))) - y[i]) / len(part)
                g["b2"] += d
                for h in range(hidden):
                    g["w2", h] += d * a[h]
                    back = d * p["w2", h] * (1 - a[h] ** 2)
                    g["b1", h] += back
                    for k in range(width):
                        g["w1", k, h] += back * z[i][k]
            step += 1
            for key in p:
                if key[0] in ("w1", "w2"):
                    g[key] += 1e-4 * p[key]
            for key in p:
                m[key] += 0.1 * (g[key] - m[key])
                v[key] += 0.001 * (g[key] ** 2 - v[key])
                p[key] -= 0.003 * (m[key] / (1 - 0.9**step)) / (math.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)
        if (now := loss()) < best:
            best, kept = now, dict(p)
    p.update(kept)
    return p, min(np.geomspace(0.25, 8, 60), key=loss)


def test_quality_classifier_equals_plain(spark):
    rng = random.Random(6)
    vocabulary = [*("the of and to in is on it".split()), *(f"wörd{k}" for k in range(40))]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    labels = [k % 3 > 0 for k in range(60)]
    d = docs(spark, *enumerate(texts))
    model = quality_classifier.fit(d, spark.createDataFrame([(k, int(x)) for k, x in enumerate(labels)], "doc_id long, quality int"))
    context = plain_context(texts)
    assert set(model.words) == set(context)
    for w, got in zip(model.words, model.context, strict=True):
        assert got.tolist() == pytest.approx(context[w], abs=1e-6)
    x = [quality_classifier.features(t, model.vectors()) for t in texts]
    for t, got in zip(texts, x, strict=True):
        assert got.tolist() == pytest.approx(plain_features(t, context), abs=2e-5)
    rows, y = np.array(x, np.float64)[:, :5], np.array(labels, np.float64)
    p, temperature = plain_training(rows.tolist(), y.tolist(), 3, 4, 7)
    net = quality_classifier.train(rows, y, 3, 4, 7)
    assert net.w1.tolist() == pytest.approx(np.array([[p["w1", k, h] for h in range(3)] for k in range(5)]), rel=1e-6)
    assert net.w2.tolist() == pytest.approx([p["w2", h] for h in range(3)], rel=1e-6) and net.b2 == pytest.approx(p["b2"], rel=1e-6) and net.temperature == temperature


def test_encoding_with_any_names(spark, pieces):
    kind = "doc_id long, text string, `key` string, `__key` int, `__ids` int, u string, `row` string, i int, n int, parts int"
    rows = [(k, t, "k", 1, 2, "u", "r", 3, 4, 5) for k, t in enumerate(["short", "long " * 500, None, "long " * 500])]
    e = sentencepiece_scan.encode(spark.createDataFrame(rows, kind), queries.MODEL, giant=100, chunk=64)
    got = {r["doc_id"]: r for r in e.collect()}
    assert e.columns == ["doc_id", "text", "key", "__key", "__ids", "u", "row", "i", "n", "parts", "ids"] and got[1]["ids"] == got[3]["ids"] and got[2]["ids"] is None
    assert all(pieces.decode(got[k]["ids"]) == t and tuple(got[k])[2:-1] == ("k", 1, 2, "u", "r", 3, 4, 5) for k, t, *_ in rows if t is not None)


def test_scratch_folders_go(spark):
    from pageloom.llm import store

    def left():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store.shared_dir(spark))
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return {x.getPath().getName() for x in fs.listStatus(path)} if fs.exists(path) else set()

    store.release()
    before = left()
    with store.scratch():
        n = near_duplicates.near_duplicates(docs(spark, (1, "a b c d e f"), (2, "a b c d e f"))).count()
        assert n == 2 and left() > before
    assert left() == before
    assert repeats.remove_repeats(docs(spark, (1, "x" * 60))).count() == 1 and left() > before
    store.release()
    assert left() == before
