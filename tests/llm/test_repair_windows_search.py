"""Conversation repair, window removal and lexical search against brute force."""

import hashlib
import heapq
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from test_queries import TABLES, rows

from pageloom.llm import conversation_repair as repair
from pageloom.llm import lexical_search, queries, sql, window_dedup

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def cheapest(signature):
    """(cost, audit) of the cheapest, then least, edits, by a search of all of them in order of cost."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(signature) and state in ("", "a"):
            return cost, audit
        if (i, state) in seen:
            continue
        seen.add((i, state))
        for role in "ua":
            if role in after[state]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, role))
        if i < len(signature):
            m = signature[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if m != "x":
                more = m.isupper()
                if m.lower() in after[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, m.lower()))
                for role in "ua":
                    if role in after[state]:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, role))


def test_solved_signatures():
    rng = random.Random(3)
    for k in range(3000):
        s = "".join(rng.choice("uasoxUASO") for _ in range(k % 12))
        cost, audit, edits = repair.solve(s)
        assert (cost, audit) == cheapest(s), s
        roles = "".join(r[0] if r else s[p - 1].lower() for e, (r, p) in zip(audit, edits, strict=True) if e != "D")
        assert re.fullmatch("(s?(ua)+)?", roles)
    long = "uxaUAso" * 20_000
    assert len([e for e in repair.solve(long)[1] if e != "I"]) == len(long)


def plain_repair(turns):
    """conv_id -> result, from (conv_id, turn, role, text) rows, by the rules one after the other."""
    text = lambda v: " " if v is None else str(v)
    out, every = {}, {c for c, *_ in turns}
    after = []
    for c, turn, role, said in turns:
        role, said = text(role), text(said)
        fate = zlib.crc32(f"{text(c)}:{text(turn)}".encode()) % 20
        said = "" if fate == 1 else re.sub("[.!?]", "", said) if fate == 2 else said
        after += [(c, turn, "user" if fate == 4 else role, said)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    for c in every:
        own = sorted((x[1:] for x in after if x[0] == c), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        signature, seen, n = "", set(), Counter()
        for _, role, said in own:
            bare = said.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, said) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, said))
            n[fault] += 1
            kind = role[:1] if role[:1] in ("u", "a", "s") else "o"
            signature += "x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        n["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        at = {t for t, *_ in own if t is not None}
        cost, audit = cheapest(signature)
        lines, i, state = [], 0, ""
        for e in audit:
            due = "assistant" if state == "u" else "user"
            role, said = (due, "") if e == "I" else (due if e == "R" else own[i][1], own[i][2])
            i += e != "I"
            if e != "D":
                lines.append(f"{role}:{said}")
                state = role[0]
        out[c] = (max(at) - min(at) + 1 - len(at) if at else 0, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, turns, tmp_path):
    kind = "conv_id long, turn long, role string, text string, key string, pos int, seen int, mark string, fate int, n int, chunk int, initial string"
    at = str(tmp_path / f"t{len(turns)}")
    spark.createDataFrame([(*x, "k", 1, 1, "m", 1, 1, 1, "i") for x in turns], kind).write.parquet(f"{at}/conversations.parquet")
    return {r["conv_id"]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, at).collect()}


def test_repair_equals_plain(spark, tmp_path):
    rng = random.Random(5)
    said = ["Yes.", "No", "", "  \t", "Hello there!", "Who?  ", "a\nb.", None, "é ü."]
    role = ["user", "assistant", "system", "tool", "", None, "User"]
    turns = [(c if c < 95 else None, None if rng.random() < 0.05 else t + (rng.random() < 0.1) * 3, rng.choice(role[: rng.choice([2, 2, 3, 7])]), rng.choice(said)) for c in range(100) for t in range(rng.randint(1, 9))]
    turns += [(200, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(9000)]  # several chunks, and a long conversation
    turns += [(300, t, "user", "same") for t in range(40)] + turns[:7]
    rng.shuffle(turns)
    assert repaired(spark, turns, tmp_path) == plain_repair(turns)
    assert repaired(spark, [], tmp_path) == {}


def plain_windows(docs, size=20):
    """(n_words, n_removed, kept) of (doc_id, text) rows with different doc_ids, by all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    first = {}
    for k in sorted((k for k in range(len(docs)) if docs[k][0] is not None), key=lambda k: docs[k][0]):
        for p in range(len(words[k]) - size + 1):
            first.setdefault(hash(tuple(words[k][p : p + size])), (k, p))
    out = []
    for k, w in enumerate(words):
        gone = [False] * len(w)
        for p in range(len(w) - size + 1 if docs[k][0] is not None else 0):
            if first[hash(tuple(w[p : p + size]))] != (k, p):
                gone[p : p + size] = [True] * size
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((docs[k][0], len(w), sum(gone), " ".join(kept)))
    return out


def window_docs(rng):
    passages = [[f"w{rng.randrange(500)}" for _ in range(rng.choice([19, 20, 21, 45, 300]))] for _ in range(12)]
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    docs = []
    for k in range(150):
        w = own(rng.randrange(40))
        for _ in range(rng.randrange(4)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "Édité"
            w += p[rng.randrange(3) :] + own(rng.randrange(30))
        docs.append((k * 7 % 151, rng.choice([" ", "\n", " \t "]).join(w)))
    docs += [(1000, "a " * 500), (1001, "a b " * 60), (1002, None), (1003, ""), (1004, " \n "), (1005, "A " * 30), (None, docs[0][1]), (1006, docs[0][1]), (1007, "one two")]
    return docs


def removed(spark, docs, **how):
    d = spark.createDataFrame([(*x, 1, 2, 3, []) for x in docs], "doc_id long, text string, row long, start long, a long, whole array<int>")
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in window_dedup.remove_repeats(d, **how).collect()), key=str)


def test_windows_equal_brute_force(spark):
    docs = window_docs(random.Random(1))
    want = sorted(plain_windows(docs), key=str)
    assert removed(spark, docs) == want
    assert removed(spark, docs, most=10) == want  # a full sketch lets more through and loses nothing
    assert removed(spark, []) == []


def test_windows_of_long_texts(spark):
    rng = random.Random(2)
    long = [f"v{rng.randrange(10**8)}" for _ in range(300_000)]
    docs = [(1, " ".join(long)), (2, " ".join(long[100_000:280_000])), (3, " ".join(["x", *long[262_100:262_200], "y", *long[:19]])), (4, "z" * 3_000_000 + " end " + " ".join(long[5:30]))]
    assert removed(spark, docs) == sorted(plain_windows(docs), key=str)


def test_windows_of_repeated_ids(spark):
    p = " ".join(f"p{k}" for k in range(30))
    got = removed(spark, [(5, p), (5, p), (6, p), (4, "a " + p)])
    assert got == sorted([(4, 31, 0, "a " + p), (5, 30, 30, ""), (5, 30, 30, ""), (6, 30, 30, "")], key=str)
    assert removed(spark, [(5, p), (5, p)]) == [(5, 30, 0, p)] * 2
    two = removed(spark, [(5, p + " b"), (5, p)])  # parts of one document
    assert sorted(x[2] for x in two) == [0, 30]


def test_spans(spark):
    p = " ".join(f"p{k}" for k in range(30))
    d = spark.createDataFrame([(1, p), (2, f"a {p} b {p}")], "doc_id long, text string")
    assert {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in window_dedup.remove_repeats(d).collect()} == {1: [], 2: [(1, 31), (32, 62)]}


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, best=50):
    found = [re.findall(TERM, (t or "").translate(LOWER)) for _, t in docs]
    tfs = [Counter(ts) for ts in found]
    n, total, df = sum(map(bool, found)), sum(map(len, found)), Counter(t for c in tfs for t in c)
    out = []
    for item, text in items:
        scored = []
        for k, c in enumerate(tfs):
            m = 100 - 50 + (50 * len(found[k]) * n) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(re.findall(TERM, (text or "").translate(LOWER))) if t in c)
            if s:
                scored.append((-s, docs[k][0] is None, docs[k][0] or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:best])]
    return sorted(out, key=str)


def searched(spark, docs, items, **how):
    d = spark.createDataFrame([(*x, 1, 2, 3, []) for x in docs], "doc_id long, text string, row long, n long, item long, terms array<int>").repartition(5)
    i = spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, item long")
    return sorted((tuple(r) for r in lexical_search.search(d, i, **how).collect()), key=str)


def test_search_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"t{k}" for k in range(60)] + ["Ünï", "你好", "x9"]
    pick = lambda n: [vocabulary[min(len(vocabulary) - 1, int(rng.expovariate(0.12)))] for _ in range(n)]
    docs = [(k // 2 if k > 380 else k, rng.choice([" ", ", ", "_"]).join(pick(rng.randrange(1, 60)))) for k in range(400)]
    docs += [(500, None), (501, ""), (502, "!!!"), (None, "t1 t2 rare"), (503, "rare RARE Rare"), (504, "t0 " * 4000)]
    items = [(k, " ".join(pick(rng.randrange(1, 25)))) for k in range(25)] + [(90, None), (91, ""), (92, "unknown words"), (93, "RARE t3 unknown"), (93, "t5"), (94, "rare")]
    want = plain_search(docs, items, 10)
    assert searched(spark, docs, items, best=10) == want
    assert searched(spark, docs, items, best=10, first=2) == want  # several tiers, with and without proof in the first
    assert searched(spark, docs, items, best=10, first=3, batch=40) == want  # several batches
    assert searched(spark, [], items) == [] == searched(spark, docs, [])


def test_terms_of_long_texts(spark):
    text = ("word, " * 5 + "x" * 50 + "; ") * 150_000
    assert searched(spark, [(1, text), (2, "other")], [(7, "WORD " + "x" * 50)]) == plain_search([(1, text), (2, "other")], [(7, "word " + "x" * 50)])


def test_terms_of_one_first_name():
    v = lexical_search.Vocabulary(*(lexical_search.np.array(a) for a in ([5, 5, 9, 5], [1, 3, 4, 3])))
    assert v.numbers(*(lexical_search.np.array(a) for a in ([5, 5, 5, 9, 9, 10], [3, 1, 2, 4, 5, 1]))).tolist() == [1, 0, -1, 2, -1, -1]


@given
@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_substring_dedup", "op13_lexical_search"])
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    d = c.execute(sql.SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([x[0] for x in d.description], d.fetchall())
