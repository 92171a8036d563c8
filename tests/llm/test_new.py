"""Conversation tries, license scans and periodic runs against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hyperweave.llm import licenses, periods, queries, tries
from pyspark.sql import functions as F


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Periodic runs


def brute_runs(ws, least=6, exponent=4):
    out = []
    for q in range(1, len(ws) // exponent + 1):
        i = 0
        while i + q < len(ws):
            if ws[i] != ws[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(ws) and ws[i] == ws[i + q]:
                i += 1
            seg = ws[s : i + q]
            if len(seg) >= max(least, exponent * q) and not any(all(seg[x] == seg[x + p] for x in range(len(seg) - p)) for p in range(1, q)):
                out.append((s, len(seg), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(ws, runs):
    return " ".join(w for i, w in enumerate(ws) if not any(s + q <= i < s + n for s, n, q in runs))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=40), st.integers(1, 9), st.integers(0, 40)), max_size=4), st.integers(2, 9), st.integers(2, 5))
def test_runs_equal_brute_force(parts, least, exponent):
    texts = [list(a) + [str(i % p) for i in range(n)] + list(a[:5]) for a, p, n in parts]
    found = periods.measure([" ".join(ws).encode() for ws in texts], least, exponent)
    for ws, (runs, left) in zip(texts, found):
        want = brute_runs(ws, least, exponent)
        assert [tuple(r) for r in runs.tolist()] == want
        assert left.decode() == brute_collapsed(ws, want)


def test_runs_in_long_texts():
    ws = ["a"] * 100_000 + ["b"] + ["x", "y", "z"] * 30_000
    (runs, left), = periods.measure([" ".join(ws).encode()])
    assert runs.tolist() == [[0, 100_000, 1], [100_001, 90_000, 3]] and left == b"a b x y z"
    assert periods.measure([b"w" * 5_000_000])[0][1] == b"w" * 5_000_000
    with pytest.raises(ValueError):
        periods.maximal_runs(periods.np.zeros(9, int), 9, 6, 1)


def test_find_runs_handles_odd_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "y"), (None, "a a a a a a", "z"), (3, " \t\né é é é é é é\x0bé b", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Periodic string")
    out = periods.find_runs(df)
    assert out.columns == ["doc_id", "text", "Periodic", "periodic_"]
    got = {(r.doc_id, r.text): ([tuple(x) for x in r.periodic_.runs], r.periodic_.collapsed) for r in out.collect()}
    assert out.count() == 5 and got[(1, None)] == ([], "") and got[(2, "")] == ([], "")
    assert got[(None, "a a a a a a")] == ([(0, 6, 1)], "a") and got[rows[4][:2]] == ([(0, 8, 1)], "é b")
    assert periods.find_runs(df.limit(0)).collect() == []


def brute_op13(key, text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(ws), zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(ws)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(runs), *told, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(brute_collapsed(ws, runs)))


def test_op13_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["a", "b", "é", "the"]) for _ in range(rng.randrange(60)))) for k in range(300)]
    rows += [(None, "a " * 9), (5, None), (6, ""), (7, "x y " * 40), (7, "x y " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periods.op13_periodic_runs(spark, str(tmp_path)).collect()]
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=order) == sorted((brute_op13(*r) for r in rows), key=order)
    assert any(r[1] for r in got)


# License scans


def brute_scan(text, percent=licenses.COVERAGE_PERCENT):
    ws = [w for w in re.split(licenses.GAP, "".join(c.lower() if c in licenses.UPPER else c for c in text or "")) if w]
    base = [(i, label) for p, label in licenses.PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    hits = set()
    for n in licenses.notices():
        for at in range(-len(n.words), len(ws)):
            same = [0 <= at + p < len(ws) and ws[at + p] == w for p, w in enumerate(n.words)]
            if 100 * sum(same) >= percent * len(same) and all(s or not m for s, m in zip(same, n.must)):
                hits.add((n.label, at, sum(same) / len(same)))
    return len(ws), sorted(base), hits


LICENSE_TEXTS = [
    None,
    "",
    "ALL rights\nreserved. all rights reserved",
    "Licensed under CC BY-NC 4.0.",
    "Licenced under CC BY-NC 4.0. cc by cc by",
    "word " * 50 + "This work is licensed under the GNU General Public License, version 3." + " tail" * 9,
    "this work was licensed under some GNU General Public License version 3",
    "is licensed under the GNU General Public License, version 2",
    "Released under the MIT License. Released under the MIT License.",
    "Released under the MITK License",
    "Licensed under the Apache License, Version 2.0. under under under",
    "(c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation",
    "Permission is hereby granted, free of charge, to any person getting a copy of the software and associated documentation files",
    "éall rights reserved all rights  reserved",
]


def test_scan_equals_brute_force(spark):
    rows = [(k, t, "c") for k, t in enumerate(LICENSE_TEXTS)] + [(None, LICENSE_TEXTS[5], "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, LICENSES string")
    out = licenses.scan(df)
    assert out.columns == ["doc_id", "text", "LICENSES", "licenses_"]
    seen = 0
    for r in out.collect():
        n, base, hits = brute_scan(r.text)
        found = r.licenses_
        assert (found.n_words, [(p.at, p.label) for p in found.phrases]) == (n, base)
        assert {(h.label, h.at, h.coverage) for h in found.templates} == hits and len(found.templates) == len(hits)
        seen += len(hits)
    assert seen > 8
    assert licenses.scan(df.limit(0)).collect() == []


def test_scan_long_texts_and_words_that_only_some_hold(spark):
    rng, vocabulary = random.Random(5), sorted({w for n in licenses.notices() for w in n.words})
    texts = [" ".join(rng.choice(vocabulary) for _ in range(3000)) for _ in range(4)]
    for k, t in enumerate(texts):  # notices with up to a fifth of the words changed
        for n in licenses.notices():
            ws = list(n.words)
            for p in rng.sample(range(len(ws)), len(ws) // 5):
                ws[p] = rng.choice(vocabulary)
            texts[k] += " " + " ".join(ws)
    for r in licenses.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        assert {(h.label, h.at, h.coverage) for h in r.licenses.templates} == brute_scan(r.text)[2]


def test_templates_are_checked():
    assert licenses.Notice.of("x", "One [Two-Three] four").must == (False, True, True, False)
    with pytest.raises(ValueError):
        licenses.Notice.of("x", " . ")
    with pytest.raises(ValueError):
        licenses.notices([("x", "a " * (licenses.MOST_WORDS + 1))])


# Conversation tries


def brute_trie(seqs):
    """``seqs``: conversation id -> list of (role, text)."""
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        leaves = sum(not any(len(x) == len(p) + 1 and x[:-1] == p for x in members) for p in below)
        children = sum(len(p) == len(path) + 1 for p in below)
        ends = sorted(c for c in cs if len(seqs[c]) == len(path))
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), children, leaves, saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=lambda r: r[:2])


def ordered(rows):
    seqs = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        seqs.setdefault(c, []).append((role or "", text or ""))
    return seqs


def brute_rebuilt(seqs):
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in seqs}
    return {c: seqs.get(c - c % 5, [])[: h[c]] + seqs[c][h[c] :] for c in seqs}


def chat_rows(rng, convs, words="ab"):
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([*words, "é", "", None])) for c in convs for t in range(rng.randrange(1, 7))]
    return rows + [(3, None, "user", "first"), (3, None, "user", "first"), (None, 0, "user", "lost"), (4, 1, "user", "tie"), (4, 1, "user", "a tie")]


CHATS = "conv_id long, turn long, role string, text string"


def test_trie_equals_brute_force(spark):
    rows = chat_rows(random.Random(6), range(60))
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], CHATS + ", depth long, key string")
    got = sorted(tuple(r) for r in tries.prefix_trie(df).collect())
    assert got == brute_trie(ordered(rows))


def test_trie_of_one_long_and_many_equal_conversations(spark):
    rows = [(1, t, "user", f"{t}") for t in range(300)] + [(c, t, "user", f"{t}") for c in range(2, 60) for t in range(2)] + [(2, 9, "user", "own")]
    df = spark.createDataFrame(rows, CHATS)
    turns = tries.turn_rows(df)
    convs = turns.groupBy("conv").agg(F.count("*").alias("n"))
    got = sorted(tuple(r) for r in tries.trie(turns.select("conv", (F.col("at") + 1).alias("depth"), "digest", "bytes"), convs, piece=4).collect())
    assert got == brute_trie(ordered(rows))
    assert tries.prefix_trie(df.limit(0)).collect() == []


def test_op11_equals_brute_force_and_sql(spark, tmp_path):
    rows = chat_rows(random.Random(7), [*range(3, 60), 100, 104, 1001, 1002, -7])
    spark.createDataFrame(rows, CHATS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in tries.op11_prefix_trie(spark, str(tmp_path)).collect())
    seqs = {c: s for c, s in ordered(rows).items() if c >= 0}
    want = [r for r in brute_trie({**brute_rebuilt(seqs), -7: got_seq(rows)})]
    assert got == want
    assert any(not s for s in brute_rebuilt(seqs).values())
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.execute(queries.SQL["op11_prefix_trie"]).fetchall()) == got


def got_seq(rows):
    """-7: its base, -5 (division truncates), is absent, so its own turns after the first h are left."""
    return ordered(rows)[-7][zlib.crc32(b"-7") % 9 :]
