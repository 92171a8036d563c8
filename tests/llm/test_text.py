"""PII, quality, secrets, chat and decontamination against brute force, and their edge cases."""

import hashlib
import pickle
import random
import re
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hyperweave.llm import chat, decontam, pii, quality, secrets
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, `a.b` string, quality string, PII string, hits string, secrets string, matches string"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "x", "q", "p", "h", "s", "m") for k, t in enumerate(texts)], DOCS)


# PII


def brute_pii(text):
    def luhn(ds):
        return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(ds))) % 10 == 0

    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, f"email:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, f"ip:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        ds = re.sub("[^0-9]", "", m[0])
        if 12 <= len(ds) <= 19 and luhn(ds):
            found.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, f"phone:{m.start()}:{m.end()}"))
    return hashlib.sha256(",".join(s for _, _, s in sorted(found)).encode()).hexdigest()


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="aZ0129.@-+ ()%é\n", max_size=40))
def test_pii_base_equals_brute_force(text):
    assert pii.digest(text) == brute_pii(text)


def test_pii_examples():
    text = "mail jo.x@mail.example.com card 4111 1111 1111 1111 +1 (988) 555-2485 at 10.0.0.255 IBAN GB82 WEST 1234 5698 7654 32 ssn 123-45-6789"
    assert [s[0] for s in pii.spans_of(text)] == ["email", "card", "phone", "ip", "iban", "idnum"]
    assert [s[0] for s in pii.spans_of("order 123-45-6789")] == []  # no context word
    assert pii.redact("a jo@x.com b", pii.spans_of("a jo@x.com b")) == "a [email] b"
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")


@pytest.mark.parametrize("after", ["", " BIC XXXX", " EUR 500", " A", " AND MORE CAPITAL WORDS FOLLOW HERE", "."])
@pytest.mark.parametrize("iban", ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32"])
def test_pii_iban_ends_before_the_next_word(iban, after):
    text = "NR 12 TO " + iban + after
    assert [text[a:b] for kind, a, b, _ in pii.spans_of(text) if kind == "iban"] == [iban]


def test_pii_iban_needs_its_end():
    for text in ("GB82WEST12345698765432X", "GB82WEST12345698765432x", "xGB82WEST12345698765432", "GB83WEST12345698765432 BIC"):
        assert not list(pii.ibans(text))
    for text in ("AA11" * 100_000, "AA11 " * 100_000):
        list(pii.ibans(text))


def test_pii_long_texts_are_linear():
    for text in ("a" * 400_000, "1" * 400_000, "a@" * 100_000, "1." * 100_000, "+1" + " " * 300_000, "1-" * 100_000):
        pii.spans_of(text)


def test_pii_frame(spark):
    rows = pii.find_pii(docs(spark, [None, "", "x jo@x.com", "x jo@x.com"])).collect()
    assert [[s["kind"] for s in r["pii_"]] for r in rows] == [[], [], ["email"], ["email"]]
    assert rows[0]["PII"] == "p" and rows[0]["a.b"] == "x"
    assert pii.find_pii(docs(spark, [])).count() == 0


# quality


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(hit)


def brute_repeats(words, least):
    """Covered words and longest repeat, from all pairs of positions."""
    n, reach = len(words), [0] * len(words)
    for a in range(n):
        for b in range(a + 1, n):
            k = 0
            while b + k < n and words[a + k] == words[b + k]:
                k += 1
            reach[a], reach[b] = max(reach[a], k), max(reach[b], k)
    hit = {k for a in range(n) if reach[a] >= least for k in range(a, a + reach[a])}
    return len(hit), max(reach, default=0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab#\n\t é\x85", max_size=60), max_size=4))
def test_quality_equals_brute_force(texts):
    limits = quality.RepetitionLimits(min_repeat=2)
    for text, row in zip(texts, quality.measure([t.encode() for t in texts], limits)):
        assert row[:5] == brute_quality(text)
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert row[6:8] == brute_repeats(words, 2)


def test_quality_verdicts(spark):
    rng = random.Random(5)
    clean = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    line = " ".join(f"v{rng.randrange(10**6)}" for _ in range(40))
    half = clean + " " + line + " x " + line + " y " + line
    texts = [clean, half, " ".join([line] * 9), "few words", None, "", clean]
    rows = quality.quality(docs(spark, texts)).select("doc_id", "quality_.*").orderBy("doc_id").collect()
    assert [r.kept for r in rows] == [True, True, False, False, False, False, True]
    assert rows[1].covered_words == 120 and rows[1].longest_repeat == 40
    kept = quality.good_rows(docs(spark, texts))
    assert kept.columns == docs(spark, []).columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 6]
    assert quality.good_rows(docs(spark, [])).count() == 0


def test_quality_one_very_long_text():
    text = b"same words again " * 60_000
    (row,) = quality.measure([text], quality.RepetitionLimits())
    assert row[0] == 180_000 and row[4] == 180_000 and not row[8]


def test_quality_of_long_texts_by_kasai(monkeypatch):
    rng = random.Random(8)
    texts = ["\n".join(" ".join(rng.choice("abc") * rng.randrange(1, 4) for _ in range(rng.randrange(9))) for _ in range(60)).encode() for _ in range(30)] + ["é\t".encode() * 40, b""]
    limits = quality.RepetitionLimits(min_repeat=4)
    want = quality.measure(texts, limits)
    monkeypatch.setattr(quality, "LEVEL_WORDS", 0)
    monkeypatch.setattr(quality, "CHUNK_BYTES", 20)
    assert quality.measure(texts, limits) == want
    assert [quality.measure([t], limits)[0] for t in texts] == want
    assert all(b"".join(quality.slices(t)) == t for t in texts)


# secrets


ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute_secrets(text):
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(s for _, _, s in sorted(found))


def test_secrets_equal_brute_force(spark):
    rng = random.Random(3)
    bits = ["password", "SECRET", "toKen", "api_key", "apikey", "=", ": ", '"', " ", "abc", "abcdef", "AKIA", "ABCDEFGH01234567", "0123456789abcdef0123456789", "é", "😀", "\n", "ſecret=abcdefgh", "toKen=abcdefgh"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(400)]
    texts += [None, "", "0123456789abcdef01234567 " * 3000, "a" * 200_000]
    rows = secrets.candidates(docs(spark, texts), out="found").select("doc_id", secrets.joined(F.filter("found", lambda s: s["kind"].isin(*secrets.BASE))).alias("s")).collect()
    for r in rows:
        assert r.s == brute_secrets(texts[r.doc_id] or ""), texts[r.doc_id]


def test_secret_owners(spark):
    live, copied, dull = "f3a9c1d7e5b2084697afc3d1", "0a1b2c3d4e5f60718293a4b5", "a" * 24
    rows = [(1, "o1", f"{live} {dull}"), (2, "o1", copied), (3, "o2", copied), (4, None, copied), (5, "o2", None), (6, "o3", ""), (6, "o3", "")]
    df = spark.createDataFrame(rows, "doc_id long, owner string, text string")
    said = {(r.doc_id, tuple(v.verdict for v in r.verdicts)) for r in secrets.judged(df, "text", "owner", "doc_id").collect()}
    assert said == {(1, ("live", "unclear")), (2, ("copied",)), (3, ("copied",)), (4, ("copied",)), (5, ()), (6, ())}
    assert secrets.judged(df, "text", "owner", "doc_id").count() == 7
    assert secrets.judged(df.limit(0), "text", "owner", "doc_id").count() == 0


def test_secret_of_one_owner_in_many_repositories(spark):
    pasted, live = "f3a9c1d7e5b2084697afc3d1", "7e1b9d3f5a0c8264b7d9e1f3"
    rows = [(k, "hot", pasted) for k in range(100)] + [(k, "hot", live) for k in range(200, 299)]
    df = spark.createDataFrame(rows, "doc_id long, owner string, text string")
    said = {r.doc_id: [v.verdict for v in r.verdicts] for r in secrets.judged(df, "text", "owner", "doc_id").collect()}
    assert said == {k: ["copied" if k < 100 else "live"] for k, _, _ in rows}


def test_secret_verdicts_of_a_corpus_equal_brute_force(spark):
    rng = random.Random(9)
    values = ["".join(rng.choice("0123456789abcdef") for _ in range(26)) for _ in range(12)] + ["b" * 30]
    rows = []
    for k in range(400):
        some = [values[min(int(rng.expovariate(0.4)), 12)] for _ in range(rng.randrange(4))]
        rows.append((rng.choice([k, 7, None]), rng.choice(["a", "b", "c", None]) if values[2] in some else "a", " ".join(some)))
    held = {}
    for repository, owner, text in rows:
        for v in text.split():
            owners, repositories = held.setdefault(v, (set(), set()))
            owners.add(owner)
            repositories.add(repository)
    df = spark.createDataFrame([(k, *r, "s", "v", "x") for k, r in enumerate(rows)], "k long, doc_id long, owner string, text string, secrets string, verdicts string, row string")
    for heavy in (1, 3, 4096):  # none, some and most values by the broadcast
        out = secrets.judged(df, "text", "owner", "doc_id", repositories_from=20, heavy_values=heavy)
        assert out.columns == ["k", "doc_id", "owner", "secrets", "verdicts", "row", "secrets_", "verdicts_"]
        for r in out.collect():
            want = []
            for v in rows[r.k][2].split():
                owners, repositories = map(len, held[v])
                verdict = "copied" if owners >= 3 or repositories >= 20 else "live" if owners == 1 and len(set(v)) >= 8 else "unclear"
                want.append((verdict, owners, repositories))
            assert [tuple(x) for x in r["verdicts_"]] == want


def test_secrets_of_long_texts_are_linear(spark):
    texts = ["eyJaaaaaaaa" * 400_000, "eyJaaaaaaaa." * 300_000, "password" * 300_000, "password" + " " * 2_000_000, "AKIA" * 500_000, "ghp_" * 500_000, "xoxb-" * 400_000, "-----BEGIN " * 200_000, "0123456789abcdef" * 100_000 + "g"]
    start = time.time()
    rows = {r.doc_id: r.found for r in secrets.candidates(docs(spark, texts), out="found").select("doc_id", "found").collect()}
    assert time.time() - start < 60
    assert [len(rows[k]) for k in range(len(texts))] == [0, 100_000, 0, 0, 1, 0, 1, 0, 1]
    token = "eyJabcdefgh.eyJabcdefgh.abcdefghi"
    (row,) = secrets.candidates(docs(spark, [f"x {token} y"])).collect()
    assert [(s.kind, s.start, s.end) for s in row["secrets_"]] == [("jwt", 2, 2 + len(token))]


# chat


def test_chat_round_trip(spark):
    nasty = ["<|end|>", "\\<|turn|>", "<", "<<|", "\\", "\\\\", "<\\|", "|>", "", None, "\n", "é<|text|>x"]
    rng = random.Random(1)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", None, "<|end|>", "a\nb"]), "".join(rng.choice([x for x in nasty if x is not None]) for _ in range(rng.randrange(4))) if rng.random() < 0.9 else None, "extra"))
    rows += [(None, 0, "user", "x", "e"), (99, None, "user", "x", "e"), (99, 1, "assistant", "tie b", "e"), (99, 1, "assistant", "tie a", "e"), (99, 1, "assistant", "tie a", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, item string")
    out = chat.format_chats(df)
    got = {r.conv_id: r for r in out.select("*", chat.parsed(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    want = {}
    for conv, turn, role, text, _ in rows:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        assert [(t.role, t.text) for t in got[conv].t] == turns
        assert got[conv].loss == "".join(t for r, t in turns if r == "assistant")
        assert "".join(s.text for s in got[conv].segments) == got[conv].formatted


def test_chat_of_very_long_texts(spark):
    texts = ["<|end|>\\" * 200_000, "x" * 3_000_000, " " * 1_000_000]
    df = spark.createDataFrame([(1, k, "assistant", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    (row,) = chat.format_chats(df).select(chat.parsed(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    assert [t.text for t in row.t] == texts and row.loss == "".join(texts)


@pytest.mark.parametrize("roles, valid", [("ua", True), ("sua", True), ("uata", True), ("au", False), ("uu", False), ("u", False), ("", None), ("usa", False)])
def test_chat_automaton(spark, roles, valid):
    names = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    df = spark.createDataFrame([(1, k, names[r], "x") for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    assert [r.valid for r in chat.format_chats(df).collect()] == ([] if valid is None else [valid])


def test_chats_of_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(none)
    assert out.collect() == [] and out.columns == ["conv_id", "formatted", "segments", "valid", "violations"]


def test_template_rules():
    with pytest.raises(ValueError):
        chat.Template(lead="##", turn="##t", text="##x", end="##e")
    with pytest.raises(ValueError):
        chat.Template(turn="<|a", text="<|ab", end="<|c")


# decontamination


def brute_hits(text, items, window):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    words, hit, ids = split(text), set(), set()
    for item, t in items:
        ws = split(t)
        if ws:
            m = min(window, len(ws))
            wins = {tuple(ws[k : k + m]) for k in range(len(ws) - m + 1)}
            for k in range(len(words) - m + 1):
                if tuple(words[k : k + m]) in wins:
                    hit |= set(range(k, k + m))
                    ids.add(item)
    return len(words), hit, ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="aBb é.", max_size=16), max_size=5), st.text(alphabet="abcé .", max_size=40), st.sampled_from([2, 3, 13]))
def test_decontamination_equals_brute_force(items, text, window):
    listed = [(str(k), t) for k, t in enumerate(items)]
    spans, ids = decontam.Matcher([(i, t.encode()) for i, t in listed], window).spans(decontam.words_of(text.encode()))
    n, hit, want = brute_hits(text, listed, window)
    assert {k for a, b in spans for k in range(a, b)} == hit and ids == want
    assert n == len(decontam.words_of(text.encode()))
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_decontamination_blocks_and_edges(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 3)
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 9)))) for k in range(12)]
    texts = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(40)] + [None, "", items[0][1]]
    bench = spark.createDataFrame([*items, (50, None), (None, "aa bb"), items[0]], "item_id long, text string")
    one = decontam.find_hits(docs(spark, texts), bench, window=4)
    many = decontam.find_hits(docs(spark, texts), bench, window=4, block_chars=40)
    assert one.columns[-1] == "hits_"
    a = {r.doc_id: r["hits_"] for r in one.collect()}
    b = {r.doc_id: r["hits_"] for r in many.collect()}
    assert a == b
    for k, text in enumerate(texts):
        n, hit, ids = brute_hits(text or "", [*((str(i), t) for i, t in items), (None, "aa bb")], 4)
        ids.discard(None)  # an item without an id hits, but has no name to list
        assert (a[k]["n_words"], {p for s in a[k]["spans"] for p in range(s["start"], s["end"])}, set(a[k]["items"])) == (n, hit, ids)
    kept = decontam.clean_rows(docs(spark, texts), bench.where("item_id = 0"))
    assert len(texts) - 1 not in {r.doc_id for r in kept.collect()} and kept.columns == docs(spark, []).columns
    assert decontam.find_hits(docs(spark, texts), bench.limit(0)).where("size(hits_.spans) > 0").count() == 0
    assert decontam.find_hits(docs(spark, []), bench).collect() == []
    assert decontam.find_hits(docs(spark, []), bench, window=4, block_chars=40).collect() == []


@pytest.mark.parametrize("words", ["a", "a b c"])
def test_decontamination_is_linear_on_repeated_words(words):
    n = len(words.split())
    item, text = f"{words} " * (20_000 // n), f"{words} " * (200_000 // n) + "end"
    start = time.time()
    spans, ids = decontam.Matcher([("1", item.encode())]).spans(decontam.words_of(text.encode()))
    assert spans == [(0, 200_000 // n * n)] and ids == {"1"} and time.time() - start < 20


def test_items_without_an_id_hit(spark, tmp_path):
    spark.createDataFrame([(None, "w1 w2 w3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "w0 w1 w2 w3"), (2, "w1 w2")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in decontam.op9_decontamination(spark, str(tmp_path)).collect()}
    assert (rows[1].n_hit, rows[1].n_items, rows[1].contaminated) == (3, 0, True) and rows[2].n_hit == 0


def test_verdicts_with_clashing_names(spark):
    df = docs(spark, ["a b c d", None]).withColumn("n_words", F.lit("mine")).withColumn("contaminated", F.lit("mine"))
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    out = decontam.verdicts(decontam.find_hits(df, bench), "hits_")
    assert out.columns == [*df.columns, "hits_", "n_words_", "n_hit", "n_items", "items_sha256", "contaminated_"]
    assert [(r.doc_id, r.n_words, r["n_words_"], r.n_hit, r["contaminated_"]) for r in out.orderBy("doc_id").collect()] == [(0, "mine", 4, 2, True), (1, "mine", 0, 0, False)]


def test_decontamination_of_long_and_repeated_texts(spark):
    item = " ".join(f"i{k}" for k in range(20))
    long = ("zz " * 400_000 + item + " " + "i3 i4 " * 400_000).encode()
    start = time.time()
    spans, ids = decontam.Matcher([("1", item.encode()), ("2", b"zz zz"), ("3", b"")]).spans(decontam.words_of(long))
    assert spans == [(0, 400_020)] and ids == {"1", "2"} and time.time() - start < 30
    bench = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    rows = decontam.find_hits(docs(spark, [item, item]), bench).collect()
    assert [r["hits_"]["items"] for r in rows] == [["1"], ["1"]]


def test_matcher_is_small():
    rng = random.Random(4)
    items = [(str(k), " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.choice([5, 60]))).encode()) for k in range(3000)]
    size = len(pickle.dumps(decontam.Matcher(items)))
    assert size < 35 * sum(len(t) for _, t in items)


def test_trimmed_rows_equal_brute_force(spark):
    rng = random.Random(12)
    word = lambda: rng.choice("abcd") * rng.randrange(1, 3)
    items = [(k, " ".join(word() for _ in range(rng.randrange(2, 9)))) for k in range(4)]
    texts = [" ".join(word() for _ in range(rng.randrange(80))) for _ in range(60)] + [None, ""]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.trimmed_rows(docs(spark, texts), bench, longer_than=6, most_percent=40, window=5)
    for r in rows.collect():
        if texts[r.doc_id] is None:
            assert r.text is None
            continue
        words = texts[r.doc_id].split()
        n, hit, _ = brute_hits(texts[r.doc_id], [(str(i), t) for i, t in items], 5)
        runs, left = [], []
        for k in sorted(hit):
            runs[-1].append(k) if runs and runs[-1][-1] == k - 1 else runs.append([k])
        cut = {k for run in runs if len(run) >= 6 or 100 * len(hit) >= 40 * n for k in run}
        left = [w for k, w in enumerate(words) if k not in cut]
        assert r.text.split() == left


def test_span_removal():
    text = "Keep this. One two, three four! And this."
    spans, _ = decontam.Matcher([("1", b"one two three four")], 3).spans(decontam.words_of(text.encode()))
    assert decontam.without_spans(text, spans, 3) == "Keep this. ! And this."


def test_trimmed_rows_cut_what_the_verdict_leaves(spark):
    passage = " ".join(f"p{k}" for k in range(90))
    filler = [f"f{k}" for k in range(2000)]
    texts = [" ".join([*filler[:700], passage, *filler[700:]]), None, "", "Nothing here."]
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    df = docs(spark, texts)
    assert decontam.clean_rows(df, bench).count() == 4  # 4.3 % of the words: no verdict
    rows = decontam.trimmed_rows(df, bench)
    assert rows.columns == df.columns
    got = {r.doc_id: r.text for r in rows.collect()}
    assert got[0].split() == filler and [got[k] for k in (1, 2, 3)] == texts[1:]
