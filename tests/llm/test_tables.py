"""Sharding, URL filters, packing, mixing, near-dedup and the pipeline."""

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from hyperweave.llm import components, mixing, packing, queries, sharding, simhash, urls
from pyspark.sql import functions as F


# sharding


def brute_fill(shards, slots):
    perms = []
    for s in shards:
        first, skip = sharding.number_of("offset-" + s) % slots, sharding.number_of("skip-" + s) % (slots - 1) + 1
        perms.append([(first + j * skip) % slots for j in range(slots)])
    table = {}
    while True:
        for k, perm in enumerate(perms):
            table[next(x for x in perm if x not in table)] = k
            if len(table) == slots:
                return [table[x] for x in range(slots)]


def test_lookup_table():
    names = [f"s{k}" for k in range(7)]
    table = sharding.fill(names, 101)
    assert table == brute_fill(names, 101)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    moved = sum(a != b for a, b in zip(sharding.fill(names, 4093), sharding.fill(names[:-1], 4093)))
    assert moved < 2.2 * 4093 / 7  # about one shard's slots
    twice = Counter(sharding.fill(names, 4093, {"s0": 2}))
    assert 1.8 < twice[0] / twice[1] < 2.2
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad, 101)
    with pytest.raises(ValueError):
        sharding.fill(names, 100)


def test_shard_rows(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (2, None)], "doc_id long, shard string")
    rows = sharding.shard(df, "doc_id").collect()
    assert len(rows) == 4 and rows[0].slot == rows[1].slot and rows[0]["shard"] == "x" and "shard_" in rows[0].asDict()
    assert sharding.shard(df.limit(0), "doc_id").count() == 0
    hot = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("u"))
    assert sharding.shard(hot, "k", spread=64, spread_by="u").select("shard").distinct().count() > 15


def test_shard_of_a_very_long_key(spark):
    df = spark.createDataFrame([("k" * 2_000_000,), ("k" * 2_000_000,), ("",)], "key string")
    rows = sharding.shard(df, "key").collect()
    assert rows[0].slot == rows[1].slot and len(rows) == 3


# URL filters


def test_intervals_and_matches(spark):
    events = [("block", "a.com", "add", 5), ("block", "a.com", "add", 7), ("block", "a.com", "remove", 10), ("block", "a.com", "add", 20), ("block", "b.com", "add", 3), ("block", "b.com", "remove", 3), ("allow", "a.com/x", "add", 0), (None, "a.com", "add", 1), ("block", None, "add", 1)]
    entries = spark.createDataFrame(events, "list string, key string, action string, day int")
    assert {tuple(r) for r in urls.intervals(entries).collect()} == {("block", "a.com", 5, 10), ("block", "a.com", 20, None), ("allow", "a.com/x", 0, None)}
    captures = [(1, "http://a.com/y", 4), (2, "http://A.com./y", 5), (3, "http://u:p@www.a.com:80/y?q#f", 9), (4, "http://a.com", 10), (5, "http://a.com/x/z", 25), (6, None, 5), (7, "http://a.com/", None), (8, "no url", 6), (9, "http://b.com/", 3), (9, "http://b.com/", 3), (None, "http://a.com/", 6)]
    df = spark.createDataFrame(captures, "page_id long, url string, day int")
    out = urls.filter_urls(df, entries)
    rows = {(r.page_id, r.day): (r.lists, r.n_matches, r.match_key, r.blocked) for r in out.collect()}
    assert out.count() == len(captures)
    assert rows[1, 4] == ("", 0, None, False) and rows[2, 5] == ("block", 1, "a.com", True) and rows[3, 9] == ("block", 1, "a.com", True)
    assert rows[4, 10][3] is False and rows[5, 25] == ("allow,block", 2, "a.com/x", False)
    assert not any(rows[k][3] for k in ((6, 5), (7, None), (8, 6), (9, 3), (None, 6)))
    assert urls.filter_urls(df.limit(0), entries).count() == 0 and urls.filter_urls(df, entries.limit(0)).where("blocked").count() == 0


def test_url_keys(spark):
    events = [("block", k, "add", 0) for k in ("h.com/x/y", "[2001:db8::1]", "[::2]/a", "co.uk", "sub.h.org")]
    entries = spark.createDataFrame(events, "list string, key string, action string, day int")
    said = {
        "http://h.com/x/y": "h.com/x/y", "http://h.com/x/y/z?q": "h.com/x/y", "http://h.com/x/yz": None, "http://h.com/x": None, "http://h.com//x/y": None,
        "http://[2001:DB8::1]:80/p": "[2001:db8::1]", "http://u@[::2]/a/b": "[::2]/a", "http://[::2]/": None, "http://a.b.co.uk/": "co.uk",
        "http://x.sub.h.org./": "sub.h.org", "http://h.org/": None, "http://" + "a." * 200_000 + "co.uk/" + "y/" * 200_000: "co.uk", "": None,
    }
    df = spark.createDataFrame([(k, u, 3, "i", "0", "l") for k, u in enumerate(said)], "page_id long, url string, day int, hw_id string, hw_0 string, lists string")
    out = urls.filter_urls(df, entries)
    assert out.columns == ["page_id", "url", "day", "hw_id", "hw_0", "lists", "lists_", "n_matches", "match_key", "blocked"]
    assert {r.url: r.match_key for r in out.collect()} == said


def test_periods_lose_no_match(spark):
    rng = random.Random(4)
    events = [("block", f"h{rng.randrange(5)}.com", rng.choice(["add", "remove"]), rng.randrange(-50, 8000)) for _ in range(200)]
    captures = [(k, f"http://h{rng.randrange(6)}.com/", rng.randrange(-100, 9000)) for k in range(300)]
    entries = spark.createDataFrame(events, "list string, key string, action string, day int")
    got = {r.page_id: r.blocked for r in urls.filter_urls(spark.createDataFrame(captures, "page_id long, url string, day int"), entries).collect()}
    for k, url, day in captures:
        state = {}
        for _, key, action, d in sorted(events, key=lambda e: (e[3], e[2] == "remove")):
            if d <= day:
                state[key] = action == "add"
        assert got[k] == state.get(url[7:-1], False)


# packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60))
def test_best_fit_decreasing(lengths):
    bins, left = [], []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fits = [b for b in range(len(bins)) if left[b] >= lengths[k]]
        if fits:
            b = min(left[b] for b in fits)
            assert b >= lengths[k]
        bins.append(None) if not fits else None
        left.append(0) if not fits else None
        del bins[len(bins) :], left[len(left) :]
        if not fits:
            left[-1] = 30 - lengths[k]
        else:
            left[left.index(b)] -= lengths[k]
    got = packing.best_fit_decreasing(lengths, 30)
    assert sorted(k for b in got for k in b) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in b) <= 30 for b in got)
    assert sorted(30 - sum(lengths[k] for k in b) for b in got) == sorted(left)  # the same loads as plain best fit


def test_packing_round_trip(spark, tmp_path):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab é\n  .,😀") for _ in range(rng.randrange(400))) for _ in range(60)] + ["", "word " * 3000]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(1000, None, "x"), (None, "no id", "x")], "doc_id long, text string, ids string")
    packed = packing.pack(df, seq_len=128, rows=4, block_tokens=2000)
    packing.write_packed(packed, f"file://{tmp_path}/packed")
    rows = spark.read.parquet(f"file://{tmp_path}/packed").collect()
    tokenizer = packing.Tokenizer(Path(packing.default_vocabulary()).read_bytes())
    back = packing.unpacked(rows)
    assert set(back) == set(range(len(texts))) | {1000, None}
    for k, t in enumerate(texts):
        assert tokenizer.encoding.decode(back[k].tolist()) == t
    for r in rows:
        cu, positions = r.cu_seqlens, np.frombuffer(r.positions, "<u2")
        assert cu[0] == 0 and cu[-1] == r.n_rows * 128 == len(positions) and cu == sorted(cu)
        for a, b in zip(cu, cu[1:]):
            assert a == b or a // 128 == (b - 1) // 128
            assert positions[a:b].tolist() == list(range(b - a))
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_of_very_long_texts_and_string_ids(spark):
    texts = {"spaces": " " * 10_000_000, "lines": "x" + "\n\t" * 1_000_000 + " y", "letters": "a" * 1_000_000, "marks": "!" * 1_000_000, "twice": "same"}
    df = spark.createDataFrame([*texts.items(), ("twice", "same")], "doc_id string, text string")
    packed = packing.pack(df)
    assert packed.schema["doc_ids"].dataType.elementType.simpleString() == "string"
    tokenizer = packing.Tokenizer(Path(packing.default_vocabulary()).read_bytes())
    rows = packed.collect()
    assert sum(r.n_tokens for r in rows) == sum(len(tokenizer.encode(t)) // 2 + 1 for t in [*texts.values(), "same"])
    back = packing.unpacked(rows)
    for name in ("spaces", "lines", "letters", "marks"):
        assert tokenizer.encoding.decode(back[name].tolist()) == texts[name]


# mixing


def test_poisson_mix(spark):
    rows = [(k, f"t{k}", "big" if k % 10 < 7 else "small" if k % 10 < 9 else None) for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, weights={"big": 1, "small": 2, None: 1})
    counts = Counter(r.source for r in out.collect())
    for source, share in (("big", 0.25), ("small", 0.5), (None, 0.25)):
        assert abs(counts[source] / 6000 - share) < 0.05
    assert out.columns == df.columns
    assert {r.source for r in mixing.mix(df, weights={"small": 1}).select("source").distinct().collect()} == {"small"}
    assert sorted(r.doc_id for r in mixing.mix(df).collect()) == sorted(r.doc_id for r in mixing.mix(df.repartition(7)).collect())
    assert mixing.mix(df.limit(0)).count() == 0
    clash = df.withColumn("copy", F.lit("c")).withColumn("order_key", F.lit("k"))
    mixed = mixing.mix(clash, order=True)
    assert mixed.columns == [*clash.columns, "copy_", "order_key_"]
    order = [r.doc_id for r in mixing.mix(df).limit(500).collect()]
    assert order != sorted(order)


@pytest.mark.parametrize("rate", [0.01, 0.7, 3.0, 64.0])
def test_poisson_table(spark, rate):
    got = spark.range(1).select(mixing.cumulative(F.lit(rate)).alias("c")).first().c
    exact = np.cumsum([math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) for k in range(len(got))])
    assert np.allclose(got, exact, atol=1e-12) and got[-1] > 1 - 1e-12


def test_large_rates_are_sums(spark):
    df = spark.createDataFrame([(k, "rare" if k < 20 else "x") for k in range(4020)], "doc_id long, source string")
    counts = Counter(r.doc_id for r in mixing.mix(df, weights={"rare": 1}).collect())
    assert len(counts) == 20 and abs(sum(counts.values()) / 4020 - 1) < 0.06 and min(counts.values()) > 130


def test_mix_with_many_weights_and_with_shuffled_rates(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("source"))
    weights = {str(k): 1.0 for k in range(20_000)} | {"hot": 4000.0, None: 1.0}
    rows = lambda **how: sorted(mixing.mix(df, weights=weights, **how).collect())
    assert rows() == rows(broadcast_sources=50)
    long = spark.createDataFrame([(1, "a", "x" * 3_000_000)], "doc_id long, source string, text string")
    assert {len(r.text) for r in mixing.mix(long, scale=20.0).collect()} == {3_000_000}


# near-dedup


def brute_print(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aBc é\n\x85\t", max_size=60))
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode()) == brute_print(text)


def brute_components(fps, radius=4):
    fps = np.array(fps, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        new = np.array([label[near[k]].min() for k in range(len(fps))])
        if (new == label).all():
            return label.tolist()
        label = new


def some_prints(seed=1, n=900):
    rng = np.random.default_rng(seed)
    fps = [int(x) for x in rng.integers(0, 2**63, 200, dtype=np.uint64) * np.uint64(2)]
    for k in range(n):
        x = fps[int(rng.integers(len(fps)))] if k % 2 else fps[0]
        for bit in rng.integers(0, 64, int(rng.integers(1, 7))):
            x ^= 1 << int(bit)
        fps.append(x)
    return sorted(set(fps))


@pytest.mark.parametrize("m, cell_rows", [(6, 8192), (7, 20)])
def test_grid_keeps_every_component(spark, m, cell_rows):
    fps = some_prints()
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    points = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(points, m, 4, cell_rows)).collect()}
    pairs = {(roots.get(x, x), label) for x, label in zip(signed, brute_components(fps))}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_manhattan_is_a_lower_bound():
    fps = np.array(some_prints(7, 300), np.uint64)
    counts = simhash.byte_counts(fps)
    for k in range(50):
        assert (np.abs(counts - counts[k]).sum(axis=1) <= np.bitwise_count(fps ^ fps[k])).all()


def test_components_of_odd_tables(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 9), (None, 4), (5, None), (7, 8), (8, 7)], "u long, v long")
    assert {tuple(r) for r in components.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    chain = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in components.components(chain).collect()} == {0}
    assert components.components(edges.limit(0)).count() == 0


def test_near_copies_and_first_copies(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    near = [*words[:200], "changed", *words[201:]]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (3, " ".join(near)), (7, None), (8, ""), (9, " \n"), (None, " ".join(words)), (None, "alone without id"), (20, "Some OTHER text here now"), (21, "some other text here now")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = {(r.id, r.component) for r in simhash.near_copies(df).collect()}
    assert got == {(5, 3), (3, 3), (7, 7), (8, 7), (9, 7), (None, 3), (None, None), (20, 20), (21, 20)}
    kept = simhash.first_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 7), (False, 20), (True, 0)]
    assert simhash.first_copies(df.limit(0)).count() == 0 and simhash.near_copies(df.limit(0)).count() == 0


def test_first_copies_of_a_repeated_id(spark):
    rng = random.Random(9)
    long = lambda: [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    one, two, three, four = long(), long(), long(), long()
    rows = [(1, one), (2, [*one[:-1], "changed"]), (1, two), (1, two), (1, three), (1, [*three[:-1], "changed"]), (6, four), (5, four), (6, two)]
    df = spark.createDataFrame([(k, " ".join(t), "x") for k, t in rows], "doc_id long, text string, fp string")
    kept = simhash.first_copies(df)
    assert all((simhash.fingerprint(" ".join(t).encode()) ^ simhash.fingerprint(" ".join([*t[:-1], "changed"]).encode())).bit_count() <= simhash.RADIUS for t in (one, three))
    firsts = {" ".join(t)[:20]: n for n, t in enumerate((one, two, three, four), 1)}
    assert kept.columns == df.columns
    assert sorted((r.doc_id, firsts[r.text[:20]]) for r in kept.collect()) == [(1, 1), (1, 2), (1, 3), (5, 4)]


# the pipeline


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import re

    from hyperweave.llm import quality

    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    rows = [(k, text(rng.randrange(60, 200)), "en", f"src{k % 3}") for k in range(120)]
    items = [(k, text(30)) for k in range(5)]
    rows += [(200 + k, rows[k][1], "en", "src0") for k in range(20)]  # copies
    rows += [(300, text(20), "en", "src1"), (301, " ".join([text(10)] * 12), "de", "src1"), (302, None, None, None)]
    rows += [(400 + k, text(60) + " " + items[k][1] + " " + text(60), "en", "src2") for k in range(5)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.columns == [*docs.columns, "slot", "shard", "shard_name"]
    # brute force: rules, then copies, then benchmark windows, then the draw of each document
    good = [r for r in rows if r[1] and quality.measure([r[1].encode()], quality.RepetitionLimits())[0][8]]
    labels = brute_components([brute_print(r[1]) for r in good])
    first = {}
    for r, c in zip(good, labels):
        first[c] = min(first.get(c, r), r)
    windows = {tuple(ws[k : k + 13]) for _, t in items for ws in [re.findall(r"\w+", t.lower())] for k in range(18)}
    clean = []
    for r in first.values():
        ws = re.findall(r"\w+", r[1].lower())
        hit = {k + j for k in range(len(ws) - 12) if tuple(ws[k : k + 13]) in windows for j in range(13)}
        if not hit or 20 * len(hit) < len(ws):
            clean.append(r)
    assert {r[0] for r in clean} == set(range(120))
    sizes = Counter(r[3] for r in clean)
    weight = {s: math.sqrt(n) for s, n in sizes.items()}
    want = Counter()
    for r in clean:
        rate = weight[r[3]] / sum(weight.values()) * len(clean) / sizes[r[3]]
        u, k, p = sharding.number_of(f"0:{r[0]}:1") / 2**60, 0, math.exp(-rate)
        total = p
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        want[r[0]] = k
    got = Counter(r.doc_id for r in out.collect())
    assert got == Counter({k: n for k, n in want.items() if n})
    table = sharding.fill([f"shard-{k:04d}" for k in range(sharding.SHARDS)])
    for r in out.collect():
        assert r["shard"] == table[sharding.number_of(str(r.doc_id)) % sharding.SLOTS]


def test_stages_of_empty_tables(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rng = random.Random(3)
    some = [(k, " ".join(f"w{rng.randrange(10**5)}" for _ in range(80)), "en", "src", 1) for k in range(4)]
    for name, rows, items in (("none", [], [(1, "a b c")]), ("items", some, [])):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, f"{tmp_path}/{name}")
            assert out.columns[: len(docs.columns)] == docs.columns
            assert out.count() == len(rows) if k < 3 else rows or not out.count()
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").columns[:5] == docs.columns


def test_queries_have_the_agreed_names():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in queries.QUERIES and set(queries.SQL) <= set(queries.QUERIES)
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
