"""Sharding, quality rules, mixing, near-duplicates and toxicity against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voxloom.llm import mixing, quality, queries, sharding, simhash, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(x):
    return float(f"{x:.9g}") if isinstance(x, float) else x


def same_as_sql(df, sql, **views):
    con = duckdb.connect()
    for name, rows in views.items():
        con.register(name, rows)
    said = con.execute(sql)
    names = [d[0] for d in said.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple(map(repr, r))
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)
    assert got == sorted((tuple(map(plain, r)) for r in said.fetchall()), key=key)


# ---- sharding --------------------------------------------------------------------------------------


def test_shards(spark, tables, messy):
    for docs in (tables("documents"), messy):
        rows = sharding.shard_documents(docs, buckets=16).collect()
        texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            assert r["law"] == "key" and 0 <= r["shard"] <= 7 and r["grown_shard"] in (r["shard"], 8)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        by_id = defaultdict(set)
        for r in rows:
            by_id[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert all(len(s) == 1 for s in by_id.values())
    assert sharding.shard_documents(messy.limit(0)).count() == 0


def test_shards_follow_weights(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = Counter(r["shard"] for r in sharding.shard_documents(rows, weights=[1, 3, 0, 4]).select("shard").collect())
    assert 2 not in got and abs(got[1] / got[0] - 3) < 0.4 and abs(got[3] / got[0] - 4) < 0.5
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit("a"), [0.0])


def test_shards_as_files(spark, messy, tmp_path):
    sharding.write_shards(messy, str(tmp_path / "s"), files_per_shard=2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == messy.count()


# ---- quality ---------------------------------------------------------------------------------------


def test_quality_sql(spark, messy):
    small = messy.filter(F.length("text").isNull() | (F.length("text") < 1000))
    rows = quality.apply_policy(quality.ledger(small))
    df = rows.select("doc_id", *quality.MEASURES[:5], (~quality.passes("base-1")).alias("base_failed"), "kept", "fail_bits")
    same_as_sql(df, queries.ORACLE["op5_quality"], documents=small.select("doc_id", "text").toPandas())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    same_as_sql(queries.op5_quality(spark, SF), queries.ORACLE["op5_quality"], documents=con.execute("SELECT * FROM documents").df())


def brute_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})


def test_measures():
    text = b"a b c a b c x\n\n a b\n a b\n* #"
    got = dict(zip(quality.MEASURES, quality.measure(text), strict=True))
    assert got == {"n_words": 13, "word_chars": 13, "n_symbols": 2, "n_dup_lines": 1, "n_repeat_words": brute_repeats(text.split()), "n_lines": 4}
    assert quality.measure(b"") == (0, 0, 0, 0, 0, 0)


def test_ledger_policies_and_ablations(spark, tables, messy):
    rows = quality.ledger(tables("documents")).cache()
    bits = [r["fail_bits"] for r in rows.collect()]
    rules = quality.POLICIES["web-1"]
    got = {r["rule"]: r for r in quality.ablations(rows).collect()}
    for rule in rules:
        b, all_bits = quality.bit(rule), quality.mask(rules)
        assert got[rule]["n_failed"] == sum(bool(x & b) for x in bits) and got[rule]["n_failed_alone"] == sum(x & all_bits == b for x in bits)
        assert got[rule]["n_kept_without"] == sum(x & (all_bits - b) == 0 for x in bits)
    kept = quality.filter_documents(messy)
    assert kept.columns == messy.columns and {r["doc_id"] for r in kept.collect()} <= {5}
    assert quality.ledger(messy.limit(0)).count() == 0


def test_clean_documents_stay(spark, tables):
    rows = quality.apply_policy(quality.ledger(tables("documents"))).join(tables("labels"), "doc_id")
    good, bad = rows.filter("quality = 1 AND n_words >= 50").agg(F.avg(F.col("kept").cast("int"))).first()[0], rows.filter("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.98 and bad < 0.05


# ---- mixing ----------------------------------------------------------------------------------------


def test_mixing_sql(spark, messy):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same_as_sql(queries.op10_mixing(spark, SF), queries.ORACLE["op10_mixing"], documents=docs.toPandas())
    own = messy.select("doc_id", "text", "source")
    same_as_sql(mixing.mix_by_source(messy), queries.ORACLE["op10_mixing"], documents=own.toPandas().astype({"doc_id": "Int64"}))
    assert mixing.mix_by_source(messy.limit(0)).count() == 0


def test_targets_share_the_excess():
    got = mixing.targets({"a": 10, "b": 1000, None: 100}, (5, 2, 1))
    total = 1.5 * 1110
    assert got["a"] == 20 and got[None] == 200 or sum(got.values()) == pytest.approx(total)
    assert all(got[s] <= 2 * n + 1e-9 for s, n in {"a": 10, "b": 1000, None: 100}.items())


def test_flow_is_of_least_cost():
    patterns = {("a",): 10, ("a", "b"): 6, ("b",): 3}
    flows = mixing.allocate(patterns, {"a": 14, "b": 9})
    assert sum(f.get("a", 0) for f in flows.values()) == 14 and sum(f.get("b", 0) for f in flows.values()) == 9
    taken = {p: sum(f.values()) for p, f in flows.items()}
    assert all(taken[p] <= 2 * n for p, n in patterns.items())
    assert sum(max(0, taken[p] - n) for p, n in patterns.items()) == 4  # 19 words once, 4 of them again


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), ["x", "y"] if i % 3 == 0 else ["x"] if i % 3 == 1 else None) for i in range(90)], "doc_id long, text string, members array<string>")
    rows, figures = mixing.mix(docs, F.col("members"), share=0.5)
    got = rows.collect()
    assert len(got) == 90 and all(r["taken"] <= 2 * r["size"] for r in got) and all(r["taken"] == 0 for r in got if not r["pattern"])
    assert sum(r["taken"] for r in got) == sum(f["taken"] for f in figures.values())
    assert all(abs(f["taken"] - f["target"]) <= 1 for f in figures.values())


def test_mixed_texts(spark, messy):
    count = lambda t: len(WORD.findall(t or ""))
    by_source = defaultdict(int)
    out = mixing.mixed_documents(messy)
    assert out.columns == messy.columns
    for r in out.collect():
        by_source[r["source"]] += count(r["text"])
    want = defaultdict(int)
    rows = mixing.mix_by_source(messy).groupBy("source_size").agg(F.sum("taken").alias("t")).collect()
    want = sorted(r["t"] for r in rows)
    assert sorted(by_source.values()) == [w for w in want if w]


# ---- near-duplicates -------------------------------------------------------------------------------


def fingerprint(text):
    words = [w.translate({k: k + 32 for k in range(65, 91)}) for w in WORD.findall(text or "")]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, k=2):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= k:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(fps)):
        r = find(i)
        low[r] = min((x for x in (low.get(r), ids[i]) if x is not None), default=None)
    return [low[find(i)] for i in range(len(fps))]


def test_simhash_tables(spark, tables, messy):
    for docs in (tables("documents"), messy):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        fps = [fingerprint(t) for _, t in rows]
        want = Counter(zip((d for d, _ in rows), (f"{f:016x}" for f in fps), brute_components([d for d, _ in rows], fps), strict=True))
        assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(messy.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 16])
def test_links_lose_nothing(spark, monkeypatch, block):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12)
    fps = {int(b) ^ int(np.bitwise_or.reduce(1 << rng.integers(0, 63, rng.integers(0, 4)), initial=0)) for b in base for _ in range(40)}
    monkeypatch.setattr(simhash, "BLOCK", block)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    n, both = simhash.bit_counts(df)
    ids = sorted(fps)
    want = dict(zip(ids, brute_components(ids, ids), strict=True))
    for parts in (simhash.plan(n, both, 2), [(g, t) for g, t in zip(simhash.group_bits(n, both, 2), (1, 0), strict=True)]):
        got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df.select(F.col("fp").alias("node"), "fp"), parts, 2)).collect()}
        assert {f: got.get(f, f) for f in ids} == want


def test_thresholds_sum_up():
    n, both = 1000, np.full((64, 64), 250) + np.eye(64, dtype=int) * 250
    for k in (1, 2, 3):
        parts = simhash.plan(n, both, k)
        bits = sorted(b for g, _ in parts for b in g)
        assert len(set(bits)) == len(bits) and sum(t + 1 for _, t in parts) == k + 1
    # more fingerprints make wider keys worth their probes
    assert max(t for _, t in simhash.plan(10**12, both * 10**9, 2)) >= 1


def similar(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return not (sets[0] | sets[1]) or len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])


@pytest.mark.parametrize("group", [3, 256])
def test_deduplicate_near_copies(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(4)
    texts, n = [], 120
    for _ in range(8):
        words = [f"w{i}" for i in rng.integers(0, 5000, n)]
        for copies in range(12):
            w = list(words)
            for at in rng.choice(n, rng.integers(0, 3), replace=False):
                w[at] = f"e{rng.integers(0, 999)}"
            texts.append(" ".join(w))
    texts += [" ".join(f"c{i}" for i in rng.integers(0, 5000, n)) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.deduplicate(df).collect()}
    assert set(range(96, 116)) <= kept
    for i, t in enumerate(texts):
        if i not in kept:
            assert any(similar(t, texts[j]) for j in kept)
    pairs = [(i, j) for i in kept for j in kept if i < j and similar(texts[i], texts[j])]
    assert len(pairs) <= 2


@pytest.mark.parametrize("share", [0.95, 0.87, 0.81])
def test_deduplicate_cut_and_extended(spark, share):
    rng = np.random.default_rng(7)
    texts = []
    for i in range(60):
        words = [f"v{x}" for x in rng.integers(0, 300, 200)]
        cut = words[: int(200 * share) + 1]
        texts += [" ".join(words), " ".join(cut if i % 2 else words + [f"x{i}n{j}" for j in range(int(195 / share) - 196)])]
    assert all(similar(texts[i], texts[i + 1]) for i in range(0, 120, 2))
    kept = sorted(r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert kept == list(range(0, 120, 2))


@pytest.mark.parametrize("group", [3, 256])
def test_deduplicate_copies_that_meet_through_the_original(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(8)
    words = [f"v{x}" for x in range(1000)]
    texts = []
    for i in range(60):
        w = list(words)
        for at in rng.choice(1000, 20, replace=False):
            w[at] = f"e{i}"
        texts.append(" ".join(w))
    texts.append(" ".join(words))
    assert all(similar(t, texts[-1]) for t in texts) and sum(similar(texts[0], t) for t in texts[1:-1]) < 10
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.deduplicate(df).collect()] == [60]


def test_deduplicate_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r["doc_id"] for r in simhash.deduplicate(docs).select("doc_id").collect()}
    sets, having, shared = {}, defaultdict(list), Counter()
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for x in sets[r["doc_id"]]:
            having[x].append(r["doc_id"])
    for ids in having.values():
        shared.update((a, b) for a in ids for b in ids if a < b)
    pairs = {(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)}
    assert pairs and not any(a in kept and b in kept for a, b in pairs)
    empty = [d for d in sets if not sets[d]]
    assert sum(d in kept for d in empty) == min(len(empty), 1)
    for d in set(sets) - kept - set(empty):
        assert any(d in p and (p[0] in kept or p[1] in kept) for p in pairs)


def test_deduplicate_messy(spark, messy):
    out = simhash.deduplicate(messy)
    assert out.columns == messy.columns
    words = lambda rows: [" ".join((r["text"] or "").lower().split(" ")).split() for r in rows]
    got = [tuple(w) for w in words(out.collect())]
    assert len(set(got)) == len(got) and set(got) == {tuple(w) for w in words(messy.collect())}
    assert simhash.deduplicate(messy.limit(0)).count() == 0


# ---- toxicity --------------------------------------------------------------------------------------


def test_machine_learns_a_meeting():
    rng = np.random.default_rng(0)
    rows, label = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append(np.array(sorted({*rng.integers(100, 2000, 5).tolist(), *([1] if a else []), *([2] if b else [])}), np.int32))
        label.append(float(a and b))
    m = toxicity.fit(rows, np.array(label), epochs=30)
    said = toxicity.sigmoid(m.logits([np.array(x, np.int32) for x in ([], [1], [2], [1, 2])])) >= 0.5
    assert said.tolist() == [False, False, False, True]
    v = m.vector[[1, 2]].astype(float)
    assert m.logits([np.array([1, 2], np.int32)])[0] == pytest.approx(m.bias + m.weight[[1, 2]].sum() + v[0] @ v[1], abs=1e-5)


def plain_slots(text):
    words = {w for w in re.findall(rb"[a-z'\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))}
    terms = {b"w" + w for w in words}
    for w in words:
        u = w.decode("utf-8", "replace")
        terms |= {b"%d" % k + u[:k].encode() for k in (4, 5) if len(u) > k}
    return sorted({zlib.crc32(t) % (1 << 18) for t in terms})


def test_toxicity_equals_a_plain_version(spark, tables, messy, monkeypatch):
    """Terms, training rows and scores: every score is the sum over terms and over all pairs of terms."""
    seen = {}
    real = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: seen.setdefault("machine", real(*a, **k)))
    docs, labels = tables("documents"), tables("labels")
    got = {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in toxicity.toxicity(docs, labels).collect()}
    texts, known = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["toxic"] for r in labels.collect()}
    m = seen["machine"]
    for d, t in texts.items():
        slots = plain_slots(t)
        v = [m.vector[s].astype(float) for s in slots]
        z = m.bias + sum(float(m.weight[s]) for s in slots) + sum(float(v[i] @ v[j]) for i in range(len(v)) for j in range(i) if v[i].any() and v[j].any())
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        assert got[d] == (zlib.crc32(str(d).encode()) % 5 == 0, pytest.approx(p, abs=1e-9), int(got[d][1] >= 0.5))
    learned = [d for d in sorted(texts) if d in known and zlib.crc32(str(d).encode()) % 5 != 0]
    again = toxicity.fit([np.array(plain_slots(texts[d]), np.int32) for d in learned], np.array([float(known[d]) for d in learned]), prior=np.mean([known[d] for d in learned]))
    assert np.allclose(m.weight, again.weight, atol=1e-5) and np.allclose(m.vector, again.vector, atol=1e-5) and m.bias == pytest.approx(again.bias)


def test_fit_goes_down_the_gradient():
    """A step from the same start goes against the numerical gradient of the logistic loss, in weights and vectors."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 6, 3)).astype(np.int32) for _ in range(400)]
    label = np.array([float(0 in r and 1 in r) for r in rows])
    loss = lambda m: float(np.mean(np.logaddexp(0, m.logits(rows)) - label * m.logits(rows)))
    losses = [loss(toxicity.fit(rows, label, epochs=k, decay=0.0)) for k in (1, 3, 9, 27)]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.5 * losses[0]


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.5) == (rows["predicted"] == 1)).all()
    toxic = rows[rows["toxic"] == 1]
    assert toxic["predicted"].mean() > 0.8 and rows[rows["toxic"] == 0]["predicted"].mean() < 0.01


def test_toxicity_messy(spark, messy):
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (4, None), (4, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(messy, labels).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 5 == 0) for r in rows)
    assert toxicity.toxicity(messy.limit(0), labels.limit(0)).count() == 0
    assert toxicity.filter_documents(messy, labels.limit(0)).columns == messy.columns


def test_marks_leave_all_similar_texts():
    """Marks never tell similar texts apart, whatever their sizes, and tell nearly all others."""
    rng = np.random.default_rng(5)
    told = 0
    for turn in range(600):
        n = int(rng.integers(1, 700))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        cut = int(rng.integers(0, n // 4 + 1))
        b = np.concatenate([a[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)])
        other = rng.integers(0, 1 << 63, len(b), dtype=np.uint64)
        marks = [simhash.mark_of(x) for x in (a, b, other)]
        if simhash.is_alike(np.sort(a), np.sort(b), 0.8):
            assert simhash.may_be_similar(marks[0], marks[1], len(a) + len(b), 0.8) and simhash.may_be_similar(marks[1], marks[0], len(a) + len(b), 0.8)
        told += simhash.may_be_similar(marks[0], marks[2], len(a) + len(b), 0.8)
    assert told < 30


@pytest.mark.parametrize("group", [3, 256])
def test_texts_that_meet_by_chance_are_not_compared(spark, monkeypatch, group):
    """Every similar pair is left to be compared, but hardly one of the many that share a passage."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(9)
    passages = [" ".join(f"p{i}x{j}" for j in range(6)) for i in range(10)]
    texts = []
    for i in range(150):
        words = [f"v{x}" for x in rng.integers(0, 300, int(rng.integers(60, 120)))]
        words[20:20] = passages[i % 10].split()
        texts += [" ".join(words), " ".join(words[: int(len(words) * rng.uniform(0.75, 1))] if i % 3 else words[:40] + ["e"] + words[41:])]
    bodies = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "node long, root long, body string")
    level = spark.sparkContext.broadcast(np.zeros(simhash.COUNTERS, np.uint16))
    met = [r.asDict() for r in simhash.met_texts(simhash.entered(bodies, level, 5, 0.8), 0.8).collect()]
    large = {(r["key"], r["node"]) for r in met if r["key"] is not None}
    n, need, first = Counter(), {}, set()
    for r in met:
        if r["key"] is None:
            pair = (r["a"], r["b"])
            n[pair] += 1
            need[pair] = r["need"]
            if r["first"]:
                first.add(pair)
    shares, by_key = Counter(node for _, node in large), defaultdict(list)
    for key, node in large:
        by_key[key].append(node)
    compared = {p for p in first if n[p] + min(shares[p[0]], shares[p[1]]) >= need[p]}
    met_in_large = {(a, b) for nodes in by_key.values() for a in nodes for b in nodes if a < b}
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if similar(texts[a], texts[b])}
    assert len(want) > 100 and want <= compared | met_in_large
    if group == 256:
        assert not large and len(compared) < len(first)
    else:
        assert large and all(len(nodes) > group for nodes in by_key.values())
