"""Language model, neighbours, archives, rollups and the pipeline."""

import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxloom.llm import hmm, neighbours, packing, rollup, warc

SF = "/root/testdata/sf0.001"


# ---- language model --------------------------------------------------------------------------------


def random_model(states=3, symbols=7, seed=0):
    rng = np.random.default_rng(seed)
    unit = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(unit(rng.random(states), 0), unit(rng.random((states, states)), 1), unit(rng.random((symbols, states)), 0))


def test_forward_is_the_sum_over_all_paths():
    m = random_model()
    docs = [np.array(d) for d in ([1, 4, 2, 6], [0], [3, 3, 5])]
    p = hmm.packed(docs)
    got = np.empty(3)
    got[p.order] = hmm.forward(m, p)
    for d, x in zip(docs, got, strict=True):
        total = sum(
            m.start[path[0]] * np.prod([m.move[a, b] for a, b in zip(path, path[1:], strict=False)]) * np.prod([m.emit[s, k] for s, k in zip(d, path, strict=True)])
            for path in product(range(3), repeat=len(d))
        )
        assert x == pytest.approx(math.log(total))


def test_expected_counts_are_posteriors():
    m, docs = random_model(2, 4), [np.array([0, 3, 1]), np.array([2, 2])]
    p = hmm.packed(docs)
    starts, moves, states = hmm.expected(m, p)
    want_start, want_moves, want = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for d in docs:
        paths = {path: m.start[path[0]] * np.prod([m.move[a, b] for a, b in zip(path, path[1:], strict=False)]) * np.prod([m.emit[s, k] for s, k in zip(d, path, strict=True)]) for path in product(range(2), repeat=len(d))}
        total = sum(paths.values())
        for path, w in paths.items():
            want_start[path[0]] += w / total
            for a, b in zip(path, path[1:], strict=False):
                want_moves[a, b] += w / total
            for s, k in zip(d, path, strict=True):
                want[s, k] += w / total
    sums = np.zeros((4, 2))
    hmm.gather(sums, p.symbols, states)
    assert np.allclose(starts, want_start) and np.allclose(moves, want_moves) and np.allclose(sums, want)


def base(rows, held):
    counts = Counter()
    for d, t in rows:
        if not held(d):
            counts.update((t or "").encode().lower().split())
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        words = [*(t or "").encode().lower().split(), None]
        score = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        out.append((d, held(d), len(words), sum(counts[w] > 0 for w in words), n, round(score, 4)))
    return Counter(out)


def held(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0


@pytest.mark.parametrize("bounds", [{}, {"own": 40, "known": 300, "shared": 16}])
def test_language_model(spark, tables, bounds):
    docs = tables("documents")
    rows = hmm.score(docs, states=4, **bounds).toPandas()
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows.itertuples())
    assert got == base([(r["doc_id"], r["text"]) for r in docs.collect()], held)
    assert (rows["score"] < 0).all()
    for part in (True, False):
        x = rows[rows["held_out"] == part]
        assert x["score"].sum() > x["base_score"].sum()


def test_score_is_the_trained_models_likelihood(spark, tables, monkeypatch):
    """Against a plain forward recursion, one text and one state at a time, over the same trained model."""
    seen, own, shared = {}, 40, 16
    train, vocabulary = hmm.train, hmm.vocabulary
    monkeypatch.setattr(hmm, "train", lambda *a, **k: seen.setdefault("model", train(*a, **k)))
    monkeypatch.setattr(hmm, "vocabulary", lambda *a, **k: seen.setdefault("vocab", vocabulary(*a, **k)))
    docs = tables("documents")
    rows = hmm.score(docs, states=3, own=own, known=300, shared=shared).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    m, vocab = seen["model"], seen["vocab"][0]
    counts = Counter(w for d, ws in texts.items() if not held(d) for w in ws)
    of = {w: 1 + k for k, w in enumerate(vocab.words[: vocab.own])}
    assert 0 < len(of) <= own and min(counts[w] for w in of) >= max(counts[w] for w in set(counts) - set(of))
    total, kinds = Counter(), Counter()
    for w, n in counts.items():
        if w not in of:
            total[zlib.crc32(w) % shared] += n
            kinds[zlib.crc32(w) % shared] += 1
    for r in rows:
        a, want = m.start.tolist(), 0.0
        for w in [*texts[r["doc_id"]], None]:
            k = None if w is None or w in of else zlib.crc32(w) % shared
            symbol = 0 if w is None else of[w] if k is None else 1 + vocab.own + k
            here = [x * float(m.emit[symbol, s]) for s, x in enumerate(a)]
            want += math.log10(sum(here)) + (0.0 if k is None else math.log10((counts[w] + 0.1) / (total[k] + 0.1 * (kinds[k] + 1))))
            a = [sum(x * float(m.move[p, s]) for p, x in enumerate(here)) / sum(here) for s in range(3)]
        assert r["score"] == pytest.approx(want, rel=1e-6)


def test_all_words_sum_to_less_than_one(spark, tables):
    """The model's one-word texts are events that exclude each other."""
    docs = tables("documents").filter(F.length("text") < 300)
    words = sorted({w for r in docs.collect() for w in r["text"].lower().split()})
    both = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(10_000_000 + i, w) for i, w in enumerate(words)], "doc_id long, text string"))
    only = both.withColumn("doc_id", F.when(F.col("doc_id") >= 10_000_000, F.lit(next(i for i in range(100) if held(i)))).otherwise(F.col("doc_id")))
    rows = hmm.score(only, states=2, own=20, known=60, shared=8).filter("n_tokens = 2 AND held_out")
    assert rows.select(F.sum(F.pow(F.lit(10.0), "score"))).first()[0] < 1


def test_language_model_messy(spark, messy):
    rows = hmm.score(messy, states=2).collect()
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows)
    assert got == base([(r["doc_id"], r["text"]) for r in messy.collect()], held)
    assert hmm.score(messy.limit(0), states=2).count() == 0
    none = next(i for i in range(100) if held(i))
    assert hmm.score(messy.withColumn("doc_id", F.lit(none)), states=2).filter("n_known > 0").count() == 0


# ---- neighbours ------------------------------------------------------------------------------------


def brute(ids, x, q, k=5):
    out = {}
    norm = np.linalg.norm(x, axis=1)
    for i in q:
        at = int(np.nonzero(ids == i)[0][0])
        cos = x @ x[at] / (norm * norm[at])
        best = {}
        for j, s in zip(ids.tolist(), cos.tolist(), strict=True):
            if j != i:
                best[j] = max(s, best.get(j, -2))
        out[i] = sorted(best.items(), key=lambda p: (-round(p[1], 12), p[0]))[:k]
    return out


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack([np.asarray(v, float) for v in rows["embedding"]])
    want = brute(ids, x, [i for i in ids if i % 50 == 0])
    got = {}
    for r in neighbours.nearest(table, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 5 for q in want]) >= 0.9
    scores = {(q, j): s for q in want for j, s in brute(ids, x, [q], len(ids))[q]}
    assert all(s == pytest.approx(scores[q, j], abs=1e-12) for q, v in got.items() for j, s in v)


def test_neighbours_edge_cases(spark):
    e = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [2.0, 0.0]), (7, [-1.0, 0.1]), (100, [0.0, 0.0]), (150, None), (200, [None, 1.0]), (250, [float("nan"), 1.0]), (300, [1.0]), (None, [1.0, 1.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame(e, "vec_id long, embedding array<double>").withColumns({"key": F.lit("own"), "score": F.lit(None).cast("string")})
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(df, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 3), (0, 3, 50), (0, 4, 7), (50, 1, 0), (50, 2, 2), (50, 3, 3), (50, 4, 7)]
    assert neighbours.nearest(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_chunks_change_nothing(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.repeat(rng.normal(size=(60, 8)), 4, axis=0))], "vec_id long, embedding array<double>")
    key = lambda d: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in d.collect())
    assert key(neighbours.nearest(df, lambda i: i % 10 == 0, chunk=7)) == key(neighbours.nearest(df, lambda i: i % 10 == 0))


def test_probes_come_in_order_of_success():
    place = np.array([0.1, 0.6, 0.45])
    cells = neighbours.probes(np.zeros(3, int), place, 20)
    cost = [sum((p**2 if d < 0 else (1 - p) ** 2) for p, d in zip(place, c, strict=True) if d) for c in cells]
    assert cost == sorted(cost) and len({tuple(c) for c in cells}) == len(cells) == 20


# ---- archives --------------------------------------------------------------------------------------


def test_archive_round_trip(spark, tmp_path):
    same, other = "<p>" + "x" * 200, "y" * 99
    pages = [(5, "http://b.org/1?b=2&a=1", same), (3, "http://www.a.org:80/P", same), (9, "https://a.org/p", same), (1, "http://a.org/q\r\nX: y", other), (2, "http://a.org/z", other), (4, None, None), (None, "http://a.org/n", same), (6, "http://[bad", "WARC/1.1\r\n\r\n\r\n\r\n" + "é" * 80), (3, "http://www.a.org:80/P", same)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"first": F.lit(1), "time": F.lit("own")})
    index = warc.archive_pages(df, time=F.timestamp_seconds(F.coalesce("page_id", F.lit(0))), path=str(tmp_path / "w")).orderBy("part", "place").collect()
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in index), key=repr)
    want = [(5, "revisit", 3, 203), (3, "response", None, 203), (9, "revisit", 3, 203), (1, "response", None, 99), (2, "response", None, 99), (4, "response", None, 0), (None, "revisit", 3, 203), (6, "response", None, 176), (3, "response", None, 203)]
    assert got == sorted(want, key=repr)
    assert [(r["url_key"], r["timestamp"]) for r in index] == sorted((r["url_key"], r["timestamp"]) for r in index)
    for r in index:
        content = spark.read.format("binaryFile").load(r["file"]).first()["content"]
        (at, size, head, _), *_ = warc.parse(bytes(content[r["offset"] : r["offset"] + r["length"]]))
        assert (at, size) == (0, r["length"]) and head["warc-type"] == r["record_type"]
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse(bytes(content[:-3])))
    assert warc.archive_pages(df.limit(0), path=str(tmp_path / "none")).count() == 0


def test_archive_of_a_long_page_in_another_time_zone(spark, tmp_path):
    long = "é<p>" * 3_000_000
    df = spark.createDataFrame([(1, "http://a.org/x", long), (2, "http://a.org/y", long), (3, "http://a.org/z", "short")], "page_id long, url string, html string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {r["page_id"]: r for r in warc.archive_pages(df, time=F.timestamp_seconds(F.lit(1_710_054_000)), path=str(tmp_path / "w")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert {r["timestamp"] for r in got.values()} == {"2024-03-10T07:00:00Z"}  # as clocks go forward there
    assert [got[k]["record_type"] for k in (1, 2, 3)] == ["response", "revisit", "response"]
    assert got[1]["payload_bytes"] == got[2]["payload_bytes"] == len(long.encode())


def test_url_keys():
    assert warc.url_key("HTTP://WWW.Example.org:80/A?b=2&a=1#x") == "org,example)/a?a=1&b=2"
    assert warc.url_key("https://example.org:8080") == "org,example:8080)/"


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = np.random.default_rng(k)
    row = lambda: (f"k{rng.integers(5)}", f"t{rng.integers(5)}", int(rng.integers(9)) if rng.random() > 0.1 else None, "u", "response", None, 0, "d", int(rng.integers(99)), 1, f"f{rng.integers(4)}")
    parts = [sorted((row() for _ in range(rng.integers(0, 12))), key=warc.order) for _ in range(k)]
    got = list(warc.merge_runs(parts))
    assert [warc.order(r) for r in got] == sorted(warc.order(r) for p in parts for r in p)


# ---- rollups ---------------------------------------------------------------------------------------


def totals(store):
    return Counter({(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in store.totals().collect()})


def want(rows):
    encode, out = packing.WordIds(packing.tokenizer_path()), {}
    for source, lang, text in rows:
        d, t = out.get((source, lang), (0, 0))
        out[source, lang] = d + 1, t + len(encode([(text or "").encode()])[0]) // 4
    return Counter(out)


def test_rollup_equals_a_recount(spark, tables, tmp_path):
    docs = tables("documents")
    store = rollup.rollup_by_batches(docs, str(tmp_path / "r"))
    assert totals(store) == want([(r["source"], r["lang"], r["text"]) for r in docs.collect()])


def test_rollup_messy(spark, messy, tmp_path):
    """Rows without an id and with one id count each for itself unless they are equal; against the tokenizer on whole texts."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = {(r["doc_id"], r["source"], r["lang"], r["text"]) for r in messy.collect()}
    found = {}
    for _, source, lang, text in rows:
        d, t = found.get((source, lang), (0, 0))
        found[source, lang] = d + 1, t + len(tokenizer.encode(text or "", add_special_tokens=False).ids)
    assert totals(rollup.rollup_by_batches(messy, str(tmp_path / "m"))) == Counter(found)
    assert rollup.rollup_by_batches(messy.limit(0), str(tmp_path / "none")).totals().count() == 0
    two = spark.createDataFrame([(1, "a", "en", "one"), (1, "a", "en", "two three"), (None, "a", "en", "x"), (None, "a", "en", "y")], "doc_id long, source string, lang string, text string")
    assert sum(d for d, _ in totals(rollup.rollup_by_batches(two, str(tmp_path / "two"))).values()) == 4


def test_rollup_batches(spark, tmp_path):
    cols = "op string, doc_id long, source string, lang string, text string, tokens int"
    store = rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert store.totals().count() == 0
    first = spark.createDataFrame([("insert", 1, "a", "en", "one two", 9), ("insert", 2, None, None, None, 9), ("insert", 2, None, None, None, 9), ("insert", None, "a", "en", "three", 9), ("delete", 77, "a", "en", "x", 9)], cols)
    assert store.commit("b1", first) and not store.commit("b1", first)
    assert totals(store) == want([("a", "en", "one two"), (None, None, None), ("a", "en", "three")])
    second = spark.createDataFrame([("revise", 1, "b", "en", "four five six", 0), ("delete", 2, None, None, None, 0), ("delete", None, None, None, None, 0)], cols)
    store.commit("b2", second)
    assert totals(store) == want([("b", "en", "four five six")])
    # a batch that was cut short before its commit is not read, and can be run again
    spark.createDataFrame([("zz", "b", "en", "t", 5, 5)], rollup.LEDGER).write.parquet(str(tmp_path / "r/ledger/b3"))
    assert totals(store) == want([("b", "en", "four five six")])
    store.commit("b3", first.filter("doc_id = 1"))
    assert totals(store) == want([("a", "en", "one two")])
    with pytest.raises(Exception, match="unknown op"):
        store.commit("b4", first.withColumn("op", F.lit("upsert")))
    with pytest.raises(ValueError):
        store.commit("a/b", first)


# ---- pipeline --------------------------------------------------------------------------------------


def test_stages_keep_columns_and_take_effect(spark, messy):
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    docs, counts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.01").cache()
        assert docs.columns == cols
        counts.append(docs.count())
    assert 1000 > counts[0] > counts[1] > counts[2] > 500
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, messy.select(cols), SF).count() >= 0
        assert stage(spark, messy.select(cols).limit(0), SF).count() == 0


def test_run_is_its_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "mixing", "packing"]
    out = corpus_pipeline.run(spark, SF)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).filter("n <> m OR n > 4096").count() == 0
