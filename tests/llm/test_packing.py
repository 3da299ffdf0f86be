import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from voxloom.llm import packing


def exact(texts):
    t = Tokenizer.from_file(packing.tokenizer_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, packing.END_ID] for x in texts]


def test_words_alone_give_the_ids_of_whole_texts():
    texts = ["Don't stop!! ok. A.B. x.\x1cy 123,4 ΑΣ Σ. é.é ÉCOLE, naïvé It's»ok. <|endoftext|> 'S ok'! x_y", "", "İx ß. Ǆ ..."]
    texts += ["hello <|endoftext|> x", "a<|endoftext|>B<|startoftext|>", "<|ENDOFTEXT|> y <|endoftext|", "x  <|startoftext|>\n<|endoftext|><|endoftext|>z", "don<|endoftext|>'t", "<|endoftext|>"]
    got = packing.WordIds(packing.tokenizer_path(), cache=5)([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e[:-1] for e in exact(texts)]


@pytest.mark.parametrize("seed", range(4))
def test_patterns_use_every_piece_and_pad_little(seed):
    rng = np.random.default_rng(seed)
    lengths = packing.classes(4096, 64)
    at = {int(x): k for k, x in enumerate(lengths)}
    demand = np.zeros(len(lengths), np.int64)
    for n in rng.lognormal(6, 1.2, (3, 40, 900, 9000)[seed]).astype(int) + 1:
        for x in packing.cut(int(n), 4096, 64):
            if x < 4096:
                demand[at[x]] += 1
    chosen = packing.patterns_for(lengths, demand, 4096, 64)
    assert (sum(n * c for c, n in chosen) == demand).all()
    assert all(0 < c @ lengths <= 4096 for c, _ in chosen)
    assert sum(n for _, n in chosen) <= int(demand @ lengths) // 4096 + 2


def test_knapsack_prices_like_enumeration():
    lengths, value = np.array([3, 5, 7]), np.array([2.0, 3.9, 5.2])
    best = max(2 * a + 3.9 * b + 5.2 * c for a in range(8) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 23)
    worth, counts = packing.price(lengths, value, 23)
    assert worth == pytest.approx(best) and counts @ lengths <= 23 and counts @ value == pytest.approx(best)


def test_cut_covers():
    for n in [*range(1, 700), 4095, 4096, 4097, 9000]:
        assert sum(packing.cut(n, 4096, 64)) == n and all(x > 0 for x in packing.cut(n, 4096, 64))


def check(rows, docs):
    ids = {}
    for d, t in docs:
        e = exact([t])[0]
        ids.setdefault((d, zlib.crc32(np.array(e, "<u4").tobytes())), []).append(e)
    pieces = sorted(map(tuple, rows), key=repr)
    assert sum(p[2] for p in pieces) == sum(len(e) for v in ids.values() for e in v)
    seqs = {}
    for d, start, length, crc, n, seq, off in pieces:
        assert any(k[0] == d and len(e) == n and zlib.crc32(np.array(e[start : start + length], "<u4").tobytes()) == crc for k, v in ids.items() for e in v)
        seqs.setdefault(seq, []).append((off, length))
    for parts in seqs.values():
        at = 0
        for off, length in sorted(parts):
            assert off == at
            at += length
        assert at <= 4096
    return seqs


def test_pack_whole_table(spark, tables):
    docs = tables("documents")
    out = packing.pack(docs).collect()
    seqs = check(out, [(r["doc_id"], r["text"]) for r in docs.collect()])
    total = sum(r["length"] for r in out)
    assert len(seqs) <= total // 4096 + 2


def test_pack_messy(spark, messy):
    check(packing.pack(messy, buckets=3).collect(), [(r["doc_id"], r["text"]) for r in messy.collect()])
    assert packing.pack(messy.limit(0)).count() == 0
    with_ids = packing.pack(messy, with_ids=True).filter("doc_id = 4").first()
    assert with_ids["ids"] == exact(["Two words"])[0]
