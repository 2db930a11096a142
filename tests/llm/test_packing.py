import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import packing, registry
from pulsegrid.llm.bpe import default_path

PATH = default_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def want_pieces(library, rows, capacity=4096):
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            out.append((doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=repr)


def check(placed, capacity):
    """Every sequence is gapless from 0 and no longer than the capacity; the number of sequences."""
    by = defaultdict(list)
    for r in placed:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


ODD = [
    "It's O'Brien's, isn't it? 'S 'LL we'Ve", "a.b,c; d!? e:f ... !!! Hello, World.", "naïve CAFÉ İstanbul ΣΑΣ ß ﬁ Å é", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|> Up",
    "12 345 6.7 x1y2 中国語 русский 👍🏽 ½ ²", "tab\tnew\nline\x0bv\x0cf\rr\x85n\xa0nb　id\x1cfs\x1fus", "", None, " \n ", "word, " * 30, "x" * 5000, "don't' 't'd 're, 've. 'm; 'd: (abc). \"abc\",",
    "á. é, Á! ñ .́ ,̈ o,̈ o.̸ x", "a\x00b \x01c. Kelvin K, ſ.",
]


def test_ids_are_the_librarys(library):
    encoder = packing.Encoder(PATH)
    texts = [(t or "").encode() for t in ODD]
    for step in (texts, texts[::-1]):
        for raw, ids in zip(step, encoder.encode(step)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(raw.decode(), add_special_tokens=False).ids, raw


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 3)
    encoder = packing.Encoder(PATH)
    for t in ODD * 2:
        (ids,) = encoder.encode([(t or "").encode()])
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_best_fit():
    assert packing.packed([6, 5, 4, 3, 2], 10) == [[6, 4], [5, 3, 2]]
    assert packing.packed([], 10) == [] and packing.packed([10, 10], 10) == [[10], [10]]
    assert packing.from_bytes(packing.to_bytes([[3, 4], [5]])) == [[3, 4], [5]] and packing.from_bytes(packing.to_bytes([])) == []


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 400, 300).tolist()
    a, b = packing.packed(sorted(lengths, reverse=True), 1000), packing.packed(lengths, 1000)
    for _ in range(20):
        child = packing.crossover(a, b, 1000, rng)
        assert Counter(x for y in child for x in y) == Counter(lengths) and all(sum(y) <= 1000 for y in child)
        a, b = child, a


def test_evolution_beats_best_fit():
    """Triples that fill a sequence exactly: best fit by size wastes some, the generations recover them."""
    rng = np.random.default_rng(7)
    better = 0
    for _ in range(6):
        lengths = []
        for _ in range(30):
            x, y = rng.integers(250, 420, 2).tolist()
            lengths += [x, y, 1000 - x - y]
        greedy = packed = packing.packed(sorted(lengths, reverse=True), 1000)
        for _ in range(4):
            packed = packing.evolve([packed, packing.packed(rng.permutation(lengths).tolist(), 1000)], lengths, 1000, rng)
        assert len(packed) <= len(greedy) and Counter(x for b in packed for x in b) == Counter(lengths)
        better += len(packed) < len(greedy)
    assert better >= 2


def test_query(spark, small, docs, library):
    got = registry.op13_packing(spark, small).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = want_pieces(library, rows)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == want
    tokens = sum(r.length for r in got)
    assert check(got, 4096) <= -(-tokens // 4096) + 1


@pytest.mark.parametrize("shard_tokens", [300, 4000, 10**6])
def test_shards_cost_nothing(spark, shard_tokens):
    """Levels of shards, equal lengths in plenty, repeated rows: within two sequences of the bound."""
    rng = np.random.default_rng(3)
    lengths = [*rng.integers(1, 60, 800).tolist(), *[7] * 500, *[100] * 5, *[99] * 3]
    rows = [(int(k % 9) if k % 5 else None, 0, 0, n, 5, int(d)) for k, (n, d) in enumerate(zip(lengths, rng.integers(0, 1 << 62, len(lengths))))]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    got = packing.pack(pieces, 100, shard_tokens).collect()
    assert Counter((r.doc_id, r.length) for r in got) == Counter((r[0], r[3]) for r in rows)
    assert check(got, 100) <= -(-sum(lengths) // 100) + 2


def test_odd_rows(spark, odd, empty, library):
    got = packing.pack_documents(odd, PATH).collect()
    want = want_pieces(library, [(r.doc_id, r.text) for r in odd.collect()])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == want
    check(got, 4096)
    nothing = packing.pack_documents(empty, PATH)
    assert nothing.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and nothing.isEmpty()
    same = odd.limit(1).withColumn("text", F.lit("word " * 1000)).crossJoin(spark.range(40)).drop("id")
    assert check(packing.pack_documents(same, PATH).collect(), 4096) == 10
    long = odd.limit(1).withColumn("text", F.repeat(F.lit("some more words, and "), 60_000))
    got = packing.pack_documents(long, PATH).collect()
    assert [r.length for r in sorted(got, key=lambda r: r.piece)][:-1] == [4096] * (len(got) - 1) and len(got) > 60
