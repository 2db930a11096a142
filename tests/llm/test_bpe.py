import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from pulsegrid.llm import bpe, registry, token_counts

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_texts_encode_as_the_library_does(library):
    rng = random.Random(7)
    alphabet = "ab'sll ve\t\n\r\x0b\x1c\x1f\x85\xa0　 12²½५xéß中国👍🏽‍́\x00_-<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "a" * 4001, "ab" * 500, ""]
    v = bpe.Vocabulary(PATH)
    got = [np.frombuffer(x, "<u4").tolist() for x in v.encode_batch(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [v.decode(x) for x in v.encode_batch(texts)] == texts


def test_a_forgotten_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(bpe, "STEP_CHARS", 10)
    texts = ["some words here", "other words there and here", "some words here"]
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.Vocabulary(PATH).encode_batch(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def expected(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        out.append((i, len(ids), digest, decoded))
    return sorted(out, key=repr)


def test_query_on_all_documents(spark, small, docs, library):
    got = registry.op5_bpe(spark, small).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == expected(library, map(tuple, docs.select("doc_id", "text").collect()))


def test_odd_rows(odd, empty, library):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = bpe.encode(odd, PATH).select("doc_id", "ids", bpe.decode(PATH).alias("back")).collect()
    want = sorted((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in rows if i)
    assert sorted((r[0], tuple(np.frombuffer(r[1], "<u4").tolist()), r[2]) for r in got if r[0]) == want
    assert bpe.encode(empty, PATH).count() == 0


def test_token_counts(spark, small, docs, odd, empty, library, monkeypatch):
    def want(rows):
        return sorted(
            (
                (i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
                for i, t in rows
            ),
            key=repr,
        )

    for frame in (docs, odd, empty):
        got = token_counts.token_counts(frame, PATH).collect()
        assert sorted(map(tuple, got), key=repr) == want(map(tuple, frame.select("doc_id", "text").collect()))
    over = registry.op7_token_counts(spark, small).collect()
    assert all(r.over_limit == (r.n_tokens > 1024) for r in over) and len(over) == docs.count()


def test_frequencies_are_packed_whole():
    docs = np.array([0, 5, 16383])
    for counts in (np.array([1, 2, 255]), np.array([1, 70000, 3])):
        a, b = token_counts.unpack(token_counts.pack(docs, counts))
        assert a.tolist() == docs.tolist() and b.tolist() == counts.tolist()


def test_sums_of_posts():
    rng = random.Random(2)
    want = {}
    batch, pieces, posts = [], [], []
    for _ in range(300):
        docs = sorted(rng.sample(range(64), rng.randint(1, 5)))
        counts = [rng.choice([1, 2, 300]) for _ in docs]
        batch.append((rng.randint(0, 3) << 24) + rng.randint(0, 1))
        pieces.append(rng.randint(1, 9))
        posts.append(token_counts.pack(np.array(docs), np.array(counts)))
        for d, c in zip(docs, counts):
            want[batch[-1], d] = want.get((batch[-1], d), 0) + c * pieces[-1]
    held = token_counts._Held()
    held.add(*token_counts.products(np.array(batch), np.array(pieces), posts))
    got = {}
    for r in held.told().itertuples():
        docs, sums = token_counts.unpack(r.posts)
        got |= {(r.batch, int(d)): int(n) for d, n in zip(docs, sums)}
    assert got == want and held.n == 0
    assert len(token_counts._Held().told()) == 0


def test_counts_of_many_partitions(docs, library):
    docs = docs.repartition(9)
    got = token_counts.token_counts(docs, PATH).collect()
    assert len(got) == docs.count()
    ids = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in got} == ids


def test_sums_that_are_told_early_are_whole(docs, library, monkeypatch):
    monkeypatch.setattr(token_counts, "HELD_SUMS", 100)
    monkeypatch.setattr(token_counts, "WAITING_ROWS", 50)
    rows = token_counts.frequencies(docs.repartition(3), PATH).toPandas().sort_values("token")
    frames = [rows[a : a + 70] for a in range(0, len(rows), 70)]
    told = pd.concat(token_counts._sums(iter(frames), PATH))
    assert len(told) > 100
    got = pd.concat([token_counts._totals(x) for _, x in told.groupby("batch")])
    ids = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert dict(zip(got.doc_id, got.n_tokens)) == ids
