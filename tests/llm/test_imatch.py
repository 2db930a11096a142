import hashlib

import numpy as np

from pulsegrid.llm import imatch, registry


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), [-ord(c) for c in r[1] or ""] + [1]))
    out = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        out.append((i, len(text), hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edited_texts(spark, small, docs, monkeypatch):
    want = expected([tuple(r) for r in docs.select("doc_id", "text").collect()])
    for bucket in (4096, 7):
        monkeypatch.setattr(imatch, "BUCKET_DOCS", bucket)
        got = registry.op10_imatch(spark, small).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == want


def test_likeness_tells_edits_from_strangers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = imatch.compare_with_edits(docs).where("n_chars > 1000").toPandas()
    assert got.near_edited.mean() > 0.4 and got.near_next.mean() < 0.1
    assert (got.near_edited > got.near_next).mean() > 0.95
    assert got[["near_edited", "near_next"]].stack().between(0, 1).all()


def test_equal_texts_have_equal_fingerprints(odd, empty):
    got = imatch.compare_with_edits(odd).collect()
    assert len(got) == odd.count()
    by_chars = {}
    for r in got:
        by_chars.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert len(by_chars[(9, 32)]) == 1
    assert imatch.compare_with_edits(empty).count() == 0


def test_document_frequencies_count_all_documents(docs):
    want = {}
    for r in docs.collect():
        for t in imatch.terms(r.text or ""):
            want[t] = want.get(t, 0) + 1
    got = {r.term: r.df for r in imatch.document_frequencies(docs).collect()}
    assert got == dict(zip(imatch.hashes(want).view(np.int64).tolist(), want.values()))


def slow_fingerprint(text, words):
    """By loops over subsets and terms, in whole numbers: {(level, subset): hash}."""
    import xxhash

    hashed = {xxhash.xxh64_intdigest(t.encode()) for t in imatch.terms(text)}
    own = sorted(hashed & words) or sorted(hashed)
    out = {}
    for level in range(imatch.LEVELS):
        for subset in range(imatch.SUBSETS):
            held = []
            for term in own:
                x = term * int(imatch._MIX[subset]) % 2**64
                x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % 2**64
                if x >> 32 < 1 << (30 - 2 * level):
                    held.append(term.to_bytes(8, "little"))
            out[level, subset] = (xxhash.xxh64_intdigest(b"".join(held)) >> (64 - 4 * imatch.DIGITS) or 1) if held else 0
    return out


def slow_likeness(a, b):
    if a == b:
        return 1.0
    at = 0
    for level in range(imatch.LEVELS):
        if 4 * sum(bool(a[level, s] or b[level, s]) for s in range(imatch.SUBSETS)) >= imatch.SUBSETS:
            at = level
    informed = [s for s in range(imatch.SUBSETS) if a[at, s] or b[at, s]]
    return sum(a[at, s] == b[at, s] for s in informed) / len(informed) if informed else 0.0


def test_fingerprints_and_likeness_equal_brute_force(spark, docs):
    import xxhash

    some = docs.where("length(text) < 1500 AND doc_id < 90")
    rows = sorted(((r.doc_id, r.text or "") for r in some.collect()), reverse=True)
    n, df = len(rows), {}
    for _, text in rows:
        for t in imatch.terms(text):
            df[t] = df.get(t, 0) + 1
    words = {xxhash.xxh64_intdigest(t.encode()) for t, k in df.items() if max(2, 0.02 * n) <= k <= 0.5 * n}
    marks = [slow_fingerprint(text, words) for _, text in rows]
    got = {r.doc_id: r for r in imatch.compare_with_edits(some, min_share=0.02, max_share=0.5).collect()}
    assert len(got) == n > 20
    for k, (doc_id, text) in enumerate(rows):
        after = (k + 1) % n
        cut = len(text) // 3
        edited = slow_fingerprint(text[: len(text) - cut] + rows[after][1][:cut], words)
        r = got[doc_id]
        for shown, mark in ((r.fingerprint, marks[k]), (r.edited_fingerprint, edited)):
            assert shown == "".join(f"{mark[level, s]:0{imatch.DIGITS}x}" for level in range(imatch.LEVELS) for s in range(imatch.SUBSETS))
        assert r.near_edited == slow_likeness(marks[k], edited) and r.near_next == slow_likeness(marks[k], marks[after])


def test_one_id_repeated_ends_the_bucket_ahead_once(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET_DOCS", 5)
    rows = [(k, f"text {k} " * 5) for k in range(40)] + [(17, f"same id {k} " * 4) for k in range(30)] + [(17, None), (None, "no id"), (None, None)]
    dealt = imatch.in_descending_order(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sum(r.edge for r in dealt) == len({r.bucket for r in dealt}) and sum(1 - r.edge for r in dealt) == len(rows)
    got = imatch.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == expected(rows)
