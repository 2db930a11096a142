from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from pulsegrid.llm import bpe, mixing, quality_rules
from tests.llm.test_near_copies import shingle_set
from tests.llm.test_pii import brute, brute_terms
from tests.llm.test_quality_rules import brute as base_rules
from tests.llm.test_simhash import expected as components


def redact(text, spans):
    """Base spans and terms to placeholders, overlapping ones as one."""
    names = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", None]
    out, at, merged = [], 0, []
    for start, kind, end in sorted(spans, key=lambda s: (s[0], s[2])):
        if merged and merged[-1][2] > start:
            merged[-1] = (*merged[-1][:2], max(merged[-1][2], end))
        else:
            merged.append((start, kind, end))
    for start, kind, end in merged:
        out += [text[at:start], names[kind]]
        at = end
    return out, text[at:]


def one_of_each(docs):
    """The least id of each group of documents linked by two-bit fingerprints or by five-word similarity."""
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = [(i, c) for i, _, c in components(docs)]
    sets = [(i, shingle_set(t)) for i, t in docs if t and t.split()]
    pairs += [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if len(a & b) >= 0.8 * len(a | b)]
    for i, j in pairs:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    return {root(i) for i in parent}


def test_stages_against_brute_force(spark, small, docs):
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    now, stages = docs, dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == list(stages)

    good = corpus_pipeline.good_documents(spark, now, small)
    assert good.columns == columns
    kept = {r.doc_id for r in quality_rules.quality_rules(now).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    assert not any(base_rules(rows[i].text)[-1] for i in kept)

    single = corpus_pipeline.distinct_documents(spark, good, small)
    assert single.columns == columns
    want = one_of_each([(i, rows[i].text) for i in kept])
    assert {r.doc_id for r in single.collect()} == want

    private = corpus_pipeline.private_data_removed(spark, single, small)
    assert private.columns == columns
    terms = brute_terms([(i, rows[i].text) for i in want])
    clean = {r.doc_id: r for r in private.collect()}
    assert set(clean) == want
    for i in want:
        text = rows[i].text or ""
        spans = [s[:3] for s in brute(text)] + terms[i, rows[i].text]
        if not spans:
            assert clean[i] == rows[i]
            continue
        pieces, tail = redact(text, spans)
        rest, ok = clean[i].text, True
        for p in pieces:  # a term is either generalised or removed
            options = ["[TERM]", ""] if p is None else [p]
            hit = next((o for o in options if rest.startswith(o)), None)
            ok = ok and hit is not None
            rest = rest[len(hit or "") :]
        assert ok and rest == tail
        assert clean[i].n_chars == len(clean[i].text)

    mixed = corpus_pipeline.mixed_sources(spark, private, small)
    assert mixed.columns == columns
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_table(private).collect() if r.size}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in taken.items() if n})

    last = corpus_pipeline.run(spark, small).collect()
    library = Tokenizer.from_file(bpe.default_path())
    assert Counter(r.doc_id for r in last) == Counter({i: n for i, n in taken.items() if n})
    for r in last:
        assert r.text == clean[r.doc_id].text
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)


def test_stages_take_odd_and_empty_tables(spark, odd, empty, small):
    for docs in (odd, empty):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, small)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert now.columns == docs.columns
        assert now.count() >= 0
