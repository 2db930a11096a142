import random

import pytest

from pulsegrid.llm import pii


def letters():
    """Documents 0 to 3 and 5 have the address; the name stands far from it, and alone in document 4."""
    rng = random.Random(4)
    words = ["".join(rng.choices("bcdfglmnrst", k=6)) for _ in range(80)]

    def body(n=60):
        return " ".join(rng.choices(words, k=n))

    rows = [(k, body() + " heads this mail") for k in range(10, 400)]
    for k in range(4):
        rows.append((k, f"Zorgblat heads this. {body()} {body()} mail jo@mail.example.org {body()} zorgblat"))
    rows.append((4, f"{body()} ZORGBLAT again, zorgblats not {body()}"))
    rows += [(5, f"{body()} jo@mail.example.org")] * 2
    return rows


@pytest.mark.parametrize("few", [100_000, 0])
def test_terms_are_treated_wherever_they_stand(spark, monkeypatch, few):
    monkeypatch.setattr(pii, "BROADCAST_ROWS", few)
    rows = letters()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = dict(rows)
    got = pii.find_pii(df).collect()
    assert len(got) == len(rows)
    added = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == 4] for r in got}
    # ln(4 * 397 / (5 * 5)) / ln(397 / 5) = 0.949
    assert {k: v for k, v in added.items() if v} == {**{k: ["Zorgblat", "zorgblat"] for k in range(4)}, 4: ["ZORGBLAT"]}
    clean = pii.sanitise(df).collect()
    assert len(clean) == len(rows)
    for r in clean:
        want = texts[r.doc_id].replace("jo@mail.example.org", "[EMAIL]")
        for term in added[r.doc_id]:
            want = want.replace(term + " ", "[TERM] ") if term.istitle() or term.isupper() else want.removesuffix(term) + "[TERM]"
        assert r.text == want
