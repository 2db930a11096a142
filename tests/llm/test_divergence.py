import random
import re
from collections import Counter, defaultdict

import pytest

from pulsegrid.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    """Rows (lang, source, text), by all terms of all groups."""
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs, counts, groups = Counter(), defaultdict(Counter), {s for a, s, _ in rows if a == lang}
        for a, source, text in rows:
            if a == lang:
                found = TERM.findall(text.translate(UPPER))
                docs.update(set(found))
                counts[source].update(found)
        kept = [t for t in docs if docs[t] >= min_docs]
        v, everywhere = len(kept), Counter()
        for c in counts.values():
            everywhere.update(c)

        def p(c, t):
            return 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * v)

        for source in groups:
            pairs = [(sum(abs(p(counts[source], t) - p(counts[o], t)) for t in kept), o) for o in groups if o != source]
            used = [(p(counts[source], t) - p(everywhere, t), t) for t in kept if counts[source][t] and p(counts[source], t) > p(everywhere, t)]
            for part, found in (("pair", pairs), ("term", used)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found if part == "pair" else found[:top])]
    return sorted(out)


def have(spark, rows, min_docs=2, top=5):
    data = spark.createDataFrame([(k, t, a, s, "extra", 1.0) for k, (a, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, p double")
    return sorted(map(tuple, divergence.audit(data, min_docs, top).collect()))


def invented(seed, n=60, sources=4, words=30):
    r = random.Random(seed)
    weights = [1 / (k + 1) for k in range(words)]
    names = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(words)]
    out = []
    for _ in range(n):
        s = r.randrange(sources)
        own = weights[s:] + weights[:s]
        out.append((r.choice(["en", "de", None]), f"src{s}", " ".join(r.choices(names, own, k=r.randrange(40))).title()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = invented(seed)
    assert have(spark, rows) == brute(rows, 2, 5)


def test_odd_rows(spark):
    rows = [
        (None, None, None), ("", "", ""), ("en", None, "één twee één ÉÉN 中国語 中国語 x1y x-y"), ("en", "a", "één ünd über x1y"), ("en", "a", "één"),
        ("en", "b", "only_once Here"), ("en", "c", "1234 5678 !!"), ("fr", "a", "seul"), ("en", "a", "één twee één ÉÉN 中国語"), ("en", "a", "één twee één ÉÉN 中国語"),
        ("en", "d", "word " * 3000), ("en", "e", "x" * 20000),
    ]
    for least in (1, 2, 50):
        assert have(spark, rows, least) == brute(rows, least, 5)
    assert have(spark, []) == []


def test_long_texts_in_pieces(monkeypatch):
    text = ("aB" * 7 + " " + "cde fG ") * 9
    whole = [t.encode() for t in TERM.findall(text.translate(UPPER))]
    for step in (1, 3, 8, 64, 10_000):
        monkeypatch.setattr(divergence, "STEP_BYTES", step)
        assert [t for part in divergence.terms(text.encode()) for t in part] == whole


def test_search_stops_early_and_misses_nothing(spark):
    """Many rare terms: their buckets stay unopened, and groups without enough over-used terms go on to the end."""
    r = random.Random(5)
    rows = [("en", f"s{k % 3}", " ".join([f"r{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(60)] + [f"big{'abc'[k % 3]}"] * 9)) for k in range(150)]
    data = spark.createDataFrame([(a, s, t) for a, s, t in rows], "lang string, source string, text string")
    kept = divergence.kept_postings(data, 2)
    entries = divergence.entries_of(kept, divergence.group_table(kept)).persist()
    log = []
    found = sorted((x.lang, x.source, "term", x.term, x.value, x["rank"]) for x in divergence.overused_terms(entries, 1, log).collect())
    assert found == [x for x in brute(rows, 2, 1) if x[2] == "term"]
    assert sum(log) < entries.select("lang", "source", "bucket").distinct().count()
    entries.unpersist()


def test_many_sources_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    rows = invented(9, n=80, sources=11)
    assert have(spark, rows) == brute(rows, 2, 5)


def test_probability_of_large_counts(spark):
    n, total = 7_123_456_789_012_345, 9_007_199_254_740_991
    from pyspark.sql import functions as F

    got = spark.range(1).select(divergence.probability(F.lit(n), F.lit(total))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // total
