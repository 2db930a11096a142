import hashlib
import math
import random
import re
import time
from collections import defaultdict
from itertools import accumulate

from pyspark.sql import functions as F

from pulsegrid.llm import pii, registry

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(d) <= 19 and luhn(d),
                "phone": 10 <= len(d) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, m.end(), m[0]))
    return sorted(out)


def spans_text(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


SECRET = r"""(?i)(?:token|secret|password|passwd|pwd|(?:api|access|private)[_-]?key)["']?\s{0,3}[:=]\s{0,3}["']?([^\s"',;]{8,})"""


TERM = r"[^\W_]+(?:['-][^\W_]+)*"


def words(text):
    return {w.lower() for w in re.findall(TERM, text)}


def brute_terms(rows, least=pii.DISCLOSURE):
    """The added spans of each (id, text), by plain counting over the distinct texts."""
    texts = {r[1] or "" for r in rows}
    n, n_t, n_e, n_et, own = len(texts), defaultdict(int), defaultdict(int), defaultdict(int), {}
    for text in texts:
        found = words(text)
        for t in found:
            n_t[t] += 1
        base = brute(text)
        entities = set()
        for _, k, _, v in base:
            d = re.sub("[^0-9]", "", v)
            entities.add((k, v.lower() if k == 0 else v if k == 1 else d))
            entities.add(("class", k, v.lower().split("@")[-1] if k == 0 else ".".join(v.split(".")[:2]) if k == 1 else d[:6]))
        secrets = set(re.findall(SECRET, text))
        for v in secrets:
            own["secret", v] = {t for t in words(v) if len(t) >= 8}
        entities |= {("secret", v) for v in secrets}
        for e in entities:
            n_e[e] += 1
        for t in found - {w for *_, v in base for w in words(v)}:
            if len(t) >= 3 and re.search(r"[^\W\d_]", t):
                for e in entities:
                    n_et[e, t] += 1
    good = set()
    for (e, t), k in n_et.items():
        if k >= 2 and n_e[e] < n and 1 + math.log((k - 0.75) / n_t[t]) / math.log(n / n_e[e]) >= least - 1e-12:
            good.add(t)
    for e, terms in own.items():
        for t in terms:
            if n_e[e] < n and n_t[t] and 1 + math.log(n_e[e] / n_t[t]) / math.log(n / n_e[e]) >= least - 1e-12:
                good.add(t)
    out = {}
    for r in rows:
        base = brute(r[1])
        found = [(m.start(), 4, m.end()) for m in re.finditer(TERM, r[1] or "") if m[0].lower() in good]
        out[r] = [s for s in found if not any(x[0] < s[2] and s[0] < x[2] for x in base)]
    return out


def test_query_against_brute_force(spark, small, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    terms = brute_terms(rows)
    got = {r.doc_id: r for r in registry.op4_pii(spark, small).collect()}
    assert len(got) == len(rows)
    for r in rows:
        base = brute(r[1])
        mine = got[r[0]]
        kinds = [sum(s[1] == k for s in base) for k in range(4)]
        assert [mine.n_email, mine.n_ip, mine.n_card, mine.n_phone] == kinds
        assert mine.base_sha256 == hashlib.sha256(spans_text(base).encode()).hexdigest()
        assert mine.spans == spans_text(sorted([s[:3] for s in base] + terms[r]))
    assert any(brute(t) for _, t in rows)


def test_secrets_are_added_and_clean_documents_left_alone(spark):
    path = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = {r.doc_id: r.spans for r in registry.op4_pii(spark, path).collect()}
    terms = brute_terms([(i, t) for i, t in texts.items()])
    secret = {i for i, t in texts.items() if re.search(SECRET, t)}
    assert len(secret) > 5 and all("term:" in got[i] for i in secret)
    for i, text in texts.items():
        assert got[i] == spans_text(sorted([s[:3] for s in brute(text)] + terms[i, text]))
    assert not [i for i, t in texts.items() if got[i] and i not in secret and not brute(t) and not terms[i, t]]


def test_patterns_random(spark):
    rng = random.Random(5)
    pieces = ["a", "b.c", "@", ".", "..", "-", "1", "22", "4539 1488", "0343-6467", "+1", " ", "  ", "(", ")", "255", "256.", "1.2.3.4", "x@y.z", "_", "é", "\n", "+49 170 1234567", "4111111111111111"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    texts += ["a@b.c_d@e.f", "a@b.c..d@e.f", "a@b.co.", "1.2.3.4.5.6.7.8", "0001.2.3.255", "1.2.3.4444", "x" * 30000, "1 " * 20000, "a@" + "b." * 20000 + "c", "9" * 50000, "1." * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = df.select("doc_id", pii.base_mentions(F.col("text")).alias("m")).collect()
    for r in got:
        want = [s[:3] for s in brute(texts[r.doc_id])]
        assert [(m.start, m.kind, m.end) for m in r.m] == want, texts[r.doc_id][:200]


def people(n=60):
    rng = random.Random(9)
    words = ["".join(rng.choices("bcdfglmnrst", k=6)) for _ in range(400)]
    rows = []
    for k in range(n):
        body = " ".join(rng.choices(words, k=40))
        if k % 6 == 0:
            body += " kapitan ask zorgblat at jo.doe@mail.example.org or write"
        elif k % 5 == 0:
            body += " kapitan ask someone or write at noon"
        rows.append((k, body))
    return rows


def test_terms_that_reveal_an_entity_are_added(spark):
    rows = people()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    terms = brute_terms(rows)
    for r in pii.find_pii(df).collect():
        text = dict(rows)[r.doc_id]
        assert [(s.start, s.kind, s.end) for s in r.spans if s.kind == 4] == terms[r.doc_id, text]
        assert ("zorgblat" in {text[s.start : s.end] for s in r.spans if s.kind == 4}) == (r.doc_id % 6 == 0)
        assert "kapitan" not in {text[s.start : s.end] for s in r.spans if s.kind == 4}
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    for k, text in rows:
        if k % 6:
            assert clean[k] == text
        else:
            assert "@" not in clean[k] and "[EMAIL]" in clean[k] and "zorgblat" not in clean[k]


def test_sanitised_text_has_no_base_span(docs, odd, empty):
    for frame in (docs, odd, empty):
        got = pii.sanitise(frame)
        assert got.columns == frame.columns and got.count() == frame.count()
        for r in got.collect():
            assert not [s for s in brute(r.text) if s[1] in (0, 1)]
    before = {r.doc_id: r for r in docs.collect()}
    terms = brute_terms([(i, r.text) for i, r in before.items()])
    for r in pii.sanitise(docs).collect():
        if not brute(before[r.doc_id].text) and not terms[r.doc_id, before[r.doc_id].text]:
            assert r == before[r.doc_id]


def test_odd_rows_and_plan(odd, empty):
    assert pii.find_pii(odd).count() == odd.count()
    assert pii.find_pii(empty).count() == 0
    plan = pii.find_pii(odd)._jdf.queryExecution().toString()
    assert "ArrowEval" not in plan and "BatchEval" not in plan and "InPandas" not in plan


def test_long_texts_of_numbers(spark):
    """Megabytes of numbers, of addresses and of one term take seconds, and every place is found."""
    ips = " ".join(f"10.{k // 250 % 250}.{k % 250}.7" for k in range(15_000))
    mail = " ".join(f"a{k}@b{k % 7}.example.org zorgblat" for k in range(5_000))
    rows = [(1, "12, " * 200_000), (2, ips), (3, mail), (4, "token = 'zorgblat77' " + "zorgblat77 " * 10_000), (5, "4111 1111 1111 1111 " * 20_000)]
    rows += [(k, f"other words {k}") for k in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.time()
    spans = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert time.time() - began < 120
    for i, text in rows[:3]:
        assert [(m.start, m.kind, m.end) for m in spans[i].base] == [s[:3] for s in brute(text)]
    assert len(spans[4].spans) == 10_001 and len(spans[2].base) == 15_000
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[1] == rows[0][1] and clean[2] == " ".join(["[IP]"] * 15_000) and "zorgblat" not in clean[4]
    assert clean[3].count("[EMAIL]") == 5_000


def test_running_sums_and_maxima(spark):
    rng = random.Random(3)
    rows = [(k, [rng.randint(0, 9) for _ in range(n)]) for k, n in enumerate((0, 1, 255, 256, 257, 5000))]
    df = spark.createDataFrame(rows, "k int, v array<int>")
    got = df.select("k", pii.running(F.col("v"), lambda a, b: a + b).alias("s"), pii.running(F.col("v"), F.greatest).alias("m")).collect()
    for r in got:
        assert r.s == list(accumulate(rows[r.k][1])) and r.m == list(accumulate(rows[r.k][1], max))


def test_overlapping_spans_become_one(spark):
    text = "x" * 10 + "+49 10.1.2.3 4567 tail"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(y).alias("by")) for a, b, y in ((0, 2, "A"), (2, 4, "B"), (5, 9, "C"), (6, 7, "D"), (8, 12, "E"), (12, 12, "F"))])
    assert df.select(pii.replaced(F.col("text"), spans)).first()[0] == "ABxCF" + text[12:]
