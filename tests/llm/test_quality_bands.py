import math
from collections import defaultdict

import pytest
import zstandard

from pulsegrid.llm import quality_rules as q
from pulsegrid.llm import registry
from tests.llm.test_quality_rules import brute


def quantile(values, share):
    values = sorted(values)
    return values[max(0, math.ceil(share * len(values)) - 1)]


def brute_band(ratios, spreads, prior):
    steps = [round(400 * math.log(x)) / 400 for x in ratios]
    low, middle, high = (quantile(steps, x) for x in (0.25, 0.5, 0.75))
    spread = max(min(middle - low, high - middle), 1 / 400) / 0.6745
    n = len(steps)
    own = math.exp(middle - spreads * spread), math.exp(middle + spreads * spread)
    return [(n * a + 20 * b) / (n + 20) for a, b in zip(own, prior)]


def brute_kept(texts):
    """The verdict on each text, every ratio and band taken anew."""
    press = zstandard.ZstdCompressor(level=3).compress
    raws = [(t or "").encode() for t in texts]

    def chunks(raw):
        n = len(raw)
        if n < 1024:
            return 0, []
        size = 512 if n < 2048 else 1024 if n < 8192 else 4096
        parts = [raw[k : k + size] for k in range(0, n - size + 1, size)] + ([raw[-size:]] if n % size else [])
        return size, [size / len(press(p)) for p in parts]

    whole, of_size = defaultdict(list), defaultdict(list)
    for raw in raws:
        if len(raw) >= 64:
            for near in (-1, 0, 1):
                whole[int(4 * math.log2(len(raw))) + near].append(len(raw) / len(press(raw)))
            size, ratios = chunks(raw)
            of_size[size] += ratios
    out = []
    for text, raw in zip(texts, raws):
        good = not brute(text)[-1]
        if len(raw) >= 64:
            c = int(4 * math.log2(len(raw)))
            first = math.ceil(2 ** (c / 4))
            prior = [b[1:] for b in q.WHOLE_BANDS if b[0] <= first][-1]
            low, high = brute_band(whole[c], 5, prior)
            good &= low <= len(raw) / len(press(raw)) <= high
            size, ratios = chunks(raw)
            if ratios:
                low, high = brute_band(of_size[size], 6, {512: (1.25, 2.8), 1024: (1.35, 3.0), 4096: (1.35, 3.4)}[size])
                good &= sum(not low <= x <= high for x in ratios) <= 0.25 * len(ratios)
        out.append(good)
    return out


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_kept_against_brute_force(spark, scale):
    path = f"/root/testdata/sf{scale}"
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute_kept([r.text for r in rows])))
    assert {r.doc_id: r.kept for r in registry.op9_quality_rules(spark, path).collect()} == want


def test_odd_tables_against_brute_force(odd, empty):
    rows = odd.select("doc_id", "text").collect()
    want = sorted(zip([r.doc_id for r in rows], brute_kept([r.text for r in rows])), key=repr)
    assert sorted(((r.doc_id, r.kept) for r in q.quality_rules(odd).collect()), key=repr) == want
    assert q.corpus_limits(empty) == q.Limits({}, {}) and q.keep_good(empty).count() == 0


def test_bands_catch_bad_documents_and_keep_good_ones(spark):
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    seen = registry.op9_quality_rules(spark, path).where("not base_failed").join(labels, "doc_id").toPandas()
    lost = ~seen.kept
    assert lost[seen.quality == 0].mean() > 0.3
    assert lost[seen.quality == 1].mean() < 0.003


def test_bands_do_not_depend_on_how_rows_are_dealt(docs):
    assert q.corpus_limits(docs.repartition(7)) == q.corpus_limits(docs.coalesce(1))
