import random
import re
from collections import Counter

from pulsegrid.llm import quality_rules as q
from pulsegrid.llm import registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def rows(df):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return sorted((tuple([r["doc_id"]] + [r[n] for n in names]) for r in df.collect()), key=repr)


def test_base_counts_match_brute_force(spark, small, docs, odd, empty):
    for frame, got in ((docs, registry.op9_quality_rules(spark, small)), (odd, q.quality_rules(odd))):
        want = sorted(((r.doc_id, *brute(r.text)) for r in frame.collect()), key=repr)
        assert rows(got) == want
    assert q.quality_rules(empty).count() == 0


def test_repeated_words_random():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        assert q.repeated_words(words) == brute(" ".join(words))[4]


def test_bands_reject_repetition_and_noise_and_keep_prose(spark):
    rng = random.Random(1)
    letters = "etaoinshrdlu"
    vocabulary = ["".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(3000)]
    prose = " ".join(rng.choices(vocabulary, k=1500))
    noise = " ".join("".join(rng.choices([chr(c) for c in range(33, 0x250)], k=9)) for _ in range(900))
    shuffled = ["alpha", "beta", "gamma", "delta"]
    repetitive = " ".join(rng.choice(shuffled) for _ in range(30)) + " " + " ".join(f"{k % 7}" for k in range(4000))
    spoiled = prose + " " + " ".join(str(k % 10) for k in range(6000))
    df = spark.createDataFrame([(1, prose), (2, noise), (3, repetitive), (4, spoiled)], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in q.quality_rules(df).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}
    assert [r.doc_id for r in q.keep_good(df).collect()] == [1]
    assert q.keep_good(df).columns == df.columns
