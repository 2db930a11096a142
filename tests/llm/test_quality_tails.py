import base64
import random

import pytest

from pulsegrid.llm import quality_rules as q


def prose(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(600)]
    return " ".join(rng.choices(vocabulary, k=n))[:n]


def noise(n):
    return base64.b64encode(random.Random(2).randbytes(n)).decode()[:n]


@pytest.mark.parametrize(("good", "junk"), [(4096, 4095), (8192, 4095), (16384, 8191), (2048, 2047), (1024, 1023)])
def test_junk_in_the_tail_only_is_seen(good, junk):
    assert q.judge_texts([prose(good + junk)])[0][6]
    assert not q.judge_texts([prose(good) + " " + noise(junk - 1)])[0][6]


def test_chunks_cover_every_byte():
    for n in [*range(1024, 9000, 37), 4095, 4096, 4097, 8191, 8192, 12287, 50001]:
        starts, size, _ = q.chunks_of(n, q.CHUNK_BYTES, q.CHUNK_BAND)
        assert {i for a in starts for i in range(a, a + size)} == set(range(n))
    assert q.chunks_of(1023, q.CHUNK_BYTES, q.CHUNK_BAND)[0] == []
