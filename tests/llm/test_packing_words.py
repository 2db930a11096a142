"""Plain words are encoded by the vocabulary's merges alone, as the library encodes them."""

import random
import struct

import pytest

from pulsegrid.llm import packing
from pulsegrid.llm.bpe import default_path

PATH = default_path("word_bpe_49k.json")
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"


def ids(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_random_words_are_the_librarys(library):
    rng = random.Random(4)
    words = ["".join(rng.choices(LETTERS, k=rng.randint(1, 14))) for _ in range(5_000)]
    words += [w.upper() for w in words[:300]] + [w + rng.choice("̈̀ÉŒœ÷×µªº­") + "a" for w in words[:300]]
    encoder = packing.Encoder(PATH)
    for w in words:
        (got,) = encoder.encode([w.encode()])
        assert ids(got) == library.encode(w, add_special_tokens=False).ids, w


def test_plain_words_need_only_merges(library):
    text = "the über façade, of many naïve words. and Some more words"
    encoder = packing.Encoder(PATH)

    class Refuses:
        def encode(self, chunk, **_):
            assert not chunk.isalpha(), chunk
            return library.encode(chunk, **_)

    encoder.tokenizer = Refuses()
    (got,) = encoder.encode([text.encode()])
    assert ids(got) == library.encode(text, add_special_tokens=False).ids
