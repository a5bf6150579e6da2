"""Encoders of ops 2, 3 and 9: what is known is not worked out again, and ids stay those of the libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tidewatch.llm import byte_bpe, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SIGNS = [*"abcABCzéÉß'.,;!#0129 \n\t\r\x85  ̧漢가‍🙂", " ", "'s", "<|", "the", " Word", "tion", "$$$"]


def mixed(n, seed):
    rng = random.Random(seed)
    return ["", *["".join(rng.choices(SIGNS, k=rng.randint(0, 90))) for _ in range(n)], "x" * 5000 + "漢字" * 900, ""]


class Counted(dict):
    tried = 0

    def get(self, *key):
        self.tried += 1
        return super().get(*key)


def test_known_states_try_no_other_starts():
    own = byte_bpe.PrefixEncoder(byte_bpe.prefix_encoder(BYTES).ranks)
    data = " unbelievably internationalisation 012345".encode()
    entries = own.extend([], data)
    for k in range(len(data)):  # appending goes on from a state that is found again
        assert own.extend(entries[:k], data) == entries
    own.ranks = Counted(own.ranks)
    assert own.extend([], data) == own.extend(entries[:20], data) == entries
    assert own.ranks.tried == 0


@pytest.mark.parametrize("pairs", [byte_bpe.CACHE_PAIRS, 50])
def test_byte_ids_and_digests(monkeypatch, pairs):
    import tiktoken

    monkeypatch.setattr(byte_bpe, "CACHE_PAIRS", pairs)
    encoder = byte_bpe.TextEncoder(BYTES, public_tokenizers.PATTERN)
    encoder.prefixes = byte_bpe.PrefixEncoder(encoder.prefixes.ranks)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.prefixes.ranks, special_tokens={})
    for seed in range(3):
        texts = mixed(300, seed)
        ids, sizes = encoder.text_ids(texts)
        said, decoded = encoder.digests(ids, sizes)
        for text, part, a, b in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), said, decoded, strict=True):
            assert part.tolist() == library.encode_ordinary(text)
            assert a == hashlib.sha256(",".join(map(str, part.tolist())).encode()).hexdigest()
            assert b == hashlib.sha256(text.encode()).hexdigest()
        assert len(encoder.prefixes.steps) <= pairs and encoder.prefixes.n_pairs <= pairs
        assert all(len(k) <= tokens.KEPT_CHARS for k in encoder.cache)
    assert list(encoder.encode([])) == []


def test_known_letters_are_not_encoded_again(monkeypatch):
    encoder = tokens.ChunkEncoder(WORDS)
    library = tokens.tokenizer(WORDS)
    list(encoder.encode(["reading élan, now; reading"]))
    asked = []
    own = encoder._words
    monkeypatch.setattr(encoder, "_words", lambda words: asked.extend(words) or own(words))
    text = "Reading, NOW! élan reading### now now."
    assert np.frombuffer(next(encoder.encode([text])), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids
    assert asked == []


def test_word_ids(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)  # starts again many times
    encoder = tokens.ChunkEncoder(WORDS)
    library = tokens.tokenizer(WORDS)
    for seed in range(6):
        texts = mixed(150, seed)
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids
        assert all(len(k) <= tokens.KEPT_CHARS for k in encoder.cache)
        runs = encoder.runs(list(encoder.cache))
        assert sorted(runs.tolist()) == list(range(len(encoder.cache)))
    assert list(encoder.encode([])) == []
