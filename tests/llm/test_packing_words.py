"""Words of the packing operator: what its memory takes, and that forgotten, joined and cut words keep their ids."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tracequarry.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_new_words_take_few_bytes_and_few_calls():
    enc, rng, calls = packing.Encoder(PATH), random.Random(3), []
    own = enc._encode
    enc._encode = lambda texts: calls.append(len(texts)) or own(texts)
    words = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(100_000)]
    texts = pa.array([" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)])
    packing._words.polynomial(np.zeros(1 << 20, np.uint64), np.array([0]), np.array([1]))  # tables that all operators share
    tracemalloc.start()
    enc.encode(texts)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 12 << 20  # a Python object for each word and part took over 20 MB
    assert sum(calls) < 100  # 100,000 distinct words


def test_words_agree_with_the_tokenizer_when_forgotten():
    enc, plain, rng = packing.Encoder(PATH), Tokenizer.from_file(PATH), random.Random(5)
    enc.most, enc.call = 40, 64
    alphabet = ["a", "Ab", "the", "ing", " ", " ", "\n", "\r\n", "\t", "ß", "1", "'s", "'ll", "'", "-", ".", ",", " ", "　", "́", "\x1c", "\x00", "²", "中文", "<|endoftext|>", "😀"]
    for _ in range(12):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, "", " ", "\n", "x" * 70]
        assert enc.encode(pa.array(texts)) == [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert len(enc.known.hashes) < 10_000
