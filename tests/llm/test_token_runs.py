"""Ids of runs of texts, whose words are parted from their closing signs and looked up once."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fathomwire.llm.common import text_slices
from fathomwire.llm.tokens import TextEncoder, parted


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_runs_equal_the_tokenizer(name):
    plain, mine, rng = Tokenizer.from_file(public_tokenizers.path(name)), TextEncoder(public_tokenizers.path(name)), random.Random(6)
    signs = "aAhHtTkKéßñÄ .,;:'’-_^`|>0129\n\n\t ̸̱́̊İΣσ日#$%!?&*(=\x1c"
    texts = ["", "it's, don't. 'S,", "H̱. T̈, a.̸ ≠ b.Σ Σ. aΣ, K̊", " ", "\n\n", "end.", ".start", "x" * 70 + ",", "ab," * 30]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    marked = ["<|endoftext|>a, <|ENDOFTEXT|>. <|startoftext|>,", "a< b<, <", *texts[:200]]
    for own in (texts, marked, [""], ["a,"]):
        for most in (100, 1 << 20):
            for i, j, data, off in text_slices(pa.array(own), most):
                ids, bounds = mine.many(data, off)
                got = [ids[s:e].tolist() for s, e in zip(bounds, bounds[1:], strict=False)]
                assert got == [plain.encode(t, add_special_tokens=False).ids for t in own[i:j]]


def test_fewer_words_are_looked_up():
    """A word in many forms costs one look at the tokenizer, not one for each form."""
    mine = TextEncoder(public_tokenizers.path("word_bpe_49k.json"))
    made = []
    mine.parts.make, make = lambda w: made.append(w) or make(w), mine.parts.make
    for _, _, data, off in text_slices(pa.array(["garden Garden garden, (garden GARDEN. garden; garden\n" * 50])):
        mine.many(data, off)
    assert sorted(made) == ["", "(garden", ",", ".", ";", "garden"]


def test_parted():
    text = "One, two.. a.b c' dé! É, x,́ y,"
    data, off = parted(np.frombuffer(text.encode(), np.uint8), np.array([0, 5, len(text.encode())]))
    assert data.tobytes().decode() == "one , two .. a.b c' dé! É, x,́ y ,"
    assert off.tolist() == [0, 6, len(data)]
