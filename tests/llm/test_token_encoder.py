"""The encoder of token records: how much the library is asked, and that the cuts leave its ids as they are."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from websieve.llm import token_records as tr

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()] + ["\u180e", "\u200b", "\u0084"]
OTHERS = [*"abC9É×÷ñ²字、”…€«д.,!'_&", "'s", "'re", "the", "\u0301", "😀", "\x00", "\x7f", "<|endoftext|>"]


def expected(text):
    return np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class Counted:
    """A tokenizer that counts the strings it is asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.strings = tokenizer, 0

    def encode_batch_fast(self, texts, **more):
        self.strings += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **more)


def letters(k):
    return "".join("abcdefghij"[int(d)] for d in str(k))


@pytest.mark.parametrize("form", ["x{}%%%", "x{}&c", "я{}", "字{}", "{}é!?", "x{}.\nY{}"])
def test_new_pieces_go_together(form):
    """Pieces of all sorts share a call; one string for each was what took the time."""
    text = " ".join(["start", *(form.format(letters(k), letters(k)) for k in range(2000))])
    enc = tr.Encoder(PATH)
    enc.tokenizer = counted = Counted(enc.tokenizer)
    assert enc.encode(text) == expected(text)
    assert counted.strings < 50
    assert enc.encode(text) == expected(text) and counted.strings < 50


def test_cuts_leave_the_librarys_ids():
    draw = random.Random(7)
    encoders = [tr.Encoder(PATH), tr.Encoder(PATH, remember=20, block=3)]
    for _ in range(300):
        texts = ["".join(draw.choices([*SPACES, *OTHERS, *" \n" * 15], k=draw.choice([0, 1, 2, 3, 8, 40]))) for _ in range(draw.choice([1, 2, 20]))]
        for enc in encoders:
            assert enc.encode_all(texts) == [expected(t) for t in texts]


def test_rows_of_a_slice():
    texts = ["cut off", None, "a b", "", "x <|endoftext|> y", None, "c. d", "cut off"]
    enc = tr.Encoder(PATH)
    for column in (pa.array(texts), pa.array(texts, pa.large_string())):
        ids, ends = enc.rows(column.slice(1, 6))
        assert [p.tobytes() for p in np.split(ids, ends[:-1])] == [expected(t or "") for t in texts[1:7]] and ends[-1] == len(ids)
        assert [len(x) for x in enc.rows(column.slice(0, 0))] == [0, 0]
    assert enc.encode_all([]) == []


def test_memory_is_bounded_by_ids():
    """Long pieces don't fill the memory although they are few."""
    enc = tr.Encoder(PATH, remember=100)
    texts = [" " + letters(k) * 300 for k in range(10, 40)]
    for t in texts:
        assert enc.encode(t) == expected(t)
        assert len(enc.pool) <= 800 or len(enc.memory) == 1
