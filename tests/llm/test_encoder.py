"""The encoder of op6 and op7 against the tokenizers library: the same ids, in less CPU time."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from cadenza.llm import pfor
from cadenza.llm.queries import tokenizer_path
from cadenza.llm.tokenized import library_encoder


def spec() -> str:
    with open(tokenizer_path(), encoding="utf-8") as f:
        return f.read()


def cpu_seconds(run) -> float:
    began = time.process_time()
    run()
    return time.process_time() - began


def test_new_pre_tokens_take_less_time_than_encodings_of_each():
    """An `Encoding` per pre-token took the largest part of op6's time."""
    rng = random.Random(3)
    parts = ["th", "er", "on", "an", "re", "ing", "ble", "sh", "wh", "tion", "ä", "ou"]
    words = list(dict.fromkeys(" " + "".join(rng.choices(parts, k=rng.randrange(3, 8))) for _ in range(60_000)))
    tokenizer, encoder = Tokenizer.from_str(spec()), library_encoder(spec())
    third = len(words) // 3
    times = [(cpu_seconds(lambda w=w: encoder.encode([x.encode() for x in w])), cpu_seconds(lambda w=w: [e.ids for e in tokenizer.encode_batch_fast(w, add_special_tokens=False)])) for w in (words[i * third : (i + 1) * third] for i in range(3))]
    assert sorted(ours / theirs for ours, theirs in times)[1] < 0.75


def test_ids_of_odd_pre_tokens_are_those_of_the_library():
    rng = random.Random(4)
    letters = ["a", "Z", " ", "  ", "\n", "\t", " ", "　", "'s", "'", "7", "½", "é", "é", "ß", "漢", "😀", "\x00", "\x7f", "ÿ", "Ā", "Ġ", "<|endoftext|>", "<|", "|>", "_", "-"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(3000)] + [None, "", "<|endoftext|>" * 3, "ab" * 30_000, " " * 5000]
    tokenizer = Tokenizer.from_str(spec())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    for part in (texts, texts[::-1]):  # the second time from what is remembered
        ids, at = library_encoder(spec())(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]


def test_blocks_of_every_width_round_trip():
    rng = np.random.default_rng(5)
    for width in range(33):
        for n in (1, 7, 1024):
            ids = rng.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
            assert pfor.unpack_block(memoryview(pfor.pack_block(ids)), n).tolist() == ids.tolist()
