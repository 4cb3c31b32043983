"""Ids of whole texts by the tokenizers library, which sees each distinct pre-token once per chunk of rows.

Its model is asked for the tokens of each pre-token. That makes no `Encoding` per
pre-token, which costs more than the merges; the ids are those of `encode`.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
from pyspark.sql import SparkSession

from .pretokens import WordEncoder, byte_letters

#: A byte that is in no UTF-8 text.
BETWEEN = 0xFF


@cache
def library_encoder(spec: str) -> WordEncoder:
    """One encoder per worker; pre-tokens are encoded apart from each other, as the library itself does."""
    import json

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    told = json.loads(spec)
    pre = told.get("pre_tokenizer") or {}
    if told["model"]["type"] != "BPE" or told.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
    tokenizer = Tokenizer.from_str(spec)
    model = tokenizer.model
    special = {t["content"].encode(): [t["id"]] for t in told.get("added_tokens", [])}
    if len(special) > 1:
        raise ValueError("one special token at most is supported")
    spelled = np.array([ord(c) for c, _ in sorted(byte_letters().items(), key=lambda x: x[1])], "<u2")
    between = chr(spelled[BETWEEN])

    def encode(words: list[bytes]) -> list[list[int]]:
        raw = np.frombuffer(bytes([BETWEEN]).join(words), np.uint8)
        tokenize = model.tokenize
        out = [[t.id for t in tokenize(w)] for w in spelled[raw].tobytes().decode("utf-16-le").split(between)]
        for token, ids in special.items():
            out = [ids if w == token else x for w, x in zip(words, out, strict=True)] if token in words else out
        return out

    return WordEncoder(encode, next(iter(special), None))


def broadcast_spec(spark: SparkSession, path: str):
    """The tokenizer file for the executors: 1.5 MB, whatever the input."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())
