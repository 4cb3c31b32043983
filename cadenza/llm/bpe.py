"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a pre-token exactly one token can end its encoding. The
tokens that are suffixes of the prefix come from an automaton over the
vocabulary; the one whose predecessor (the last token of the shorter prefix)
forms a compatible pair with it is stored. Back-pointers then give the ids.
A pair (a, b) is compatible when BPE leaves the text of a + b as exactly a, b.

Each text is read once, in its partition; nothing is shuffled. Time is linear
in the text, also for one pre-token of millions of letters.

Nulls and empty texts have no ids. Repeated rows give repeated results. Other
columns of the input are ignored, so none can clash.
"""

from __future__ import annotations

import hashlib
import json
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import WordEncoder, byte_letters, ragged
from .shared import map_text

#: Pairs, and distinct pre-tokens of a generation, that a worker remembers.
REMEMBERED_PAIRS, REMEMBERED_WORDS = 300_000, 120_000
NEVER = 1 << 60


class BpeModel:
    """A vocabulary with its merges, read from the text of a tokenizers JSON file."""

    def __init__(self, text: str) -> None:
        import ahocorasick

        spec = json.loads(text)
        model, letters = spec["model"], byte_letters()
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
        vocab: dict[str, int] = model["vocab"]
        self.bytes = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if all(c in letters for c in token)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if len(self.special) > 1:
            raise ValueError("one special token at most is supported")
        #: Pre-tokens that are one token whatever they spell.
        self.whole = {token.encode(): i for token, i in self.special.items()}
        self.bytes |= {i: token for token, i in self.whole.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(pair, rank)
            self.made.setdefault(whole, (*pair, rank))
        self.automaton = ahocorasick.Automaton()
        for i, b in self.bytes.items():
            if i in self.made or len(b) == 1:
                self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        size = max(self.bytes) + 1
        lengths = np.zeros(size, np.int64)
        for i, b in self.bytes.items():
            lengths[i] = len(b)
        self.spelled_at = np.concatenate([[0], np.cumsum(lengths)])
        self.spelled = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(size)), np.uint8)
        self.edges_right: dict[int, list[tuple[int, int]]] = {}
        self.edges_left: dict[int, list[tuple[int, int]]] = {}
        self.pairs: dict[int, bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one edge of a token (0 left, 1 right) while it is built, each with the rank of the merge that takes it."""
        out, taken = [], NEVER
        while True:
            out.append((token, taken))
            if token not in self.made:
                return out
            taken = self.made[token][2]
            token = self.made[token][side]

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge crosses between a and b while each is built.

        A merge of two edge pieces happens if its rank comes before the merges
        that take them. Of equal ranks the leftmost merge is first.
        """
        right = self.edges_right.get(a)
        if right is None:
            right = self.edges_right[a] = self.edge(a, 1)
        left = self.edges_left.get(b)
        if left is None:
            left = self.edges_left[b] = self.edge(b, 0)
        rank = self.rank.get
        for x, x_taken in right:
            for y, y_taken in left:
                r = rank((x, y))
                if r is not None and r < x_taken and r <= y_taken:
                    return False
        return True

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the unique last token of each prefix, then back along them."""
        special = self.whole.get(word)
        if special is not None:
            return [special]
        last, size = [-1] * len(word), [0] * len(word)
        pairs = self.pairs
        for end, (token, n) in self.automaton.iter(word.decode("latin-1")):
            if last[end] >= 0:
                continue
            before = end - n
            if before >= 0:
                key = last[before] << 32 | token
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.compatible(last[before], token)
                if not fits:
                    continue
            last[end], size[end] = token, n
        out, at = [], len(word) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        if len(self.pairs) > REMEMBERED_PAIRS:
            self.pairs.clear()
        one = self.encode_word
        return [one(w) for w in words]

    def encoder(self) -> WordEncoder:
        special = next(iter(self.special), None)
        return WordEncoder(self.encode_words, special.encode() if special else None, REMEMBERED_WORDS)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids spell."""
        begin = self.spelled_at[ids]
        return self.spelled[ragged(begin, self.spelled_at[ids.astype(np.int64) + 1] - begin)]


@cache
def _model(text: str) -> BpeModel:
    return BpeModel(text)


@cache
def _encoder(text: str) -> WordEncoder:
    return _model(text).encoder()


def read_model(path: str) -> str:
    """The tokenizer file, read once on the driver; 1.5 MB, whatever the input."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_and_decode(docs: DataFrame, path: str, doc_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Ids of each text and the text that they decode to.

    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers), decoded_sha256, and with `with_ids` also ids and decoded.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_model(path))  # of a fixed size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, encoder = _model(spec.value), _encoder(spec.value)
        ids, at = encoder(batch.column("text"))
        text = model.decode(ids)
        size = np.concatenate([[0], np.cumsum(model.spelled_at[ids.astype(np.int64) + 1] - model.spelled_at[ids])])[at]
        raw, spelled = memoryview(ids.astype("<u4")).cast("B"), memoryview(text)
        decoded = [bytes(spelled[a:b]).decode("utf-8", "replace") for a, b in zip(size[:-1], size[1:], strict=True)]
        columns = [
            batch.column("doc_id"),
            pa.array(np.diff(at), pa.int64()),
            pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
        ]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns += [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(decoded)]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)[doc_col]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return map_text(docs.selectExpr(f"`{doc_col}` as doc_id", f"`{text_col}` as text"), run, schema)
