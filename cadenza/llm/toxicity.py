"""Toxic spans by a linear-chain conditional random field over words.

Labels are of documents, so words are labelled first. From a bounded sample of
labelled documents, cues are taken: words or beginnings of words that clean documents
hardly have, first those in many different contexts, then one by one those that
explain most toxic documents not yet explained. Words with a cue in a toxic document are toxic, all
others clean. The field is fitted to these words by its likelihood; its features
are the word and its beginnings, hashed, so unseen forms of a stem count too.

Marginals come from the forward-backward recursions. For two labels each is a
chain of fractional linear maps of one ratio, so all words of a chunk of texts are
done in blocks: maps of each block are composed, then the blocks are chained, then
filled in, exactly. A logistic function of the two summaries of a document (its
greatest marginal and the expected number of toxic words among those whose marginal is
above 0.1) is its score, fitted on the part of the sample that the field did not see.

The sample of each label has whole documents in the order of a hash, SAMPLE at most, until
they have CHARS characters; a document of more than LONGEST characters does not teach, so the
sample has less than CHARS and LONGEST. All texts are scored whole where they are; nothing else is moved.

Nulls and texts without words have the score of no evidence and no spans. Repeated
rows are scored each. Without labels of both kinds every score is 0. A doc_id with
several labels is toxic if one of them is. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .langid import held_out
from .pretokens import ragged, text_bytes
from .shared import hash_share, map_text

#: Documents of each label in the sample, and characters until which they are taken.
SAMPLE, CHARS = {1: 2000, 0: 2500}, {1: 2_400_000, 0: 4_000_000}
#: Characters of the longest document that teaches.
LONGEST = 1_000_000
#: Features: beginnings of so many bytes, the whole word, the words before and after it, all hashed to 2**HASH_BITS weights.
STEMS, HASH_BITS = (4, 5, 6, 8), 18
#: So many forms may be cues by chance alone; a cue is in clean documents at most at RATE of the toxic ones.
CHANCE, RATE = 0.5, 0.05
ROUNDS, STEP, DECAY, BLOCK = 30, 0.5, 1e-4, 64
#: Share of the words whose own forms are hidden in training.
HIDDEN = 0.1
#: A score from which a document counts as toxic, and a marginal from which a word does.
TOXIC, SPAN = 0.7, 0.5

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals as small letters; the number of bytes stays."""
    out = _LOWER[data]
    capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    out[capital] += 0x20
    return out


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text its first word, with the end."""
    word = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    padded = np.concatenate([[False], word, [False]])
    begin = np.flatnonzero(word & (~padded[:-2] | edge[:-1]))
    close = np.flatnonzero(word & (~padded[2:] | edge[1:])) + 1
    return begin, close, np.searchsorted(begin, offsets)


def features(data: np.ndarray, begin: np.ndarray, close: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Weight indices of each word, one row for each kind of feature; 0 where the word has no such feature.

    `first` marks the first words of texts, which have no neighbour before them.
    """
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = close - begin
    head = eight[begin + 8] & _MASK[np.minimum(size, 8)]
    tail = eight[close] >> (np.uint64(64) - np.uint64(8) * np.minimum(size, 7).astype(np.uint64))
    shift, odd = np.uint64(64 - HASH_BITS), np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros((len(STEMS) + 3, len(begin)), np.int32)
    for k, n in enumerate(STEMS):
        mixed = ((head & _MASK[n]) ^ np.uint64(n)) * odd
        out[k] = np.where(size > n, ((mixed ^ (mixed >> np.uint64(29))) * odd) >> shift, 0)
    mixed = (head * odd) ^ (tail * np.uint64(0xC2B2AE3D27D4EB4F)) ^ size.astype(np.uint64)
    out[-3] = ((mixed ^ (mixed >> np.uint64(29))) * odd) >> shift
    if len(begin):
        before, after = mixed[:-1] * np.uint64(3), mixed[1:] * np.uint64(5)
        out[-2, 1:] = np.where(first[1:], 0, ((before ^ (before >> np.uint64(29))) * odd) >> shift)
        out[-1, :-1] = np.where(first[1:], 0, ((after ^ (after >> np.uint64(29))) * odd) >> shift)
    return out


def added(weights: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The sum of each word's weights, one kind of feature after the other."""
    out = weights[index[0]]
    for row in index[1:]:
        out += weights[row]
    return out


def chain(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """x[t] = (a[t] + b[t] x[t-1]) / (c[t] + d[t] x[t-1]), where the first must not depend on x."""
    n = len(a)
    rows = -(-n // BLOCK)
    pad = rows * BLOCK - n
    a, b, c, d = (np.concatenate([x, np.full(pad, v)]).reshape(rows, BLOCK).T.copy() for x, v in ((a, 0.0), (b, 1.0), (c, 1.0), (d, 0.0)))
    # numerator and denominator as linear in x of the block before
    p, q, r, s = (np.full(rows, v) for v in (0.0, 1.0, 1.0, 0.0))
    for t in range(BLOCK):
        p, q, r, s = a[t] * r + b[t] * p, a[t] * s + b[t] * q, c[t] * r + d[t] * p, c[t] * s + d[t] * q
        top = np.maximum(np.maximum(p, q), np.maximum(r, s))
        p, q, r, s = p / top, q / top, r / top, s / top
    x, before = 1.0, np.empty(rows)
    for i, (w, y, z, v) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        before[i] = x
        x = (w + y * x) / (z + v * x)
    out = np.empty((BLOCK, rows))
    x = before
    for t in range(BLOCK):
        x = (a[t] + b[t] * x) / (c[t] + d[t] * x)
        out[t] = x
    return out.T.reshape(-1)[:n]


@dataclass
class Field:
    """weights of features, then transition[from, to] and start[to] as logarithms, and the logistic function of a document."""

    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    logistic: np.ndarray

    def ratios(self, score: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward messages of label 1 over those of label 0."""
        e, t, s = np.exp(np.clip(score, -30, 30)), np.exp(self.transition), np.exp(self.start)
        forward = chain(np.where(first, e * s[1], e * t[0, 1]), np.where(first, 0.0, e * t[1, 1]), np.where(first, s[0], t[0, 0]), np.where(first, 0.0, t[1, 0]))
        last = np.append(first[1:], True)
        after = np.append(e[1:], 1.0)
        backward = chain(*(x[::-1] for x in (np.where(last, 1.0, t[1, 0]), np.where(last, 0.0, after * t[1, 1]), np.where(last, 1.0, t[0, 0]), np.where(last, 0.0, after * t[0, 1]))))[::-1]
        return forward, backward

    def marginals(self, index: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not index.shape[1]:
            return np.zeros(0)
        forward, backward = self.ratios(added(self.weights, index), first)
        odds = forward * backward
        return odds / (1 + odds)

    def summary(self, marginal: np.ndarray, of_text: np.ndarray) -> np.ndarray:
        """For each text: the log-odds of its greatest marginal, the logarithm of one plus the expected toxic words, and 1."""
        out = np.zeros((len(of_text) - 1, 3))
        out[:, 0], out[:, 2] = -12.0, 1.0
        full = np.flatnonzero(np.diff(of_text))
        if len(full):
            p = np.clip(np.maximum.reduceat(marginal, of_text[full]), 6e-6, 1 - 6e-6)
            out[full, 0] = np.log(p / (1 - p))
            out[full, 1] = np.log1p(np.add.reduceat(np.where(marginal > 0.1, marginal, 0.0), of_text[full]))
        return out

    def score(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary @ self.logistic, -30, 30)))


def forms_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each word's forms, which are the word as a whole and its beginnings (-1 where it has none), and how long each form is."""
    names: dict[bytes, int] = {}
    out = np.full((len(words), len(STEMS) + 1), -1, np.int64)
    for i, w in enumerate(words):
        out[i, 0] = names.setdefault(b"=" + w, len(names))
        for k, n in enumerate(STEMS, 1):
            if len(w) > n:
                out[i, k] = names.setdefault(w[:n], len(names))
    return out, np.fromiter(map(len, names), np.int64, len(names))


def find_cues(forms: np.ndarray, length: np.ndarray, word: np.ndarray, doc: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Forms that mark toxic documents, as a mask, from the words of documents in a row.

    Forms that clean documents hardly have are cues if they are in `strong` toxic
    documents and stand between as many different pairs of words: a form that copies
    repeat always stands between the same two. `strong` is the least number that hardly any
    form reaches by chance, by the share of toxic documents. Then come forms that
    explain seven tenths as many documents that have no cue yet.
    """
    edge = np.append(True, doc[1:] != doc[:-1])
    left = np.where(edge, 0, np.append(0, word[:-1] + 1))
    right = np.where(np.append(edge[1:], True), 0, np.append(word[1:] + 1, 0))
    pairs = []
    for kind in forms.T:  # one kind at once, for the memory; kinds share no form
        here = kind[word]
        pairs.append(np.unique(here[here >= 0] * len(labels) + doc[here >= 0]))
    pairs = np.concatenate(pairs)
    of, at = pairs // len(labels), pairs % len(labels)
    toxic, clean = (np.bincount(of[labels[at] == y], minlength=len(length)) for y in (1, 0))
    total = np.bincount(labels[np.unique(doc)], minlength=2)
    share = min(0.9, (total[1] + 1) / (total.sum() + 2))
    strong = max(3, math.ceil(math.log(len(length) / CHANCE) / -math.log(share)))
    least = max(3, math.ceil(0.7 * strong))
    able = (toxic >= least) & (clean * (total[1] / max(1, total[0])) <= RATE * toxic)
    size, marked = len(forms) + 1, labels[doc] == 1
    spread = np.zeros(len(length), np.int64)
    for kind in forms.T:
        here = kind[word]
        near = marked & (here >= 0) & able[here]
        spread += np.bincount(np.unique((here[near] * size + left[near]) * size + right[near]) // size**2, minlength=len(length))
    cues = able & (toxic >= strong) & (spread >= strong)
    some = able[of] & (labels[at] == 1)
    having: dict[int, set[int]] = defaultdict(set)
    for f, d in zip(of[some].tolist(), at[some].tolist(), strict=True):
        having[f].add(d)
    open_docs = set(np.flatnonzero(labels == 1).tolist()).difference(*(having.pop(f) for f in np.flatnonzero(cues).tolist()))
    having = {f: d for f, d in having.items() if spread[f] >= least}
    while having:
        # the longer form of equal reach is the narrower one
        best = max(having, key=lambda f: (len(having[f] & open_docs), length[f], f))
        if len(having[best] & open_docs) < least:
            break
        cues[best] = True
        open_docs -= having.pop(best)
    return cues


def fit(sample: list[tuple[str, int]]) -> Field | None:
    """A field from texts with labels; None if one of the labels is missing."""
    sample = sorted({text: label for text, label in sorted(sample)}.items())
    if len({label for _, label in sample}) < 2:
        return None
    data, offsets = text_bytes(pa.array([t for t, _ in sample], pa.string()))
    data, labels = lower(data), np.array([y for _, y in sample])
    begin, close, of_text = find_words(data, offsets)
    size = close - begin
    tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(data[ragged(begin, size)])]).dictionary_encode()
    word, owner = np.asarray(tokens.indices).astype(np.int64), np.repeat(np.arange(len(sample)), np.diff(of_text))
    spread = np.random.default_rng(7).permutation(len(sample)) % 4
    seen = spread > 0  # a quarter is left for the logistic function
    use = seen[owner]
    forms, length = forms_of(tokens.dictionary.to_pylist())
    cues = np.append(find_cues(forms, length, word[use], owner[use], labels), False)
    gold = cues[forms].any(1)[word] & (labels[owner] == 1)
    first = np.zeros(len(begin), bool)
    first[of_text[:-1][np.diff(of_text) > 0]] = True
    index = features(data, begin, close, first)
    field = Field(np.zeros(1 << HASH_BITS), np.zeros((2, 2)), np.array([0.0, -3.0]), np.zeros(3))
    taught = index[:, use]
    # some words are known by their neighbours alone, so that these learn to tell of words never seen
    taught[:-2, np.random.default_rng(11).random(taught.shape[1]) < HIDDEN] = 0
    _train(field, taught, first[use], gold[use])
    marginal = field.marginals(index, first)
    summary = field.summary(marginal, of_text)
    field.logistic = _logistic(summary[~seen], labels[~seen])
    return field


def _train(field: Field, index: np.ndarray, first: np.ndarray, gold: np.ndarray) -> None:
    """Ascend the likelihood of the labels with steps that adapt to each weight."""
    met = np.zeros(1 << HASH_BITS, bool)
    for row in index:
        met[row] = True
    used = np.flatnonzero(met)
    local = (np.cumsum(met, dtype=np.int32) - 1)[index]
    weights, squares = np.zeros(len(used)), np.full(len(used), 1e-3)
    chain_squares = np.full(6, 1e-3)
    skip = used == 0
    follow = ~first
    before = np.append(False, gold[:-1])
    observed = np.array([[np.sum(follow & ~before & ~gold), np.sum(follow & ~before & gold)], [np.sum(follow & before & ~gold), np.sum(follow & before & gold)]], float)
    opened = np.array([np.sum(first & ~gold), np.sum(first & gold)], float)
    n = max(1, len(gold))
    for _ in range(ROUNDS):
        score = added(weights, local)
        forward, backward = field.ratios(score, first)
        odds = forward * backward
        p = odds / (1 + odds)
        gap = gold - p
        slope = sum(np.bincount(row, gap, len(used)) for row in local) - DECAY * n / 1000 * weights
        squares += slope**2
        weights += STEP * slope / np.sqrt(squares)
        weights[skip] = 0.0
        e, t = np.exp(np.clip(np.log(np.maximum(forward, 1e-300)), -60, 60)), np.exp(field.transition)
        x, y = np.append(1.0, e[:-1]), backward
        emit = np.exp(np.clip(score, -30, 30))
        joint = [np.full(n, t[0, 0]), t[0, 1] * emit * y, t[1, 0] * x, t[1, 1] * x * emit * y]
        whole = joint[0] + joint[1] + joint[2] + joint[3]
        joint = np.array([(j / whole)[follow].sum() for j in joint]).reshape(2, 2)
        change = np.concatenate([(observed - joint).ravel(), opened - [np.sum(1 - p[first]), np.sum(p[first])]])
        chain_squares += change**2
        change = STEP * change / np.sqrt(chain_squares)
        field.transition += change[:4].reshape(2, 2)
        field.start += change[4:]
    field.weights[used] = weights


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a ridge around the greatest marginal itself, by Newton's method."""
    prior = np.array([1.0, 0.0, 0.0])
    w, ridge = prior.copy(), np.diag([1.0, 0.1, 0.1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ (w - prior))
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    w[:2] = np.maximum(w[:2], 0.0)
    return w


def learn(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1) -> Field | None:
    """Fit to a bounded sample of labelled documents that are not held out."""
    rows = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id", parts, part))
    rows = rows.groupBy(F.col("doc_id").alias("_doc_id")).agg(F.max("toxic").alias("_toxic"))
    sizes = {r[0]: r[1] for r in rows.groupBy("_toxic").count().collect()}
    # some of the sampled documents are missing or empty
    share = F.when(F.col("_toxic") == 1, 4 * SAMPLE[1] / max(1, sizes.get(1, 0))).otherwise(4 * SAMPLE[0] / max(1, sizes.get(0, 0)))
    chosen = rows.where(hash_share("_doc_id") < share).withColumn("_n", F.xxhash64("_doc_id"))  # about 4 times SAMPLE
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_doc_id")).where((F.length("text") > 0) & (F.length("text") <= LONGEST))
    first = Window.partitionBy("_toxic").orderBy("_n", F.xxhash64("text"))
    before = F.coalesce(F.sum(F.length("text")).over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    limit, most = (F.when(F.col("_toxic") == 1, x[1]).otherwise(x[0]) for x in (SAMPLE, CHARS))
    numbered = texts.withColumns({"_m": F.row_number().over(first), "_before": before})
    found = numbered.where((F.col("_m") <= limit) & (F.col("_before") < most)).select("text", "_toxic").collect()
    return fit([(t, int(y)) for t, y in found])


def tag(docs: DataFrame, field: Field | None, keep: bool = False) -> DataFrame:
    """doc_id, score, predicted, n_toxic_words, spans of each row; with `keep` instead the rows of `docs` that are not predicted toxic.

    A span has the character offsets start and end of successive words whose marginal is SPAN or more.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)  # 2**HASH_BITS numbers
    inputs = docs.columns if keep else ["doc_id", "text"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        field = sent.value
        data, offsets = text_bytes(batch.column("text"))
        small = lower(data) if len(data) else data
        begin, close, of_text = find_words(small, offsets)
        first = np.zeros(len(begin), bool)
        first[of_text[:-1][np.diff(of_text) > 0]] = True
        if field is None:
            marginal, score = np.zeros(len(begin)), np.zeros(len(offsets) - 1)
        else:
            marginal = field.marginals(features(small, begin, close, first), first)
            score = field.score(field.summary(marginal, of_text))
        if keep:
            return batch.filter(pa.array(score < TOXIC))
        hot = np.flatnonzero(marginal >= SPAN)
        spans: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        before = -2
        for t, text in zip(hot.tolist(), (np.searchsorted(of_text, hot, side="right") - 1).tolist(), strict=True):
            zero = lead[offsets[text]]
            if t == before + 1 and not first[t]:
                spans[text][-1]["end"] = int(lead[close[t]] - zero)
            else:
                spans[text].append({"start": int(lead[begin[t]] - zero), "end": int(lead[close[t]] - zero)})
            before = t
        words = np.bincount(np.searchsorted(of_text, hot, side="right") - 1, minlength=len(offsets) - 1)
        columns = [batch.column("doc_id"), pa.array(score), pa.array((score >= TOXIC).astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(spans, span)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", "n_toxic_words", "spans"])

    rows = docs.select(*[f"`{c}`" for c in inputs])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if keep or f.name != "text")
    return map_text(rows, run, fields if keep else f"{fields}, score double, predicted int, n_toxic_words int, spans array<struct<start:int,end:int>>")
