"""Searches along a sequence: alignment, posteriors of states, token passing with a beam.

One sequence is one group; its frames arrive sorted. Where groups are many and short
they share calls.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import map_groups
from .pruning import histogram_limits, histogram_prune

ZERO = -1e15
#: Keys are places in an array where it has no more than this many for each row.
DENSE = 16
#: Utterances that are decoded together, so that a frame's tokens stay in a processor's cache.
TOGETHER = 32


def viterbi_path(scores: np.ndarray, stay: float, leave: float, beam: float = np.inf) -> np.ndarray | None:
    """States of the best left-to-right path through a frames x states matrix of log scores, or None if the beam cuts all."""
    frames, states = scores.shape
    best = np.full(states, -np.inf)
    best[0] = scores[0, 0]
    moved = np.zeros((frames, states), bool)
    for t in range(1, frames):
        step = np.concatenate([[-np.inf], best[:-1] + leave])
        moved[t] = step > best + stay
        best = np.maximum(step, best + stay) + scores[t]
        best[best < best.max() - beam] = -np.inf
    if not np.isfinite(best[-1]):
        return None
    path = np.empty(frames, int)
    state = states - 1
    for t in range(frames - 1, -1, -1):
        path[t] = state
        state -= moved[t, state]
    return path


def align(frames: DataFrame, means: dict[str, float], variances: dict[str, float], stay: float = 0.5, beam: float = 100.0, most: float = 1600.0) -> DataFrame:
    """utt, frame, state, label: forced alignment of frames (utt, frame, value) to the labels of the utterance in order.

    The column labels has the utterance's transcript on its first frame. A beam that loses all paths is doubled, up to `most`;
    an utterance with fewer frames than labels, or without a path, is left out.
    """

    def run(table: pa.Table, begins: np.ndarray) -> pa.Table:
        out: dict[str, list] = {"utt": [], "frame": [], "state": [], "label": []}
        x = np.asarray(table.column("value"), float)
        utts, frame = table.column("utt").to_pylist(), table.column("frame").to_pylist()
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            labels = table.column("labels")[a].as_py()
            if not labels or b - a < len(labels):
                continue
            m, v = np.array([means[s] for s in labels]), np.array([variances[s] for s in labels])
            scores = -0.5 * (np.log(2 * np.pi * v) + (x[a:b, None] - m) ** 2 / v)
            width, path = beam, None
            while path is None and width <= most:
                path, width = viterbi_path(scores, np.log(stay), np.log(1 - stay), width), 2 * width
            if path is None:
                continue
            out["utt"] += utts[a:b]
            out["frame"] += frame[a:b]
            out["state"] += path.tolist()
            out["label"] += [labels[s] for s in path]
        return pa.table({"utt": pa.array(out["utt"], table.schema.field("utt").type), "frame": pa.array(out["frame"], pa.int32()), "state": pa.array(out["state"], pa.int32()), "label": pa.array(out["label"], pa.string())})

    kind = frames.schema["utt"].dataType.simpleString()
    return map_groups(frames.select("utt", "frame", "value", "labels"), "utt", ["frame"], run, f"utt {kind}, frame int, state int, label string")


def state_posteriors(frames: DataFrame, start: np.ndarray, transition: np.ndarray, means: np.ndarray, variances: np.ndarray) -> DataFrame:
    """utt, frame, posteriors (by state) and ll (of the utterance) by the forward-backward recursions, scaled by frame."""

    def run(table: pa.Table, begins: np.ndarray) -> pa.Table:
        x = np.asarray(table.column("value"), float)
        logs = -0.5 * (np.log(2 * np.pi * variances) + (x[:, None] - means) ** 2 / variances)
        top = logs.max(1, keepdims=True)
        density = np.exp(logs - top)
        gamma, ll = np.empty_like(density), np.empty(len(x))
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            forward, scale = np.empty((b - a, len(start))), np.empty(b - a)
            now = start * density[a]
            for t in range(b - a):
                if t:
                    now = (forward[t - 1] @ transition) * density[a + t]
                scale[t] = now.sum()
                forward[t] = now / scale[t]
            back = np.ones(len(start))
            for t in range(b - a - 1, -1, -1):
                gamma[a + t] = forward[t] * back
                gamma[a + t] /= gamma[a + t].sum()
                back = transition @ (density[a + t] * back) / scale[t]
            ll[a:b] = np.log(scale).sum() + top[a:b].sum()
        return pa.table([table.column("utt"), table.column("frame"), pa.array(list(gamma), pa.list_(pa.float64())), pa.array(ll)], names=["utt", "frame", "posteriors", "ll"])

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    return map_groups(frames.select("utt", "frame", "value"), "utt", ["frame"], run, f"utt {kinds['utt']}, frame {kinds['frame']}, posteriors array<double>, ll double")


def beam_prune(tokens: DataFrame, group: str, score: str, beam: float) -> DataFrame:
    """Tokens within `beam` of the best of their group; maxima are combined before they are shuffled."""
    best = tokens.groupBy(F.col(group).alias("_g")).agg(F.max(score).alias("_best"))
    return tokens.join(best, F.col(group).eqNullSafe(F.col("_g"))).where(F.col(score) >= F.col("_best") - beam).drop("_g", "_best")


def top_tokens(tokens: DataFrame, group: str, score: str, k: int, ties: str) -> DataFrame:
    """The best k tokens of each group, exactly, with rank from 1."""
    w = Window.partitionBy(group).orderBy(F.desc(score), ties)
    return tokens.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recombine(tokens: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """Of tokens with equal keys (node and history) the best one, least `tie` among equals."""
    rest = [c for c in tokens.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(tie)))
    return tokens.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def token_step(tokens: DataFrame, arcs: DataFrame, scores: DataFrame, beam: float, most: int) -> DataFrame:
    """utt, node, history and score of tokens after one frame.

    Tokens (utt, node, history, score) take all arcs (src, dst, unit, word, weight) of their node and
    the frame's score (utt, unit, lp) of the arc's unit; an arc with a word makes that the history. Of tokens that agree in
    node and history the best stays, then those within the beam of their utterance's best, the best `most` of them.
    """
    kept = beam_prune(_moved(tokens, arcs, scores), "utt", "score", beam)
    w = Window.partitionBy("utt").orderBy(F.desc("score"), "node", "history")
    return kept.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def token_step_by_histogram(tokens: DataFrame, arcs: DataFrame, scores: DataFrame, beams: DataFrame, width: float, most: int) -> tuple[DataFrame, DataFrame]:
    """As `token_step`, pruned by `pruning.histogram_prune`: the tokens, and each utterance's beam (utt, beam) for the next frame."""
    return histogram_prune(_moved(tokens, arcs, scores), "utt", "score", beams, width, most)


def _moved(tokens: DataFrame, arcs: DataFrame, scores: DataFrame) -> DataFrame:
    rows = tokens.join(arcs, F.col("node") == F.col("src")).join(scores, ["utt", "unit"])
    moved = rows.select("utt", F.col("dst").alias("node"), F.coalesce("word", "history").alias("history"), (F.col("score") + F.col("weight") + F.col("lp")).alias("score"))
    return moved.groupBy("utt", "node", "history").agg(F.max("score").alias("score"))


def ordered_tokens(tokens: DataFrame, final: str, score: str) -> DataFrame:
    return tokens.orderBy(F.desc(final), F.desc(score))


def prefix_tree(lexicon: list[tuple[str, tuple[str, ...]]]) -> tuple[dict[int, dict[str, int]], dict[int, list[str]]]:
    """Nodes (0 is the root) to next nodes by unit, and the words that end at nodes."""
    arcs: dict[int, dict[str, int]] = {0: {}}
    words: dict[int, list[str]] = {}
    for word, units in sorted(lexicon):
        node = 0
        for u in units:
            if u not in arcs[node]:
                arcs[node][u] = len(arcs)
                arcs[len(arcs)] = {}
            node = arcs[node][u]
        words.setdefault(node, []).append(word)
    return arcs, words


def lookahead(arcs: dict[int, dict[str, int]], words: dict[int, list[str]], unigram: dict[str, float]) -> dict[int, float]:
    """For each node the best score of the words that it can still reach."""
    out: dict[int, float] = {}
    for node in sorted(arcs, reverse=True):  # children come after their parents
        own = [unigram.get(w, ZERO) for w in words.get(node, [])]
        out[node] = max([*own, *(out[n] for n in arcs[node].values())], default=ZERO)
    return out


class Decoder:
    """Token passing over the prefix tree of a lexicon with bigram scores, many utterances at once, a frame at a time."""

    def __init__(self, units: list[str], lexicon: list[tuple[str, tuple[str, ...]]], bigram: dict[tuple[str, str], float], unigram: dict[str, float], backoff: dict[str, float], scale: float = 1.0, beam: float = 200.0, most: int = 2000, stay: float = 0.5, end_beam: float | None = None, lattice: bool = False) -> None:
        arcs, words = prefix_tree(lexicon)
        ahead = lookahead(arcs, words, unigram)
        unit = {u: i for i, u in enumerate(units)}
        entering = {n: u for next_ in arcs.values() for u, n in next_.items()}
        self.units, self.scale, self.beam, self.most, self.lattice = len(units), scale, beam, most, lattice
        self.log_stay, self.log_leave = np.log(stay), np.log(1 - stay)
        self.end_width = beam if end_beam is None else end_beam
        # histories are 0 for the sentence start, else 1 + the word's number
        self.names = sorted({w for ws in words.values() for w in ws})
        number = {"<s>": 0, **{w: i for i, w in enumerate(self.names, 1)}}
        self.size, self.nodes = len(number), len(arcs)
        self.own = np.array([unigram.get(w, ZERO) for w in self.names])
        self.weight = np.array([backoff.get(w, 0.0) for w in number])
        known = sorted((number[a] * self.size + number[b], lp) for (a, b), lp in bigram.items() if a in number and b in number)
        self.keys, self.pairs = np.array([k for k, _ in known], np.int64), np.array([lp for _, lp in known])
        self.final = np.array([bigram[w, "</s>"] if (w, "</s>") in bigram else backoff.get(w, 0.0) + unigram.get("</s>", ZERO) for w in number])
        kids = [np.array(sorted(arcs[n].values()), np.int64) for n in range(self.nodes)]
        ends = [np.array(sorted(number[w] for w in words.get(n, [])), np.int64) for n in range(self.nodes)]
        self.kid_at, self.end_at = (np.concatenate([[0], np.cumsum([len(x) for x in lists])]) for lists in (kids, ends))
        self.kid, self.end = (np.concatenate(lists) if lists else np.zeros(0, np.int64) for lists in (kids, ends))
        self.entered = np.array([unit[entering[n]] if n else 0 for n in range(self.nodes)])
        self.look = scale * np.array([ahead[n] for n in range(self.nodes)])

    def language(self, last: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Scores of words after histories: the pair's, or the history's weight and the word's own."""
        out = self.weight[last] + self.own[word - 1]
        if len(self.keys):
            key = last * self.size + word
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out = np.where(self.keys[at] == key, self.pairs[at], out)
        return out

    def begin(self, utterances: int) -> Tokens:
        return Tokens(utterances, self.look[0], self.beam)

    def advance(self, tokens: Tokens, t: int, frame: np.ndarray) -> None:
        """Take frame t, utterances x units, of all utterances that have tokens."""
        utt, node, last, trace, score, heard = tokens.columns()
        count, past, width = len(tokens.width), tokens.past, tokens.width
        out_of = self.log_leave if t else 0.0
        leave = score + out_of
        # words that end here begin anew at the root, the best one of each word
        r, e = _spread(self.end_at[node], (self.end_at[node + 1] - self.end_at[node]) * (t > 0))
        word = self.end[e]
        lm = self.language(last[r], word)
        value = leave[r] - self.look[node[r]] + self.scale * lm + self.look[0]
        top_end = np.full(count, -np.inf)
        np.maximum.at(top_end, utt[r], value)
        live = np.flatnonzero(value >= top_end[utt[r]] - self.end_width * width[utt[r]] / self.beam)
        r, word, lm, value = r[live], word[live], lm[live], value[live]
        top = _best_of(utt[r] * self.size + word, value, r)
        new = past.add(t, utt[r], word, trace[r], heard[r] + out_of, lm, value, top, self.size, self.lattice)
        r, word, value = r[top], word[top], value[top]
        # from where arcs of the tree are taken
        utt_from, node_from = np.concatenate([utt, utt[r]]), np.concatenate([node, np.zeros(len(r), np.int64)])
        last_from, trace_from, score_from = np.concatenate([last, word]), np.concatenate([trace, new]), np.concatenate([leave, value])
        heard_from = np.concatenate([heard, heard[r]]) + out_of
        k, c = _spread(self.kid_at[node_from], self.kid_at[node_from + 1] - self.kid_at[node_from])
        into = self.kid[c]
        sound = frame[utt_from[k], self.entered[into]]
        moved = score_from[k] - self.look[node_from[k]] + self.look[into] + sound
        inner = np.flatnonzero(node > 0)
        more = self.log_stay + frame[utt[inner], self.entered[node[inner]]]
        utt, node = np.concatenate([utt[inner], utt_from[k]]), np.concatenate([node[inner], into])
        last, trace, score = np.concatenate([last[inner], last_from[k]]), np.concatenate([trace[inner], trace_from[k]]), np.concatenate([score[inner] + more, moved])
        heard = np.concatenate([heard[inner] + more, heard_from[k] + sound])
        tokens.keep(_best_of((utt * self.nodes + node) * self.size + last, score, trace), utt, node, last, trace, score, heard)
        going = np.flatnonzero(np.bincount(tokens.utt, minlength=count))
        limit = np.full(count, np.inf)
        limit[going], width[going] = histogram_limits(np.searchsorted(going, tokens.utt), tokens.score, width[going], self.beam, self.most)
        stay = tokens.score >= limit[tokens.utt]
        if not stay.all():
            tokens.keep(np.flatnonzero(stay), *tokens.columns())

    def _ended(self, tokens: Tokens, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """The words that end in tokens: rows of tokens, words, their language scores, and the whole scores with the end's."""
        node = tokens.node[rows]
        r, e = _spread(self.end_at[node], self.end_at[node + 1] - self.end_at[node])
        at, word = rows[r], self.end[e]
        lm = self.language(tokens.last[at], word)
        return at, word, lm, tokens.score[at] - self.look[tokens.node[at]] + self.scale * lm + self.scale * self.final[word]

    def finish(self, tokens: Tokens, t: int, done: np.ndarray) -> dict[int, tuple[tuple[str, ...], float]]:
        """The best words and score of utterances that end before frame t, by number; their tokens go."""
        over, found = done[tokens.utt], {}
        if over.any():
            at, word, lm, value = self._ended(tokens, np.flatnonzero(over))
            utt = tokens.utt[at]
            top = _best_of(utt * self.size + word, value, np.arange(len(at)))
            new = tokens.past.add(t, utt, word, tokens.trace[at], tokens.heard[at], lm, value, top, self.size, self.lattice)
            best = _best_of(utt[top], value[top], word[top])
            for u, s, place in zip(utt[top[best]].tolist(), value[top[best]].tolist(), new[best].tolist(), strict=True):
                found[u] = tuple(self.names[i - 1] for i in tokens.past.path(place)), s
            if self.lattice:
                tokens.past.close(utt[top], new, self.final[word[top]])
            tokens.keep(np.flatnonzero(~over), *tokens.columns())
        return found

    def so_far(self, tokens: Tokens) -> dict[int, tuple[tuple[str, ...], float]]:
        """The words that the best token of each utterance has behind it, and its score with what lies ahead of it."""
        best = _best_of(tokens.utt, tokens.score, tokens.trace)
        return {u: (tuple(self.names[i - 1] for i in tokens.past.path(place)), s) for u, place, s in zip(tokens.utt[best].tolist(), tokens.trace[best].tolist(), tokens.score[best].tolist(), strict=True)}

    def search(self, matrix: np.ndarray, begins: np.ndarray) -> tuple[list[tuple[tuple[str, ...], float]], _Ends]:
        """The best words and score of each whole utterance, and the ends of words."""
        length = np.diff(begins)
        found: list[tuple[tuple[str, ...], float]] = [((), ZERO)] * len(length)
        tokens = self.begin(len(length))
        for t in range(int(length.max(initial=0))):
            self.advance(tokens, t, matrix[np.minimum(begins[:-1] + t, len(matrix) - 1)])
            for u, best in self.finish(tokens, t + 1, length == t + 1).items():
                found[u] = best
            tokens.reclaim()
        return found, tokens.past


class Tokens:
    """The tokens of many utterances in columns, the beam of each, and the ends of words behind them."""

    def __init__(self, utterances: int, score: float, beam: float) -> None:
        self.utt, self.node, self.last = np.arange(utterances), np.zeros(utterances, np.int64), np.zeros(utterances, np.int64)
        self.trace, self.score, self.heard = np.arange(utterances), np.full(utterances, score), np.zeros(utterances)
        self.width, self.past = np.full(utterances, beam), _Ends(utterances)

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.utt, self.node, self.last, self.trace, self.score, self.heard

    def keep(self, rows: np.ndarray, *columns: np.ndarray) -> None:
        self.utt, self.node, self.last, self.trace, self.score, self.heard = (x[rows] for x in columns)

    def reclaim(self) -> None:
        self.trace = self.past.reclaim(self.trace)


def _spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows repeated as often as counted, and the places begin .. begin + count - 1 of each."""
    rows = np.repeat(np.arange(len(count)), count)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(count) - count - begin, count)


def _best_of(key: np.ndarray, score: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The best row of each key, the first by `tie` among equals, in the order of keys."""
    most = int(key.max(initial=-1)) + 1
    if most <= DENSE * len(key) + DENSE:  # keys as places in an array, which takes no sorting
        top, first, place = np.full(most, -np.inf), np.full(most, np.iinfo(np.int64).max), np.full(most, -1)
        np.maximum.at(top, key, score)
        rows = np.flatnonzero(score == top[key])
        np.minimum.at(first, key[rows], tie[rows])
        rows = rows[tie[rows] == first[key[rows]]][::-1]
        place[key[rows]] = rows  # of rows that agree in all the first one is written last
        return place[place >= 0]
    order = np.lexsort((tie, -score, key))
    return order[np.append(True, key[order][1:] != key[order][:-1])] if len(order) else order


def decode(frames: DataFrame, units: list[str], lexicon: list[tuple[str, tuple[str, ...]]], bigram: dict[tuple[str, str], float], unigram: dict[str, float], backoff: dict[str, float], scale: float = 1.0, beam: float = 200.0, most: int = 2000, stay: float = 0.5, end_beam: float | None = None, lattice: bool = False, dealt: bool = False) -> DataFrame:
    """utt, words, score: token passing over a prefix tree with bigram scores, in natural logarithms.

    Frames have the log likelihood of each unit in `scores`, in the order of
    `units`. A token is (node, last word); of equal ones the best stays. The best
    score of reachable words is added ahead and taken back at the word's end.
    Tokens are pruned as `pruning` says, with `beam` as the full width. Ends of words go where they lie more than `end_beam` below
    the frame's best end, narrowed as the beam is.

    With `lattice` the result has the arcs of a word lattice: net, arc, src, dst, word, frame (behind the word), am, lm and
    score (am + scale * lm). A node is a word and the frame behind it; node 0 begins the utterance, and arcs named </s>
    lead to its last node. An arc is the best way to say its word after the word of its source, from the frame where that
    way began: of ways that agree in both words and in the end, the best one stays. Only arcs that a living
    token can go back to are kept while tokens advance; an utterance without a way to its end has none. An utterance's
    arcs are in one partition. `dealt` says that an utterance's frames are in one already.
    """
    decoder = Decoder(units, lexicon, bigram, unigram, backoff, scale, beam, most, stay, end_beam, lattice)

    def run(table: pa.Table, begins: np.ndarray) -> pa.Table:
        parts = [begins[i : i + TOGETHER + 1] for i in range(0, len(begins) - 1, TOGETHER)]
        return pa.concat_tables([some(table.slice(part[0], part[-1] - part[0]), part - part[0]) for part in parts])

    def some(table: pa.Table, begins: np.ndarray) -> pa.Table:
        matrix = np.asarray(table.column("scores").combine_chunks().flatten(), float).reshape(-1, decoder.units)
        found, past = decoder.search(matrix, begins)
        if lattice:
            return past.lattice(table.column("utt").take(pa.array(begins[:-1])), [*decoder.names, "</s>"], scale)
        utt = table.column("utt").take(pa.array(begins[:-1]))
        return pa.table([utt, pa.array([" ".join(path) for path, _ in found], pa.string()), pa.array([float(s) for _, s in found], pa.float64())], names=["utt", "words", "score"])

    kind = frames.schema["utt"].dataType.simpleString()
    schema = f"net {kind}, arc long, src long, dst long, word string, frame int, am double, lm double, score double" if lattice else f"utt {kind}, words string, score double"
    return map_groups(frames.select("utt", "frame", "scores"), "utt", ["frame"], run, schema, dealt)


class _Ends:
    """Ends of words of many utterances: nodes of their lattices, and the arcs into them.

    The first nodes, one an utterance, are their beginnings. Nodes that no living token can go back to are
    reclaimed, with their arcs, when as many were added as stayed the last time.
    """

    #: Nodes that are kept whatever becomes of them.
    FEW = 4096

    def __init__(self, utterances: int) -> None:
        self.utt = np.arange(utterances)
        self.word, self.frame, self.before = (np.zeros(utterances, np.int64) for _ in range(3))
        self.before -= 1
        self.heard = np.zeros(utterances)
        self.arcs = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]  # src, dst, am, lm
        self.stayed = max(self.FEW, utterances)
        self.ends: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, frame: int, utt: np.ndarray, word: np.ndarray, before: np.ndarray, heard: np.ndarray, lm: np.ndarray, value: np.ndarray, top: np.ndarray, size: int, lattice: bool) -> np.ndarray:
        """Numbers of the nodes of the rows `top`, one for each utterance and word; for a lattice all rows become arcs into them."""
        new = len(self.utt) + np.arange(len(top))
        if lattice and len(top):
            keys = utt[top] * size + word[top]
            order = np.argsort(keys)
            into = new[order[np.searchsorted(keys[order], utt * size + word)]]
            am = heard - self.heard[before]
            kept = _best_of(into * size + self.word[before], value, before)  # of ways from one word the best
            self.arcs = [np.concatenate([a, b[kept]]) for a, b in zip(self.arcs, (before, into, am, lm), strict=True)]
        for name, values in (("utt", utt[top]), ("word", word[top]), ("frame", np.full(len(top), frame)), ("before", before[top]), ("heard", heard[top])):
            setattr(self, name, np.concatenate([getattr(self, name), values]))
        return new

    def path(self, node: int) -> list[int]:
        out = []
        while self.before[node] >= 0:
            out.append(int(self.word[node]))
            node = int(self.before[node])
        return out[::-1]

    def close(self, utt: np.ndarray, nodes: np.ndarray, lm: np.ndarray) -> None:
        """Nodes at which utterances end, with the score of the end."""
        self.ends.append((utt, nodes, lm))

    def _reached(self, roots: np.ndarray) -> np.ndarray:
        """Which nodes roots can go back to, by their best way or by arcs."""
        live = np.zeros(len(self.utt), bool)
        edge = np.unique(roots)
        src, dst = self.arcs[0], self.arcs[1]
        order = np.argsort(dst, kind="stable")
        starts = np.searchsorted(dst[order], np.arange(len(self.utt) + 1))
        while len(edge):
            live[edge] = True
            counts = starts[edge + 1] - starts[edge]
            rows = np.repeat(starts[edge] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            back = np.concatenate([src[order[rows]], self.before[edge]])
            edge = np.unique(back[back >= 0])
            edge = edge[~live[edge]]
        return live

    def reclaim(self, trace: np.ndarray) -> np.ndarray:
        """Forget nodes that neither tokens nor ended utterances go back to, once enough were added; the tokens' nodes by their new numbers."""
        if len(self.utt) < 2 * self.stayed:
            return trace
        live = self._reached(np.concatenate([trace, *(n for _, n, _ in self.ends)]))
        live[: int((self.before < 0).sum())] = True  # beginnings keep their places
        number = np.cumsum(live) - 1
        for name in ("utt", "word", "frame", "before", "heard"):
            setattr(self, name, getattr(self, name)[live])
        self.before = np.where(self.before >= 0, number[self.before], -1)
        kept = live[self.arcs[0]] & live[self.arcs[1]]
        self.arcs = [a[kept] for a in self.arcs]
        self.arcs[0], self.arcs[1] = number[self.arcs[0]], number[self.arcs[1]]
        self.ends = [(u, number[n], lm) for u, n, lm in self.ends]
        self.stayed = max(self.FEW, len(self.utt))
        return number[trace]

    def lattice(self, keys: pa.Array, names: list[str], scale: float) -> pa.Table:
        """Arcs of all utterances that ended, nodes and arcs numbered from 0 in each, in the order of time."""
        columns = ["net", "arc", "src", "dst", "word", "frame", "am", "lm", "score"]
        if not self.ends:
            return pa.table([pa.array([], keys.type), *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64()))], names=columns)
        utt, node, lm = (np.concatenate(x) for x in zip(*self.ends, strict=True))
        live = self._reached(node)
        src, dst, am, lms = self.arcs
        kept = live[dst] & live[src]
        # ends come last in their utterance: a node of its own for each
        ended, first = np.unique(utt, return_inverse=True)
        src = np.concatenate([src[kept], node])
        dst = np.concatenate([dst[kept], len(self.utt) + first])
        am, lms = np.concatenate([am[kept], np.zeros(len(node))]), np.concatenate([lms[kept], lm])
        word = np.concatenate([self.word[self.arcs[1][kept]] - 1, np.full(len(node), len(names) - 1)])
        frame = np.concatenate([self.frame[self.arcs[1][kept]], self.frame[node]])
        of = np.concatenate([self.utt, ended])
        when = np.concatenate([self.frame, np.full(len(ended), np.iinfo(np.int64).max)])
        used = np.unique(np.concatenate([src, dst]))
        order = used[np.lexsort((used, when[used], of[used]))]
        place = np.zeros(len(of), np.int64)
        place[order] = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        rows = np.lexsort((place[dst], place[src], of[src]))
        src, dst, am, lms, word, frame = (x[rows] for x in (src, dst, am, lms, word, frame))
        net = of[src]
        arc = np.arange(len(net)) - np.searchsorted(net, net)
        data = [keys.take(pa.array(net)), pa.array(arc), pa.array(place[src]), pa.array(place[dst]), pa.array(np.array(names, object)[word], pa.string()), pa.array(frame.astype(np.int32)), pa.array(am), pa.array(lms), pa.array(am + scale * lms)]
        return pa.table(data, names=columns)
