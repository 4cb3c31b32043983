"""Errors of recognized text, morph lattices and segmentations, confidences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.scalars import byte_distance


def word_distance(a: list[str], b: list[str]) -> int:
    """Edit distance of two word sequences; rows of the table are numpy arrays."""
    if not len(a) or not len(b):
        return max(len(a), len(b))
    names = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([names[w] for w in b])
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for i, w in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != names[w]))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def word_errors(hyp: Column, ref: Column) -> Column:
    """Edit distance in words."""

    @F.pandas_udf("int")
    def count(hyp: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([word_distance(h.split(), r.split()) for h, r in zip(hyp, ref, strict=True)], dtype="int32")

    return count(hyp, ref)


def error_rates(pairs: DataFrame, key: str | None = None) -> DataFrame:
    """word_errors, words, letter_errors, letters summed over (hyp, ref), and their rates; letters are bytes."""
    rows = pairs.withColumns({"w": word_errors(F.col("hyp"), F.col("ref")), "c": byte_distance(F.col("hyp"), F.col("ref")), "n": F.size(F.filter(F.split("ref", r"\s+"), lambda x: x != "")), "m": F.octet_length("ref")})
    out = (rows.groupBy(key) if key else rows.groupBy()).agg(*[F.sum(c).alias(n) for c, n in (("w", "word_errors"), ("n", "words"), ("c", "letter_errors"), ("m", "letters"))])
    return out.withColumns({"wer": F.col("word_errors") / F.col("words"), "ler": F.col("letter_errors") / F.col("letters")})


def morph_matches(words: DataFrame, morphs: DataFrame) -> DataFrame:
    """word, start, end, morph, lp: all morphs (morph, lp) at all places of each distinct word.

    Places and lengths that the dictionary has are spelled out, then joined on equality.
    """
    lengths = F.broadcast(morphs.select(F.length("morph").alias("len")).distinct())  # a row per length of a morph
    places = words.select("word").distinct().withColumn("start", F.explode(F.sequence(F.lit(0), F.length("word") - 1))).where(F.length("word") > 0)
    cut = places.join(lengths, F.col("start") + F.col("len") <= F.length("word"))
    cut = cut.withColumn("morph", F.col("word").substr(F.col("start") + 1, F.col("len")))
    return cut.join(morphs, "morph").select("word", "start", (F.col("start") + F.col("len")).alias("end"), "morph", "lp")


def segment_words(words: DataFrame, unigram: dict[str, float], bigram: dict[tuple[str, str], float] | None = None, backoff: dict[str, float] | None = None, start: str = "<w>", end: str = "<w>") -> DataFrame:
    """word, morphs (best segmentation), best and soft (log-sum over all) in base-10 logarithms; null if there is none.

    Hypotheses that end at one place with the same last morph are merged: the best
    stays for `best`, weights are added for `soft`. The model is small and travels along.
    """
    bigram, backoff = bigram or {}, backoff or {}
    longest = max(map(len, unigram), default=0)

    def score(last: str, morph: str) -> float | None:
        found = bigram.get((last, morph))
        if found is not None:
            return found
        own = unigram.get(morph)
        return None if own is None else own + backoff.get(last, 0.0)

    def segment(word: str) -> tuple[str | None, float | None, float | None]:
        at: list[dict[str, tuple[float, float, tuple]]] = [{} for _ in range(len(word) + 1)]
        at[0][start] = (0.0, 0.0, ())
        for i in range(len(word)):
            for last, (best, soft, path) in at[i].items():
                for j in range(i + 1, min(len(word), i + longest) + 1):
                    morph = word[i:j]
                    if morph not in unigram or (lp := score(last, morph)) is None:
                        continue
                    old = at[j].get(morph)
                    new = (best + lp, (*path, morph))
                    top = max(new, (old[0], old[2])) if old else new
                    at[j][morph] = (top[0], np.logaddexp(old[1] * np.log(10), (soft + lp) * np.log(10)) / np.log(10) if old else soft + lp, top[1])
        final = [(best + (score(last, end) or 0.0), soft + (score(last, end) or 0.0), path) for last, (best, soft, path) in at[len(word)].items()]
        if not word or not final:
            return None, None, None
        best, _, path = max(final, key=lambda f: (f[0], f[2]))
        return " ".join(path), float(best), float(np.logaddexp.reduce([f[1] * np.log(10) for f in final]) / np.log(10))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(w, *segment(w)) for w in pdf["word"]], columns=["word", "morphs", "best", "soft"]).astype({"morphs": object})

    return words.select("word").distinct().mapInPandas(run, "word string, morphs string, best double, soft double")


def spell_lattice(text: str, morphs: set[str]) -> list[tuple[int, int, str]]:
    """Arcs (from, to, morph) over a text; a stretch of white space is one <w>."""
    out, longest, i = [], max(map(len, morphs), default=0), 0
    while i < len(text):
        if text[i].isspace():
            j = i
            while j < len(text) and text[j].isspace():
                j += 1
            out.append((i, j, "<w>"))
            i = j
            continue
        out += [(i, j, text[i:j]) for j in range(i + 1, min(len(text), i + longest) + 1) if text[i:j] in morphs]
        i += 1
    return out


def nbest_confidence(hypotheses: DataFrame, key: str, score: str, scale: float) -> DataFrame:
    """Add confidence: the share of each hypothesis in the sum of e^(score / scale) over its list."""
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    gap = (F.col(score) - F.max(score).over(w)) / F.lit(float(scale))
    return hypotheses.withColumn("_e", F.exp(gap)).withColumn("confidence", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def search_confidence(loop: Column, token: Column, edit: Column, acoustic: Column) -> Column:
    """Weighted mean of the phone loop's, tokens', edit distance's and acoustic confidences."""
    return (loop + 20 * token + 5 * edit + acoustic) / 27
