"""Language identification by compression.

For each language a zstandard raw-content dictionary is cut from a bounded sample
of labelled texts; a text is compressed with each, and the language with the
smallest result wins. The score is a softmax over the compressed sizes. `accepted` is
false where the score is low or the second language comes within LEAST_GAP bytes.

Sample: for each language whole documents in the order of a hash of doc_id, DOCS at
most, until they have BYTES; with very many languages an equal share of ALL_BYTES
each, but one document at least. A document of more than LONGEST bytes does not teach, so a
language has less than BYTES and LONGEST bytes; one that has only such documents is not
learned, all others are. All documents are predicted, with their whole text, where they are; nothing
but the sample is moved.

Null texts and texts without a letter are `und` with score 0 and not accepted.
Without labelled rows every text is `und`. Ties go to the first language by name.
Repeated rows are predicted each. Other columns are ignored, or kept as they are
with `keep`, whatever their names.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import hash_share, map_text

#: Documents and bytes per language in the sample, and bytes of all languages.
DOCS, BYTES, ALL_BYTES = 600, 1_500_000, 48_000_000
#: Bytes of the longest document that teaches.
LONGEST = 1_000_000
#: Languages whose counts may be broadcast.
MANY = 100_000
LEVEL, MATCH = 5, 3
#: Bytes of compressed size that divide the odds of a language by e; the least accepted score.
SCALE, ACCEPTED = 3.0, 0.4
#: Bytes by which the second smallest compressed size must exceed the smallest one.
LEAST_GAP = 2
UNKNOWN = "und"


def held_out(doc_id: str, parts: int, part: int):
    """Whether a hash of doc_id puts a row apart; never for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


def learn(docs: DataFrame, parts: int = 4, part: int = 2) -> dict[str, bytes]:
    """The dictionary of each language, from rows that are not held out."""
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", parts, part))
    rows = rows.where((F.length("text") > 0) & (F.octet_length("text") <= LONGEST))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))
    languages = sizes.count()
    if not languages:
        return {}
    budget = min(BYTES, ALL_BYTES // languages)
    # about four times DOCS by their hash, so that the windows are small, and all where there are few
    near = rows.join(F.broadcast(sizes) if languages <= MANY else sizes, "lang").where(hash_share("doc_id") < 4.0 * DOCS / F.col("n_docs"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.xxhash64("text"), "doc_id")
    before = F.coalesce(F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = near.withColumns({"n": F.row_number().over(order), "before": before}).where((F.col("n") <= DOCS) & (F.col("before") < budget))
    found: dict[str, list[str]] = {}
    for lang, text in chosen.orderBy("lang", "n").select("lang", "text").collect():
        found.setdefault(lang, []).append(text)
    return {lang: "\n".join(found[lang]).lower().encode("utf-8", "replace") for lang in sorted(found)}


@cache
def _compressors(dictionaries: tuple[bytes, ...]):
    import zstandard

    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
    out = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params) for d in dictionaries]
    return out


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and accepted of each row; with `keep` instead the accepted rows of `docs` as they are."""
    import regex

    languages, contents = tuple(dictionaries), tuple(dictionaries.values())
    sent = docs.sparkSession.sparkContext.broadcast(contents)  # ALL_BYTES and the last document of each language
    inputs = docs.columns if keep else ["doc_id", "text"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        compressors, letter = _compressors(sent.value), regex.compile(r"\p{L}").search
        names, scores, gaps = [], [], []
        for text in batch.column("text").to_pylist():
            if text is None or not languages or letter(text) is None:
                names.append(UNKNOWN)
                scores.append(0.0)
                gaps.append(0.0)
                continue
            raw = text.lower().encode("utf-8", "replace")
            size = np.array([len(c.compress(raw)) for c in compressors], np.float64)
            best = int(size.argmin())
            names.append(languages[best])
            gaps.append(float(np.delete(size, best).min(initial=np.inf) - size[best]))
            scores.append(float(1.0 / np.exp((size[best] - size) / SCALE).sum()))
        score = np.array(scores, np.float64)
        accepted = pa.array((score >= ACCEPTED) & (np.array(gaps, np.float64) >= LEAST_GAP))
        if keep:
            return batch.filter(accepted)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), accepted], names=["doc_id", "lang_pred", "score", "accepted"])

    rows = docs.select(*[f"`{c}`" for c in inputs])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if keep or f.name != "text")
    return map_text(rows, run, fields if keep else f"{fields}, lang_pred string, score double, accepted boolean")
