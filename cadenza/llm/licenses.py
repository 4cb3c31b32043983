"""License scans by ordered signature rules, in built-in functions alone.

A text is lower-cased (A-Z) and cut into words. Some hundreds of rules are patterns
over words with one space between; each begins with one of its keywords. Texts that
hold no part of a word that every rule needs are passed over. In the others, a rule is
tried where one of its keywords stands, on as many words from there as the longest rule
can take, and only if those hold the word that the rule needs. So a detection is
(rule, place) for every place, and what is tried grows with the keywords in a text.

Detections overlap. One that lies inside another goes if the other has the higher
priority, or the same and more words, or the same words and comes first among the rules.
As a rule takes a bounded number of words, the detections that can hold another are
a bounded stretch of the sorted list before it: the work is linear in the detections.
Base phrases are rules of the lowest priority; their places and labels count before
this selection and stay.

All of it happens inside a row: no shuffle, no state. Null texts are empty: no words, no
labels, score 0, first and last places null. Words of other scripts are words; only
A-Z are lower-cased. Repeated rows and rows without a doc_id are scanned each. An
empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import license_rules as rules_of

#: A word after lower-casing, and before it.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE = "struct<number:int,label:string,priority:int,need:string,pattern:string>"
HIT = "struct<start:int,last:int,priority:int,number:int,label:string>"


def may_match(small: Column) -> Column:
    """Whether a text in small letters holds what every rule needs some of; lower() maps A-Z and may only let more through."""
    edge = r"[^a-z0-9\x{80}-\x{10FFFF}]"
    found = small.rlike(rf"(?:^|{edge})(?:{'|'.join(rules_of.SHORT_GATES)})(?:{edge}|$)")
    for gate in rules_of.GATES:
        found = found | small.contains(gate)
    return found


def _rules_by_keyword() -> str:
    """A constant map from each keyword to its rules, as SQL. Patterns hold neither quotes nor backslashes."""
    by: dict[str, list[dict]] = {}
    for r in rules_of.rules():
        for word in sorted(rules_of.first_words(r.pattern)):
            by.setdefault(word, []).append({"number": r.number, "label": r.label, "priority": r.priority, "need": r.need, "pattern": f"^({r.pattern})(?: |$)"})
    return f"from_json('{json.dumps(by)}', 'map<string,array<{RULE}>>')"


#: Whether detection o goes before x, which lies inside it.
BEATS = "(o.last >= x.last and (o.priority > x.priority or o.priority = x.priority and (o.last - o.start > x.last - x.start or o.last - o.start = x.last - x.start and o.number < x.number)))"


def _detections() -> Column:
    """For each place of a keyword in the column `words`, in order, the detections there."""
    span = rules_of.longest()
    keywords = sorted(set().union(*(rules_of.first_words(r.pattern) for r in rules_of.rules())))
    listed = ", ".join(f"'{k}'" for k in keywords)
    places = f"filter(transform(words, (w, i) -> struct(w, i)), x -> x.w in ({listed}))"
    nears = f"transform({places}, x -> struct(x.i as i, x.w as w, array_join(slice(words, x.i + 1, {span}), ' ') as near))"
    tried = f"transform(filter(element_at({_rules_by_keyword()}, c.w), r -> contains(c.near, r.need)), r -> struct(r, regexp_extract(c.near, r.pattern, 1) as m))"
    last = "c.i + length(y.m) - length(replace(y.m, ' ', ''))"
    hit = f"cast(struct(c.i, {last}, y.r.priority, y.r.number, y.r.label) as {HIT})"
    return F.expr(f"transform({nears}, c -> transform(filter({tried}, y -> y.m <> ''), y -> {hit}))")


#: Of each place those that no other one there beats: one of each priority at most.
BEST_OF_PLACES = f"flatten(transform(places, a -> filter(a, x -> not exists(a, o -> {BEATS}))))"


def _kept() -> Column:
    """Of `best`, sorted by place, those that lie in no other one that goes before them.

    What holds a detection begins less than the longest rule's words before it, or there: a bounded
    number of entries before it, as a place has one of each priority at most.
    """
    reach = rules_of.longest() * len(rules_of.STRENGTH)
    around = f"slice(best, greatest(i + 1 - {reach}, 1), least(i, {reach}) + {len(rules_of.STRENGTH)})"
    return F.expr(f"filter(best, (x, i) -> not exists({around}, o -> o.start <= x.start and {BEATS}))")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (places of base phrases, with labels) and found (the detections that stay) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("small", F.lower("text"))
    words = F.when(may_match(F.col("small")), F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", F.regexp_count("text", F.lit(ANY_CASE)).cast("long").alias("n_words"), words.alias("words"))
    rows = rows.select("doc_id", "n_words", _detections().alias("places"))
    base = F.filter(F.flatten("places"), lambda h: h["priority"] == rules_of.BASE)
    rows = rows.select("doc_id", "n_words", base.alias("base"), F.expr(BEST_OF_PLACES).alias("best"))
    return rows.select("doc_id", "n_words", "base", _kept().alias("found"))


def summarize(scanned: DataFrame) -> DataFrame:
    """The digest columns of a scan, one row each; score is how sure the surest detection is."""
    starts = F.transform("base", lambda h: h["start"].cast("long"))
    labels = lambda c: F.transform(c, lambda h: h["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    strength = F.create_map(*[F.lit(x) for item in rules_of.STRENGTH.items() for x in item])
    sure = F.array_max(F.transform("found", lambda h: F.element_at(strength, h["priority"])))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(labels("base")).alias("base_labels"),
        joined(F.concat(labels("base"), labels("found"))).alias("labels"),
        F.coalesce(sure, F.lit(0.0)).alias("score"),
    )
