"""Errors of the arcs of a hypothesis lattice against the arcs of a reference lattice.

Labels are fields divided by semicolons: the first is a transition, the third a phone in its
context, the last a word; a label of one field is all of these. Modes:

* mwe: the best of -1 + 2e over overlapping references with the same label and -1 + e over
  others, e being the share of the reference that is overlapped;
* mpe: the same with the centre phones of labels;
* mpfe-pdf: 1 if a reference's transition leaves a state with the arc's own density, else 0;
* mpfe-cps: 1 if the arc's first field is a state of the phone of a reference, else 0;
* mpfe: 1 if the state that a reference's transition leaves is one of the arc's phone, else 0;
* snfe: chains of references through common nodes that lie over the arc, each reference with
  minus its overlap over the shorter of the two lengths, or 0 where centre phones agree; the best
  chain that reaches the arc's end. A chain begins with a reference that no other one over the
  arc leads to.

The frame modes are meant for lattices whose arcs are single states. An arc without any
reference over it has -1, or 0 in the frame modes; so has one whose chains end early.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segments import centre_phone, sublabel

MODES = ("mwe", "mpe", "mpfe-pdf", "mpfe-cps", "mpfe", "snfe")
#: Frames of the stretches over which arcs meet.
WIDTH = 64


def word_of(label: Column) -> Column:
    """The last field of a label."""
    return F.substring_index(label, ";", -1)


def _overlaps(hypotheses: DataFrame, references: DataFrame, width: int) -> DataFrame:
    """Hypothesis arcs h with the reference arcs r over them, once each: in the stretch where their overlap begins."""

    def spread(df: DataFrame, name: str) -> DataFrame:
        tiles = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
        return df.where("start < `end`").select("net", F.struct(*[c for c in df.columns if c != "net"]).alias(name), F.explode(tiles).alias("tile"))

    low, high = F.greatest("h.start", "r.start"), F.least("h.end", "r.end")
    pairs = spread(hypotheses, "h").join(spread(references, "r"), ["net", "tile"])
    return pairs.where((low < high) & (F.floor(low / width) == F.col("tile"))).select("net", "h", "r", (high - low).cast("double").alias("both"))


def _chain_value() -> Column:
    """The best chain of the references in the list `over`, sorted by their start, that reaches the arc's end."""
    best = F.expr(
        "aggregate(over, cast(array() as array<struct<dst: bigint, `end`: bigint, value: double>>), (so_far, r) -> concat(so_far, array(struct("
        "cast(r.dst as bigint) as dst, cast(r.`end` as bigint) as `end`, r.error + coalesce(array_max(transform(filter(so_far, p -> p.dst = r.src), p -> p.value)), 0D) as value))))"
    )
    return F.array_max(F.transform(F.filter(best, lambda p: p["end"] >= F.col("end")), lambda p: p["value"]))


def arc_errors(hypotheses: DataFrame, references: DataFrame, modes: Sequence[str], silence: str | None = None, transitions: DataFrame | None = None, phones: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """The hypothesis arcs (net, arc, start, end, label) with a value for each of `modes` (its name, with _ for -), against references (net, arc, src, dst, start, end, label).

    `transitions` has transition, state and pdf; `phones` has phone and states (an array). Arcs whose word is `silence` have 0.
    All modes are found in one join and one grouping by arc.
    """
    if unknown := set(modes) - set(MODES):
        raise ValueError(sorted(unknown))
    label = F.col("label")
    first, phone = sublabel(label, 0).try_cast("int"), sublabel(label, 2)

    def prepared(df: DataFrame, *keep: str) -> DataFrame:
        rows = df.select("net", "arc", *keep, "start", "end", "label", centre_phone(label).alias("phone"), first.alias("first"), phone.alias("model"))
        if {"mpfe-pdf", "mpfe"} & set(modes):
            rows = rows.join(transitions.select(F.col("transition").alias("first"), "state", "pdf"), "first", "left")
        if {"mpfe-cps", "mpfe"} & set(modes):
            rows = rows.join(phones.select(F.col("phone").alias("model"), "states"), "model", "left")
        return rows

    share = F.col("both") / (F.col("r.end") - F.col("r.start"))
    right = {
        "mwe": lambda: F.col("h.label") == F.col("r.label"),
        "mpe": lambda: F.col("h.phone") == F.col("r.phone"),
        "mpfe-pdf": lambda: F.col("h.pdf") == F.col("r.pdf"),
        "mpfe-cps": lambda: F.array_contains("r.states", F.col("h.first")),
        "mpfe": lambda: F.array_contains("h.states", F.col("r.state")),
    }
    shorter = F.least(F.col("h.end") - F.col("h.start"), F.col("r.end") - F.col("r.start"))
    error = F.when(F.col("h.phone") == F.col("r.phone"), 0.0).otherwise(-F.col("both") / shorter)
    found = {}
    for mode in modes:
        if mode == "snfe":
            found["over"] = F.array_sort(F.collect_list(F.struct("r.start", "r.end", "r.arc", "r.src", "r.dst", error.alias("error"))))
            continue
        ok = F.coalesce(right[mode](), F.lit(False))
        found[mode.replace("-", "_")] = F.max(F.when(ok, 1.0).otherwise(0.0) if mode.startswith("mpfe") else F.when(ok, -1 + 2 * share).otherwise(-1 + share))
    pairs = _overlaps(prepared(hypotheses), prepared(references, "src", "dst"), width)
    per_arc = pairs.groupBy("net", F.col("h.arc").alias("arc"), F.col("h.end").alias("end")).agg(*[v.alias(k) for k, v in found.items()])
    if "snfe" in modes:
        per_arc = per_arc.withColumn("snfe", _chain_value()).drop("over")
    out = hypotheses.join(per_arc.drop("end"), ["net", "arc"], "left")
    quiet = F.lit(False) if silence is None else word_of(label) == silence
    return out.withColumns({c: F.when(quiet, 0.0).otherwise(F.coalesce(c, F.lit(0.0 if c.startswith("mpfe") else -1.0))) for c in (m.replace("-", "_") for m in modes)})
