"""Readers and writers of the text and binary formats of recipes, segments, models, lattices and likelihoods.

Text formats are read as lines with their file's name and parsed by columns; formats with
nested or ordered parts are parsed file by file, many files in parallel.
"""

from __future__ import annotations

import io
import math
import re
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import ranks

#: Fields of a recipe line, of which some are numbers.
RECIPE_FIELDS = ("audio", "alt-audio", "transcript", "alignment", "hmmnet", "den-hmmnet", "lna", "start-time", "end-time", "start-line", "end-line", "speaker", "utterance")
RECIPE_TYPES = {"start-time": "double", "end-time": "double", "start-line": "int", "end-line": "int"}
FRAME_RATE, PRE_EMPHASIS, SAMPLE_RATE = 125.0, 0.97, 16000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file and value of each line that is not blank."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value")).where("value <> ''")


def parsed(contents: DataFrame, parse: Callable[[str, bytes], list[tuple]], schema: str) -> DataFrame:
    """Rows that `parse` makes of each path and content."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame(parse(name, bytes(content)), columns=names)

    return contents.select("path", "content").mapInPandas(run, schema)


def whole_files(spark: SparkSession, path: str, parse: Callable[[str, bytes], list[tuple]], schema: str) -> DataFrame:
    """Rows that `parse` makes of each file's name and bytes."""
    return parsed(spark.read.format("binaryFile").load(path), parse, schema)


def write_texts(texts: DataFrame, folder: str) -> None:
    """One file for each name: `texts` has name, place and value, the lines of a file in the order of place. Names become folders."""
    texts.repartition("name").sortWithinPartitions("name", "place").select("name", "value").write.partitionBy("name").text(folder)


def name_of(file: Column) -> Column:
    """The name that `write_texts` gave a file."""
    return F.regexp_extract(file, r"/name=([^/]*)/", 1)


def read_recipe(spark: SparkSession, path: str) -> DataFrame:
    """file, fields: one row per utterance; a field without a value, or an unnamed one, is an error."""
    rows = lines(spark, path)
    pairs = F.split("value", r"[ \t]+")
    bad = F.exists(pairs, lambda p: ~p.rlike(r"^[^=]+=[^=]*$"))
    rows = rows.withColumn("fields", F.when(bad, F.raise_error(F.concat(F.lit("Invalid recipe line: "), F.col("value")))).otherwise(F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)), F.split_part(p, F.lit("="), F.lit(2)))))))
    return rows.select("file", *[F.col("fields")[f].cast(RECIPE_TYPES.get(f, "string")).alias(f.replace("-", "_")) for f in RECIPE_FIELDS])


def batches(recipe: DataFrame, order: str, number: int, speaker: str | None = None) -> DataFrame:
    """Add batch (from 1): successive parts, the first ones with what is left over; with `speaker` a speaker stays together.

    Places in the whole order come from ranges that are sorted apart, so no task sees all rows.
    """

    def parts(rows: DataFrame, by: str) -> DataFrame:
        ranked, n = ranks.global_ranks(rows, by)
        size, more = divmod(n, number)
        late = (F.col("rank") - more * (size + 1)) / max(1, size) + more
        batch = F.when(F.col("rank") < more * (size + 1), F.col("rank") / (size + 1)).otherwise(late)
        return ranked.withColumn("batch", (F.floor(batch) + 1).cast("int")).drop("rank")

    if speaker is None:
        return parts(recipe, order)
    firsts = recipe.groupBy(F.col(speaker).alias("_s")).agg(F.min(order).alias("_first"))
    return recipe.join(parts(firsts, "_first").drop("_first"), F.col(speaker).eqNullSafe(F.col("_s"))).drop("_s")


def parse_segments(value: Column, samples_per_frame: float = SAMPLE_RATE / FRAME_RATE) -> list[Column]:
    """start, end (frames), labels, state, comment of a segment line; without times these are -1."""
    timed = value.rlike(r"^[0-9]")
    part = lambda i: F.coalesce(F.get(F.split(value, r"[ \t]+", 4), F.lit(i)), F.lit(""))
    name = F.when(timed, part(2)).otherwise(F.split_part(value, F.lit(" "), F.lit(1)))
    rest = F.when(timed, part(3)).otherwise(F.regexp_extract(value, r"^[^ \t]+[ \t]+(.*)$", 1))
    frame = lambda i: F.when(timed, F.floor(part(i).try_cast("long") / samples_per_frame)).otherwise(-1).cast("int")
    state = F.coalesce(F.regexp_extract(name, r"\.([0-9]+)", 1).try_cast("int"), F.lit(-1))
    return [frame(0).alias("start"), frame(1).alias("end"), F.split(F.regexp_replace(name, r"\.[0-9]", ""), ",").alias("labels"), state.alias("state"), rest.alias("comment")]


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    rows = lines(spark, path)
    out = rows.select("file", "value", *parse_segments(F.col("value")))
    wrong = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") > F.col("end"))
    return out.withColumn("start", F.when(wrong, F.raise_error(F.concat(F.lit("invalid start or end time: "), F.col("value")))).otherwise(F.col("start"))).drop("value")


def segment_lines(segments: DataFrame, samples_per_frame: float = SAMPLE_RATE / FRAME_RATE) -> DataFrame:
    """value: lines that `read_segments` reads."""
    name = F.concat(F.array_join("labels", ","), F.when(F.col("state") >= 0, F.concat(F.lit("."), F.col("state").cast("string"))).otherwise(""))
    times = [(F.col(c) * samples_per_frame).cast("long").cast("string") for c in ("start", "end")]
    return segments.select(F.rtrim(F.when(F.col("start") < 0, F.concat_ws(" ", name, "comment")).otherwise(F.concat_ws(" ", *times, name, "comment"))).alias("value"))


def parse_speakers(_: str, content: bytes) -> list[tuple]:
    """(kind, id, module, key, values) of blocks `speaker ID { MODULE { key value ... } }`."""
    out, depth, kind, name, module = [], 0, "", "", ""
    for token in re.findall(r"[{}]|[^{}\n]+", content.decode()):
        words = token.split()
        if token == "{":
            depth += 1
        elif token == "}":
            depth -= 1
            if depth < 0:
                raise ValueError("unbalanced braces in a speaker file")
        elif words and depth == 0:
            kind, name = words[0], words[1] if len(words) > 1 else ""
        elif words and depth == 1:
            module = words[-1]
        elif words:
            out.append((kind, name, module, words[0], words[1:]))
    return out


def read_speakers(spark: SparkSession, path: str) -> DataFrame:
    return whole_files(spark, path, parse_speakers, "kind string, id string, module string, key string, values array<string>")


def speaker_text(rows: list[tuple[str, str, str, str, list[str]]]) -> str:
    """What `parse_speakers` reads."""
    nested: dict = {}
    for kind, name, module, key, values in rows:
        nested.setdefault((kind, name), {}).setdefault(module, []).append(f"    {key} {' '.join(values)}\n")
    blocks = []
    for (kind, name), modules in nested.items():
        blocks.append(f"{kind} {name}\n{{\n" + "".join(f"  {m}\n  {{\n{''.join(ks)}  }}\n" for m, ks in modules.items()) + "}\n")
    return "\n".join(blocks)


def with_speakers(recipe: DataFrame, speakers: DataFrame, default: str = "default") -> DataFrame:
    """Recipe rows with value of their speaker (speaker, value), or of the default speaker; an error without either."""
    standard = speakers.where(F.col("speaker") == default).select(F.col("value").alias("_default"))
    rows = recipe.join(speakers, "speaker", "left").join(F.broadcast(standard.limit(1)), F.lit(True), "left")
    missing = F.raise_error(F.concat(F.lit("Unknown speaker "), F.coalesce("speaker", F.lit(""))))
    value = F.when(F.col("value").isNull() & F.col("_default").isNull(), missing).otherwise(F.coalesce("value", "_default"))
    return rows.withColumn("value", value).drop("_default")


def windows_of(samples: np.ndarray, sample_rate: int, frame_rate: float = FRAME_RATE, emphasis: float = PRE_EMPHASIS) -> np.ndarray:
    """Overlapping windows of pre-emphasized samples, two frames wide."""
    width, advance = int(2 * sample_rate / frame_rate), sample_rate / frame_rate
    last = math.floor((len(samples) - width - 1) / advance)
    x = samples[1:] - emphasis * samples[:-1]
    starts = [int(f * advance) for f in range(max(0, last + 1))]
    return np.array([x[s : s + width] for s in starts]).reshape(-1, width)


AUDIO = "file string, frame int, n int, x array<double>"


def parse_audio(raw_rate: int | None = None, big_endian: bool = False, frame_rate: float = FRAME_RATE) -> Callable[[str, bytes], list[tuple]]:
    """Windows of WAV files of 16 or 32 bits, or of headerless samples of 16 bits at `raw_rate`."""

    def parse(name: str, content: bytes) -> list[tuple]:
        if raw_rate:
            rate, data = raw_rate, np.frombuffer(content, ">i2" if big_endian else "<i2")
        else:
            with wave.open(io.BytesIO(content)) as w:
                if w.getsampwidth() not in (2, 4):
                    raise ValueError(f"{name}: samples of 16 bits or of 32 are needed")
                rate, data = w.getframerate(), np.frombuffer(w.readframes(w.getnframes()), f"<i{w.getsampwidth()}")[:: w.getnchannels()]
        frames = windows_of(data.astype(float), rate, frame_rate)
        return [(name, i, len(frames), x) for i, x in enumerate(frames.tolist())]

    return parse


def read_audio(spark: SparkSession, path: str, raw_rate: int | None = None, big_endian: bool = False, frame_rate: float = FRAME_RATE) -> DataFrame:
    """file, frame, n, x of WAV files of 16 or 32 bits, or of headerless samples at `raw_rate`."""
    return whole_files(spark, path, parse_audio(raw_rate, big_endian, frame_rate), AUDIO)


def wave_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A WAV file of 16-bit samples, or of 32 bits where one does not fit into 16."""
    width = 2 if len(samples) == 0 or (samples.min() >= -32768 and samples.max() <= 32767) else 4
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(samples.astype(f"<i{width}").tobytes())
    return out.getvalue()


def read_features(spark: SparkSession, path: str, short_header: bool = False) -> DataFrame:
    """file, frame, n, x of files with a dimension (int32, or one byte) and float32 vectors."""

    return whole_files(spark, path, parse_features(short_header), AUDIO)


def parse_features(short_header: bool = False) -> Callable[[str, bytes], list[tuple]]:
    def parse(name: str, content: bytes) -> list[tuple]:
        dim, skip = (content[0], 1) if short_header else (int.from_bytes(content[:4], "little"), 4)
        x = np.frombuffer(content[skip : len(content) - (len(content) - skip) % (4 * dim)], "<f4").reshape(-1, dim).astype(float)
        return [(name, i, len(x), v) for i, v in enumerate(x.tolist())]

    return parse


def feature_bytes(x: np.ndarray, short_header: bool = False) -> bytes:
    """What `read_features` reads."""
    return (bytes([x.shape[1]]) if short_header else int(x.shape[1]).to_bytes(4, "little")) + x.astype("<f4").tobytes()


LIKELIHOODS = "file string, frame int, logp array<double>"


def parse_likelihoods(name: str, content: bytes) -> list[tuple]:
    """The number of states (int32, big end first), the byte width and codes."""
    states, size = int.from_bytes(content[:4], "big"), content[4]
    codes = np.frombuffer(content[5 : len(content) - (len(content) - 5) % (states * size)], {1: ">u1", 2: ">u2", 4: ">f4"}[size]).reshape(-1, states)
    x = codes.astype(float) / {1: -24.0, 2: -1820.0, 4: 1.0}[size]
    return [(name, i, v) for i, v in enumerate(x.tolist())]


def read_likelihoods(spark: SparkSession, path: str) -> DataFrame:
    return whole_files(spark, path, parse_likelihoods, LIKELIHOODS)


def likelihood_bytes(logp: np.ndarray, width: int = 2) -> bytes:
    """What `read_likelihoods` reads, with one, two or four bytes a state."""
    if width == 4:
        codes = logp.astype(">f4")
    elif width == 2:
        codes = np.where(logp < -36.008, 65535, np.floor(-1820 * logp + 0.5)).astype(">u2")
    else:
        codes = np.minimum(255, np.floor(-24 * logp + 0.5)).astype(">u1")
    return int(logp.shape[1]).to_bytes(4, "big") + bytes([width]) + codes.tobytes()


def read_arpa(spark: SparkSession, path: str) -> DataFrame:
    """file, n, context, word, lp, bo of ARPA models; sections follow from marks, so a file is parsed whole."""

    def parse(name: str, content: bytes) -> list[tuple]:
        out, n, counts, seen = [], 0, {}, {}
        for line in content.decode().splitlines():
            line = line.strip()
            if m := re.fullmatch(r"\\(\d+)-grams:", line):
                n = int(m[1])
            elif m := re.fullmatch(r"ngram\s+(\d+)\s*=\s*(\d+)", line):
                counts[int(m[1])] = int(m[2])
            elif line == "\\end\\":
                break
            elif n and line:
                words = line.split()
                gram = words[1 : n + 1]
                out.append((name, n, " ".join(gram[:-1]), gram[-1], float(words[0]), float(words[n + 1]) if len(words) > n + 1 else 0.0))
                seen[n] = seen.get(n, 0) + 1
        if seen != {k: v for k, v in counts.items() if v}:
            raise ValueError(f"{name}: sections have {seen} n-grams, the header {counts}")
        return out

    return whole_files(spark, path, parse, "file string, n int, context string, word string, lp double, bo double")


def arpa_lines(model: DataFrame) -> DataFrame:
    """name, place and value: ARPA models of (name, n, context, word, lp, bo) as lines for `write_texts`, sorted in each order."""
    counts = model.groupBy("name", "n").agg(F.count(F.lit(1)).alias("c"))
    n = F.col("n").cast("int")
    row = lambda df, *a: df.select("name", F.struct(a[0].cast("int").alias("n"), F.lit(a[1]).alias("kind"), a[3].alias("key")).alias("place"), a[2].alias("value"))
    number = lambda c: F.format_string("%.12g", c)
    words = F.trim(F.concat_ws(" ", "context", "word"))
    grams = row(model, n, 1, F.concat_ws("\t", number(F.col("lp")), words, F.when(F.col("bo") != 0, number(F.col("bo")))), words)
    names = model.select("name").distinct()
    heads = [row(names, F.lit(-1), 0, F.lit("\\data\\"), F.lit("")), row(counts, F.lit(0), 0, F.concat(F.lit("ngram "), n.cast("string"), F.lit("="), F.col("c").cast("string")), n.cast("string")), row(counts, n, 0, F.concat(F.lit("\n\\"), n.cast("string"), F.lit("-grams:")), F.lit("")), row(names, F.lit(999), 9, F.lit("\n\\end\\"), F.lit(""))]
    out = grams
    for h in heads:
        out = out.union(h)
    return out


def arpa_text(rows: list[tuple[int, str, str, float, float]]) -> str:
    """An ARPA model of (n, context, word, lp, bo), sorted in each order."""
    orders = sorted({r[0] for r in rows})
    out = ["\\data\\", *[f"ngram {n}={sum(r[0] == n for r in rows)}" for n in orders], ""]
    for n in orders:
        out.append(f"\\{n}-grams:")
        for _, context, word, lp, bo in sorted((r for r in rows if r[0] == n), key=lambda r: (r[1].split(), r[2])):
            out.append("\t".join([f"{lp:g}", f"{context} {word}".strip(), *[f"{bo:g}"] * bool(bo)]))
        out.append("")
    return "\n".join([*out, "\\end\\", ""])


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """word, prob, units of lines `word(prob) unit ...`."""
    head = F.regexp_extract("value", r"^(\S+?)(?:\(([0-9.eE+-]+)\))?(?:\s|$)", 1)
    prob = F.coalesce(F.regexp_extract("value", r"^\S+?\(([0-9.eE+-]+)\)(?:\s|$)", 1).try_cast("double"), F.lit(1.0))
    return lines(spark, path).select(head.alias("word"), prob.alias("prob"), F.filter(F.split(F.regexp_replace("value", r"^\S+", ""), r"\s+"), lambda u: u != "").alias("units"))


def known_words(lexicon: DataFrame, units: DataFrame) -> DataFrame:
    """Lexicon rows all of whose units are in `units`; other pronunciations of their words stay or go by themselves."""
    spelled = lexicon.select(F.col("units").alias("_units")).distinct()
    missing = spelled.select("_units", F.explode("_units").alias("unit")).join(units.select("unit"), "unit", "left_anti").select("_units").distinct()
    return lexicon.join(missing, F.col("units") == F.col("_units"), "left_anti")


def read_lattice(spark: SparkSession, path: str) -> DataFrame:
    """file, arc, src, dst, word, am, lm of SLF lattices (lines J=... S=... E=... W=... a=... l=...)."""
    rows = lines(spark, path).where(F.col("value").startswith("J="))
    get = lambda k, kind: F.regexp_extract("value", rf"(?:^|\s){k}=(\S+)", 1).try_cast(kind)
    return rows.select("file", get("J", "int").alias("arc"), get("S", "int").alias("src"), get("E", "int").alias("dst"), get("W", "string").alias("word"), F.coalesce(get("a", "double"), F.lit(0.0)).alias("am"), F.coalesce(get("l", "double"), F.lit(0.0)).alias("lm"))


def lattice_lines(arcs: DataFrame) -> DataFrame:
    parts = [F.concat(F.lit(f"{k}="), F.col(c).cast("string")) for k, c in (("J", "arc"), ("S", "src"), ("E", "dst"), ("W", "word"), ("a", "am"), ("l", "lm"))]
    return arcs.select(F.concat_ws(" ", *parts).alias("value"))


LATTICES = "file string, nodes int, arc int, src int, dst int, word string, am double, lm double"


def parse_lattice(grammar: bool = False) -> Callable[[str, bytes], list[tuple]]:
    """Arcs of an SLF file with its declared N nodes and L arcs; with `grammar` it must be of version 1.0, scale 1, with no scores."""

    def parse(name: str, content: bytes) -> list[tuple]:
        wanted: dict[str, str] = {}
        nodes, arcs = [], []
        for line in content.decode().splitlines():
            fields = dict(f.split("=", 1) for f in line.split() if "=" in f)
            if "J" in fields:
                arcs.append(fields)
            elif "I" in fields:
                nodes.append(int(fields["I"]))
            else:
                wanted |= fields
        if len(nodes) != int(wanted.get("N", -1)) or len(arcs) != int(wanted.get("L", -1)):
            raise ValueError(f"{name}: {len(nodes)} nodes and {len(arcs)} arcs, {wanted.get('N')} and {wanted.get('L')} declared")
        if grammar:
            if wanted.get("VERSION") != "1.0" or float(wanted.get("lmscale", 0)) != 1 or float(wanted.get("wdpenalty", 1)) != 0:
                raise ValueError(f"{name}: a grammar of version 1.0 with scale 1 and no penalty is needed")
            if nodes != list(range(len(nodes))) or any(int(a["J"]) != i or float(a.get("a", 0)) or float(a.get("l", 0)) for i, a in enumerate(arcs)):
                raise ValueError(f"{name}: nodes and arcs in order and without scores are needed")
        known = set(nodes)
        out = [(name, len(nodes), int(a["J"]), int(a["S"]), int(a["E"]), a["W"], float(a.get("a", 0)), float(a.get("l", 0))) for a in arcs]
        if any(r[3] not in known or r[4] not in known for r in out):
            raise ValueError(f"{name}: an arc has an unknown node")
        return out

    return parse


def read_lattices(spark: SparkSession, path: str, grammar: bool = False) -> DataFrame:
    """file, nodes, arc, src, dst, word, am, lm of whole SLF files, whose counts are checked."""
    return whole_files(spark, path, parse_lattice(grammar), LATTICES)


def lattice_files(arcs: DataFrame) -> DataFrame:
    """name, place and value: lattices of (name, arc, src, dst, word, am, lm) as lines for `write_texts`."""
    ends = arcs.select("name", F.explode(F.array("src", "dst")).alias("node")).distinct()
    n = ends.groupBy("name").agg(F.count(F.lit(1)).alias("nodes")).join(arcs.groupBy("name").agg(F.count(F.lit(1)).alias("arcs")), "name")
    place = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("long").alias("key")).alias("place")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("value")
    out = n.select("name", place(0, F.lit(0)), text("VERSION=1.0\nlmscale=1.00\nwdpenalty=0.00\nN=", F.col("nodes"), "\tL=", F.col("arcs")))
    out = out.union(ends.select("name", place(1, F.col("node")), text("I=", F.col("node"), "\tt=0.00")))
    arc = text("J=", F.col("arc"), "\tS=", F.col("src"), "\tE=", F.col("dst"), "\tW=", F.col("word"), "\tv=0\ta=", F.col("am"), "\tl=", F.col("lm"))
    return out.union(arcs.select("name", place(2, F.col("arc")), arc))


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """file, kind (I, F or T), src, dst, input, output, score of network lines `I n`, `F n`, `T src dst [in [out [score]]]`."""
    at = lambda i: F.get(F.split("value", r"\s+"), F.lit(i))
    arc = F.col("value").startswith("T")
    return lines(spark, path).where(F.col("value").rlike("^[IFT] ")).select("file", at(0).alias("kind"), at(1).try_cast("int").alias("src"), F.when(arc, at(2).try_cast("int")).alias("dst"), F.when(arc, at(3)).alias("input"), F.when(arc, at(4)).alias("output"), F.coalesce(F.when(arc, at(5).try_cast("double")), F.lit(0.0)).alias("score"))


def network_lines(arcs: DataFrame, first: DataFrame, last: DataFrame) -> DataFrame:
    """name, place and value: networks as lines for `write_texts`; arcs have name, src, dst, input, output and score, the others name and node."""
    text = lambda *parts: F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("value")
    place = lambda kind, *key: F.struct(F.lit(kind).alias("kind"), *[k.cast("long").alias(f"k{i}") for i, k in enumerate(key)]).alias("place")
    zero = F.lit(0)
    out = first.select("name", place(0, F.col("node"), zero), text("I", F.col("node"))).union(last.select("name", place(1, F.col("node"), zero), text("F", F.col("node"))))
    return out.union(arcs.select("name", place(2, F.col("src"), F.col("dst")), text("T", F.col("src"), F.col("dst"), F.col("input"), F.col("output"), F.col("score"))))


def read_weighted_arcs(spark: SparkSession, path: str) -> DataFrame:
    """file, src, dst, symbol, score of arcs `src dst symbol score`, the score being minus a natural logarithm; a line with a node alone ends there and has no dst."""
    at = lambda i: F.get(F.split("value", r"\s+"), F.lit(i))
    score = -F.coalesce(at(3).try_cast("double"), F.lit(0.0)) + F.lit(0.0)
    return lines(spark, path).select("file", at(0).try_cast("int").alias("src"), at(1).try_cast("int").alias("dst"), at(2).alias("symbol"), score.alias("score"))


def pdf_by_node(arcs: DataFrame) -> DataFrame:
    """dst, pdf: the pdf that all arcs into a node have; two different ones are an error."""
    out = arcs.where("pdf is not null").groupBy("dst").agg(F.min("pdf").alias("pdf"), F.max("pdf").alias("_other"))
    return out.withColumn("pdf", F.when(F.col("pdf") != F.col("_other"), F.raise_error(F.concat(F.lit("conflicting pdfs at node "), F.col("dst").cast("string")))).otherwise(F.col("pdf"))).drop("_other")


def parse_model(_: str, content: bytes) -> list[tuple]:
    """(gid, kind, mean, cov) of a Gaussian file: a count, dimension and kind, then one line each of mean and covariance."""
    rows = content.decode().split("\n")
    count, dim, kind = rows[0].split()
    out = []
    for gid, line in enumerate(r for r in rows[1:] if r.strip()):
        words = line.split()
        own = kind
        if kind == "variable":
            own, words = words[0], words[1:]
        numbers = [float(w) for w in words]
        out.append((gid, own, numbers[: int(dim)], numbers[int(dim) :]))
    if len(out) != int(count):
        raise ValueError(f"{len(out)} Gaussians, {count} declared")
    return out


def read_gaussians(spark: SparkSession, path: str) -> DataFrame:
    return whole_files(spark, path, parse_model, "gid int, kind string, mean array<double>, cov array<double>")


def gaussian_text(rows: list[tuple[int, str, list[float], list[float]]], dim: int) -> str:
    kinds = {r[1] for r in rows}
    kind = kinds.pop() if len(kinds) == 1 else "variable"
    lines_ = [" ".join([*[r[1]] * (kind == "variable"), *[repr(v) for v in (*r[2], *r[3])]]) for r in sorted(rows)]
    return "\n".join([f"{len(rows)} {dim} {kind}", *lines_, ""])


def read_mixtures(spark: SparkSession, path: str) -> DataFrame:
    """pdf, gid, weight of lines `n gid weight gid weight ...` after a count; pdfs are numbered by line."""

    def parse(_: str, content: bytes) -> list[tuple]:
        out = []
        for pdf, line in enumerate(r for r in content.decode().split("\n")[1:] if r.strip()):
            words = line.split()
            out += [(pdf, int(words[2 * i + 1]), float(words[2 * i + 2])) for i in range(int(words[0]))]
        return out

    return whole_files(spark, path, parse, "pdf int, gid int, weight double")


def mixture_text(rows: list[tuple[int, int, float]]) -> str:
    """What `read_mixtures` reads, of (pdf, gid, weight)."""
    by: dict[int, list[str]] = {}
    for pdf, gid, weight in sorted(rows):
        by.setdefault(pdf, []).append(f"{gid} {weight!r}")
    return "\n".join([str(len(by)), *[f"{len(v)} {' '.join(v)}" for _, v in sorted(by.items())], ""])


HMMS = "file string, hmm int, label string, state int, pdf int, target int, prob double"


def parse_hmms(name: str, content: bytes) -> list[tuple]:
    """Transitions of models: PHONE and a count, then for each model its number, states (two of them without a pdf), label, pdfs, and for
    each state itself, how many ways lead on, and the target and probability of each."""
    words = iter(content.decode().split())
    if next(words, "") != "PHONE":
        raise ValueError(f"{name}: not a file of models")
    out = []
    for _ in range(int(next(words))):
        hmm, states, label = int(next(words)), int(next(words)), next(words)
        pdfs = [int(next(words)) for _ in range(states)]
        for s in range(states):
            state, ways = int(next(words)), int(next(words))
            if state != s:
                raise ValueError(f"{name}: states of {label} are out of order")
            for _ in range(ways):
                target, prob = int(next(words)), float(next(words))
                if not 1 <= target < states:
                    raise ValueError(f"{name}: {label} has an invalid transition")
                out.append((name, hmm, label, s, pdfs[s], target, prob))
    return out


def read_hmms(spark: SparkSession, path: str) -> DataFrame:
    return whole_files(spark, path, parse_hmms, HMMS)


def hmm_text(rows: list[tuple[int, str, int, int, int, float]]) -> str:
    """What `read_hmms` reads, of (hmm, label, state, pdf, target, prob)."""
    models: dict[tuple[int, str], dict[int, tuple[int, list]]] = {}
    for hmm, label, state, pdf, target, prob in sorted(rows):
        models.setdefault((hmm, label), {}).setdefault(state, (pdf, []))[1].append((target, prob))
    out = ["PHONE", str(len(models))]
    for (hmm, label), states in models.items():
        count = max(max(states), max(t for _, ways in states.values() for t, _ in ways)) + 1
        pdfs = [states[s][0] if s in states else -2 for s in range(count)]
        out += [f"{hmm} {count} {label}", " ".join(map(str, pdfs))]
        out += [" ".join([str(s), str(len(states.get(s, (0, []))[1])), *[f"{t} {p!r}" for t, p in states.get(s, (0, []))[1]]]) for s in range(count)]
    return "\n".join([*out, ""])


def parse_durations(name: str, content: bytes) -> list[tuple]:
    """(file, state, shape, scale) of gamma distributions by state: version 4, or 3 where the count is the last state's number."""
    words = content.decode().split()
    version, count = int(words[0]), int(words[1]) + (words[0] == "3")
    if version not in (3, 4) or len(words) != 2 + 3 * count:
        raise ValueError(f"{name}: durations of version 3 or 4 are needed")
    out = [(name, int(words[2 + 3 * i]), float(words[3 + 3 * i]), float(words[4 + 3 * i])) for i in range(count)]
    if [r[1] for r in out] != list(range(count)):
        raise ValueError(f"{name}: states are out of order")
    return out


def read_durations(spark: SparkSession, path: str) -> DataFrame:
    return whole_files(spark, path, parse_durations, "file string, state int, shape double, scale double")


def duration_lines(models: DataFrame) -> DataFrame:
    """name, place and value: durations of (name, state, shape, scale) as lines for `write_texts`."""
    head = models.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select("name", F.lit(-1).alias("place"), F.concat(F.lit("4\n"), F.col("n").cast("string")).alias("value"))
    return head.union(models.select("name", F.col("state").alias("place"), F.concat_ws(" ", F.col("state").cast("string"), F.format_string("%.4f", "shape"), F.format_string("%.4f", "scale")).alias("value")))


def natural_key(name: Column) -> Column:
    """A string whose order is that of names with numbers in them: digits count as numbers."""
    parts = F.regexp_extract_all(name, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


def write_states(frames: DataFrame, folder: str) -> None:
    """Features by state, one folder each, compressed."""
    frames.write.mode("overwrite").partitionBy("state").option("compression", "gzip").json(folder)


def dump_frames(frames: DataFrame, first: int, last: int, backward: bool = False, noise: float = 0.0, dim: int = 0, seed: int = 0) -> DataFrame:
    """Frames first .. last of each utterance in order, or backward; noise of a standard deviation is added to `dim` elements."""
    rows = frames.where(F.col("frame").between(first, last))
    if noise:
        rows = rows.withColumn("x", F.array(*[F.element_at("x", i + 1) + F.randn(seed + i) * noise for i in range(dim)]))
    return rows.orderBy("utt", F.desc("frame") if backward else "frame")
