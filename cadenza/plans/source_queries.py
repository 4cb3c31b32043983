"""Queries that write the tables' rows in a format and read them back, and their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import scalars
from cadenza.operators import frames as fr
from cadenza.operators import language_model as lm
from cadenza.operators.statistics import gaussian_ml, moments
from cadenza.operators.storage import new_folder
from cadenza.plans.feature_graph import graph_edges, graph_messages
from cadenza.plans.feature_queries import FRAMES
from cadenza.plans.statistics_queries import MODEL, RUNS, _r, _runs, _vectors
from cadenza.sources import files
from cadenza.sources.tables import read

RATE = 250
#: Rows whose contents are made before they are handed on.
ROWS = 256


def src_phn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of labels as segment files, one line each with the user as comment."""
    runs = _runs(spark, sf_dir).select("start", "end", F.array("label").alias("labels"), (F.col("utt") % 4).cast("int").alias("state"), F.col("utt").cast("string").alias("comment"))
    folder = new_folder(spark, "phn")
    files.segment_lines(runs).write.text(folder)
    back = files.read_segments(spark, folder)
    return back.select(F.col("comment").cast("long").alias("utt"), "start", "end", F.element_at("labels", 1).alias("label"), "state")


def src_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    line = F.concat(F.lit("audio=c"), F.col("c_custkey").cast("string"), F.lit(".wav speaker="), F.col("c_mktsegment"), F.lit(" start-time="), (F.col("c_custkey") / 4).cast("string"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" end-line="), F.col("c_nationkey").cast("string"))).otherwise(""))
    folder = new_folder(spark, "recipe")
    c.select(line.alias("value")).write.text(folder)
    return files.read_recipe(spark, folder).select("audio", "speaker", "start_time", F.coalesce("end_line", F.lit(-1)).alias("end_line"))


def src_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A speaker of each nation, with a warp factor and two corners."""
    n = read(spark, sf_dir, "nation")
    value = F.format_string("speaker %s\n{\n  vtln\n  {\n    warp_factor %d.5\n    turn %d %d\n  }\n}", "n_name", "n_nationkey", "n_regionkey", "n_nationkey")
    folder = new_folder(spark, "speakers")
    n.select(value.alias("value")).write.text(folder)
    return files.read_speakers(spark, folder).select("kind", "id", "module", "key", F.array_join("values", " ").alias("values"))


def _bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A back-off model of the names of parts for each half of them."""
    p = read(spark, sf_dir, "part")
    out = None
    for half in (0, 1):
        sents = lm.sentences(p.where(F.col("p_partkey") % 2 == half), "p_partkey", "p_name")
        model = lm.ngram_model([lm.count_ngrams(sents, "p_partkey", n) for n in (1, 2)]).withColumn("name", F.lit(f"half{half}"))
        out = model if out is None else out.union(model)
    return out


def src_arpa(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "arpa")
    files.write_texts(files.arpa_lines(_bigrams(spark, sf_dir)), folder)
    back = files.read_arpa(spark, f"{folder}/*")
    return back.select(files.name_of(F.col("file")).alias("name"), "n", "context", "word", _r("lp").alias("lp"), _r("bo").alias("bo"))


def lm_gram_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of n-grams in the order of an ARPA file's section."""
    grams = _bigrams(spark, sf_dir).select("name", "n", "context", "word")
    w = Window.partitionBy("name", "n").orderBy(F.trim(F.concat_ws(" ", "context", "word")))
    return grams.withColumn("place", F.row_number().over(w))


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of brands spelled by two words of their parts' names; each word has many pronunciations."""
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("word"), (F.col("p_size") / 64).alias("prob"), F.split("p_name", " ").alias("units")).distinct()


def src_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "lexicon")
    _lexicon(spark, sf_dir).select(F.concat(F.col("word"), F.lit("("), F.col("prob").cast("string"), F.lit(") "), F.array_join("units", " ")).alias("value")).write.text(folder)
    return files.read_lexicon(spark, folder).select("word", "prob", F.array_join("units", " ").alias("units"))


def lexicon_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pronunciations without the units that begin with a letter after r; others of the same word stay."""
    lexicon = _lexicon(spark, sf_dir)
    units = lexicon.select(F.explode("units").alias("unit")).distinct().where("unit < 's'")
    return files.known_words(lexicon, units).select("word", "prob", F.array_join("units", " ").alias("units"))


def _supplier_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of suppliers for each nation, with an arc that skips every third."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = read(spark, sf_dir, "supplier").withColumn("i", F.row_number().over(w) - 1)
    arcs = s.select(F.concat(F.lit("net"), F.col("s_nationkey").cast("string")).alias("name"), F.col("i").alias("arc"), F.col("i").alias("src"), (F.col("i") + 1).alias("dst"), F.col("s_name").alias("word"), F.round(F.col("s_acctbal") / 100, 2).alias("am"), (-(F.col("s_suppkey") % 8) / 4).alias("lm"))
    return arcs


def src_slf(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "slf")
    files.write_texts(files.lattice_files(_supplier_arcs(spark, sf_dir)), folder)
    return files.read_lattices(spark, f"{folder}/*").withColumn("name", files.name_of(F.col("file"))).drop("file")


def src_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same arcs as grammars, which have no scores."""
    folder = new_folder(spark, "grammar")
    files.write_texts(files.lattice_files(_supplier_arcs(spark, sf_dir).withColumns({"am": F.lit(0.0), "lm": F.lit(0.0)})), folder)
    return files.read_lattices(spark, f"{folder}/*", grammar=True).select(files.name_of(F.col("file")).alias("name"), "src", "dst", "word")


def src_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks of each nation's suppliers, with first and last nodes."""
    arcs = _supplier_arcs(spark, sf_dir).select("name", "src", "dst", F.col("word").alias("input"), F.concat(F.lit("o"), F.col("dst").cast("string")).alias("output"), F.col("lm").alias("score"))
    ends = arcs.groupBy("name").agg(F.max("dst").alias("node"))
    folder = new_folder(spark, "network")
    files.write_texts(files.network_lines(arcs, ends.select("name", F.lit(0).alias("node")), ends), folder)
    back = files.read_network(spark, f"{folder}/*")
    return back.select(files.name_of(F.col("file")).alias("name"), "kind", "src", F.coalesce("dst", F.lit(-1)).alias("dst"), "input", "output", "score")


def src_weighted_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs with costs, which are scores with the other sign."""
    arcs = _supplier_arcs(spark, sf_dir)
    folder = new_folder(spark, "fsmt")
    files.write_texts(arcs.select("name", F.col("arc").alias("place"), F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), "word", (-F.col("lm")).cast("string")).alias("value")), folder)
    back = files.read_weighted_arcs(spark, f"{folder}/*")
    return back.select(files.name_of(F.col("file")).alias("name"), "src", "dst", "symbol", "score")


def src_hmms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of three states for each nation, as a file by region."""
    n = read(spark, sf_dir, "nation")
    head = n.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("c")).select(F.col("n_regionkey").cast("string").alias("name"), F.lit(-1).alias("place"), F.concat(F.lit("PHONE\n"), F.col("c").cast("string")).alias("value"))
    stay = F.round(F.col("n_nationkey") / 32, 5)
    model = F.format_string("%d 4 %s\n-1 -2 %d %d\n0 1 2 1.0\n1 0\n2 2 2 %s 3 %s\n3 1 1 0.5", F.col("n_nationkey"), F.col("n_name"), F.col("n_nationkey"), F.col("n_nationkey") + 1, stay.cast("string"), (1 - stay).cast("string"))
    folder = new_folder(spark, "hmms")
    files.write_texts(head.union(n.select(F.col("n_regionkey").cast("string").alias("name"), F.col("n_nationkey").alias("place"), model.alias("value"))), folder)
    return files.read_hmms(spark, f"{folder}/*").select("hmm", "label", "state", "pdf", "target", "prob")


def src_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.lit("all").alias("name"), F.col("n_nationkey").alias("state"), (F.col("n_nationkey") / 8).alias("shape"), (F.col("n_regionkey") / 4).alias("scale"))
    folder = new_folder(spark, "durations")
    files.write_texts(files.duration_lines(n), folder)
    return files.read_durations(spark, f"{folder}/*").select("state", "shape", "scale")


def src_gaussians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Gaussians of the labels of vectors, as a model file: one line each."""
    g = gaussian_ml(moments(_vectors(spark, sf_dir), "label", "x", "g"))
    number = lambda c: F.array_join(F.transform(c, lambda v: F.format_string("%.9g", v)), " ")
    line = g.select(F.lit("all").alias("name"), F.col("label").alias("place"), F.concat_ws(" ", number("mean"), number("variance")).alias("value"))
    head = g.groupBy().agg(F.count(F.lit(1)).alias("c"), F.max(F.size("mean")).alias("d")).select(F.lit("all").alias("name"), F.lit(-1).alias("place"), F.format_string("%d %d diagonal_cov", "c", "d").alias("value"))
    folder = new_folder(spark, "gaussians")
    files.write_texts(head.union(line), folder)
    back = files.read_gaussians(spark, f"{folder}/*").select("gid", F.posexplode(F.arrays_zip("mean", "cov")).alias("i", "s"))
    return back.select("gid", "i", _r("s.mean").alias("mean"), _r("s.cov").alias("variance"))


def src_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixtures of the parts of each size, weighted by price: a line for each size."""
    p = read(spark, sf_dir, "part")
    m = p.groupBy("p_size").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_retailprice"))).alias("g"))
    value = F.concat_ws(" ", F.size("g").cast("string"), F.array_join(F.transform("g", lambda s: F.concat_ws(" ", s["p_partkey"].cast("string"), s["p_retailprice"].cast("string"))), " "))
    head = m.groupBy().agg(F.count(F.lit(1)).alias("c")).select(F.lit("all").alias("name"), F.lit(-1).alias("place"), F.col("c").cast("string").alias("value"))
    folder = new_folder(spark, "mixtures")
    files.write_texts(head.union(m.select(F.lit("all").alias("name"), F.col("p_size").alias("place"), value.alias("value"))), folder)
    return files.read_mixtures(spark, f"{folder}/*").select("pdf", "gid", "weight")


def _by_user(spark: SparkSession, sf_dir: str, column) -> DataFrame:
    e = read(spark, sf_dir, "events")
    values = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", column.alias("v")))), lambda s: s["v"])
    return e.groupBy(F.col("user_id").cast("string").alias("path")).agg(values.alias("v"))


def _content(rows: DataFrame, make) -> DataFrame:
    """path and content: bytes that `make` makes of each row's values, one row at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                content = pa.array([make(np.array(v.as_py(), float)) for v in part.column("v")], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("path"), content], names=["path", "content"])

    return rows.select("path", "v").mapInArrow(run, "path string, content binary")


def src_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' values as samples of audio files, cut into windows of pre-emphasized samples."""
    contents = _content(_by_user(spark, sf_dir, (F.col("value") * 50).cast("int")), lambda x: files.wave_bytes(x, RATE))
    back = files.parsed(contents, files.parse_audio(), files.AUDIO)
    return back.select(F.col("file").cast("long").alias("utt"), "frame", "n", *[_r(F.element_at("x", i + 1), 4).alias(f"x{i}") for i in range(4)])


def src_last_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last whole window of each user's raw samples, big end first."""
    contents = _content(_by_user(spark, sf_dir, (F.col("value") * 50).cast("int")), lambda x: x.astype(">i2").tobytes())
    back = files.parsed(contents, files.parse_audio(RATE, big_endian=True), files.AUDIO)
    return back.groupBy(F.col("file").cast("long").alias("utt")).agg(F.max("frame").alias("last"))


def src_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precomputed features: each user's frames as single-precision vectors."""
    v = F.array((F.col("event_id") % 97).cast("double"), F.length("event_type").cast("double"))
    contents = _content(_by_user(spark, sf_dir, v), files.feature_bytes)
    back = files.parsed(contents, files.parse_features(), files.AUDIO)
    return back.select(F.col("file").cast("long").alias("utt"), "frame", "n", F.element_at("x", 1).alias("x0"), F.element_at("x", 2).alias("x1"))


def _codes(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    v = F.array(-F.col("value") / 12, -F.col("event_id") % 7 / 2.0)
    back = files.parsed(_content(_by_user(spark, sf_dir, v), lambda x: files.likelihood_bytes(x, width)), files.parse_likelihoods, files.LIKELIHOODS)
    return back.select(F.col("file").cast("long").alias("utt"), "frame", _r(F.element_at("logp", 1), 5).alias("p0"), _r(F.element_at("logp", 2), 5).alias("p1"))


def src_lna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State likelihoods with two bytes each."""
    return _codes(spark, sf_dir, 2)


def src_lna_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State likelihoods with one byte each."""
    return _codes(spark, sf_dir, 1)


def src_state_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by label, one folder each, and back."""
    f = fr.event_frames(read(spark, sf_dir, "events"))
    names = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    labels = names.select(F.col("user_id").alias("utt"), (F.row_number().over(w) - 1).alias("frame"), F.col("event_type").alias("state"))
    folder = new_folder(spark, "states")
    files.write_states(f.join(labels, ["utt", "frame"]).select("utt", "frame", "state", "x"), folder)
    back = spark.read.json(folder)
    return back.select("utt", F.col("frame").cast("int").alias("frame"), "state", F.element_at("x", 1).alias("x0"))


def feacat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames 2 to 8 of each user."""
    return fr.unpacked(files.dump_frames(fr.event_frames(read(spark, sf_dir, "events")), 2, 8, backward=True), "x", 3)


def _order_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each order: a base and a module for each line, some of a type that is not known, twice, or before their source."""
    li = read(spark, sf_dir, "lineitem")
    source = F.when(F.col("l_quantity") > 25, F.concat(F.lit(" m"), (F.col("l_partkey") + 1) % 6)).otherwise("")
    kind = F.when(F.col("l_suppkey") % 9 == 0, "gamma").otherwise("merge")
    block = F.concat(F.lit("module\n{\n  name m"), F.col("l_partkey") % 6, F.lit("\n  type "), kind, F.lit("\n  sources base"), source, F.lit("\n}\n"))
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", block.alias("block"))))
    text = F.concat(F.lit("module\n{\n  name base\n  type audiofile\n}\n"), F.array_join(F.transform("lines", lambda x: x["block"]), ""))
    return li.groupBy("l_orderkey").agg(lines.alias("lines")).select("l_orderkey", text.alias("text"))


def graph_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the orders' graphs as Graphviz reads them."""
    return graph_edges(_order_graphs(spark, sf_dir), "l_orderkey")


def graph_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the orders' graphs: modules that are declared twice, unknown, or read before they are declared."""
    return graph_messages(_order_graphs(spark, sf_dir), "l_orderkey")


def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of nations' names where numbers in them count as numbers."""
    n = read(spark, sf_dir, "nation")
    return n.select("n_name", F.row_number().over(Window.orderBy(files.natural_key(F.col("n_name")))).alias("place"))


def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of each order's quantities."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return li.select("l_orderkey", scalars.upper_median(F.col("q")).alias("median"))


MODULES = """m AS (SELECT l_orderkey, 'm' || (l_partkey % 6) AS name, l_suppkey % 9 = 0 AS unknown, CASE WHEN l_quantity > 25 THEN ['base', 'm' || ((l_partkey + 1) % 6)] ELSE ['base'] END AS sources,
  row_number() OVER w AS k, coalesce(list('m' || (l_partkey % 6)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS earlier FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))"""
USERS = "u AS (SELECT user_id AS utt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, count(*) OVER (PARTITION BY user_id) AS n, * FROM events)"
SAMPLES = f"{USERS}, s AS (SELECT utt, n, list((value * 50)::DOUBLE ORDER BY frame) AS v FROM (SELECT utt, n, frame, trunc(value * 50) / 50 AS value FROM u) GROUP BY utt, n), k AS (SELECT utt, n, v, (n - 5) // 2 + 1 AS frames FROM s WHERE n >= 5)"
PART_LM = """w AS (SELECT p_partkey AS id, p_partkey % 2 AS half, list_concat(list_concat(['<s>'], string_split(p_name, ' ')), ['</s>']) AS words FROM part),
t AS (SELECT id, half, unnest(words) AS word, unnest(range(len(words))) AS place FROM w), b AS (SELECT half, lag(word) OVER (PARTITION BY id ORDER BY place) AS context, word, place FROM t),
uc AS (SELECT half, word, count(*) AS c FROM b WHERE place > 0 GROUP BY half, word), uni AS (SELECT half, word, c / (sum(c) OVER (PARTITION BY half))::DOUBLE AS p FROM uc),
bc AS (SELECT half, context, word, count(*) AS c FROM b WHERE place > 0 GROUP BY half, context, word), cs AS (SELECT half, context, sum(c) AS t, count(*) AS kinds FROM bc GROUP BY half, context),
cov AS (SELECT half, context, sum(p) AS covered FROM bc JOIN uni USING (half, word) GROUP BY half, context),
bo AS (SELECT half, context, log10(0.5::DOUBLE * kinds / t / greatest(1 - covered, 1e-10)) AS bo FROM cs JOIN cov USING (half, context)),
model AS (SELECT concat('half', uni.half) AS name, 1 AS n, '' AS context, uni.word AS word, log10(p) AS lp, coalesce(bo, 0) AS bo FROM uni LEFT JOIN bo ON bo.half = uni.half AND bo.context = uni.word
  UNION ALL SELECT concat('half', half), 1, '', context, -99, bo FROM bo WHERE NOT EXISTS (SELECT 1 FROM uni WHERE uni.half = bo.half AND uni.word = bo.context)
  UNION ALL SELECT concat('half', half), 2, context, word, log10((c - 0.5::DOUBLE) / t), 0 FROM bc JOIN cs USING (half, context))"""
LEXICON = "l AS (SELECT DISTINCT p_brand AS word, p_size / 64.0::DOUBLE AS prob, p_name AS units FROM part)"
ARCS = "a AS (SELECT concat('net', s_nationkey) AS name, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS i, s_name AS word, round(s_acctbal / 100, 2) AS am, -(s_suppkey % 8) / 4.0::DOUBLE + 0.0::DOUBLE AS lm FROM supplier)"
NETWORK = f"{ARCS} SELECT name, 'T' AS kind, i AS src, (i + 1)::INT AS dst, word AS input, concat('o', i + 1) AS output, lm AS score FROM a UNION ALL SELECT DISTINCT name, 'I', 0, -1, NULL, NULL, 0 FROM a UNION ALL SELECT name, 'F', max(i + 1)::INT, -1, NULL, NULL, 0 FROM a GROUP BY name"

QUERIES = {f.__name__: f for f in (src_phn, src_recipe, src_speakers, src_arpa, lm_gram_order, src_lexicon, lexicon_known, src_slf, src_grammar, src_network, src_weighted_arcs, src_hmms, src_durations, src_gaussians, src_mixtures, src_audio, src_last_frame, src_features, src_lna, src_lna_short, src_state_frames, feacat, graph_dot, graph_errors, natural_order, upper_median)}

ORACLE_SQL = {
    "src_phn": f'WITH {RUNS} SELECT utt, start, "end", label, (utt % 4)::INT AS state FROM runs',
    "src_recipe": "SELECT concat('c', c_custkey, '.wav') AS audio, c_mktsegment AS speaker, c_custkey / 4.0::DOUBLE AS start_time, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE -1 END::INT AS end_line FROM customer",
    "src_speakers": "SELECT 'speaker' AS kind, n_name AS id, 'vtln' AS module, 'warp_factor' AS key, concat(n_nationkey, '.5') AS \"values\" FROM nation UNION ALL SELECT 'speaker', n_name, 'vtln', 'turn', concat(n_regionkey, ' ', n_nationkey) FROM nation",
    "src_arpa": f"WITH {PART_LM} SELECT name, n::INT AS n, context, word, round(lp, 6) + 0.0::DOUBLE AS lp, round(bo, 6) + 0.0::DOUBLE AS bo FROM model",
    "lm_gram_order": f"WITH {PART_LM} SELECT name, n::INT AS n, context, word, (row_number() OVER (PARTITION BY name, n ORDER BY trim(concat(context, ' ', word))))::INT AS place FROM model",
    "src_lexicon": f"WITH {LEXICON} SELECT word, prob, units FROM l",
    "lexicon_known": f"WITH {LEXICON} SELECT word, prob, units FROM l WHERE len(list_filter(string_split(units, ' '), lambda x: x >= 's')) = 0",
    "src_slf": f"WITH {ARCS} SELECT name, (count(*) OVER (PARTITION BY name) + 1)::INT AS nodes, i AS arc, i AS src, (i + 1)::INT AS dst, word, am, lm FROM a",
    "src_grammar": f"WITH {ARCS} SELECT name, i AS src, (i + 1)::INT AS dst, word FROM a",
    "src_network": f"WITH {NETWORK}",
    "src_weighted_arcs": f"WITH {ARCS} SELECT name, i AS src, (i + 1)::INT AS dst, word AS symbol, lm AS score FROM a",
    "src_hmms": "WITH n AS (SELECT *, round(n_nationkey / 32.0::DOUBLE, 5) AS stay FROM nation) SELECT n_nationkey AS hmm, n_name AS label, 0 AS state, -1 AS pdf, 2 AS target, 1.0::DOUBLE AS prob FROM n UNION ALL SELECT n_nationkey, n_name, 2, n_nationkey, 2, stay FROM n UNION ALL SELECT n_nationkey, n_name, 2, n_nationkey, 3, 1 - stay FROM n UNION ALL SELECT n_nationkey, n_name, 3, n_nationkey + 1, 1, 0.5 FROM n",
    "src_durations": "SELECT n_nationkey AS state, n_nationkey / 8.0::DOUBLE AS shape, n_regionkey / 4.0::DOUBLE AS scale FROM nation",
    "src_gaussians": f"WITH {MODEL} SELECT (dense_rank() OVER (ORDER BY label) - 1)::INT AS gid, i, round(mean, 6) + 0.0::DOUBLE AS mean, round(variance, 6) + 0.0::DOUBLE AS variance FROM m",
    "src_mixtures": "SELECT (dense_rank() OVER (ORDER BY p_size) - 1)::INT AS pdf, p_partkey::INT AS gid, p_retailprice AS weight FROM part",
    "src_audio": f"WITH {SAMPLES}, f AS (SELECT utt, frames, v, unnest(range(frames)) AS f FROM k WHERE frames > 0) SELECT utt, f::INT AS frame, frames::INT AS n, {', '.join(f'round(v[2 * f + {i + 2}] - 0.97::DOUBLE * v[2 * f + {i + 1}], 4) + 0.0::DOUBLE AS x{i}' for i in range(4))} FROM f",
    "src_last_frame": f"WITH {SAMPLES} SELECT utt, (frames - 1)::INT AS last FROM k WHERE frames > 0",
    "src_features": f"WITH {USERS} SELECT utt, frame::INT AS frame, n::INT AS n, (event_id % 97)::DOUBLE AS x0, length(event_type)::DOUBLE AS x1 FROM u",
    "src_lna": f"WITH {USERS}, c AS (SELECT utt, frame, CASE WHEN -value / 12 < -36.008::DOUBLE THEN 65535 ELSE floor(value / 12 * 1820 + 0.5::DOUBLE) END AS a, floor(event_id % 7 / 2.0::DOUBLE * 1820 + 0.5::DOUBLE) AS b FROM u) SELECT utt, frame::INT AS frame, round(a / -1820.0::DOUBLE, 5) + 0.0::DOUBLE AS p0, round(b / -1820.0::DOUBLE, 5) + 0.0::DOUBLE AS p1 FROM c",
    "src_lna_short": f"WITH {USERS}, c AS (SELECT utt, frame, least(255, floor(value / 12 * 24 + 0.5::DOUBLE)) AS a, floor(event_id % 7 / 2.0::DOUBLE * 24 + 0.5::DOUBLE) AS b FROM u) SELECT utt, frame::INT AS frame, round(a / -24.0::DOUBLE, 5) + 0.0::DOUBLE AS p0, round(b / -24.0::DOUBLE, 5) + 0.0::DOUBLE AS p1 FROM c",
    "src_state_frames": f"WITH {USERS} SELECT utt, frame::INT AS frame, event_type AS state, value AS x0 FROM u",
    "feacat": f"WITH {FRAMES} SELECT utt, frame, round(x0, 6) + 0.0::DOUBLE AS x0, round(x1, 6) + 0.0::DOUBLE AS x1, round(x2, 6) + 0.0::DOUBLE AS x2 FROM fr WHERE frame BETWEEN 2 AND 8",
    "graph_dot": f"WITH {MODULES} SELECT l_orderkey, '\"' || unnest(sources) || '\" -> \"' || name || '\";' AS edge FROM m",
    "graph_errors": f"""WITH {MODULES}, e AS (SELECT l_orderkey, k, CASE WHEN list_contains(earlier, name) THEN 'module ' || name || ' is declared twice' WHEN unknown THEN 'unknown module type gamma'
  WHEN len(sources) > 1 AND NOT list_contains(earlier, sources[2]) THEN 'module ' || name || ' reads ' || sources[2] || ', which is not declared before it' END AS message FROM m)
SELECT l_orderkey, arg_min(message, k) FILTER (message IS NOT NULL) AS message FROM e GROUP BY l_orderkey""",
    "natural_order": "SELECT n_name, (row_number() OVER (ORDER BY split_part(n_name, '_', 1), split_part(n_name, '_', 2)::INT))::INT AS place FROM nation",
    "upper_median": "SELECT l_orderkey, (list_sort(list(l_quantity)))[(count(*) // 2 + 1)::INT] AS median FROM lineitem GROUP BY l_orderkey",
}
