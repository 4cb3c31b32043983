"""Queries over lexicons across words, over transducers and over training in rounds, and their SQL."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import adaptation, discriminative, features, lexicon, statistics, training, transducers, trees
from cadenza.operators import language_model as lm
from cadenza.operators.frames import event_frames, numbered
from cadenza.operators.storage import new_folder
from cadenza.plans.graph_queries import SENTS, _r, _sentences
from cadenza.plans import sequence_queries, source_queries
from cadenza.plans.source_queries import RATE, _by_user, _content
from cadenza.plans.statistics_queries import LOGS, RUNS, _mixture, _runs
from cadenza.sources import files, ranged
from cadenza.sources.tables import read

VOWELS = "aeiouy"


def _spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations that are letters from a to z, with their letters as units."""
    words = _sentences(spark, sf_dir).select(F.explode("words").alias("word")).where(F.col("word").rlike("^[a-z]+$")).distinct()
    return words.select("word", (1 / (1 + F.length("word") % 3)).alias("prob"), F.split("word", "").alias("units"))


def lexicon_triphones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network of those words across words."""
    return lexicon.triphone_network(_spelled(spark, sf_dir)).select("src", "dst", "triphone", "word", _r("prob").alias("prob"))


def lexicon_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That network with three states for a triphone, tied by whether the neighbours are vowels."""
    arcs = lexicon.triphone_network(_spelled(spark, sf_dir))
    parts = lambda at: F.regexp_extract("name", r"^(?:(.)-)?(.)(?:\+(.))?$", at)
    kind = lambda c: F.when(c == "", "#").when(F.contains(F.lit(VOWELS), c), "v").otherwise("c")
    models = arcs.where("triphone is not null").select(F.col("triphone").alias("name")).distinct()
    models = models.select("name", F.array(F.concat(kind(parts(1)), parts(2), F.lit("1")), F.concat(parts(2), F.lit("2")), F.concat(parts(2), F.lit("3"), kind(parts(3)))).alias("states"))
    return lexicon.tied_states(arcs, models).select("src", "dst", "state", "word", _r("prob").alias("prob"))


def fst_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters to words, then the words' own order in names of parts: what can be reached, with weights."""
    names = read(spark, sf_dir, "part").select(F.split("p_name", " ").alias("words"))
    words = names.select(F.explode("words").alias("word")).distinct()
    spelled = words.select("word", (1 / (1 + F.length("word") % 3)).alias("prob"), F.split("word", "").alias("units"))
    arcs, _ = transducers.compose(transducers.lexicon_transducer(spelled), transducers.sentence_grammar(names))
    name = lambda c: F.concat_ws("/", f"{c}.a", f"{c}.b", F.col(f"{c}.f").cast("string"))
    return arcs.select(name("src").alias("src"), name("dst").alias("dst"), "input", "output", _r("weight").alias("weight"))


TYPES = ("click", "error", "purchase", "signup", "view")


def _training(spark: SparkSession, sf_dir: str, batches: int) -> tuple[training.Training, DataFrame, DataFrame]:
    """Users' events as frames of chains of their runs, one state of two Gaussians to a type."""
    runs = _runs(spark, sf_dir).groupBy("utt").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "label"))), lambda r: r["label"]).alias("labels"))
    frames = training.with_chains(event_frames(read(spark, sf_dir, "events")), runs, list(TYPES), states=1)
    rows = [(u, k, 0.6 - 0.2 * k, [100.0 + 50 * u + 150 * k, 48.0 + 10 * k, 5.0 + u], [20000.0, 800.0, 4.0], 0.4) for u in range(len(TYPES)) for k in range(2)]
    return training.Training(spark, new_folder(spark, "training"), batches), frames, spark.createDataFrame(rows, training.MODEL)


def train_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model after one round over all users."""
    trainer, frames, model = _training(spark, sf_dir, 2)
    out = trainer.run(frames, model, 1).select("state", "component", "weight", "stay", F.posexplode(F.arrays_zip("mean", "variance")).alias("i", "v"))
    return out.select("state", "component", "i", _r("weight", 5).alias("weight"), _r("v.mean", 4).alias("mean"), _r("v.variance", 3).alias("variance"), _r("stay", 5).alias("stay"))


def train_hmm_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three rounds find: utterances, frames and likelihood."""
    trainer, frames, model = _training(spark, sf_dir, 2)
    trainer.run(frames, model, 3)
    return trainer.history(3).select("round", "utterances", "lost", "frames", _r("log_likelihood", 3).alias("log_likelihood"))


GAUSSIANS = [(u, k, 0.6 - 0.2 * k, [100.0 + 50 * u + 150 * k, 48.0 + 10 * k, 5.0 + u]) for u in range(len(TYPES)) for k in range(2)]
SPREAD = [20000.0, 800.0, 4.0]
WARPS = [round(0.9 + 0.01 * i, 2) for i in range(21)]


def _warps() -> dict[float, np.ndarray]:
    """Matrices that read three elements at piecewise linear places."""
    return {w: features.interpolation_matrix(features.warped_bins(3, w), 3, 0) for w in WARPS}


def vtln_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warp under which each user's frames are likeliest by the mixtures of their types."""
    events = read(spark, sf_dir, "events")
    place = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1
    frames = numbered(events, x=F.array(F.col("value"), (F.col("event_id") % 97).cast("double"), F.length("event_type").cast("double")), state=place)
    model = training.States(np.array([[g[2] for g in GAUSSIANS if g[0] == u] for u in range(5)]), np.array([[g[3] for g in GAUSSIANS if g[0] == u] for u in range(5)]), np.tile(SPREAD, (5, 2, 1)), np.full(5, 0.5))
    best = adaptation.best_warps(adaptation.warp_scores(frames, "utt", "x", "state", _warps(), model), "utt")
    return best.select("utt", "warp", _r("ll", 4).alias("ll"))


def _class_tree() -> tuple[statistics.Mixture, np.ndarray, list[int]]:
    mixture = statistics.Mixture(list(range(len(GAUSSIANS))), np.full(len(GAUSSIANS), 0.1), np.array([g[3] for g in GAUSSIANS]), np.tile(SPREAD, (len(GAUSSIANS), 1)))
    return mixture, *trees.class_tree(mixture.means, mixture.weights, 4)


def mllr_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node of the tree of ten Gaussians whose transform each user's leaves take, with what it has of the user."""
    mixture, leaf_of, parents = _class_tree()
    stats = adaptation.occupancies(event_frames(read(spark, sf_dir, "events")), "utt", "x", mixture)
    found = adaptation.class_transforms(stats, "utt", leaf_of, parents, mixture, 25.0)
    return found.select("utt", "leaf", "node", _r("gamma", 4).alias("gamma"), F.size("transform").alias("numbers"))


def mmi_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes of the labels' posteriors by means and logarithms of variances."""
    v, mixture = _mixture(spark, sf_dir)
    value, slopes = discriminative.mutual_information(v, "label", "x", mixture)
    rows = [(k, d, round(value, 4), round(float(slopes["means"][i, d]), 4) + 0.0, round(float(slopes["variances"][i, d]), 4) + 0.0) for i, k in enumerate(mixture.ids) for d in range(mixture.means.shape[1])]
    return spark.createDataFrame(rows, "label int, i int, value double, by_mean double, by_variance double")


def mmi_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What six rounds of ascent reach."""
    v, mixture = _mixture(spark, sf_dir)
    _, values = discriminative.train_mutual_information(v, "label", "x", mixture, rounds=6)
    return spark.createDataFrame([(i, round(x, 3)) for i, x in enumerate(values)], "round int, value double")


def lm_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of odd sentences under a trigram model of even ones that is kept in buckets."""
    even = _sentences(spark, sf_dir).where("id % 2 = 0")
    model = lm.ngram_model([lm.count_ngrams(even, "id", n) for n in range(1, 4)])
    store = lm.NgramStore.write(model, f"ngrams_{zlib.crc32(sf_dir.encode())}", 8)
    rows = lm.histories(_sentences(spark, sf_dir).where("id % 2 = 1"), "id", 3)
    return rows.join(store.scores(rows), ["context", "word"]).select("id", "place", "context", "word", _r("lp").alias("lp"))


def src_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' values as files of samples, which tasks read 16 frames at a time."""
    contents = _content(_by_user(spark, sf_dir, (F.col("value") * 50).cast("int")), lambda x: files.wave_bytes(x, RATE))
    folder = new_folder(spark, "audio")
    ranged.write_contents(contents, folder)
    back = ranged.read_ranged(spark, folder, "wav", frames=16)
    return back.select(F.regexp_extract("file", r"([^/]*)$", 1).cast("long").alias("utt"), "frame", "n", *[_r(F.element_at("x", i + 1), 4).alias(f"x{i}") for i in range(4)])


QUERIES = {f.__name__: f for f in (lexicon_triphones, lexicon_states, fst_compose, train_hmm, train_hmm_rounds, vtln_model, mllr_nodes, mmi_slopes, mmi_train, lm_store, src_ranged)}

def _log_density(x: str, mean: str) -> str:
    """The logarithm of a Gaussian of the fixed spread in SQL, of lists."""
    return " ".join([f"-0.5 * (3 * ln(2 * pi()) + {' + '.join(f'ln({v!r}::DOUBLE)' for v in SPREAD)}", *[f"+ pow({x}[{i + 1}] - {mean}[{i + 1}], 2) / {v!r}::DOUBLE" for i, v in enumerate(SPREAD)]]) + ")"


MODEL_ROWS = ", ".join(f"({u}, {k}, {w!r}::DOUBLE, {m!r}::DOUBLE[])" for u, k, w, m in GAUSSIANS)
FRAMES = "fr AS (SELECT user_id AS utt, list_position(" + str(list(TYPES)) + ", event_type) - 1 AS u, [value, (event_id % 97)::DOUBLE, length(event_type)::DOUBLE] AS x FROM events)"


WARP_ROWS = ", ".join(f"({w!r}::DOUBLE, {m.tolist()!r}::DOUBLE[][])" for w, m in _warps().items())


def _node_rows() -> tuple[str, str]:
    """Leaves of the Gaussians, and the ancestors of leaves with their heights, as SQL rows."""
    _, leaf_of, parents = _class_tree()
    above = []
    for leaf in sorted(set(leaf_of.tolist())):
        node, height = leaf, 0
        while node >= 0:
            above.append(f"({leaf}, {node}, {height})")
            node, height = parents[node], height + 1
    return ", ".join(f"({i}, {int(leaf)}, {GAUSSIANS[i][3]!r}::DOUBLE[])" for i, leaf in enumerate(leaf_of)), ", ".join(above)


SPELLED = f"""{SENTS}, sp AS (SELECT DISTINCT word, string_split(word, '') AS u, len(word) AS n, 1::DOUBLE / (1 + len(word) % 3) AS prob FROM w WHERE regexp_full_match(word, '[a-z]+')),
fi AS (SELECT DISTINCT u[1] AS y FROM sp), la AS (SELECT DISTINCT u[n] AS x FROM sp UNION ALL SELECT ''), two AS (SELECT DISTINCT u[1] AS y, u[2] AS z FROM sp WHERE n > 1), en AS (SELECT DISTINCT u[n - 1] AS a, u[n] AS b FROM sp WHERE n > 1),
net AS (
  SELECT CASE WHEN x = '' THEN '<s>' ELSE x || '|' || y END AS src, y || '>' || z AS dst, CASE WHEN x = '' THEN '' ELSE x || '-' END || y || '+' || z AS triphone, NULL AS word, 1.0::DOUBLE AS prob FROM two, la
  UNION ALL SELECT DISTINCT array_to_string(u[1:k], ' ') || '>' || u[k + 1], array_to_string(u[1:k + 1], ' ') || '>' || u[k + 2], u[k] || '-' || u[k + 1] || '+' || u[k + 2], NULL, 1.0::DOUBLE FROM (SELECT *, unnest(range(1, n - 1)) AS k FROM sp)
  UNION ALL SELECT array_to_string(u[1:n - 1], ' ') || '>' || u[n], u[n - 1] || '<' || u[n], NULL, word, prob FROM sp WHERE n > 1
  UNION ALL SELECT a || '<' || b, CASE WHEN y = '' THEN '</s>' ELSE b || '|' || y END, a || '-' || b || CASE WHEN y = '' THEN '' ELSE '+' || y END, NULL, 1.0::DOUBLE FROM en, (SELECT y FROM fi UNION ALL SELECT '')
  UNION ALL SELECT CASE WHEN x = '' THEN '<s>' ELSE x || '|' || word END, CASE WHEN y = '' THEN '</s>' ELSE word || '|' || y END, CASE WHEN x = '' THEN '' ELSE x || '-' END || word || CASE WHEN y = '' THEN '' ELSE '+' || y END, word, prob FROM sp, la, (SELECT y FROM fi UNION ALL SELECT '') WHERE n = 1
)"""

ORACLE_SQL = {
    "lexicon_triphones": f"WITH {SPELLED} SELECT src, dst, triphone, word, round(prob, 6) + 0.0::DOUBLE AS prob FROM net",
    "lexicon_states": f"""WITH {SPELLED}, t AS (SELECT *, regexp_extract(triphone, '^(?:(.)-)?(.)(?:\\+(.))?$', ['l', 'c', 'r']) AS p FROM net WHERE triphone IS NOT NULL),
k AS (SELECT *, CASE WHEN p['l'] = '' THEN '#' WHEN contains('{VOWELS}', p['l']) THEN 'v' ELSE 'c' END || p['c'] || '1' AS s1, p['c'] || '2' AS s2, p['c'] || '3' || CASE WHEN p['r'] = '' THEN '#' WHEN contains('{VOWELS}', p['r']) THEN 'v' ELSE 'c' END AS s3 FROM t),
m AS (SELECT *, src || '#' || s1 AS n1, src || '#' || s1 || ' ' || s2 AS n2, src || '#' || s1 || ' ' || s2 || ' ' || s3 AS n3 FROM k)
SELECT DISTINCT src, n1 AS dst, s1 AS state, NULL AS word, 1.0::DOUBLE AS prob FROM m UNION ALL SELECT DISTINCT n1, n2, s2, NULL, 1.0::DOUBLE FROM m UNION ALL SELECT DISTINCT n2, n3, s3, NULL, 1.0::DOUBLE FROM m
UNION ALL SELECT DISTINCT n3, dst, NULL, word, round(prob, 6) + 0.0::DOUBLE FROM m UNION ALL SELECT src, dst, NULL, word, round(prob, 6) + 0.0::DOUBLE FROM net WHERE triphone IS NULL""",
    "fst_compose": """WITH RECURSIVE ss AS (SELECT string_split(p_name, ' ') AS w FROM part), ws AS (SELECT DISTINCT unnest(w) AS word FROM ss), st AS (SELECT w, unnest(range(1, len(w) + 2)) AS k FROM ss),
gc AS (SELECT CASE WHEN k = 1 THEN '' ELSE w[k - 1] END AS src, CASE WHEN k <= len(w) THEN w[k] END AS dst, count(*) AS c FROM st GROUP BY 1, 2), gr AS MATERIALIZED (SELECT src, dst, -ln(c / sum(c) OVER (PARTITION BY src)) AS weight FROM gc),
lx AS MATERIALIZED (SELECT DISTINCT CASE WHEN k = 1 THEN '' ELSE word || ':' || array_to_string(string_split(word, '')[k:], ' ') END AS src, CASE WHEN k = len(word) THEN '' ELSE word || ':' || array_to_string(string_split(word, '')[k + 1:], ' ') END AS dst, word[k] AS input, CASE WHEN k = 1 THEN word END AS output,
  CASE WHEN k = 1 THEN ln(1 + len(word) % 3) ELSE 0 END AS weight FROM (SELECT word, unnest(range(1, len(word) + 1)) AS k FROM ws)),
p AS (SELECT '' AS a, '' AS b, 0 AS f UNION SELECT l.dst, coalesce(g.dst, p.b), CASE WHEN l.output IS NULL THEN 1 ELSE 0 END FROM p JOIN lx l ON l.src = p.a LEFT JOIN gr g ON g.src = p.b AND g.dst = l.output WHERE l.output IS NULL OR g.dst IS NOT NULL)
SELECT concat_ws('/', p.a, p.b, p.f) AS src, concat_ws('/', l.dst, coalesce(g.dst, p.b), CASE WHEN l.output IS NULL THEN 1 ELSE 0 END) AS dst, l.input, g.dst AS output, round(l.weight + coalesce(g.weight, 0), 6) + 0.0::DOUBLE AS weight
FROM p JOIN lx l ON l.src = p.a LEFT JOIN gr g ON g.src = p.b AND g.dst = l.output WHERE l.output IS NULL OR g.dst IS NOT NULL""",
    "train_hmm": f"""WITH RECURSIVE {RUNS}, fr AS MATERIALIZED (SELECT user_id AS utt, row_number() OVER w - 1 AS t, [value, (event_id % 97)::DOUBLE, length(event_type)::DOUBLE] AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
ch AS MATERIALIZED (SELECT utt, list(list_position({list(TYPES)}, label) ORDER BY start) AS c FROM runs GROUP BY utt),
md AS (SELECT u, k, 0.6::DOUBLE - 0.2::DOUBLE * k AS w, [100.0::DOUBLE + 50 * u + 150 * k, 48.0::DOUBLE + 10 * k, 5.0::DOUBLE + u] AS m FROM (SELECT unnest(range(5)) AS u), (SELECT unnest(range(2)) AS k)),
jt AS MATERIALIZED (SELECT utt, t, u, k, x, ln(w) - 0.5 * (3 * ln(2 * pi()) + ln(20000.0::DOUBLE) + ln(800.0::DOUBLE) + ln(4.0::DOUBLE) + pow(x[1] - m[1], 2) / 20000 + pow(x[2] - m[2], 2) / 800 + pow(x[3] - m[3], 2) / 4) AS j FROM fr, md),
dn AS MATERIALIZED (SELECT utt, t, u, max(j) + ln(sum(exp(j - top))) AS d FROM (SELECT *, max(j) OVER (PARTITION BY utt, t, u) AS top FROM jt) GROUP BY utt, t, u),
sd AS MATERIALIZED (SELECT utt, t, list_transform(any_value(c), lambda p: d[p]) AS s, len(any_value(c)) AS n, max(t) OVER (PARTITION BY utt) AS z FROM (SELECT utt, t, list(d ORDER BY u) AS d FROM dn GROUP BY utt, t) JOIN ch USING (utt) GROUP BY utt, t, d),
al AS (SELECT utt, t, list_transform(range(1, n + 1), lambda k: CASE WHEN k = 1 THEN s[1] ELSE -1e300 END) AS a FROM sd WHERE t = 0
  UNION ALL SELECT sd.utt, sd.t, list_transform(range(1, sd.n + 1), lambda k: CASE WHEN k = 1 THEN a[1] + ln(0.4::DOUBLE) ELSE greatest(a[k] + ln(0.4::DOUBLE), a[k - 1] + ln(0.6::DOUBLE)) + ln(1 + exp(-abs(a[k] + ln(0.4::DOUBLE) - a[k - 1] - ln(0.6::DOUBLE)))) END + sd.s[k]) FROM al JOIN sd ON sd.utt = al.utt AND sd.t = al.t + 1),
be AS (SELECT utt, t, list_transform(range(1, n + 1), lambda k: CASE WHEN k = n THEN ln(0.6::DOUBLE) ELSE -1e300 END) AS b, s FROM sd WHERE t = z
  UNION ALL SELECT sd.utt, sd.t, list_transform(range(1, sd.n + 1), lambda k: CASE WHEN k = sd.n THEN ln(0.4::DOUBLE) + be.s[k] + b[k] ELSE greatest(ln(0.4::DOUBLE) + be.s[k] + b[k], ln(0.6::DOUBLE) + be.s[k + 1] + b[k + 1]) + ln(1 + exp(-abs(ln(0.4::DOUBLE) + be.s[k] + b[k] - ln(0.6::DOUBLE) - be.s[k + 1] - b[k + 1]))) END), sd.s FROM be JOIN sd ON sd.utt = be.utt AND sd.t = be.t - 1),
al2 AS MATERIALIZED (SELECT * FROM al), be2 AS MATERIALIZED (SELECT * FROM be),
wh AS (SELECT al2.utt, a[n] + ln(0.6::DOUBLE) AS whole FROM al2 JOIN sd ON sd.utt = al2.utt AND sd.t = al2.t WHERE sd.t = z),
gm AS MATERIALIZED (SELECT utt, t, p - 1 AS u, sum(g) AS g FROM (SELECT al2.utt, al2.t, unnest(c) AS p, unnest(list_transform(range(1, len(c) + 1), lambda k: exp(a[k] + b[k] - whole))) AS g FROM al2 JOIN be2 ON be2.utt = al2.utt AND be2.t = al2.t JOIN wh ON wh.utt = al2.utt JOIN ch ON ch.utt = al2.utt) GROUP BY utt, t, p),
stays AS (SELECT p - 1 AS u, sum(g) AS stays FROM (SELECT unnest(c) AS p, unnest(list_transform(range(1, len(c) + 1), lambda k: exp(a[k] + ln(0.4::DOUBLE) + be2.s[k] + b[k] - whole))) AS g FROM al2 JOIN be2 ON be2.utt = al2.utt AND be2.t = al2.t + 1 JOIN wh ON wh.utt = al2.utt JOIN ch ON ch.utt = al2.utt) GROUP BY p),
leaves AS (SELECT p - 1 AS u, count(*) AS leaves FROM (SELECT unnest(c) AS p FROM ch) GROUP BY p),
oc AS (SELECT jt.u, jt.k, gm.g * exp(j - d) AS g, unnest(x) AS v, unnest(range(3)) AS i FROM jt JOIN dn ON dn.utt = jt.utt AND dn.t = jt.t AND dn.u = jt.u JOIN gm ON gm.utt = jt.utt AND gm.t = jt.t AND gm.u = jt.u),
su AS (SELECT u, k, i, sum(g) AS occ, sum(g * v) AS s1, sum(g * v * v) AS s2 FROM oc GROUP BY u, k, i)
SELECT u::INT AS state, k::INT AS component, i::INT AS i, round(occ / sum(occ) OVER (PARTITION BY u, i), 5) + 0.0::DOUBLE AS weight, round(s1 / occ, 4) + 0.0::DOUBLE AS mean, round(greatest(s2 / occ - pow(s1 / occ, 2), 1e-6), 3) + 0.0::DOUBLE AS variance,
  round(stays / (stays + leaves), 5) + 0.0::DOUBLE AS stay FROM su JOIN stays USING (u) JOIN leaves USING (u)""",
    "mmi_slopes": f"""WITH {LOGS}, s AS (SELECT j.vec_id, j.label AS c, CASE WHEN e.label = j.label THEN 1 ELSE 0 END - exp(joint - total) AS gap, CASE WHEN e.label = j.label THEN joint - total ELSE 0 END AS value FROM j JOIN t USING (vec_id) JOIN embeddings e USING (vec_id)),
a AS (SELECT s.c, v.i, sum(gap * (v.x - m.mean) / m.variance) AS by_mean, 0.5 * sum(gap * (pow(v.x - m.mean, 2) / m.variance - 1)) AS by_variance FROM s JOIN v USING (vec_id) JOIN m ON m.label = s.c AND m.i = v.i GROUP BY s.c, v.i)
SELECT c AS label, i, round((SELECT sum(value) FROM s), 4) + 0.0::DOUBLE AS value, round(by_mean, 4) + 0.0::DOUBLE AS by_mean, round(by_variance, 4) + 0.0::DOUBLE AS by_variance FROM a""",
    "lm_store": sequence_queries.ORACLE_SQL["lm_trigram_backoff"],
    "src_ranged": source_queries.ORACLE_SQL["src_audio"],
    "vtln_model": f"""WITH {FRAMES}, n AS (SELECT *, row_number() OVER () AS line FROM fr), md(u, k, w, m) AS (VALUES {MODEL_ROWS}), wa(warp, a) AS (VALUES {WARP_ROWS}),
y AS (SELECT line, utt, u, warp, list_transform(a, lambda row: list_inner_product(row, x)) AS x FROM n, wa),
j AS (SELECT line, utt, warp, ln(w) + {_log_density("x", "m")} AS j FROM y JOIN md USING (u)),
d AS (SELECT line, utt, warp, max(j) + ln(sum(exp(j - top))) AS ld FROM (SELECT *, max(j) OVER (PARTITION BY line, warp) AS top FROM j) GROUP BY line, utt, warp),
s AS (SELECT utt, warp, sum(ld) AS ll FROM d GROUP BY utt, warp) SELECT utt, warp, round(ll, 4) + 0.0::DOUBLE AS ll FROM s QUALIFY row_number() OVER (PARTITION BY utt ORDER BY ll DESC, warp) = 1""",
    "mllr_nodes": f"""WITH {FRAMES}, n AS (SELECT *, row_number() OVER () AS line FROM fr), g(gid, leaf, m) AS (VALUES {_node_rows()[0]}), an(leaf, node, height) AS (VALUES {_node_rows()[1]}),
j AS (SELECT line, utt, gid, leaf, {_log_density("x", "m")} AS j FROM n, g), p AS (SELECT *, exp(j - max(j) OVER (PARTITION BY line)) AS e FROM j), q AS (SELECT utt, leaf, e / sum(e) OVER (PARTITION BY line) AS p FROM p),
o AS (SELECT utt, leaf, sum(p) AS gamma FROM q GROUP BY utt, leaf), no AS (SELECT utt, node, sum(gamma) AS gamma FROM o JOIN an USING (leaf) GROUP BY utt, node),
c AS (SELECT utt, an.leaf, node, gamma, height FROM no JOIN an USING (node) WHERE gamma >= 25 QUALIFY row_number() OVER (PARTITION BY utt, an.leaf ORDER BY height) = 1),
every AS (SELECT DISTINCT utt, leaf FROM fr, (SELECT DISTINCT leaf FROM g))
SELECT e.utt, e.leaf::INT AS leaf, c.node::INT AS node, round(c.gamma, 4) + 0.0::DOUBLE AS gamma, CASE WHEN c.node IS NOT NULL THEN 12 END::INT AS numbers FROM every e LEFT JOIN c ON c.utt = e.utt AND c.leaf = e.leaf""",
}
