"""Queries over statistics, estimates and segments, and their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.operators import adaptation, discriminative, ranks, segments, statistics, trees
from cadenza.operators.frames import event_frames, numbered
from cadenza.plans.feature_queries import FRAMES
from cadenza.sources.tables import read

DIGITS = 6


def _vectors(spark: SparkSession, sf_dir: str, dim: int = 64) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.slice(F.col("embedding").cast("array<double>"), 1, dim).alias("x"), (F.col("vec_id") % 3 + 1).cast("double").alias("g"))


def _r(c, digits: int = DIGITS):
    return F.round(c, digits) + F.lit(0.0)


def stat_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = statistics.moments(_vectors(spark, sf_dir), "label", "x", "g")
    rows = m.select("label", "n", "gamma", F.posexplode(F.arrays_zip("sum1", "sum2")).alias("i", "s"))
    return rows.select("label", "n", "gamma", "i", _r("s.sum1").alias("sum1"), _r("s.sum2").alias("sum2"))


def stat_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = statistics.moments(_vectors(spark, sf_dir), "label", "x", "g", full=True)
    return m.select("label", F.posexplode("sum2").alias("i", "s")).select("label", "i", _r("s").alias("s"))


def stat_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of halves, added."""
    v = _vectors(spark, sf_dir)
    halves = [statistics.moments(v.where(F.col("vec_id") % 2 == k), "label", "x", "g") for k in (0, 1)]
    m = statistics.add_moments(halves[0].union(halves[1]), "label")
    rows = m.select("label", "n", "gamma", F.posexplode(F.arrays_zip("sum1", "sum2")).alias("i", "s"))
    return rows.select("label", "n", "gamma", "i", _r("s.sum1").alias("sum1"), _r("s.sum2").alias("sum2"))


def stat_gauss_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = statistics.gaussian_ml(statistics.moments(_vectors(spark, sf_dir), "label", "x", "g"))
    rows = m.select("label", F.posexplode(F.arrays_zip("mean", "variance")).alias("i", "s"))
    return rows.select("label", "i", _r("s.mean").alias("mean"), _r("s.variance").alias("variance"))


def stat_ismooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of each label smoothed by those of the next label."""
    m = statistics.moments(_vectors(spark, sf_dir), "label", "x", "g")
    other = m.select((F.col("label") - 1).alias("label"), F.col("sum1").alias("o"), F.col("gamma").alias("og"))
    out = m.join(other, "label").withColumn("s", statistics.smooth(F.col("sum1"), F.col("gamma"), F.col("o"), F.col("og"), 10.0))
    return out.select("label", F.posexplode("s").alias("i", "v")).select("label", "i", _r("v").alias("v"))


def stat_trans(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst is not null")
    counts = e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return statistics.transition_estimates(counts, "src", "dst", "n").select("src", "dst", "n", _r("p").alias("p"))


def stat_feanorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).withColumns({"all": F.lit(0), "one": F.lit(1.0)})
    m = statistics.gaussian_ml(statistics.moments(rows, "all", "x", "one"))
    out = m.select(F.posexplode(F.arrays_zip("mean", "variance")).alias("i", "s"))
    return out.select("i", _r("s.mean").alias("mean"), _r(1 / F.sqrt("s.variance")).alias("scale"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.label_runs(numbered(read(spark, sf_dir, "events"), label=F.col("event_type")))


def stat_dur_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir).select("label", F.least(F.col("end") - F.col("start"), F.lit(4)).alias("dur"))
    return runs.groupBy("label", "dur").agg(F.count(F.lit(1)).alias("n"))


def stat_dur_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gamma distributions of the durations of each label."""
    d = _runs(spark, sf_dir).select("label", (F.col("end") - F.col("start")).cast("double").alias("d"))
    means = d.groupBy("label").agg(F.avg("d").alias("mean"), F.avg(F.log("d")).alias("mean_log"), F.count(F.lit(1)).alias("n"))

    @F.pandas_udf("struct<shape:double,scale:double>")
    def fit(mean: pd.Series, mean_log: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics.gamma_fit(a, b) for a, b in zip(mean, mean_log, strict=True)], columns=["shape", "scale"])

    return means.withColumn("f", fit("mean", "mean_log")).select("label", "n", "f.shape", "f.scale")


def stat_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_frames(read(spark, sf_dir, "events")).select(F.posexplode("x").alias("channel", "v"))
    return ranks.quantile_values(f, "channel", "v")


def feat_quanteq_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alpha and gamma of each user's values against all users' quantiles."""
    f = event_frames(read(spark, sf_dir, "events")).select("utt", F.element_at("x", 1).alias("v"))
    train = [r.v for r in ranks.quantile_values(f.withColumn("all", F.lit(0)), "all", "v").orderBy("q").collect()]
    own = ranks.quantile_values(f, "utt", "v").groupBy("utt").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "v"))), lambda s: s["v"]).alias("qs"))

    @F.pandas_udf("struct<alpha:double,gamma:double>")
    def fit(qs: pd.Series) -> pd.DataFrame:
        grid = np.arange(0, 1.0001, 0.05), np.arange(1, 3.0001, 0.1)
        return pd.DataFrame([adaptation.quantile_equalization(np.array(q), np.array(train), *grid) for q in qs], columns=["alpha", "gamma"])

    return own.withColumn("f", fit("qs")).select("utt", _r("f.alpha").alias("alpha"), _r("f.gamma").alias("gamma"))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, statistics.Mixture]:
    v = _vectors(spark, sf_dir)
    return v, statistics.Mixture.from_rows(statistics.gaussian_ml(statistics.moments(v, "label", "x", "g")), "label")


def _scored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    v, mixture = _mixture(spark, sf_dir)
    rows = statistics.score_mixture(v, "x", mixture).select("vec_id", "log_mixture", F.posexplode(name).alias("i", "v"))
    names = F.array(*[F.lit(i) for i in mixture.ids])
    return rows.select("vec_id", F.element_at(names, F.col("i") + 1).cast("int").alias("label"), _r("v").alias("v"), _r("log_mixture").alias("log_mixture"))


def gmm_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "log_densities")


def gmm_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "posteriors")


def gmm_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log densities with only the two nearest of four clusters, of labels with one remainder, exact."""
    v, mixture = _mixture(spark, sf_dir)
    rows = statistics.top_cluster_log_densities(v, "x", mixture, np.array(mixture.ids) % 4, 2)
    return rows.select("vec_id", F.posexplode("log_densities").alias("i", "v")).select("vec_id", "i", _r("v").alias("v"))


def gmm_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label whose mean is nearest to each vector."""
    v, mixture = _mixture(spark, sf_dir)
    return statistics.nearest_means(v, "x", mixture).select("vec_id", F.col("nearest").cast("int").alias("nearest"), _r("distance").alias("distance"))


def gmm_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of expectation maximization, a split, and the likelihood of each round."""
    v, mixture = _mixture(spark, sf_dir)
    out = []
    for turn in range(3):
        mixture, ll = statistics.em_step(v, "x", mixture)
        out.append((turn, len(mixture.ids), ll))
        if turn == 0:
            mixture = statistics.split_largest(mixture, len(mixture.ids) + 2, 0.01)
    return spark.createDataFrame(out, "turn int, gaussians int, ll double")


def gmm_kld(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = statistics.gaussian_ml(statistics.moments(_vectors(spark, sf_dir), "label", "x", "g"))
    a = m.select(F.col("label").alias("a"), F.col("mean").alias("ma"), F.col("variance").alias("va"))
    b = m.select(F.col("label").alias("b"), F.col("mean").alias("mb"), F.col("variance").alias("vb"))
    parts = F.transform(F.arrays_zip("ma", "va", "mb", "vb"), lambda s: F.log(s["vb"] / s["va"]) + (s["va"] + (s["ma"] - s["mb"]) * (s["ma"] - s["mb"])) / s["vb"] - 1)
    kld = F.aggregate(parts, F.lit(0.0), lambda x, y: x + y) / 2
    # one row per Gaussian on both sides
    return a.crossJoin(F.broadcast(b)).select("a", "b", _r(kld).alias("kld"))


def gmm_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, mixture = _mixture(spark, sf_dir)
    labels = statistics.cluster_gaussians(mixture, 4)
    return spark.createDataFrame([(int(i), int(c)) for i, c in zip(mixture.ids, labels, strict=True)], "label int, cluster int")


def lda(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = adaptation.lda(_vectors(spark, sf_dir), "label", "x", "g", 4)
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(a) for j, v in enumerate(r)], "i int, j int, v double")


def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a = adaptation.pca(_vectors(spark, sf_dir), "x", unit_determinant=True)
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(a) for j, v in enumerate(r)], "i int, j int, v double")


def mllt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statistics.moments(_vectors(spark, sf_dir), "label", "x", "g", full=True).orderBy("label").collect()
    covs = []
    for s in rows:
        mean = np.array(s["sum1"]) / s["gamma"]
        covs.append(adaptation.symmetric(s["sum2"], len(mean)) / s["gamma"] - np.outer(mean, mean))
    a = adaptation.mllt(np.array(covs), np.array([s["gamma"] for s in rows]))
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(a) for j, v in enumerate(r)], "i int, j int, v double")


def cmllr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transform for each of five speakers, to which vectors are dealt by id."""
    v = _vectors(spark, sf_dir).withColumn("speaker", (F.col("vec_id") % 5).cast("int"))
    mixture = statistics.Mixture.from_rows(statistics.gaussian_ml(statistics.moments(v, "label", "x", "g")), "label")
    stats = adaptation.cmllr_statistics(v, "speaker", "x", mixture)

    @F.pandas_udf("array<double>")
    def solve(s: pd.Series) -> pd.Series:
        return pd.Series([adaptation.cmllr_transform(np.array(x, float), 64).ravel() for x in s])

    return stats.select("speaker", F.posexplode(solve("s")).alias("i", "v"))


def vtln_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_frames(read(spark, sf_dir, "events")).select("utt", F.element_at("x", 1).alias("v"))
    best = adaptation.best_warp(f, "utt", "v", [round(0.9 + 0.01 * i, 2) for i in range(21)], 250.0, 20000.0)
    return best.select("utt", "warp", _r("ll", 4).alias("ll"))


def mpe_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerator and denominator weights by label: parts of posterior times (score - mean score), by sign."""
    v = _scored(spark, sf_dir, "posteriors").withColumn("score", F.when(F.col("label") == F.pmod("vec_id", F.lit(10)), 1.0).otherwise(-1.0))
    w = Window.partitionBy("vec_id")
    g = v.withColumn("g", F.col("v") * (F.col("score") - F.sum(F.col("v") * F.col("score")).over(w)))
    return g.groupBy("label").agg(_r(F.sum(F.when(F.col("g") > 0, F.col("g")).otherwise(0.0)), 4).alias("num"), _r(F.sum(F.when(F.col("g") < 0, -F.col("g")).otherwise(0.0)), 4).alias("den"))


def stat_ebw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussians moved by their label's vectors against all vectors, the latter weighted by posteriors."""
    v, mixture = _mixture(spark, sf_dir)
    num = statistics.moments(v.withColumn("one", F.lit(1.0)), "label", "x", "one")
    post = statistics.score_mixture(v, "x", mixture).select("x", F.posexplode("posteriors").alias("i", "p"))
    names = F.array(*[F.lit(i) for i in mixture.ids])
    den = statistics.moments(post.withColumn("label", F.element_at(names, F.col("i") + 1)), "label", "x", "p")
    out = discriminative.update_gaussians(num, den, mixture, "label")
    return out.select("label", "d", F.posexplode(F.arrays_zip("mean", "variance")).alias("i", "s")).select("label", "i", _r("d", 4).alias("d"), _r("s.mean", 5).alias("mean"), _r("s.variance", 5).alias("variance"))


def stat_mixture_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights from the labels' numbers against posteriors."""
    v, mixture = _mixture(spark, sf_dir)
    num = {r[0]: r[1] for r in v.groupBy("label").count().collect()}
    sums = statistics.score_mixture(v, "x", mixture).select(F.posexplode("posteriors").alias("i", "p")).groupBy("i").agg(F.sum("p").alias("p")).orderBy("i").collect()
    w = discriminative.ebw_weights(np.array([num[i] for i in mixture.ids], float), np.array([r.p for r in sums]), mixture.weights)
    return spark.createDataFrame([(int(i), float(x)) for i, x in zip(mixture.ids, w, strict=True)], "label int, weight double")


def gmm_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the mixture from itself after a round of estimation, by sampling."""
    v, mixture = _mixture(spark, sf_dir)
    return discriminative.sampled_distances(spark, mixture, statistics.em_step(v, "x", mixture)[0])


def logl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed log-likelihood of the vectors of each label under the mixture of all."""
    v, mixture = _mixture(spark, sf_dir)
    return statistics.score_mixture(v, "x", mixture).groupBy("label").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("log_mixture"), 4).alias("ll"))


def tie_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types in context, tied by their values."""
    e = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select(F.coalesce(F.lag("event_type").over(w), F.lit("none")).alias("l"), F.col("event_type").alias("c"), F.coalesce(F.lead("event_type").over(w), F.lit("none")).alias("r"), F.array("value", (F.col("event_id") % 97).cast("double")).alias("x"))
    stats = statistics.moments(rows.withColumns({"name": F.concat_ws(" ", "l", "c", "r"), "g": F.lit(1.0)}), "name", "x", "g").orderBy("name").collect()
    states = [trees.State(*r["name"].split(), r.gamma, np.array(r.sum1), np.array(r.sum2)) for r in stats]
    units = sorted({s.centre for s in states})
    leaves = trees.tie_states(states, trees.questions_of(units, lambda u: u[-1]), 20.0, 1.0, 0.5)
    out = [(k, s.left, s.centre, s.right) for k, leaf in enumerate(leaves) for s in leaf.states]
    return spark.createDataFrame(out, "leaf int, left string, centre string, right string")


def regression_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, mixture = _mixture(spark, sf_dir)
    label = trees.regression_tree(mixture.means, mixture.weights, 4)
    return spark.createDataFrame([(int(i), int(c)) for i, c in zip(mixture.ids, label, strict=True)], "label int, leaf int")


def seg_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


def seg_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_frames(read(spark, sf_dir, "events"))
    rows = segments.frame_labels(f, _runs(spark, sf_dir))
    return rows.groupBy("utt", "label").agg(F.count(F.lit(1)).alias("frames"), _r(F.sum(F.element_at("x", 1)), 4).alias("total"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of labels that are one event late."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("utt"), (F.row_number().over(w) - 1).alias("frame"), F.coalesce(F.lag("event_type").over(w), F.lit("none")).alias("label"))
    return segments.label_runs(e)


def seg_overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.overlap_scores(_runs(spark, sf_dir), _references(spark, sf_dir))
    return out.select("utt", "start", "end", "label", _r("score").alias("score"))


def seg_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.clipped(_runs(spark, sf_dir), 10, 40).select("utt", "start", "end", "label")


def triphone(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = segments.triphones(_runs(spark, sf_dir), "utt", "start", "label")
    return r.select("utt", "start", "triphone", segments.centre_phone(F.col("triphone")).alias("centre"))


V = "v AS (SELECT vec_id, label, (vec_id % 3 + 1)::DOUBLE AS g, unnest(embedding)::DOUBLE AS x, (unnest(range(64)))::INT AS i FROM embeddings)"
DIAG = "SELECT label, count(*) AS n, sum(g) AS gamma, i, round(sum(g * x), 6) + 0.0::DOUBLE AS sum1, round(sum(g * x * x), 6) + 0.0::DOUBLE AS sum2 FROM v GROUP BY label, i"
MODEL = f"{V}, m AS (SELECT label, i, sum(g) AS gamma, sum(g * x) / sum(g) AS mean, greatest(sum(g * x * x) / sum(g) - pow(sum(g * x) / sum(g), 2), 1e-6) AS variance FROM v GROUP BY label, i)"
LOGS = f"""{MODEL}, w AS (SELECT label, gamma / sum(gamma) OVER () AS weight FROM (SELECT DISTINCT label, gamma FROM m WHERE i = 0)),
l AS (SELECT v.vec_id, m.label, sum(-0.5 * (ln(2 * pi() * m.variance) + pow(v.x - m.mean, 2) / m.variance)) AS ld FROM v JOIN m USING (i) GROUP BY v.vec_id, m.label),
j AS (SELECT l.vec_id, l.label, ld, ld + ln(weight) AS joint FROM l JOIN w USING (label)),
t AS (SELECT vec_id, max(joint) + ln(sum(exp(joint - top))) AS total FROM (SELECT *, max(joint) OVER (PARTITION BY vec_id) AS top FROM j) GROUP BY vec_id)"""
RUNS = """e AS (SELECT user_id AS utt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_type AS label,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, value FROM events),
c AS (SELECT *, sum(CASE WHEN label = before THEN 0 ELSE 1 END) OVER (PARTITION BY utt ORDER BY frame) AS run FROM e),
runs AS (SELECT utt, min(frame)::INT AS start, (max(frame) + 1)::INT AS "end", min(label) AS label FROM c GROUP BY utt, run)"""
MPE_POST = f"{LOGS}, p AS (SELECT vec_id, label, round(exp(joint - total), 6) AS v, CASE WHEN label = vec_id % 10 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score FROM j JOIN t USING (vec_id)), q AS (SELECT label, v * (score - sum(v * score) OVER (PARTITION BY vec_id)) AS g FROM p)"

QUERIES = {f.__name__: f for f in (stat_diag, stat_full, stat_merge, stat_gauss_ml, stat_ismooth, stat_trans, stat_feanorm, stat_dur_hist, stat_dur_gamma, stat_quantiles, feat_quanteq_fit, gmm_loglik, gmm_posterior, gmm_clustered, gmm_nearest, gmm_em, gmm_kld, gmm_cluster, lda, pca, mllt, cmllr, vtln_grid, mpe_split, stat_ebw, stat_mixture_weights, gmm_sampled, logl, tie_states, regression_tree, seg_runs, seg_interval_join, seg_overlap_score, seg_clip, triphone)}

ORACLE_SQL = {
    "stat_diag": f"WITH {V} {DIAG}",
    "stat_merge": f"WITH {V} {DIAG}",
    "stat_full": f"WITH {V}, f AS (SELECT a.label, a.i AS r, b.i AS c, sum(a.g * a.x * b.x) AS s FROM v a JOIN v b ON a.vec_id = b.vec_id AND b.i <= a.i GROUP BY a.label, a.i, b.i) SELECT label, (r * (r + 1) // 2 + c)::INT AS i, round(s, 6) + 0.0::DOUBLE AS s FROM f",
    "stat_gauss_ml": f"WITH {MODEL} SELECT label, i, round(mean, 6) + 0.0::DOUBLE AS mean, round(variance, 6) + 0.0::DOUBLE AS variance FROM m",
    "stat_ismooth": f"WITH {V}, s AS (SELECT label, i, sum(g) AS gamma, sum(g * x) AS s FROM v GROUP BY label, i) SELECT a.label, a.i, round(a.s + b.s * (10.0::DOUBLE / b.gamma), 6) + 0.0::DOUBLE AS v FROM s a JOIN s b ON b.label = a.label + 1 AND a.i = b.i",
    "stat_trans": "WITH t AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), c AS (SELECT src, dst, count(*) AS n FROM t WHERE dst IS NOT NULL GROUP BY src, dst) SELECT src, dst, n, round(greatest(n / sum(n) OVER (PARTITION BY src), 0.001::DOUBLE), 6) AS p FROM c",
    "stat_feanorm": f"WITH {V} SELECT i, round(avg(x), 6) + 0.0::DOUBLE AS mean, round(1 / sqrt(greatest(avg(x * x) - pow(avg(x), 2), 1e-6)), 6) + 0.0::DOUBLE AS scale FROM v GROUP BY i",
    "stat_dur_hist": f'WITH {RUNS} SELECT label, least("end" - start, 4)::INT AS dur, count(*) AS n FROM runs GROUP BY label, dur',
    "stat_quantiles": f"WITH {FRAMES}, u AS (SELECT unnest([x0, x1, x2]) AS v, unnest([0, 1, 2])::INT AS channel FROM fr), o AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY channel) AS n FROM u), q AS (SELECT unnest(range(4))::INT AS q) SELECT channel, q, v FROM o JOIN q ON r = ceil(n * (q + 1) / 4) - 1",
    "gmm_loglik": f"WITH {LOGS} SELECT vec_id, label, round(ld, 6) + 0.0::DOUBLE AS v, round(total, 6) + 0.0::DOUBLE AS log_mixture FROM j JOIN t USING (vec_id)",
    "gmm_posterior": f"WITH {LOGS} SELECT vec_id, label, round(exp(joint - total), 6) + 0.0::DOUBLE AS v, round(total, 6) + 0.0::DOUBLE AS log_mixture FROM j JOIN t USING (vec_id)",
    "stat_ebw": f"""WITH {LOGS}, ps AS (SELECT vec_id, label, exp(joint - total) AS p FROM j JOIN t USING (vec_id)),
nu AS (SELECT label, i, count(*) AS g, sum(x) AS s1, sum(x * x) AS s2 FROM v GROUP BY label, i), de AS (SELECT ps.label, v.i, sum(p) AS g, sum(p * x) AS s1, sum(p * x * x) AS s2 FROM ps JOIN v USING (vec_id) GROUP BY ps.label, v.i),
df AS (SELECT m.label, m.i, mean, variance, de.g AS gd, nu.g - de.g AS gm, nu.s1 - de.s1 AS a1, nu.s2 - de.s2 AS a2 FROM m JOIN nu ON nu.label = m.label AND nu.i = m.i JOIN de ON de.label = m.label AND de.i = m.i),
qu AS (SELECT *, a2 + gm * (variance + mean * mean) - 2 * mean * a1 AS b, gm * a2 - a1 * a1 AS c FROM df), ro AS (SELECT *, CASE WHEN b * b - 4 * variance * c >= 0 THEN (-b + sqrt(greatest(b * b - 4 * variance * c, 0))) / (2 * variance) ELSE 0 END AS r FROM qu),
dd AS (SELECT *, greatest(2 * gd, 2 * greatest(0, max(r) OVER (PARTITION BY label), -gm), 1e-12) AS d FROM ro), nw AS (SELECT *, (a1 + d * mean) / (gm + d) AS new_mean FROM dd)
SELECT label, i, round(d, 4) + 0.0::DOUBLE AS d, round(new_mean, 5) + 0.0::DOUBLE AS mean, round(greatest((a2 + d * (variance + mean * mean)) / (gm + d) - new_mean * new_mean, 1e-6), 5) + 0.0::DOUBLE AS variance FROM nw""",
    "gmm_nearest": f"WITH {MODEL}, d AS (SELECT v.vec_id, m.label, sum(pow(v.x - m.mean, 2)) AS d FROM v JOIN m USING (i) GROUP BY v.vec_id, m.label) SELECT vec_id, label::INT AS nearest, round(d, 6) + 0.0::DOUBLE AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, label) = 1",
    "gmm_clustered": f"""WITH {LOGS}, cm AS (SELECT label % 4 AS c, i, avg(mean) AS mean, avg(variance) AS variance FROM m GROUP BY label % 4, i),
cl AS (SELECT v.vec_id, c, sum(-0.5 * (ln(2 * pi() * cm.variance) + pow(v.x - cm.mean, 2) / cm.variance)) AS cd FROM v JOIN cm USING (i) GROUP BY v.vec_id, c), cr AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cd DESC, c) AS k FROM cl)
SELECT l.vec_id, l.label::INT AS i, round(CASE WHEN k <= 2 THEN ld ELSE cd END, 6) + 0.0::DOUBLE AS v FROM l JOIN cr ON cr.vec_id = l.vec_id AND cr.c = l.label % 4""",
    "feat_quanteq_fit": f"""WITH {FRAMES}, o AS (SELECT utt, x0 AS v, row_number() OVER (PARTITION BY utt ORDER BY x0) - 1 AS r, count(*) OVER (PARTITION BY utt) AS n, row_number() OVER (ORDER BY x0) - 1 AS gr, count(*) OVER () AS gn FROM fr), k AS (SELECT unnest(range(4)) AS q),
t AS (SELECT list(v ORDER BY q) AS t FROM o JOIN k ON gr = ceil(gn * (q + 1) / 4) - 1), u AS (SELECT utt, list(v ORDER BY q) AS v FROM o JOIN k ON r = ceil(n * (q + 1) / 4) - 1 GROUP BY utt),
x AS (SELECT utt, list_transform([1, 2, 3], lambda p: greatest(v[p], t[p]) / greatest(v[4], t[4])) AS x, list_transform([1, 2, 3], lambda p: t[p] / greatest(v[4], t[4])) AS y FROM u, t), g AS (SELECT a * 0.05::DOUBLE AS a, 1 + b * 0.1::DOUBLE AS g FROM (SELECT unnest(range(21)) AS a), (SELECT unnest(range(21)) AS b)),
e AS (SELECT utt, a, g, pow(a * pow(x[1], g) + (1 - a) * x[1] - y[1], 2) + pow(a * pow(x[2], g) + (1 - a) * x[2] - y[2], 2) + pow(a * pow(x[3], g) + (1 - a) * x[3] - y[3], 2) AS e FROM x, g)
SELECT utt, round(a, 6) + 0.0::DOUBLE AS alpha, round(g, 6) + 0.0::DOUBLE AS gamma FROM e QUALIFY row_number() OVER (PARTITION BY utt ORDER BY e, a, g) = 1""",
    "gmm_kld": f"WITH {MODEL} SELECT a.label AS a, b.label AS b, round(sum(ln(b.variance / a.variance) + (a.variance + pow(a.mean - b.mean, 2)) / b.variance - 1) / 2, 6) + 0.0::DOUBLE AS kld FROM m a JOIN m b USING (i) GROUP BY a.label, b.label",
    "vtln_grid": f"WITH {FRAMES}, g AS (SELECT unnest(range(21)) AS k), l AS (SELECT utt, round(0.9 + 0.01 * k, 2)::DOUBLE AS warp, sum(ln(round(0.9 + 0.01 * k, 2)::DOUBLE) - pow(x0 * round(0.9 + 0.01 * k, 2)::DOUBLE - 250, 2) / 40000.0::DOUBLE) AS ll FROM fr CROSS JOIN g GROUP BY utt, k) SELECT utt, arg_max(warp, ll) AS warp, round(max(ll), 4) + 0.0::DOUBLE AS ll FROM l GROUP BY utt",
    "mpe_split": f"WITH {MPE_POST} SELECT label, round(sum(greatest(g, 0)), 4) + 0.0::DOUBLE AS num, round(sum(greatest(-g, 0)), 4) + 0.0::DOUBLE AS den FROM q GROUP BY label",
    "logl": f"WITH {LOGS} SELECT e.label, count(*) AS n, round(sum(total), 4) + 0.0::DOUBLE AS ll FROM t JOIN embeddings e USING (vec_id) GROUP BY e.label",
    "seg_runs": f'WITH {RUNS} SELECT utt, start, "end", label FROM runs',
    "seg_interval_join": f"WITH {RUNS} SELECT utt, label, count(*) AS frames, round(sum(value), 4) + 0.0::DOUBLE AS total FROM e GROUP BY utt, label",
    "seg_overlap_score": f"""WITH {RUNS}, d AS (SELECT utt, frame, coalesce(before, 'none') AS label FROM e),
dc AS (SELECT *, sum(CASE WHEN label = prev THEN 0 ELSE 1 END) OVER (PARTITION BY utt ORDER BY frame) AS run FROM (SELECT *, lag(label) OVER (PARTITION BY utt ORDER BY frame) AS prev FROM d)),
refs AS (SELECT utt, min(frame)::INT AS rs, (max(frame) + 1)::INT AS re, min(label) AS rl FROM dc GROUP BY utt, run)
SELECT h.utt, start, "end", label, round(coalesce(max(CASE WHEN label = rl THEN -1 + 2 * ((least("end", re) - greatest(start, rs)) / (re - rs)::DOUBLE) ELSE -1 + (least("end", re) - greatest(start, rs)) / (re - rs)::DOUBLE END), -1), 6) + 0.0::DOUBLE AS score
FROM runs h LEFT JOIN refs r ON h.utt = r.utt AND start < re AND rs < "end" GROUP BY h.utt, start, "end", label""",
    "seg_clip": f'WITH {RUNS} SELECT utt, greatest(start, 10)::INT AS start, least("end", 40)::INT AS "end", label FROM runs WHERE "end" > 10 AND start < 40',
    "triphone": f"WITH {RUNS} SELECT utt, start, concat(CASE WHEN l IS NULL THEN '' ELSE l || '-' END, label, CASE WHEN r IS NULL THEN '' ELSE '+' || r END) AS triphone, label AS centre FROM (SELECT *, lag(label) OVER w AS l, lead(label) OVER w AS r FROM runs WINDOW w AS (PARTITION BY utt ORDER BY start))",
}
