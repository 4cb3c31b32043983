"""Queries over frames and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import features as ft
from cadenza.operators.frames import elements, event_frames, time_range, unpacked
from cadenza.plans.feature_graph import FeatureGraph
from cadenza.sources.tables import read

DIM = 3
FRAMES = """fr AS (
  SELECT user_id AS utt, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame, (count(*) OVER (PARTITION BY user_id))::INT AS n,
    value::DOUBLE AS x0, (event_id % 97)::DOUBLE AS x1, length(event_type)::DOUBLE AS x2 FROM events)"""


def padded_sql(context: int) -> str:
    return f"""{FRAMES}, pad AS (
  SELECT fr.utt, p.f::INT AS frame, fr.n, x0, x1, x2
  FROM (SELECT utt, n, unnest(range(-{context}, n + {context})) AS f FROM (SELECT DISTINCT utt, n FROM fr)) p
  JOIN fr ON fr.utt = p.utt AND fr.frame = greatest(0, least(p.f, p.n - 1)))"""


def graph_query(text: str, shown: int | None = None):
    """A query that applies a feature graph to the event frames and shows its vectors' elements."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, dim = FeatureGraph.from_text(text).apply(event_frames(read(spark, sf_dir, "events")), DIM)
        return unpacked(df, "x", shown or dim)

    return query


def module(name: str, kind: str, sources: str = "", **options: str) -> str:
    lines = [f"name {name}", f"type {kind}", f"sources {sources}" if sources else "", *[f"{k} {v}" for k, v in options.items()]]
    return "module\n{\n" + "\n".join(lines) + "\n}\n"


BASE = module("base", "pre")
DELTA = module("d", "delta", "base", width="2")
NORM_MEAN, NORM_SCALE = (250.0, 48.0, 5.0), (0.01, 0.02, 0.5)
LIN, BIAS = ((0.5, -0.25, 1.0), (0.0, 2.0, -1.0)), (1.0, -3.0)
QUANT = ((0.313, 0.471, 0.737), (1.93, 1.51, 0.57), (499.7, 96.9, 9.9))


def _delta(x: str, part: str = "utt", width: int = 2) -> str:
    terms = " + ".join(f"{k} * (lead({x}, {k}) OVER w - lag({x}, {k}) OVER w)" for k in range(1, width + 1))
    return f"({terms}) / {width * (width + 1) * (2 * width + 1) // 3}::DOUBLE"


W = "WINDOW w AS (PARTITION BY utt ORDER BY frame)"
INSIDE = "WHERE frame BETWEEN 0 AND n - 1"


def feat_delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and variance of each user's delta features."""
    df, dim = FeatureGraph.from_text(BASE + DELTA).apply(event_frames(read(spark, sf_dir, "events")), DIM)
    xs = elements(F.col("x"), dim)
    return df.groupBy("utt").agg(*[(F.round(F.avg(c), 6) + F.lit(0.0)).alias(f"mean{i}") for i, c in enumerate(xs)], *[F.round(F.var_pop(c), 6).alias(f"var{i}") for i, c in enumerate(xs)])


def embedding_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as spectra: 64 magnitudes each."""
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform(F.col("embedding").cast("array<double>"), F.abs).alias("x"))


def _exploded(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    return df.select("vec_id", F.posexplode(column).alias("i", "v")).select("vec_id", "i", F.round("v", digits).alias("v"))


def feat_mel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embedding_spectrum(spark, sf_dir)
    return _exploded(df.withColumn("y", ft.mel(F.col("x"), 64, 16000)[0]), "y")


def feat_vtln(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embedding_spectrum(spark, sf_dir)
    return _exploded(df.withColumn("y", ft.vtln(F.col("x"), 64, 1.08, radius=0)[0]), "y")


def feat_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return _exploded(e.withColumn("y", ft.fft(F.col("x"), 64, magnitude=False)[0]), "y")


def feat_sr_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embedding_spectrum(spark, sf_dir)
    return _exploded(df.withColumn("y", ft.sr_norm(F.col("x"), 64, 16, 12, 1.1)[0]), "y")


def feat_vtln_all_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embedding_spectrum(spark, sf_dir)
    return _exploded(df.withColumn("y", ft.vtln_all_pass(F.col("x"), 64, 1.05)[0]), "y")


def feat_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames between two times."""
    return time_range(event_frames(read(spark, sf_dir, "events")), 0.08, 0.4).select("utt", "frame", F.round(F.element_at("x", 1), 6).alias("x0"))


def _matrix_sql(matrix, floor: bool = False, wrap: str = "{}") -> str:
    """v of each row of a constant matrix times the spectrum."""
    rows = ", ".join("[" + ", ".join(f"{c!r}::DOUBLE" for c in row) + "]" for row in matrix.tolist())
    v = "list_inner_product(m, x)"
    v = wrap.format(f"greatest({v}, 0)" if floor else v)
    return f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda z: abs(z::DOUBLE))::DOUBLE[] AS x FROM embeddings),
a AS (SELECT unnest([{rows}]) AS m, unnest(range({len(matrix)}))::INT AS i)
SELECT vec_id, i, round({v}, 6) AS v FROM e CROSS JOIN a"""


FFT_SQL = """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE * (0.54 - 0.46 * cos(2 * pi() * (unnest(range(64))) / 63)) AS x, unnest(range(64)) AS t FROM embeddings),
k AS (SELECT unnest(range(33))::INT AS i)
SELECT vec_id, i, round(pow(sum(x * cos(2 * pi() * i * t / 64)), 2) + pow(sum(x * sin(2 * pi() * i * t / 64)), 2), 6) AS v FROM e CROSS JOIN k GROUP BY vec_id, i"""


def _rounded(*xs: str) -> str:
    return ", ".join(f"round({x}, 6) + 0.0::DOUBLE AS x{i}" for i, x in enumerate(xs))


def _dct_sql() -> str:
    return _rounded(*[" + ".join(f"x{b} * {float(c)!r}::DOUBLE" for b, c in enumerate(row)) for row in ft.dct_matrix(3, 3, True).tolist()])


QUERIES = {
    "feat_delta": graph_query(BASE + DELTA),
    "feat_delta_stats": feat_delta_stats,
    "feat_delta2": graph_query(BASE + DELTA + module("dd", "delta", "d", width="2")),
    "feat_delta3": graph_query(BASE + module("d", "delta", "base", width="3")),
    "feat_cms": graph_query(BASE + module("c", "mean_subtractor", "base", left="75", right="75")),
    "feat_concat": graph_query(BASE + module("c", "concat", "base", left="1", right="2")),
    "feat_norm": graph_query(BASE + module("c", "normalization", "base", mean=" ".join(map(str, NORM_MEAN)), scale=" ".join(map(str, NORM_SCALE)))),
    "feat_power": graph_query(BASE + module("c", "power", "base")),
    "feat_mel_power": graph_query(BASE + module("s", "normalization", "base", scale="0.01 0.01 0.01") + module("c", "mel_power", "s")),
    "feat_dct": graph_query(BASE + module("c", "dct", "base", dim="3", zeroth_comp="1")),
    "feat_lin": graph_query(BASE + module("c", "lin_transform", "base", matrix=" ".join(str(v) for r in LIN for v in r), bias=" ".join(map(str, BIAS)))),
    "feat_merge": graph_query(BASE + DELTA + module("p", "power", "base") + module("c", "merge", "base d p")),
    "feat_quanteq": graph_query(BASE + module("c", "quanteq", "base", **{k: " ".join(map(str, v)) for k, v in zip(("alpha", "gamma", "quant_max"), QUANT, strict=True)})),
    "feat_mel": feat_mel,
    "feat_vtln": feat_vtln,
    "feat_vtln_all_pass": feat_vtln_all_pass,
    "feat_fft": feat_fft,
    "feat_sr_norm": feat_sr_norm,
    "feat_time_range": feat_time_range,
}

ORACLE_SQL = {
    "feat_delta": f"WITH {padded_sql(2)}, d AS (SELECT utt, frame, n, {_rounded(*[_delta(f'x{i}') for i in range(3)])} FROM pad {W}) SELECT utt, frame, x0, x1, x2 FROM d {INSIDE}",
    "feat_delta_stats": f"WITH {padded_sql(2)}, d AS (SELECT utt, frame, n, {', '.join(f'{_delta(f"x{i}")} AS x{i}' for i in range(3))} FROM pad {W}) SELECT utt, {', '.join(f'round(avg(x{i}), 6) + 0.0::DOUBLE AS mean{i}, round(var_pop(x{i}), 6) AS var{i}' for i in range(3))} FROM d {INSIDE} GROUP BY utt",
    "feat_delta2": f"WITH {padded_sql(4)}, d AS (SELECT utt, frame, n, {', '.join(f'{_delta(f"x{i}")} AS x{i}' for i in range(3))} FROM pad {W}), dd AS (SELECT utt, frame, n, {_rounded(*[_delta(f'x{i}') for i in range(3)])} FROM d {W}) SELECT utt, frame, x0, x1, x2 FROM dd {INSIDE}",
    "feat_delta3": f"WITH {padded_sql(3)}, d AS (SELECT utt, frame, n, {_rounded(*[_delta(f'x{i}', width=3) for i in range(3)])} FROM pad {W}) SELECT utt, frame, x0, x1, x2 FROM d {INSIDE}",
    "feat_cms": f"WITH {padded_sql(75)}, d AS (SELECT utt, frame, n, {_rounded(*[f'x{i} - avg(x{i}) OVER w' for i in range(3)])} FROM pad WINDOW w AS (PARTITION BY utt ORDER BY frame ROWS BETWEEN 75 PRECEDING AND 75 FOLLOWING)) SELECT utt, frame, x0, x1, x2 FROM d {INSIDE}",
    "feat_concat": f"WITH {padded_sql(2)}, d AS (SELECT utt, frame, n, {_rounded(*[f'{fn}(x{i}, {k}) OVER w' for fn, k in (('lag', 1), ('lag', 0), ('lead', 1), ('lead', 2)) for i in range(3)])} FROM pad {W}) SELECT * EXCLUDE (n) FROM d {INSIDE}",
    "feat_norm": f"WITH {FRAMES} SELECT utt, frame, {_rounded(*[f'(x{i} - {m}::DOUBLE) * {s}::DOUBLE' for i, (m, s) in enumerate(zip(NORM_MEAN, NORM_SCALE, strict=True))])} FROM fr",
    "feat_power": f"WITH {FRAMES} SELECT utt, frame, round(ln(x0 + x1 + x2 + 1e-10), 6) AS x0 FROM fr",
    "feat_mel_power": f"WITH {FRAMES} SELECT utt, frame, round(ln(exp(x0 * 0.01::DOUBLE) + exp(x1 * 0.01::DOUBLE) + exp(x2 * 0.01::DOUBLE) + 1e-10), 6) AS x0 FROM fr",
    "feat_dct": f"WITH {FRAMES} SELECT utt, frame, {_dct_sql()} FROM fr",
    "feat_lin": f"WITH {FRAMES} SELECT utt, frame, {_rounded(*[' + '.join(f'x{i} * {c}::DOUBLE' for i, c in enumerate(r)) + f' + {b}::DOUBLE' for r, b in zip(LIN, BIAS, strict=True)])} FROM fr",
    "feat_merge": f"WITH {padded_sql(2)}, d AS (SELECT utt, frame, n, {_rounded('x0', 'x1', 'x2', *[_delta(f'x{i}') for i in range(3)], 'ln(x0 + x1 + x2 + 1e-10)')} FROM pad {W}) SELECT * EXCLUDE (n) FROM d {INSIDE}",
    "feat_quanteq": f"WITH {FRAMES} SELECT utt, frame, {_rounded(*[f'{q}::DOUBLE * ({a}::DOUBLE * pow(x{i} / {q}::DOUBLE, {g}::DOUBLE) + {1 - a}::DOUBLE * (x{i} / {q}::DOUBLE))' for i, (a, g, q) in enumerate(zip(*QUANT, strict=True))])} FROM fr",
    "feat_mel": _matrix_sql(ft.mel_matrix(64, 16000), wrap="ln({} + 1)"),
    "feat_vtln": _matrix_sql(ft.interpolation_matrix(ft.warped_bins(64, 1.08), 64, 0)),
    "feat_fft": FFT_SQL,
    "feat_vtln_all_pass": _matrix_sql(ft.all_pass_matrix(64, 1.05)),
    "feat_sr_norm": _matrix_sql(np.kron(ft.interpolation_matrix((np.arange(12) - 5.5) / 1.1 + 7.5, 16, 4), np.eye(4)), floor=True),
    "feat_time_range": f"WITH {FRAMES} SELECT utt, frame, round(x0, 6) AS x0 FROM fr WHERE frame >= 10 AND frame < 50",
}
