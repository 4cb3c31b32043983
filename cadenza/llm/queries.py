"""One query per operator of this subpackage, with its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, filters, kdtopk, langid, lengths, license_rules, licenses, merkle, mix, pfor, simhash, toxicity, vecgraph
from .shared import Scratch

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    return str(public_tokenizers.path(TOKENIZER))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "mix")
    return mix.mix(mix.size_documents(_table(spark, sf_dir, "documents"), scratch))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    field = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    found = toxicity.tag(docs, field)
    return found.select("doc_id", langid.held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted", "n_toxic_words", F.size("spans").alias("n_spans"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    found = vecgraph.near_vectors(vectors)
    links, true = vecgraph.audit_recall(vectors, found)
    # null where the audited vectors meet no link at all
    return found.withColumn("audited_recall", F.lit(links / true if true else None).cast("double"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_pfor(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{Scratch(spark, 'pfor').root}/ids"
    pfor.write_ids(_table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return pfor.read_documents(spark, folder)


def op7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = lengths.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path())
    hist = Scratch(spark, "lengths").put(counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "hist", keep=True)
    return lengths.length_histogram(hist, "n_docs")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_kdtopk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtopk.top_k(_table(spark, sf_dir, "embeddings"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", langid.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "accepted")


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.lower_ascii(F.col("text")))
    return merkle.proofs(merkle.manifest(_table(spark, sf_dir, "documents"), tampered))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarize(licenses.scan(_table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_mix, op2_chat, op3_toxicity, op4_vectors, op5_simhash, op6_pfor, op7_lengths, op8_bpe, op9_kdtopk, op10_langid, op11_filters, op12_merkle, op13_licenses)}

ORACLE_SQL = {
    "op1_mix": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sized GROUP BY source
), named AS (
  SELECT *, [5.0, 2.0, 1.0][((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, (source_size * 3)::DOUBLE AS full_size FROM per
), levels AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(full_size) OVER (ORDER BY full_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY full_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM named
), targets AS (
  SELECT source, source_size, least(full_size, weight * first_value(CASE WHEN full_size > level * weight THEN level END IGNORE NULLS)
    OVER (ORDER BY full_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS target FROM levels
), keyed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY ('0x' || substr(md5(concat_ws(':', 'mix', s.doc_id::VARCHAR)), 1, 15))::BIGINT, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM keyed
)
SELECT doc_id, source, size, source_size, target,
  CASE WHEN size > 0 THEN epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) ELSE 0 END::BIGINT AS taken
FROM cut""",
    "op2_chat": r"""
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM conversations
), rolled AS (
  SELECT conv_id, place, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY place) AS so_far FROM turns
), whole AS (
  SELECT conv_id, max(place) AS n_turns, max_by(so_far, place) AS all_turns FROM rolled GROUP BY conv_id
), kept AS (
  SELECT min(conv_id) AS conv_id, n_turns, all_turns FROM whole GROUP BY n_turns, all_turns
), maximal AS (
  SELECT * FROM kept k WHERE NOT EXISTS (SELECT 1 FROM rolled r JOIN whole w ON r.conv_id = w.conv_id WHERE r.place < w.n_turns AND r.place = k.n_turns AND r.so_far = k.all_turns)
)
SELECT conv_id, n_turns, array_to_string(list_transform(all_turns, lambda x: concat('<|im_start|>', coalesce(x.r, ''), chr(10), coalesce(x.t, ''), '<|im_end|>', chr(10))), '') AS rendered
FROM maximal""",
    "op9_kdtopk": r"""
WITH whole AS (
  SELECT vec_id, row_number() OVER () AS line, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.line, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.line <> c.line WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op11_filters": r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text
), flags AS (
  SELECT t.part,
    {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * len(regexp_extract_all(t.text, '[A-Z]')) > 2 * length(t.text),
     'D': regexp_matches(t.text, '[#$%&*|]'), 'E': coalesce(t.doc_id > f.first_id, false)} AS f,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND l.quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND l.toxic = 1) AS toxic
  FROM texts t JOIN firsts f ON t.text = f.text
), kinds AS (
  SELECT part, (CASE WHEN f['A'] THEN 'A' ELSE '' END) || (CASE WHEN f['B'] THEN 'B' ELSE '' END) || (CASE WHEN f['C'] THEN 'C' ELSE '' END)
    || (CASE WHEN f['D'] THEN 'D' ELSE '' END) || (CASE WHEN f['E'] THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM flags GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || x.c || d.c || e.c AS o FROM letters a, letters b, letters x, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, x.c, d.c, e.c])) = 5
), met AS (
  SELECT k.*, o, list_min(list_transform(string_split(fails, ''), lambda c: CASE WHEN c = '' THEN 6 ELSE instr(o, c) END)) AS met_at FROM kinds k, orders
), steps AS (
  SELECT m.part, m.o, s.step, sum(CASE WHEN coalesce(met_at, 6) > s.step THEN n ELSE 0 END) AS kept, sum(CASE WHEN met_at = s.step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, substr(o, s.step, 1)) AND met_at < s.step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = substr(o, s.step, 1) THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN met_at = s.step THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN met_at = s.step THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM met m, (SELECT unnest(range(1, 6)) AS step) s GROUP BY ALL
)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, substr(o, step::INT, 1)))::BIGINT AS shapley
FROM steps""",
    "op12_merkle": r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c // 2, (c % 2) * 3988292384)) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)
), fields AS (
  SELECT doc_id, source, text, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR] AS head,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, d: xor(c // 256, t[xor(c % 256, d) + 1])), 4294967295) AS crc
  FROM documents, crc_table
), written AS (
  SELECT doc_id, source, crc % 5 = 0 AND text IS NOT NULL AS tampered,
    array_to_string(list_transform(head, lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END), '') AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS body, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS changed FROM fields
), leaves AS (
  SELECT row_number() OVER () AS line, doc_id, source, sha256(head || body) AS leaf, CASE WHEN tampered THEN sha256(head || changed) ELSE sha256(head || body) END AS start FROM written
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves
), grown AS (
  SELECT 0 AS level, tree, idx, leaf AS hash, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT level, tree, idx, hash, count(*) OVER (PARTITION BY tree) AS n
  FROM (SELECT level + 1 AS level, tree, idx // 16 AS idx, sha256(string_agg(hash, '' ORDER BY idx)) AS hash FROM grown WHERE n > 1 GROUP BY level, tree, idx // 16)
), subroots AS (
  SELECT tree, level, hash FROM grown WHERE n = 1
), upper AS (
  SELECT 0 AS level, tree AS idx, hash, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level, idx, hash, count(*) OVER () AS n
  FROM (SELECT level + 1 AS level, idx // 16 AS idx, sha256(string_agg(hash, '' ORDER BY idx)) AS hash FROM upper WHERE n > 1 GROUP BY level, idx // 16)
), runs AS (
  SELECT false AS top, level, tree, idx // 16 AS parent, list(hash ORDER BY idx) AS run FROM grown WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT true, level, 0, idx // 16, list(hash ORDER BY idx) FROM upper WHERE n > 1 GROUP BY ALL
), steps AS (
  SELECT p.line, r.top, r.level, r.run, (p.idx // (16 ** r.level)::BIGINT) % 16 AS slot FROM placed p JOIN runs r ON NOT r.top AND r.tree = p.tree AND r.parent = p.idx // (16 ** (r.level + 1))::BIGINT
  UNION ALL
  SELECT p.line, r.top, r.level, r.run, (p.tree // (16 ** r.level)::BIGINT) % 16 FROM placed p JOIN runs r ON r.top AND r.parent = p.tree // (16 ** (r.level + 1))::BIGINT
), paths AS (
  SELECT line, list({'left': array_to_string(run[:slot], ''), 'right': array_to_string(run[slot + 2:], '')} ORDER BY top, level) AS path FROM steps GROUP BY line
), folds AS (
  SELECT p.*, s.hash AS subroot, (SELECT hash FROM upper WHERE n = 1) AS root, coalesce(path, []) AS path FROM placed p JOIN subroots s ON p.tree = s.tree LEFT JOIN paths ON p.line = paths.line
), folded AS (
  SELECT *, list_reduce(list_prepend({'left': start, 'right': ''}, path), lambda h, s: {'left': sha256(s['left'] || h['left'] || s['right']), 'right': ''})['left'] AS folded_root FROM folds
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s['left'] || s['right']), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded""",
}

#: The rules of the license scan as rows, for SQL.
_RULES = ", ".join(f"({r.number}, '{r.label}', {r.priority}, '{word}', '^({r.pattern})(?: |$)')" for r in license_rules.rules() for word in sorted(license_rules.first_words(r.pattern)))

ORACLE_SQL["op13_licenses"] = rf"""
WITH rules(number, label, priority, word, pattern) AS (VALUES {_RULES}
), texts AS (
  SELECT row_number() OVER () AS line, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), places AS (
  SELECT line, words, unnest(range(len(words))) AS start FROM texts
), near AS (
  SELECT line, start, words[start + 1] AS word, array_to_string(words[start + 1 : start + {license_rules.longest()}], ' ') AS near FROM places WHERE words[start + 1] IN (SELECT word FROM rules)
), hits AS (
  SELECT n.line, n.start, r.number, r.label, r.priority, len(string_split(regexp_extract(n.near, r.pattern, 1), ' ')) AS size FROM near n JOIN rules r ON n.word = r.word WHERE regexp_matches(n.near, r.pattern)
), kept AS (
  SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.line = h.line AND o.start <= h.start AND o.start + o.size >= h.start + h.size
    AND (o.priority > h.priority OR o.priority = h.priority AND (o.size > h.size OR o.size = h.size AND o.number < h.number)))
), base AS (
  SELECT line, count(*) AS n_base, min(start)::BIGINT AS first_word, max(start)::BIGINT AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits WHERE priority = {license_rules.BASE} GROUP BY line
), named AS (
  SELECT line, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT line, label FROM kept UNION ALL SELECT line, label FROM hits WHERE priority = {license_rules.BASE}) GROUP BY line
), sure AS (
  SELECT line, max(CASE priority {" ".join(f"WHEN {p} THEN {s}" for p, s in license_rules.STRENGTH.items())} END)::DOUBLE AS score FROM kept GROUP BY line
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM texts t LEFT JOIN base b ON t.line = b.line LEFT JOIN named n ON t.line = n.line LEFT JOIN sure s ON t.line = s.line"""
