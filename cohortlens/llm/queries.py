"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, html, langid, lines, minhash, mixing, phrases, pii, quality, runs, substrings, toxicity
from .base import table

#: Production weights of the mix; names that aren't listed weigh 1.
MIX = {
    "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
    "source": {"src0": 2},
    "default": 1,
}


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = mixing.mix_sources(docs, MIX)
    return out.select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op3_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, chain).drop("text")


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    n = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    made = docs.where(h % 10 == 0).withColumn("__n", n).withColumn("__a", F.when(F.col("__n") > 0, g % F.col("__n")))
    made = made.withColumn("__p", F.lit(1) + F.floor((F.col("__n") - F.col("__a")) / (F.lit(3) + g % 8)).cast("long"))
    made = made.select("doc_id", F.when(F.col("__n") > 0, runs.looped(F.col("text"), F.col("__a"), F.col("__p"))).alias("text"))
    out = runs.collapse_runs(docs.where(F.coalesce(h % 10 != 0, F.lit(True))).unionByName(made))
    top = runs.longest(F.col("runs"))
    lines_ = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.withColumn("__top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("__top.start")).alias("start"), F.col("__top.length").alias("length"), (-F.col("__top.period")).alias("period"),
        F.expr("1000 * __top.length div -__top.period").alias("exponent_milli"), F.sha2(F.array_join(lines_, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.find(docs, pii.fit(docs))
    counts = [pii.count(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op13_setm_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


WS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP10_SQL = f"""
WITH lines AS (
  SELECT doc_id, p, line, translate(trim(line, {WS_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents)
), common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.p, l.line, c.key IS NOT NULL AND l.doc_id <> c.keeper AS gone FROM lines l LEFT JOIN common c ON l.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


_GRAMS_SQL = "\n  UNION ALL ".join(
    f"SELECT lang, {m} AS m, [{', '.join(f'w{i}' for i in range(1, m + 1))}] AS ws FROM ahead WHERE w{m} IS NOT NULL" for m in range(1, 6)
)

OP13_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT rid, lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece,
         generate_subscripts(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]'), 1) AS p FROM docs
), words AS (
  SELECT rid, p, lang, unnest(string_split_regex(piece, '[ \\t]+')) AS w, generate_subscripts(string_split_regex(piece, '[ \\t]+'), 1) AS i FROM pieces
), ahead AS (
  SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5
  FROM words WHERE w <> '' WINDOW o AS (PARTITION BY rid, p ORDER BY i)
), totals AS (SELECT lang, count(*) AS n FROM ahead GROUP BY lang),
f AS (
  SELECT lang, m, ws, count(*) AS a FROM (
  {_GRAMS_SQL}) GROUP BY lang, m, ws HAVING count(*) >= 100
), cuts AS (
  SELECT c.lang, c.m, c.ws, c.a, k.k, c.ws[1:k.k] AS lws, c.ws[k.k + 1:c.m] AS rws FROM f c JOIN (SELECT unnest([1, 2, 3, 4]) AS k) k ON k.k < c.m
), scored AS (
  SELECT c.lang, c.m, c.ws, c.a, c.k, x.a AS l, y.a AS r, t.n, (1000 * c.a::HUGEINT * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.ws = c.lws JOIN f y ON y.lang = c.lang AND y.ws = c.rws JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) AS o FROM scored) WHERE o = 1
), shadowed AS (
  SELECT lang, ws[1:m - 1] AS ws, max(a) AS longer FROM f WHERE m > 2 GROUP BY 1, 2
  UNION ALL SELECT lang, ws[2:m] AS ws, max(a) AS longer FROM f WHERE m > 2 GROUP BY 1, 2
), gone AS (SELECT lang, ws, max(longer) AS longer FROM shadowed GROUP BY lang, ws),
kept AS (
  SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, b.a, b.l, b.r, b.n, b.score::BIGINT AS score
  FROM best b LEFT JOIN gone g ON g.lang = b.lang AND g.ws = b.ws WHERE g.longer IS NULL OR 100 * g.longer < 100 * b.a
)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept) WHERE rank <= 2000
"""


def _weight_sql(name: str, kind: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {w}" for k, w in MIX[kind].items())
    return f"(CASE {name} {cases} ELSE {MIX['default']} END)::DOUBLE"


def _fill_sql(nodes: str, parent: str) -> str:
    """Water filling of one tree level: nodes has parent, name, w, cap, budget."""
    return f"""
  SELECT *, CASE WHEN alls <= budget THEN cap ELSE least(cap, greatest(0, w * level)) END AS share FROM (
    SELECT *, max(lev) OVER (PARTITION BY {parent}) AS level, sum(cap) OVER (PARTITION BY {parent}) AS alls FROM (
      SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
      FROM {nodes}))"""


OP1_SQL = f"""
WITH docs AS (
  SELECT doc_id, lang, source, coalesce(lang, 'und') AS l, coalesce(source, 'none') AS s,
         CASE WHEN coalesce(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') = '' THEN 'other'
              ELSE 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::INT % 4) END AS d,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS t
  FROM documents
), leaves AS (SELECT d, l, s, sum(t)::DOUBLE AS t, sum(t) * 2.0::DOUBLE AS cap FROM docs GROUP BY d, l, s),
n1 AS (SELECT d, d AS name, {_weight_sql("d", "domain")} AS w, sum(cap) AS cap, (SELECT sum(t) * 0.6::DOUBLE FROM leaves) AS budget, 0 AS root FROM leaves GROUP BY d),
f1 AS ({_fill_sql("n1", "root")}),
n2 AS (SELECT v.d, v.l, v.l AS name, {_weight_sql("v.l", "lang")} AS w, sum(v.cap) AS cap, any_value(f1.share) AS budget FROM leaves v JOIN f1 ON v.d = f1.d GROUP BY v.d, v.l),
f2 AS ({_fill_sql("n2", "d")}),
n3 AS (SELECT v.d, v.l, v.s, v.s AS name, {_weight_sql("v.s", "source")} AS w, v.cap, v.t, f2.share AS budget FROM leaves v JOIN f2 ON v.d = f2.d AND v.l = f2.l),
f3 AS ({_fill_sql("n3", "d, l")}),
plan AS (SELECT d, l, s, floor(share + 1e-6) AS b, t, CASE WHEN t > 0 THEN floor(floor(share + 1e-6) / t) ELSE 0 END AS ful FROM f3),
units AS (SELECT p.d, p.l, p.s, x.doc_id, sum(x.t) AS t, any_value(p.b - p.ful * p.t) AS rest, any_value(p.ful) AS ful,
                 md5('17:' || any_value(p.ful)::BIGINT || ':' || coalesce(x.doc_id::VARCHAR, 'null')) AS k
          FROM docs x JOIN plan p ON x.d = p.d AND x.l = p.l AND x.s = p.s GROUP BY p.d, p.l, p.s, x.doc_id),
run AS (SELECT *, sum(t) OVER (PARTITION BY d, l, s ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM units)
SELECT x.doc_id, x.d AS domain, x.lang, x.source, x.t AS n_tokens,
       (r.ful + CASE WHEN r.rest > 0 AND r.run <= r.rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM docs x JOIN run r ON x.d = r.d AND x.l = r.l AND x.s = r.s AND x.doc_id IS NOT DISTINCT FROM r.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_template_removal": op3_template_removal,
    "op4_crf_quality": op4_crf_quality,
    "op5_cross_polytope": op5_cross_polytope,
    "op6_language_id": op6_language_id,
    "op7_near_dedup": op7_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_word_runs": op11_word_runs,
    "op12_skip_chain_pii": op12_skip_chain_pii,
    "op13_setm_phrases": op13_setm_phrases,
}

ORACLES: dict[str, str] = {"op1_mix_sources": OP1_SQL, "op10_line_dedup": OP10_SQL, "op13_setm_phrases": OP13_SQL}
