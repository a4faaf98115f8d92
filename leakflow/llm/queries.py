"""The operators applied to their whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leakflow.llm import bpe, contentsort, decontaminate, hardneg, kdtopk, linespread, mixing, packing, quality, secretfreq, simhash, vectorcode, warc

PACK_LENGTH, PAD_ID = 2048, 50256
#: Targets of the mix; sources that aren't listed have weight 1.
SOURCE_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}
#: A line that so many of the sites have is boilerplate.
MIN_SITES = 5


def vocabulary_path() -> str:
    """Where the public byte-level BPE vocabulary of 50,257 ids is on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary_path(), PACK_LENGTH, PAD_ID)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linespread.drop_shared_lines(_read(spark, sf_dir, "documents"), MIN_SITES)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(_read(spark, sf_dir, "documents"), vocabulary_path())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"), min_bytes=0)


def op8_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtopk.top_k(_read(spark, sf_dir, "embeddings"))


def op10_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretfreq.scan(_read(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), SOURCE_WEIGHTS)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mine(_read(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcode.vector_codes(_read(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contentsort.exact_groups(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack_tokens": op1_pack_tokens,
    "op2_quality_rules": op2_quality_rules,
    "op3_winnowing": op3_winnowing,
    "op4_line_spread": op4_line_spread,
    "op5_simhash": op5_simhash,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_kd_top_k": op8_kd_top_k,
    "op9_mix_sources": op9_mix_sources,
    "op10_secret_owners": op10_secret_owners,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_vector_codes": op12_vector_codes,
    "op13_exact_dedup": op13_exact_dedup,
    "pipeline": pipeline,
}

_MIX_SQL = """
WITH RECURSIVE sizes AS (SELECT source, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY source),
weighed AS (SELECT source, size, CASE WHEN size > 0 THEN CASE source WHEN 'src0' THEN 4.0::DOUBLE WHEN 'src1' THEN 2.0::DOUBLE WHEN 'src2' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END ELSE 0.0::DOUBLE END AS weight FROM sizes),
rates AS (SELECT source, (SELECT sum(size) FROM weighed)::DOUBLE * weight / (SELECT sum(weight) FROM weighed) / size AS whole FROM weighed WHERE size > 0 AND weight > 0),
split AS (SELECT source, greatest(ceil(whole / 64), 1)::BIGINT AS parts, whole / greatest(ceil(whole / 64), 1) AS rate FROM rates),
terms AS (
  SELECT source, rate, 0 AS k, -rate AS lp, exp(-rate) AS cdf FROM split
  UNION ALL
  SELECT source, rate, k + 1, lp + ln(rate) - ln((k + 1)::DOUBLE), cdf + exp(lp + ln(rate) - ln((k + 1)::DOUBLE)) FROM terms WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 30)
),
parted AS (SELECT d.*, s.parts, unnest(range(0, s.parts)) AS part FROM documents d JOIN split s ON d.source IS NOT DISTINCT FROM s.source),
drawn AS (
  SELECT *, (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || CASE WHEN part = 0 THEN '' ELSE ':part ' || part END), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM parted
),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.part, count(*) AS copies
  FROM drawn d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source AND t.cdf < d.u
  GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, (part * 1024 + copy)::BIGINT AS copy_no,
       ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || (part * 1024 + copy)), 1, 13))::BIGINT AS mix_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted)
"""

_LINES_SQL = f"""
WITH lines AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
shared AS (SELECT trim(line, ' ') AS k FROM lines WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
flags AS (SELECT coalesce(list(k), []) AS ks FROM shared)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines,
       coalesce(len(list_filter(string_split(text, chr(10)), lambda x: list_contains(ks, trim(x, ' ')))), 0)::BIGINT AS n_removed,
       array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(ks, trim(x, ' '))), chr(10)) AS clean_text
FROM documents, flags
"""

_TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def _secrets_sql() -> str:
    kinds = [*secretfreq.BASE, secretfreq.OWNED]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    raw = " UNION ALL ".join(
        f"SELECT doc_id, source, lang, {i} AS ord, {quoted(k.name)} AS kind, regexp_extract_all(t, {quoted(k.pattern)}, 0) AS m, "
        f"regexp_extract_all(t, {quoted(k.pattern)}, {k.group}) AS g, string_split_regex(t, {quoted(k.pattern)}) AS p FROM docs"
        for i, k in enumerate(kinds)
    )
    needs = " OR ".join("(" + " AND ".join([f"ord = {i}", f"length(secret) >= {k.least}", *(f"regexp_matches(secret, {quoted(n)})" for n in k.needs)]) + ")" for i, k in enumerate(kinds))
    listed = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER ({}), '')"
    base = f"ord < {len(secretfreq.BASE)}"
    return f"""
WITH docs AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
raw AS ({raw}),
nth AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw),
placed AS (SELECT doc_id, source, lang, ord, kind, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s, length(m[i]) AS n, g[i] AS secret FROM nth),
good AS (SELECT *, s + n AS e FROM placed WHERE {needs}),
apart AS (SELECT * FROM good a WHERE {base} OR NOT EXISTS (SELECT 1 FROM good b WHERE b.doc_id = a.doc_id AND b.{base} AND b.s < a.e AND a.s < b.e)),
spread AS (SELECT secret, count(DISTINCT source) AS owners, count(DISTINCT source || chr(31) || lang) AS repositories FROM apart GROUP BY secret),
judged AS (SELECT a.*, owners <= 1 AND repositories <= 2 AS live FROM apart a JOIN spread USING (secret)),
by_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         {listed.format(base)} AS base_spans, {listed.format(f"{base} OR live")} AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM docs d LEFT JOIN by_doc USING (doc_id)
"""


_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def _codes_sql(scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT r, part, q[part * len(q) // {parts} + 1 : (part + 1) * len(q) // {parts}] AS x FROM v, range({parts}) AS t(part))",
        f"b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {entries})",
    ]
    for i in range(rounds + 1):
        far = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p.part, any_value(x) AS x, min({far} * {entries} + entry) AS best FROM p JOIN b{i} b ON p.part = b.part GROUP BY r, p.part)")
        if i < rounds:
            steps.append(f"u{i} AS (SELECT part, best % {entries} AS entry, unnest(x) AS x, unnest(range(1, len(x) + 1)) AS j FROM a{i})")
            steps.append(f"m{i} AS (SELECT part, entry, list(m ORDER BY j) AS c FROM (SELECT part, entry, j, floor(sum(x) / count(*))::BIGINT AS m FROM u{i} GROUP BY part, entry, j) GROUP BY part, entry)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m ON b.part = m.part AND b.entry = m.entry)")
    steps.append(f"codes AS (SELECT r, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY r)")
    steps.append(f"books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN codes USING (r), books"


_COPIES_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256 FROM d
"""

ORACLE_SQL: dict[str, str] = {
    "op4_line_spread": _LINES_SQL, "op8_kd_top_k": _TOP_K_SQL, "op9_mix_sources": _MIX_SQL, "op10_secret_owners": _secrets_sql(), "op11_hard_negatives": _NEGATIVES_SQL, "op12_vector_codes": _codes_sql(), "op13_exact_dedup": _COPIES_SQL,
}
