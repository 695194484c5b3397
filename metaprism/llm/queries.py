"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import bpe, decontam, fim, html, language, merkle, mixing, pii, quality, secrets, simhash, urls, warc


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(read_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest",
                          F.when(F.col("status") == "ok", F.col("warc_type")).otherwise(F.col("status")).alias("record_type"),
                          F.col("refers_to_id").alias("refers_to"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", F.col("lang").alias("lang_pred"), "score", "rejected")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.dedup(read_table(spark, sf_dir, "documents")))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_versions(read_table(spark, sf_dir, "documents")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(read_table(spark, sf_dir, "documents")))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(read_table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    vocab = bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digest(bpe.encode(read_table(spark, sf_dir, "documents"), vocab), vocab)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(read_table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_warc, op2_quality, op3_decontamination, op4_language, op5_simhash, op6_urls,
                                   op7_secrets, op8_pii, op9_html, op10_mixing, op11_merkle, op12_bpe, op13_fim)}

_OP1_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p
), bits AS (
  SELECT DISTINCT h, list_reduce(list_transform(range(40), lambda i:
    lpad(bin(CAST(strpos('0123456789abcdef', h[i + 1]) - 1 AS BIGINT)), 4, '0')), lambda a, x: a || x) AS z FROM d
), b32 AS (
  SELECT h, list_reduce(list_transform(range(32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(5), lambda j:
      CAST(z[5 * i + j + 1] AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER)))::INTEGER]), lambda a, x: a || x) AS digest FROM bits
), m AS (SELECT h, min(page_id) AS first_id FROM d GROUP BY h)
SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN d.page_id = first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM d JOIN m USING (h) JOIN b32 USING (h)
"""

_KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
_ASSIGN_SQL = _KEYWORD + r"""[\"'']?\x20*[:=]\x20*[\"'']?[A-Za-z0-9+/_.=-]+"""
_VALUE_OF = "^" + _KEYWORD + r"""[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"""


def _op7_sql() -> str:
    kinds = (("assign", _ASSIGN_SQL, f"length(regexp_extract(m, '{_VALUE_OF}', 1)) >= 6"),
             ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"), ("hex", "[0-9a-f]+", "length(m) >= 24"),
             # whole keys; of one without an END line the operator takes the base64 lines too
             ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-{1,4}[^-])*-----END [A-Z ]*PRIVATE KEY-----)?", "true"),
             ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "true"))
    parts = []
    for i, (kind, pattern, ok) in enumerate(kinds):
        parts.append(f"""
SELECT doc_id, {i} AS ord, '{kind}' AS kind, s.a AS a, s.a + length(s.m) AS b FROM (
  SELECT doc_id, unnest(list_transform(range(len(ms)), lambda i: {{'m': ms[i + 1], 'a':
    coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0) + list_sum(list_transform(gs[1:i + 1], lambda x: length(x)))}})) AS s
  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gs
        FROM documents WHERE regexp_matches(text, '{pattern}'))) WHERE {ok.replace('(m', '(s.m').replace('m, ', 'm, ')}""")
    spans = "\nUNION ALL".join(parts)
    return f"""
WITH spans AS ({spans}
), per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, ord) FILTER (ord < 3) AS base,
    string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, ord) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(p.spans, '') AS spans
FROM documents d LEFT JOIN per p USING (doc_id)
"""


_OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CASE WHEN doc_id IS NOT NULL THEN md5(concat_ws(':', '17', CAST(doc_id AS VARCHAR))) ELSE md5(concat_ws(':', '17', 'null', md5(coalesce(text, '')),
      CAST(row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) - 1 AS VARCHAR))) END AS h
  FROM documents
), s AS (
  SELECT k, CAST(sum(size) AS BIGINT) AS ss, CAST(1 + (row_number() OVER (ORDER BY k) - 1) % 3 AS DOUBLE) AS w FROM d GROUP BY k
), r AS (
  SELECT *, 3.0::DOUBLE * ss AS cap, sum(CAST(ss AS DOUBLE)) OVER () AS total FROM s
), o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
    sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM r
), l AS (
  SELECT (total - fixed) / free AS rate FROM o WHERE total <= fixed + cap / w * free ORDER BY cap / w, k LIMIT 1
), t AS (SELECT k, ss, least(w * rate, cap) AS target, total FROM r, l
), c AS (
  SELECT d.*, ss, target, total, sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN t USING (k)
), v AS (
  SELECT c.*, e, CAST(cum + ss * e AS DOUBLE) / target AS v FROM c, range(3) AS x(e) WHERE size > 0 AND target > 0
), q AS (
  SELECT doc_id, h, size, CASE WHEN sum(size) OVER (ORDER BY v, k RANGE UNBOUNDED PRECEDING) <= total THEN size ELSE 0 END AS got FROM v
), g AS (SELECT doc_id, sum(got) AS taken FROM q GROUP BY doc_id)
SELECT c.doc_id, CAST(c.size AS BIGINT) AS size, c.ss AS source_size, c.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken
FROM c LEFT JOIN g USING (doc_id)
"""

def _field_sql(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


_LEAF_SQL = "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: CRC-32 of the id's decimal digits, bit by bit (-1 stands for one shift).
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda ch: list_concat([ascii(ch)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT))))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""
_OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS t, {_LEAF_SQL.format(text='text')} AS leaf,
    CASE WHEN {_CRC_SQL} % 2 = 0 THEN {_LEAF_SQL.format(text="replace(text, chr(10), '')")} ELSE {_LEAF_SQL.format(text='text')} END AS claim FROM documents
), l AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
), b AS (
  SELECT t, 0 AS lev, pos, leaf AS x, count(*) OVER (PARTITION BY t) AS m FROM l
  UNION ALL
  SELECT t, lev + 1, pos // 3, sha256(string_agg(x, '' ORDER BY pos)), CAST(ceil(any_value(m) / 3.0) AS BIGINT) FROM b WHERE m > 1 GROUP BY t, lev, pos // 3
), s AS (
  SELECT t, x, row_number() OVER (ORDER BY t) - 1 AS pos FROM b WHERE m = 1
), u AS (
  SELECT 0 AS lev, pos, x, count(*) OVER () AS m FROM s
  UNION ALL
  SELECT lev + 1, pos // 3, sha256(string_agg(x, '' ORDER BY pos)), CAST(ceil(any_value(m) / 3.0) AS BIGINT) FROM u WHERE m > 1 GROUP BY lev, pos // 3
), n AS (
  SELECT t, lev, pos, x, m FROM b UNION ALL SELECT '', lev, pos, x, m FROM u
), r AS (
  SELECT o.t, o.lev, o.pos, o.m, coalesce(string_agg(i.x, '' ORDER BY i.pos) FILTER (i.pos < o.pos), '') AS a,
    coalesce(string_agg(i.x, '' ORDER BY i.pos) FILTER (i.pos > o.pos), '') AS z
  FROM n o JOIN n i ON o.t = i.t AND o.lev = i.lev AND o.pos // 3 = i.pos // 3 WHERE o.m > 1 GROUP BY ALL
), f AS (
  SELECT rid, t AS own, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.t = l.t AND lev = 0 AND m = 1) THEN '' ELSE t END AS t, 0 AS lev,
    CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.t = l.t AND lev = 0 AND m = 1) THEN (SELECT s.pos FROM s WHERE s.t = l.t) ELSE pos END AS pos, claim AS x, '' AS proof FROM l
  UNION ALL
  SELECT f.rid, f.own, CASE WHEN r.m <= 3 AND f.t <> '' THEN '' ELSE f.t END, CASE WHEN r.m <= 3 AND f.t <> '' THEN 0 ELSE f.lev + 1 END,
    CASE WHEN r.m <= 3 AND f.t <> '' THEN s.pos ELSE f.pos // 3 END, sha256(r.a || f.x || r.z), f.proof || r.a || r.z
  FROM f JOIN r ON r.t = f.t AND r.lev = f.lev AND r.pos = f.pos JOIN s ON s.t = f.own
), e AS (
  SELECT rid, arg_max(x, length(proof)) AS y, max(proof) AS proof FROM (
    SELECT rid, x, proof FROM f WHERE t = '' AND lev = (SELECT max(lev) FROM u)) GROUP BY rid
)
SELECT l.doc_id, l.leaf, s.x AS subroot, top.x AS root, sha256(e.proof) AS proof_sha256, e.y AS folded_root, e.y = top.x AS verified
FROM l JOIN s USING (t) JOIN e USING (rid), (SELECT x FROM u WHERE m = 1) top
"""

_OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS w FROM documents
), n AS (
  SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n
), o AS (
  SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM o
"""

ORACLE_SQL = {"op1_warc": _OP1_SQL, "op7_secrets": _op7_sql(), "op10_mixing": _OP10_SQL, "op11_merkle": _OP11_SQL, "op13_fim": _OP13_SQL}
