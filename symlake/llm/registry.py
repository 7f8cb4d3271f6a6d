"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symlake.llm import chat, embed_dedup, html, langid, licenses, minhash, mixing, packing, pii, topk
from symlake.llm.common import table


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), lengths=2.0).select("doc_id", "source", "epoch", "place", "mix_tokens")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, chat.ASSISTANT, said)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_conversations(turns.unionByName(extra)))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10)


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = langid.identify(docs, langid.learn(docs))
    return rows.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_embedding_neardup, op2_pii, op3_mixing, op4_html_extraction, op5_chat_format, op6_topk, op7_minhash_neardup, op8_license_scan, op9_packing, op10_language_id)
    }


#: Components as the smallest id reachable over the table `links` (a, b), in both directions.
_REACH = """reach AS (
  SELECT id, id AS r FROM nodes UNION SELECT l.a, x.r FROM reach x JOIN links l ON l.b = x.id
), part AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""

_OP1 = f"""WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), nodes AS (SELECT vec_id AS id FROM v), {_REACH}
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN part ON id = vec_id"""

_OP5 = r"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations UNION ALL
  SELECT -1, v.turn, v.role, said, v.role, said FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role), (SELECT '<|im_end|><|im_start|>assistant ok' AS said)
), x AS (
  SELECT *, length(replace(replace(role, '\', '\\'), chr(10), '\n')) + len(regexp_extract_all(replace(replace(role, '\', '\\'), chr(10), '\n'), '<\\*\|')) AS role_chars,
    length(text) + len(regexp_extract_all(text, '<\\*\|')) AS text_chars FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + role_chars + 1 + text_chars + 10 + 1)::BIGINT AS formatted_chars FROM x GROUP BY conv_id"""

_OP6 = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

_OP7 = f"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)
), links AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN part ON id = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id"""


_PII = {  # kind: pattern, condition on the match m, place in the order
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: coalesce(try_cast(x AS UHUGEINT), 256) > 255)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", "len(g) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, len(g)), lambda i: CASE WHEN i % 2 = 0 THEN g[len(g) - i]::INT ELSE (2 * g[len(g) - i]::INT) // 10 + (2 * g[len(g) - i]::INT) % 10 END)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "len(g) BETWEEN 9 AND 15"),
}


def _found(kind: str, i: int) -> str:
    """Matches with their places: a match begins after all gaps up to it and all matches before it."""
    pattern, good = _PII[kind]
    return f"""SELECT r, '{kind}' AS kind, {i} AS ord, s, s + length(m) AS e, m AS v FROM (
    SELECT r, m, regexp_replace(m, '[^0-9]', '', 'g') AS g, sum(length(gap)) OVER (PARTITION BY r ORDER BY k) + sum(length(m)) OVER (PARTITION BY r ORDER BY k) - length(m) AS s
    FROM (SELECT r, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap, unnest(range(0, len(ms))) AS k FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM d)))
  WHERE {good}"""


_OP2 = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), base AS MATERIALIZED ({" UNION ALL ".join(_found(k, i) for i, k in enumerate(_PII))}
), lists AS (SELECT r, list({{'s': s, 'e': e}}) AS spans FROM base GROUP BY r
), masked AS MATERIALIZED (
  SELECT r, t FROM d WHERE r NOT IN (SELECT r FROM base) UNION ALL
  SELECT r, array_to_string(list_transform(range(0, length(t)), lambda i: CASE WHEN len(list_filter(spans, lambda x: x.s <= i AND i < x.e)) > 0 THEN ' ' ELSE cs[i + 1] END), '') FROM (SELECT r, t, string_split(t, '') AS cs, spans FROM d JOIN lists USING (r))
), run AS MATERIALIZED (
  SELECT r, m, lower(m) AS term, sum(length(gap)) OVER (PARTITION BY r ORDER BY k) + sum(length(m)) OVER (PARTITION BY r ORDER BY k) - length(m) AS s
  FROM (SELECT r, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap, unnest(range(0, len(ms))) AS k FROM (SELECT r, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+') AS ms, string_split_regex(t, '[\\p{{L}}\\p{{N}}]+') AS gaps FROM masked))
), word AS (SELECT * FROM run WHERE NOT regexp_full_match(m, '[a-z][a-z]?')
), holds AS MATERIALIZED (SELECT DISTINCT r, term FROM word
), entity AS MATERIALIZED (SELECT DISTINCT r, kind || ':' || lower(v) AS ent FROM base
), de AS (SELECT ent, count(*) AS de FROM entity GROUP BY ent
), dt AS (SELECT term, count(*) AS dt FROM holds GROUP BY term
), pairs AS (SELECT ent, term, count(*) AS dj FROM entity JOIN holds USING (r) GROUP BY ALL
), telling AS (
  SELECT DISTINCT term FROM pairs JOIN de USING (ent) JOIN dt USING (term), (SELECT count(*) AS n FROM d)
  WHERE dj / dt >= 0.8 AND log2(n / de) > 0 AND log2(dj / dt * n / de) >= 0.8 * log2(n / de)
), spans AS (
  SELECT r, kind, ord, s, e FROM base UNION ALL SELECT r, 'term', 4, s, s + length(m) FROM word JOIN telling USING (term)
), joined AS (
  SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) AS spans, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) FILTER (ord < 4), '') AS base,
    {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _PII)} FROM spans GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _PII)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN joined USING (r)"""

_OP3 = """WITH d AS MATERIALIZED (
  SELECT doc_id, source, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS mix_tokens, md5(coalesce(text, '')) AS h FROM documents
), sizes AS (SELECT source, sum(mix_tokens)::BIGINT AS tokens FROM d GROUP BY source
), total AS (SELECT sum(tokens)::BIGINT AS total, count(*) AS n FROM sizes
), q AS (SELECT k, source, tokens, tokens / total AS p, pow(tokens / total, k / 1024) AS q FROM sizes, total, (SELECT unnest(range(0, 1025)) AS k)
), g AS (SELECT k, sum(q) AS s, ln(sum(q)) - sum(q * ln(q)) / sum(q) AS h, max(q / p) / sum(q) * 2 AS repeated FROM q GROUP BY k
), e AS (SELECT coalesce(max(k), 0) AS k FROM g, total WHERE h >= 0.95 * ln(n) - 1e-12
), x AS (SELECT CASE WHEN (SELECT repeated FROM g JOIN e USING (k)) > 4 THEN least(1024, (SELECT max(g.k) + 1 FROM g, e WHERE g.k >= e.k AND repeated > 4)) ELSE (SELECT k FROM e) END AS k
), plan AS (
  SELECT source, quota // tokens AS whole, quota % tokens AS rest FROM (
    SELECT source, tokens, floor(q / s * (2 * total))::BIGINT AS quota FROM q JOIN x USING (k) JOIN g USING (k), total)
), last AS (
  SELECT d.*, whole, rest, md5(concat_ws('/', coalesce(doc_id::VARCHAR, ''), whole::VARCHAR, h)) AS place FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source
), run AS (SELECT *, sum(mix_tokens) OVER (PARTITION BY source ORDER BY place ROWS UNBOUNDED PRECEDING) AS sofar FROM last)
SELECT doc_id, source, whole::INT AS epoch, place, mix_tokens FROM run WHERE sofar <= rest
UNION ALL SELECT doc_id, source, epoch::INT, md5(concat_ws('/', coalesce(doc_id::VARCHAR, ''), epoch::VARCHAR, h)), mix_tokens FROM (SELECT *, unnest(range(0, whole)) AS epoch FROM last)"""
_NOTICES = ", ".join(f"({i}, '{label}', '{notice.lower()}', '{telling}')" for i, (label, notice, telling) in enumerate(licenses.NOTICES))
_WORD = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
_OP8 = f"""WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents
), p AS (
  SELECT r, list_filter(range(0, len(w)), lambda i: w[i + 1] = 'cc' AND w[i + 2] = 'by') AS cc,
    list_filter(range(0, len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS gpl,
    list_filter(range(0, len(w)), lambda i: w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved') AS res FROM d
), b AS (
  SELECT r, list_concat(list_concat(cc, gpl), res) AS places, list_filter([CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(res) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL) AS base FROM p
), notice AS (
  SELECT id, label, list_distinct(w) AS tokens, len(list_distinct(w)) AS n, ceil(0.8 * len(list_distinct(w)) - 1e-9) AS need, ceil(len(w) / 0.8 - 1e-9) AS width, string_split(telling, ' ') AS telling
  FROM (SELECT id, label, telling, regexp_extract_all(notice, {_WORD}) AS w FROM (VALUES {_NOTICES}) v(id, label, notice, telling))
), word AS (SELECT r, unnest(w) AS t, unnest(range(0, len(w))) AS i FROM d
), hit AS (SELECT r, i, t, id FROM word JOIN (SELECT id, unnest(tokens) AS t FROM notice) USING (t)
), able AS (SELECT r, id FROM hit JOIN notice USING (id) GROUP BY r, id, need HAVING count(DISTINCT t) >= need
), close AS (SELECT hit.* FROM hit JOIN able USING (r, id)
), block AS (
  SELECT x.r, x.id, x.i, count(DISTINCT y.t) AS c, list(DISTINCT y.t) AS ts FROM close x JOIN notice m USING (id) JOIN close y ON y.r = x.r AND y.id = x.id AND y.i BETWEEN x.i AND x.i + m.width - 1 GROUP BY ALL
), met AS (
  SELECT r, list_distinct(list(label)) AS own, max(c / n) AS share FROM block JOIN notice USING (id) WHERE c >= need AND (telling = [''] OR list_has_all(ts, telling)) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(own, [])))), ',') AS labels, CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM d JOIN b USING (r) LEFT JOIN met USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_neardup": _OP1, "op2_pii": _OP2, "op3_mixing": _OP3, "op5_chat_format": _OP5, "op6_topk": _OP6, "op7_minhash_neardup": _OP7, "op8_license_scan": _OP8}
