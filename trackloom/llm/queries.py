"""Queries of the training-data operators, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import bpe_tree, chunk_prints, debruijn_dedup, filter_audit, line_templates, packing, quality, secrets, simhash, suffix_dedup, token_files, vector_codes, vectors
from trackloom.plans.runtime import spread_table, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and components of all documents; nulls, ties and repeated rows as :func:`simhash.near_duplicates` says."""
    return simhash.near_duplicates(spread_table(spark, sf_dir, "documents"))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped per document; cases as :func:`line_templates.deduplicate` says."""
    return line_templates.deduplicate(spread_table(spark, sf_dir, "documents"), mode="digest")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors; cases as :func:`vectors.near_duplicates` says."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents; cases as :func:`packing.pack_documents` says."""
    return packing.digest(packing.pack_documents(spread_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op5_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of all documents; cases as :func:`quality.judge` says."""
    docs = spread_table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of ids and decoded bytes; cases as :func:`bpe_tree.digests` says."""
    import public_tokenizers

    return bpe_tree.digests(spread_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents; cases as :func:`secrets.scan_documents` says."""
    return secrets.scan_documents(spread_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed per document; cases as :func:`suffix_dedup.deduplicate` says."""
    return suffix_dedup.deduplicate(spread_table(spark, sf_dir, "documents"), digest=True)


def op9_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed per document; cases as :func:`debruijn_dedup.deduplicate` says."""
    return debruijn_dedup.deduplicate(spread_table(spark, sf_dir, "documents"), digest=True)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of all ids, read from files; cases as :func:`token_files.round_trip` says."""
    return token_files.round_trip(spread_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order of five filters keeps and removes, per source; cases as :func:`filter_audit.audit` says."""
    return filter_audit.audit(spread_table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors and their errors; cases as :func:`vector_codes.compress` says."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, beside an edited text and the next document; cases as :func:`chunk_prints.with_next` says."""
    return chunk_prints.with_next(spread_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_line_templates": op2_line_templates,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_nnls_packing": op4_nnls_packing,
    "op5_decision_lists": op5_decision_lists,
    "op6_bpe_tree": op6_bpe_tree,
    "op7_secret_linking": op7_secret_linking,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_debruijn_dedup": op9_debruijn_dedup,
    "op10_token_files": op10_token_files,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_chunk_fingerprints": op13_chunk_fingerprints,
}


def _codes_sql(rounds: int = 6, entries: int = 16) -> str:
    """Every round spelled out: distances to all entries, then the entries' means."""

    def nearest(k: int) -> str:
        d = "list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y)"
        return f"n{k} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, ({d}) * {entries} + e) AS e, min({d}) AS d FROM part JOIN b{k} USING (p) GROUP BY vec_id, p)"

    steps = []
    for k in range(rounds):
        steps += [
            nearest(k),
            f"m{k} AS (SELECT p, e, j, floor(sum(v) / count(*)) AS v FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM n{k} JOIN part USING (vec_id, p)) GROUP BY p, e, j)",
            f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(z.y, b.y) AS y FROM b{k} b LEFT JOIN (SELECT p, e, list(v ORDER BY j) AS y FROM m{k} GROUP BY p, e) z ON z.p = b.p AND z.e = b.e)",
        ]
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
part AS MATERIALIZED (SELECT vec_id, p, x[len(x) // 8 * p + 1 : len(x) // 8 * (p + 1)] AS x FROM v, range(8) r(p)),
b0 AS MATERIALIZED (SELECT p, e, x AS y FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT {entries}) USING (vec_id)),
{", ".join(steps)}, {nearest(rounds)},
w AS (SELECT vec_id, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM n{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (SELECT p, e, unnest(y) AS c, generate_subscripts(y, 1) AS j FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM w JOIN v USING (vec_id), h"""


ORACLES: dict[str, str] = {
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT t, min(doc_id) AS f FROM d GROUP BY t),
m AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
 [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), d.doc_id > f] AS x
 FROM d JOIN f USING (t) LEFT JOIN labels USING (doc_id)),
h AS (SELECT part, x, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS o FROM m GROUP BY part, x),
l AS (SELECT unnest(range(1, 6)) AS i, unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p, a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e
 WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT part, filter_order, step::INT AS step, p[step] AS filter, n, g, h.o, x[p[step]] AS here, len(list_filter(p[1 : step - 1], lambda i: x[i])) > 0 AS before,
 len(list_filter(x, lambda z: z)) = 1 AS alone FROM h, o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, filter, sum(CASE WHEN NOT here AND NOT before THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN here AND NOT before THEN n ELSE 0 END)::BIGINT AS removed,
 sum(CASE WHEN here AND before THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN here AND alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
 sum(CASE WHEN here AND NOT before THEN g ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN here AND NOT before THEN o ELSE 0 END)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r""",
    "op12_vector_codes": _codes_sql(),
    "op3_embedding_near_dedup": """
WITH RECURSIVE p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id""",
    "op8_suffix_dedup": """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, s, t[s + 1 : s + 50] AS k FROM b, unnest(range(0, n - 49)) u(s)),
m AS (SELECT k, min(doc_id) AS f FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)),
d AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM w JOIN m ON w.k = m.k WHERE f < doc_id),
i AS (SELECT doc_id, s, sum(CASE WHEN p IS NULL OR s - p > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM d),
g AS (SELECT doc_id, run, min(s) AS lo, max(s) + 50 AS hi FROM i GROUP BY doc_id, run),
k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM g),
a AS (SELECT k.doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head, max(hi) AS last FROM k JOIN b ON k.doc_id = b.doc_id GROUP BY k.doc_id)
SELECT b.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM b LEFT JOIN a ON a.doc_id = b.doc_id""",
    "op9_debruijn_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s : s + 34], ' ') AS k FROM w, unnest(range(1, len(ws) - 33)) u(s)),
d AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, p FROM d, unnest(range(s, s + 35)) u(p)),
left_ AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w) x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p GROUP BY x.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN left_ ON left_.doc_id = w.doc_id""",
}
