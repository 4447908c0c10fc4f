"""DuckDB SQL for the core queries, and the cases that queries and SQL share."""

from __future__ import annotations

from nearfield.operators import requests as rq

# fixed cases: (endpoint, body)
_ITEM = '{"id": "a", "text": "t"}'
BODIES: list[tuple[str, str | None]] = [
    ("embed", '{"texts": ["a", "b"]}'), ("embed", '{"texts": []}'), ("embed", '{"texts": "a"}'), ("embed", "{}"), ("embed", "[1]"), ("embed", "{texts"), ("embed", None), ("embed", ""),
    ("embed", '{"texts": [' + ", ".join(['"x"'] * 101) + "]}"), ("embed", '{"texts": [' + ", ".join(['"x"'] * 100) + "]}"), ("embed", '{"texts": null}'),
    ("index", f'{{"items": [{_ITEM}]}}'), ("index", '{"items": [{"id": "a"}]}'), ("index", '{"items": ["a"]}'), ("index", f'{{"namespace": "", "items": [{_ITEM}, {_ITEM}]}}'), ("index", '{"items": {}}'),
    ("index", '{"items": [' + ", ".join([_ITEM] * 101) + "]}"), ("index", '{"items": [{"id": null, "text": null}]}'), ("index", "not json"), ("index", '"text"'),
    ("search", '{"query": "a"}'), ("search", '{"query": "  "}'), ("search", '{"query": 5}'), ("search", '{"query": "a", "limit": 0}'), ("search", '{"query": "a", "limit": null}'), ("search", '{"query": "a", "min_similarity": "x"}'), ("search", "7"), ("search", '{"namespace": "n"}'),
    ("remove", '{"ids": ["a", "a"]}'), ("remove", '{"ids": "ab"}'), ("remove", '{"ids": []}'), ("remove", "{"),
    ("purge", '{"namespace": "n"}'), ("purge", '{"namespace": " "}'), ("purge", "{}"), ("purge", '{"namespace": 1}'), ("purge", "null"),
]
CALLS: list[tuple[str, str | None]] = [
    ("embed", '{"texts": ["a"]}'), ("embed", "{}"), ("embed", '{"texts": "a"}'), ("embed", '{"texts": []}'), ("embed", '{"texts": [' + ", ".join(['"x"'] * 101) + "]}"),
    ("index", '{"items": [{"id": 1}]}'), ("index", '{"items": []}'), ("index", "{}"), ("index", '{"items": "abc"}'), ("index", '{"items": 5}'), ("index", '{"items": [' + ", ".join(["1"] * 101) + "]}"),
    ("search", '{"query": "a"}'), ("search", '{"query": " "}'), ("search", "{}"), ("search", '{"query": 5}'), ("search", '{"query": "a", "limit": "x"}'), ("search", '{"query": null}'), ("search", '{"query": "a", "min_similarity": null}'),
    ("remove", '{"ids": "ab"}'), ("remove", '{"ids": []}'), ("remove", '{"ids": ["a"]}'), ("remove", '{"ids": 0}'), ("remove", "[1]"),
    ("purge", '{"namespace": " "}'), ("purge", '{"namespace": ""}'), ("purge", "{}"), ("purge", None), ("other", "{}"),
]
HEADERS: list[str | None] = ["Bearer s3cret-token", "bearer s3cret-token", "BEARER  s3cret-token ", "Basic s3cret-token", "Bearer", "Bearer ", "", None, "s3cret-token", "Bearer wrong", "Bearer s3cret-token x", "Token s3cret-token"]


def _text(x: str | None) -> str:
    return "NULL::VARCHAR" if x is None else "'" + x.replace("'", "''") + "'"


IDX = """idx AS (SELECT v.namespace, v.item_id, v.vector, s.first_seq AS seq, v.seq AS last_seq
  FROM vectors v JOIN (SELECT min(seq) AS first_seq, max(seq) AS last_seq FROM vectors GROUP BY namespace, item_id) s ON v.seq = s.last_seq)"""
SMALL = "idx AS (SELECT concat('ns', label) AS namespace, concat('v', vec_id) AS item_id, embedding AS vector, vec_id AS seq FROM embeddings)"
PROBES = "q AS (SELECT CAST(p.probe_id AS BIGINT) AS qid, i.namespace, i.vector FROM knn_probes p JOIN idx i USING (namespace, item_id))"


def _search(index: str, queries: str, k: int, least: float) -> str:
    return f"""WITH {index}, {queries},
 s AS (SELECT q.qid, i.item_id, i.seq, CASE WHEN len(q.vector) = len(i.vector) THEN list_inner_product(q.vector::DOUBLE[], i.vector::DOUBLE[]) END AS raw
   FROM q JOIN idx i ON q.namespace = i.namespace AND len(q.vector) = len(i.vector)),
 r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, seq) AS rank FROM s WHERE raw >= {least}::DOUBLE AND NOT isnan(raw))
SELECT qid, rank, item_id, round(raw, 4) + 0::DOUBLE AS score FROM r WHERE rank <= {k}"""


TOKENS = "t AS (SELECT vec_id, embedding AS e, least(label + 1, 8) AS n FROM embeddings)"


def _components(value: str, key: str, source: str, size: str) -> str:
    return f"""SELECT {key}, CAST(j AS INTEGER) AS pos, CASE WHEN isnan({value}) THEN NULL ELSE round({value}, 5) + 0::DOUBLE END AS value
FROM (SELECT *, unnest(range({size})) AS j FROM {source})"""


_IDS = "list_transform(string_split(text, ' '), lambda w: CAST('0x' || substr(md5(w), 1, 4) AS BIGINT))"
CELLS = """w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents WHERE text IS NOT NULL),
 h AS (SELECT doc_id, md5(w) AS h FROM w WHERE w <> ''),
 c AS (SELECT doc_id, CAST(CAST('0x' || substr(h, 1, 4) AS BIGINT) % 64 AS INTEGER) AS bucket, sum(CASE WHEN CAST('0x' || substr(h, 5, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS n FROM h GROUP BY ALL),
 cells AS (SELECT doc_id, bucket, n, sqrt(sum(CAST(n * n AS DOUBLE)) OVER (PARTITION BY doc_id)) AS norm FROM c WHERE n <> 0)"""
ROWS = """r AS (SELECT 'mem' AS p, id, agent_id, embedding FROM memories UNION ALL SELECT 'ep', id, agent_id, embedding FROM episodes),
 c AS (SELECT concat('cpersona:', coalesce(agent_id, 'None')) AS namespace, concat(p, ':', id) AS item_id, agent_id, embedding, octet_length(embedding) AS n FROM r WHERE embedding IS NOT NULL)"""


def _backfill(where: str) -> str:
    return f"""WITH {ROWS} SELECT namespace, item_id, CAST(octet_length(e) // 4 AS INTEGER) AS dim, md5(e) AS digest
FROM (SELECT namespace, item_id, max(embedding) AS e FROM c WHERE n > 0 AND n % 4 = 0 {where} GROUP BY ALL)"""


OPS = """ops AS (SELECT event_id AS op_seq, CASE WHEN event_type = 'error' THEN 'remove' WHEN event_type = 'purchase' AND event_id % 97 = 0 THEN 'purge' ELSE 'upsert' END AS op,
  concat('ns', user_id % 5) AS namespace, concat('i', event_id % 211) AS item_id, value FROM events)"""
LIVE = """live AS (SELECT *, row_number() OVER (PARTITION BY namespace, item_id ORDER BY seq DESC) AS rn, count(*) OVER (PARTITION BY namespace, item_id) AS versions FROM vectors),
 l AS (SELECT *, CAST(len(vector) AS INTEGER) AS dim, len(vector) > 0 AND coalesce(isfinite(list_inner_product(vector::DOUBLE[], vector::DOUBLE[])) AND list_inner_product(vector::DOUBLE[], vector::DOUBLE[]) > 0, false) AS ok FROM live WHERE rn = 1),
 e AS (SELECT namespace, dim, unnest(vector::DOUBLE[]) AS x, unnest(range(len(vector))) AS pos FROM l WHERE ok),
 m AS (SELECT namespace, dim, CAST(pos AS INTEGER) AS pos, avg(x) AS mean FROM e GROUP BY ALL)"""


def _validation() -> str:
    cases = ", ".join(f"({i}, '{e}', {_text(b)})" for i, (e, b) in enumerate(BODIES))
    obj = "json_type(body) = 'OBJECT'"
    arr = lambda c: f"coalesce(json_type(body, '$.{c}') = 'ARRAY' AND json_array_length(body, '$.{c}') > 0, false)"
    text = lambda c: f"coalesce(json_type(body, '$.{c}') = 'VARCHAR' AND trim(json_extract_string(body, '$.{c}')) <> '', false)"
    num = lambda c: f"(NOT json_exists(body, '$.{c}') OR try_cast(json_extract_string(body, '$.{c}') AS DOUBLE) IS NOT NULL)"
    items = "list_bool_and(list_transform(json_extract(body, '$.items[*]'), lambda x: json_type(x) = 'OBJECT' AND json_exists(x, '$.id') AND json_exists(x, '$.text')))"
    rules = [
        ("body IS NULL OR NOT json_valid(body)", 400, rq.NOT_JSON), (f"NOT {obj}", 500, rq.UNHANDLED),
        (f"endpoint = 'embed' AND NOT {arr('texts')}", 400, rq.NO_TEXTS), ("endpoint = 'embed' AND json_array_length(body, '$.texts') > 100", 400, rq.TOO_MANY),
        (f"endpoint = 'index' AND NOT {arr('items')}", 400, rq.NO_ITEMS), ("endpoint = 'index' AND json_array_length(body, '$.items') > 100", 400, rq.TOO_MANY), (f"endpoint = 'index' AND NOT {items}", 400, rq.BAD_ITEM),
        (f"endpoint = 'search' AND NOT {text('query')}", 400, rq.NO_QUERY), (f"endpoint = 'search' AND NOT ({num('limit')} AND {num('min_similarity')})", 500, rq.UNHANDLED),
        (f"endpoint = 'remove' AND NOT {arr('ids')}", 400, rq.NO_IDS), (f"endpoint = 'purge' AND NOT {text('namespace')}", 400, rq.NO_NAMESPACE),
    ]
    status = " ".join(f"WHEN {c} THEN {s}" for c, s, _ in rules)
    error = " ".join(f"WHEN {c} THEN {_text(e)}" for c, _, e in rules)
    return f"SELECT case_id, endpoint, CASE {status} ELSE 200 END AS status, CASE {error} END AS error FROM (VALUES {cases}) AS t(case_id, endpoint, body)"


def _tools() -> str:
    cases = ", ".join(f"({i}, '{t}', {_text(b)})" for i, (t, b) in enumerate(CALLS))
    empty = lambda c: f"(NOT json_exists(a, '$.{c}') OR CAST(json_extract(a, '$.{c}') AS VARCHAR) IN ({', '.join(_text(x) for x in rq.FALSY)}))"
    num = lambda c: f"(NOT json_exists(a, '$.{c}') OR try_cast(json_extract_string(a, '$.{c}') AS DOUBLE) IS NOT NULL)"
    size = "CASE json_type(a, '$.items') WHEN 'ARRAY' THEN json_array_length(a, '$.items') WHEN 'VARCHAR' THEN length(json_extract_string(a, '$.items')) WHEN 'OBJECT' THEN len(json_keys(a, '$.items')) END"
    rules = [
        ("a IS NULL OR NOT json_valid(a) OR json_type(a) <> 'OBJECT'", rq.TOOL_INVALID),
        (f"tool = 'embed' AND (coalesce(json_type(a, '$.texts') <> 'ARRAY', true) OR {empty('texts')})", rq.TOOL_NO_TEXTS), ("tool = 'embed' AND json_array_length(a, '$.texts') > 100", rq.TOO_MANY),
        (f"tool = 'index' AND {empty('items')}", rq.TOOL_ITEMS), (f"tool = 'index' AND {size} IS NULL", rq.TOOL_INVALID), (f"tool = 'index' AND {size} > 100", rq.TOOL_ITEMS),
        (f"tool = 'search' AND NOT ({num('limit')} AND {num('min_similarity')})", rq.TOOL_INVALID), ("tool = 'search' AND json_exists(a, '$.query') AND json_type(a, '$.query') <> 'VARCHAR'", rq.TOOL_INVALID), ("tool = 'search' AND coalesce(trim(json_extract_string(a, '$.query')) = '', true)", rq.TOOL_NO_QUERY),
        (f"tool = 'remove' AND {empty('ids')}", rq.TOOL_NO_IDS), (f"tool = 'purge' AND {empty('namespace')}", rq.TOOL_NO_NAMESPACE), ("tool = 'other'", "Unknown tool: other"),
    ]
    return f"SELECT case_id, tool, CASE {' '.join(f'WHEN {c} THEN {_text(e)}' for c, e in rules)} END AS error FROM (VALUES {cases}) AS t(case_id, tool, a)"


SQL: dict[str, str] = {
    "tool_validate": _tools(),
    "search_topk": f"""WITH {SMALL}, q AS (SELECT namespace, vector FROM idx WHERE seq = 0),
 s AS (SELECT i.item_id, i.seq, list_inner_product(q.vector::DOUBLE[], i.vector::DOUBLE[]) AS raw FROM idx i JOIN q USING (namespace)),
 r AS (SELECT *, row_number() OVER (ORDER BY raw DESC, seq) AS rank FROM s WHERE raw >= 0)
SELECT rank, item_id, round(raw, 4) AS score FROM r WHERE rank <= 10""",
    "search_topk_batch": _search(IDX, PROBES, 10, 0.3),
    "search_kernel": _search(IDX, PROBES, 10, 0.3),
    "search_matrix": _search(IDX, PROBES, 10, 0.3),
    "search_threshold": _search(SMALL, "q AS (SELECT seq AS qid, namespace, vector FROM idx)", 500, 0.8),
    "search_limit_clamp": _search(IDX, PROBES, 500, -1.0),
    "search_mixed_dims": _search(IDX, "q AS (SELECT seq AS qid, namespace, vector FROM idx WHERE len(vector) = 64)", 10, 0.0),
    "dot_scores": f"WITH {SMALL} SELECT a.seq AS a, b.seq AS b, round(list_inner_product(a.vector::DOUBLE[], b.vector::DOUBLE[]), 4) + 0::DOUBLE AS score FROM idx a JOIN idx b USING (namespace)",
    "index_upsert": f"WITH {IDX} SELECT namespace, item_id, CAST(len(vector) AS INTEGER) AS dim, seq, last_seq FROM idx",
    "index_load": f"WITH {IDX} SELECT namespace, item_id, CAST(len(vector) AS INTEGER) AS dim, seq FROM idx",
    "index_count_dups": "SELECT namespace, count(*) AS n_processed, count(DISTINCT item_id) AS n_items FROM vectors GROUP BY namespace",
    "index_stats": f"WITH {IDX} SELECT count(*) AS n_vectors, count(DISTINCT namespace) AS n_namespaces FROM idx",
    "dim_groups": f"WITH {IDX} SELECT namespace, CAST(len(vector) AS INTEGER) AS dim, count(*) AS n FROM idx GROUP BY ALL",
    "remove": f"WITH {IDX} SELECT namespace, item_id, seq FROM idx ANTI JOIN knn_probes USING (namespace, item_id)",
    "remove_count": f"WITH {IDX} SELECT count(*) AS n_removed FROM idx SEMI JOIN knn_probes USING (namespace, item_id)",
    "purge": f"WITH {IDX} SELECT namespace, item_id, seq FROM idx WHERE namespace <> 'default'",
    "purge_count": f"WITH {IDX} SELECT count(*) AS n_removed FROM idx WHERE namespace = 'default'",
    "namespace_count": f"WITH {IDX} SELECT n.namespace, count(idx.seq) AS n FROM (VALUES ('default'), ('docs:handbook'), (''), ('no such namespace')) AS n(namespace) LEFT JOIN idx ON idx.namespace = n.namespace GROUP BY ALL",
    "oplog_fold": f"""WITH {OPS}, k AS (SELECT u.*, greatest(coalesce((SELECT max(op_seq) FROM ops r WHERE r.op = 'remove' AND r.namespace = u.namespace AND r.item_id = u.item_id), -1), coalesce((SELECT max(op_seq) FROM ops p WHERE p.op = 'purge' AND p.namespace = u.namespace), -1)) AS killed FROM ops u WHERE op = 'upsert')
SELECT namespace, item_id, min(op_seq) AS seq, round(CAST(arg_max(CAST(value AS FLOAT), op_seq) AS DOUBLE), 3) AS value FROM k WHERE op_seq > killed GROUP BY namespace, item_id""",
    # for each remove and purge the keys that it names and that are live just before it
    "oplog_removed": f"""WITH {OPS}, d AS (SELECT op_seq, namespace, CASE op WHEN 'remove' THEN item_id END AS item_id FROM ops WHERE op <> 'upsert'),
 last AS (SELECT d.op_seq, o.item_id, arg_max(o.op, o.op_seq) AS op, max(o.op_seq) AS at FROM d JOIN ops o ON o.namespace = d.namespace AND o.op_seq < d.op_seq AND o.op <> 'purge' AND (d.item_id IS NULL OR d.item_id = o.item_id) GROUP BY ALL),
 wiped AS (SELECT d.op_seq, max(o.op_seq) AS at FROM d JOIN ops o ON o.op = 'purge' AND o.namespace = d.namespace AND o.op_seq < d.op_seq GROUP BY d.op_seq)
SELECT d.op_seq, count(*) FILTER (WHERE l.op = 'upsert' AND l.at > coalesce(w.at, -1)) AS n_removed FROM d LEFT JOIN last l USING (op_seq) LEFT JOIN wiped w USING (op_seq) GROUP BY d.op_seq""",
    "l2_guard": _components("CASE WHEN nn > 1e-9 THEN v[j + 1] / nn ELSE v[j + 1] END", "seq", "(SELECT seq, vector::DOUBLE[] AS v, sqrt(list_inner_product(vector::DOUBLE[], vector::DOUBLE[])) AS nn FROM vectors WHERE len(vector) > 0)", "len(v)"),
    "l2_clip": _components("v[j + 1] / greatest(nn, 1e-9::DOUBLE)", "seq", "(SELECT seq, vector::DOUBLE[] AS v, sqrt(list_inner_product(vector::DOUBLE[], vector::DOUBLE[])) AS nn FROM vectors WHERE len(vector) > 0)", "len(v)"),
    "pool_mean": f"WITH {TOKENS} " + _components("list_sum(list_transform(range(n), lambda i: CAST(e[i * 8 + j + 1] AS DOUBLE))) / n", "vec_id", "t", "8"),
    "pool_cls": f"WITH {TOKENS} " + _components("CAST(e[j + 1] AS DOUBLE)", "vec_id", "t", "8"),
    "pool_last": f"WITH {TOKENS} " + _components("CAST(e[(n - 1) * 8 + j + 1] AS DOUBLE)", "vec_id", "t", "8"),
    "padding_invariance": f"""WITH {TOKENS}, p AS (SELECT vec_id, j, list_sum(list_transform(range(n), lambda i: CAST(e[i * 8 + j + 1] AS DOUBLE))) / n AS x FROM (SELECT *, unnest(range(8)) AS j FROM t))
SELECT vec_id, true AS same, round(sqrt(sum(x * x)), 5) AS norm FROM p GROUP BY vec_id""",
    "truncate": f"SELECT doc_id, ({_IDS})[1:512] AS input_ids FROM documents WHERE text IS NOT NULL",
    "pad_longest": f"""WITH i AS (SELECT doc_id, namespace, ({_IDS})[1:512] AS ids FROM documents WHERE text IS NOT NULL), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY namespace) AS n FROM i)
SELECT doc_id, list_resize(ids, n, 0::BIGINT) AS input_ids, list_transform(range(n), lambda x: CASE WHEN x < len(ids) THEN 1::BIGINT ELSE 0::BIGINT END) AS attention_mask, list_resize([]::BIGINT[], n, 0::BIGINT) AS token_type_ids FROM m""",
    "hash_embed": f"WITH {CELLS} SELECT doc_id, bucket, round(n / norm, 6) AS value FROM cells",
    "search_text": f"""WITH {CELLS}, v AS (SELECT c.*, d.namespace, d.source FROM cells c JOIN documents d USING (doc_id)),
 s AS (SELECT a.doc_id AS qid, b.doc_id, sum(CAST(a.n * b.n AS DOUBLE)) / (a.norm * b.norm) AS raw FROM v a JOIN v b ON a.namespace IS NOT DISTINCT FROM b.namespace AND a.bucket = b.bucket WHERE a.source = 'glossary' GROUP BY a.doc_id, b.doc_id, a.norm, b.norm),
 r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, doc_id) AS rank FROM s WHERE raw >= 0.3::DOUBLE)
SELECT qid, rank, CAST(doc_id AS VARCHAR) AS item_id, round(raw, 4) + 0::DOUBLE AS score FROM r WHERE rank <= 5""",
    "backfill": _backfill(""),
    "backfill_agent": _backfill("AND agent_id = 'lantern-desk'"),
    "backfill_expect_dim": _backfill("AND n = 512"),
    "backfill_malformed": f"WITH {ROWS} SELECT namespace, item_id, CAST(n AS INTEGER) AS n_bytes FROM c WHERE n = 0 OR n % 4 <> 0",
    "backfill_summary": f"""WITH {ROWS} SELECT count(*) AS n_rows, count(*) FILTER (WHERE n = 512) AS n_migrated, count(*) FILTER (WHERE n <> 512) AS n_skipped,
 count(DISTINCT (namespace, item_id)) FILTER (WHERE n = 512) AS n_vectors, count(DISTINCT namespace) FILTER (WHERE n = 512) AS n_namespaces FROM c WHERE n > 0 AND n % 4 = 0""",
    "blob_roundtrip": "SELECT seq, CAST(len(vector) * 4 AS INTEGER) AS n_bytes, true AS same FROM vectors",
    "request_validate": _validation(),
    "embed_validate": f"""WITH r AS (SELECT DISTINCT request_id, texts FROM embed_requests), v AS (SELECT request_id, coalesce(len(texts), 0) AS n FROM r)
SELECT CASE WHEN n = 0 OR n > 100 THEN 400 ELSE 200 END AS status, CASE WHEN n = 0 THEN {_text(rq.NO_TEXTS)} WHEN n > 100 THEN {_text(rq.TOO_MANY)} END AS error, count(DISTINCT request_id) AS n FROM v GROUP BY 1, 2""",
    "auth_decision": "SELECT case_id, CASE WHEN lower(split_part(h, ' ', 1)) = 'bearer' AND trim(substr(h, 8)) = 's3cret-token' THEN 200 ELSE 401 END AS status FROM (VALUES " + ", ".join(f"({i}, {_text(h)})" for i, h in enumerate(HEADERS)) + ") AS t(case_id, h)",
    "provider_catalog": """SELECT * FROM (VALUES ('api_openai', 1536, 'remote', 'guard'), ('onnx_miniml', 384, 'mean', 'clip'), ('onnx_jina_v5_nano', 768, 'last', 'clip'),
 ('onnx_bge_m3', 1024, 'cls', 'clip'), ('mlx_bge_m3', 1024, 'model', 'none'), ('hashing', 64, 'sum', 'clip')) AS t(provider, dims, pooling, normalise)""",
    "p6_found": "SELECT namespace FROM vectors GROUP BY namespace HAVING count(*) > 0.02::DOUBLE * (SELECT count(*) FROM vectors)",
    "p6_profile": f"""WITH {LIVE}, g AS (SELECT namespace, dim, CAST(sum(versions) AS BIGINT) AS n_rows, count(*) AS n_live, count(*) FILTER (WHERE ok) AS n_usable, max(seq) AS last_seq, arg_max(item_id, seq) AS last_item_id FROM l GROUP BY ALL),
 n AS (SELECT namespace, dim, round(sqrt(sum(mean * mean)), 6) AS mean_norm, round(max(mean) FILTER (WHERE pos = 0), 6) + 0::DOUBLE AS mean_0 FROM m GROUP BY ALL)
SELECT g.namespace, g.dim, n_rows, n_live, n_usable, mean_norm, mean_0, last_seq, last_item_id FROM g LEFT JOIN n ON g.namespace = n.namespace AND g.dim = n.dim""",
    "p6_means": f"WITH {LIVE} SELECT namespace, dim, pos, round(mean, 6) + 0::DOUBLE AS value FROM m",
    "window_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
