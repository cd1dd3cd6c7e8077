"""DuckDB oracle SQL for the registered queries (independent re-statement).

Tables ``documents conversations embeddings pages benchmark labels`` are
views.  DuckDB's RE2 has no Alphabetic property, so runs use ``[\\p{L}\\p{N}]``;
the two agree on the test tables (no combining vowel signs occur).
"""

from __future__ import annotations

# RE2 token pattern, Unicode White_Space set, section tags.
P_TOKEN = r"(?s)</?[\p{L}\p{N}_-]*>|[\p{L}\p{N}]+|."
WS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
EXPORT_FIRST = r"^[\p{L}\p{N}!#$%&'()*+,\-./:;<=>?@\[\]^_`{|}~]"

R, MIN_OCC, SUBSAMPLE, C, PERIOD, TOP_N, SEED, LAST_N = 3, 2, 1e-3, 16, 5000, 10, 42, 3


def toks(expr: str, keep_ws: bool = False, lower: bool = False, strip: bool = False) -> str:
    e = expr
    if lower:
        e = f"lower({e})"
    if strip:
        e = f"regexp_replace({e}, '[[:punct:]]', '', 'g')"
    base = f"regexp_extract_all(coalesce({e}, ''), '{P_TOKEN}')"
    if keep_ws:
        return base
    return f"list_filter({base}, lambda x: NOT regexp_full_match(x, '{WS}'))"


def doc_toks(i: str, c: str, o: str, **kw) -> str:
    return (f"(['<input>'] || {toks(i, **kw)} || ['</input>', '<context>'] || {toks(c, **kw)} || "
            f"['</context>', '<output>'] || {toks(o, **kw)} || ['</output>'])")


CORPUS = "corpus AS (SELECT doc_id, '' AS input, source AS context, text AS output FROM documents)"


def occ_cte(name="occ", src="corpus", **kw) -> str:
    return (f"{name}_t AS (SELECT doc_id, {doc_toks('input', 'context', 'output', **kw)} AS toks FROM {src}), "
            f"{name} AS (SELECT doc_id, unnest(range(len(toks))) AS pos, unnest(toks) AS token FROM {name}_t)")


def vocab_cte(occ="occ", name="vocab") -> str:
    return (f"{name}_c AS (SELECT token, count(*) AS occurrences, min(doc_id * 2147483648 + pos) AS first_seen "
            f"FROM {occ} GROUP BY token), "
            f"{name} AS (SELECT row_number() OVER (ORDER BY first_seen) AS token_id, token, occurrences, "
            f"occurrences::DOUBLE / (sum(occurrences) OVER ())::DOUBLE AS frequency, first_seen FROM {name}_c)")


BASE = f"WITH {CORPUS}, {occ_cte()}, {vocab_cte()}"

CHAT = ("msgs AS (SELECT conv_id AS chat_id, turn, 'corpus' AS server, 'chat' || conv_id::VARCHAR AS channel, "
        "NULL::VARCHAR AS topic, role AS author, text AS content FROM conversations)")
HEADER = ("'<server>' || coalesce(server, '') || '</server><channel>#' || coalesce(channel, '') || "
          "'</channel><topic>' || coalesce(topic, '') || '</topic>'")
MERGED = ("merged AS (SELECT chat_id, '' AS input, " + HEADER + " AS context, "
          "string_agg('<message>@' || coalesce(author, '') || ': ' || coalesce(content, '') || '</message>', '' "
          "ORDER BY turn) AS output FROM msgs GROUP BY chat_id, server, channel, topic)")


def uniform(*parts: str) -> str:
    cat = " || '|' || ".join(parts)
    return f"(('0x' || substr(md5({cat}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


# id arrays per document (encoded corpus)
ARRAYS = ("enc AS (SELECT o.doc_id, o.pos, v.token_id, v.occurrences, v.frequency FROM occ o JOIN vocab v USING (token)), "
          "arr AS (SELECT doc_id, list(token_id ORDER BY pos) AS ids FROM enc GROUP BY doc_id)")
WINDOWS = ("win AS (SELECT e.doc_id, e.pos, e.token_id AS target_id, a.ids, len(a.ids) AS n FROM enc e "
           f"JOIN arr a USING (doc_id) WHERE e.pos >= {R} AND e.pos < len(a.ids) - {R})")


def _ids_text(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: x::VARCHAR), ' ')"


def _multi_hot(expr: str) -> str:
    return _ids_text(f"list_sort(list_distinct({expr}))")


def _ctx(r: str) -> str:
    # ids is 1-based in DuckDB; target index pos (0-based) is element pos+1
    return f"list_concat(ids[pos + 1 - {r}:pos], ids[pos + 2:pos + 1 + {r}])"


KEEP = (f"least(greatest(sqrt(frequency / {SUBSAMPLE} + 1.0) * ({SUBSAMPLE} / frequency), 0.0), 1.0)")
_U_SAMPLE = uniform(f"'{SEED}'", "'0'", "w.doc_id::VARCHAR", "w.pos::VARCHAR")
SAMPLED = (f"sampled AS (SELECT w.doc_id, w.pos, w.target_id FROM win w JOIN enc e ON e.doc_id = w.doc_id AND e.pos = w.pos "
           f"WHERE e.occurrences >= {MIN_OCC} AND {_U_SAMPLE} < "
           f"least(greatest(sqrt(e.frequency / {SUBSAMPLE} + 1.0) * ({SUBSAMPLE} / e.frequency), 0.0), 1.0))")

TOKEN_VECTORS = ("tv AS (SELECT v.token_id, v.token, e.embedding FROM vocab v JOIN embeddings e "
                 f"ON e.vec_id = v.token_id % (SELECT count(*) FROM embeddings) "
                 f"WHERE v.occurrences >= {MIN_OCC})")

CENTROIDS = ("ex AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS k "
             "FROM embeddings), cen AS (SELECT label, k, avg(x) AS x FROM ex GROUP BY label, k)")

BENCH_OCC = ("bdocs AS (SELECT item_id AS doc_id, '' AS input, '' AS context, text AS output FROM benchmark), "
             + occ_cte("bocc", "bdocs"))

PROMPTS = ("prompts AS (SELECT conv_id, turn, trim(text) AS input FROM conversations WHERE role = 'user'), "
           "ptok AS (SELECT conv_id, turn, list_filter(" + doc_toks("input", "''", "''") +
           ", lambda t: t <> '</output>') AS toks FROM prompts), "
           "pocc AS (SELECT conv_id, turn, unnest(range(len(toks))) AS pos, unnest(toks) AS token FROM ptok)")


def _position_part() -> str:
    """By position: the plain and the weighted sum of its window's position encodings (weights 1..C*64)."""
    return ("pe AS (SELECT p, sum(CASE WHEN p = 0 THEN 0.0 ELSE sin(2 * pi() * p / " f"{PERIOD}.0 / k) END) AS s, "
            f"sum(CASE WHEN p = 0 THEN 0.0 ELSE k * sin(2 * pi() * p / {PERIOD}.0 / k) END) AS t "
            f"FROM range(0, (SELECT max(pos) FROM enc) + {C} + 1) r(p), range(1, 65) q(k) GROUP BY p), "
            f"slots AS (SELECT i AS pos, j, CASE WHEN j < {C} - i THEN j ELSE i + j - greatest({C} - i, 0) END AS p "
            f"FROM range(0, (SELECT max(pos) FROM enc) + 1) r(i), range(0, {C}) q(j)), "
            "pp AS (SELECT pos, sum(s) AS ps, sum(64 * j * s + t) AS pt FROM slots JOIN pe USING (p) GROUP BY pos)")


SQL = {
    "documents_from_text": "SELECT doc_id, '' AS input, '' AS context, text AS output FROM documents",
    "documents_lowercase": "SELECT doc_id, '' AS input, lower(source) AS context, lower(text) AS output FROM documents",
    "document_lookup": f"WITH {CORPUS} SELECT l.doc_id, c.input, c.context, c.output FROM labels l LEFT JOIN corpus c USING (doc_id)",
    "document_count": "SELECT count(*) AS n_documents FROM documents",
    "documents_append": (f"WITH {CHAT}, {MERGED} SELECT (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY chat_id) "
                         "AS doc_id, input, context, output FROM merged"),
    "chat_last_n": (f"WITH {CHAT} SELECT chat_id, turn, author, content FROM (SELECT *, row_number() OVER "
                    f"(PARTITION BY chat_id ORDER BY turn DESC) AS rn FROM msgs) WHERE rn <= {LAST_N}"),
    "chat_split": (f"WITH {CHAT} SELECT chat_id, turn, coalesce(lag(content) OVER (PARTITION BY chat_id ORDER BY turn), '') AS input, "
                   f"{HEADER} || '<author>@' || coalesce(author, '') || '</author>' AS context, coalesce(content, '') AS output FROM msgs"),
    "chat_merge": f"WITH {CHAT}, {MERGED} SELECT chat_id, input, context, output FROM merged",
    "normalize_text": "SELECT doc_id, regexp_replace(lower(text), '[[:punct:]]', '', 'g') AS text FROM documents",
    "tokenize_text": (f"WITH t AS (SELECT doc_id, {toks('text')} AS toks FROM documents) "
                      "SELECT doc_id, unnest(range(len(toks))) AS pos, unnest(toks) AS token FROM t"),
    "tokenize_keep_ws": (f"WITH t AS (SELECT page_id AS doc_id, {toks('html', keep_ws=True)} AS toks FROM pages) "
                         "SELECT doc_id, unnest(range(len(toks))) AS pos, unnest(toks) AS token FROM t"),
    "tokenize_document": f"WITH {CORPUS}, {occ_cte(lower=True, strip=True)} SELECT doc_id, pos, token FROM occ",
    "vocabulary_counts": f"{BASE} SELECT token, occurrences, frequency FROM vocab",
    "vocabulary_ids": f"{BASE} SELECT token_id, token, occurrences, frequency FROM vocab",
    "distinct_tokens": f"WITH {CORPUS}, {occ_cte()} SELECT count(DISTINCT token) AS n_distinct FROM occ",
    "encode_documents": f"{BASE} SELECT o.doc_id, o.pos, v.token_id FROM occ o JOIN vocab v USING (token)",
    "decode_ids": f"{BASE} SELECT v.token_id, o.doc_id, o.pos, v.token FROM occ o JOIN vocab v USING (token)",
    "keep_probability": f"{BASE} SELECT token, frequency, {KEEP} AS keep_probability FROM vocab",
}

# detokenize: the inverse of the framed token list, section by section
_DT_T = f"dt AS (SELECT doc_id, {doc_toks('input', 'context', 'output', keep_ws=True)} AS t0 FROM pdocs)"
SQL["detokenize"] = (
    "WITH pdocs AS (SELECT page_id AS doc_id, url AS input, '' AS context, html AS output FROM pages), " + _DT_T + ", "
    "s1 AS (SELECT doc_id, t0, list_position(t0, '</input>') AS c1 FROM dt), "
    "s1b AS (SELECT doc_id, t0[1] = '<input>' AND c1 > 1 AS ok1, array_to_string(t0[2:c1 - 1], '') AS i_txt, "
    "t0[c1 + 1:] AS t1 FROM s1), "
    "s2 AS (SELECT *, list_position(t1, '</context>') AS c2 FROM s1b), "
    "s2b AS (SELECT doc_id, ok1, i_txt, coalesce(t1[1] = '<context>' AND c2 > 1, false) AS ok2, "
    "array_to_string(t1[2:c2 - 1], '') AS c_txt, t1[c2 + 1:] AS t2 FROM s2), "
    "s3 AS (SELECT *, list_position(t2, '</output>') AS c3 FROM s2b) "
    "SELECT doc_id, CASE WHEN ok1 AND ok2 AND coalesce(t2[1] = '<output>' AND c3 > 1, false) THEN i_txt END AS input, "
    "CASE WHEN ok1 AND ok2 AND coalesce(t2[1] = '<output>' AND c3 > 1, false) THEN c_txt END AS context, "
    "CASE WHEN ok1 AND ok2 AND coalesce(t2[1] = '<output>' AND c3 > 1, false) THEN array_to_string(t2[2:c3 - 1], '') END AS output "
    "FROM s3")

SQL["vocabulary_merge"] = (
    f"{BASE}, {CHAT}, {MERGED}, mdocs AS (SELECT chat_id AS doc_id, input, context, output FROM merged), "
    f"{occ_cte('docc', 'mdocs')}, {vocab_cte('docc', 'dv')}, "
    "known AS (SELECT v.token_id, v.token, v.occurrences + coalesce(d.occurrences, 0) AS occurrences FROM vocab v "
    "LEFT JOIN dv d USING (token)), "
    "fresh AS (SELECT (SELECT max(token_id) FROM vocab) + row_number() OVER (ORDER BY d.first_seen) AS token_id, d.token, "
    "d.occurrences FROM dv d ANTI JOIN vocab v USING (token)), "
    "allv AS (SELECT * FROM known UNION ALL SELECT * FROM fresh) "
    "SELECT token_id, token, occurrences, occurrences::DOUBLE / (sum(occurrences) OVER ())::DOUBLE AS frequency FROM allv")

SQL["encode_extend"] = (
    f"{BASE}, {BENCH_OCC}, "
    "unk AS (SELECT token, min(doc_id * 2147483648 + pos) AS first_seen FROM bocc ANTI JOIN vocab USING (token) GROUP BY token), "
    "fresh AS (SELECT (SELECT max(token_id) FROM vocab) + row_number() OVER (ORDER BY first_seen) AS token_id, token, "
    "1::BIGINT AS occurrences FROM unk), "
    "allv AS (SELECT token_id, token, occurrences FROM vocab UNION ALL SELECT * FROM fresh) "
    "SELECT token_id, token, occurrences, occurrences::DOUBLE / (sum(occurrences) OVER ())::DOUBLE AS frequency FROM allv")

SQL["attach_embeddings"] = (
    f"{BASE}, {TOKEN_VECTORS}, {BENCH_OCC} "
    "SELECT b.doc_id AS item_id, b.pos, b.token, tv.embedding IS NOT NULL AS has_vector, "
    "round(list_sum(list_transform(tv.embedding, lambda x: x::DOUBLE)), 6) AS vector_sum, "
    "round(list_sum(list_transform(tv.embedding, lambda x, i: x::DOUBLE * i)), 4) AS vector_weighted "
    "FROM bocc b LEFT JOIN tv USING (token)")

SQL["prompt_tokens"] = f"WITH {PROMPTS} SELECT conv_id, turn, pos, token FROM pocc"
SQL["prompt_index"] = (
    f"{BASE}, {TOKEN_VECTORS}, {PROMPTS} "
    "SELECT p.conv_id, p.turn, count(*) AS n_tokens, sum(CASE WHEN tv.token IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_missing, "
    "sum(CASE WHEN tv.token IS NULL THEN 1 ELSE 0 END) = 0 AS accepted FROM pocc p LEFT JOIN tv USING (token) "
    "GROUP BY p.conv_id, p.turn")

SQL["context_windows"] = (f"{BASE}, {ARRAYS}, {WINDOWS} SELECT doc_id, pos, target_id, {_ids_text(_ctx(str(R)))} AS context FROM win")
_U_RADIUS = uniform(f"'{SEED}'", "'0'", "'radius'", "doc_id::VARCHAR", "pos::VARCHAR")
_DYN_R = f"(floor({_U_RADIUS} * {R}) + 1)::BIGINT"
SQL["context_windows_dynamic"] = (f"{BASE}, {ARRAYS}, {WINDOWS}, dw AS (SELECT *, {_DYN_R} AS r FROM win) "
                                  f"SELECT doc_id, pos, target_id, {_ids_text(_ctx('r'))} AS context FROM dw")
SQL["cbow_pairs"] = (f"{BASE}, {ARRAYS}, {WINDOWS} SELECT doc_id, pos, {_multi_hot(_ctx(str(R)))} AS inputs, "
                     f"{_multi_hot('[target_id]')} AS outputs FROM win")
SQL["skipgram_pairs"] = (f"{BASE}, {ARRAYS}, {WINDOWS} SELECT doc_id, pos, {_multi_hot('[target_id]')} AS inputs, "
                         f"{_multi_hot(_ctx(str(R)))} AS outputs FROM win")
SQL["multi_hot"] = (f"{BASE}, {ARRAYS} SELECT doc_id, len(list_distinct(ids))::BIGINT AS n_indices, "
                    f"{_multi_hot('ids')} AS indices FROM arr")
SQL["sample_targets"] = f"{BASE}, {ARRAYS}, {WINDOWS}, {SAMPLED} SELECT doc_id, pos, target_id FROM sampled"
SQL["train_validation_split"] = (
    f"{BASE}, {ARRAYS}, {WINDOWS}, {SAMPLED}, "
    "ranked AS (SELECT *, row_number() OVER (ORDER BY "
    + uniform(f"'{SEED}'", "'validation'", "doc_id::VARCHAR", "pos::VARCHAR") + ", doc_id, pos) AS rk FROM sampled) "
    f"SELECT doc_id, pos, target_id, rk <= least(floor((SELECT count(*) FROM sampled) * 0.15), 10000) AS validation FROM ranked")
SQL["causal_windows"] = (
    f"{BASE}, {ARRAYS} SELECT e.doc_id, e.pos, e.token_id AS target_id, "
    f"{_ids_text(f'list_concat(list_transform(range(greatest({C} - e.pos, 0)), lambda z: 0::BIGINT), a.ids[greatest(e.pos - {C} + 1, 1):e.pos])')} AS context "
    "FROM enc e JOIN arr a USING (doc_id)")

# a window is the C rows before a token; slot C - o holds the token o places back
_LAGS = " + ".join(f"coalesce(lag(s, {o}) OVER w, 0.0)" for o in range(1, C + 1))
_WLAGS = " + ".join(f"coalesce({64 * (C - o)} * lag(s, {o}) OVER w + lag(t, {o}) OVER w, 0.0)" for o in range(1, C + 1))
SQL["next_token_features"] = (
    f"{BASE}, {ARRAYS}, {TOKEN_VECTORS}, {_position_part()}, "
    "tvs AS (SELECT token_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS s, "
    "list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)) AS t FROM tv), "
    "vals AS (SELECT e.doc_id, e.pos, e.token_id AS target_id, s, t FROM enc e LEFT JOIN tvs USING (token_id)), "
    f"agg AS (SELECT *, {_LAGS} AS fs, {_WLAGS} AS ft, "
    f"coalesce(sum((s IS NULL)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {C} PRECEDING AND 1 PRECEDING), 0) AS missing "
    "FROM vals WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) "
    f"SELECT doc_id, pos, target_id, {C * 64}::BIGINT AS n_features, round(fs + ps, 6) AS feature_sum, "
    "round(ft + pt, 3) AS feature_weighted, round(s, 6) AS target_sum, round(t, 3) AS target_weighted "
    "FROM agg JOIN pp USING (pos) WHERE missing = 0 AND s IS NOT NULL")

SQL["cosine_pairs"] = (
    f"WITH {CENTROIDS}, d AS (SELECT ex.vec_id, ex.label, sum(ex.x * c.x) AS dotp, sum(ex.x * ex.x) AS na, sum(c.x * c.x) AS nb "
    "FROM ex JOIN cen c ON c.label = ex.label AND c.k = ex.k GROUP BY ex.vec_id, ex.label) "
    "SELECT vec_id, label, round(dotp / nullif(sqrt(na) * sqrt(nb), 0), 6) AS cosine FROM d")
SQL["squared_error"] = (
    f"WITH {CENTROIDS} SELECT ex.label, round(sum((ex.x - c.x) * (ex.x - c.x)), 6) AS sse FROM ex "
    "JOIN cen c ON c.label = ex.label AND c.k = ex.k GROUP BY ex.label")
SQL["similar_topn"] = (
    f"WITH {CENTROIDS}, nrm AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM ex GROUP BY vec_id), "
    "d AS (SELECT a.vec_id AS q, b.vec_id AS t, sum(a.x * b.x) AS dotp FROM ex a JOIN ex b ON a.k = b.k GROUP BY a.vec_id, b.vec_id), "
    "s AS (SELECT d.q::VARCHAR AS query, d.t::VARCHAR AS token, d.dotp / nullif(na.n * nb.n, 0) AS sim FROM d "
    "JOIN nrm na ON na.vec_id = d.q JOIN nrm nb ON nb.vec_id = d.t), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC NULLS LAST, token) AS rk FROM s) "
    f"SELECT query, token, round(sim, 6) AS similarity, rk AS rank FROM r WHERE rk <= {TOP_N}")
SQL["nearest_token"] = (
    f"WITH {CENTROIDS}, nrm AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM ex GROUP BY vec_id), "
    "cn AS (SELECT label, sqrt(sum(x * x)) AS n FROM cen GROUP BY label), "
    "d AS (SELECT c.label, e.vec_id, sum(c.x * e.x) AS dotp FROM cen c JOIN ex e ON c.k = e.k GROUP BY c.label, e.vec_id), "
    "s AS (SELECT d.label::VARCHAR AS query, d.vec_id::VARCHAR AS token, d.dotp / nullif(cn.n * nrm.n, 0) AS sim FROM d "
    "JOIN cn USING (label) JOIN nrm USING (vec_id)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC NULLS LAST, token) AS rk FROM s) "
    "SELECT query, token, round(sim, 6) AS similarity FROM r WHERE rk = 1")
SQL["position_encoding"] = (
    f"WITH {CENTROIDS} SELECT vec_id, k::BIGINT AS k, round(CASE WHEN vec_id = 0 THEN x ELSE "
    f"x + sin(2 * pi() * vec_id / {PERIOD}.0 / k) END, 6) AS value FROM ex")
SQL["embedding_upsert"] = (
    f"WITH {CENTROIDS}, upd AS (SELECT label::VARCHAR AS token, count(*) AS n, sum(x::FLOAT::DOUBLE) AS s, sum(x::FLOAT::DOUBLE * k) AS t FROM cen GROUP BY label), "
    "st AS (SELECT vec_id::VARCHAR AS token, len(embedding) AS n, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS s, "
    "list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)) AS t FROM embeddings) "
    "SELECT token, n::BIGINT AS n, round(s, 6) AS vector_sum, round(t, 4) AS vector_weighted FROM (SELECT * FROM st ANTI JOIN upd USING (token) "
    "UNION ALL SELECT * FROM upd)")
SQL["embedding_export_rows"] = (
    f"{BASE}, {TOKEN_VECTORS} SELECT token, "
    + ", ".join(f"embedding[{i}]::DOUBLE AS embedding{i}" for i in range(1, 65))
    + " FROM tv WHERE regexp_matches(token, '" + EXPORT_FIRST.replace("'", "''") + "')")


# dynamic contexts of the sampled targets; every distinct context token meets the target (CBOW)
_DIMS = 16
_PAIRS = ("dyn AS (SELECT w.*, " + _DYN_R.replace("doc_id", "w.doc_id").replace("pos::", "w.pos::") + " AS r FROM win w "
          "JOIN sampled s ON s.doc_id = w.doc_id AND s.pos = w.pos), "
          f"pairs AS (SELECT unnest(list_distinct({_ctx('r')})) AS token_id, target_id AS other FROM dyn), "
          f"signed AS (SELECT token_id, md5('{SEED}|sign|0|' || other::VARCHAR) AS digits FROM pairs)")
_SKETCH = ("sketch AS (SELECT token_id, count(*) AS n_pairs, "
           + ", ".join(f"sum(CASE WHEN digits[{k}] >= '8' THEN 1 ELSE -1 END)::BIGINT AS d{k}" for k in range(1, _DIMS + 1))
           + " FROM signed GROUP BY token_id)")
_D = ", ".join(f"d{k}" for k in range(1, _DIMS + 1))
SQL["fit_cooccurrence"] = f"{BASE}, {ARRAYS}, {WINDOWS}, {SAMPLED}, {_PAIRS}, {_SKETCH} SELECT token_id, n_pairs, {_D} FROM sketch"

_GRAMS = ("SELECT token_id, token, unnest(list_distinct(list_transform(range(1, greatest(length(token) + 1, 2)), "
          "lambda i: substr(chr(2) || token || chr(3), i, 3)))) AS gram")
_SUM_D = ", ".join(f"sum(d{k})::BIGINT AS d{k}" for k in range(1, _DIMS + 1))
_OWN = ", ".join(f"CASE WHEN md5('{SEED}|sign|0|' || token_id::VARCHAR)[{k}] >= '8' THEN 1 ELSE -1 END::BIGINT AS d{k}" for k in range(1, _DIMS + 1))
SQL["embed_all_tokens"] = (
    f"{BASE}, {ARRAYS}, {WINDOWS}, {SAMPLED}, {_PAIRS}, {_SKETCH}, "
    f"lg AS (SELECT g.gram, {_SUM_D} FROM ({_GRAMS} FROM vocab) g JOIN sketch USING (token_id) GROUP BY g.gram), "
    f"ug AS ({_GRAMS} FROM vocab ANTI JOIN sketch USING (token_id)), "
    f"comp AS (SELECT token_id, token, {_SUM_D} FROM ug JOIN lg USING (gram) GROUP BY token_id, token), "
    f"every AS (SELECT v.token_id, v.token, 'learned' AS source, {_D} FROM vocab v JOIN sketch USING (token_id) "
    f"UNION ALL SELECT token_id, token, 'composed', {_D} FROM comp "
    f"UNION ALL SELECT token_id, token, 'hashed', {_OWN} FROM (SELECT DISTINCT token_id, token FROM ug) ANTI JOIN comp USING (token_id)) "
    f"SELECT *, CASE WHEN {' AND '.join(f'd{k} = 0' for k in range(1, _DIMS + 1))} THEN NULL ELSE 1.0::DOUBLE END AS squared_length FROM every")

# samples of two context tokens with vectors of four elements: x1..x8 (older slot first), a one, y1..y4
_SC, _SD = 2, 4


def _pe(p: str, k: int) -> str:
    return f"CASE WHEN {p} = 0 THEN 0.0 ELSE sin(2 * pi() * ({p}) / {PERIOD}.0 / {k}) END"


def _slot(j: int, k: int) -> str:
    back, pad = _SC - j, f"pos < {_SC - j}"
    place = f"CASE WHEN {pad} THEN {j} ELSE pos + {j} - greatest({_SC} - pos, 0) END"
    return f"coalesce(lag(e{k}, {back}) OVER w, 0.0) + {_pe(place, k)}"


_XS = [f"x{i}" for i in range(_SC * _SD)] + ["1.0"] + [f"e{k}" for k in range(1, _SD + 1)]
_SHORT = (f"{BASE}, {ARRAYS}, {TOKEN_VECTORS}, vals AS (SELECT e.doc_id, e.pos, "
          + ", ".join(f"tv.embedding[{k}]::DOUBLE AS e{k}" for k in range(1, _SD + 1))
          + " FROM enc e LEFT JOIN tv USING (token_id)), xs AS (SELECT *, "
          + ", ".join(f"{_slot(j, k)} AS x{j * _SD + k - 1}" for j in range(_SC) for k in range(1, _SD + 1))
          + f", coalesce(sum((e1 IS NULL)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {_SC} PRECEDING AND 1 PRECEDING), 0) AS missing "
          "FROM vals WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), "
          "samples AS (SELECT * FROM xs WHERE missing = 0 AND e1 IS NOT NULL)")
_CELLS = [(i, j) for i in range(_SC * _SD + 1) for j in range(i, len(_XS))]
SQL["next_token_gram"] = (
    f"{_SHORT}, g AS (SELECT [" + ", ".join(f"sum({_XS[i]} * {_XS[j]})" for i, j in _CELLS) + "] AS v FROM samples), "
    f"cells AS (SELECT unnest([{', '.join(str(i) for i, _ in _CELLS)}])::BIGINT AS i, unnest([{', '.join(str(j) for _, j in _CELLS)}])::BIGINT AS j, "
    "unnest(v) AS value FROM g) SELECT i, j, round(value, 3) AS value FROM cells WHERE value IS NOT NULL")
SQL["validate_next_token_total"] = (
    f"{_SHORT} SELECT count(*) AS n_samples, round(sum("
    + " + ".join(f"(x{(_SC - 1) * _SD + k - 1} - e{k}) * (x{(_SC - 1) * _SD + k - 1} - e{k})" for k in range(1, _SD + 1)) + "), 3) AS loss FROM samples")

SQL["similar_topn_indexed"], SQL["nearest_token_indexed"] = SQL["similar_topn"], SQL["nearest_token"]
SQL["compare_by_token"] = (
    f"WITH found AS ({SQL['similar_topn']}), asked AS (SELECT DISTINCT doc_id::VARCHAR AS query FROM documents) "
    "SELECT a.query, f.query IS NOT NULL AS indexed, f.token, f.similarity, f.rank FROM asked a LEFT JOIN found f USING (query)")

SQL["chat_parse"] = (
    f"WITH {CHAT} SELECT chat_id, row_number() OVER (PARTITION BY chat_id ORDER BY turn) - 1 AS turn, server, channel, author, content, "
    "NULL::VARCHAR AS failure FROM msgs WHERE chat_id % 7 <> 0 "
    "UNION ALL SELECT DISTINCT chat_id, NULL, NULL, NULL, NULL, NULL, 'malformed' FROM msgs WHERE chat_id % 7 = 0")
SQL["documents_patch"] = "SELECT doc_id, coalesce(lang, '') AS input, coalesce(source, '') AS context, text AS output FROM documents"
SQL["shuffle_order"] = (f"{BASE}, {ARRAYS}, {WINDOWS}, {SAMPLED} SELECT doc_id, pos, target_id, "
                        + uniform(f"'{SEED}'", "'shuffle'", "doc_id::VARCHAR", "pos::VARCHAR") + " AS shuffle_key FROM sampled")
