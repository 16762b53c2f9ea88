"""The same queries in DuckDB's SQL. Those with seeded generators of Python have none."""

from __future__ import annotations

ROWS = """
    r AS (SELECT d.doc_id, d.doc_id::VARCHAR AS id, d.lang AS leaf_id, d.source AS model_slug, d.text,
                 CASE WHEN toxic = 1 THEN 'refusal' WHEN quality = 0 THEN 'flagged' WHEN quality = 1 THEN 'accepted' ELSE 'draft' END AS status,
                 CASE WHEN quality = 1 THEN 4.5 WHEN quality = 0 THEN 1.5 END::DOUBLE AS score,
                 list_filter([CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'low_quality' END], lambda f: f IS NOT NULL) AS flags
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""
NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g'))"
STOP = "['the','a','an','and','or','to','of','in','is','it','you','that','for','on','with','this','be','are','can','if']"
ENGLISH = f"""
    (length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) = 0 OR (
       length(regexp_replace(t, '[^A-Za-z]', '', 'g')) / length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) >= 0.85 AND
       len(list_distinct(list_intersect(regexp_extract_all(lower(t), '[a-zA-Z'']+'), {STOP}))) >= CASE WHEN len(regexp_extract_all(lower(t), '[a-zA-Z'']+')) >= 15 THEN 3 ELSE 1 END))
"""
OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
QUAD = f"\\b(?:{OCTET}\\.){{3}}{OCTET}\\b"
BETWEEN = f"string_split_regex(t, '{QUAD}')"
#: Quads that no version word stands at, in the 12 characters before or after.
QUADS = f"""
    list_transform(list_filter(list_zip(regexp_extract_all(t, '{QUAD}'), {BETWEEN}, {BETWEEN}[2:]), lambda z: z[1] IS NOT NULL
        AND NOT regexp_matches(right(z[2], 12), '(?i)(?:\\bv(?:ersion)?\\.?|\\brelease|\\bver\\.?|\\bbuild)\\s*$')
        AND NOT regexp_matches(left(z[3], 12), '(?i)^\\s*(?:release|build|beta|rc[0-9]*|stable|lts)\\b')), lambda z: z[1])
"""
HOST = """
    list_filter(%s, lambda q: list_transform([string_split(q, '.')], lambda o: 
        NOT (o[1]::INT IN (10, 127, 0) OR o[1]::INT >= 224 OR (o[1]::INT = 172 AND o[2]::INT BETWEEN 16 AND 31) OR (o[1]::INT = 192 AND o[2]::INT = 168)
             OR (o[1]::INT = 100 AND o[2]::INT BETWEEN 64 AND 127) OR (o[1]::INT = 169 AND o[2]::INT = 254)
             OR (o[1]::INT = 192 AND o[2]::INT = 0 AND o[3]::INT = 2) OR (o[1]::INT = 198 AND o[2]::INT = 51 AND o[3]::INT = 100) OR (o[1]::INT = 203 AND o[2]::INT = 0 AND o[3]::INT = 113)
             OR list_contains(o, '255') OR q IN ('8.8.8.8','8.8.4.4','1.1.1.1','1.0.0.1','9.9.9.9','149.112.112.112','208.67.222.222','208.67.220.220','4.2.2.2','4.2.2.1')))[1])
""" % QUADS
KINDS = f"""
    array_to_string(list_filter([
        CASE WHEN regexp_matches(t, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b') THEN 'email' END,
        CASE WHEN len({HOST}) > 0 THEN 'ip' END,
        CASE WHEN regexp_matches(t, '\\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?[0-9]{{2}} ?[0-9]{{2}} ?[0-9]{{2}} ?[A-D]\\b') THEN 'ni' END], lambda k: k IS NOT NULL), ', ')
"""
REFUSES = [
    "\\bI can(''|’)?t help with\\b", "\\bI cannot (help|assist)\\b", "\\bI can(''|’)?t (assist|provide|do that)\\b", "\\bI(''|’)?m not able to\\b", "\\bI am not able to\\b", "\\bI(''|’)?m unable to\\b",
    "\\bI am unable to\\b", "\\bas an AI\\b", "\\bI won(''|’)?t\\b", "\\bI must decline\\b", "\\bI(''|’)?m sorry, but I can",
]
SOLID = "regexp_matches(t, '(?m)`|^\\s*([0-9]+[.)]|[-*])\\s|\\$\\s?\\w|\\b\\w+\\s+/\\w|\\s--?\\w')"
#: Texts of the driver hold no refusal phrase: an answer refuses if it is empty or of one to three words without substance.
REFUSED = f"(t = '' OR (len(regexp_extract_all(t, '\\S+')) <= 3 AND NOT {SOLID} AND {{long}}) OR {' OR '.join(f'regexp_matches(t, {chr(39)}(?i){p}{chr(39)})' for p in REFUSES)})"


def removals(base: str, threshold: float, refused: str) -> str:
    """The cascade over texts ``b`` (doc_id, id, t) that ``base`` defines."""
    return f"""
    {base},
    h AS (SELECT *, first_value(id) OVER (PARTITION BY sha256({NORM.format("chr(10) || t")}) ORDER BY doc_id, id) AS first_id FROM b),
    nv AS (SELECT row_number() OVER (ORDER BY h.doc_id, h.id) AS n, h.id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM h JOIN embeddings ON vec_id = h.doc_id WHERE h.id = h.first_id),
    ne AS (SELECT y.n AS j, list(x.n ORDER BY x.n) AS before FROM nv x JOIN nv y ON x.n < y.n WHERE list_cosine_similarity(x.v, y.v) >= {threshold} GROUP BY y.n),
    nd AS (SELECT n, row_number() OVER (ORDER BY n) AS k FROM (SELECT j AS n FROM ne UNION SELECT unnest(before) FROM ne)),
    ns AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept, NULL::BIGINT AS n, NULL::BIGINT AS partner
           UNION ALL
           SELECT nd.k, CASE WHEN len(list_intersect(coalesce(ne.before, []), ns.kept)) > 0 THEN ns.kept ELSE list_append(ns.kept, nd.n) END, nd.n, list_min(list_intersect(coalesce(ne.before, []), ns.kept))
           FROM ns JOIN nd ON nd.k = ns.k + 1 LEFT JOIN ne ON ne.j = nd.n),
    nr AS (SELECT y.id, x.id AS partner_id, list_cosine_similarity(x.v, y.v) AS sim FROM ns JOIN nv x ON x.n = ns.partner JOIN nv y ON y.n = ns.n),
    m AS (SELECT id, CASE
            WHEN id <> first_id THEN 'exact_dup'
            WHEN partner_id IS NOT NULL THEN 'near_dup'
            WHEN {refused} THEN 'refusal'
            WHEN {KINDS} <> '' THEN 'pii'
            WHEN length(t) < 40 OR length(t) > 12000 THEN 'length'
            WHEN NOT {ENGLISH} THEN 'language' END AS rule,
          first_id, partner_id, sim, t FROM h LEFT JOIN nr USING (id)),
    removed AS (SELECT id, rule, CASE rule
            WHEN 'exact_dup' THEN 'identical to ' || first_id
            WHEN 'near_dup' THEN printf('cosine %.3f with %s', sim, partner_id)
            WHEN 'refusal' THEN 'assistant refused'
            WHEN 'pii' THEN 'contains ' || {KINDS}
            WHEN 'length' THEN length(t)::VARCHAR || CASE WHEN length(t) < 40 THEN ' chars, minimum 40' ELSE ' chars, maximum 12000' END
            WHEN 'language' THEN 'not English' END AS reason FROM m WHERE rule IS NOT NULL)
"""


REMOVED = removals("b AS (SELECT doc_id, doc_id::VARCHAR AS id, coalesce(text, '') AS t FROM documents)", 0.92, REFUSED.format(long="false"))
SAID = """
    c AS (SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id)
"""
TRIMMED = "CASE WHEN x.role = 'assistant' THEN regexp_replace(x.text, '\\s+$', '') ELSE x.text END"
MESSAGE = f"""'{{"role":"' || x.role || '","content":' || to_json({TRIMMED}) || '}}'"""
RUBRIC = {"Correctness": 40, "Actionability": 25, "Style adherence": 20, "Safety": 15}


def _score(base: int) -> str:
    return "(" + " + ".join(f"{w} * (o_orderkey % {base + 2 * i} % 5 + 1)" for i, w in enumerate(RUBRIC.values())) + ")"


CALLS = "k AS (SELECT event_id AS id, user_id AS project_id, event_type AS kind, value AS cost, epoch_us(ts) AS created_at FROM events)"

ORACLE_SQL = {
    "exact_dup": f"""
        WITH f AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256({NORM.format("text")}) ORDER BY doc_id) AS first_id FROM documents)
        SELECT doc_id, first_id, 'identical to ' || first_id AS reason FROM f WHERE doc_id <> first_id
    """,
    "pii_scan": f"SELECT doc_id, kinds FROM (SELECT doc_id, {KINDS} AS kinds FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)) WHERE kinds <> ''",
    "public_ip_list": f"SELECT doc_id, unnest({HOST}) AS ip FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "length_bounds": "SELECT doc_id, length(coalesce(text, ''))::BIGINT AS chars FROM documents WHERE length(coalesce(text, '')) NOT BETWEEN 40 AND 12000",
    "language_en": f"SELECT doc_id, lang FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents) WHERE NOT {ENGLISH}",
    "refusal_scan": f"SELECT doc_id FROM (SELECT doc_id, trim(coalesce(text, '')) AS t FROM documents) WHERE {REFUSED.format(long='true')}",
    "secret_scan": "SELECT count(*) FILTER (regexp_matches(coalesce(text, ''), 'sk-or-|hf_[A-Za-z0-9]{16,}')) AS with_secret, count(*) AS docs FROM documents",
    "filter_cascade": f"WITH RECURSIVE {REMOVED} SELECT id, rule, reason FROM removed",
    "filter_summary": f"WITH RECURSIVE {REMOVED} SELECT rule, count(id) AS removed FROM (SELECT unnest(['exact_dup','near_dup','refusal','pii','length','language']) AS rule) a LEFT JOIN removed USING (rule) GROUP BY rule",
    "filter_marked": f"""
        WITH RECURSIVE {REMOVED} SELECT CASE WHEN rule IS NULL THEN 'draft' WHEN rule = 'refusal' THEN 'refusal' ELSE 'filtered' END AS status,
            CASE WHEN rule IS NULL THEN '' ELSE 'draft' END AS prev_status, coalesce(rule, '') AS flags, count(*) AS n FROM b LEFT JOIN removed USING (id) GROUP BY ALL
    """,
    "filter_restored": f"WITH RECURSIVE {REMOVED} SELECT CASE WHEN rule IS NULL OR rule = 'length' THEN 'draft' WHEN rule = 'refusal' THEN 'refusal' ELSE 'filtered' END AS status, count(*) AS n FROM b LEFT JOIN removed USING (id) GROUP BY ALL",
    "near_dup": """
        WITH RECURSIVE u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
        e AS (SELECT a.id AS i, b.id AS j FROM u a JOIN u b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.35),
        o AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM u),
        near AS (SELECT j, list(i ORDER BY i) AS before FROM e GROUP BY j),
        s AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept, NULL::BIGINT AS id, NULL::BIGINT AS partner
              UNION ALL
              SELECT o.n, CASE WHEN len(list_intersect(coalesce(near.before, []), s.kept)) > 0 THEN s.kept ELSE list_append(s.kept, o.id) END, o.id, list_min(list_intersect(coalesce(near.before, []), s.kept))
              FROM s JOIN o ON o.n = s.n + 1 LEFT JOIN near ON near.j = o.id)
        SELECT id, partner AS partner_id FROM s WHERE partner IS NOT NULL
    """,
    "embedding_batches": """
        WITH m AS (SELECT d.doc_id, length(chr(10) || coalesce(text, '')) AS chars, row_number() OVER (ORDER BY d.doc_id) - 1 AS n FROM documents d WHERE d.doc_id NOT IN (SELECT vec_id FROM embeddings))
        SELECT (n // 64)::BIGINT AS batch, count(*) AS rows, sum(chars // 4)::BIGINT AS tokens FROM m GROUP BY 1
    """,
    "compact_vectors": "SELECT vec_id, len(v)::BIGINT AS dims, len(list_filter(v, lambda x: abs(x) > 0.10005))::BIGINT AS large FROM (SELECT vec_id, list_transform(embedding[1:16], lambda x: round(x::DOUBLE, 4)) AS v FROM embeddings)",
    "conversation_assemble": """
        SELECT conv_id, count(*) AS turns, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS user_text,
               coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS assistant_text, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS first_user
        FROM conversations GROUP BY conv_id
    """,
    "conversation_hash": f"""
        WITH c AS (SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), '') || chr(10) || coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS t FROM conversations GROUP BY conv_id)
        SELECT conv_id, sha256({NORM.format("t")}) AS sha FROM c
    """,
    "validate_structure": """
        WITH p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
        bad AS (SELECT conv_id, count(*) FILTER ((role = 'system' AND before IS NOT NULL) OR (role = 'user' AND before = 'user') OR (role = 'assistant' AND before IS DISTINCT FROM 'user') OR trim(text) = '') AS n, arg_max(role, turn) AS tail FROM p GROUP BY conv_id)
        SELECT conv_id, CASE WHEN n > 0 THEN 'order' WHEN tail <> 'assistant' THEN 'final turn must be assistant, got ' || tail ELSE '' END AS issues FROM bad
    """,
    "validate_edit": "SELECT conv_id, CASE WHEN arg_max(role, turn) <> 'assistant' THEN 1 ELSE 0 END::BIGINT AS issues FROM conversations GROUP BY conv_id",
    "format_alpaca": f"""
        WITH {SAID}, e AS (SELECT conv_id, m, m[1].role = 'system' AS led, CASE WHEN m[1].role = 'system' THEN m[2:] ELSE m END AS rest FROM c WHERE m[-1].role = 'assistant')
        SELECT conv_id, CASE WHEN led THEN 'System: ' || m[1].text || chr(10) || chr(10) ELSE '' END || rest[1].text AS instruction,
               coalesce(array_to_string(list_transform(rest[2:len(rest) - 1], lambda x: CASE x.role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'System' END || ': ' || {TRIMMED}), chr(10) || chr(10)), '') AS input,
               regexp_replace(m[-1].text, '\\s+$', '') AS output
        FROM e
    """,
    "format_sft": f"""WITH {SAID} SELECT conv_id::VARCHAR AS id, '{{"id":"' || conv_id || '","messages":[' || array_to_string(list_transform(m, lambda x: {MESSAGE}), ',') || ']}}' AS line FROM c""",
    "format_tools": f"""WITH {SAID} SELECT conv_id::VARCHAR AS id, '{{"id":"' || conv_id || '","messages":[' || array_to_string(list_transform(m, lambda x: {MESSAGE}), ',') || '],"tools":[]}}' AS line FROM c""",
    "format_grpo": f"""WITH {SAID} SELECT conv_id::VARCHAR AS id, '{{"id":"' || conv_id || '","prompt":[' || array_to_string(list_transform(m[1:len(m) - 1], lambda x: {MESSAGE}), ',') || '],"answer":' || to_json(trim(m[-1].text)) || '}}' AS line FROM c WHERE m[-1].role = 'assistant'""",
    "format_dpo": f"""
        WITH {SAID}, e AS (SELECT conv_id, m[1:len(m) - 1] AS prompt, list_filter(m, lambda x: x.role = 'assistant') AS own FROM c WHERE m[-1].role = 'assistant')
        SELECT conv_id::VARCHAR AS id, '{{"id":"' || conv_id || '","prompt":[' || array_to_string(list_transform(prompt, lambda x: '{{"role":"' || x.role || '","content":' || to_json(x.text) || '}}'), ',') || '],"chosen":['
               || list_transform([own[-1]], lambda x: {MESSAGE})[1] || '],"rejected":[' || list_transform([own[1]], lambda x: {MESSAGE})[1] || ']}}' AS line
        FROM e WHERE len(own) > 1
    """,
    "template_chatml": f"""
        WITH {SAID} SELECT conv_id, sha256(CASE WHEN m[1].role = 'system' THEN '' ELSE '<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) END
               || array_to_string(list_transform(m, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '')) AS rendered FROM c
    """,
    "template_llama": f"""
        WITH {SAID} SELECT conv_id, sha256('<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || CASE WHEN m[1].role = 'system' THEN trim(m[1].text) ELSE '' END || '<|eot_id|>'
               || array_to_string(list_transform(list_filter(m, lambda x: x.role <> 'system'), lambda x: '<|start_header_id|>' || x.role || '<|end_header_id|>' || chr(10) || chr(10) || trim(x.text) || '<|eot_id|>'), '')) AS rendered FROM c
    """,
    "template_gemma": f"""
        WITH {SAID}, f AS (SELECT conv_id, CASE WHEN m[1].role = 'system' AND m[2].role = 'user' THEN list_prepend(struct_pack(turn := m[2].turn, role := 'user', text := m[1].text || chr(10) || chr(10) || m[2].text), m[3:]) ELSE m END AS m FROM c)
        SELECT conv_id, sha256('<bos>' || array_to_string(list_transform(m, lambda x: '<start_of_turn>' || CASE x.role WHEN 'assistant' THEN 'model' ELSE x.role END || chr(10) || trim(x.text) || '<end_of_turn>' || chr(10)), '')) AS rendered,
               len(list_filter(list_transform(m, lambda x, i: (x.role = 'user') <> (i % 2 = 1)), lambda y: y)) = 0 AS fine FROM f
    """,
    "transcripts": f"WITH {SAID} SELECT conv_id, array_to_string(list_transform(list_filter(m, lambda x: x.role <> 'system'), lambda x: '**' || x.role || ':** ' || x.text), chr(10) || chr(10)) AS shown FROM c",
    "conversation_shares": f"WITH {SAID} SELECT count(*) AS rows, count(*) FILTER (len(list_filter(m, lambda x: x.role = 'assistant')) > 1) AS multi_turn, count(*) FILTER (len(list_filter(m, lambda x: x.role = 'assistant')) > 1) / count(*) AS multi_share FROM c",
    "rows_page": f"WITH {ROWS} SELECT id, status, score FROM r ORDER BY score DESC NULLS LAST, id LIMIT 50 OFFSET 100",
    "rows_search": f"WITH {ROWS} SELECT id, status FROM r WHERE status IN ('draft', 'accepted') AND (text ILIKE '%license%' OR id ILIKE '%license%')",
    "rows_flagged": f"WITH {ROWS} SELECT id, score FROM r WHERE list_contains(flags, 'low_quality') AND score <= 3.0",
    "status_counts": f"WITH {ROWS} SELECT status, count(*) AS n FROM r GROUP BY status",
    "flag_counts": f"WITH {ROWS} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM r) GROUP BY flag",
    "leaf_counts": "SELECT lang AS leaf_id, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, leaf_id",
    "refusal_rollups": f"WITH {ROWS} SELECT 'model' AS kind, coalesce(model_slug, 'unknown') AS key, count(*) AS n FROM r WHERE status = 'refusal' GROUP BY 2 UNION ALL SELECT 'leaf', coalesce(leaf_id, 'unknown'), count(*) FROM r WHERE status = 'refusal' GROUP BY 2",
    "refusal_matrix": f"WITH {ROWS} SELECT model_slug, leaf_id, count(*) FILTER (status = 'refusal') AS refusals, count(*) AS total, count(*) FILTER (status = 'refusal') / count(*) AS rate FROM r GROUP BY ALL",
    "review_totals": f"WITH {ROWS} SELECT count(*) FILTER (status IN ('draft', 'accepted', 'edited')) AS exportable, count(*) FILTER (list_contains(flags, 'edited')) AS edited, count(*) FILTER (status = 'flagged') AS flagged FROM r",
    "export_gate": f"WITH {ROWS}, x AS (SELECT * FROM r WHERE status IN ('draft', 'accepted', 'edited')) SELECT count(*) FILTER (coalesce(score >= 3.0, true)) AS kept_on, count(*) AS kept_off, count(*) FILTER (score < 3.0) AS low FROM x",
    "breakdown": "SELECT 'leaf' AS kind, lang AS key, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'difficulty', source, count(*) FROM documents GROUP BY source",
    "removed_counts": f"WITH RECURSIVE {REMOVED} SELECT rule AS reason, count(*) AS removed FROM removed WHERE rule <> 'refusal' GROUP BY rule",
    "anti_join_pending": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "semi_join_partial": "SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) THEN 'partial' ELSE 'pending' END AS status, count(*) AS n FROM customer GROUP BY 1",
    "row_numbers": """
        WITH u AS (SELECT lang AS prefix, max(doc_id) AS top FROM documents WHERE doc_id % 10 <> 7 GROUP BY lang),
        n AS (SELECT d.lang AS prefix, d.doc_id AS k, row_number() OVER (PARTITION BY d.lang ORDER BY d.doc_id) + coalesce(top, 0) AS n FROM documents d LEFT JOIN u ON d.lang = u.prefix)
        SELECT prefix || '-' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS id, k FROM n
    """,
    "teacher_round_robin": "SELECT doc_id, ['a/one', 'b/two', 'c/three'][doc_id % 3 + 1] AS teacher FROM documents",
    "weighted_score": f"SELECT o_orderkey, {_score(5)} / 100 AS score FROM orders",
    "judge_summary": f"""
        WITH s AS (SELECT {_score(5)} / 100 AS score FROM orders), b AS (SELECT score, least(9, floor(score / 5.0 * 10))::INT AS bin FROM s)
        SELECT {", ".join(f"count(*) FILTER (bin = {k}) AS b{k}" for k in range(10))}, count(*) FILTER (score < 3.0) AS low_count, count(*) AS judged_rows, round(avg(score), 1) AS mean, median(score) AS median FROM b
    """,
    "pair_verdicts": f"""
        WITH p AS (SELECT o_orderkey, o_orderkey % 3 AS v, o_orderkey % 2 = 0 AS first, {_score(5)} AS a, {_score(6)} AS b FROM orders),
        q AS (SELECT *, CASE WHEN first THEN a ELSE b END AS c, CASE WHEN first THEN b ELSE a END AS r, CASE WHEN v = 2 THEN 'tie' WHEN (v = 0) = first THEN 'chosen' ELSE 'rejected' END AS said FROM p),
        t AS (SELECT *, said = 'tie' AND abs(c / 100 - r / 100) >= 0.25 AS broken FROM q)
        SELECT o_orderkey, CASE WHEN broken THEN CASE WHEN c > r THEN 'chosen' ELSE 'rejected' END ELSE said END AS verdict, CASE WHEN said = 'tie' AND NOT broken THEN 'tie' ELSE 'judged' END AS status,
               c / 100 AS score, r / 100 AS rejected_score, broken AS tie_broken_by_scores FROM t
    """,
    "budget_replay": f"""
        WITH {CALLS}, s AS (SELECT *, sum(greatest(cost, 0)) OVER w AS spend, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY project_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING))
        SELECT project_id, max(n) AS calls, min(n) FILTER (spend + 1e-9 >= 180) AS stopped_after, arg_min(id, n) FILTER (spend + 1e-9 >= 180) AS stopped_by FROM s GROUP BY project_id
    """,
    "early_abort": f"""
        WITH {CALLS}, s AS (SELECT project_id AS run_id, row_number() OVER w AS done, count(*) FILTER (kind IN ('click', 'view')) OVER w AS errors FROM k WINDOW w AS (PARTITION BY project_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING))
        SELECT run_id, min(done) AS aborted_at, arg_min(errors, done) AS errors FROM s WHERE done <= 20 AND errors >= 8 AND errors >= done * 0.6 GROUP BY run_id
    """,
    "cost_ema": f"""
        WITH RECURSIVE {CALLS}, o AS (SELECT project_id, cost, row_number() OVER (PARTITION BY project_id ORDER BY created_at, id) AS n FROM k WHERE cost IS NOT NULL),
        e AS (SELECT project_id, n, cost AS ema FROM o WHERE n = 1 UNION ALL SELECT o.project_id, o.n, 0.5 * o.cost + 0.5 * e.ema FROM e JOIN o ON o.project_id = e.project_id AND o.n = e.n + 1)
        SELECT project_id, round(arg_max(ema, n), 6) AS ema FROM e GROUP BY project_id
    """,
    "resume_plan": "SELECT CASE WHEN event_id % 5 IN (1, 2, 4) THEN 'pending' WHEN event_id % 5 = 0 THEN 'done' ELSE 'partial' END AS status, event_id % 5 IN (1, 2) AS requeued, count(*) AS n FROM events GROUP BY ALL",
    "latest_per_key": f"WITH {CALLS} SELECT project_id, id, kind FROM k QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) = 1",
    "last_events": f"WITH {CALLS} SELECT kind, id FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY created_at DESC, id DESC) <= 500",
    "price_lookup": """
        WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'openai/gpt-4o' || CASE WHEN p_partkey % 2 = 0 THEN ':free' ELSE '' END WHEN 1 THEN 'own/' || p_size ELSE 'unknown' END AS model_slug, p_size FROM part)
        SELECT p_partkey, model_slug, CASE WHEN p_partkey % 3 = 0 THEN 2.5 WHEN p_partkey % 3 = 1 AND p_size < 25 THEN 2.0 ELSE 1.0 END::DOUBLE AS price_in,
               CASE WHEN p_partkey % 3 = 0 THEN 10.0 WHEN p_partkey % 3 = 1 AND p_size < 25 THEN 8.0 ELSE 3.0 END::DOUBLE AS price_out FROM p
    """,
    "cost_estimate": """
        WITH p AS (SELECT p_partkey, p_partkey % 7 AS calls, CASE WHEN p_partkey % 3 = 0 THEN 2.5 WHEN p_partkey % 3 = 1 AND p_size < 25 THEN 2.0 ELSE 1.0 END::DOUBLE AS a,
                          CASE WHEN p_partkey % 3 = 0 THEN 10.0 WHEN p_partkey % 3 = 1 AND p_size < 25 THEN 8.0 ELSE 3.0 END::DOUBLE AS b FROM part)
        SELECT p_partkey, (308 * calls)::BIGINT AS est_tokens_in, (360 * calls)::BIGINT AS est_tokens_out, round((308 / 1e6 * a + 360 / 1e6 * b) * calls, 6) AS est_usd FROM p
    """,
    "project_summary": """
        SELECT n_nationkey AS project_id, 1.2346::DOUBLE AS spend_usd, 10.0::DOUBLE AS budget_cap_usd, count(DISTINCT s_suppkey) AS leaves, (3 * count(DISTINCT s_suppkey))::BIGINT AS target_rows, count(DISTINCT c_custkey) AS rows,
               count(DISTINCT c_custkey) FILTER (c_acctbal < 0) AS refusals, count(DISTINCT c_custkey) FILTER (c_acctbal > 8000 AND c_acctbal <= 9000) AS filtered, count(DISTINCT c_custkey) FILTER (c_acctbal > 9000) AS accepted, count(DISTINCT s_suppkey) AS pairs
        FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey
    """,
    "tree_path": """
        WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation),
        t AS (SELECT id, label AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, t.path || ' / ' || n.label FROM t JOIN n ON n.parent = t.id)
        SELECT id, path FROM t
    """,
    "slugs": "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'node') AS slug FROM part",
    "event_usage": "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events",
}
_STAGES = """
    WITH s AS (SELECT o_orderkey AS id, o_custkey % 20 AS project_id, o_orderkey % 6 + 1 AS stage, ['done', 'failed', 'paused', 'cancelled', 'running'][o_orderkey % 5 + 1] AS status, o_orderdate AS made FROM orders),
    l AS (SELECT project_id, stage, first(status ORDER BY made DESC, id DESC) AS last, bool_or(status = 'done') AS ever FROM s GROUP BY ALL),
    g AS (SELECT DISTINCT project_id, unnest(range(1, 9)) AS stage FROM s),
    st AS (SELECT project_id, stage, CASE WHEN last IN ('queued', 'running') THEN 'running' WHEN last IN ('paused', 'budget_stop') THEN 'paused' WHEN last = 'failed' AND NOT ever THEN 'failed' WHEN coalesce(ever, false) THEN 'done' ELSE 'todo' END AS status FROM g LEFT JOIN l USING (project_id, stage))
"""
ORACLE_SQL["stage_status"] = f"{_STAGES} SELECT project_id, stage, status FROM st"
ORACLE_SQL["next_stage"] = f"{_STAGES} SELECT project_id, arg_min(stage, CASE WHEN status = 'running' THEN stage ELSE 100 + stage END) AS next_stage FROM st WHERE status <> 'done' GROUP BY project_id"
ORACLE_SQL["row_kinds"] = "SELECT CASE WHEN p_size % 5 = 0 THEN 'tools' WHEN p_size % 3 = 0 THEN 'grpo' ELSE 'sft' END AS kind, count(*) AS n FROM part GROUP BY ALL"
ORACLE_SQL["kept_rows"] = "SELECT p_partkey, greatest(0, p_size - CASE WHEN p_partkey % 4 <> 0 THEN 25 ELSE 0 END)::BIGINT AS kept FROM part"
ORACLE_SQL["adversarial_prompts"] = """
    SELECT c_mktsegment AS segment, count(*) AS prompts, count(*) FILTER (c_custkey % 5 <> 0 AND c_acctbal < 0) AS adversarial,
           count(*) FILTER (c_custkey % 5 <> 0 AND c_acctbal < 0) / count(*) AS share FROM customer GROUP BY c_mktsegment
"""
ORACLE_SQL["active_runs"] = """
    SELECT o_custkey % 50 AS project_id, o_orderkey AS id, (o_orderkey % 6 + 1)::BIGINT AS stage FROM orders WHERE o_orderkey % 5 IN (2, 4)
    QUALIFY row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
"""
