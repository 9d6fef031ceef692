"""DuckDB SQL of the library's queries, written apart from the DataFrame code."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
#: Usage without repeats.
EVENTS = """ev AS (
    SELECT * FROM fx_usage WHERE event = 'retrieved'
    UNION ALL SELECT * FROM (SELECT * FROM fx_usage WHERE event IN ('used', 'selected') QUALIFY row_number() OVER (PARTITION BY trace_id, event, chunk_id ORDER BY ts, id) = 1)
    UNION ALL SELECT * FROM (SELECT * FROM fx_usage WHERE event IN ('task_ok', 'task_fail') QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY ts DESC, id DESC) = 1))"""
CUT = "coalesce(c.evidence_cutoff_at, TIMESTAMP '1970-01-01 00:00:00')"


def days(later: str, earlier: str) -> str:
    return f"greatest(0.0, (epoch_us({later}) - epoch_us({earlier})) / 86400e6)"


FACTS = f"""facts AS (
    SELECT u.chunk_id, u.trace_id, max(u.ts) AS succeeded_at FROM ev u JOIN fx_chunks c ON c.id = u.chunk_id
    WHERE u.event = 'used' AND u.ts > {CUT}
      AND (u.trace_id IN (SELECT trace_id FROM ev WHERE event = 'task_ok') OR u.trace_id IN (SELECT trace_id FROM fx_log WHERE outcome = 'ok'))
    GROUP BY 1, 2)"""
COUNTS = f"""counts AS (
    SELECT c.id, count(u.id) FILTER (u.event = 'selected') AS selected, count(u.id) FILTER (u.event = 'used') AS used,
           max(u.ts) FILTER (u.event = 'used') AS last_used_at
    FROM fx_chunks c LEFT JOIN ev u ON u.chunk_id = c.id AND u.event IN ('selected', 'used') AND u.ts > {CUT} GROUP BY c.id)"""
OUTCOME = """done AS (
    SELECT CAST(u.id AS VARCHAR) AS id, u.chunk_id, u.trace_id, CASE WHEN o.event = 'task_ok' THEN 'outcome_ok' ELSE 'outcome_fail' END AS kind, u.ts,
           CASE WHEN o.event = 'task_ok' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target,
           least(1.0::DOUBLE, 0.2::DOUBLE * (CASE u.attribution WHEN 'explicit' THEN 0.30::DOUBLE WHEN 'cited' THEN 0.25::DOUBLE ELSE 0.15::DOUBLE END / count(*) OVER (PARTITION BY u.trace_id))
             * CASE WHEN o.event = 'task_ok' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS alpha
    FROM ev u JOIN (SELECT trace_id, event FROM ev WHERE event IN ('task_ok', 'task_fail')) o USING (trace_id) WHERE u.event = 'used')"""
#: Needs EVENTS, COUNTS and OUTCOME.
EVIDENCE = OUTCOME + f""", evid AS (SELECT * FROM (
    SELECT * FROM done
    UNION ALL SELECT CAST(u.id AS VARCHAR), u.chunk_id, u.trace_id, 'selected_unused', u.ts, 0.0, 0.2::DOUBLE * 0.08::DOUBLE FROM ev u
      WHERE u.event = 'selected' AND u.trace_id IN (SELECT trace_id FROM fx_log WHERE usage_state IN ('known_some', 'known_none'))
        AND NOT EXISTS (SELECT 1 FROM ev x WHERE x.event = 'used' AND x.trace_id = u.trace_id AND x.chunk_id = u.chunk_id)
    UNION ALL SELECT f.id, f.chunk_id, f.trace_id, concat('feedback_', f.signal), f.ts, CASE WHEN f.signal = 'up' THEN 1.0 ELSE 0.0 END,
      least(1.0::DOUBLE, 0.2::DOUBLE * f.strength::DOUBLE * least(1.5::DOUBLE, 1 + 0.5::DOUBLE * pow(0.5::DOUBLE, coalesce(floor({days('f.ts', 'n.last_used_at')}), 0) / 14)))
      FROM (SELECT * FROM fx_feedback QUALIFY row_number() OVER (PARTITION BY trace_id, chunk_id ORDER BY ts DESC, id DESC) = 1) f JOIN counts n ON n.id = f.chunk_id)
    WHERE chunk_id IN (SELECT id FROM fx_chunks WHERE origin <> 'spark'))"""
FOLD = """fold AS (SELECT chunk_id, n_evidence, round(list_reduce(list_prepend({'t': base, 'a': 0.0::DOUBLE}, steps), lambda c, e: {'t': least(1.0::DOUBLE, greatest(0.0::DOUBLE, c.t + e.a * (e.t - c.t))), 'a': 0.0::DOUBLE}).t, 8) AS confidence, reason FROM (
    SELECT e.chunk_id, count(*) AS n_evidence, first(c.confidence_base) AS base, list({'t': e.target, 'a': e.alpha} ORDER BY e.ts, e.r, e.kind, e.id) AS steps, last(e.kind ORDER BY e.ts, e.r, e.kind, e.id) AS reason
    FROM (SELECT *, CASE WHEN kind LIKE 'outcome%' THEN 1 WHEN kind = 'selected_unused' THEN 2 ELSE 3 END AS r FROM evid) e JOIN fx_chunks c ON c.id = e.chunk_id GROUP BY 1))"""
GOVERN = f"""gov AS (SELECT chunk_id, greatest(0.0, sum(v)) AS s, count(*) FILTER (v > 0) AS actors FROM (
    SELECT f.chunk_id, actor, greatest(-1.0, least(1.0, sum((CASE WHEN signal = 'down' THEN strength ELSE -strength END)::DOUBLE * pow(0.5::DOUBLE, {days(AS_OF, 'ts')} / 90)))) AS v
    FROM fx_feedback f JOIN fx_chunks c ON c.id = f.chunk_id WHERE actor IS NOT NULL AND ts > {CUT} GROUP BY 1, 2) GROUP BY 1)"""
CONTEXT = f"""ctx AS (SELECT chunk_id, context_key, count(*) FILTER (kind = 'outcome_ok') AS success_count, count(*) FILTER (kind = 'outcome_fail') AS failure_count, count(*) FILTER (kind = 'up') AS positive_feedback, count(*) FILTER (kind = 'down') AS negative_feedback
    FROM (SELECT d.chunk_id, l.context_key, d.kind FROM done d JOIN fx_log l USING (trace_id) JOIN fx_chunks c ON c.id = d.chunk_id WHERE c.origin <> 'spark'
      UNION ALL SELECT f.chunk_id, f.context_key, f.signal FROM fx_feedback f LEFT JOIN fx_chunks c ON c.id = f.chunk_id WHERE c.evidence_cutoff_at IS NULL OR f.ts > c.evidence_cutoff_at) GROUP BY 1, 2)"""
ARCHIVE = f"""hub AS (SELECT chunk_id, count(*) FILTER (event = 'selected') AS hs, count(*) FILTER (event = 'used') AS hu FROM ev WHERE event IN ('selected', 'used') AND ts >= {AS_OF} - INTERVAL 30 DAYS GROUP BY 1),
    succ AS (SELECT chunk_id, count(*) AS n FROM facts GROUP BY 1), arch AS (
    SELECT c.id, CASE WHEN confidence_base < 0.25 AND last_used_at < {AS_OF} - INTERVAL 60 DAYS THEN 'low_confidence'
        WHEN selected >= 3 AND used = 0 AND confidence_base < 0.60 THEN 'repeated_selected_unused'
        WHEN hs >= 3 AND hu < 0.01 * hs THEN 'hub_selected_unused'
        WHEN used = 0 AND coalesce(evidence_cutoff_at, created_at) < {AS_OF} - INTERVAL 30 DAYS AND c.id NOT IN (SELECT chunk_id FROM fx_validations WHERE verdict IN ('applied', 'supported')) THEN 'never_used'
        WHEN round(s, 6) >= 2 AND actors >= 2 THEN 'governance_proposal' WHEN round(s, 6) >= 2.5 AND actors >= 2 THEN 'sustained_negative_feedback'
        WHEN used >= 2 AND coalesce(d.n, 0) < 0.2 * used AND confidence_base < 0.35 THEN 'sustained_task_failure' END AS reason
    FROM fx_chunks c JOIN counts USING (id) LEFT JOIN hub ON hub.chunk_id = c.id LEFT JOIN succ d ON d.chunk_id = c.id LEFT JOIN gov ON gov.chunk_id = c.id
    WHERE c.state IN ('active', 'pending') AND c.protected = 0 AND c.origin <> 'spark' AND reason IS NOT NULL)"""
DECAY = f"""decay AS (SELECT id, round(n, 6) AS confidence, concat('decay:', d, 'd') AS note FROM (SELECT id, b, d, b + (1 - pow(0.5::DOUBLE, d / 90)) * (0.20::DOUBLE - b) AS n FROM (
    SELECT id, confidence_base AS b, CAST(floor({days(AS_OF, 'last_used_at')}) AS BIGINT) AS d FROM fx_chunks JOIN counts USING (id) WHERE state IN ('active', 'pending') AND origin <> 'spark' AND protected = 0 AND last_used_at IS NOT NULL)) WHERE d > 0 AND abs(b - n) > 0.001)"""
LOSERS = "losers AS (SELECT id, concat('duplicate:', first_value(id) OVER w) AS reason FROM fx_chunks WHERE state IN ('active', 'pending') AND origin <> 'spark' WINDOW w AS (PARTITION BY content_hash ORDER BY protected DESC, confidence_base DESC, created_at, id) QUALIFY row_number() OVER w > 1)"
LIFE = f"""life AS (SELECT trace_id, CASE WHEN late THEN 'timed_out' ELSE task_state END AS became, CASE WHEN late THEN 'discarded' WHEN task_state = 'recalled' THEN 'open' WHEN usage_state = 'known_some' THEN 'new' ELSE 'discarded' END AS distill_state
    FROM (SELECT *, task_state = 'recalled' AND ts < {AS_OF} - INTERVAL 14 DAYS AS late FROM fx_log))"""
EXPIRE = f"expire AS (SELECT id, 'unknown' AS becomes FROM fx_validations WHERE verdict = 'shown' AND created_at < {AS_OF} - INTERVAL 2 DAYS UNION ALL SELECT id, 'expired' FROM fx_episodes WHERE ts < {AS_OF} - INTERVAL 20 DAYS)"
WORDS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: strlen(w) >= 2)"
ASKED = f"list_filter({WORDS.format('query')}, lambda w: w NOT IN ('the', 'a', 'an', 'to', 'of', 'in', 'on', 'for', 'and', 'or', 'is', 'do', 'i'))"


def hits(vectors: str, k: int) -> str:
    return f"""SELECT query_id, chunk_id, sim, CAST(rank AS INTEGER) AS rank FROM (
        SELECT query_id, chunk_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank
        FROM (SELECT q.query_id, v.chunk_id, round(list_dot_product(q.vec::DOUBLE[], v.embedding::DOUBLE[]), 6) AS sim FROM fx_queries q CROSS JOIN {vectors} v)) WHERE rank <= {k}"""


BM25 = f"""post AS (SELECT id, w AS token, count(*) AS tf FROM (SELECT id, unnest({WORDS.format("concat_ws(' ', content, trigger_desc, skill_name)")}) AS w FROM fx_chunks) GROUP BY 1, 2),
    size AS (SELECT id, sum(tf) AS size FROM post GROUP BY 1), stats AS (SELECT count(*) AS docs, avg(size) AS mean FROM size),
    df AS (SELECT token, count(*) AS df FROM post GROUP BY 1),
    qw AS (SELECT query_id, token FROM (SELECT query_id, token, min(pos) AS pos FROM (SELECT query_id, unnest(words) AS token, generate_subscripts(words, 1) AS pos
        FROM (SELECT query_id, {ASKED} AS words FROM fx_queries)) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 32),
    bm AS (SELECT qw.query_id, p.id AS chunk_id, sum(greatest(1e-6, ln((docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS s
        FROM qw JOIN post p USING (token) JOIN df USING (token) JOIN size USING (id) JOIN fx_chunks c ON c.id = p.id CROSS JOIN stats
        WHERE c.state <> 'archived' AND c.origin <> 'spark' GROUP BY 1, 2),
    lexical AS (SELECT query_id, chunk_id, round(s / max(s) OVER (PARTITION BY query_id), 6) AS lexical FROM bm)"""


def ranked(source: str, score: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, chunk_id) AS INTEGER) AS rank FROM {source}) WHERE rank <= {k}"


TRIM = r"""["''`,;.()\[\]{}?!<>*|=@#%\\]+"""


def entity_rows(source: str, key: str, texts: list[str]) -> str:
    """Common table expressions up to ``ents``: key, entity and etype of the texts of ``source``."""
    pieces = "\nUNION ALL ".join(
        rf"""SELECT {key} AS k, {2 * i} AS part, j * 1000000 + generate_subscripts(w, 1) AS nr, true AS marked, unnest(w) AS tok FROM (SELECT {key}, unnest(spans) AS w, generate_subscripts(spans, 1) AS j FROM (
            SELECT {key}, list_transform(list_filter(string_split({t}, '`'), lambda p, i: i % 2 = 0 AND i < len(string_split({t}, '`'))), lambda p: string_split_regex(p, '\s+')) AS spans FROM {source}))
        UNION ALL SELECT {key}, {2 * i + 1}, generate_subscripts(string_split_regex({t}, '\s+'), 1), false, unnest(string_split_regex({t}, '\s+')) FROM {source}"""
        for i, t in enumerate(texts)
    )
    return rf"""pieces AS ({pieces}), cut AS (SELECT *, regexp_replace(tok, '^{TRIM}|{TRIM}$', '', 'g') AS t FROM pieces),
    kinds AS (SELECT k, part, nr, t, CASE WHEN regexp_matches(t, '^--[\p{{L}}\p{{N}}_:./-]+$') AND strlen(t) >= 4 THEN 'flag' WHEN strlen(t) < 2 THEN NULL WHEN regexp_matches(t, '^[A-Za-z]{{1,4}}[0-9]{{3,}}$') THEN 'error'
        WHEN named AND (contains(t, '::') OR (contains(t, '/') AND contains(t, '.'))) THEN 'path' WHEN named AND worded AND regexp_matches(t, '[_-]') THEN 'symbol'
        WHEN regexp_matches(t, '^[\p{{L}}\p{{N}}]+$') AND regexp_matches(t, '\p{{Ll}}\p{{Lu}}') THEN 'symbol' WHEN marked AND named AND worded THEN 'symbol' END AS etype
        FROM (SELECT *, regexp_matches(t, '^[\p{{L}}\p{{N}}_:./-]+$') AS named, regexp_matches(t, '\p{{L}}') AS worded FROM cut)),
    named AS (SELECT k, part, nr, etype, CASE WHEN etype = 'path' AND NOT contains(t, '::') THEN regexp_replace(lower(t), '/+$', '') ELSE lower(t) END AS entity FROM kinds WHERE etype IS NOT NULL),
    once AS (SELECT * FROM named WHERE strlen(entity) >= 2 QUALIFY row_number() OVER (PARTITION BY k, entity ORDER BY part, nr) = 1),
    ents AS (SELECT k, entity, etype FROM once QUALIFY row_number() OVER (PARTITION BY k ORDER BY part, nr) <= 64)"""


def renamed(ctes: str, suffix: str) -> str:
    for name in ("pieces", "cut", "kinds", "named", "once", "ents"):
        ctes = ctes.replace(f"{name} AS (", f"{name}{suffix} AS (").replace(f"FROM {name} ", f"FROM {name}{suffix} ").replace(f"FROM {name})", f"FROM {name}{suffix})")
    return ctes


SPREAD = f"""{entity_rows('fx_code', 'id', ['content', 'trigger_desc'])}, {renamed(entity_rows('fx_queries', 'query_id', ['query']), '_q')},
    seed AS (SELECT query_id, chunk_id, greatest(c, t, l) AS base FROM cand0 WHERE base > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY greatest(c, t, l) DESC, chunk_id) <= 5),
    src AS (SELECT query_id, entity, sum(a) AS a FROM (SELECT k AS query_id, entity, 1.0::DOUBLE AS a FROM ents_q UNION ALL SELECT query_id, entity, base FROM seed JOIN ents ON k = chunk_id) GROUP BY 1, 2),
    link AS (SELECT k AS chunk_id, entity FROM ents WHERE k IN (SELECT id FROM fx_chunks WHERE state <> 'archived' AND origin <> 'spark')), fan AS (SELECT entity, count(*) AS fan FROM link GROUP BY 1 HAVING count(*) <= 50),
    rawa AS (SELECT query_id, chunk_id, sum(a / fan) AS r FROM src JOIN fan USING (entity) JOIN link USING (entity) GROUP BY 1, 2), spr0 AS (SELECT query_id, chunk_id, round(r / max(r) OVER (PARTITION BY query_id), 6) AS spread FROM rawa),
    spr AS (SELECT * FROM spr0 WHERE chunk_id IN (SELECT id FROM fx_chunks WHERE state <> 'archived' AND origin <> 'spark' AND embed_version >= 1))"""


def recalled(vectors: bool = True, gate: float | None = None, spread: bool = True) -> str:
    """Common table expressions up to ``rec``, the chunks of each query in order; without ``spread`` that channel has no weight."""
    passed_on = f"""{SPREAD},
    cand AS (SELECT query_id, chunk_id, coalesce(c, 0) AS c, coalesce(t, 0) AS t, coalesce(l, 0) AS l, coalesce(spread, 0) AS s FROM cand0 FULL JOIN spr USING (query_id, chunk_id))""" if spread else "cand AS (SELECT *, 0.0::DOUBLE AS s FROM cand0)"
    near = f"""UNION ALL SELECT query_id, chunk_id, sim, 0, 0 FROM ({hits('fx_vec_content', 40)}) UNION ALL SELECT query_id, chunk_id, 0, sim, 0 FROM ({hits('fx_vec_trigger', 40)})""" if vectors else ""
    names = ("content", "trigger", "lexical", "spread", "confidence", "context", "activation")
    parts = ", ".join(f"{{'v': -round(w_{n}, 6), 'name': '{n}'}}" for n in names)
    return f"""{BM25}, {EVENTS}, {COUNTS}, {EVIDENCE}, {FOLD}, {CONTEXT},
    one AS (SELECT query_id, chunk_id, max(c) AS c, max(t) AS t, max(l) AS l FROM (SELECT query_id, chunk_id, 0.0::DOUBLE AS c, 0.0::DOUBLE AS t, lexical AS l FROM ({ranked('lexical', 'lexical', 40)}) {near})
        WHERE chunk_id IN (SELECT id FROM fx_chunks WHERE state <> 'archived' AND origin <> 'spark' AND embed_version >= 1) GROUP BY 1, 2),
    soft AS (SELECT o.query_id, d.dst AS chunk_id, count(*) AS n FROM one o JOIN fx_deps d ON d.src = o.chunk_id AND d.kind = 'soft' WHERE d.dst IN (SELECT id FROM fx_chunks WHERE state <> 'archived' AND origin <> 'spark') GROUP BY 1, 2),
    cand0 AS (SELECT query_id, chunk_id, CASE WHEN n > 0 THEN greatest(coalesce(c, 0), least(1.0::DOUBLE, coalesce(c, 0) + 0.05::DOUBLE * n)) ELSE c END AS c, coalesce(t, 0) AS t, coalesce(l, 0) AS l FROM one FULL JOIN soft USING (query_id, chunk_id)),
    {passed_on},
    parts AS (SELECT x.query_id, x.chunk_id, k.state, k.token_count, 0.55::DOUBLE * c AS w_content, 0.25::DOUBLE * t AS w_trigger, 0.25::DOUBLE * l AS w_lexical, 0.10::DOUBLE * s AS w_spread, 0.10::DOUBLE * coalesce(f.confidence, confidence_base) AS w_confidence,
        0.15::DOUBLE * coalesce(((wins + 1) / (wins + losses + 2) - 0.5) * 2 * least((wins + losses) / 5, 1), 0) AS w_context,
        0.08::DOUBLE * CASE WHEN n.used > 0 THEN 1 / (1 + exp(-(ln(1 + n.used) - 0.5 * ln(1 + {days(AS_OF, 'n.last_used_at')})))) ELSE 0 END AS w_activation,
        CASE WHEN strlen(content) > 800 THEN -0.15::DOUBLE * ln(strlen(content) / 800.0::DOUBLE) ELSE 0.0 END AS w_length,
        len(list_filter(list_transform(string_split(lower(coalesce(anti_trigger_desc, '')), ','), lambda p: trim(p, ' ')), lambda p: p <> '' AND contains(lower(q.query), p))) > 0 AS against,
        x.t, starts_with(ltrim(content, ' '), 'Avoid:') OR coalesce(anti_trigger_desc, '') <> '' AS fail_origin
        FROM cand x JOIN fx_queries q USING (query_id) JOIN fx_chunks k ON k.id = x.chunk_id LEFT JOIN fold f ON f.chunk_id = x.chunk_id LEFT JOIN counts n ON n.id = x.chunk_id
        LEFT JOIN (SELECT chunk_id, context_key, success_count + 2.0::DOUBLE * positive_feedback AS wins, failure_count + 2.0::DOUBLE * negative_feedback AS losses FROM ctx) v ON v.chunk_id = x.chunk_id AND v.context_key = q.context_key),
    fused AS (SELECT *, round(g, 6) AS gate, round(g * CASE WHEN state = 'pending' THEN 0.6::DOUBLE ELSE 1 END, 6) AS score FROM (SELECT *, ({' + '.join(f'w_{n}' for n in names)} + w_length) * CASE WHEN against THEN 0.6::DOUBLE ELSE 1 END AS g FROM parts)),
    top AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 20),
    gated AS (SELECT * FROM top WHERE {f'gate >= {gate}' if gate is not None else 'true'}),
    slot AS (SELECT * FROM gated QUALIFY state <> 'pending' OR coalesce(count(*) FILTER (state = 'pending') OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0),
    rec AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score, gate, token_count,
        array_to_string(list_transform(list_filter(ps, lambda e, i: i = 1 OR -e.v >= 0.15::DOUBLE * -list_sum(list_transform(ps, lambda z: z.v))), lambda e: e.name), '+') AS reason
        FROM (SELECT *, list_sort(list_filter([{parts}], lambda e: e.v < 0)) AS ps FROM slot))"""


USABLE_DEP = "usable AS (SELECT id, token_count AS cost FROM fx_chunks WHERE state <> 'archived' AND origin <> 'spark' AND embed_version <> 0), hard AS (SELECT DISTINCT src, dst FROM fx_deps WHERE kind = 'hard')"


def blocks(seeds: str) -> str:
    """Common table expressions up to ``block``: id, parts (id and cost) and reason of each seed's closed block; a recursion walks in depth, one chunk a step."""
    return f"""{USABLE_DEP},
    walk(id, todo, seen, parts, reason) AS (SELECT c.id, list_sort(coalesce((SELECT list({{'d': 1, 'n': dst}}) FROM hard WHERE src = c.id), []::STRUCT(d INTEGER, n VARCHAR)[])), [c.id], [{{'id': c.id, 'cost': c.token_count}}], NULL::VARCHAR FROM fx_chunks c WHERE c.id IN ({seeds})
        UNION ALL SELECT id, CASE WHEN list_contains(seen, front.n) THEN todo[2:] ELSE list_concat(list_sort(coalesce((SELECT list({{'d': front.d + 1, 'n': dst}}) FROM hard WHERE src = front.n), []::STRUCT(d INTEGER, n VARCHAR)[])), todo[2:]) END,
            list_append(seen, front.n), CASE WHEN list_contains(seen, front.n) OR cost IS NULL THEN parts ELSE list_append(parts, {{'id': front.n, 'cost': cost}}) END,
            CASE WHEN list_contains(seen, front.n) THEN NULL WHEN cost IS NULL THEN 'hard_dep_unavailable' WHEN front.d >= 3 THEN 'dep_depth_limit' END
        FROM (SELECT w.id, todo, todo[1] AS front, seen, parts, u.cost FROM walk w LEFT JOIN usable u ON u.id = w.todo[1].n WHERE len(todo) > 0 AND reason IS NULL)),
    block AS (SELECT id, CASE WHEN reason IS NULL THEN parts ELSE [] END AS parts, reason FROM walk WHERE len(todo) = 0 OR reason IS NOT NULL)"""


def packs(budget: int, trim: bool = False, closed: bool = True) -> str:
    """Common table expressions after ``rec``: ``pack``, first by order, then by density, one row of a query a step."""
    ids = "list_transform(p.taken, lambda x: x.id)"
    new = f"list_filter(r.parts, lambda y: NOT list_contains({ids}, y.id))"
    cost = "coalesce(list_sum(list_transform({0}, lambda y: y.cost)), 0)::BIGINT".format
    mark = lambda parts, name: f"list_transform({parts}, lambda y: {{'id': y.id, 'cost': y.cost, 'pass': '{name}', 'seed': r.chunk_id}})"
    held = blocks("SELECT chunk_id FROM rec") if closed else "block AS (SELECT id, [{'id': id, 'cost': token_count}] AS parts, NULL::VARCHAR AS reason FROM fx_chunks)"
    short = f"r.parts[1].cost <= {budget} - p.used" if trim else "false"
    return f"""{held},
    list_of AS (SELECT r.query_id, r.rank, r.chunk_id, r.score, b.parts, b.reason FROM rec r JOIN block b ON b.id = r.chunk_id),
    one_pass(query_id, rank, used, taken, lefts) AS (SELECT query_id, 0, CAST(0 AS BIGINT), []::STRUCT(id VARCHAR, cost BIGINT, pass VARCHAR, seed VARCHAR)[], []::INTEGER[] FROM (SELECT DISTINCT query_id FROM rec)
        UNION ALL SELECT query_id, rank, CASE WHEN fits THEN used + cost WHEN trims THEN used + one_cost ELSE used END, CASE WHEN fits THEN list_concat(taken, news) WHEN trims THEN list_concat(taken, ones) ELSE taken END, CASE WHEN open AND NOT fits AND NOT trims THEN list_append(lefts, rank) ELSE lefts END
        FROM (SELECT *, open AND used + cost <= {budget} AS fits, open AND used + cost > {budget} AND may_trim AS trims FROM (SELECT p.query_id, r.rank, p.used, p.taken, p.lefts, NOT list_contains({ids}, r.chunk_id) AND r.reason IS NULL AS open, {cost(new)} AS cost, {mark(new, 'order')} AS news,
            {short} AS may_trim, r.parts[1].cost AS one_cost, {mark('r.parts[1:1]', 'trimmed')} AS ones FROM one_pass p JOIN list_of r ON r.query_id = p.query_id AND r.rank = p.rank + 1))),
    done_one AS (SELECT * FROM one_pass QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) = 1),
    rest AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY density DESC, rank) AS nth FROM (SELECT query_id, rank, chunk_id, parts, cost, score / greatest(cost, 1) AS density FROM (SELECT r.query_id, r.rank, r.chunk_id, r.score, {new} AS parts, {cost(new)} AS cost FROM list_of r JOIN done_one p ON p.query_id = r.query_id AND list_contains(p.lefts, r.rank)) WHERE len(parts) > 0)),
    two_pass(query_id, nth, used, taken) AS (SELECT query_id, CAST(0 AS BIGINT), {cost('taken')}, taken FROM done_one
        UNION ALL SELECT p.query_id, r.nth, CASE WHEN p.used + r.cost <= {budget} THEN p.used + r.cost ELSE p.used END, CASE WHEN p.used + r.cost <= {budget} THEN list_concat(p.taken, {mark(new, 'density')}) ELSE p.taken END FROM two_pass p JOIN rest r ON r.query_id = p.query_id AND r.nth = p.nth + 1),
    pack AS (SELECT query_id, CAST(pos AS INTEGER) AS pos, t.id AS chunk_id, t.cost AS tokens, t.pass AS pass, t.seed AS seed FROM (SELECT query_id, unnest(taken) AS t, generate_subscripts(taken, 1) AS pos FROM two_pass QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY nth DESC) = 1))"""


def share(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN round({n}::DOUBLE / {d}, 3) ELSE 0.0 END"


HIT = "CASE WHEN emitted_valence = 'affirm' THEN observed_outcome < 0 ELSE observed_outcome > 0 END"

SQL = {
    "f1_listing": "SELECT id, origin, state, substr(content, 1, 280) AS preview, created_at FROM fx_chunks WHERE state = 'active' ORDER BY created_at DESC, id LIMIT 50 OFFSET 10",
    "f2_recallable": "SELECT id, state, origin FROM fx_chunks WHERE state <> 'archived' AND origin <> 'spark' AND embed_version >= 1",
    "f3_valid_sparks": "SELECT id, maturity FROM fx_chunks WHERE origin = 'spark' AND state <> 'archived' AND maturity NOT IN ('promoted', 'dropped') AND embed_version >= 1",
    "f8_recent_traces": "SELECT trace_id, ts, outcome, task_state FROM fx_log ORDER BY ts DESC, trace_id LIMIT 100",
    "f11_stale_embeddings": "SELECT id, (SELECT count(*) FROM fx_chunks WHERE embed_version = 0) AS remaining FROM fx_chunks WHERE embed_version = 0",
    "f13_reverse_deps": "SELECT dst, count(*) AS dependents, count(*) FILTER (kind = 'hard') AS hard FROM fx_deps GROUP BY dst",
    "f14_trace_outcomes": "SELECT trace_id, arg_max(event, (ts, id)) AS outcome, count(*) AS reports FROM fx_usage WHERE event IN ('task_ok', 'task_fail') GROUP BY 1",
    "v1_domain_violations": """WITH x AS (SELECT 'usage' AS source_table, 'event' AS column_name, event AS value, CAST(id AS VARCHAR) AS id FROM fx_usage WHERE event NOT IN ('retrieved', 'selected', 'refined', 'used', 'task_ok', 'task_fail')
        UNION ALL SELECT 'usage', 'attribution', '(null)', CAST(id AS VARCHAR) FROM fx_usage WHERE event = 'used' AND attribution IS NULL UNION ALL SELECT 'usage', 'source', source, CAST(id AS VARCHAR) FROM fx_usage WHERE source NOT IN ('mcp', 'sdk', 'cli', 'hook', 'daemon', 'augmented')
        UNION ALL SELECT 'feedback', 'signal', signal, id FROM fx_feedback WHERE signal NOT IN ('up', 'down') UNION ALL SELECT 'log', 'task_state', task_state, trace_id FROM fx_log WHERE task_state NOT IN ('recalled', 'running', 'completed', 'abandoned', 'timed_out')
        UNION ALL SELECT 'distill', 'distill_state', distill_state, id FROM fx_distill WHERE distill_state NOT IN ('open', 'new', 'screening', 'distilled', 'discarded', 'failed')
        UNION ALL SELECT 'submitted', 'verdict', verdict, id FROM fx_submitted WHERE verdict NOT IN ('shown', 'observed', 'applied', 'supported', 'contradicted', 'irrelevant', 'unknown'))
        SELECT source_table, column_name, value, count(*) AS n, min(id) AS first_id FROM x GROUP BY 1, 2, 3""",
    "v5_orphans": "SELECT DISTINCT src, dst FROM fx_deps WHERE kind = 'hard' AND (src NOT IN (SELECT id FROM fx_chunks) OR dst NOT IN (SELECT id FROM fx_chunks))",
    "t1_t2_hash_tokens": "SELECT id, sha256(content) AS hash, CAST(ceil(strlen(content) / 4.0) AS BIGINT) AS tokens FROM fx_chunks",
    "t3_t4_normalized_queries": r"""WITH n AS (SELECT query_id, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(query), '[^\p{L}\p{N}]+', ' ', 'g'), ' '),
        lambda w: w <> '' AND w NOT IN ('a', 'an', 'and', 'for', 'in', 'of', 'on', 'the', 'to', 'with')))), ' ') AS normalized FROM fx_queries) SELECT query_id, normalized, sha256(normalized) AS context_hash FROM n""",
    "t11_anti_hits": """SELECT DISTINCT q.query_id, p.id AS chunk_id FROM (SELECT id, trim(unnest(string_split(lower(anti_trigger_desc), ',')), ' ') AS part FROM fx_chunks WHERE anti_trigger_desc IS NOT NULL) p JOIN fx_queries q ON p.part <> '' AND contains(lower(q.query), p.part)""",
    "n2_activation": f"WITH {EVENTS}, u AS (SELECT chunk_id, count(*) AS uses, max(ts) AS last FROM ev WHERE event = 'used' GROUP BY 1) SELECT chunk_id, uses, round(1 / (1 + exp(-(ln(1 + uses) - 0.5 * ln(1 + {days(AS_OF, 'last')})))), 6) AS activation FROM u",
    "n4_length_penalty": "SELECT id, round(CASE WHEN strlen(content) > 800 THEN -0.15::DOUBLE * ln(strlen(content) / 800.0::DOUBLE) ELSE 0.0 END, 6) AS penalty FROM fx_chunks",
    "a1_success_facts": f"WITH {EVENTS}, {FACTS} SELECT * FROM facts",
    "a2_success_counts": f"WITH {EVENTS}, {FACTS} SELECT c.id, count(f.trace_id) AS successes, max(f.succeeded_at) AS last_success_at FROM fx_chunks c LEFT JOIN facts f ON f.chunk_id = c.id GROUP BY c.id",
    "a3_usage_counts": f"WITH {EVENTS}, {COUNTS} SELECT * FROM counts",
    "a4_purged_usage": f"""SELECT id, trace_id, chunk_id, event, ts FROM fx_usage u WHERE NOT (event IN ('retrieved', 'refined') AND ts < {AS_OF} - INTERVAL 7 DAYS) OR coalesce(chunk_id, '') IN (SELECT id FROM fx_chunks WHERE origin = 'spark')""",
    "a7_outcome_evidence": f"WITH {EVENTS}, {OUTCOME} SELECT * FROM done",
    "a9_latest_feedback": "SELECT trace_id, chunk_id, id, signal, CAST(strength AS DOUBLE) AS strength, actor FROM fx_feedback QUALIFY row_number() OVER (PARTITION BY trace_id, chunk_id ORDER BY ts DESC, id DESC) = 1",
    "a10_confidence": f"WITH {EVENTS}, {COUNTS}, {EVIDENCE}, {FOLD} SELECT * FROM fold",
    "a12_governance": f"WITH {GOVERN} SELECT chunk_id, round(s, 6) AS score, actors, s >= 2 AND actors >= 2 AS proposed FROM gov",
    "a15_usage_states": "SELECT usage_state, task_state, count(*) AS n FROM fx_log GROUP BY 1, 2",
    "a16_observed_outcomes": f"WITH {EVENTS}, {OUTCOME} SELECT chunk_id, count(*) AS observed, round(avg(target), 6) AS mean_target FROM done GROUP BY 1",
    "a18_counter_baseline": f"WITH {EVENTS}, k AS (SELECT chunk_id, count(*) AS kept FROM ev WHERE event = 'selected' GROUP BY 1) SELECT id, CAST(greatest(0, selected_count - coalesce(kept, 0)) AS BIGINT) AS base FROM fx_counters LEFT JOIN k ON chunk_id = id",
    "a20_deduped": f"WITH {EVENTS} SELECT event, count(*) AS n, min(id) AS first_id FROM ev GROUP BY 1",
    "c1_c8_archive_rules": f"WITH {EVENTS}, {FACTS}, {COUNTS}, {GOVERN}, {ARCHIVE} SELECT * FROM arch",
    "c9_duplicates": f"WITH {LOSERS} SELECT * FROM losers",
    "c10_decay": f"WITH {EVENTS}, {COUNTS}, {DECAY} SELECT * FROM decay",
    "c12_l9_l10_supports": """WITH v AS (SELECT v.*, c.created_at AS born_at, c.state, c.origin, m.version, m.source_projects, m.directive FROM fx_validations v JOIN fx_chunks c ON c.id = v.chunk_id JOIN fx_rule_meta m ON m.id = c.id),
        p AS (SELECT chunk_id, coalesce(session_id, id) AS unit, max(project) AS project, any_value(source_projects) AS source_projects FROM v WHERE verdict = 'supported' AND rule_version = version AND created_at > born_at AND NOT EXISTS (SELECT 1 FROM fx_births b WHERE b.rule_id = v.chunk_id AND b.session_id = v.session_id) GROUP BY 1, 2),
        u AS (SELECT chunk_id, count(*) AS units, count(DISTINCT project) AS projects, CASE WHEN any_value(source_projects) IS NULL THEN count(DISTINCT project) >= 2 ELSE bool_or(NOT list_contains(string_split(source_projects, ','), project)) END AS moved FROM p GROUP BY 1),
        x AS (SELECT chunk_id, state, origin, directive, count(*) FILTER (verdict = 'contradicted' AND resolved_at IS NULL) AS open_contradictions FROM v GROUP BY 1, 2, 3, 4),
        y AS (SELECT chunk_id, state, origin, directive, coalesce(units, 0) AS units, coalesce(projects, 0) AS projects, coalesce(moved, false) AND coalesce(units, 0) >= 2 AND open_contradictions = 0 AS transferable, open_contradictions FROM x LEFT JOIN u USING (chunk_id))
        SELECT chunk_id, units, projects, open_contradictions, transferable,
        CASE WHEN open_contradictions > 0 AND state = 'active' AND NOT directive THEN 'suspended' WHEN transferable AND state = 'pending' AND origin <> 'spark' THEN 'promoted' ELSE 'unchanged' END AS becomes FROM y""",
    "l10_contradictions": "SELECT id, chunk_id, session_id, project, created_at FROM fx_validations WHERE verdict = 'contradicted' AND resolved_at IS NULL",
    "c15_trace_lifecycle": f"WITH {LIFE} SELECT * FROM life",
    "c18_calibration": f"""WITH x AS (SELECT least(9, CAST(floor(emitted_strength * 10) AS BIGINT)) AS b, ({HIT})::INT AS hit FROM fx_verdicts WHERE observed_outcome IS NOT NULL AND outcome_provenance = 'observed' AND emitted_valence IN ('affirm', 'caution') AND emitted_conf IS NOT NULL),
        m AS (SELECT bucket, bucket / 10 AS lo, (bucket + 1) / 10 AS hi, count(hit) AS n, round(coalesce(avg(hit), (bucket + 0.5) / 10), 6) AS rate FROM range(10) r(bucket) LEFT JOIN x ON b = bucket WHERE (SELECT count(*) FROM x) >= 20 GROUP BY bucket) SELECT * FROM m""",
    "l8_expiries": f"WITH {EXPIRE} SELECT * FROM expire",
    "r1_content_hits": hits("fx_vec_content", 10),
    "r2_lexical_hits": f"WITH {BM25} {ranked('lexical', 'lexical', 10)}",
    "r6_recall": f"WITH {recalled()} SELECT * FROM rec",
    "r14_spark_hits": f"""WITH c AS ({hits('fx_vec_content', 20)}), t AS ({hits('fx_vec_trigger', 20)}), s AS (SELECT query_id, chunk_id, max(sim) AS sim FROM (SELECT * FROM c UNION ALL SELECT * FROM t) JOIN fx_chunks k ON k.id = chunk_id
        WHERE origin = 'spark' AND state <> 'archived' AND maturity NOT IN ('promoted', 'dropped') AND embed_version >= 1 GROUP BY 1, 2) {ranked('s', 'sim', 20)}""",
    "e1_ranking_metrics": f"""WITH h AS ({hits('fx_vec_content', 10)}), r AS (SELECT DISTINCT query_id, chunk_id FROM fx_relevant), n AS (SELECT query_id, count(*) AS n FROM r GROUP BY 1),
        x AS (SELECT h.query_id, count(r.chunk_id) AS h, min(rank) FILTER (r.chunk_id IS NOT NULL) AS f, sum(CASE WHEN r.chunk_id IS NULL THEN 0.0 ELSE 1 / log2(rank + 1) END) AS dcg FROM h LEFT JOIN r ON r.query_id = h.query_id AND r.chunk_id = h.chunk_id GROUP BY 1)
        SELECT query_id, round(h / 10, 6) AS precision, round(h / n, 6) AS recall, round(coalesce(1 / f, 0.0), 6) AS rr, round(dcg / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM x JOIN n USING (query_id)""",
    "o1_window_rates": f"""WITH {EVENTS}, v(d) AS (VALUES (1), (7), (30)),
        e AS (SELECT d, trace_id, count(*) FILTER (event = 'retrieved') AS r, count(*) FILTER (event = 'selected') AS s, count(*) FILTER (event = 'used') AS u FROM ev JOIN v ON ts >= {AS_OF} - to_days(d) GROUP BY 1, 2),
        x AS (SELECT d, sum(s) AS s, sum(u) AS u, count(*) FILTER (r > 0 AND s = 0) AS empty, count(*) FILTER (r > 0) AS recalls, count(*) FILTER (s > 0 AND trace_id IN (SELECT trace_id FROM fx_feedback)) AS spoken, count(*) FILTER (s > 0) AS choosing FROM e GROUP BY 1),
        l AS (SELECT d, count(*) AS traces, count(*) FILTER (task_state = 'completed') AS completed, count(*) FILTER (task_state = 'timed_out') AS late, count(*) FILTER (usage_state <> 'unknown') AS known, count(*) FILTER (outcome = 'ok') AS ok, count(outcome) AS ended FROM fx_log JOIN v ON ts >= {AS_OF} - to_days(d) GROUP BY 1)
        SELECT d AS days, traces, {share('empty', 'recalls')} AS empty_recall_rate, {share('completed', 'traces')} AS completed_rate, {share('late', 'traces')} AS timeout_rate, {share('known', 'traces')} AS annotation_rate, {share('u', 's')} AS use_rate, {share('ok', 'ended')} AS success_rate, {share('spoken', 'choosing')} AS feedback_coverage FROM l LEFT JOIN x USING (d)""",
    "o2_dimension_rates": f"""WITH {EVENTS}, e AS (SELECT trace_id, count(*) FILTER (event = 'selected') AS s, count(*) FILTER (event = 'used') AS u FROM ev GROUP BY 1),
        l AS (SELECT l.*, s, u, l.trace_id IN (SELECT trace_id FROM fx_feedback) AS spoken FROM fx_log l LEFT JOIN e USING (trace_id)),
        k AS (SELECT 'source' AS dimension, event_source AS value, * FROM l UNION ALL SELECT 'agent', coalesce(agent, '(null)'), * FROM l UNION ALL SELECT 'context', context_key, * FROM l),
        g AS (SELECT dimension, value, count(*) AS traces, {share("count(*) FILTER (outcome = 'ok')", 'count(outcome)')} AS success_rate, {share("count(*) FILTER (task_state = 'timed_out')", 'count(*)')} AS timeout_rate, {share('sum(u)', 'sum(s)')} AS use_rate,
            {share("count(*) FILTER (usage_state <> 'unknown')", 'count(*)')} AS annotation_rate, {share('count(*) FILTER (s > 0 AND spoken)', 'count(*) FILTER (s > 0)')} AS feedback_coverage FROM k GROUP BY 1, 2)
        SELECT * FROM g QUALIFY dimension <> 'context' OR row_number() OVER (PARTITION BY dimension ORDER BY traces DESC, value) <= 10""",
    "o3_agent_coverage": f"SELECT event_source, count(*) AS traces, count(agent) AS with_agent, {share('count(agent)', 'count(*)')} AS coverage FROM fx_log GROUP BY 1",
    "o4_rank_histogram": f"WITH {EVENTS} SELECT rank, count(*) FILTER (event = 'selected') AS selected, count(*) FILTER (event = 'used') AS used FROM ev WHERE event IN ('selected', 'used') GROUP BY 1",
    "o6_operation_performance": "\nUNION ALL\n".join(f"""SELECT op, {agent} AS agent, count(*) AS runs, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'timeout') AS timeouts,
        quantile_disc(duration_ms, 0.5)::DOUBLE AS p50, quantile_disc(duration_ms, 0.95)::DOUBLE AS p95, {share("count(*) FILTER (status = 'ok')", "count(*)")} AS success_rate FROM fx_oplog GROUP BY 1, 2""" for agent in ("NULL::VARCHAR", "coalesce(agent, '(null)')")),
    "o6_top_errors": "SELECT op, error_kind, count(*) AS n, max(started_at) AS last_at FROM fx_oplog WHERE error_kind IS NOT NULL GROUP BY 1, 2",
    "st8_daily_operations": "SELECT date_trunc('day', started_at)::TIMESTAMP AS day, op, count(*) AS runs, round(avg(duration_ms), 3) AS mean_ms FROM fx_oplog GROUP BY 1, 2",
    "o9_library_summary": "SELECT origin, state, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, round(avg(confidence_base), 6) AS mean_confidence, count(*) FILTER (confidence_base BETWEEN 0.4 AND 0.6) AS undecided FROM fx_chunks GROUP BY 1, 2",
    "o10_recurring_sparks": "SELECT chunk_id, count(*) AS retrievals FROM fx_usage WHERE event = 'retrieved' AND chunk_id IN (SELECT id FROM fx_chunks WHERE origin = 'spark') GROUP BY 1 HAVING count(*) >= 2",
    "o12_rule_counts": "SELECT verdict, count(*) AS n, count(DISTINCT chunk_id) AS rules, count(DISTINCT session_id) AS sessions FROM fx_validations GROUP BY 1",
    "o13_provenance": f"""WITH {EVENTS}, {OUTCOME}, a AS (SELECT chunk_id, ts, id, CASE WHEN target = 1 THEN 'ok' ELSE 'fail' END AS what FROM done UNION ALL SELECT chunk_id, ts, id, signal FROM fx_feedback)
        SELECT chunk_id, CAST(row_number() OVER w AS INTEGER) AS nth, id, what FROM a WINDOW w AS (PARTITION BY chunk_id ORDER BY ts DESC, id) QUALIFY row_number() OVER w <= 5""",
    "p7_tier_calibration": f"""SELECT CASE WHEN emitted_strength >= 0.65 THEN 'strong' WHEN emitted_strength >= 0.30 THEN 'medium' ELSE 'weak' END AS tier, count(*) AS n, count(abstain_reason) AS abstained,
        {share('count(*) FILTER (observed_outcome > 0)', 'count(observed_outcome)')} AS fail_rate FROM fx_verdicts GROUP BY 1""",
    "p8_verdict_calibration": f"""WITH x AS (SELECT least(9, CAST(floor(emitted_conf * 10) AS BIGINT)) AS bucket, emitted_conf, ({HIT})::INT AS hit FROM fx_verdicts WHERE emitted_conf IS NOT NULL AND observed_outcome IS NOT NULL AND emitted_valence <> 'neutral'),
        y AS (SELECT bucket, count(*) AS n, round(avg(emitted_conf), 6) AS claimed, round(avg(hit), 6) AS hit_rate FROM x GROUP BY 1) SELECT *, round(abs(claimed - hit_rate), 5) AS gap FROM y""",
    "a7_a8_evidence": f"WITH {EVENTS}, {COUNTS}, {EVIDENCE} SELECT * FROM evid",
    "a11_context_stats": f"WITH {EVENTS}, {OUTCOME}, {CONTEXT} SELECT * FROM ctx",
    "a14_verdict_outcomes": """WITH o AS (SELECT trace_id, arg_min(event, (ts, id)) AS event FROM fx_usage WHERE event IN ('task_ok', 'task_fail') GROUP BY 1)
        SELECT verdict_id, CASE WHEN event = 'task_ok' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS observed_outcome, CASE WHEN event = 'task_ok' AND emitted_valence = 'caution' THEN 'counterfactual_censored' ELSE 'observed' END AS provenance FROM fx_verdicts JOIN o USING (trace_id) WHERE observed_outcome IS NULL""",
    "c16_compacted": f"""SELECT trace_id, CASE WHEN NOT old THEN context_key END AS context_key, old AS compacted FROM (SELECT *, task_state IN ('completed', 'timed_out') AND ts < {AS_OF} - INTERVAL 20 DAYS AS old FROM fx_log)""",
    "c17_retained_operations": f"SELECT id, op, started_at FROM fx_oplog WHERE started_at >= {AS_OF} - INTERVAL 20 DAYS",
    "c19_dry_run": f"""WITH {EVENTS}, {FACTS}, {COUNTS}, {GOVERN}, {ARCHIVE}, {DECAY}, {LOSERS}, {LIFE}, {EXPIRE} SELECT step, count(*) AS n FROM (SELECT concat('archive:', reason) AS step FROM arch UNION ALL SELECT 'duplicate' FROM losers
        UNION ALL SELECT 'decay' FROM decay UNION ALL SELECT 'timed_out' FROM life WHERE became = 'timed_out' UNION ALL SELECT concat('expire:', becomes) FROM expire) GROUP BY 1""",
    "c5_c7_proposals": f"""WITH {GOVERN}, f AS (SELECT chunk_id, min(ts) AS created_at FROM fx_feedback WHERE signal = 'down' GROUP BY 1)
        SELECT chunk_id, round(s, 6) AS score, actors, f.created_at, c.state AS chunk_state, CASE WHEN NOT coalesce(c.state IN ('active', 'pending') AND c.origin <> 'spark' AND c.protected = 0, false) THEN 'rejected'
            WHEN round(s, 6) >= 2 AND actors >= 2 THEN 'accepted' WHEN round(s, 6) < 2 AND f.created_at < {AS_OF} - INTERVAL 30 DAYS THEN 'expired' ELSE 'pending' END AS becomes
        FROM gov JOIN f USING (chunk_id) LEFT JOIN fx_chunks c ON c.id = chunk_id WHERE round(s, 6) > 0""",
    "n9_calibrated": f"""WITH x AS (SELECT least(9, CAST(floor(emitted_strength * 10) AS BIGINT)) AS b, ({HIT})::INT AS hit FROM fx_verdicts WHERE observed_outcome IS NOT NULL AND outcome_provenance = 'observed' AND emitted_valence IN ('affirm', 'caution') AND emitted_conf IS NOT NULL),
        m AS (SELECT bucket, bucket / 10 AS lo, (bucket + 1) / 10 AS hi, count(hit) AS n, round(coalesce(avg(hit), (bucket + 0.5) / 10), 6) AS rate FROM range(10) r(bucket) LEFT JOIN x ON b = bucket WHERE (SELECT count(*) FROM x) >= 20 GROUP BY bucket) SELECT verdict_id, emitted_strength, coalesce(rate, emitted_strength) AS calibrated FROM fx_verdicts LEFT JOIN m ON least(9, CAST(floor(emitted_strength * 10) AS BIGINT)) = bucket""",
    "r16_lexical_recall": f"WITH {recalled(vectors=False)} SELECT query_id, rank, chunk_id, score FROM rec",
    "r9_packed": f"WITH RECURSIVE {recalled()}, {packs(1200)} SELECT * FROM pack",
    "r19_hook_recall": f"WITH RECURSIVE {recalled(gate=0.40)}, {packs(4000, closed=False)} SELECT query_id, pos, chunk_id, tokens, pass FROM pack WHERE pos <= 5",
    "r11_trimmed": f"WITH RECURSIVE {recalled()}, {packs(1200, trim=True)} SELECT * FROM pack",
    "r10_blocks": f"""WITH RECURSIVE {blocks("SELECT id FROM fx_chunks WHERE state <> 'archived' AND origin <> 'spark' AND embed_version >= 1")},
        near AS (SELECT src, list(dst ORDER BY dst) AS deps, count(*) FILTER (u.id IS NULL) AS lost, sum(cost) AS cost FROM hard LEFT JOIN usable u ON u.id = dst GROUP BY 1)
        SELECT id, 'closure' AS mode, array_to_string(list_transform(parts, lambda x: x.id), ',') AS chunks, coalesce(list_sum(list_transform(parts, lambda x: x.cost)), 0)::BIGINT AS tokens, reason AS skip_reason FROM block
        UNION ALL SELECT c.id, 'direct', CASE WHEN lost > 0 THEN '' ELSE array_to_string(list_prepend(c.id, coalesce(deps, [])), ',') END, CASE WHEN lost > 0 THEN 0 ELSE token_count + coalesce(cost, 0) END, CASE WHEN lost > 0 THEN 'hard_dep_unavailable' END
        FROM fx_chunks c LEFT JOIN near ON near.src = c.id WHERE c.id IN (SELECT id FROM block)""",
    "t10_lexical_tokens": f"""SELECT query_id, array_to_string(list_transform(list_filter(list_transform(words, lambda w, i: {{'w': w, 'i': i}}), lambda e: list_position(words, e.w) = e.i)[1:32], lambda e: e.w), ' ') AS words FROM (SELECT query_id, {ASKED} AS words FROM fx_queries)""",
    "t5_t7_situations": r"""WITH a AS (SELECT id, lower(trim(coalesce(stage, ''), ' ')) AS stage, trim(coalesce(last_error, ''), ' ') AS e, regexp_extract(coalesce(file_context, ''), '([^ ,\t\n\r]+)', 1) AS token FROM fx_situations),
        b AS (SELECT id, stage, regexp_extract(e, '[Ee]([0-9]{3,})', 1) AS code, regexp_extract(e, '(?:^|[^\p{L}\p{N}_])([\p{L}\p{N}_]*(?:Error|Exception))(?:$|[^\p{L}\p{N}_])', 1) AS name, lower(e) AS low, regexp_extract(token, '\.([^.]*)$', 1) AS ext, regexp_extract(token, '([^/\\]*)$', 1) AS base FROM a),
        c AS (SELECT id, concat('stage=', stage, '|err=', CASE WHEN code <> '' THEN concat('E', code) WHEN name <> '' THEN name WHEN contains(low, 'panic') THEN 'panic' ELSE substr(regexp_extract(low, '(\p{L}+)', 1), 1, 24) END,
            '|file=', lower(CASE WHEN ext <> '' AND strlen(ext) <= 8 THEN ext ELSE base END)) AS signature FROM b)
        SELECT id, signature, sha256(signature) AS context_key, len(list_filter(string_split(signature, '|'), lambda p: NOT suffix(p, '='))) > 0 AS has_signal FROM c""",
    "t15_t27_message_flags": r"""WITH m AS (SELECT id, text, lower(text) AS low, regexp_extract(lower(text), '([1-5][0-9][0-9])', 1) AS code FROM fx_messages)
        SELECT id, length(regexp_replace(text, '\x1b\[[^A-Za-z]*[A-Za-z]', '', 'g')) AS clean_length, trim(text, ' ') = 'Exit code 1' OR regexp_matches(text, 'doesn''t want to proceed|was rejected|user denied|Permission for this action was denied|auto mode classifier') AS noise,
            regexp_matches(low, '(?:不对|错了|搞错|重做)(?:[^一-鿿]|$)|不是这样|理解错|不应该|应该是|不要这样|别这样|重新来|还是不行|还是报错|没有用|不是我要的|that''s wrong|that is wrong|not what i|you misunderstood|doesn''t work|still broken|still failing|incorrect') AND length(text) <= 800 AND NOT starts_with(ltrim(text, ' '), 'This session is being continued') AS correction,
            regexp_matches(low, '未做任何代码改动|未做代码改动|没有做任何代码改动|无代码改动|no code changes were made|no code was changed|made no changes') AS status_report,
            CASE WHEN regexp_matches(low, 'arrearage|欠费') THEN 'embedding_arrearage' WHEN regexp_matches(low, 'no such file|text file busy') THEN 'spawn_failed' WHEN regexp_matches(low, 'timeout|deadline') THEN 'llm_timeout' WHEN regexp_matches(low, 'status: [45]|http error') THEN 'llm_http_error' WHEN regexp_matches(low, 'locked|busy') THEN 'db_locked' ELSE 'other' END AS error_kind,
            CASE WHEN regexp_matches(low, 'status: 429|429 ') THEN 'rate_limited' WHEN code >= '500' THEN 'http_5xx' WHEN code >= '400' THEN 'http_4xx' WHEN code <> '' THEN 'error' WHEN regexp_matches(low, 'transport|connection|tls') THEN 'transport' ELSE 'error' END AS http_bucket,
            sha256(concat_ws(':', id, '0', CAST(length(text) AS VARCHAR), text)) AS event_id FROM m""",
    "t24_citations": r"""WITH c AS (SELECT id, regexp_extract_all(lower(text), 'chunk:([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})', 1) AS l FROM fx_messages)
        SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS cited FROM c WHERE len(l) > 0""",
    "t30_grounded_signals": """WITH c AS (SELECT id, list_filter(string_split(lower(trigger_desc), ' '), lambda w: length(w) >= 4 AND contains(lower(content), w)) AS l FROM fx_chunks)
        SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS signals FROM c""",
    "f12_blacklisted": "SELECT id, content_hash FROM fx_chunks WHERE state <> 'archived' AND content_hash IN (SELECT content_hash FROM fx_chunks WHERE state = 'archived')",
    "v2_conflicting_feedback": "SELECT trace_id, chunk_id, count(*) AS signals FROM fx_feedback GROUP BY 1, 2 HAVING count(DISTINCT signal) > 1",
    "v3_attributed": f"""WITH {EVENTS} SELECT id, CASE WHEN chunk_id NOT IN (SELECT id FROM fx_chunks) THEN 'missing_chunk' WHEN (trace_id, chunk_id) NOT IN (SELECT (trace_id, chunk_id) FROM ev WHERE event = 'selected') THEN 'not_selected' END AS problem FROM ev WHERE event = 'used'""",
    "a19_evolve_readiness": f"""WITH {GOVERN}, {LIFE}, f AS (SELECT chunk_id, min(ts) AS at FROM fx_feedback WHERE signal = 'down' GROUP BY 1),
        p AS (SELECT NOT coalesce(c.state IN ('active', 'pending') AND c.origin <> 'spark' AND c.protected = 0, false) AS gone, round(s, 6) >= 2 AND actors >= 2 AS ready, round(s, 6) < 2 AND f.at < {AS_OF} - INTERVAL 30 DAYS AS old FROM gov JOIN f USING (chunk_id) LEFT JOIN fx_chunks c ON c.id = chunk_id WHERE round(s, 6) > 0),
        a AS (SELECT count(*) AS new_traces, CAST(coalesce(floor((epoch_us({AS_OF}) - epoch_us(min(ts))) / 3600e6), 0) AS BIGINT) AS oldest_hours FROM life JOIN fx_log USING (trace_id) WHERE distill_state = 'new'),
        b AS (SELECT count(*) FILTER (NOT gone AND NOT ready AND NOT old) AS pending, count(*) FILTER (NOT gone AND ready) AS ready FROM p)
        SELECT *, CASE WHEN new_traces >= 5 THEN 'new_traces' WHEN new_traces > 0 AND oldest_hours >= 6 THEN 'aged' WHEN pending >= 3 THEN 'pending_proposals' WHEN ready >= 1 THEN 'ready_proposal' END AS reason FROM a CROSS JOIN b""",
    "l2_corrections": r"""WITH m AS (SELECT *, CASE WHEN role = 'assistant' THEN substr(text, 1, 200) END AS said FROM fx_messages),
        w AS (SELECT id, role, text, last_value(said IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous, first_value(said IGNORE NULLS) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM m WINDOW o AS (PARTITION BY conv_id ORDER BY turn, text))
        SELECT id, previous, next FROM w WHERE role = 'user' AND length(text) <= 800 AND NOT starts_with(ltrim(text, ' '), 'This session is being continued')
          AND regexp_matches(lower(text), '(?:不对|错了|搞错|重做)(?:[^一-鿿]|$)|不是这样|理解错|不应该|应该是|不要这样|别这样|重新来|还是不行|还是报错|没有用|不是我要的|that''s wrong|that is wrong|not what i|you misunderstood|doesn''t work|still broken|still failing|incorrect')""",
    "l15_session_summaries": """SELECT conv_id, count(*) AS messages, substr(arg_max(text, (turn, text)) FILTER (role = 'user' AND text IS NOT NULL), 1, 200) AS asked, substr(arg_max(text, (turn, text)) FILTER (role = 'assistant' AND text IS NOT NULL), 1, 200) AS answered FROM fx_messages GROUP BY 1""",
    "o7_o8_daily_kpis": f"""WITH x AS (SELECT CAST(ts AS DATE) AS day, count(*) AS traces, {share("count(*) FILTER (outcome = 'ok')", 'count(outcome)')} AS success_rate, {share("count(*) FILTER (task_state = 'timed_out')", 'count(*)')} AS timeout_rate FROM fx_log GROUP BY 1)
        SELECT CAST(a.day AS TIMESTAMP) AS day, a.traces, a.success_rate, a.timeout_rate, round(a.success_rate - b.success_rate, 3) AS success_change, round(a.timeout_rate - b.timeout_rate, 3) AS timeout_change FROM x a ASOF LEFT JOIN x b ON a.day - 7 >= b.day""",
}
