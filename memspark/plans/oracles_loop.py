"""DuckDB SQL of distilling, rules in use, requests, the critic, and what health adds, written apart from the DataFrame code."""

from __future__ import annotations

from memspark.plans.oracles import AS_OF, ARCHIVE, BM25, CONTEXT, COUNTS, DECAY, EVENTS, EVIDENCE, FACTS, FOLD, GOVERN, HIT, LIFE, OUTCOME, SQL, entity_rows, packs, ranked, recalled, share


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


BLANK = r"\s\x{85}\p{Z}"
QUOTE = "`\"''“”‘’"
VALUE = rf"[^{BLANK}{QUOTE}\x{{3000}}-\x{{303f}}\x{{4e00}}-\x{{9fff}}\x{{ff00}}-\x{{ffef}},;]"
LABELLED = [
    (r"(?i)(?:^|[^A-Za-z0-9])(?:password|passwd)", "[:=：]", 1, False), (r"(?i)(?:^|[^A-Za-z0-9])pwd", "[:=：]", 4, False),
    (r"(?i)(?:^|[^A-Za-z0-9])(?:client_secret|secret_key|access_key|api_key|api-key|apikey|secret|token)", "[:=：]", 8, True), ("(?:密码|口令)", "[是为:：=]", 4, False), ("(?:密钥|秘钥|私钥|令牌)", "[是为:：=]", 8, True),
]


def clean(x: str) -> str:
    """Found labels with their values are replaced one after the other, those whose value looks like a secret."""
    for prefix, least in (("sk-", 20), ("AKIA", 16), ("ghp_", 36)):
        x = rf"regexp_replace({x}, '(^|[^A-Za-z0-9_-]){prefix}[A-Za-z0-9_-]{{{least},}}', '\1[REDACTED]', 'g')"
    x = rf"regexp_replace({x}, '(?i)(bearer )[^{BLANK}{QUOTE}]+', '\1[REDACTED]', 'g')"
    for label, sep, least, mixed in LABELLED:
        head = rf"{label}[ \t]*{sep}[ \t]*(?:{sep}[ \t]*)?[{QUOTE}]?"
        value = f"regexp_extract(m, '^(?:{head})({VALUE}+)$', 1)"
        some = rf"length({value}) >= {least} AND NOT regexp_matches({value}, '^[$\x7b<%\[]|/')" + (f" AND regexp_matches({value}, '[^A-Za-z]')" if mixed else "")
        found = f"list_filter(regexp_extract_all(t, '{head}{VALUE}+'), lambda m: {some})"
        x = f"list_transform([{x}], lambda t: list_reduce(list_prepend(t, {found}), lambda acc, m: replace(acc, m, concat(regexp_extract(m, '^({head}){VALUE}+$', 1), '[REDACTED]'))))[1]"
    return x


def action(x: str) -> str:
    bad = f"regexp_matches(lower({x}), 'ignore all previous instructions|ignore previous instructions?|system prompt[:：]|you are now a different|you are now a new')"
    return f"CASE WHEN {bad} THEN 'discard' WHEN {clean(x)} <> {x} THEN 'redact' WHEN {x} IS NOT NULL THEN 'allow' END"


def tok(x: str) -> str:
    return f"CAST(coalesce(ceil(strlen({x}) / 4.0), 0) AS BIGINT)"


GONE = "gone AS (SELECT DISTINCT content_hash AS hash FROM fx_chunks WHERE state = 'archived')"
PRESENT = "present AS (SELECT content_hash AS hash, arg_min(id, (created_at, id)) AS existing FROM fx_chunks WHERE origin <> 'spark' AND state IN ('active', 'pending') GROUP BY 1)"
DIST = rf"""raw AS (SELECT *, {strip('coalesce(nomination, output_summary)')} AS t, {strip("coalesce(query, '')")} AS q FROM fx_distill),
    said AS (SELECT *, substr(CASE WHEN q <> '' THEN q ELSE list_filter(list_transform(string_split(t, chr(10)), lambda l: {strip('l')}), lambda l: strlen(l) > 10)[1] END, 1, 80) AS trigger_desc FROM raw
        WHERE t <> '' AND (nomination IS NOT NULL OR NOT regexp_matches(lower(t), '未做任何代码改动|未做代码改动|没有做任何代码改动|无代码改动|no code changes were made|no code was changed|made no changes'))),
    dist AS (SELECT id AS source_id, CASE WHEN nomination IS NULL AND outcome = 'fail' THEN concat('Avoid: ', t) ELSE t END AS content, trigger_desc, CASE WHEN outcome = 'fail' AND q <> '' THEN substr(q, 1, 60) END AS anti_trigger_desc,
        nullif(array_to_string(list_filter(string_split_regex(trigger_desc, '\s+'), lambda w: w <> '')[1:3], ' '), '') AS skill_name FROM said)"""
PROMPT = f"""place AS (SELECT *, row_number() OVER (PARTITION BY context_key ORDER BY priority DESC, ts, id) AS nth FROM fx_distill WHERE context_key IS NOT NULL),
    near AS (SELECT a.id, b.query, b.output_summary, b.outcome FROM place a JOIN place b ON b.context_key = a.context_key AND b.id <> a.id AND b.nth <= 5 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.nth) <= 4),
    rel AS (SELECT id, CAST(sum({tok('query')} + {tok('output_summary')} + {tok('outcome')}) AS BIGINT) AS n FROM near GROUP BY 1),
    prompt AS (SELECT d.id, {tok('query')} + {tok('output_summary')} + {tok('nomination')} + coalesce(n, 0) AS prompt_tokens FROM fx_distill d LEFT JOIN rel ON rel.id = d.id)"""
USABLE = f"""sig AS (SELECT DISTINCT id, state, s AS signal FROM (SELECT id, state, lower({strip("regexp_replace(" + strip('part') + ", '^(sig:)+', '')")}) AS s FROM (SELECT id, state, unnest(string_split(signals, '|')) AS part FROM fx_rules))
    WHERE length(s) >= CASE WHEN regexp_matches(s, '[一-鿿]') THEN 3 ELSE 4 END AND s NOT IN ('error', 'errors', 'failed', 'failure', 'warning', 'build', 'test', 'tests', 'run', 'git', 'npm', 'cargo', 'node', 'python', 'python3', 'bash', 'sudo', 'curl', 'docker', 'make', 'http', 'https',
        'file', 'files', 'path', 'code', 'true', 'false', 'null', '错误', '失败', '报错', '问题', 'cargo test', 'cargo build', 'cargo run', 'cargo clippy', 'pytest', 'npm test', 'npm run build', 'npm run dev', 'npm install', 'npm ci', 'yarn build', 'pnpm build', 'git status', 'git diff',
        'git commit', 'git push', 'git pull', 'git log', 'tsc', 'python -m pytest', 'go test', 'go build', 'make test'))"""
CAL = SQL["c18_calibration"].replace("WITH x AS", "calx AS", 1).replace("SELECT * FROM m", "").replace("count(*) FROM x)", "count(*) FROM calx)").replace("LEFT JOIN x ON", "LEFT JOIN calx ON").replace("m AS (SELECT bucket", "cal AS (SELECT bucket")
POINTS = f"""{recalled(spread=False)}, pts AS (SELECT query_id, chunk_id, CASE WHEN against OR fail_origin OR w_context < 0 THEN 'caution' WHEN t >= 0.5::DOUBLE AND round(w_confidence + w_context + w_activation, 6) > 0 THEN 'affirm' ELSE 'neutral' END AS valence,
        round(greatest(0.0, least(1.0, ((w_content + w_trigger + w_lexical) + (w_confidence + w_context + w_activation)) * CASE WHEN state = 'pending' THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN against THEN 0.6::DOUBLE ELSE 1 END + 1e-9::DOUBLE)), 6) AS strength FROM parts),
    con AS (SELECT p.*, (p.chunk_id, q.context_key) IN (SELECT (chunk_id, context_key) FROM ctx) AS signed, p.chunk_id IN (SELECT chunk_id FROM done) AS seen FROM (SELECT * FROM pts WHERE strength >= 0.25::DOUBLE QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, chunk_id) <= 8) p JOIN fx_queries q USING (query_id))"""
HARD = "hard AS (SELECT DISTINCT src AS a, dst AS b FROM fx_deps WHERE kind = 'hard')"
SWEPT = " UNION ALL ".join(f"SELECT '{name}' AS setting, {a!r}::DOUBLE AS fa, {s!r}::DOUBLE AS fs" for name, a, s in (("off", 0.0, 1.0), ("default", 0.08 / 0.08, 1.0), ("heavy", 1.0 / 0.08, 1.0), ("spread_off", 1.0, 0.0), ("spread_heavy", 1.0, 1.0 / 0.10)))
PROPOSED = f"""prop AS (SELECT chunk_id, f.at AS created_at, CASE WHEN NOT coalesce(c.state IN ('active', 'pending') AND c.origin <> 'spark' AND c.protected = 0, false) THEN 'rejected' WHEN round(s, 6) >= 2 AND actors >= 2 THEN 'accepted' WHEN round(s, 6) < 2 AND f.at < {AS_OF} - INTERVAL 30 DAYS THEN 'expired' ELSE 'pending' END AS becomes
    FROM gov JOIN (SELECT chunk_id, min(ts) AS at FROM fx_feedback WHERE signal = 'down' GROUP BY 1) f USING (chunk_id) LEFT JOIN fx_chunks c ON c.id = chunk_id WHERE round(s, 6) > 0)"""
FAMILY = r"""(list_filter(list_transform(string_split_regex(input, '[&|;\n()]'), lambda g: list_filter(list_transform(list_filter(string_split_regex(g, '\s+'), lambda w: w <> '' AND NOT starts_with(w, '-') AND NOT contains(w, '=') AND NOT regexp_matches(w, '^[0-9]+$')), lambda w: lower(regexp_extract(w, '([^/]*)$', 1))),
        lambda p: p NOT IN ('sudo', 'timeout', 'env', 'nohup', 'time', 'exec', 'command'))[1]), lambda p: p IS NOT NULL AND regexp_matches(p, '^[a-z0-9_.-]+$') AND p NOT IN ('cd', 'echo', 'cat', 'ls', 'head', 'tail', 'true', 'false', 'set', 'export', 'sleep', 'printf', 'wc', 'sort', 'uniq', 'cut', 'tr', 'grep', 'sed', 'awk', 'xargs', 'tee', 'rm', 'cp', 'mv', 'mkdir', 'touch', 'pwd',
        'which', 'test', 'for', 'while', 'do', 'done', 'if', 'then', 'fi', 'else', 'bash', 'sh', 'source', 'until', 'let', 'read', 'find', 'ps', 'kill', 'pgrep')))"""
QUOTED = "|".join(rf"{q}[^{q}\s]*(\s?)[^{q}]*(?:{q}|$)" for q in ('"', "''", "`"))
CALLS = rf"""lines AS (SELECT *, list_filter(list_transform(string_split(result, chr(10)), lambda l: {strip('l')}), lambda l: l <> '' AND NOT starts_with(l, 'Exit code') AND regexp_matches(lower(l), 'error|failed|failure|exception|panicked|not found|denied|refused|cannot|can''t|invalid|unable|timeout|timed out|失败|错误|异常'))[1] AS line,
        {FAMILY} AS many FROM fx_transcript WHERE kind = 'tool'),
    words AS (SELECT *, string_split_regex(translate(regexp_replace(array_to_string(list_filter(string_split_regex(line, '\s+'), lambda w: NOT regexp_matches(w, '[/\\]')), ' '), '{QUOTED}', '\1\2\3', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\s+') AS ws FROM lines),
    cut_off AS (SELECT *, substr(array_to_string(list_transform(list_filter(ws, lambda w: w <> ''), lambda w: CASE WHEN regexp_matches(w, '^[a-z].*[0-9]') THEN w ELSE regexp_replace(w, '[0-9]', '#', 'g') END), ' '), 1, 80) AS short FROM words),
    calls AS (SELECT id, session_id, ts, failed, result, list_filter(many, lambda p, i: list_position(many, p) = i) AS family, CASE WHEN length(short) >= 8 THEN concat('sig:', short) END AS sig FROM cut_off)"""


def clipped(x: str, most: int) -> str:
    return f"CASE WHEN length({clean(strip(x))}) <= {most} THEN {clean(strip(x))} ELSE concat(substr({clean(strip(x))}, 1, {most}), '…') END"


def labelled(label: str, x: str) -> str:
    return f"CASE WHEN {strip(x)} <> '' THEN concat('[{label}] ', {strip(x)}) END"


TABLES = ("chunks", "usage", "feedback", "log", "deps", "episodes", "validations", "verdicts", "oplog")

CLUSTERS = """fan AS (SELECT signal, min(id) AS centre FROM fx_episodes GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8 AND count(DISTINCT session_id) >= 2),
        v AS (SELECT id, session_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM fx_episodes JOIN fx_episode_vectors USING (id)),
        e AS (SELECT centre AS a, id AS b FROM fx_episodes JOIN fan USING (signal) WHERE id <> centre
            UNION ALL SELECT x.id, y.id FROM v x JOIN v y ON x.id < y.id AND x.session_id <> y.session_id AND round(list_cosine_similarity(x.vec, y.vec), 6) >= 0.82),
        both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b), comp AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY 1),
        wide AS (SELECT cluster, least(count(*), 6)::BIGINT AS members FROM comp JOIN fx_episodes USING (id) GROUP BY 1 HAVING count(DISTINCT session_id) >= 2),
        clusters AS (SELECT id, cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY ts, id) AS INTEGER) AS nth, members FROM comp JOIN fx_episodes USING (id) JOIN wide USING (cluster) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY ts, id) <= 6)"""
TRACED = f"""{recalled()}, {packs(1200)}, sparks AS ({SQL['r14_spark_hits'].replace('WITH c AS', 'WITH sc AS').replace('t AS (', 'st AS (', 1).replace('FROM c UNION ALL SELECT * FROM t)', 'FROM sc UNION ALL SELECT * FROM st)')}),
    traced AS (SELECT l.query_id, l.chunk_id, 'retrieved' AS event, l.rank, l.score, CASE WHEN p.pos IS NULL THEN coalesce(l.reason, 'budget') END AS skip_reason FROM list_of l LEFT JOIN pack p ON p.query_id = l.query_id AND p.chunk_id = l.chunk_id
        UNION ALL SELECT p.query_id, p.chunk_id, 'selected', p.pos, l.score, NULL FROM pack p JOIN list_of l ON l.query_id = p.query_id AND l.chunk_id = p.seed
        UNION ALL SELECT query_id, chunk_id, 'spark', rank, sim, NULL FROM sparks)"""
HUMAN = r"""regexp_replace(text, '^\s+', '') <> '' AND NOT starts_with(regexp_replace(text, '^\s+', ''), '<') AND NOT starts_with(regexp_replace(text, '^\s+', ''), '[Request interrupted')"""
SESSION = rf"""sess AS (SELECT concat('s', conv_id) AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS INTEGER) AS seq, * FROM (
    SELECT conv_id, turn, 0 AS k, 'user' AS kind, id AS uuid, NULL::VARCHAR AS name, NULL::VARCHAR AS input, NULL::BOOLEAN AS failed, text FROM fx_messages WHERE role = 'user' AND {HUMAN}
    UNION ALL SELECT conv_id, turn, 0, 'assistant', '', NULL, NULL, NULL, text FROM fx_messages WHERE role = 'assistant' AND text IS NOT NULL
    UNION ALL SELECT conv_id, turn, 1, 'tool', '', CASE WHEN turn % 3 = 0 THEN 'Read' ELSE 'Bash' END, CASE WHEN turn % 3 = 0 THEN concat('Read src/m', turn, '.rs') ELSE concat('cd app && make t', turn) END, (conv_id + turn) % 3 <> 0, coalesce(text, '') FROM fx_messages WHERE role = 'assistant'))"""
LOGS_NOTE = f"CASE WHEN stuck THEN concat('screening_timeout:', coalesce(run_id, 'unknown')) WHEN late THEN 'no_record_timeout' END"
CURED_LOGS = f"""lg AS (SELECT *, distill_state = 'screening' AND locked_at < {AS_OF} - INTERVAL 30 MINUTES AS stuck, distill_state = 'open' AND ts < {AS_OF} - INTERVAL 14 DAYS AS late FROM fx_distill),
    lh AS (SELECT id, ts, CASE WHEN stuck THEN 'failed' WHEN late THEN 'discarded' ELSE distill_state END AS distill_state, {LOGS_NOTE} AS note, attempts + CASE WHEN stuck THEN 1 ELSE 0 END AS attempts FROM lg),
    cured AS (SELECT id, distill_state, coalesce(note, CASE WHEN old THEN 'compacted' END) AS note, attempts, old AS compacted FROM (SELECT *, distill_state IN ('distilled', 'discarded', 'failed') AND ts < {AS_OF} - INTERVAL 20 DAYS AS old FROM lh))"""
CURATED = f"""{EVENTS}, {FACTS}, {COUNTS}, {GOVERN}, {ARCHIVE}, c1 AS (SELECT c.* EXCLUDE (state), CASE WHEN a.id IS NULL THEN c.state ELSE 'archived' END AS state, a.reason AS state_reason FROM fx_chunks c LEFT JOIN arch a ON a.id = c.id),
    dup AS (SELECT id, concat('duplicate:', first_value(id) OVER w) AS reason FROM c1 WHERE state IN ('active', 'pending') AND origin <> 'spark' WINDOW w AS (PARTITION BY content_hash ORDER BY protected DESC, confidence_base DESC, created_at, id) QUALIFY row_number() OVER w > 1),
    c2 AS (SELECT c1.* EXCLUDE (state, state_reason), CASE WHEN d.id IS NULL THEN c1.state ELSE 'archived' END AS state, coalesce(d.reason, c1.state_reason) AS state_reason FROM c1 LEFT JOIN dup d ON d.id = c1.id),
    fell AS (SELECT d.id, d.confidence FROM ({DECAY[len('decay AS ('):-1]}) d JOIN c2 ON c2.id = d.id WHERE c2.state IN ('active', 'pending')),
    grew AS (SELECT c2.id, CASE WHEN open_contradictions > 0 AND c2.state = 'active' AND NOT m.directive THEN 'suspended' WHEN transferable AND c2.state = 'pending' AND c2.origin <> 'spark' THEN 'promoted' END AS turned
        FROM c2 JOIN fx_rule_meta m ON m.id = c2.id JOIN ({SQL['c12_l9_l10_supports']}) s ON s.chunk_id = c2.id WHERE turned IS NOT NULL),
    final AS (SELECT c2.id, CASE turned WHEN 'promoted' THEN 'active' WHEN 'suspended' THEN 'pending' ELSE c2.state END AS state, CASE turned WHEN 'promoted' THEN 'validated:transferable' WHEN 'suspended' THEN 'suspended:contradicted' ELSE c2.state_reason END AS state_reason,
        coalesce(f.confidence, confidence_base) AS confidence FROM c2 LEFT JOIN fell f ON f.id = c2.id LEFT JOIN grew g ON g.id = c2.id)"""
GOVERNED = """asked AS (SELECT r.id AS rid, r.chunk_id, r.action, c.content_hash AS h, row_number() OVER (PARTITION BY c.content_hash ORDER BY r.ts, r.id) AS nth FROM fx_requests r JOIN fx_chunks c ON c.id = r.chunk_id),
    steps(h, nth, ms, invalid, rid, failure, becomes) AS (
        SELECT c.content_hash, 0::BIGINT, list({'id': c.id, 'origin': c.origin, 'state': c.state, 'reason': NULL::VARCHAR} ORDER BY c.id), false, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM fx_chunks c WHERE c.id IN (SELECT chunk_id FROM asked) GROUP BY 1
        UNION ALL SELECT h, nth, list_transform(ms, lambda m: {'id': m.id, 'origin': m.origin, 'state': CASE WHEN m.id = chunk_id AND failure IS NULL THEN becomes WHEN m.id <> chunk_id AND void THEN 'archived' ELSE m.state END,
            'reason': CASE WHEN m.id = chunk_id AND failure IS NULL AND NOT idle THEN CASE action WHEN 'invalidate' THEN 'invalidated' WHEN 'approve' THEN 'approved' ELSE action END WHEN m.id <> chunk_id AND void THEN 'invalidated:same_hash' ELSE m.reason END}),
            void OR (invalid AND NOT (failure IS NULL AND action = 'restore' AND coalesce(own.reason, '') LIKE 'invalidated%')), rid, failure, becomes
        FROM (SELECT *, failure IS NULL AND action = 'invalidate' AS void, CASE WHEN failure IS NULL THEN CASE WHEN action IN ('approve', 'restore') THEN 'active' ELSE 'archived' END END AS becomes FROM (
            SELECT *, action IN ('approve', 'restore') AND own.state = 'active' AS idle, CASE WHEN own.origin = 'spark' AND action IN ('approve', 'archive') THEN 'spark_lifecycle' WHEN (action = 'approve' AND own.state = 'archived') OR (action = 'restore' AND own.state = 'pending') THEN 'invalid_state' END AS failure FROM (
                SELECT a.*, s.ms, s.invalid, list_filter(s.ms, lambda m: m.id = a.chunk_id)[1] AS own FROM steps s JOIN asked a ON a.h = s.h AND a.nth = s.nth + 1))))"""
SNAPS = """dayly AS (SELECT CAST(started_at AS DATE) AS day, max(started_at) AS ts, count(*) AS runs, count(*) FILTER (status <> 'ok') AS errors, sum(duration_ms) AS ms FROM fx_oplog GROUP BY 1),
    sofar AS (SELECT ts, sum(runs) OVER w AS runs, sum(errors) OVER w AS errors, sum(ms) OVER w AS ms, row_number() OVER w AS nth FROM dayly WINDOW w AS (ORDER BY day)),
    thin(nth, last) AS (SELECT nth, ts FROM sofar WHERE nth = 1 UNION ALL SELECT s.nth, CASE WHEN s.ts - t.last >= INTERVAL 20 HOURS THEN s.ts ELSE t.last END FROM thin t JOIN sofar s ON s.nth = t.nth + 1),
    kept AS (SELECT s.* FROM sofar s JOIN thin t ON t.nth = s.nth AND t.last = s.ts),
    snaps AS (SELECT ts, 'runs' AS name, runs::DOUBLE AS value FROM kept UNION ALL SELECT ts, 'errors', errors::DOUBLE FROM kept UNION ALL SELECT ts, 'mean_ms', round(ms / runs, 3) FROM kept)"""
ACTED = f"""{USABLE}, hit AS (SELECT a.id AS action, s.id AS chunk_id, s.state, CAST(sum(length(signal)) AS BIGINT) AS score, string_agg(signal, '|' ORDER BY signal) AS signals FROM fx_actions a JOIN sig s ON s.state <> 'archived' AND contains(lower(a.text), s.signal) GROUP BY 1, 2, 3),
        best AS (SELECT * FROM hit WHERE score >= 6 QUALIFY row_number() OVER (PARTITION BY action ORDER BY score DESC, state = 'active' DESC, chunk_id) = 1),
        acted AS (SELECT action AS id, chunk_id, score, signals, session_id, ts, row_number() OVER (PARTITION BY chunk_id, session_id ORDER BY ts, action) = 1 AS shown FROM best JOIN fx_actions a ON a.id = action)"""
LOOP_SQL = {
    "l7_judged": """SELECT o.id, chunk_id, CASE CAST(substr(o.id, 2) AS BIGINT) % 6 WHEN 0 THEN 'supported' WHEN 2 THEN 'contradicted' WHEN 3 THEN CASE WHEN raw LIKE '[fence]%' THEN 'unknown' END WHEN 4 THEN 'irrelevant' ELSE 'unknown' END AS verdict
        FROM fx_observations o JOIN fx_chunks c ON c.id = o.chunk_id WHERE c.state <> 'archived' AND verdict = 'observed'""",
    "l6_births": f"""WITH RECURSIVE {CLUSTERS}, members AS (SELECT cluster AS key, project FROM clusters JOIN fx_episodes USING (id)), src AS (SELECT key, string_agg(DISTINCT project, ',' ORDER BY project) AS source_projects FROM members GROUP BY 1),
        r AS (SELECT key, source_projects, CAST(substr(key, 2) AS BIGINT) AS n FROM src)
        SELECT key, concat('keep ', n) AS content, concat('a', n, '|b') AS signals, 'one two three' AS skill_name, concat('a', n, ' | b') AS trigger_desc, source_projects, 0.55::DOUBLE AS confidence FROM r WHERE n % 4 = 0
        UNION ALL SELECT key, concat('also ', n), '', concat('when ', n), concat('when ', n), source_projects, 0.55 FROM r WHERE n % 4 = 0 UNION ALL SELECT key, concat('lone ', n), 'x', 'x', 'x', source_projects, 0.55 FROM r WHERE n % 4 = 1""",
    "l11_revisions": """WITH o AS (SELECT chunk_id, list_sort(list_distinct(list(project))) AS more FROM fx_validations WHERE verdict = 'contradicted' AND resolved_at IS NULL GROUP BY 1),
        x AS (SELECT chunk_id, more, CAST(substr(chunk_id, 2) AS BIGINT) AS n, version, CASE WHEN source_projects IS NULL THEN [] ELSE string_split(source_projects, ',') END AS src FROM o JOIN fx_rule_meta m ON m.id = chunk_id WHERE NOT directive AND CAST(substr(chunk_id, 2) AS BIGINT) IN (SELECT n FROM fx_replies))
        SELECT chunk_id, CASE n % 5 WHEN 1 THEN 'retire' WHEN 2 THEN 'keep' ELSE 'revise' END AS action, CASE WHEN n % 5 IN (0, 1) THEN 'archived' END AS becomes, CASE n % 5 WHEN 0 THEN 'superseded' WHEN 1 THEN 'retired' END AS why, CASE WHEN n % 5 = 0 THEN concat('better ', n) END AS content,
            CASE WHEN n % 5 = 0 THEN version + 1 END AS version, CASE WHEN n % 5 = 0 THEN array_to_string(list_concat(src, list_filter(more, lambda p: NOT list_contains(src, p))), ',') END AS source_projects FROM x WHERE n % 5 <> 3""",
    "j13_verdict_snapshots": f"WITH RECURSIVE {SNAPS} SELECT verdict_id, s.ts, s.value AS runs FROM fx_verdicts v ASOF LEFT JOIN (SELECT * FROM snaps WHERE name = 'runs') s ON v.emitted_at >= s.ts",
    "o8_deltas": f"""WITH RECURSIVE {SNAPS}, x AS (SELECT d AS days, name, arg_max(value, ts) AS value, arg_max(value, ts) FILTER (ts <= {AS_OF} - to_days(d)) AS before FROM snaps CROSS JOIN (VALUES (1), (7), (60)) v(d) WHERE ts <= {AS_OF} GROUP BY 1, 2) SELECT *, round(value - before, 6) AS delta FROM x""",
    "p9_replay": f"""WITH {EVENTS}, known AS (SELECT u.chunk_id, min(o.ts) AS known_at FROM ev u JOIN ev o ON o.trace_id = u.trace_id AND o.event IN ('task_ok', 'task_fail') WHERE u.event = 'used' GROUP BY 1),
        seen AS (SELECT v.verdict_id, round(max(similarity) - min(similarity), 6) AS d, count(*) FILTER (known_at < emitted_at) AS evident FROM fx_verdicts v JOIN ev s ON s.trace_id = v.trace_id AND s.event = 'selected' LEFT JOIN known USING (chunk_id) GROUP BY 1),
        a AS (SELECT v.verdict_id, emitted_strength AS strength, coalesce(d, 0.0) AS d, coalesce(evident, 0) AS evident, coalesce(emitted_valence, 'neutral') IN ('affirm', 'caution') AND outcome IS NOT NULL AS judged,
            (emitted_valence = 'affirm' AND outcome = 'fail') OR (emitted_valence = 'caution' AND outcome = 'ok') AS wrong FROM fx_verdicts v LEFT JOIN fx_log l USING (trace_id) LEFT JOIN seen USING (verdict_id)),
        g AS (SELECT f AS floor, e AS least, c AS ceiling, a.*, CASE WHEN strength < f THEN 'w' WHEN evident < e THEN 's' WHEN d > c THEN 'c' END AS gate FROM a CROSS JOIN (VALUES (0.2::DOUBLE), (0.5::DOUBLE)) x(f) CROSS JOIN (VALUES (0), (1)) y(e) CROSS JOIN (VALUES (0.2::DOUBLE), (1.0::DOUBLE)) z(c)),
        n AS (SELECT floor, least, ceiling, count(*) AS appraisals, count(gate) AS abstained, count(*) FILTER (gate = 'w') AS weak_resonance, count(*) FILTER (gate = 's') AS sparse_evidence, count(*) FILTER (gate = 'c') AS conflicted,
            count(*) FILTER (gate IS NOT NULL AND judged AND wrong) AS prevented, count(*) FILTER (gate IS NOT NULL AND judged AND NOT wrong) AS suppressed, count(*) FILTER (judged) AS j, count(*) FILTER (judged AND wrong) AS jw, count(*) FILTER (judged AND gate IS NULL) AS k, count(*) FILTER (judged AND gate IS NULL AND wrong) AS kw FROM g GROUP BY 1, 2, 3)
        SELECT floor, least, ceiling, appraisals, abstained, round(abstained / appraisals, 4) AS abstain_rate, weak_resonance, sparse_evidence, conflicted, prevented, suppressed, CASE WHEN prevented + suppressed > 0 THEN round(prevented / (prevented + suppressed), 4) END AS precision,
            CASE WHEN j > 0 THEN round(jw / j, 4) END AS wrong_rate_before, CASE WHEN k > 0 THEN round(kw / k, 4) END AS wrong_rate_after FROM n""",
    "t28_projects": "SELECT DISTINCT concat('s', conv_id) AS id, CASE WHEN conv_id % 7 % 2 = 0 THEN concat('p', conv_id % 7) ELSE concat('c', conv_id) END AS project FROM fx_messages",
    "t29_bags": r"""WITH w AS (SELECT id, unnest(list_filter(string_split_regex(trigger_desc, '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM fx_chunks), n AS (SELECT id, CAST(concat('0x', substr(sha256(lower(w)), 1, 8)) AS BIGINT) % 256 AS place, count(*)::DOUBLE AS n FROM w GROUP BY 1, 2),
        t AS (SELECT id, count(*)::INTEGER AS filled, round(max(n) / sqrt(sum(n * n)), 6) AS largest, arg_min(place, (-n, place)) AS place FROM n GROUP BY 1)
        SELECT c.id, coalesce(filled, 0) AS filled, coalesce(largest, 0.0) AS largest, coalesce(place, 0) AS place FROM fx_chunks c LEFT JOIN t ON t.id = c.id""",
    "src5_events": f"WITH {SESSION} SELECT session_id, seq, kind, uuid, name, input, failed, sha256(text) AS hash FROM sess",
    "l15_digests": f"""WITH {SESSION} SELECT session_id, substr(arg_max(text, seq) FILTER (kind = 'user'), 1, 200) AS asked, substr(arg_max(text, seq) FILTER (kind = 'assistant'), 1, 200) AS answered,
        coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (kind = 'tool'), '') AS tools, count(*) FILTER (kind = 'tool') AS calls, count(*) FILTER (failed) AS failures FROM sess GROUP BY 1""",
    "t12_t13_sanitized": f"SELECT id, act AS action, sha256(CASE WHEN act = 'discard' THEN content ELSE {clean('content')} END) AS hash FROM (SELECT id, content, {action('content')} AS act FROM fx_secrets)",
    "f9_work_queue": "SELECT id, priority, ts FROM fx_distill WHERE distill_state = 'new'",
    "f10_retries": f"SELECT id, attempts FROM fx_distill WHERE distill_state = 'failed' AND attempts < 3 AND coalesce(last_failed_at, ts) < {AS_OF} - INTERVAL 5 MINUTES",
    "c14_screening": f"SELECT id, attempts + 1 AS attempts, concat('screening_timeout:', coalesce(run_id, 'unknown')) AS note FROM fx_distill WHERE distill_state = 'screening' AND locked_at < {AS_OF} - INTERVAL 30 MINUTES",
    "d1_distilled": f"WITH {DIST} SELECT source_id, sha256(content) AS hash, trigger_desc, anti_trigger_desc, skill_name FROM dist",
    "d2_n12_prompt_tokens": f"WITH {PROMPT} SELECT * FROM prompt",
    "d3_batch": f"""WITH {DIST}, {GONE}, x AS (SELECT l.id, {action('content')} AS action, sha256({clean('content')}) AS hash FROM fx_distill l LEFT JOIN dist ON source_id = l.id WHERE l.distill_state = 'new'),
        y AS (SELECT *, CASE WHEN action IS NULL THEN 'insufficient_material' WHEN action = 'discard' OR hash IN (SELECT hash FROM gone) THEN 'all_chunks_filtered' END AS note FROM x)
        SELECT id, CASE WHEN note IS NULL THEN 'distilled' ELSE 'discarded' END AS state, note, CASE WHEN note IS NULL THEN hash END AS hash, CASE WHEN note IS NULL THEN CASE WHEN action = 'redact' THEN 0.40 ELSE 0.55 END END::DOUBLE AS confidence FROM y""",
    "d5_token_usage": f"""WITH {DIST}, {PROMPT}, x AS (SELECT count(*) AS logs, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum({tok('content')} + {tok('trigger_desc')} + {tok('anti_trigger_desc')}), 0) AS BIGINT) AS completion_tokens
        FROM fx_distill l JOIN prompt USING (id) LEFT JOIN dist ON source_id = l.id WHERE l.ts >= {AS_OF} - INTERVAL 7 DAYS) SELECT *, prompt_tokens + completion_tokens >= 100000 AS exceeded FROM x""",
    "t14_c11_entity_index": f"WITH {entity_rows('fx_code', 'id', ['content', 'trigger_desc'])} SELECT k AS chunk_id, entity, etype FROM ents",
    "r5_spread": f"WITH {recalled()} SELECT * FROM spr",
    "p1_p3_contributors": f"WITH {POINTS} SELECT * FROM con",
    "p4_p5_verdicts": f"""WITH {POINTS}, {CAL}, g AS (SELECT q.query_id, count(chunk_id) AS n, coalesce(max(strength), 0.0) AS s, coalesce(round(max(strength) - min(strength), 6), 0.0) AS d, count(*) FILTER (valence = 'affirm') AS na, count(*) FILTER (valence = 'caution') AS nc,
            count(*) FILTER (seen) AS ns, coalesce(string_agg(chunk_id, ',' ORDER BY chunk_id) FILTER (valence = 'caution'), '') AS flags FROM (SELECT query_id FROM fx_queries) q LEFT JOIN con USING (query_id) GROUP BY 1),
        h AS (SELECT *, CASE WHEN n = 0 THEN 'weak_resonance' WHEN ns < 1 THEN 'sparse_evidence' WHEN d > 0.2::DOUBLE THEN 'conflicted' END AS gate FROM g)
        SELECT query_id, CASE WHEN gate IS NOT NULL THEN 'neutral' WHEN na > 0 AND nc > 0 THEN 'mixed' WHEN nc > 0 THEN 'caution' WHEN na > 0 THEN 'affirm' ELSE 'neutral' END AS valence, CASE WHEN gate IS NOT NULL THEN 'weak' WHEN s >= 0.65::DOUBLE THEN 'strong' WHEN s >= 0.30::DOUBLE THEN 'medium' ELSE 'weak' END AS tier,
        s AS strength, d AS dispersion, CASE WHEN gate IS NOT NULL THEN 0.0 ELSE round(greatest(0.0, least(1.0, coalesce(rate, s) * (1 - d))), 6) END AS confidence, gate AS abstain_reason, CASE WHEN gate IS NULL THEN flags ELSE '' END AS flagged FROM h LEFT JOIN cal ON bucket = least(9, CAST(floor(s * 10) AS BIGINT))""",
    "v4_verdicts": f"""WITH s AS (SELECT *, nullif({clean(strip('observation'))}, '') AS said FROM fx_submitted), x AS (SELECT s.id, said, CASE WHEN verdict IS NULL OR verdict NOT IN ('applied', 'supported', 'contradicted', 'irrelevant') THEN 'invalid_verdict' WHEN verdict IN ('supported', 'contradicted') AND said IS NULL THEN 'observation_required'
        WHEN origin IS NULL THEN 'unknown_chunk' WHEN origin = 'spark' THEN 'spark_not_a_rule' END AS problem FROM s LEFT JOIN fx_chunks c ON c.id = chunk_id) SELECT id, problem, CASE WHEN problem IS NULL THEN said END AS observation FROM x""",
    "t23_usable_signals": f"WITH {USABLE} SELECT * FROM sig",
    "r21_r22_actions": f"WITH {ACTED} SELECT id, chunk_id, score, signals, shown FROM acted",
    "l13_shown": f"WITH {ACTED} SELECT sha256(concat(chunk_id, '|', session_id, '|pre_tool')) AS id, chunk_id, session_id, 'pre_tool' AS channel, id AS tool_use_id, 'shown' AS verdict, ts AS created_at FROM acted WHERE shown",
    "l5_clusters": f"""WITH RECURSIVE {CLUSTERS}
        SELECT id, cluster, nth, members FROM clusters""",
    "l16_to_embed": """SELECT DISTINCT id, session_id FROM (SELECT id, session_id, ts FROM fx_episodes WHERE id NOT IN (SELECT id FROM fx_episode_vectors) ORDER BY ts, id LIMIT 12)""",
    "l16_consumed": f"""WITH RECURSIVE {CLUSTERS}, gave AS (SELECT cluster, min(rule_id) AS rule_id FROM clusters JOIN fx_episodes USING (id) JOIN fx_births b ON b.session_id = fx_episodes.session_id GROUP BY 1)
        SELECT e.id, CASE WHEN c.id IS NULL THEN 'new' WHEN rule_id IS NULL THEN 'no_rule' ELSE 'ruled' END AS state, rule_id FROM fx_episodes e LEFT JOIN clusters c ON c.id = e.id LEFT JOIN gave USING (cluster)""",
    "c13_cycles": f"""WITH RECURSIVE {HARD}, reach(a, b) AS (SELECT a, b FROM hard UNION SELECT r.a, h.b FROM reach r JOIN hard h ON h.a = r.b)
        SELECT x.a AS id, min(x.b) AS cycle FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY 1""",
    "c20_curated": f"WITH {CURATED} SELECT f.id, f.state, f.state_reason, round(f.confidence, 6) AS confidence FROM final f JOIN fx_chunks c ON c.id = f.id WHERE f.state <> c.state OR f.state_reason IS NOT NULL OR f.confidence <> c.confidence_base",
    "c20_logs": f"WITH {CURED_LOGS} SELECT * FROM cured",
    "c20_report": f"""WITH RECURSIVE {CURATED}, {CURED_LOGS}, {HARD}, reach(a, b) AS (SELECT a, b FROM hard UNION SELECT r.a, h.b FROM reach r JOIN hard h ON h.a = r.b),
        ends AS (SELECT a AS id FROM hard WHERE a NOT IN (SELECT id FROM fx_chunks) UNION SELECT b FROM hard WHERE b NOT IN (SELECT id FROM fx_chunks)),
        x AS (SELECT concat('archive:', reason) AS step FROM arch UNION ALL SELECT 'duplicate' FROM dup UNION ALL SELECT 'decay' FROM fell UNION ALL SELECT turned FROM grew UNION ALL SELECT 'on_cycle' FROM (SELECT a FROM reach WHERE a = b) UNION ALL SELECT 'orphan' FROM ends
            UNION ALL SELECT 'recovered' FROM cured WHERE note LIKE 'screening_timeout:%' UNION ALL SELECT 'given_up' FROM cured WHERE note = 'no_record_timeout' UNION ALL SELECT 'compacted' FROM cured WHERE compacted
            UNION ALL SELECT 'pruned_runs' FROM fx_oplog WHERE started_at < {AS_OF} - INTERVAL 20 DAYS UNION ALL SELECT 'pruned_requests' FROM fx_requests WHERE ts < {AS_OF} - INTERVAL 30 DAYS)
        SELECT step, count(*) AS n FROM x GROUP BY 1""",
    "c21_actions": f"""WITH RECURSIVE {GOVERNED} SELECT rid AS id, failure, becomes FROM steps WHERE nth > 0 UNION ALL SELECT id, 'chunk_not_found', NULL FROM fx_requests WHERE chunk_id NOT IN (SELECT id FROM fx_chunks)""",
    "c21_chunks": f"""WITH RECURSIVE {GOVERNED}, ends AS (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY h ORDER BY nth DESC) = 1), m AS (SELECT h, invalid, unnest(ms) AS m FROM ends),
        void AS (SELECT DISTINCT h FROM asked WHERE action = 'invalidate')
        SELECT m.id AS id, m.state AS state, m.reason AS reason, invalid FROM m WHERE m.reason IS NOT NULL
        UNION ALL SELECT c.id, 'archived', 'invalidated:same_hash', e.invalid FROM fx_chunks c JOIN void ON void.h = c.content_hash JOIN ends e ON e.h = c.content_hash WHERE c.id NOT IN (SELECT m.id FROM m)""",
    "c22_spark_transitions": f"""WITH {GONE}, {PRESENT}, x AS (SELECT r.id, r.action AS request, r.target, coalesce(s.maturity, 'seed') AS m, s.id IS NULL AS lost, {action('s.content')} AS act, sha256({clean('s.content')}) AS hash FROM fx_spark_requests r LEFT JOIN fx_chunks s ON s.id = r.spark_id AND s.origin = 'spark'),
        y AS (SELECT x.*, existing, CASE WHEN lost THEN 'chunk_not_found' WHEN request = 'mature' THEN CASE WHEN m NOT IN ('seed', 'sprouting') THEN concat('already_', m) WHEN target <> m AND target <> CASE m WHEN 'seed' THEN 'sprouting' ELSE 'incubating' END THEN 'invalid_transition' END
            WHEN request = 'promote' THEN CASE WHEN m IN ('promoted', 'dropped') THEN concat('already_', m) WHEN target NOT IN ('note', 'skill') THEN 'invalid_target' WHEN act = 'discard' THEN 'discarded' WHEN x.hash IN (SELECT hash FROM gone) THEN 'hash_invalidated' END
            WHEN m = 'promoted' THEN 'already_promoted' END AS failure FROM x LEFT JOIN present p ON p.hash = x.hash)
        SELECT id, failure, CASE WHEN failure IS NULL THEN CASE request WHEN 'mature' THEN target WHEN 'promote' THEN 'promoted' ELSE 'dropped' END END AS becomes, CASE WHEN failure IS NULL AND request = 'promote' THEN existing END AS chunk_id,
            CASE WHEN failure IS NULL AND request = 'promote' AND existing IS NULL THEN CASE WHEN act = 'redact' THEN 0.40 WHEN target = 'skill' THEN 0.85 ELSE 0.60 END END::DOUBLE AS confidence FROM y""",
    "c23_ingested": f"""WITH {GONE}, {PRESENT}, x AS (SELECT *, {action('content')} AS act, sha256({clean('content')}) AS hash FROM fx_ingest),
        r AS (SELECT x.*, existing, CASE WHEN kind IS NULL OR kind NOT IN ('note', 'skill') THEN 'invalid_kind' WHEN source IS NULL OR source NOT IN ('chat', 'manual', 'doc', 'agent') THEN 'invalid_source' WHEN coalesce(trim(content, ' '), '') = '' THEN 'empty_content' WHEN act = 'discard' THEN 'discarded'
            WHEN x.hash IN (SELECT hash FROM gone) THEN 'hash_invalidated' END AS refused FROM x LEFT JOIN present p ON p.hash = x.hash),
        f AS (SELECT *, CASE WHEN refused IS NULL THEN first_value(id) OVER (PARTITION BY hash, refused IS NULL ORDER BY ts, id) END AS head FROM r), s AS (SELECT *, CASE WHEN refused IS NULL THEN coalesce(existing, nullif(head, id)) END AS chunk FROM f),
        t AS (SELECT *, CASE WHEN refused IS NOT NULL THEN refused WHEN chunk IS NOT NULL THEN 'existing' ELSE 'added' END AS status FROM s)
        SELECT id, status, chunk AS chunk_id, CASE WHEN status = 'added' THEN CASE WHEN kind = 'skill' AND source <> 'agent' THEN 'installed' ELSE 'captured' END END AS origin, CASE WHEN status = 'added' THEN CASE WHEN source = 'agent' THEN 'pending' ELSE 'active' END END AS state,
            CASE WHEN status = 'added' THEN CASE WHEN act = 'redact' THEN 0.40 WHEN kind = 'skill' AND source <> 'agent' THEN 0.85 ELSE 0.60 END END::DOUBLE AS confidence FROM t""",
    "a17_repair": f"""WITH {EVENTS}, {LIFE}, k AS (SELECT chunk_id, count(*) AS kept FROM ev WHERE event = 'selected' GROUP BY 1), real_ones AS (SELECT * FROM fx_chunks WHERE origin <> 'spark')
        SELECT (SELECT count(*) FROM fx_usage WHERE source = 'daemon' AND event IN ('selected', 'retrieved')) AS events_deleted,
            (SELECT count(*) FROM life JOIN fx_log l USING (trace_id) WHERE distill_state = 'open' AND (event_source = 'daemon' OR trace_id NOT IN (SELECT trace_id FROM fx_usage WHERE event = 'selected'))) AS traces_retired,
            (SELECT CAST(sum(selected_count) AS BIGINT) FROM fx_counters WHERE id IN (SELECT id FROM real_ones)) AS selected_before,
            (SELECT CAST(sum(greatest(0, selected_count - coalesce(kept, 0))) AS BIGINT) FROM fx_counters LEFT JOIN k ON chunk_id = id WHERE id IN (SELECT id FROM real_ones))
              + (SELECT count(*) FROM fx_usage u JOIN real_ones c ON c.id = u.chunk_id WHERE event = 'selected' AND source <> 'daemon' AND (evidence_cutoff_at IS NULL OR ts > evidence_cutoff_at)) AS selected_after""",
    "a21_a22_backfilled": """SELECT id, CASE WHEN ts LIKE '____-__-__ __:__:__' THEN concat(replace(ts, ' ', 'T'), '.000Z') ELSE ts END AS ts, coalesce(source, 'sdk') AS source, CASE WHEN used THEN coalesce(attribution, 'explicit') END AS attribution, CASE WHEN outcome IS NULL THEN 'recalled' ELSE 'completed' END AS task_state FROM fx_old_rows""",
    "o5_lifecycle": f"""WITH {GOVERN}, {PROPOSED}, r AS (SELECT * FROM fx_states WHERE origin <> 'spark' AND state_updated_at >= {AS_OF} - INTERVAL 7 DAYS)
        SELECT (SELECT count(*) FROM r WHERE state = 'active' AND state_reason IN ('repeated_success', 'approved', 'restore')) AS promotions, (SELECT count(*) FROM r WHERE state = 'active' AND (state_reason IN ('repeated_success', 'approved', 'restore') OR starts_with(state_reason, 'validated:'))) AS all_promotions,
            (SELECT count(*) FROM r WHERE state = 'archived') AS evictions, (SELECT min(created_at) FROM fx_chunks WHERE state = 'pending' AND origin <> 'spark') AS oldest_pending_at, (SELECT min(created_at) FROM prop WHERE becomes = 'pending') AS oldest_proposal_at""",
    "o11_suggestions": f"""WITH {GOVERN}, {PROPOSED}, n AS (SELECT 'rebuild_embeddings' AS action, count(*) AS n FROM fx_chunks WHERE embed_version < 1 UNION ALL SELECT 'distill_new_logs', count(*) FROM fx_distill WHERE distill_state = 'new'
        UNION ALL SELECT 'promote_recurring_sparks', count(*) FROM (SELECT chunk_id FROM fx_usage WHERE event = 'retrieved' AND chunk_id IN (SELECT id FROM fx_chunks WHERE origin = 'spark') GROUP BY 1 HAVING count(*) >= 2)
        UNION ALL SELECT 'recover_screening', count(*) FROM fx_distill WHERE distill_state = 'screening' AND locked_at < {AS_OF} - INTERVAL 30 MINUTES UNION ALL SELECT 'review_proposals', count(*) FROM prop WHERE becomes = 'pending'
        UNION ALL SELECT 'name_agents', count(*) FROM fx_log WHERE event_source IN ('mcp', 'cli') AND agent IS NULL AND ts >= {AS_OF} - INTERVAL 7 DAYS) SELECT * FROM n WHERE n > 0""",
    "o15_endpoints": f"""WITH w AS (SELECT * FROM fx_calls WHERE ts >= {AS_OF} - INTERVAL 24 HOURS), g AS (SELECT kind, count(*) AS calls, count(*) FILTER (status = 'ok') AS ok, list_sort(list(latency_ms)) AS l FROM w GROUP BY 1),
        e AS (SELECT kind, status AS top_error FROM w WHERE status <> 'ok' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, status) = 1),
        a AS (SELECT kind, max(ts) FILTER (status = 'ok') AS last_ok_at, max(ts) FILTER (status <> 'ok') AS last_error_at FROM fx_calls GROUP BY 1)
        SELECT a.kind, coalesce(calls, 0) AS calls, CASE WHEN calls > 0 THEN {share('ok', 'calls')} END AS success_rate, l[CAST(round((len(l) - 1) * 0.5) AS INT) + 1] AS p50, l[CAST(round((len(l) - 1) * 0.95) AS INT) + 1] AS p95, top_error, last_ok_at, last_error_at, coalesce(ok * 2 < calls, false) AS degraded
        FROM a LEFT JOIN g ON g.kind = a.kind LEFT JOIN e ON e.kind = a.kind""",
    "o16_errors": f"SELECT op, count(*) FILTER (started_at >= {AS_OF} - INTERVAL 1 DAY) AS day, count(*) FILTER (started_at >= {AS_OF} - INTERVAL 7 DAYS) AS week, max(started_at) AS last_at FROM fx_oplog WHERE status <> 'ok' GROUP BY 1",
    "o17_table_sizes": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM fx_{t}" for t in TABLES),
    "n11_explanations": f"""WITH {EVENTS}, {COUNTS}, {EVIDENCE}, {FOLD}, n AS (SELECT chunk_id, count(*) FILTER (target = 1) AS ok, count(*) FILTER (target = 0) AS bad FROM done GROUP BY 1),
        d AS (SELECT chunk_id, CAST(floor((epoch_us({AS_OF}) - epoch_us(max(ts))) / 1e6) AS BIGINT) AS s FROM fx_feedback WHERE signal = 'down' GROUP BY 1)
        SELECT chunk_id, concat(ok, CASE WHEN ok = 1 THEN ' success, ' ELSE ' successes, ' END, bad, CASE WHEN bad = 1 THEN ' failure' ELSE ' failures' END, ' → EMA ', coalesce(printf('%.2f', round(confidence, 2)), 'n/a'),
            CASE WHEN s IS NULL THEN '' ELSE concat('; last negative feedback ', CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN concat(s // 60, 'm ago') WHEN s < 86400 THEN concat(s // 3600, 'h ago') ELSE concat(s // 86400, 'd ago') END) END) AS explanation
        FROM n LEFT JOIN fold USING (chunk_id) LEFT JOIN d USING (chunk_id)""",
    "e1_averages": f"SELECT count(*) AS queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg, count(*) FILTER (rr = 0) AS misses FROM ({SQL['e1_ranking_metrics']})",
    "e2_self_labels": """WITH ok AS (SELECT id AS chunk_id, substr(trigger_desc, 1, 90) AS probe, substr(content, 61, 140) AS body FROM fx_chunks WHERE state <> 'archived' AND origin <> 'spark' AND embed_version >= 1)
        SELECT chunk_id, 'trigger' AS kind, probe AS query FROM ok WHERE probe <> '' UNION ALL SELECT chunk_id, 'body', body FROM ok WHERE length(body) >= 40""",
    "e3_weight_sweep": f"""WITH {recalled()}, w AS ({SWEPT}), s AS (SELECT setting, query_id, chunk_id, round((w_content + w_trigger + w_lexical + w_spread * fs + w_confidence + w_context + w_activation * fa + w_length) * CASE WHEN against THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN state = 'pending' THEN 0.6::DOUBLE ELSE 1 END, 6) AS score FROM parts CROSS JOIN w),
        top5 AS (SELECT setting, query_id, chunk_id, row_number() OVER (PARTITION BY setting, query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 5),
        each AS (SELECT setting, query_id, count(*) FILTER (good) AS h, min(rank) FILTER (good) AS f FROM (SELECT *, (query_id, chunk_id) IN (SELECT (query_id, chunk_id) FROM fx_relevant) AS good FROM top5) GROUP BY 1, 2)
        SELECT setting, count(*) AS queries, round(avg(h / 5), 6) AS precision, round(avg(coalesce(1 / f, 0)), 6) AS mrr, count(*) FILTER (h = 0) AS misses FROM each GROUP BY 1""",
    "r15_trace_events": f"WITH RECURSIVE {TRACED} SELECT * FROM traced",
    "r15_snapshots": f"""WITH RECURSIVE {TRACED}, told AS (SELECT query_id, string_agg(t.chunk_id, ',' ORDER BY t.rank, t.chunk_id) FILTER (event = 'retrieved') AS retrieved, string_agg(t.chunk_id, ',' ORDER BY t.rank, t.chunk_id) FILTER (event = 'selected') AS selected,
        string_agg(t.chunk_id, ',' ORDER BY t.rank, t.chunk_id) FILTER (event = 'spark') AS sparks, sum(c.token_count) FILTER (event = 'selected') AS tokens FROM traced t JOIN fx_chunks c ON c.id = t.chunk_id GROUP BY 1)
        SELECT query_id, coalesce(retrieved, '') AS retrieved, coalesce(selected, '') AS selected, coalesce(sparks, '') AS sparks, coalesce(tokens, 0)::BIGINT AS tokens FROM fx_queries LEFT JOIN told USING (query_id)""",
    "t16_t18_call_features": f"WITH {CALLS} SELECT id, array_to_string(family, ',') AS programs, CASE WHEN failed THEN sig END AS signature FROM calls",
    "l1_struggles": f"""WITH {CALLS}, placed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS nr FROM calls),
        pairs AS (SELECT a.session_id, a.id, a.nr, a.sig, min(b.nr) AS rnr FROM placed a JOIN placed b ON b.session_id = a.session_id AND b.nr BETWEEN a.nr + 1 AND a.nr + 15 AND NOT b.failed AND list_has_any(a.family, b.family)
            WHERE a.failed AND len(a.family) > 0 AND NOT (trim(a.result, ' ') = 'Exit code 1' OR regexp_matches(a.result, 'doesn''t want to proceed|was rejected|user denied|Permission for this action was denied|auto mode classifier')) GROUP BY 1, 2, 3, 4),
        walk AS (SELECT session_id, list_reduce(list_prepend({{'i': 0::BIGINT, 'e': 0::BIGINT, 'kept': []::BIGINT[]}}, list({{'i': nr, 'e': rnr + 1, 'kept': []::BIGINT[]}} ORDER BY nr)), lambda a, x: CASE WHEN x.i >= a.e THEN {{'i': x.i, 'e': x.e, 'kept': list_append(a.kept, x.i)}} ELSE a END).kept AS kept FROM pairs GROUP BY 1)
        SELECT p.session_id, p.id, r.id AS recovery_id, least(6, p.rnr - p.nr - 1) AS attempts, p.sig AS signature FROM pairs p JOIN walk w ON w.session_id = p.session_id AND list_contains(w.kept, p.nr) JOIN placed r ON r.session_id = p.session_id AND r.nr = p.rnr""",
    "l3_observations": f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, CAST(id AS VARCHAR)) AS nr FROM fx_transcript), a AS (SELECT s.id, t.*EXCLUDE(id), row_number() OVER (PARTITION BY s.id ORDER BY t.nr) AS k FROM fx_shown s JOIN t ON t.session_id = s.session_id AND t.ts > s.shown_at AND t.kind = 'tool' QUALIFY k <= 3),
        f AS (SELECT *, first_value(nr) OVER (PARTITION BY id ORDER BY nr) AS start FROM a), ok AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.session_id = f.session_id AND u.kind = 'user' AND u.nr > f.start AND u.nr < f.nr))
        SELECT id, count(*) AS calls, count(*) FILTER (failed) AS failures, sha256(string_agg(concat(CASE WHEN failed THEN '[失败] ' ELSE '[成功] ' END, {clipped('input', 300)}, chr(10), {clipped('result', 300)}), concat(chr(10), '---', chr(10)) ORDER BY nr)) AS hash FROM ok GROUP BY 1""",
    "a5_reduced_traces": """WITH h AS (SELECT trace_id, max((ts, id)) FILTER (complete AND used IS NOT NULL) AS reset, arg_max(outcome, (ts, id)) FILTER (outcome IN ('ok', 'fail')) AS outcome, count(used) AS said FROM fx_reports GROUP BY 1),
        e AS (SELECT r.trace_id, r.ts, r.id, r.attribution, unnest(string_split(used, ',')) AS chunk_id, generate_subscripts(string_split(used, ','), 1) AS pos FROM fx_reports r JOIN h USING (trace_id) WHERE used IS NOT NULL AND (reset IS NULL OR (r.ts, r.id) >= reset)),
        c AS (SELECT trace_id, chunk_id, min((ts, id, pos)) AS first_at, arg_max(attribution, CASE attribution WHEN 'explicit' THEN 3 WHEN 'cited' THEN 2 ELSE 1 END) AS attribution FROM e WHERE chunk_id <> '' GROUP BY 1, 2),
        l AS (SELECT trace_id, string_agg(chunk_id, ',' ORDER BY first_at) AS used, string_agg(attribution, ',' ORDER BY first_at) AS attributions FROM c GROUP BY 1)
        SELECT trace_id, coalesce(used, '') AS used, coalesce(attributions, '') AS attributions, reset IS NOT NULL AS complete, outcome, CASE WHEN said = 0 THEN 'unknown' WHEN used IS NULL THEN 'known_none' ELSE 'known_some' END AS usage_state FROM h LEFT JOIN l USING (trace_id)""",
    "t8_embed_texts": f"SELECT id, sha256(concat_ws(chr(10), {labelled('error', 'last_error')}, {labelled('stage', 'stage')}, {labelled('files', 'file_context')})) AS hash FROM fx_situations",
    "o4_recall_pack": f"""WITH {EVENTS}, {COUNTS}, r AS (SELECT n.*, c.state FROM counts n JOIN fx_chunks c USING (id) WHERE origin <> 'spark'), w AS (SELECT * FROM fx_usage WHERE ts >= {AS_OF} - INTERVAL 7 DAYS),
        t AS (SELECT count(*) FILTER (event = 'retrieved') AS r, count(*) FILTER (event = 'selected') AS s FROM w GROUP BY trace_id), u AS (SELECT rank, chunk_id IN (SELECT id FROM counts WHERE used > 0) AS is_used FROM w WHERE event = 'selected' AND rank IS NOT NULL)
        SELECT (SELECT count(*) FROM r WHERE state <> 'archived' AND selected >= 3 AND used = 0) AS zombies, (SELECT {share('count(*) FILTER (selected > 0 AND used = 0)', 'count(*) FILTER (selected > 0)')} FROM r) AS selected_unused_rate,
            (SELECT coalesce(round(avg(r), 2), 0.0) FROM t) AS avg_retrieved, (SELECT coalesce(round(avg(s), 2), 0.0) FROM t) AS avg_selected, (SELECT coalesce(round(avg(1 / rank) FILTER (is_used AND rank > 0), 3), 0.0) FROM u) AS used_rank_mrr,
            (SELECT count(*) FROM u WHERE rank = 1) AS rank_1, (SELECT count(*) FROM u WHERE rank BETWEEN 2 AND 3) AS rank_2_3, (SELECT count(*) FROM u WHERE rank BETWEEN 4 AND 10) AS rank_4_10, (SELECT count(*) FROM u WHERE rank > 10) AS rank_over_10,
            (SELECT {share("count(*) FILTER (usage_state = 'known_none')", 'count(*)')} FROM fx_log WHERE event_source = 'hook' AND ts >= {AS_OF} - INTERVAL 7 DAYS) AS hook_silence_rate""",
    "o4_rank_anomalies": f"""WITH {EVENTS}, {COUNTS}, x AS (SELECT u.chunk_id, u.rank, n.used FROM fx_usage u JOIN counts n ON n.id = u.chunk_id WHERE u.event = 'selected' AND u.ts >= {AS_OF} - INTERVAL 7 DAYS)
        SELECT * FROM (SELECT 'high_rank_unused' AS kind, chunk_id, min(rank) AS best_rank FROM x WHERE rank <= 3 AND used = 0 GROUP BY 2 ORDER BY 3, 2 LIMIT 5) UNION ALL SELECT * FROM (SELECT 'low_rank_used', chunk_id, min(rank) FROM x WHERE rank > 10 AND used > 0 GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)""",
    "p7_intuition": f"""WITH v AS (SELECT outcome, coalesce(emitted_strength, 0.0) AS s, CASE WHEN abstain_reason IS NOT NULL THEN 'neutral' ELSE coalesce(emitted_valence, 'neutral') END AS valence,
            CASE WHEN abstain_reason IS NOT NULL THEN 'weak' WHEN coalesce(emitted_strength, 0.0) >= 0.65::DOUBLE THEN 'strong' WHEN coalesce(emitted_strength, 0.0) >= 0.30::DOUBLE THEN 'medium' ELSE 'weak' END AS tier FROM fx_verdicts JOIN fx_log USING (trace_id)),
        t AS (SELECT tier, count(outcome) AS e, CASE WHEN count(outcome) > 0 THEN count(*) FILTER (outcome = 'ok') / count(outcome) ELSE 0 END AS hit, avg(s) FILTER (outcome IS NOT NULL) AS mean FROM v GROUP BY 1)
        SELECT (SELECT count(*) FROM v) AS appraisals, round(coalesce((SELECT hit FROM t WHERE tier = 'strong'), 0) - coalesce((SELECT hit FROM t WHERE tier = 'weak'), 0), 3) AS monotonicity_gap, (SELECT round(coalesce(sum(e * abs(mean - hit)) / sum(e), 0), 3) FROM t WHERE e > 0) AS ece,
            (SELECT {share("count(*) FILTER (outcome = 'ok')", 'count(outcome)')} FROM v WHERE valence = 'caution' AND tier = 'strong') AS false_alarm_rate, (SELECT {share("count(*) FILTER (tier = 'weak' OR valence = 'neutral')", 'count(*)')} FROM v) AS silence_rate""",
    "o7_kpi_snapshot": f"""WITH {EVENTS}, {COUNTS}, r AS (SELECT n.*, c.state FROM counts n JOIN fx_chunks c USING (id) WHERE origin <> 'spark'), w7 AS (SELECT * FROM ({SQL['o1_window_rates'].replace('WITH ' + EVENTS + ',', 'WITH', 1)}) WHERE days = 7), d AS (SELECT * FROM fx_oplog WHERE started_at >= {AS_OF} - INTERVAL 1 DAY),
        h AS (SELECT list_sort(list(duration_ms)) AS l FROM fx_oplog WHERE op = 'hook_recall' AND started_at >= {AS_OF} - INTERVAL 7 DAYS), k AS (SELECT * FROM fx_calls WHERE kind = 'chat' AND ts >= {AS_OF} - INTERVAL 24 HOURS)
        SELECT name, CAST(value AS DOUBLE) AS value FROM (SELECT 'active' AS name, (SELECT count(*) FROM r WHERE state = 'active')::DOUBLE AS value UNION ALL SELECT 'pending', (SELECT count(*) FROM r WHERE state = 'pending')
            UNION ALL SELECT 'zombie_chunks', (SELECT count(*) FROM r WHERE state <> 'archived' AND selected >= 3 AND used = 0) UNION ALL SELECT 'knowledge_debt_ratio', (SELECT CASE WHEN count(*) FILTER (state = 'active') > 0 THEN round(count(*) FILTER (state = 'pending') / count(*) FILTER (state = 'active'), 2) ELSE count(*) FILTER (state = 'pending') END FROM r)
            {' '.join(f"UNION ALL SELECT '{said}', coalesce((SELECT {name} FROM w7), 0)" for name, said in (('success_rate', 'task_success_rate_7d'), ('empty_recall_rate', 'empty_recall_rate_7d'), ('timeout_rate', 'trace_timeout_rate_7d'), ('completed_rate', 'completed_rate_7d'), ('use_rate', 'selected_to_used_rate_7d'), ('feedback_coverage', 'feedback_coverage_7d')))}
            UNION ALL SELECT 'record_error_rate_24h', (SELECT {share("count(*) FILTER (status <> 'ok')", 'count(*)')} FROM d WHERE op = 'record') {' '.join(f"UNION ALL SELECT '{op}_runs_24h', (SELECT count(*) FROM d WHERE op = '{op}')" for op in ('evolve', 'curate', 'hook_recall'))}
            UNION ALL SELECT 'errors_24h', (SELECT count(*) FROM d WHERE status <> 'ok') UNION ALL SELECT 'hook_recall_p95_ms_7d', (SELECT coalesce(l[CAST(round((len(l) - 1) * 0.95) AS INT) + 1], 0) FROM h)
            UNION ALL SELECT 'llm_chat_success_rate_24h', (SELECT CASE WHEN count(*) > 0 THEN {share("count(*) FILTER (status = 'ok')", 'count(*)')} ELSE -1 END FROM k))""",
    "r8_reranked": f"""WITH {recalled()}, o AS ({ranked('lexical', 'lexical', 10)}) SELECT r.query_id, CAST(row_number() OVER (PARTITION BY r.query_id ORDER BY o.rank NULLS LAST, r.rank) AS INTEGER) AS rank, r.chunk_id, r.rank AS fused_rank FROM rec r LEFT JOIN o ON o.query_id = r.query_id AND o.chunk_id = r.chunk_id""",
    "r17_search": f"WITH {BM25} SELECT query_id, rank, chunk_id, state, substr(content, 1, 280) AS preview FROM ({ranked('lexical', 'lexical', 100)}) JOIN fx_chunks ON id = chunk_id",
}
