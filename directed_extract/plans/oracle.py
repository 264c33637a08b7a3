"""The same results in SQL, written independently of the Spark plans. One statement for each query."""

from __future__ import annotations

from directed_extract.operators.grid import CHUNK_FILE, TEMPERATURE_FILE

# Pieces of SQL that several statements share.
SP = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SP}+|{SP}+$', '', 'g')"


def key(c: str) -> str:
    return f"lower({strip(c)})"


def surface(c: str) -> str:
    collapsed = f"regexp_replace({c}, '{SP}+', ' ', 'g')"
    return f"coalesce({strip(f'''regexp_replace({collapsed}, '[–—]', '-', 'g')''')}, '')"


def match_form(c: str) -> str:
    return f"coalesce(regexp_replace(regexp_replace(lower({strip(c)}), '{SP}+', ' ', 'g'), '[–—]', '-', 'g'), '')"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{SP}+'), lambda w: w <> '')"


def chars(c: str) -> str:
    return f"list_distinct(string_split({c}, ''))"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN {a} || {b} = '' THEN 0.0 ELSE len(list_intersect({chars(a)}, {chars(b)})) / len({chars(f'({a} || {b})')}) END)"


def contained(a: str, b: str) -> str:
    return f"(contains({a}, {b}) OR contains({b}, {a}))"


def matches(a: str, b: str) -> str:
    return f"({a} = {b} OR {contained(a, b)} OR {jaccard(a, b)} >= 0.8)"


COMMON = "('the','a','an','and','or','of','in','on','at','to','for','with','by')"


def content(c: str) -> str:
    return f"lower(array_to_string(list_filter({words(c)}, lambda w: lower(w) NOT IN {COMMON}), ' '))"


def texts(c: str) -> str:
    return f"coalesce(list_filter(list_transform({c}, lambda e: e.texto), lambda t: t IS NOT NULL), []::VARCHAR[])"


OBJECT = r"""(SELECT pred_id, file_name, CASE WHEN json_valid(raw_line) AND json_type(raw_line) = 'OBJECT' THEN raw_line END AS j FROM prediction_lines)"""
PMID = "CASE WHEN NOT json_exists(j, '$.PMID') THEN 'doc_' || (pred_id - 1) WHEN json_type(j, '$.PMID') = 'NULL' THEN 'None' ELSE j ->> '$.PMID' END"

DOCUMENTS = f"""docs AS (
  SELECT pred_id AS line_num, {PMID} AS pmid, j ->> '$.Texto' AS txt,
         CASE WHEN json_type(j, '$.Entidad') = 'ARRAY'
              THEN list_transform(list_filter(json_extract(j, '$.Entidad[*]'), lambda e: json_type(e) = 'OBJECT' AND json_exists(e, '$.texto')), lambda e: e ->> '$.texto')
              ELSE []::VARCHAR[] END AS candidates
  FROM {OBJECT} WHERE j IS NOT NULL AND json_type(j, '$.Texto') = 'VARCHAR'
    AND (NOT json_exists(j, '$.Entidad') OR json_type(j, '$.Entidad') IN ('ARRAY', 'OBJECT', 'VARCHAR'))
    AND {strip("j ->> '$.Texto'")} <> '')"""

PREDICTIONS = f"""raw AS (
  SELECT pred_id, file_name, {PMID} AS pmid, list_filter(json_extract(j, '$.Entidad[*]'), lambda e: json_type(e, '$.texto') = 'VARCHAR') AS items
  FROM {OBJECT} WHERE j IS NOT NULL AND json_type(j, '$.Entidad') = 'ARRAY'),
ents AS (
  SELECT pred_id, file_name, pmid, i, items[i] ->> '$.texto' AS texto, try_cast(items[i] ->> '$.confidence' AS DOUBLE) AS confidence,
         CASE WHEN json_type(items[i], '$.strategies') = 'ARRAY'
              THEN list_transform(list_filter(json_extract(items[i], '$.strategies[*]'), lambda s: json_type(s) = 'VARCHAR'), lambda s: s ->> '$') ELSE []::VARCHAR[] END AS strategies
  FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM raw)),
gold AS (
  SELECT pmid, {texts('entidad')} AS reference FROM benchmark_docs WHERE pmid IS NOT NULL AND pmid <> ''
  QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY gold_id DESC) = 1)"""

JUDGED = f"""{PREDICTIONS},
lists AS (
  SELECT r.pred_id, r.file_name, r.pmid, list_transform(r.items, lambda e: {match_form("(e ->> '$.texto')")}) AS p, list_transform(g.reference, lambda t: {match_form('t')}) AS g
  FROM raw r JOIN gold g USING (pmid) WHERE len(g.reference) > 0),
options AS (
  SELECT pred_id, file_name, pmid, len(p) AS np, len(g) AS ng,
         list_transform(p, lambda x: list_filter(range(1, len(g) + 1), lambda i: {matches('x', 'g[i]')})) AS o FROM lists),
judged AS (
  SELECT pred_id, file_name, pmid, np, ng,
         len(list_reduce(o, lambda a, x: list_concat(a, list_slice(list_filter(x, lambda i: NOT list_contains(a, i)), 1, 1)), []::BIGINT[])) AS tp FROM options)"""

SCORES = """once AS (
  SELECT DISTINCT run_id || '/' || pmid AS doc, strategy, entity FROM detections WHERE pmid IS NOT NULL AND run_id IS NOT NULL AND strategy IS NOT NULL AND entity IS NOT NULL),
evidence AS (
  SELECT doc, entity, sum(s.weight) AS w, count(*) AS n, bool_or(strategy = 'regex') AS rx, string_agg(strategy, ',' ORDER BY ord) AS strategies
  FROM once JOIN strategies s ON s.name = strategy GROUP BY doc, entity),
step1 AS (SELECT *, CASE WHEN rx THEN least(1.0, w * 1.5) ELSE w END AS c1 FROM evidence),
step2 AS (SELECT *, CASE WHEN n > 1 THEN least(1.0, c1 * (1 + 0.2 * (n - 1))) ELSE c1 END AS c2 FROM step1),
scores AS (SELECT doc, entity, w, n, strategies, round(greatest(0.0, least(1.0, CASE WHEN rx THEN c2 ELSE c2 * 0.8 END)), 9) AS confidence FROM step2),
accepted AS (SELECT * FROM scores WHERE confidence >= 0.5)"""

LISTS = f"""lists AS (
  SELECT gold_id, line_id, {texts('b.entidad')} AS d, {texts('c.entidad')} AS c
  FROM benchmark_docs b JOIN corpus_docs c USING (pmid) WHERE trim(b.pmid) <> ''),
each_d AS (SELECT gold_id, line_id, i - 1 AS pos, d[i] AS detected, c FROM (SELECT *, unnest(range(1, len(d) + 1)) AS i FROM lists) WHERE d[i] <> '')"""


def fuzzy_pair(a: str, b: str) -> str:
    return f"({content(a)} <> '' AND {content(b)} <> '' AND {jaccard(content(a), content(b))} >= 0.8)"


CLASSES = f"""{LISTS},
compared AS (
  SELECT gold_id, line_id, pos, detected, c[k] AS candidate, k,
         {key('detected')} = {key('c[k]')} AS is_exact, {contained(key('detected'), key('c[k]'))} AS is_partial, {fuzzy_pair(key('detected'), key('c[k]'))} AS is_fuzzy
  FROM (SELECT *, unnest(CASE WHEN len(c) > 0 THEN range(1, len(c) + 1) ELSE [0] END) AS k FROM each_d)),
best AS (
  SELECT gold_id, line_id, pos, any_value(detected) AS detected,
         arg_min(candidate, k) FILTER (is_exact) AS e, arg_max(candidate, k) FILTER (is_partial) AS p, arg_max(candidate, k) FILTER (is_fuzzy) AS f
  FROM compared GROUP BY gold_id, line_id, pos),
classes AS (
  SELECT gold_id, line_id, pos, detected,
         CASE WHEN e IS NOT NULL THEN 'exact' WHEN p IS NOT NULL THEN 'partial' WHEN f IS NOT NULL THEN 'fuzzy' ELSE 'unmatched' END AS match_class, coalesce(e, p, f) AS candidate FROM best)"""

VALIDATED = f"""listed AS (SELECT line_id, i - 1 AS pos, entidad[i].texto AS candidate FROM (SELECT line_id, entidad, unnest(range(1, len(entidad) + 1)) AS i FROM corpus_docs)),
validated AS (
  SELECT line_id, pos, candidate,
         CASE WHEN candidate IS NULL OR {strip('candidate')} = '' THEN 'invalid'
              WHEN row_number() OVER (PARTITION BY line_id, {key('candidate')} ORDER BY pos) > 1 THEN 'duplicate' ELSE 'valid' END AS verdict FROM listed)"""


def windows(unit: str) -> str:
    fits = "len(w) <= chunk_max" if unit == "words" else "length(array_to_string(w, ' ')) <= chunk_max"
    return f"""WITH runs AS (SELECT * FROM strategies WHERE model IS NOT NULL AND chunk_target > 0 AND chunk_overlap >= 0),
base AS (
  SELECT doc_id, name, text, {words('text')} AS ws, chunk_target AS t, CASE WHEN chunk_overlap >= chunk_target THEN greatest(1, chunk_target // 2) ELSE chunk_overlap END AS o, chunk_min, chunk_max
  FROM documents, runs WHERE text IS NOT NULL),
sized AS (SELECT *, len(ws) AS n, CASE WHEN len(ws) <= t THEN 0 ELSE cast(ceil((len(ws) - t) / (t - o)) AS BIGINT) END AS k FROM base),
starts AS (
  SELECT *, list_slice(list_concat(list_transform(range(0, k + 1), lambda i: i * (t - o)), range(greatest(n - o, k * (t - o) + 1), n)), 1, 1000) AS st FROM sized),
kept AS (
  SELECT doc_id, name, text, n, chunk_min,
         list_transform(list_filter(list_transform(st, lambda s: list_slice(ws, s + 1, s + t)), lambda w: len(w) >= chunk_min AND {fits}), lambda w: array_to_string(w, ' ')) AS c FROM starts),
chunks AS (SELECT doc_id, name, CASE WHEN n < chunk_min OR len(c) = 0 THEN [text] ELSE c END AS c FROM kept)
SELECT doc_id, name AS strategy, cast(len(c) AS INT) AS n_chunks, cast(list_sum(list_transform(c, lambda x: length(x))) AS BIGINT) AS n_chars, md5(array_to_string(c, '|')) AS chunks_md5 FROM chunks"""


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif({b}, 0), 0.0)"


def metrics(source: str, digits: int, by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}n_docs, tp, fp, fn, n_predicted, n_reference, round(p, {digits}) AS precision, round(r, {digits}) AS recall, round({ratio('2 * p * r', 'p + r')}, {digits}) AS f1_score
FROM (SELECT *, {ratio('tp', 'tp + fp')} AS p, {ratio('tp', 'tp + fn')} AS r FROM (
  SELECT {lead}count(*) AS n_docs, cast(coalesce(sum(tp), 0) AS BIGINT) AS tp, cast(coalesce(sum(np - tp), 0) AS BIGINT) AS fp, cast(coalesce(sum(ng - tp), 0) AS BIGINT) AS fn,
         cast(coalesce(sum(np), 0) AS BIGINT) AS n_predicted, cast(coalesce(sum(ng), 0) AS BIGINT) AS n_reference FROM {source} {group}))"""


FP = f"""{PREDICTIONS},
said AS (SELECT pred_id, pmid, {key('texto')} AS entity, arg_min(confidence, i) AS x, arg_min(coalesce(confidence, 0.0), i) AS confidence, arg_min(strategies, i) AS strategies FROM ents GROUP BY ALL),
known AS (SELECT DISTINCT pmid, {key('r')} AS entity FROM (SELECT pmid, unnest(reference) AS r FROM gold)),
fp AS (SELECT * FROM said ANTI JOIN known USING (pmid, entity))"""
FN = f"""{PREDICTIONS},
known AS (SELECT DISTINCT pmid, {key('r')} AS entity FROM (SELECT pmid, unnest(reference) AS r FROM gold)),
fn AS (SELECT pmid, entity FROM known WHERE pmid IN (SELECT pmid FROM raw) EXCEPT SELECT pmid, {key('texto')} FROM ents)"""

PROFILE = """profile AS (
  SELECT r.file_name, count(DISTINCT r.pred_id) AS docs, count(e.texto) AS entities, round(coalesce(avg(CASE WHEN e.texto IS NOT NULL THEN coalesce(e.confidence, 0.0) END), 0.0), 6) AS avg_conf,
         round(coalesce(min(CASE WHEN e.texto IS NOT NULL THEN coalesce(e.confidence, 0.0) END), 0.0), 6) AS min_conf, round(coalesce(max(CASE WHEN e.texto IS NOT NULL THEN coalesce(e.confidence, 0.0) END), 0.0), 6) AS max_conf,
         count(DISTINCT lower(e.texto)) AS unique_entities
  FROM raw r LEFT JOIN ents e ON e.pred_id = r.pred_id GROUP BY r.file_name)"""
TEMP_FILE = TEMPERATURE_FILE
RESULTS = f"""{JUDGED}, {PROFILE},
measured AS ({metrics('judged', 3, 'file_name')}),
results AS (
  SELECT p.*, m.precision, m.recall, m.f1_score,
         CASE WHEN regexp_matches(file_name, '{CHUNK_FILE}') THEN regexp_extract(file_name, '{CHUNK_FILE}', 1) END AS model,
         try_cast(nullif(regexp_extract(file_name, '{CHUNK_FILE}', 2), '') AS INT) AS chunk, try_cast(nullif(regexp_extract(file_name, '{CHUNK_FILE}', 3), '') AS INT) AS overlap,
         try_cast(nullif(regexp_extract(file_name, '{TEMP_FILE}', 1), '') AS DOUBLE) AS temperature, try_cast(nullif(regexp_extract(file_name, '{TEMP_FILE}', 2), '') AS DOUBLE) AS min_confidence
  FROM profile p LEFT JOIN measured m USING (file_name))"""
MEANS = ", ".join(f"round(coalesce(avg({m}), 0.0), 6) AS mean_{m}" for m in ("entities", "avg_conf", "precision", "recall", "f1_score"))

LABELLED = f"""tokens AS (
  SELECT doc, i - 1 AS pos, ws[i] AS token, CASE length(ws[i]) % 5 WHEN 0 THEN 'problem' WHEN 1 THEN 'problem' WHEN 2 THEN 'test' END AS type, length(ws[i]) % 5 = 0 AS b
  FROM (SELECT doc_id AS doc, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, {words('text')} AS ws FROM documents))),
marked AS (SELECT *, type IS NOT NULL AND (b OR coalesce(lag(type) OVER w <> type, true)) AS begins FROM tokens WINDOW w AS (PARTITION BY doc ORDER BY pos)),
numbered AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS g FROM marked),
entities AS (SELECT doc, cast(g AS BIGINT) AS entity_no, any_value(type) AS type, string_agg(token, ' ' ORDER BY pos) AS txt, count(*) AS n FROM numbered WHERE type IS NOT NULL GROUP BY doc, g)"""

FIRST_WORD = r"[\p{L}\p{M}\p{N}_]"
SQL_CANDIDATES = f"(SELECT DISTINCT line_id, texto, e FROM (SELECT line_id, {surface('texto')} AS texto, unnest({texts('entidad')}) AS e FROM corpus_docs WHERE texto IS NOT NULL))"


def _bounded() -> str:
    a = strip("e")
    left = f"CASE WHEN regexp_matches({a}, '^{FIRST_WORD}') THEN '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])' ELSE '{FIRST_WORD}' END"
    right = f"CASE WHEN regexp_matches({a}, '{FIRST_WORD}$') THEN '($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])' ELSE '{FIRST_WORD}' END"
    return f"{a} <> '' AND regexp_matches(texto, '(?i)' || {left} || regexp_escape({a}) || {right})"


TRIM = r"^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$"


def pmid_key(c: str) -> str:
    t = f"regexp_replace({c}, '{TRIM}', '', 'g')"
    return f"CASE WHEN {t} NOT IN ('', 'None') THEN regexp_replace({t}, '(?i)^(?:pmid\\s*[:#.=]?\\s*)?\\+?0*(\\d+?)(?:\\.0*)?$', '\\1') END"


DANGLING = f"""refs AS (
  SELECT 'detections' AS table_name, det_id AS row_id, {pmid_key('pmid')} AS k, created_at AS t FROM detections
  UNION ALL SELECT 'benchmark_docs', gold_id, {pmid_key('pmid')}, annotated_at FROM benchmark_docs
  UNION ALL SELECT 'prediction_lines', pred_id, {pmid_key("(raw_line ->> '$.PMID')")}, written_at FROM prediction_lines WHERE json_valid(raw_line) AND json_type(raw_line) = 'OBJECT'),
events AS (
  SELECT k, t, max(present) AS present FROM (
    SELECT {pmid_key('pmid')} AS k, ingested_at AS t, 1 AS present FROM corpus_docs UNION ALL SELECT {pmid_key('pmid')}, deleted_at, 0 FROM doc_deletions) WHERE k IS NOT NULL GROUP BY k, t),
judged_refs AS (SELECT r.*, coalesce(e.present, 0) = 0 AS lost FROM refs r ASOF LEFT JOIN events e ON r.k = e.k AND r.t >= e.t WHERE r.k IS NOT NULL)"""


def opened(x: str) -> str:
    return f"(CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({x} ->> '$', '(?s)^\\s*(\\{{.*\\}}|\\[.*\\])\\s*$') AND json_valid({x} ->> '$') THEN cast({x} ->> '$' AS JSON) ELSE {x} END)"


def as_list(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN []::JSON[] WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') ELSE [{x}] END)"


def leaf(x: str) -> str:
    return f"(CASE json_type({x}) WHEN 'OBJECT' THEN {x} ->> '$.name' WHEN 'NULL' THEN NULL ELSE {x} ->> '$' END)"


def of_map(branch: str) -> str:
    return f"""SELECT pred_id, '{branch}' AS branch, parent_key, i - 1 AS pos, {leaf('x')} AS leaf FROM (
  SELECT pred_id, parent_key, i, {opened('items[i]')} AS x FROM (SELECT pred_id, parent_key, items, unnest(range(1, len(items) + 1)) AS i FROM (
    SELECT pred_id, e.key AS parent_key, {as_list('v')} AS items FROM (SELECT pred_id, e, {opened('e.value')} AS v FROM (
      SELECT pred_id, unnest(map_entries(cast(m AS MAP(VARCHAR, JSON)))) AS e FROM (SELECT pred_id, {opened(f"json_extract(ms, '$.{branch}')")} AS m FROM multi) WHERE json_type(m) = 'OBJECT')))))"""


NESTED = f"""lines AS (SELECT pred_id, cast(raw_line AS JSON) AS j FROM prediction_lines WHERE json_valid(raw_line) AND json_type(raw_line) = 'OBJECT'),
multi AS (SELECT pred_id, ms FROM (SELECT pred_id, {opened("json_extract(j, '$._multi_strategy')")} AS ms FROM lines) WHERE json_type(ms) = 'OBJECT'),
elements AS (SELECT pred_id, i - 1 AS place, {opened('items[i]')} AS e FROM (SELECT pred_id, items, unnest(range(1, len(items) + 1)) AS i FROM (
  SELECT pred_id, {as_list('v')} AS items FROM (SELECT pred_id, {opened("json_extract(j, '$.Entidad')")} AS v FROM lines)))),
named AS (SELECT pred_id, place, {as_list('v')} AS items FROM (SELECT pred_id, place, {opened("json_extract(e, '$.strategies')")} AS v FROM elements WHERE json_type(e) = 'OBJECT' AND e ->> '$.texto' IS NOT NULL)),
leaves AS (
  SELECT pred_id, 'entidad' AS branch, cast(place AS VARCHAR) AS parent_key, i - 1 AS pos, {leaf('x')} AS leaf FROM (
    SELECT pred_id, place, i, {opened('items[i]')} AS x FROM (SELECT pred_id, place, items, unnest(range(1, len(items) + 1)) AS i FROM named))
  UNION ALL {of_map('all_detections')} UNION ALL {of_map('entity_strategies')})"""

# The stand-in model in SQL: what it names in a prompt, and how it answers.
NAMED = r"[A-Z][a-z]{4,} syndrome(?: type [0-9])?|[A-Z]{4}[0-9]{1,2}|[a-z]{6,}itis"
SUFFIXES = "disease|syndrome|cancer|tumor|anemia|deficiency|mutation|gene"
LOOSE = " || ".join(f"regexp_extract_all(answer, '{p}')" for p in (
    rf"(?i)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:{SUFFIXES})\b", r"(?i)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:G\d+PD|BRCA\d+|ATM|LCAT)\b", r"(?i)\b(?:G6PD|BRCA1|BRCA2|ATM|LCAT)\b"))


def named(prompt: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({prompt}, '{NAMED}')))"


ASKED = windows("chars").rpartition("SELECT doc_id")[0].replace("FROM documents, runs WHERE text IS NOT NULL", "FROM (SELECT line_id AS doc_id, texto AS text FROM corpus_docs), runs WHERE text IS NOT NULL").replace(
    "WHERE model IS NOT NULL AND chunk_target > 0 AND chunk_overlap >= 0", "WHERE model IS NOT NULL AND chunk_target > 0 AND chunk_overlap >= 0 AND chunk_min > 0 AND chunk_max > chunk_min AND temperature BETWEEN 0 AND 1 AND weight > 0"
) + f""", asked AS (SELECT doc_id, name, model, 'Diseases in this text: ' || chunk || chr(10) || chr(10) || 'Return ONLY a JSON list like: ["disease1", "disease2"]' AS p1,
  'TEXT: ' || chunk || chr(10) || chr(10) || 'EXTRACT disease names. If you find any diseases, return them as: ["disease1", "disease2"]' || chr(10) || 'If you find NO diseases, return: []' AS p2
  FROM (SELECT doc_id, name, unnest(c) AS chunk FROM chunks) JOIN (SELECT name, model FROM strategies) USING (name) WHERE {strip('chunk')} <> '')"""
PIPELINE = f"""{ASKED},
answers AS (SELECT doc_id, name, CASE WHEN length(p1) % 7 <> 0 THEN {named('p1')} WHEN length(p2) % 7 <> 0 THEN {named('p2')} ELSE [] END AS terms,
  CASE WHEN length(p1) % 7 = 0 AND (length(p2) % 7 = 0 OR len({named('p2')}) = 0) THEN CASE WHEN length(p2) % 7 = 0 THEN 'No list today: ' ELSE '' END || array_to_string({named('p2')}, ', ') END AS answer FROM asked),
offered AS (SELECT line_id, list_distinct({texts('entidad')}) AS c, {texts('entidad')} AS ordered FROM corpus_docs WHERE texto IS NOT NULL),
terms AS (
  SELECT DISTINCT doc_id, name, term FROM (SELECT doc_id, name, unnest(terms) AS term FROM answers
    UNION ALL SELECT doc_id, name, term FROM (SELECT doc_id, name, unnest({LOOSE}) AS term FROM answers WHERE answer IS NOT NULL) JOIN offered ON line_id = doc_id WHERE list_contains(list_transform(c, lambda x: lower(x)), lower(term)))),
pairs AS (SELECT line_id, k, ordered[k] AS candidate FROM (SELECT line_id, ordered, unnest(range(1, len(ordered) + 1)) AS k FROM offered)),
hits AS (SELECT doc_id, name, term, arg_min(candidate, k) AS entity FROM terms JOIN pairs ON line_id = doc_id
  WHERE {key('candidate')} = {key('term')} OR {contained(key('candidate'), key('term'))} OR {fuzzy_pair(key('term'), key('candidate'))} GROUP BY doc_id, name, term),
both_kinds AS (SELECT DISTINCT doc_id AS doc, name AS strategy, entity FROM hits UNION SELECT line_id, 'regex', e FROM {SQL_CANDIDATES} WHERE {_bounded()}),
{SCORES.partition("evidence AS (")[1]}{SCORES.partition("evidence AS (")[2].replace("FROM once JOIN", "FROM both_kinds JOIN").replace("JOIN strategies s ON", "JOIN (SELECT ord, name, weight FROM strategies) s ON")}"""

ORACLES: dict[str, str] = {
    "pipeline_accepted": f"{PIPELINE} SELECT doc AS line_id, entity, confidence, cast(n AS INT) AS n_strategies, strategies FROM accepted",
    "call_status": f"""{ASKED}, prompts AS (SELECT DISTINCT model, p1 FROM asked)
SELECT CASE WHEN length(p1) % 5 = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n_calls, cast(sum(CASE WHEN length(p1) % 5 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n_attempts FROM prompts GROUP BY 1""",
    "p1_found": f"WITH {DANGLING} SELECT table_name, row_id FROM judged_refs WHERE lost",
    "p1_report": f"""WITH {DANGLING} SELECT table_name, strftime(t, '%Y-%m') AS period, count(*) AS n_refs, count(*) FILTER (lost) AS n_dangling, count(DISTINCT k) FILTER (lost) AS n_keys,
count(*) FILTER (lost AND k NOT IN (SELECT k FROM events WHERE present = 1)) AS n_never_came FROM judged_refs GROUP BY 1, 2""",
    "p3_found": f"WITH {NESTED} SELECT pred_id, branch, parent_key, cast(pos AS INT) AS pos, leaf FROM leaves WHERE leaf IS NOT NULL",
    "jsonl_documents": f"WITH {DOCUMENTS} SELECT line_num, pmid, cast(length(txt) AS INT) AS n_chars, cast(len(candidates) AS INT) AS n_candidates, md5(array_to_string(list_transform(candidates, lambda c: coalesce(c, '')), '|')) AS candidates_md5 FROM docs",
    "documents_limit": f"WITH {DOCUMENTS} SELECT line_num, pmid FROM docs ORDER BY line_num LIMIT 100",
    "usable_texts": f"SELECT line_id, CASE WHEN length(texto) > 200 THEN left(texto, 200) || '...' ELSE texto END AS preview FROM corpus_docs WHERE {strip('texto')} <> ''",
    "surface_forms": f"SELECT doc_id, md5({surface('text')}) AS surface, md5({match_form('text')}) AS match_form, cast(len({words('text')}) AS INT) AS n_words, cast(length(text) AS INT) AS n_letters FROM documents",
    "allow_list": """WITH allowed AS (SELECT lower(texto) AS a FROM entity_catalog WHERE tipo = 'Test'),
kept AS (SELECT line_id, count(*) AS k FROM (SELECT line_id, unnest(entidad) AS e FROM corpus_docs) WHERE lower(e.texto) IN (SELECT a FROM allowed) GROUP BY line_id)
SELECT line_id, cast(coalesce(len(entidad), 0) AS INT) AS entities_before, cast(coalesce(k, 0) AS INT) AS entities_after FROM corpus_docs LEFT JOIN kept USING (line_id)""",
    "allow_list_stats": """WITH allowed AS (SELECT lower(texto) AS a FROM entity_catalog WHERE tipo = 'Test'),
n AS (SELECT (SELECT count(*) FROM corpus_docs) AS n_docs, count(*) AS b, count(*) FILTER (lower(e.texto) IN (SELECT a FROM allowed)) AS k FROM (SELECT unnest(entidad) AS e FROM corpus_docs))
SELECT n_docs, b AS n_before, k AS n_after, b - k AS n_removed, round(coalesce(k * 100.0 / nullif(b, 0), 0.0), 4) AS kept_percent FROM n""",
    "constant_candidates": """SELECT coalesce(len(entidad) > 0, false) AS had_entities, (SELECT md5(string_agg(t || '/' || k, '|' ORDER BY i)) FROM (VALUES
(1, 'Short of breath', 'SpecificDisease'), (2, 'Chest pain', 'SpecificDisease'), (3, 'Orthopnea', 'SpecificDisease'), (4, 'Hypertension', 'SpecificDisease'), (5, 'Hyperlipidemia', 'SpecificDisease'),
(6, 'Angina', 'SpecificDisease'), (7, 'Obesity', 'SpecificDisease'), (8, 'Aspirin', 'Treatment'), (9, 'Nitroglycerin', 'Treatment'), (10, 'Monitoring', 'Treatment')) b(i, t, k)) AS block_md5,
count(*) AS n_docs, cast(count(*) * 10 AS BIGINT) AS n_candidates FROM corpus_docs GROUP BY 1""",
    "first_samples": "SELECT line_id, CASE WHEN length(texto) > 200 THEN left(texto, 200) || '...' ELSE coalesce(texto, '') END AS preview, cast(len(entidad) AS INT) AS n_entities FROM corpus_docs WHERE len(entidad) > 0 ORDER BY line_id LIMIT 5",
    "type_names": "SELECT CASE e.tipo WHEN 'SpecificDisease' THEN 'disease' WHEN 'Treatment' THEN 'therapy' WHEN 'Test' THEN 'procedure' ELSE e.tipo END AS tipo, count(*) AS n FROM (SELECT unnest(entidad) AS e FROM corpus_docs) WHERE e IS NOT NULL GROUP BY 1",
    "valid_strategies": """SELECT name, coalesce(chunk_target > 0 AND chunk_overlap >= 0 AND chunk_min > 0 AND chunk_max > chunk_min AND temperature BETWEEN 0 AND 1 AND weight > 0, false) AS is_valid,
coalesce(chunk_target > 0 AND chunk_overlap >= 0, false) AS can_run FROM strategies WHERE model IS NOT NULL""",
    "chunk_profile": windows("chars"),
    "chunk_profile_words": windows("words"),
    "sentence_chunk_profile": f"""WITH sized AS (SELECT doc_id, text, {words('text')} AS ws, len({words('text')}) AS n, CASE WHEN len({words('text')}) <= 40 THEN 0 ELSE cast(ceil((len({words('text')}) - 40) / 30) AS BIGINT) END AS k FROM documents),
starts AS (SELECT *, list_slice(list_concat(list_transform(range(0, k + 1), lambda i: i * 30), range(greatest(n - 10, k * 30 + 1), n)), 1, 1000) AS st FROM sized),
kept AS (SELECT doc_id, text, n, list_transform(list_filter(list_transform(st, lambda s: list_slice(ws, s + 1, s + 40)), lambda w: len(w) >= 5 AND length(array_to_string(w, ' ')) <= 200), lambda w: array_to_string(w, ' ')) AS c FROM starts),
chunks AS (SELECT doc_id, CASE WHEN n <= 40 OR len(c) = 0 THEN [text] ELSE c END AS c FROM kept)
SELECT doc_id, cast(len(c) AS INT) AS n_chunks, md5(array_to_string(c, '|')) AS chunks_md5 FROM chunks""",
    "regex_detections": f"SELECT line_id, e AS entity FROM {SQL_CANDIDATES} WHERE {_bounded()}",
    "answer_parsing": r"""WITH spans AS (SELECT pred_id, regexp_extract(coalesce(raw_line, ''), '(?s)\[.*\]') AS a, regexp_extract(coalesce(raw_line, ''), '(?s)\{.*\}') AS o FROM prediction_lines),
typed AS (SELECT *, CASE WHEN a <> '' AND json_valid(a) AND json_type(a) = 'ARRAY' THEN a END AS al, CASE WHEN a = '' AND o <> '' AND json_valid(o) AND json_type(o) = 'OBJECT' THEN o END AS ob FROM spans),
listed AS (SELECT pred_id, al IS NOT NULL OR (ob IS NOT NULL AND (NOT json_exists(ob, '$.present') OR json_type(ob, '$.present') = 'ARRAY')) AS ok,
  CASE WHEN al IS NOT NULL THEN json_extract(al, '$[*]') WHEN ob IS NOT NULL AND json_type(ob, '$.present') = 'ARRAY' THEN json_extract(ob, '$.present[*]') ELSE []::JSON[] END AS items FROM typed),
named AS (SELECT pred_id, ok, list_filter(list_transform(list_filter(items, lambda x: json_type(x) = 'VARCHAR'), lambda x: x ->> '$'), lambda s: s <> '') AS t FROM listed)
SELECT pred_id, ok, cast(len(t) AS INT) AS n_terms, md5(array_to_string(t, '|')) AS terms_md5 FROM named""",
    "cache_live": """WITH c AS (SELECT md5(entity) AS key, max(created_at) + INTERVAL 24 HOURS AS expiry FROM detections WHERE entity IS NOT NULL GROUP BY entity),
live AS (SELECT *, row_number() OVER (ORDER BY expiry, key) AS rn, count(*) OVER () AS n FROM c WHERE expiry > TIMESTAMP '2024-06-01 00:00:00')
SELECT key, expiry FROM live WHERE n < 200 OR rn > n // 4""",
    "entity_scores": f"WITH {SCORES} SELECT doc, entity, round(w, 6) AS weight, cast(n AS INT) AS n_strategies, strategies, round(confidence, 6) AS confidence FROM scores",
    "score_standalone": f"WITH {SCORES} SELECT doc, entity, round(greatest(0.0, least(1.0, w * (CASE WHEN rx THEN 1.5 ELSE 1 END) * (CASE WHEN n > 1 THEN 1 + 0.2 * (n - 1) ELSE 1 END) * (CASE WHEN rx THEN 1 ELSE 0.8 END))), 6) AS confidence FROM evidence",
    "accepted_entities": f"WITH {SCORES} SELECT entity, count(*) AS n_docs, round(avg(confidence), 6) AS mean_confidence FROM accepted GROUP BY entity",
    "accepted_top": f"WITH {SCORES} SELECT doc, arg_min(entity, struct_pack(a := -confidence, b := entity)) AS first_entity, cast(count(*) AS INT) AS n_accepted FROM accepted GROUP BY doc",
    "confidence_summary": f"""WITH {SCORES} SELECT count(*) AS total, round(coalesce(avg(confidence), 0.0), 6) AS mean_confidence, coalesce(min(confidence), 0.0) AS min_confidence, coalesce(max(confidence), 0.0) AS max_confidence,
count(*) FILTER (confidence >= 0.9) AS high, count(*) FILTER (confidence >= 0.7 AND confidence < 0.9) AS medium, count(*) FILTER (confidence >= 0.5 AND confidence < 0.7) AS low, count(*) FILTER (confidence < 0.5) AS below_threshold FROM scores""",
    "confidence_ranges": f"WITH {SCORES} SELECT doc, round(min(confidence), 3) AS min_confidence, round(max(confidence), 3) AS max_confidence FROM scores GROUP BY doc",
    "confidence_histogram": f"WITH {SCORES} SELECT CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' WHEN confidence >= 0.5 THEN 'low' ELSE 'below' END AS band, count(*) AS n_entities FROM accepted GROUP BY 1",
    "strategy_counts": f"WITH {SCORES} SELECT strategy, count(*) AS n_entities FROM (SELECT unnest(string_split(strategies, ',')) AS strategy FROM accepted) GROUP BY 1",
    "run_summary": f"""WITH {SCORES}, d AS (SELECT count(DISTINCT run_id || '/' || pmid) AS n FROM detections) SELECT d.n AS n_docs, count(*) AS n_entities, round(coalesce(count(*) / nullif(d.n, 0), 0.0), 6) AS entities_per_doc,
round(coalesce(avg(confidence), 0.0), 6) AS mean_confidence FROM accepted, d GROUP BY d.n""",
    "entity_match_classes": f"WITH {CLASSES} SELECT gold_id, line_id, cast(pos AS INT) AS pos, detected, match_class, candidate FROM classes",
    "match_statistics": f"""WITH {CLASSES} SELECT count(*) AS total_detected, count(*) FILTER (match_class = 'exact') AS n_exact, count(*) FILTER (match_class = 'partial') AS n_partial, count(*) FILTER (match_class = 'fuzzy') AS n_fuzzy,
count(*) FILTER (match_class = 'unmatched') AS n_unmatched, round(coalesce(count(*) FILTER (match_class <> 'unmatched') / nullif(count(*), 0), 0.0), 6) AS match_rate FROM classes""",
    "candidate_validation": f"WITH {VALIDATED} SELECT line_id, cast(pos AS INT) AS pos, candidate, verdict, CASE WHEN verdict = 'valid' THEN {strip('candidate')} END AS clean FROM validated",
    "match_suggestions": f"""WITH {CLASSES}, {VALIDATED}
SELECT line_id, 'Consider adding ''' || detected || ''' as a candidate entity' AS suggestion FROM classes WHERE match_class = 'unmatched'
UNION ALL SELECT line_id, '''' || detected || ''' and ''' || candidate || ''' are similar - consider standardizing' FROM classes WHERE match_class = 'fuzzy' AND lower(detected) <> lower(candidate)
UNION ALL SELECT line_id, 'Duplicate candidate: ''' || candidate || '''' FROM validated WHERE verdict = 'duplicate'""",
    "term_matches": f"""WITH {CLASSES} SELECT DISTINCT gold_id, line_id, f AS candidate FROM (
SELECT gold_id, line_id, pos, arg_min(candidate, k) FILTER (is_exact OR is_partial OR is_fuzzy) AS f FROM compared GROUP BY gold_id, line_id, pos) WHERE f IS NOT NULL""",
    "char_similarity": f"""WITH t AS (SELECT line_id, {texts('entidad')} AS t FROM corpus_docs),
p AS (SELECT line_id, i - 1 AS pos, t[i] AS a, t[i + 1] AS b, {match_form('t[i]')} AS m, {match_form('t[i + 1]')} AS n FROM (SELECT *, unnest(range(1, len(t))) AS i FROM t WHERE len(t) > 1))
SELECT line_id, cast(pos AS INT) AS pos, round({jaccard('m', 'n')}, 6) AS similarity, {fuzzy_pair(key('a'), key('b'))} AS is_fuzzy, {matches('m', 'n')} AS is_match FROM p""",
    "eval_documents": f"WITH {JUDGED} SELECT pred_id, pmid, cast(tp AS INT) AS tp, cast(np - tp AS INT) AS fp, cast(ng - tp AS INT) AS fn, cast(np AS INT) AS n_predicted, cast(ng AS INT) AS n_reference, round({ratio('tp', 'np')}, 9) AS precision, round({ratio('tp', 'ng')}, 9) AS recall FROM judged",
    "eval_overall": f"WITH {JUDGED} {metrics('judged', 9)}",
    "eval_strategies": f"""WITH {PREDICTIONS}, hits AS (SELECT unnest(e.strategies) AS strategy, len(list_filter(g.reference, lambda r: {matches(match_form('e.texto'), match_form('r'))})) > 0 AS hit FROM ents e JOIN gold g USING (pmid) WHERE len(g.reference) > 0)
SELECT strategy, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fp, round(count(*) FILTER (hit) / count(*), 9) AS precision FROM hits GROUP BY strategy""",
    "false_positives": f"WITH {FP} SELECT pred_id, pmid, entity, confidence, array_to_string(strategies, ',') AS strategies, coalesce(l, '') AS benchmark_entities FROM fp LEFT JOIN (SELECT pmid, string_agg(entity, '|' ORDER BY entity) AS l FROM known GROUP BY pmid) USING (pmid)",
    "false_positives_by_strategy": f"WITH {FP} SELECT strategy, count(*) AS n FROM (SELECT unnest(strategies) AS strategy FROM fp) GROUP BY strategy",
    "false_negatives": f"WITH {FN} SELECT pmid, entity FROM fn",
    "false_negatives_by_document": f"WITH {FN} SELECT pmid, count(*) AS n, string_agg(entity, '|' ORDER BY entity) AS entities FROM fn GROUP BY pmid",
    "false_negative_details": f"""WITH {FN}, said AS (SELECT pmid, string_agg(DISTINCT {key('texto')}, '|' ORDER BY {key('texto')}) AS l FROM ents GROUP BY pmid), last AS (SELECT pmid, arg_max(texto, line_id) AS t FROM corpus_docs WHERE texto IS NOT NULL GROUP BY pmid)
SELECT fn.pmid, entity, coalesce(l, '') AS predicted_entities, CASE WHEN length(t) > 200 THEN left(t, 200) || '...' ELSE t END AS preview FROM fn LEFT JOIN said USING (pmid) LEFT JOIN last USING (pmid)""",
    "error_totals": f"""WITH {PREDICTIONS}, mine AS (SELECT r.pred_id, r.pmid, count(DISTINCT {key('e.texto')}) AS n FROM raw r LEFT JOIN ents e ON e.pred_id = r.pred_id GROUP BY ALL), known AS (SELECT DISTINCT pmid, {key('r')} AS entity FROM (SELECT pmid, unnest(reference) AS r FROM gold)),
sizes AS (SELECT g.pmid, count(k.entity) AS k FROM gold g LEFT JOIN known k USING (pmid) GROUP BY g.pmid), said AS (SELECT DISTINCT pmid, {key('texto')} AS entity FROM ents)
SELECT (SELECT cast(sum(n) AS BIGINT) FROM mine) AS n_predicted, (SELECT cast(sum(k) AS BIGINT) FROM mine JOIN sizes USING (pmid)) AS n_benchmark, (SELECT count(DISTINCT pmid) FROM mine) AS n_pmids,
(SELECT cast(sum(k) AS BIGINT) FROM sizes WHERE pmid IN (SELECT pmid FROM raw)) AS n_reference, (SELECT count(*) FROM said WHERE pmid IN (SELECT pmid FROM sizes)) AS n_detected, (SELECT count(*) FROM sizes WHERE pmid IN (SELECT pmid FROM raw)) AS n_pmids_with_benchmark,
(SELECT count(*) FROM (SELECT DISTINCT pred_id, pmid, {key('texto')} AS entity FROM ents) ANTI JOIN known USING (pmid, entity)) AS n_false_positives,
(SELECT count(*) FROM known ANTI JOIN said USING (pmid, entity) WHERE pmid IN (SELECT pmid FROM raw)) AS n_false_negatives""",
    "param_grid_chunks": "SELECT t.chunk, o.overlap FROM (VALUES (20), (40), (60), (80), (100)) t(chunk), (VALUES (10), (20), (30), (40), (50)) o(overlap) WHERE o.overlap < t.chunk",
    "param_grid_temperatures": "SELECT cast(t / 10 AS DOUBLE) AS temperature, cast(c / 10 AS DOUBLE) AS confidence FROM range(0, 11) a(t), range(1, 6) b(c)",
    "grid_profile": f"WITH {PREDICTIONS}, {PROFILE} SELECT * FROM profile",
    "grid_means_chunks": f"""WITH {RESULTS} SELECT CASE WHEN grouping(chunk) = 0 THEN 'model+chunk' ELSE 'model+overlap' END AS grouping, model, chunk, overlap, count(*) AS n, {MEANS}
FROM results WHERE model IS NOT NULL GROUP BY GROUPING SETS ((model, chunk), (model, overlap))""",
    "grid_means_temperatures": f"""WITH {RESULTS} SELECT CASE WHEN grouping(temperature) = 0 THEN 'temperature' ELSE 'min_confidence' END AS grouping, temperature, min_confidence, count(*) AS n, {MEANS}
FROM results WHERE temperature IS NOT NULL GROUP BY GROUPING SETS ((temperature), (min_confidence))""",
    "grid_top_f1": f"WITH {RESULTS} SELECT model, chunk, overlap, f1_score, entities FROM results WHERE model IS NOT NULL AND f1_score > 0 ORDER BY f1_score DESC, model, chunk, overlap LIMIT 10",
    "grid_top_entities": f"WITH {RESULTS} SELECT temperature, min_confidence, entities, avg_conf FROM results WHERE temperature IS NOT NULL ORDER BY entities DESC, temperature, min_confidence LIMIT 10",
    "bio_entities": f"WITH {LABELLED} SELECT doc AS doc_id, entity_no, type, md5(txt) AS text_md5, n AS n_tokens FROM entities",
    "bio_documents": f"""WITH {LABELLED}, whole AS (SELECT doc, string_agg(token, ' ' ORDER BY pos) AS t FROM tokens GROUP BY doc),
named AS (SELECT doc, count(*) AS n, string_agg(CASE type WHEN 'problem' THEN 'SpecificDisease' WHEN 'test' THEN 'Test' END, ',' ORDER BY entity_no) AS k FROM entities GROUP BY doc)
SELECT doc AS doc_id, md5(t) AS text_md5, cast(coalesce(n, 0) AS INT) AS n_entities, md5(coalesce(k, '')) AS types_md5 FROM whole LEFT JOIN named USING (doc)""",
    "pubtator_documents": f"""WITH d AS (SELECT pmid, gold_id, gold_id % 16 AS f, list_filter(entidad, lambda e: e.texto IS NOT NULL) AS e FROM benchmark_docs WHERE regexp_matches(pmid, '^[0-9]+$')),
k AS (SELECT pmid, gold_id, list_filter(coalesce(list_transform(e, lambda x: struct_pack(t := {strip('x.texto')}, k := CASE WHEN x.tipo = 'SpecificDisease' THEN 'SpecificDisease' END)), []), lambda x: x.k IS NOT NULL) AS e FROM d),
u AS (SELECT pmid, gold_id, list_filter(range(1, len(e) + 1), lambda i: list_position(e, e[i]) = i) AS ix, e FROM k)
SELECT pmid AS PMID, 'Title ' || gold_id || ' Abstract' AS Texto, cast(len(ix) AS INT) AS n_entities, md5(array_to_string(list_transform(ix, lambda i: e[i].t || '/' || e[i].k), '|')) AS entities_md5 FROM u""",
    "prompt_keys": """WITH p AS (SELECT 'Diseases in this text: ' || texto || chr(10) || chr(10) || 'Return ONLY a JSON list like: ["disease1", "disease2"]' AS prompt FROM corpus_docs WHERE texto IS NOT NULL)
SELECT md5('llama-nova:3b:' || 'You are a biomedical entity extractor. Extract disease names and medical conditions from the text.

RULES:
1. Only extract entities that are diseases/conditions
2. Be conservative - if unsure, don''t extract
3. Return entities in valid JSON format
4. Evidence must be the EXACT literal mention from the text

Output ONLY valid JSON with no explanations.' || ':' || prompt) AS key, count(*) AS n_uses FROM p GROUP BY prompt""",
}
