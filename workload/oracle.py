"""The same questions in DuckDB's SQL, written from the definitions and not from the Spark plans."""

from __future__ import annotations

import os

import yaml

from siftmark.sources.rules import PACKS

ORACLE: dict[str, str] = {}

_FILES = """files AS (
  SELECT source AS job_id, source || '/' || doc_id || '.txt' AS path, lang AS language, text AS content FROM documents)"""

_LINES = """cut AS (
  SELECT job_id, path, language, string_split(CASE WHEN ends_with(content, chr(10)) THEN left(content, length(content) - 1) ELSE content END, chr(10)) AS ls
  FROM files WHERE content <> ''),
lines AS (
  SELECT job_id, path, language, unnest(generate_series(1, len(ls)))::INT AS line, regexp_replace(unnest(ls), '\\r$', '') AS text FROM cut)"""

# The rules as data: id, name, category, severity, languages, required, pattern, message, fix.
_PROSE = [
    ("TXT-101", "Dotted quad", "security", "low", ["*"], False, r'[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+',
     "The text holds four numbers with dots between.", "Write a name in place of the numbers."),
    ("TXT-102", "Mail address in text", "compliance", "medium", ["*"], False, r'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}',
     "The text holds a mail address.", "Mask the address."),
    ("TXT-103", "Long number", "compliance", "high", ["*"], False, r'\b[0-9]{13,16}\b',
     "The text holds a number as long as a card number.", ""),
    ("TXT-104", "Phone number", "compliance", "medium", ["*"], False, r'\([0-9]{3}\) [0-9]{3}-[0-9]{4}',
     "The text holds a phone number.", ""),
    ("TXT-105", "Assigned token", "security", "critical", ["*"], False, r"""(?i)\b(token|secret|api_key)\s*=\s*["'][^"']{6,}["']""",
     "A token is written out in the text.", "Remove the token and revoke it."),
    ("TXT-201", "Copyleft license named", "license", "high", ["*"], False, r'(?i)general public licen[sc]e',
     "The text stands under a copyleft license.", ""),
    ("TXT-202", "Permissive license named", "license", "info", ["*"], False, r'(?i)\b(?:MIT|Apache|BSD)\s+License\b',
     "The text names a permissive license.", ""),
    ("TXT-301", "Lone word", "style", "info", ["*"], False, r'^\S+$',
     "The line is a single word.", ""),
    ("TXT-302", "Symbol noise", "quality", "low", ["*"], False, r'[%#*&$]{3}',
     "The line holds runs of symbols.", ""),
    ("TXT-303", "Table bar", "style", "info", ["*"], False, r'\s\|\s',
     "The line looks like the row of a table.", ""),
    ("TXT-401", "Doubled article", "quality", "low", ["en"], False, r'(?i)\bthe the\b',
     "The article stands twice.", ""),
    ("TXT-402", "Doubled preposition", "quality", "low", ["fr", "es"], False, r'\bde de\b',
     "The preposition stands twice.", ""),
    ("TXT-403", "Doubled conjunction", "quality", "low", ["de"], False, r'\bund und\b',
     "The conjunction stands twice.", ""),
    ("TXT-501", "Sentence end missing", "style", "medium", ["en", "fr"], True, r'[.!?]\s*$',
     "The text does not end with a sentence end.", ""),
    ("TXT-502", "License missing", "license", "info", ["de"], True, r'(?i)licen[sc]e',
     "The text names no license.", ""),
]


def _listed(path):
    """The enabled rules of a pack file, as rows like those above, and the places of the others."""
    with open(path) as f:
        rules = yaml.safe_load(f)["rules"]
    rows = [
        (r["id"], r["name"], r["category"], r["severity"], [x.lower() for x in r["languages"]], r["pattern"].get("negate", False),
         r["pattern"]["match"], r["message"], r.get("fix", ""))
        for r in rules if r["enabled"]
    ]
    return rows, tuple(i for i, r in enumerate(rules) if not r["enabled"])


_WEB, _WEB_GAPS = _listed(os.path.join(PACKS, "weakness", "catalogue.yaml"))


def _quote(text):
    return "'" + text.replace("'", "''") + "'"


def _rules(rows, gaps=()):
    """The rules as a relation; `gaps` are positions of rules the pack has and SQL leaves out."""
    places = [i for i in range(len(rows) + len(gaps)) if i not in gaps]
    values = [
        f"({seq}, {_quote(i)}, {_quote(name)}, {_quote(cat)}, {_quote(sev)}, {langs!r}, {str(neg).lower()}, {_quote(msg)}, {_quote(fix)})"
        for seq, (i, name, cat, sev, langs, neg, _, msg, fix) in zip(places, rows)
    ]
    return "rules(seq, rule_id, name, category, severity, languages, negate, message, fix) AS (VALUES\n  " + ",\n  ".join(values) + ")"


_RULES = _rules(_PROSE, gaps=(10,))
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _fits(rule):
    langs = rule[4]
    return "true" if "*" in langs else f"lower(language) IN ({', '.join(map(_quote, langs))})"


def _regex_hits(rows=None):
    """One scan of the lines per rule, each with a constant pattern."""
    parts = []
    for rule in rows or _PROSE:
        pattern, i = rule[6], rule[0]
        if not rule[5]:
            before = _quote("^((?s:.*?))(?:" + pattern + ")")
            parts.append(f"""SELECT job_id, path, line, text, {_quote(i)} AS rule_id, strlen(regexp_extract(text, {before}, 1)) + 1 AS pos
  FROM lines WHERE {_fits(rule)} AND regexp_matches(text, {_quote(pattern)})""")
    return "line_hits AS (\n  " + "\n  UNION ALL ".join(parts) + f"""),
regex_findings AS (
  SELECT job_id, path AS file, line, pos::INT AS "column", rule_id, name AS rule_name, category, severity, message,
    trim(text, {_WHITE}) AS snippet, fix AS fix_suggestion, 0 AS phase, seq AS rule_seq, 0 AS match_idx FROM line_hits JOIN rules USING (rule_id))"""


def _required(rows=None):
    parts = [
        f"SELECT job_id, path, {_quote(r[0])} AS rule_id FROM files WHERE {_fits(r)} AND NOT regexp_matches(content, {_quote(r[6])})"
        for r in rows or _PROSE if r[5]
    ]
    return "missing AS (\n  " + "\n  UNION ALL ".join(parts) + """),
required_findings AS (
  SELECT job_id, path AS file, 1 AS line, 1 AS "column", rule_id, name AS rule_name, category, severity, message,
    '' AS snippet, fix AS fix_suggestion, 0 AS phase, seq AS rule_seq, 0 AS match_idx FROM missing JOIN rules USING (rule_id))"""


_REQUIRED = _required()

_SECRETS = r"""assigned AS (
  SELECT job_id, path, line, text, list_filter(regexp_extract_all(text, '(?i)[\w_-]+\s*[:=]\s*["'']([^"''\s]{12,})["'']', 1),
    lambda v: regexp_full_match(v, '[A-Za-z0-9+/=_\-]{12,}')) AS vs
  FROM lines WHERE NOT regexp_matches(text, '^\s*(//|#|\*)')),
scored AS (
  SELECT *, round(list_aggregate(string_split(v, ''), 'entropy'), 12) AS e
  FROM (SELECT job_id, path, line, text, unnest(vs) AS v, unnest(generate_series(0, len(vs) - 1))::INT AS idx FROM assigned WHERE len(vs) > 0)),
secret_findings AS (
  SELECT job_id, path AS file, line, 1 AS "column", 'ENT-001' AS rule_id, 'High-entropy string (possible secret)' AS rule_name,
    'security' AS category, 'high' AS severity,
    'High-entropy string detected (entropy=' || printf('%d.%02d', (floor(e * 100)::INT // 100), floor(e * 100)::INT % 100) || '). Possible hardcoded secret: ' || left(v, 4) || '***' || right(v, 4) AS message,
    trim(text, """ + _WHITE + r""") AS snippet, 'Move to an environment variable or secrets manager.' AS fix_suggestion, 1 AS phase, 0 AS rule_seq, idx AS match_idx
  FROM scored WHERE e >= 3.0)"""

_ALL = "findings AS (SELECT * FROM regex_findings UNION ALL SELECT * FROM required_findings UNION ALL SELECT * FROM secret_findings)"
_ORDER = "phase, replace(file, '/', chr(1)), rule_seq, line, match_idx"
_COUNTS = """count(f.file) AS total_findings, count(f.file) FILTER (severity = 'critical') AS n_critical, count(f.file) FILTER (severity = 'high') AS n_high,
  count(f.file) FILTER (severity = 'medium') AS n_medium, count(f.file) FILTER (severity = 'low') AS n_low, count(f.file) FILTER (severity = 'info') AS n_info"""


def _summary(findings="findings", jobs="(SELECT DISTINCT job_id FROM files)"):
    return f"""counts AS (SELECT j.job_id, {_COUNTS} FROM {jobs} j LEFT JOIN {findings} f ON f.job_id = j.job_id GROUP BY j.job_id),
summary AS (
  SELECT *, greatest(0.0, 100 - 20 * n_critical - 10 * n_high - 4 * n_medium - n_low)::DOUBLE AS score,
    n_critical + n_high = 0 AS passed FROM counts)"""


_FINDINGS = ",\n".join([_FILES, _LINES, _RULES, _regex_hits(), _REQUIRED, _SECRETS, _ALL])
_SUMMED = _FINDINGS + ",\n" + _summary()
_RESULTS = _SUMMED + """,
results AS (SELECT *, 'corpus' AS repo_owner, job_id AS repo_name, sha256(job_id) AS commit_sha, 1200 AS duration_ms, epoch(TIMESTAMP '2024-02-01 00:00:00')::BIGINT AS done FROM summary)"""
_PLACE = 'job_id, file, line, "column", rule_id'
_N = "job_id, total_findings, n_critical, n_high, n_medium, n_low, n_info"


def _o(name: str, sql: str) -> None:
    ORACLE[name] = sql


def _from(ctes: str, sql: str) -> str:
    return f"WITH {ctes}\n{sql}"


_o("rule_listing", _from(_FILES + ",\n" + _RULES, """
SELECT r.rule_id, r.severity, r.category, r.name, r.enabled, coalesce(u.files, 0) AS files
FROM (SELECT rule_id, severity, category, name, true AS enabled FROM rules
      UNION ALL VALUES ('TXT-304', 'low', 'quality', 'Shouting', false), ('TXT-901', 'high', 'quality', 'Structure check', true)) r
LEFT JOIN (SELECT rule_id, count(*) AS files FROM files JOIN
   (SELECT rule_id, languages FROM rules UNION ALL VALUES ('TXT-901', ['*'])) q
   ON list_contains(languages, '*') OR list_contains(languages, lower(language)) GROUP BY rule_id) u ON u.rule_id = r.rule_id"""))
_o("line_listing", _from(_FILES + ",\n" + _LINES, """
SELECT job_id, path, language, line, strlen(text) AS bytes FROM lines WHERE NOT regexp_matches(text, '^\\s*(//|#|\\*)')"""))
_o("scan_regex", _from(",\n".join([_FILES, _LINES, _RULES, _regex_hits()]),
   f"SELECT {_PLACE}, severity, category, rule_name, message, snippet, fix_suggestion FROM regex_findings"))
_o("scan_required", _from(",\n".join([_FILES, _RULES, _REQUIRED]), f"SELECT {_PLACE}, severity, message, snippet FROM required_findings"))
_o("scan_secrets", _from(",\n".join([_FILES, _LINES, _SECRETS]), f"SELECT {_PLACE}, severity, message, snippet, match_idx FROM secret_findings"))

_PAGE_FILES = r"""files AS (SELECT regexp_extract(url, '^\w+://([^/]+)', 1) AS job_id, 'pages/' || page_id || '.html' AS path, 'javascript' AS language, html AS content FROM pages)"""
_o("scan_pages", _from(",\n".join([_PAGE_FILES, _LINES, _rules(_WEB, _WEB_GAPS), _regex_hits(_WEB), _required(_WEB), _SECRETS]),
   " UNION ALL ".join(f"SELECT {_PLACE}, severity, message FROM {k}_findings" for k in ("regex", "required", "secret"))))
_TURN_FILES = "files AS (SELECT 'c' || conv_id AS job_id, role || '/' || turn || '.txt' AS path, 'en' AS language, text AS content FROM conversations)"
_o("scan_turns", _from(",\n".join([_TURN_FILES, _LINES, _RULES, _regex_hits(), _REQUIRED, _SECRETS, _ALL, _summary()]), f"SELECT {_N}, score, passed FROM summary"))
_o("scan_corpus_summary", _from(_SUMMED, f"SELECT {_N}, score, passed, (n_critical + n_high > 0)::INT AS exit_code FROM summary"))

_KEPT = """kept AS (SELECT * FROM findings WHERE NOT (starts_with(file, 'src1/') OR starts_with(file, 'src2/') OR starts_with(file, 'src10/1'))),
firsts AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY {order}) <= 100),
kept_jobs AS (SELECT DISTINCT job_id FROM files WHERE NOT (starts_with(path, 'src1/') OR starts_with(path, 'src2/') OR starts_with(path, 'src10/1')))""".format(order=_ORDER)
_o("scan_corpus_limited", _from(_FINDINGS + ",\n" + _KEPT + ",\n" + _summary("firsts", "kept_jobs"), f"SELECT {_N}, score, passed FROM summary"))

_o("scan_long_texts", _from(_FINDINGS, f"SELECT {_PLACE}, message, snippet FROM findings"))
_o("stored_long_texts", _from(_FINDINGS, f"SELECT {_PLACE}, message FROM findings"))
_o("scan_own_kinds", _from(_FILES + ",\n" + _LINES, """
SELECT job_id, path AS file, line, (strlen(left(text, 120)) + 1)::INT AS "column", 'OWN-1' AS rule_id, 'low' AS severity, 'max_length 120' AS message FROM lines WHERE length(text) > 120
UNION ALL SELECT job_id, path, line, 1, 'OWN-2', 'low', 'digits 12' FROM lines WHERE language IN ('en', 'de') AND length(regexp_replace(text, '[^0-9]', '', 'g')) >= 12
UNION ALL SELECT job_id, path, 1, 1, 'OWN-3', 'low', 'digits 8' FROM files WHERE content IS NOT NULL
  AND path NOT IN (SELECT path FROM lines WHERE length(regexp_replace(text, '[^0-9]', '', 'g')) >= 8)
UNION ALL SELECT job_id, path, line, (strlen(regexp_extract(text, '^((?s:.*?))(?:[0-9]{4})', 1)) + 1)::INT, 'OWN-4', 'info', 'number' FROM lines WHERE regexp_matches(text, '[0-9]{4}')"""))

# -- file trees, stored trigrams, scans side by side ----------------------------

_TREE = """tree AS (SELECT doc_id, source AS job_id, coalesce(text, '') AS content, 'src/' ||
    CASE WHEN doc_id % 11 = 0 THEN 'node_modules' WHEN doc_id % 7 = 0 THEN '.h' || (doc_id // 100) ELSE 'd' || (doc_id // 100) END || '/' ||
    CASE WHEN doc_id % 5 = 0 THEN '.f' ELSE 'f' END || doc_id || CASE WHEN doc_id % 13 = 0 THEN '.png' WHEN doc_id % 2 = 0 THEN '.py' ELSE '.txt' END AS path FROM documents)"""
_o("tree_scan", _from(_TREE, """
SELECT job_id, path, CASE WHEN ends_with(path, '.py') THEN 'python' ELSE 'unknown' END AS language, strlen(content)::BIGINT AS bytes, sha256(content) AS digest
FROM tree WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0"""))
_o("tree_skipped", _from(_TREE, """
SELECT job_id, path, strlen(content)::BIGINT AS bytes, CASE WHEN doc_id % 11 = 0 THEN 'skipped folder' WHEN doc_id % 13 = 0 THEN 'binary' ELSE 'too large' END AS reason
FROM tree WHERE doc_id % 11 = 0 OR doc_id % 13 = 0 OR strlen(content) > 20000"""))
_o("candidate_scan", _from(_FINDINGS, f"SELECT {_PLACE} FROM findings"))
_o("scan_history", _from(_FINDINGS, f"""
SELECT scan_id, jobs.job_id, count(severity) AS total_findings, greatest(0.0, 100 - coalesce(sum(CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 10 WHEN 'medium' THEN 4 WHEN 'low' THEN 1 ELSE 0 END), 0))::DOUBLE AS score,
  count(severity) AS n
FROM (VALUES ('nightly'), ('other')) ids(scan_id) CROSS JOIN (SELECT DISTINCT source AS job_id FROM documents) jobs LEFT JOIN (
  SELECT 'nightly' AS scan, job_id, severity FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY {_ORDER}) AS rank FROM findings) WHERE rank <= 20
  UNION ALL SELECT 'other', job_id, severity FROM findings WHERE rule_id <> 'ENT-001') f ON scan = scan_id AND f.job_id = jobs.job_id
GROUP BY scan_id, jobs.job_id"""))

_o("changed_scan", _from(_FINDINGS, f"""
SELECT {_PLACE} FROM findings WHERE file IN (
  SELECT source || '/' || doc_id || '.txt' FROM documents JOIN labels USING (doc_id) WHERE quality = 0 OR toxic = 1)"""))
_o("exclude_scan", _from(_FINDINGS, f"SELECT {_PLACE} FROM findings WHERE NOT starts_with(file, 'src1/') AND NOT starts_with(file, 'src3')"))
_o("tag_language", """
SELECT doc_id, source || '.' || doc_id || CASE lang WHEN 'en' THEN '.PY' WHEN 'fr' THEN '.tar.go' WHEN 'de' THEN '.d/README' ELSE '.odd' END AS path,
  CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'go' ELSE 'unknown' END AS language,
  CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.go' WHEN 'de' THEN '' ELSE '.odd' END AS extension FROM documents""")


def _listing(key):
    return f"""(SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT {key} AS k, count(*) AS n FROM findings f WHERE f.job_id = s.job_id GROUP BY 1))"""


_o("summary_by_job", _from(_SUMMED + """,
sev AS (SELECT job_id, string_agg(k || '=' || n, ',' ORDER BY k) AS t FROM (SELECT job_id, severity AS k, count(*) AS n FROM findings GROUP BY ALL) GROUP BY job_id),
cat AS (SELECT job_id, string_agg(k || '=' || n, ',' ORDER BY k) AS t FROM (SELECT job_id, category AS k, count(*) AS n FROM findings GROUP BY ALL) GROUP BY job_id)""", f"""
SELECT s.*, coalesce(sev.t, '') AS severities, coalesce(cat.t, '') AS categories FROM (SELECT {_N}, score, passed FROM summary) s
LEFT JOIN sev USING (job_id) LEFT JOIN cat USING (job_id)"""))
_o("policy_verdict", _from(_SUMMED, """
SELECT job_id, passed AS allowed, NOT passed AS blocked, n_critical + n_high AS n_errors, total_findings - n_critical - n_high AS n_warnings FROM summary"""))
_TEXT = "'[' || rule_id || '] ' || message || ' at ' || file || ':' || line"
_o("policy_messages", _from(_FINDINGS, f"""
SELECT job_id, CASE WHEN severity IN ('critical', 'high') THEN 'error' ELSE 'warning' END AS kind, {_TEXT} AS text, rule_id, message AS reason FROM findings"""))
_PARTED = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY {_ORDER})::INT AS rank FROM findings),
parted AS (SELECT *, (rank - 1) // 40 AS part FROM ranked)"""
_o("policy_documents", _from(_FINDINGS + ",\n" + _PARTED, f"""
SELECT job_id, part, coalesce(string_agg({_TEXT}, chr(10) ORDER BY rank) FILTER (severity IN ('critical', 'high')), '') AS errors,
  sha256(coalesce(string_agg({_TEXT}, chr(10) ORDER BY rank) FILTER (severity NOT IN ('critical', 'high')), '')) AS warnings, count(*)::INT AS n_rules
FROM parted GROUP BY job_id, part"""))
_o("gate_by_level", _from(_SUMMED, """
SELECT job_id, (n_critical > 0)::INT AS code_critical, (n_critical + n_high > 0)::INT AS code_high, (n_critical + n_high + n_medium > 0)::INT AS code_medium,
  (total_findings > 0)::INT AS code_low, 0 AS code_never, 0 AS code_other FROM summary"""))
_RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY {_ORDER})::INT AS rank FROM findings)"
_o("job_listing", _from(_SUMMED, "SELECT job_id, 'corpus/' || job_id AS repo, score, passed FROM summary"))
_o("capped_findings", _from(_FINDINGS + ",\n" + _RANKED, f"SELECT rank, {_PLACE} FROM ranked WHERE rank <= 15"))
_o("job_report", _from(_RESULTS + ",\n" + _RANKED + """,
tops AS (SELECT job_id, string_agg('[' || rule_id || '] ' || file || ':' || line || '  ' || message, chr(10) ORDER BY rank) AS top FROM ranked WHERE rank <= 15 GROUP BY job_id)""", """
SELECT job_id, repo_owner, repo_name, score, passed, total_findings, duration_ms::BIGINT AS duration_ms, coalesce(top, '') AS top,
  greatest(total_findings - 15, 0) AS more FROM results LEFT JOIN tops USING (job_id)"""))
_o("top_rules", _from(_FINDINGS, "SELECT rule_id, severity, count(*) AS findings, min(job_id) AS first_job FROM findings GROUP BY ALL ORDER BY findings DESC, rule_id, severity LIMIT 10"))
_o("top_files", _from(_FINDINGS, "SELECT file, count(*) AS findings, min(job_id) AS first_job FROM findings GROUP BY ALL ORDER BY findings DESC, file LIMIT 25"))
_o("severity_totals", _from(_FINDINGS, """
SELECT severity, count(*) AS findings, list_position(['critical', 'high', 'medium', 'low', 'info'], severity)::INT AS rank FROM findings GROUP BY severity"""))
_o("findings_cube", _from(_FINDINGS, "SELECT category, severity, count(*) AS findings FROM findings GROUP BY CUBE (category, severity)"))
_o("findings_by_quality", _from(_FINDINGS + ",\nper_file AS (SELECT file, count(*) AS n FROM findings GROUP BY file)", """
SELECT quality, toxic, count(*) AS files, coalesce(sum(n), 0)::BIGINT AS findings FROM labels JOIN documents USING (doc_id)
LEFT JOIN per_file ON file = source || '/' || doc_id || '.txt' GROUP BY quality, toxic"""))



def _fired():
    """Every rule of the pack, whatever its languages, with the test of a document."""
    rules = [(r[0], r[6], r[5]) for r in _PROSE] + [("TXT-304", "[A-Z]{4,}", False)]
    for i, pattern, required in rules:
        text = _quote(pattern)
        yield i, f"NOT regexp_matches(content, {text})" if required else f"len(list_filter(ls, lambda l: regexp_matches(l, {text}))) > 0"
    yield "TXT-901", "false"


_JUDGED = _FILES + ",\n" + r"""cut AS (SELECT doc_id, quality = 0 AS expected, text AS content, string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS ls
  FROM documents JOIN labels USING (doc_id)),
judged AS (
  """ + "\n  UNION ALL ".join(f"SELECT doc_id, {_quote(i)} AS rule_id, expected, {fired} AS fired FROM cut" for i, fired in _fired()) + ")"
_o("rule_backtest", _from(_JUDGED, """
SELECT rule_id, count(*) AS total, count(*) FILTER (expected = fired) AS passed, count(*) FILTER (expected <> fired) AS failed FROM judged GROUP BY rule_id"""))
_o("rule_backtest_failures", _from(_JUDGED, "SELECT doc_id, rule_id, expected AS expected_fire, fired FROM judged WHERE expected <> fired"))

_DEPS = """deps AS (
  SELECT p_brand AS job_id, p_partkey || '/requirements.txt' AS path, 'pypi' AS ecosystem, 'p' || p_partkey AS name, p_size || '.0' AS version, 0 AS i FROM part
  UNION ALL SELECT p_brand, p_partkey || '/requirements.txt', 'pypi', 'free-' || p_partkey, '', 0 FROM part
  UNION ALL SELECT p_brand, p_partkey || '/package.json', 'npm', 'p' || p_partkey, '^' || p_size || '.0.0', 0 FROM part
  UNION ALL SELECT p_brand, p_partkey || '/package.json', 'npm', 'free-' || p_partkey, '', 0 FROM part
  UNION ALL SELECT p_brand, p_partkey || '/package.json', 'npm', 'dev-' || p_partkey, '', 0 FROM part
  UNION ALL SELECT p_brand, p_partkey || '/go.mod', 'go', 'x.org/p' || p_partkey, 'v' || p_size || '.0.0', 0 FROM part
  UNION ALL SELECT p_brand, p_partkey || '/go.mod', 'go', 'x.org/in' || p_partkey, 'v1.0.0', 0 FROM part
  UNION ALL SELECT p_brand, p_partkey || '/go.mod', 'go', 'x.org/free' || p_partkey, '', 0 FROM part
  UNION ALL SELECT p_brand, p_partkey || '/Cargo.toml', 'cargo', 'p' || p_partkey, p_size || '.0', 0 FROM part
  UNION ALL SELECT p_brand, p_partkey || '/Cargo.toml', 'cargo', 'free-' || p_partkey, '', 0 FROM part
  UNION ALL SELECT p_brand, p_partkey || '/Cargo.toml', 'cargo', 'd' || p_partkey, p_size::VARCHAR, 0 FROM part
  UNION ALL SELECT p_brand, p_partkey || '/pom.xml', 'maven', 'g:p' || p_partkey, p_size::VARCHAR, 0 FROM part
  UNION ALL SELECT p_brand, p_partkey || '/pom.xml', 'maven', 'g:free' || p_partkey, '', 0 FROM part)"""
_o("dependency_inventory", _from(_DEPS, "SELECT job_id, path, ecosystem, name, version FROM deps"))
_o("unpinned_deps", _from(_DEPS, """
SELECT job_id, path AS file, 1 AS line, 1 AS "column", 'DEP-001' AS rule_id, 'medium' AS severity, 'compliance' AS category,
  'Unpinned dependency: ' || name AS message FROM deps WHERE version = ''"""))
_o("unpinned_scan", _from(_DEPS, """
SELECT job_id, count(*) FILTER (version = '') AS n_medium, count(*) FILTER (version = '') AS total_findings,
  greatest(0.0, 100 - 4 * count(*) FILTER (version = ''))::DOUBLE AS score, true AS passed FROM deps GROUP BY job_id"""))

_o("dependency_versions", """
WITH parts AS (SELECT p_brand AS job_id, p_partkey AS k, p_size AS s, regexp_extract(p_brand, '([0-9]+)', 1) AS n FROM part)
SELECT job_id, 'mods/m' || k || '/' || file AS path, ecosystem, name, version FROM (
  SELECT *, unnest([
    {'file': 'pom.xml', 'ecosystem': 'maven', 'name': 'g:own' || k, 'version': s || '.1'}, {'file': 'pom.xml', 'ecosystem': 'maven', 'name': 'g:managed', 'version': '2.' || n},
    {'file': 'pom.xml', 'ecosystem': 'maven', 'name': 'g:deep' || k, 'version': 'x-near-' || n}, {'file': 'pom.xml', 'ecosystem': 'maven', 'name': 'g:rel', 'version': s::VARCHAR},
    {'file': 'pom.xml', 'ecosystem': 'maven', 'name': 'g:gone', 'version': ''}, {'file': 'pom.xml', 'ecosystem': 'maven', 'name': 'g:none', 'version': ''},
    {'file': 'Cargo.toml', 'ecosystem': 'cargo', 'name': 'tab' || k, 'version': s::VARCHAR}, {'file': 'Cargo.toml', 'ecosystem': 'cargo', 'name': 'cc' || k, 'version': '1'},
    {'file': 'Cargo.toml', 'ecosystem': 'cargo', 'name': 'nix' || k, 'version': '0.' || s}, {'file': 'Cargo.toml', 'ecosystem': 'cargo', 'name': 'free' || k, 'version': ''},
    {'file': 'package.json', 'ecosystem': 'npm', 'name': 'peer' || k, 'version': '>=' || s}, {'file': 'package.json', 'ecosystem': 'npm', 'name': 'opt' || k, 'version': ''}
  ], recursive := true) FROM parts)""")
_o("manifest_rejects", """
SELECT p_brand AS job_id, p_partkey || '/' || file AS path, reason FROM part, (VALUES ('package.json', 'no JSON object'), ('pom.xml', 'no whole project element'),
  ('go.mod', 'open require block'), ('Cargo.toml', 'open section header')) broken(file, reason) WHERE p_partkey % 5 = 0""")

# -- whole jobs: marked texts and manifests ------------------------------------

_WHOLE_FILES = r"""heads AS (SELECT *, split_part(text, chr(10), 1) AS h FROM documents),
lists AS (SELECT p_partkey AS k, p_size AS s FROM part),
files AS (
  SELECT source AS job_id, source || '/' || doc_id || '.txt' AS path, lang AS language, CASE doc_id % 7
    WHEN 0 THEN text WHEN 1 THEN h || ' scan:ignore' || substr(text, length(h) + 1) WHEN 2 THEN h || ' scan:ignore TXT-303, TXT-302' || substr(text, length(h) + 1)
    WHEN 3 THEN h || ' scan:ignore TXT-999' || substr(text, length(h) + 1) WHEN 4 THEN h || ' scan:ignore TXT-302 here' || substr(text, length(h) + 1)
    WHEN 5 THEN repeat(chr(10), 9) || 'scan:ignore-file' || chr(10) || text ELSE repeat(chr(10), 10) || 'scan:ignore-file' || chr(10) || text END AS content FROM heads
  UNION ALL SELECT 'src' || (k % 20), 'deps/' || k || '/' || name, 'unknown', content FROM (
    SELECT k, 'requirements.txt' AS name, format(E'# part\np{}=={}.0\nfree-{}\n-r more.txt\n', k, s, k) AS content FROM lists
    UNION ALL SELECT k, 'package.json', format('{{"name":"x","dependencies":{{"p{}":"^{}.0.0","free-{}":"*"}},"devDependencies":{{"dev-{}":"latest"}}}}', k, s, k, k) FROM lists
    UNION ALL SELECT k, 'go.mod', format(E'module m\n\nrequire x.org/p{} v{}.0.0\nrequire (\n\tx.org/in{} v1.0.0 // indirect\n\tx.org/free{}\n)\n', k, s, k, k) FROM lists
    UNION ALL SELECT k, 'Cargo.toml', format(E'[package]\nversion = "9"\n[dependencies]\np{} = "{}.0"\nfree-{} = {{ path = "../x" }}\n[dev-dependencies]\nd{} = {{ version = "{}" }}\n', k, s, k, k, s) FROM lists
    UNION ALL SELECT k, 'pom.xml', format(E'<project><dependencies>\n<dependency><groupId>g</groupId><artifactId>p{}</artifactId><version>{}</version></dependency>\n<dependency><groupId>g</groupId><artifactId>free{}</artifactId></dependency></dependencies></project>', k, s, k) FROM lists))"""
_UNSUPPRESSED = """quiet AS (SELECT job_id, path FROM cut WHERE len(list_filter(ls[1:10], lambda l: contains(l, 'scan:ignore-file'))) > 0),
marks AS (SELECT *, strpos(snippet, 'scan:ignore') AS spot, trim(substr(snippet, strpos(snippet, 'scan:ignore') + 11)) AS said FROM
  (SELECT * FROM regex_findings UNION ALL SELECT * FROM required_findings) f WHERE NOT EXISTS (FROM quiet q WHERE q.job_id = f.job_id AND q.path = f.file)),
findings AS (
  SELECT * EXCLUDE (spot, said) FROM marks WHERE spot = 0 OR NOT (said = '' OR list_contains(list_transform(string_split(said, ','), lambda x: trim(x)), rule_id))
  UNION ALL SELECT * FROM secret_findings
  UNION ALL SELECT 'src' || (split_part(path, '/', 1)::INT % 20), 'deps/' || path, 1, 1, 'DEP-001', 'Unpinned dependency', 'compliance', 'medium', 'Unpinned dependency: ' || name,
    '', 'Pin to an exact version for reproducible builds.', 2, 0, CASE WHEN starts_with(name, 'dev-') THEN 1 ELSE 0 END FROM deps WHERE version = '')"""
_WHOLE = ",\n".join([_WHOLE_FILES, _LINES, _RULES, _regex_hits(), _REQUIRED, _SECRETS, _DEPS, _UNSUPPRESSED])
_o("scan_whole_jobs", _from(_WHOLE, f"""
SELECT row_number() OVER (PARTITION BY job_id ORDER BY {_ORDER}) AS number, {_PLACE}, message, phase FROM findings"""))
_o("scan_whole_summary", _from(_WHOLE + ",\n" + _summary(), f"SELECT {_N}, score, passed, (n_critical + n_high > 0)::INT AS exit_code FROM summary"))

# -- ingest --------------------------------------------------------------------


def _hmac(data: str, secret: str) -> str:
    key = secret.encode().ljust(64, b"\0")
    blob = lambda pad: "'" + "".join(f"\\x{b ^ pad:02X}" for b in key) + "'::BLOB"
    return f"sha256({blob(0x5C)} || unhex(sha256({blob(0x36)} || encode({data}))))"


_ACTION = "CASE o_orderstatus WHEN 'O' THEN 'opened' WHEN 'P' THEN 'synchronize' ELSE 'closed' END"
_FULL = "CASE o_orderpriority WHEN '3-MEDIUM' THEN 'alone' ELSE 'cust' || o_custkey || '/repo/' || o_orderkey END"
_SENT = f"""sent AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'invalid signature' WHEN o_orderpriority = '1-URGENT' THEN 'ignored event'
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'invalid payload' WHEN o_orderstatus = 'F' THEN 'ignored action' END AS reason,
  o_custkey, o_orderdate, o_orderstatus, {_FULL} AS repo, o_orderpriority FROM orders)"""
# The text that ids are derived from: the parts with a zero byte between.
_ID = "left(sha256({parts}), 32)"
_BODY = f"""'{{"action":"' || {_ACTION} || '","number":' || o_orderkey || ',"pull_request":{{"head":{{"sha":"' || md5(o_orderkey::VARCHAR) ||
  '","ref":"main","repo":{{"clone_url":"https://x/' || o_custkey || '.git","full_name":"' || repo || '"}}}}}}}}'"""
_AT = "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"
_o("webhook_jobs", _from(_SENT, f"""
SELECT {_ID.format(parts=f"'github' || chr(0) || {_BODY} || chr(0) || {_AT}")} AS id, 'github' AS source, 'https://x/' || o_custkey || '.git' AS repo_url, split_part(repo, '/', 1) AS repo_owner,
  CASE WHEN repo = 'alone' THEN '' ELSE 'repo/' || o_orderkey END AS repo_name, md5(o_orderkey::VARCHAR) AS commit_sha, 'main' AS branch,
  o_orderkey::INT AS pr_number, 'queued' AS status, o_orderdate AS created_at FROM sent WHERE reason IS NULL"""))
_o("webhook_rejects", _from(_SENT, "SELECT o_orderkey, reason FROM sent WHERE reason IS NOT NULL"))
_o("webhook_verify", "SELECT o_orderkey, o_orderpriority <> '5-LOW' AS valid FROM orders")
_o("manual_jobs", f"""
SELECT {_ID.format(parts=f"'manual' || chr(0) || 'https://x/' || o_custkey || chr(0) || md5(o_orderkey::VARCHAR) || chr(0) || 'main' || chr(0) || {_AT}")} AS id,
  'manual' AS source, 'https://x/' || o_custkey AS repo_url, md5(o_orderkey::VARCHAR) AS commit_sha, 'main' AS branch, 'queued' AS status,
  o_orderdate AS created_at FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW'""")
_o("manual_rejects", """
SELECT 'repo_url and commit_sha required' AS reason, count(*) AS n, count(*) FILTER (o_orderpriority <> '5-LOW') AS with_commit
FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '5-LOW'""")

# -- audit log -----------------------------------------------------------------

_SIGN = _hmac("props", "workload-secret")
_o("audit_signed", f"""
SELECT 'e' || event_id AS id, 'job-' || user_id AS job_id, event_type, 'user-' || user_id AS actor, props AS payload, {_SIGN} AS signature, ts AS created_at FROM events""")
_LIFTED = """lifted AS (SELECT *, '{"job_id":"j' || user_id || '","event_type":"' || event_type || '","actor":' ||
  CASE WHEN event_type = 'error' THEN user_id::VARCHAR ELSE '"u' || user_id || '"' END || ',"n":' || event_id || '}' AS payload FROM events)"""
_o("audit_lifted", _from(_LIFTED, f"""
SELECT 'j' || user_id AS job_id, event_type, CASE WHEN event_type = 'error' THEN '' ELSE 'u' || user_id END AS actor, payload,
  {_hmac("payload", "workload-secret")} AS signature FROM lifted"""))
_o("audit_query", """
SELECT 'e' || event_id AS id, 'job-' || user_id AS job_id, event_type, ts AS created_at FROM events
WHERE event_type = 'error' AND ts >= '2024-01-05 00:00:00' AND ts <= '2024-01-25 12:00:00' ORDER BY ts DESC, id LIMIT 50 OFFSET 20""")
_o("audit_stored", """
SELECT event_type, count(*) AS n, min('e' || event_id) AS first_id FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-14 06:00:00' AND TIMESTAMP '2024-01-16 18:00:00' GROUP BY event_type""")
_o("audit_by_job", "SELECT 'e' || event_id AS id, ts AS created_at FROM events WHERE user_id = 7")


def _cut(text: str, n: int) -> str:
    """The first characters that fit in n - 1 bytes, where the text has more than n."""
    return f"CASE WHEN strlen({text}) <= {n} THEN {text} ELSE left({text}, list_max(list_filter(range({n}), lambda k: strlen(left({text}, k)) <= {n - 1}))) || '\u2026' END"


def _pad(text: str, n: int) -> str:
    return f"CASE WHEN length({text}) < {n} THEN rpad({text}, {n}, ' ') ELSE {text} END"


_o("audit_listing", f"""
WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN repeat('x', (event_id % 5)::INT) || repeat('\u00e9\u4e2d\U0001f600' || event_id, 3) ELSE 'e' || event_id END AS long_id,
    'job-' || user_id || '-of-a-long-name-' || event_id AS long_job, event_type, 'user-' || user_id AS actor FROM events),
cut AS (SELECT {_cut("long_id", 32)} AS id, {_cut("long_job", 24)} AS job_id, event_type, actor FROM e)
SELECT *, {_pad("id", 32)} || '  ' || {_pad("job_id", 24)} || '  ' || {_pad("event_type", 20)} || '  ' || actor AS text FROM cut""")
_o("text_heads", f"SELECT doc_id, {_cut('text', 61)} AS head FROM documents")
_o("audit_verify", f"""
SELECT 'e' || event_id AS id, {_hmac("CASE WHEN event_type = 'click' THEN props || ' ' ELSE props END", "workload-secret")} =
  CASE WHEN event_type = 'signup' THEN '' ELSE {_SIGN} END AS valid FROM events""")
_o("audit_verify_ids", """
SELECT 'e' || o_orderkey AS id, coalesce(event_type NOT IN ('click', 'signup'), false) AS valid FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN events ON event_id = o_orderkey""")
_o("audit_verify_counts", "SELECT count(*) AS verified, count(*) FILTER (event_type IN ('click', 'signup')) AS failed FROM events")

# -- metrics -------------------------------------------------------------------

_BOUNDS = "bounds(le, bound) AS (VALUES " + ", ".join(f"('{b}', {b}.0::DOUBLE)" for b in (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000)) + ", ('+Inf', 'infinity'::DOUBLE))"
_o("latency_histogram", _from(_BOUNDS, """
SELECT event_type, le, count(*) FILTER (value <= bound) AS bucket_count, round(sum(value), 4) AS total_sum, count(*) AS total_count
FROM events, bounds GROUP BY event_type, le"""))
_o("bucket_counts", """
WITH counts AS (SELECT event_type, ts::DATE AS day, floor(value)::BIGINT AS bound, count(*) AS n FROM events GROUP BY ALL)
SELECT *, sum(n) OVER (PARTITION BY event_type, day ORDER BY bound)::BIGINT AS bucket_count FROM counts""")
_QUANTILE = _BOUNDS + """,
h AS (SELECT event_type, ts::DATE AS day, bound, count(*) FILTER (value <= bound) AS c FROM events, bounds GROUP BY ALL),
w AS (SELECT *, max(c) OVER k AS total, coalesce(lag(c) OVER o, 0) AS below, coalesce(lag(bound) OVER o, 0) AS start FROM h
  WINDOW k AS (PARTITION BY event_type, day), o AS (PARTITION BY event_type, day ORDER BY bound)),
q AS (SELECT event_type, day, p, min_by(CASE WHEN isinf(bound) THEN start ELSE start + (bound - start) * (p * total - below) / (c - below) END, bound) AS v
  FROM w, (VALUES (0.5), (0.99)) ps(p) WHERE c >= p * total GROUP BY ALL)"""
_o("histogram_quantile", _from(_QUANTILE, """
SELECT event_type, day, round(max(v) FILTER (p = 0.5), 6) AS p50, round(max(v) FILTER (p = 0.99), 6) AS p99 FROM q GROUP BY event_type, day"""))
_o("service_counters", """
SELECT 'gateway' AS service, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS http_requests_total,
  count(*) FILTER (event_type = 'error') AS http_errors_total, round(sum(value), 4) AS latency_sum FROM events GROUP BY ALL""")
_o("event_counters", """
SELECT 'analysis' AS service, date_trunc('hour', ts)::TIMESTAMP AS window_start, metric, count(*) FILTER (event_type = kind) AS value
FROM events, (VALUES ('jobs_queued_total', 'signup'), ('jobs_completed_total', 'purchase'), ('jobs_failed_total', 'error'), ('evaluations_total', 'view'),
  ('entries_inserted_total', 'click'), ('entries_verified_total', '-'), ('verify_failed_total', '-'), ('notifications_sent_total', '-')) m(metric, kind)
GROUP BY ALL""")
_o("counter_rate", """
SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS window_start, round(coalesce(sum(inc), 0) / 3600.0, 9) AS rate FROM (
  SELECT *, CASE WHEN value < prev THEN value ELSE value - prev END AS inc FROM (
    SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY ALL""")
_BAND = "CASE WHEN {v} >= 20 THEN 'red' WHEN {v} >= 5 THEN 'yellow' WHEN {v} >= 0 THEN 'green' END"
_o("latest_value", f"""
SELECT user_id, value AS latest, ts AS "at", {_BAND.format(v="value")} AS band FROM events WHERE event_type <> 'view'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
_MOVE = "CASE WHEN event_type IN ('signup', 'click') THEN 1 WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 0 END"
_o("queue_depth", f"""
SELECT 'q' AS queue, event_id, depth, {_BAND.format(v="depth")} AS band FROM (
  SELECT event_id, (sum({_MOVE}) OVER (ORDER BY ts, event_id))::BIGINT AS depth FROM events)""")
_o("queue_depth_hot", f"SELECT event_id, (sum({_MOVE}) OVER (ORDER BY event_id * 7919 % 3600, event_id))::BIGINT AS depth FROM events")
_o("read_samples", """
SELECT event_type AS service, 'value' AS metric, 'gauge' AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 12:00:00' AND TIMESTAMP '2024-01-20 06:00:00' GROUP BY event_type""")
_o("inflight_requests", """
SELECT event_id, move, (sum(move) OVER (ORDER BY moved, move, event_id))::BIGINT AS inflight FROM (
  SELECT event_id, ts AS moved, 1 AS move FROM events UNION ALL
  SELECT event_id, ts + to_microseconds(round(value * 1000000)::BIGINT), -1 FROM events)""")

# -- sequences -----------------------------------------------------------------

_PROGRESS = """steps AS (SELECT user_id AS job_id, event_id AS id, ts AS moment,
    CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'finding' ELSE 'status_change' END AS type FROM events),
kept AS (SELECT * FROM (SELECT *, coalesce(max(type IN ('done', 'failed')) OVER (PARTITION BY job_id ORDER BY moment, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM steps) WHERE NOT over)"""
_o("job_progress", _from(_PROGRESS, 'SELECT job_id, id, type, moment AS "at" FROM kept'))
_o("latest_status", _from(_PROGRESS, "SELECT job_id, type AS status, moment AS since FROM kept QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY moment DESC, id DESC) = 1"))
_ROWS = "e AS (SELECT {key} AS k, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM events)"
_o("reuse_results", f"""
WITH RECURSIVE {_ROWS.format(key="user_id")},
r AS (SELECT k, n, event_id, t AS stored, false AS reused FROM e WHERE n = 1
  UNION ALL SELECT e.k, e.n, e.event_id, CASE WHEN e.t <= r.stored + 86400000000 THEN r.stored ELSE e.t END, e.t <= r.stored + 86400000000
  FROM r JOIN e ON e.k = r.k AND e.n = r.n + 1)
SELECT k AS user_id, event_id, reused FROM r""")


# -- exports -------------------------------------------------------------------

_LEVEL = "CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'info' THEN 'notice' ELSE 'warning' END"
_o("export_annotations", _from(_FINDINGS, f"""
SELECT job_id, '::' || {_LEVEL} || ' file=' || file || ',line=' || line || ',col=' || "column" || ',title=[' || rule_id || '] ' || rule_name || '::' || message AS text FROM findings"""))
_FINDING_JSON = """'{"rule_id":' || to_json(rule_id) || ',"rule_name":' || to_json(rule_name) || ',"category":' || to_json(category) || ',"severity":' || to_json(severity) ||
  ',"file":' || to_json(file) || ',"line":' || line || ',"column":' || "column" || ',"message":' || to_json(message) ||
  CASE WHEN snippet = '' THEN '' ELSE ',"snippet":' || to_json(snippet) END || CASE WHEN fix_suggestion = '' THEN '' ELSE ',"fix_suggestion":' || to_json(fix_suggestion) END || '}'"""

_o("export_json_lines", _from(_FINDINGS, f"SELECT job_id, {_FINDING_JSON} AS json FROM findings"))

def _documents(row, jobs, size=40):
    """Jobs with the JSON array of each part; a job without findings has one empty part."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY {_ORDER})::INT AS rank FROM findings),
parts AS (SELECT job_id AS j, (rank - 1) // {size} AS p, '[' || string_agg({row}, ',' ORDER BY rank) || ']' AS body, count(*) AS n FROM ranked GROUP BY ALL),
docs AS (SELECT *, coalesce(p, 0)::BIGINT AS part, coalesce(body, '[]') AS items, coalesce(n, 0) AS notes FROM {jobs} LEFT JOIN parts ON j = job_id)"""


def _map_json(key):
    return f"""(SELECT job_id, '{{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}}' AS m FROM (SELECT job_id, {key} AS k, count(*) AS n FROM findings GROUP BY ALL) GROUP BY job_id)"""


_o("export_json_results", _from(_SUMMED + ",\n" + _documents(_FINDING_JSON, "summary"), f"""
SELECT d.job_id, part, sha256('{{"job_id":' || to_json(d.job_id) || ',"findings":' || items || ',"summary":{{"total_findings":' || total_findings ||
  ',"by_severity":' || coalesce(a.m, '{{}}') || ',"by_category":' || coalesce(b.m, '{{}}') || ',"score":' || score || ',"passed":' || passed || '}}}}') AS digest
FROM docs d LEFT JOIN {_map_json('severity')} a ON a.job_id = d.job_id LEFT JOIN {_map_json('category')} b ON b.job_id = d.job_id"""))
_SARIF_LEVEL = "CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END"
_SARIF_ROW = f"""'{{"ruleId":"' || rule_id || '","level":"' || {_SARIF_LEVEL} || '","message":{{"text":"' || message || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' ||
  file || '"}},"region":{{"startLine":' || line || ',"startColumn":' || "column" || '}}}}}}]}}'"""
_o("export_sarif_results", _from(_FINDINGS, f"SELECT job_id, {_SARIF_ROW} AS json FROM findings"))
_LISTED = [(r[0], r[1], r[7]) for r in _PROSE]
_LISTED.insert(10, ("TXT-304", "Shouting", "The line holds a word in capitals."))
_LISTED.append(("TXT-901", "Structure check", "Never reported, the pattern type is not supported."))
_DRIVER = ",".join(f'{{"id":"{i}","name":"{n}","shortDescription":{{"text":"{m}"}}}}' for i, n, m in _LISTED)
_SARIF_HEAD = '{"$schema":"https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"siftmark","version":"0.1.0","rules":[' + _DRIVER + ']}},"results":'
_o("export_sarif_documents", _from(_SUMMED + ",\n" + _documents(_SARIF_ROW, "summary"),
   f"SELECT job_id, part, sha256({_quote(_SARIF_HEAD)} || items || '}}]}}') AS digest FROM docs"))
_LINE = """file || ':' || line || ':' || "column" || ' ' || severity || ' ' || message || ' (' || rule_id || ')' || CASE WHEN snippet = '' THEN '' ELSE chr(10) || '    > ' || snippet END"""
_o("export_text_lines", _from(_FINDINGS, f"SELECT job_id, {_LINE} AS text FROM findings"))


def _tallies(sep):
    return f"concat_ws({sep}, " + ", ".join(f"CASE WHEN n_{s} > 0 THEN '{s} ' || n_{s} END" for s in ("critical", "high", "medium", "low", "info")) + ")"


_STATE = "CASE WHEN passed THEN 'clean' ELSE 'blocked' END"
_HEAD = f"""'siftmark report for ' || job_id || ': ' || {_STATE} || printf(', %.0f of 100 points', score) || chr(10) ||
  CASE WHEN total_findings = 0 THEN 'nothing found' ELSE total_findings || ' findings: ' || {_tallies("', '")} END"""
_o("export_text_heads", _from(_SUMMED, f"SELECT job_id, {_HEAD} AS text FROM summary"))
_o("export_text_reports", _from(_SUMMED + ",\n" + _PARTED + f""",
bodies AS (SELECT job_id AS j, part, string_agg({_LINE}, chr(10) ORDER BY rank) AS body FROM parted GROUP BY ALL)""", f"""
SELECT job_id, coalesce(part, 0)::BIGINT AS part, sha256(CASE WHEN part > 0 THEN body ELSE {_HEAD} || coalesce(chr(10) || body, '') END) AS digest
FROM summary LEFT JOIN bodies ON j = job_id"""))
_NOTE = """'{"path":"' || file || '","start_line":' || line || ',"end_line":' || line || ',"annotation_level":"' ||
  CASE WHEN severity IN ('critical', 'high') THEN 'failure' WHEN severity = 'medium' THEN 'warning' ELSE 'notice' END ||
  '","message":"' || message || '","title":"[' || rule_id || '] ' || rule_name || '"}'"""
_o("export_checkrun", _from(_RESULTS + ",\n" + _documents(_NOTE, "results", 50), f"""
SELECT job_id, part, notes, sha256('{{"name":"siftmark","head_sha":"' || commit_sha || '","status":"completed","conclusion":"' ||
  CASE WHEN passed THEN 'success' ELSE 'failure' END || '","completed_at":"2024-02-01T00:00:00Z","output":{{"title":"' ||
  CASE WHEN passed THEN 'Nothing blocks' ELSE 'Findings block' END || printf(', %.0f of 100 points', score) || '","summary":"' || total_findings || ' findings in 1200 ms. ' ||
  {_tallies("', '")} || '","annotations":' || items || '}}}}') AS digest FROM docs"""))
_o("export_pr_comment", _from(_RESULTS + ",\n" + _RANKED + """,
items AS (SELECT job_id, string_agg('1. ' || file || ', line ' || line || ': ' || message || ' (' || rule_id || ')' || chr(10), '' ORDER BY rank) AS t FROM ranked WHERE rank <= 10 GROUP BY job_id)""", f"""
SELECT job_id, '### siftmark: ' || {_STATE} || chr(10) || printf('%.0f of 100 points at %s', score, left(commit_sha, 8)) ||
  CASE WHEN total_findings = 0 THEN '' ELSE chr(10) || chr(10) || {_tallies("', '")} || chr(10) || chr(10) || t ||
    CASE WHEN total_findings > 10 THEN chr(10) || (total_findings - 10) || ' more are in the full report.' || chr(10) ELSE '' END END AS body
FROM results LEFT JOIN items USING (job_id)"""))
_CHAT = f"""'{{"attachments":[{{"color":"' || CASE WHEN passed THEN '#2e7d32' ELSE '#c62828' END || '","text":"corpus/' || job_id || ' is ' || {_STATE} ||
  printf(' with %.0f of 100 points', score) || CASE WHEN total_findings > 0 THEN '; ' || {_tallies("', '")} ELSE '' END || '","footer":"siftmark","ts":' || done || ',"mrkdwn_in":["text"]}}]}}'"""
_o("export_chat", _from(_RESULTS, f"SELECT job_id, {_CHAT} AS json FROM results"))
_o("export_mail", _from(_RESULTS, f"""
SELECT job_id, 'corpus/' || job_id || ' is ' || {_STATE} || ' (siftmark)' AS subject,
  'The scan of corpus/' || job_id || ' at ' || commit_sha || printf(' took 1200 ms and gives %.0f of 100 points.', score) || chr(10) ||
  CASE WHEN total_findings > 0 THEN 'It has ' || total_findings || ' findings:' || chr(10) || {_tallies("chr(10)")} || chr(10) ELSE '' END AS body FROM results"""))
_o("notify_outbox", _from(_RESULTS, f"""
SELECT job_id, 'slack' AS target, 'ready' AS state, {_CHAT} AS body FROM results UNION ALL SELECT job_id, 'email', 'no recipients configured', NULL FROM results"""))
_EXPO = _BOUNDS + """,
cells AS (SELECT event_type AS service, 'request_ms_bucket' AS metric, 'histogram' AS kind, le, (count(*) FILTER (value <= bound))::DOUBLE AS value FROM events, bounds GROUP BY ALL
  UNION ALL SELECT event_type, 'request_ms_sum', 'histogram', NULL, round(sum(value), 3) FROM events GROUP BY ALL
  UNION ALL SELECT event_type, 'request_ms_count', 'histogram', NULL, count(*)::DOUBLE FROM events GROUP BY ALL
  UNION ALL SELECT event_type, 'seen_total', 'counter', NULL, count(*)::DOUBLE FROM events GROUP BY ALL)"""
_o("export_exposition", _from(_EXPO, """
SELECT service, service || '_' || metric || CASE WHEN le IS NULL THEN '' ELSE '{le="' || le || '"}' END || ' ' ||
  CASE WHEN metric = 'request_ms_sum' THEN printf('%.3f', value) ELSE value::BIGINT::VARCHAR END AS text FROM cells
UNION ALL SELECT DISTINCT service, '# TYPE ' || service || '_' || CASE kind WHEN 'counter' THEN metric ELSE 'request_ms' END || ' ' || kind FROM cells"""))
_o("read_exposition", _from(_EXPO, "SELECT service, metric, kind, le, value FROM cells"))

# -- streams: the same answers as in batch ---------------------------------------

_o("stream_scan", _from(_SUMMED, f"SELECT {_N}, score, passed FROM summary"))
_o("stream_metrics", _from(_QUANTILE.replace("ts::DATE AS day", "date_trunc('hour', ts)::TIMESTAMP AS day"), """
SELECT q.event_type, q.day AS window_start, n AS requests, CASE WHEN q.event_type = 'error' THEN n ELSE 0 END AS errors, round(n / 3600.0, 9) AS rate,
  round(max(v) FILTER (p = 0.5), 6) AS p50, round(max(v) FILTER (p = 0.99), 6) AS p99
FROM q JOIN (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY ALL) c ON c.event_type = q.event_type AND c.day = q.day
GROUP BY q.event_type, q.day, n"""))
_o("stream_late", """
WITH e AS (SELECT event_type, ts, event_id % 4 AS p FROM events), m AS (SELECT p, max(ts) AS top FROM e GROUP BY p),
marks AS (SELECT a.p, max(b.top) - INTERVAL 20 DAY AS mark FROM m a LEFT JOIN m b ON b.p < a.p GROUP BY a.p)
SELECT event_type, count(*) FILTER (mark IS NULL OR ts > mark) AS in_time, count(*) FILTER (ts <= mark) AS late, count(*) AS repaired
FROM e JOIN marks USING (p) GROUP BY event_type""")
_o("stream_reuse", ORACLE["reuse_results"])
_o("stream_progress", ORACLE["job_progress"])
_o("stream_audit", f"SELECT 'e' || event_id AS id, {_SIGN} AS signature, ts AS created_at, true AS valid FROM events")
_o("stream_latest_status", _from(_PROGRESS, "SELECT job_id, type AS status, moment AS since FROM steps QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY moment DESC, id DESC) = 1"))
