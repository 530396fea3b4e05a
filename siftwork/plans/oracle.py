"""The same results in plain DuckDB SQL over the given tables.

Nothing here shares logic with the Spark side; only the fixed values are the same.  Patterns use
RE2, which has no look-around and no back-references, so some are written differently.
"""

from __future__ import annotations

from .. import catalogues as cat
from ..operators.search import predicates
from . import planted, registry


def q(text: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if text is None else "'" + text.replace("'", "''") + "'"


def strlist(values) -> str:
    return "CAST([" + ", ".join(q(v) for v in values) + "] AS VARCHAR[])"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


SEP = q(registry.SEP)


# ----------------------------------------------------------------------- corpus tables


def _suffix(pieces) -> str:
    return " || ".join(q(p) if isinstance(p, str) else f"repeat({q(p[0])}, {p[1]})" for p in pieces)


def _shape(shape: str) -> str:
    return q(shape).replace("{s}", "' || source || '").replace("{i}", "' || doc_id || '")


_NAMES = strlist(name for name, _ in planted.PLANTED)
_SUFFIXES = "[" + ", ".join(_suffix(p) for _, p in planted.PLANTED) + "]"

_KIND_SLOTS = " ".join(f"WHEN {at} THEN [0, {kind}]" for kind, (at, *_) in enumerate(planted.ADDED, 1))
_ADDED = {c: " ".join(f"WHEN {k} THEN {q(row[i])}" for k, row in enumerate(planted.ADDED, 1)) for i, c in ((1, "name"), (2, "text"), (3, "error"))}
_TURN_SEQ = planted.key_sql(planted.pair_sql("conv_id", "turn", "//"), planted.TURN)
_PAGE_SEQ = planted.key_sql("page_id", planted.PAGE)

CORPUS = f"""
corpus AS (
  SELECT doc_id * {planted.KINDS} + kind AS seq,
    'https://example.com/' || source || '/' || doc_id || '/' || CASE kind {_ADDED["name"]}
      ELSE coalesce(({_NAMES})[doc_id % {planted.SLOTS} + 1], {q(planted.DEFAULT_NAME)}) END AS url,
    CASE kind {_ADDED["text"]} ELSE text || coalesce(chr(10) || ({_SUFFIXES})[doc_id % {planted.SLOTS} + 1], '') END AS raw_content,
    CASE kind {_ADDED["error"]} END AS error,
    source, 1704067200 + doc_id % 97 * 60 AS ingest_s
  FROM (SELECT *, unnest(CASE doc_id % {planted.SLOTS} {_KIND_SLOTS} ELSE [0] END) AS kind FROM documents)),
valid AS (SELECT *, sha256(raw_content) AS content_hash FROM corpus WHERE error IS NULL AND raw_content <> ''),
first_docs AS (SELECT * FROM valid WHERE seq IN (SELECT min(seq) FROM valid GROUP BY content_hash))"""

RECRAWL = f"""
recrawl AS (
  SELECT seq + {planted.REVISED} AS seq, url,
    CASE WHEN seq // {planted.KINDS} % 3 = 0 AND raw_content <> '' THEN raw_content || chr(10) || 'revised' ELSE raw_content END AS raw_content, error
  FROM corpus
  UNION ALL
  SELECT {_TURN_SEQ}, 'https://example.com/conv/' || conv_id || '/' || turn, text, NULL FROM conversations)"""

URLS = f"""
urls AS (
  SELECT doc_id AS seq, ([{", ".join(_shape(s) for s in planted.URL_SHAPES)}])[doc_id % {len(planted.URL_SHAPES)} + 1] AS url FROM documents
  UNION ALL SELECT {_PAGE_SEQ}, url FROM pages),
parts AS (
  SELECT seq, url,
    lower(regexp_extract(url, '^(?:([a-zA-Z][a-zA-Z0-9+.\\-]*):)?', 1)) AS scheme,
    regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?//([^/?#]*)', 1) AS host,
    regexp_replace(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '') AS path
  FROM urls)"""

PAGES = f"""
linked AS (
  SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN
    html || {q(planted.PLANTED_LINKS)} || '<a href="https://example.net/p' || page_id || '">x</a>' ELSE html END AS html
  FROM pages),
anchors AS (
  SELECT page_id, unnest(h) AS href, unnest(range(len(h))) AS pos FROM (
    SELECT page_id, list_transform(
      regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', '', 'g'),
        '(?i)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"', 1),
      lambda x: replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS h
    FROM linked)),
targets AS (
  SELECT page_id, pos, href,
    CASE WHEN starts_with(href, '/url?') AND regexp_matches(href, '[?&]q=[^&]')
      THEN url_decode(regexp_extract(href, '[?&]q=([^&]+)', 1))
    WHEN regexp_matches(href, '^https?://(www\\.)?duckduckgo\\.com[/?]') AND regexp_matches(href, '[?&]uddg=[^&]')
      THEN url_decode(regexp_extract(href, '[?&]uddg=([^&#]+)', 1)) ELSE href END AS target
  FROM anchors),
external AS (
  SELECT page_id, target AS url, min(pos) AS first_pos FROM targets
  WHERE starts_with(target, 'http://') OR starts_with(target, 'https://') GROUP BY ALL),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY first_pos) AS pos FROM external
  WHERE regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\\.', '') NOT IN
    ({", ".join(q(h) for h in cat.EXCLUDED_HOSTS)}))"""


def _platform_sums() -> str:
    cols = []
    for name, patterns in cat.PLATFORM_PATTERNS.items():
        tests = " + ".join(
            f"CAST(regexp_matches(t, {q('(?i)' + p)}) OR regexp_matches(u, {q('(?i)' + p)}) AS BIGINT)" for p in patterns
        )
        cols.append(f"{tests} AS {name}")
    return ", ".join(cols)


_PLATFORMS = list(cat.PLATFORM_PATTERNS)
_SCORE_LIST = "[" + ", ".join(
    f"{{'platform': '{p}', 'score': {p}, 'pos': {i}, 'rules': {len(cat.PLATFORM_PATTERNS[p])}}}" for i, p in enumerate(_PLATFORMS)
) + "]"
SCORES = f"""
sums AS (SELECT seq, {_platform_sums()} FROM (SELECT seq, lower(raw_content) AS t, lower(url) AS u FROM valid)),
scores AS (SELECT seq, unnest({_SCORE_LIST}, recursive := true) FROM sums),
best AS (
  SELECT v.seq, coalesce(s.platform, 'unknown') AS platform, coalesce(round(s.score / CAST(s.rules AS DOUBLE), 2), 0.0) AS confidence
  FROM valid v LEFT JOIN (
    SELECT * FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY score DESC, pos) = 1) s USING (seq))"""


def _all(pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all(raw_content, {q(pattern)}, {group})"


E1 = _all(r"(?is)(?:system\s*prompt|system_prompt)\s*[:=]\s*[\"']?(.*?)[\"']?\s*(?:\n|$)")
E2 = _all(r"(?is)##?\s*(?:Instructions?|Rules?|Prompt|System\s*Prompt)\s*\n+(?:[^\n]|\n+[^\n#])*")
E3 = _all(r"(?is)<system>.*?</system>")
E4 = _all(r"(?is)(?:You are|Act as|Assistant is)\s.{0,400}")
_ELEMENTS = "|".join(rf"<{t}(?:\s[^>]*)?>.*?</{t}\s*>" for t in cat.PROMPT_ELEMENTS)
E5 = (
    f"list_transform({_all('(?is)' + _ELEMENTS)}, lambda x: list_aggregate(list_transform("
    f"string_split_regex(x, '<[^>]*>'), lambda y: {strip('y')}), 'string_agg', ''))"
)
_STRIP_LIST = "list_transform({}, lambda x: " + strip("x") + ")"
BLOCKS = f"""
traits AS (
  SELECT seq, url, raw_content, content_hash, lower(raw_content) AS lower_text,
    list_concat({_STRIP_LIST.format(f"list_concat(list_concat(list_concat({E1}, {E2}), {E3}), {E4})")}, {E5}) AS all_blocks,
    substr({strip("nullif(regexp_extract(raw_content, '(?i)(?:^|\\n)(You are[^\\n]{0,300})', 1), '')")}, 1, {cat.PERSONA_CHARS}) AS persona,
    list_filter({strlist(cat.TECH_KEYWORDS)}, lambda k: contains(lower(raw_content), k)) AS tech,
    list_transform({_all("(?i)" + cat.CONSTRAINT)}, lambda x: substr({strip("x")}, 1, {cat.CONSTRAINT_CHARS})) AS constraint_list
  FROM valid),
blocks AS (
  SELECT *, list_filter(all_blocks, lambda b, i: b <> '' AND list_position(all_blocks, b) = i) AS block_list FROM traits)"""
TRAITS = f"""{BLOCKS},
tagged AS (
  SELECT b.*, e.platform, e.confidence, list_sort(list_distinct(list_filter(list_concat(list_concat([e.platform], tech),
    [CASE WHEN persona <> '' THEN '{cat.TAG_PERSONA}' END, CASE WHEN len(constraint_list) > 0 THEN '{cat.TAG_CONSTRAINTS}' END,
     CASE WHEN len(block_list) > 0 THEN '{cat.TAG_PROMPT}' END]), lambda t: t IS NOT NULL))) AS tags
  FROM blocks b JOIN best e USING (seq))"""


def _join(list_expr: str, sep: str = SEP) -> str:
    return f"coalesce(array_to_string({list_expr}, {sep}), '')"


_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def _lines(source: str, key: str, text: str) -> str:
    return f"""
all_lines AS MATERIALIZED (
  SELECT {key}, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_number FROM (
    SELECT {key}, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS l
    FROM (SELECT {key}, string_split_regex({text}, '{_BREAK}') AS p FROM {source})))"""


def _entropy(text: str) -> str:
    p = f"((length({text}) - length(replace({text}, c, ''))) / CAST(length({text}) AS DOUBLE))"
    return f"coalesce(list_sum(list_transform(list_distinct(string_split({text}, '')), lambda c: -{p} * log2({p}))), 0.0)"


def _findings(rules, source: str = "valid", text: str = "raw_content") -> str:
    scans, tests = [], []
    for pos, rule in enumerate(rules):
        pattern = q(("(?i)" if rule.ignore_case else "") + rule.pattern)
        scans.append(
            f"SELECT seq, line_number, line, {pos} AS rule_pos, {q(rule.name)} AS rule_name, {rule.min_entropy}::DOUBLE AS threshold,"
            f" regexp_extract_all(line, {pattern}, 0) AS ms, string_split_regex(line, {pattern}) AS gaps"
            f" FROM flagged WHERE regexp_matches(line, {pattern})"
        )
        tests.append(f"regexp_matches(line, {pattern})")
    k = cat.CONTEXT_CHARS

    def window(first: str, last: str) -> str:
        return (
            f"coalesce(array_to_string(list_transform(range({first}, {last}), lambda p: CASE WHEN len(list_filter(spans,"
            " lambda s: s.a <= p AND p < s.b)) > 0 THEN '*' ELSE substr(line, p + 1, 1) END), ''), '')"
        )

    redacted = "CASE WHEN length(m) <= 8 THEN '****' ELSE left(m, 4) || '****' || right(m, 4) END"
    return f"""{_lines(source, 'seq', text)},
flagged AS MATERIALIZED (SELECT * FROM all_lines WHERE {" OR ".join(tests)}),
scans AS MATERIALIZED ({" UNION ALL ".join(scans)}),
matches AS (
  SELECT seq, line_number, line, rule_pos, rule_name, threshold, ms[i] AS m,
    CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g)))
      + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM scans)),
hits AS MATERIALIZED (SELECT *, start + length(m) AS stop FROM matches WHERE threshold = 0 OR {_entropy('m')} >= threshold - 1e-12),
spans AS MATERIALIZED (SELECT seq, line_number, list({{'a': start, 'b': stop}}) AS spans FROM hits GROUP BY ALL),
findings AS (
  SELECT seq, rule_pos, rule_name, line_number, start, {redacted} AS redacted,
    {window(f'greatest(start - {k}, 0)', 'start')} || {redacted} || {window('stop', f'least(stop + {k}, length(line))')} AS context
  FROM hits JOIN spans USING (seq, line_number)),
counted AS (SELECT v.seq, count(f.rule_pos) AS n_findings FROM {source} v LEFT JOIN findings f USING (seq) GROUP BY ALL)"""


FINDINGS = _findings(cat.SECRET_RULES)
# The Python rules as alternations.
_QUOTED = "sk-[A-Za-z0-9]{32,48}"
_RE2_RULES = (
    registry.PYTHON_RULES[0]._replace(pattern=f"'{_QUOTED}'|\"{_QUOTED}\"|{_QUOTED}"),
    registry.PYTHON_RULES[1]._replace(pattern=r"[a-z]+_[a-z]+\s*[=:]\s*[^\s]{8,}"),
    *registry.CUSTOM_RULES,
)


# Lines with findings are rebuilt character by character; texts in the corpus break at "\n" only.
_MASKED = """
SELECT v.seq, coalesce(m.t, raw_content) AS raw_content FROM valid v LEFT JOIN (
  SELECT seq, string_agg(CASE WHEN spans IS NULL THEN line ELSE array_to_string(list_transform(string_split(line, ''),
      lambda c, p: CASE WHEN len(list_filter(spans, lambda s: s.a < p AND p <= s.b)) > 0 THEN '*' ELSE c END), '') END,
    chr(10) ORDER BY line_number) AS t
  FROM all_lines LEFT JOIN spans USING (seq, line_number) WHERE seq IN (SELECT seq FROM spans) GROUP BY seq) m USING (seq)"""


def w(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def decide(source: str, stored: str, out: str) -> str:
    """Outcome of the documents of a batch against a table of stored (url, content_hash)."""
    return f"""
{out}_unknown AS (
  SELECT s.* FROM {source} s WHERE s.error IS NULL AND s.raw_content <> ''
    AND seq IN (SELECT min(seq) FROM {source} WHERE error IS NULL AND raw_content <> '' GROUP BY raw_content)
    AND sha256(s.raw_content) NOT IN (SELECT content_hash FROM {stored})),
{out} AS (
  SELECT seq, url, raw_content, sha256(raw_content) AS content_hash,
    CASE WHEN url IN (SELECT url FROM {stored}) OR seq <> min(seq) OVER (PARTITION BY url) THEN 'rejected' ELSE 'accepted' END AS outcome
  FROM {out}_unknown)"""


BATCHES = (
    "none AS (SELECT url, content_hash FROM first_docs WHERE false)",
    decide("corpus", "none", "one"),
    "stored AS (SELECT url, content_hash FROM one WHERE outcome = 'accepted')",
    decide("recrawl", "stored", "two"),
)


# ------------------------------------------------------------------------- embeddings


def _tokens(source: str, key: str, text: str, name: str) -> str:
    return f"""
{name}_tok AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+', 0)) AS token FROM {source}),
{name}_cnt AS (
  SELECT {key}, CAST(('0x' || right(md5(token), 3))::BIGINT & 511 AS BIGINT) AS b1,
    CAST(('0x' || right(sha1(token), 3))::BIGINT & 511 AS BIGINT) AS b2, count(*) AS n FROM {name}_tok GROUP BY {key}, token),
{name}_w AS (
  SELECT {key}, bucket, sum(weight) AS weight FROM (
    SELECT {key}, b1 AS bucket, CAST(n AS DOUBLE) AS weight FROM {name}_cnt UNION ALL SELECT {key}, b2, n * 0.5::DOUBLE FROM {name}_cnt)
  GROUP BY ALL),
{name} AS (
  SELECT {key}, bucket, CAST(CAST(weight / sqrt(sum(weight * weight) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS v FROM {name}_w)"""


_DOCUMENT = (
    f"substr(array_to_string(list_concat(block_list[1:{cat.DOCUMENT_BLOCKS}],"
    f" CASE WHEN raw_content <> '' THEN [substr(raw_content, 1, {cat.DOCUMENT_RAW_CHARS})] ELSE [] END), chr(10) || chr(10)), 1, {cat.DOCUMENT_CHARS})"
)
INDEX = f"""
index_rows AS (
  SELECT t.content_hash AS id, {_DOCUMENT} AS document, t.url, t.platform, {_join('tags', "','")} AS tags,
    CAST(c.n_findings > 0 AS BIGINT) AS has_secrets
  FROM tagged t JOIN counted c USING (seq) WHERE t.seq IN (SELECT seq FROM first_docs))"""


def _semantic(query: str, n: int, where: str = "true") -> str:
    return (
        w(CORPUS, SCORES, TRAITS, FINDINGS, INDEX, _tokens("index_rows", "id", "document", "dv"),
          f"qt AS (SELECT 0 AS k, {q(query)} AS t)", _tokens("qt", "k", "t", "qv"),
          "dots AS (SELECT d.id, sum(d.v * qv.v) AS dot FROM dv d JOIN qv USING (bucket) GROUP BY ALL)")
        + f"SELECT id, substr(document, 1, {cat.EXCERPT_CHARS}) AS document, round(exact, 4) AS distance, url, platform, tags,"
        f" has_secrets = 1 AS has_secrets FROM (SELECT i.*, round(1 - coalesce(dot, 0.0), 9) AS exact FROM index_rows i LEFT JOIN dots USING (id)"
        f" WHERE {where}) ORDER BY exact, id LIMIT {n}"
    )


# ------------------------------------------------------------------- corpus predicates


def _pick(values, divisor: int) -> str:
    return f"({strlist(values)})[(seq // {divisor}) % {len(values)} + 1]"


SEARCH = f"""
sdocs AS (
  SELECT seq, 'https://' || {_pick(planted.SEARCH_HOSTS, 1)} || '/' || {_pick(planted.SEARCH_FOLDERS, 5)} || {_pick(planted.SEARCH_NAMES, 1)} AS url,
    raw_content || chr(10) || {_pick(planted.SEARCH_LINES, 1)} AS raw_content FROM valid),
atoms AS (
  SELECT seq, url, lower(raw_content) AS t, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_extract(url, '^https://([^/]*)', 1) AS host,
    regexp_extract(url, '^https://[^/]*(.*)$', 1) AS path, regexp_extract(url, '[^/]*\\.([^./]+)$', 1) AS ext FROM sdocs)"""


def _preds(source: str) -> str:
    rows = ", ".join(
        f"({i}, {q(name)}, {q(p.query)}, {q(p.kind)}, {q(','.join(p.tags))}, {q(p.basename)}, {q(p.needle)}, {q(p.path)},"
        f" {strlist(p.extensions)}, {q(p.host)}, {q(p.host_suffix)}, {q(p.mention)})"
        for i, (name, p) in enumerate(predicates(source))
    )
    return (
        f"preds(query_no, source, query, kind, tags, basename, needle, part, exts, phost, suffix, mention) AS (VALUES {rows}),\n"
        "phits AS (SELECT seq, url, query_no, source, query, kind, tags FROM preds JOIN atoms ON"
        " (basename IS NULL OR basename = base OR (contains(basename, '/') AND ends_with(path, '/' || basename)))"
        " AND (phost IS NULL OR phost = host)"
        " AND (suffix IS NULL OR ends_with(host, suffix)) AND (len(exts) = 0 OR list_contains(exts, ext))"
        " AND (part IS NULL OR contains(path, part)) AND (needle IS NULL OR contains(t, lower(needle)))"
        " AND (mention IS NULL OR contains(t, mention)))"
    )


def _search(source: str, kind: str | None = None) -> str:
    where = f" WHERE kind = '{kind}'" if kind else ""
    return w(CORPUS, SEARCH, _preds(source)) + f"SELECT seq, source, query, tags FROM phits{where}"


PAYLOADS = """
payloads AS (
  SELECT page_id, '{"items":[{"html_url":"https://github.com/u' || page_id || '/r/blob/main/CLAUDE.md"},{"html_url":""},{"html_url":"' || url || '"}]}' AS github_body,
    CASE WHEN page_id % 7 = 0 THEN '{"message":"none"}' ELSE '[{"project_id":' || page_id || ',"path":"a/b.md","ref":"main"},{"project_id":2,"path":""},{"project_id":3,"path":"c' || page_id || '.md"}]' END AS gitlab_body
  FROM pages),
github_urls AS (
  SELECT page_id, pos, regexp_replace(u, '^https://github\\.com/([^/]+/[^/]*)/blob/(.*)$', 'https://raw.githubusercontent.com/\\1/\\2') AS url FROM (
    SELECT page_id, pos, json_extract_string(github_body, '$.items[' || pos || '].html_url') AS u
    FROM payloads, (SELECT unnest([0, 1, 2]) AS pos)) WHERE u <> '')"""

_GITHUB_RAW = "CASE WHEN host = 'github.com' AND regexp_matches(path, '^/*[^/]+/[^/]*/blob/') THEN 'https://raw.githubusercontent.com/' || regexp_replace(path, '^/*([^/]+/[^/]*)/blob/(.*)$', '\\1/\\2') ELSE url END"
_GITLAB_RAW = "CASE WHEN contains(path, '/-/blob/') THEN scheme || '://' || host || regexp_replace(path, '/-/blob/', '/-/raw/') ELSE url END"
_BITBUCKET_RAW = "CASE WHEN host = 'bitbucket.org' AND regexp_matches(path, '^/*[^/]+/[^/]*/src/') THEN 'https://bitbucket.org/' || regexp_replace(path, '^/*([^/]+/[^/]*)/src/(.*)$', '\\1/raw/\\2') ELSE url END"
_TO_RAW = f"CASE WHEN host = 'github.com' THEN {_GITHUB_RAW} WHEN contains(path, '/-/blob/') THEN {_GITLAB_RAW} ELSE {_BITBUCKET_RAW} END"
_BASE_GITHUB = "CASE WHEN host = 'raw.githubusercontent.com' AND regexp_matches(path, '^/*[^/]+/[^/]*/[^/]*/') THEN 'https://raw.githubusercontent.com/' || regexp_extract(path, '^/*([^/]+/[^/]*/[^/]*)/', 1) END"
_BASE_GITLAB = "CASE WHEN regexp_extract(split_part(path, '/-/raw/', 2), '^[^/]*') <> '' THEN scheme || '://' || host || split_part(path, '/-/raw/', 1) || '/-/raw/' || regexp_extract(split_part(path, '/-/raw/', 2), '^[^/]*') END"


def _url(expr: str) -> str:
    return w(URLS) + f"SELECT seq, url, {expr} AS result FROM parts"


def _found(expr: str) -> str:
    return w(CORPUS) + f"SELECT seq, CAST(len(f) AS BIGINT) AS n, {_join('f')} AS found FROM (SELECT seq, {expr} AS f FROM valid)"


_FILE_COLUMNS = "seq, url, content_hash, platform, confidence"
_FILES = w(CORPUS, SCORES, FINDINGS) + f"SELECT {_FILE_COLUMNS} FROM first_docs JOIN best USING (seq) JOIN counted USING (seq) WHERE "
_FINDING_COLUMNS = "seq, rule_name, line_number, start, redacted, context"


def _rows(values) -> str:
    return "VALUES " + ", ".join(values)


_DIMS = [
    (kind, pos, value)
    for kind, values in (("filename", cat.TARGET_FILENAMES), ("signature", cat.CONTENT_SIGNATURES), ("path", cat.TARGET_PATHS), ("s3_term", cat.S3_TERMS))
    for pos, value in enumerate(values)
]


def oracles() -> dict[str, str]:
    docs = w(CORPUS)
    tagged = w(CORPUS, SCORES, TRAITS)
    both = w(CORPUS, RECRAWL, *BATCHES)
    return {
        "url_list_scan": f"SELECT DISTINCT {strip('url')} AS url FROM pages",
        "url_list_sink": w(PAGES) + "SELECT url FROM pages UNION SELECT url FROM kept",
        "corpus_scan": w(CORPUS, SCORES, TRAITS) + f"SELECT c.seq, CASE WHEN error IS NULL THEN sha256(c.raw_content) ELSE '' END AS content_hash, CAST(length(c.raw_content) AS BIGINT) AS length, c.url AS raw_url, {_join('block_list')} AS blocks FROM corpus c LEFT JOIN blocks b USING (seq)",
        "catalogue_sink": w(CORPUS, SCORES, TRAITS, FINDINGS) + f"SELECT t.url, t.content_hash, t.platform, {_join('t.tags', chr(39) + ',' + chr(39))} AS tags, CAST(n_findings > 0 AS BIGINT) AS has_secrets, n_findings FROM tagged t JOIN first_docs USING (seq) JOIN counted USING (seq)",
        "export_json": w(CORPUS, SCORES, FINDINGS) + "SELECT 'manifest 2024-01-01T00:00:00+00:00' AS part, count(*) AS n FROM first_docs UNION ALL SELECT 'rule ' || rule_name, count(*) FROM findings JOIN first_docs USING (seq) GROUP BY 1 UNION ALL SELECT 'platform ' || platform, count(*) FROM best JOIN first_docs USING (seq) GROUP BY 1",
        "vector_table": w(CORPUS, SCORES, TRAITS, FINDINGS, INDEX) + f"SELECT id, CAST(length(document) AS BIGINT) AS document_chars, CAST({cat.EMBEDDING_DIM} AS BIGINT) AS dim, url, platform, tags, has_secrets FROM index_rows",
        "catalogue_dims": w(CORPUS, SEARCH, "dims(kind, pos, value) AS (" + _rows(f"({q(k)}, {p}, {q(v)})" for k, p, v in _DIMS) + ")") + "SELECT kind, CAST(pos AS BIGINT) AS pos, value, (SELECT count(*) FROM sdocs WHERE contains(url || chr(10) || raw_content, value)) AS n_docs FROM dims",
        "api_payload_scan_github": w(PAYLOADS) + "SELECT page_id, CAST(pos AS BIGINT) AS pos, url FROM github_urls",
        "api_payload_scan_gitlab": w(PAYLOADS) + "SELECT page_id, CAST(pos AS BIGINT) AS pos, 'https://gitlab.com/api/v4/projects/' || pid || '/repository/files/' || replace(path, '/', '%2F') || '/raw?ref=' || coalesce(ref, 'HEAD') AS url FROM (SELECT page_id, pos, json_extract_string(gitlab_body, '$[' || pos || '].project_id') AS pid, json_extract_string(gitlab_body, '$[' || pos || '].path') AS path, json_extract_string(gitlab_body, '$[' || pos || '].ref') AS ref FROM payloads, (SELECT unnest([0, 1, 2]) AS pos) WHERE starts_with(gitlab_body, '[')) WHERE path <> '' AND pid <> '0'",
        "github_blob_to_raw": _url(_GITHUB_RAW),
        "gitlab_blob_to_raw": _url(_GITLAB_RAW),
        "bitbucket_src_to_raw": _url(_BITBUCKET_RAW),
        "to_raw_url": _url(_TO_RAW),
        "repo_base_github": _url(_BASE_GITHUB),
        "repo_base_gitlab": _url(_BASE_GITLAB),
        "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
        "content_length": "SELECT doc_id, CAST(length(text) AS BIGINT) AS length FROM documents",
        "redact": "SELECT doc_id, " + ", ".join(f"CASE WHEN length({c}) <= 8 THEN '****' ELSE left({c}, 4) || '****' || right({c}, 4) END AS redacted_{c}" for c in ("text", "source")) + " FROM documents",
        "shannon_entropy": f"SELECT doc_id, round({_entropy('text')}, 6) AS entropy FROM documents",
        "excerpt": f"SELECT doc_id, substr(text, 1, {cat.EXCERPT_CHARS}) AS excerpt FROM documents",
        "tags_csv": tagged + f"SELECT seq, {_join('tags', chr(39) + ',' + chr(39))} AS tags FROM tagged",
        "tag_flags": tagged + "SELECT seq, persona IS NOT NULL AS persona_found, CAST(len(tech) AS BIGINT) AS tech_stack_count, CAST(len(constraint_list) AS BIGINT) AS constraint_count FROM tagged",
        "valid_docs": docs + "SELECT seq, url FROM valid",
        "by_url": _FILES + f"url = {q(registry.LOOKUP_URL)}",
        "by_hash": _FILES + f"content_hash = {q(registry.LOOKUP_HASH)}",
        "by_platform": _FILES + "platform = 'crewai'",
        "with_secrets": _FILES + "n_findings > 0",
        "where_metadata": w(CORPUS, SCORES, TRAITS, FINDINGS, INDEX) + "SELECT id, url, tags FROM index_rows WHERE platform = 'unknown' AND has_secrets = 1",
        "has_secrets": w(CORPUS, FINDINGS) + "SELECT seq, n_findings > 0 AS has_secrets FROM counted",
        "exclude_domains": w(PAGES) + "SELECT page_id, url FROM kept",
        "external_only": w(PAGES) + "SELECT page_id, url FROM external",
        "prompt_assign": _found(E1),
        "prompt_section": _found(E2),
        "prompt_system_tag": _found(E3),
        "prompt_persona_span": _found(E4),
        "prompt_html_tags": _found(E5),
        "prompt_blocks": w(CORPUS, BLOCKS) + f"SELECT seq, CAST(len(block_list) AS BIGINT) AS n, {_join('block_list')} AS found FROM blocks",
        "constraints": w(CORPUS, BLOCKS) + f"SELECT seq, CAST(len(constraint_list) AS BIGINT) AS n, {_join('constraint_list')} AS found FROM blocks",
        "persona": w(CORPUS, BLOCKS) + "SELECT seq, persona FROM blocks",
        "tech_stack": w(CORPUS, BLOCKS) + f"SELECT seq, {_join('tech')} AS tech_stack FROM blocks",
        "model_dna": tagged + f"SELECT seq, persona, {_join('tech')} AS tech_stack, {_join('constraint_list')} AS constraints, persona IS NOT NULL AS persona_found FROM tagged",
        "tags": tagged + "SELECT seq, unnest(tags) AS tag FROM tagged",
        "link_harvest": w(PAGES) + "SELECT page_id, pos, url FROM kept",
        "unwrap_redirect": w(PAGES) + "SELECT page_id, pos, href, target FROM targets",
        "top_links": w(PAGES) + "SELECT page_id, pos, url FROM kept WHERE pos <= 2",
        "platform_scores": w(CORPUS, SCORES) + "SELECT seq, platform, CAST(score AS BIGINT) AS score FROM scores WHERE score > 0",
        "platform": w(CORPUS, SCORES) + "SELECT seq, platform FROM best",
        "confidence": w(CORPUS, SCORES) + "SELECT seq, platform, confidence FROM best",
        "classify": tagged + f"SELECT seq, url, content_hash, platform, confidence, {_join('tags', chr(39) + ',' + chr(39))} AS tags, CAST(len(block_list) AS BIGINT) AS n_blocks FROM tagged",
        "lines": w(_lines("documents", "doc_id", "text")) + "SELECT doc_id, line_number, line FROM all_lines",
        "secret_findings": w(CORPUS, FINDINGS) + f"SELECT {_FINDING_COLUMNS} FROM findings",
        "secret_findings_raw_tables": w(f"texts AS (SELECT {planted.key_sql('doc_id', 0)} AS seq, text FROM documents UNION ALL SELECT {_PAGE_SEQ}, html FROM pages UNION ALL SELECT {_TURN_SEQ}, text FROM conversations)", _findings(cat.SECRET_RULES, "texts", "text")) + f"SELECT {_FINDING_COLUMNS} FROM findings",
        "secret_rule_counts": w(CORPUS, FINDINGS, "rules(rule_pos, rule_name, min_entropy) AS (" + _rows(f"({i}, {q(r.name)}, {r.min_entropy}::DOUBLE)" for i, r in enumerate(cat.SECRET_RULES)) + ")") + "SELECT CAST(r.rule_pos AS BIGINT) AS rule_pos, r.rule_name, r.min_entropy, count(f.seq) AS n_findings, count(DISTINCT f.seq) AS n_docs FROM rules r LEFT JOIN findings f USING (rule_name) GROUP BY ALL",
        "entropy_filter": w(CORPUS, _findings([registry.RAW_ENTROPY_RULE._replace(name="all", min_entropy=0.0), registry.RAW_ENTROPY_RULE._replace(name="kept")])) + "SELECT v.seq, count(*) FILTER (f.rule_name = 'all') AS n_all, count(*) FILTER (f.rule_name = 'kept') AS n_kept FROM valid v LEFT JOIN findings f USING (seq) GROUP BY ALL",
        "finding_context": w(CORPUS, FINDINGS) + "SELECT seq, rule_name, line_number, start, context FROM findings",
        "secret_report": w(CORPUS, FINDINGS) + f"SELECT v.seq, v.url, count(f.seq) AS secret_count, count(f.seq) > 0 AS has_secrets, coalesce(string_agg(rule_name || ':' || line_number || ':' || redacted, {SEP} ORDER BY rule_pos, line_number, start), '') AS findings FROM valid v LEFT JOIN findings f USING (seq) GROUP BY ALL",
        "custom_rules": w(CORPUS, _findings(registry.CUSTOM_RULES)) + f"SELECT {_FINDING_COLUMNS} FROM findings",
        "custom_rules_python": w(CORPUS, _findings(_RE2_RULES)) + f"SELECT {_FINDING_COLUMNS} FROM findings",
        "mask_document": w(CORPUS, FINDINGS) + _MASKED,
        "catalogue_count": docs + "SELECT count(*) AS n FROM first_docs",
        "dedup_content": docs + "SELECT seq, url, content_hash FROM first_docs",
        "dedup_urls": w(CORPUS, RECRAWL) + "SELECT min(seq) AS seq, url FROM (SELECT seq, url FROM corpus UNION ALL SELECT seq, url FROM recrawl) GROUP BY url",
        "upsert_catalogue": both + "SELECT seq, url, content_hash, CAST(1 AS BIGINT) AS batch, outcome FROM one UNION ALL SELECT seq, url, content_hash, 2, outcome FROM two",
        "upsert_catalogue_stream": w(CORPUS, SCORES, FINDINGS) + "SELECT content_hash, platform, n_findings > 0 AS has_secrets FROM first_docs JOIN best USING (seq) JOIN counted USING (seq)",
        "index_documents": w(CORPUS, RECRAWL, *BATCHES, "accepted AS (SELECT seq, 1 AS batch, raw_content FROM one WHERE outcome = 'accepted' UNION ALL SELECT seq, 2, raw_content FROM two WHERE outcome = 'accepted')", _findings(cat.SECRET_RULES, "accepted")) + "SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n, count(*) FILTER (n_findings > 0) AS n_secrets FROM accepted JOIN counted USING (seq) GROUP BY ALL",
        "index_delete": w(CORPUS, SCORES) + "SELECT content_hash AS id, platform FROM first_docs JOIN best USING (seq) WHERE platform <> 'crewai'",
        "index_reset": w(CORPUS) + "SELECT unnest(['before', 'reset', 'again']) AS state, unnest([n, 0, n]) AS n FROM (SELECT count(*) AS n FROM first_docs)",
        "search_postings": _semantic(registry.QUERY_TEXT, cat.DEFAULT_TOP_K),
        "search_stored_index": _semantic(registry.QUERY_TEXT, cat.DEFAULT_TOP_K),
        "page_catalogue": w(CORPUS, SCORES) + "SELECT seq, url, ingest_s, platform FROM first_docs JOIN best USING (seq) ORDER BY ingest_s DESC, seq DESC LIMIT 100 OFFSET 100",
        "findings_of_file": w(CORPUS, FINDINGS) + "SELECT url, content_hash, rule_name, line_number, redacted FROM first_docs JOIN findings USING (seq)",
        "inventory_delta": w(CORPUS, RECRAWL) + "SELECT min(seq) AS seq, url FROM recrawl WHERE url NOT IN (SELECT url FROM corpus) GROUP BY url",
        "inventory_refresh": w(PAGES, PAYLOADS, "u AS (SELECT url FROM kept UNION SELECT url FROM github_urls)") + "SELECT url FROM u WHERE url NOT IN (SELECT url FROM pages) UNION ALL SELECT 'stored ' || url FROM (SELECT url FROM u UNION SELECT url FROM pages)",
        "inventory_merge": w(CORPUS, RECRAWL) + "SELECT url FROM corpus UNION SELECT url FROM recrawl",
        "run_summary": w(CORPUS, SCORES, TRAITS, FINDINGS) + "SELECT t.platform, count(*) AS n_files, CAST(sum(copies) AS BIGINT) AS n_documents, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (n_findings > 0) AS n_with_secrets, CAST(sum(n_findings) AS BIGINT) AS n_findings, CAST(sum(len(block_list)) AS BIGINT) AS n_blocks FROM tagged t JOIN first_docs USING (seq) JOIN counted USING (seq) JOIN (SELECT content_hash AS h, count(*) AS copies FROM valid GROUP BY ALL) ON h = t.content_hash GROUP BY ALL",
        "skip_report": docs + "SELECT CASE WHEN error IS NOT NULL THEN error WHEN raw_content = '' THEN 'empty' ELSE 'ok' END AS status, count(*) AS n FROM corpus GROUP BY ALL",
        "multi_source_union": w(PAGES, PAYLOADS, "u AS (SELECT 0 AS source, page_id, 0 AS pos, url FROM pages UNION ALL SELECT 1, page_id, pos, url FROM kept UNION ALL SELECT 2, page_id, pos, url FROM github_urls)") + "SELECT url, CAST(source AS BIGINT) AS source, page_id, CAST(pos AS BIGINT) AS pos FROM u QUALIFY row_number() OVER (PARTITION BY url ORDER BY source, page_id, pos) = 1",
        "build_document": tagged + f"SELECT seq, {_DOCUMENT} AS document FROM tagged",
        "tokenize": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, {_join('t', chr(39) + ' ' + chr(39))} AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+', 0) AS t FROM documents)",
        "hash_embed": w(_tokens("documents", "doc_id", "text", "dv")) + "SELECT doc_id, bucket, weight FROM dv_w",
        "l2_normalize": w(_tokens("documents", "doc_id", "text", "dv")) + "SELECT doc_id, bucket, round(v, 5) AS weight FROM dv",
        "index_metadata": w(CORPUS, SCORES, TRAITS, FINDINGS, INDEX) + "SELECT id, url, platform, tags, has_secrets FROM index_rows",
        "semantic_search": _semantic(registry.QUERY_TEXT, cat.DEFAULT_TOP_K),
        "semantic_search_filtered": _semantic(registry.FILTER_QUERY, 5, "platform = 'langchain'"),
        "knn_embeddings": "SELECT id, label, round(d, 4) AS distance FROM (SELECT vec_id AS id, label, round(list_cosine_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) AS d FROM embeddings) ORDER BY d, id LIMIT 10",
        "knn_batch": "SELECT query_id, id, round(d, 4) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS d FROM embeddings a, embeddings b)) WHERE rank <= 5",
        "knn_recall": f"SELECT count(*) FILTER (vec_id % 20 = 0) AS n_queries, CAST(count(*) FILTER (vec_id % 20 = 0) * least({cat.DEFAULT_TOP_K}, count(*)) AS BIGINT) AS n_wanted, true AS enough FROM embeddings",
        "knn_batch_text": w(_tokens("documents", "doc_id", "text", "dv"), _tokens("benchmark", "item_id", "text", "qv")) + "SELECT query_id, id, round(d, 4) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM (SELECT item_id AS query_id, x.doc_id AS id, round(1 - coalesce(dot, 0.0), 9) AS d FROM benchmark CROSS JOIN documents x LEFT JOIN (SELECT item_id, doc_id, sum(dv.v * qv.v) AS dot FROM dv JOIN qv USING (bucket) GROUP BY ALL) USING (item_id, doc_id))) WHERE rank <= 3",
        "search_filename": _search("every", "filename"),
        "search_content": _search("code-search", "content"),
        "search_path": _search("every", "path"),
        "search_combined": _search("every", "combined"),
        "search_extension": _search("code-search", "extension"),
        "search_filetype": _search("open-web", "content"),
        "search_host": _search("s3"),
        "search_host_code": _search("code-host"),
        "predicate_catalogue": w(CORPUS, SEARCH, _preds("every")) + "SELECT CAST(p.query_no AS BIGINT) AS query_no, p.source, p.query, p.kind, p.kind || ': ' || concat_ws(' + ', p.basename, p.needle, p.part) AS description, p.tags, count(h.seq) AS n_hits FROM preds p LEFT JOIN phits h USING (query_no) GROUP BY ALL",
        "search_all": w(CORPUS, SEARCH, _preds("all")) + "SELECT url, CAST(query_no AS BIGINT) AS query_no, rank, query FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY seq) AS rank FROM phits) WHERE rank <= 10 QUALIFY row_number() OVER (PARTITION BY url ORDER BY query_no, rank) = 1",
        "coverage_grid": w(URLS, f"names AS (SELECT unnest({strlist(cat.TARGET_FILENAMES)}) AS filename, unnest(range({len(cat.TARGET_FILENAMES)})) AS pos)") + f"SELECT repo_base, pos, filename, repo_base || '/' || filename AS url FROM (SELECT DISTINCT coalesce({_BASE_GITHUB}, {_BASE_GITLAB}) AS repo_base FROM parts), names WHERE repo_base IS NOT NULL AND repo_base || '/' || filename NOT IN (SELECT url FROM urls)",
        "mask_auth_headers": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Accept=' || event_type || ';Authorization=token [REDACTED]' WHEN 1 THEN 'X-Kind=' || event_type || ';authorization=[REDACTED]' ELSE 'Accept=' || event_type END AS headers FROM events",
    }
