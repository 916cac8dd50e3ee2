"""SQL for the queries of this folder that SQL can express.

The model, the tokenizer, packing, the index with its overlap checks, minhash banding, page extraction and the
further kinds of personal data have no SQL; the tests hold them against plain versions.
"""

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from . import licenses, url_filter

_WORD = r"'[^\x20\x09-\x0D]+'"

_JOIN = f"""
WITH RECURSIVE
words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), {_WORD}) AS w
    FROM documents),
sets AS (
    SELECT doc_id, list_distinct(CASE
        WHEN len(w) = 0 THEN []::VARCHAR[]
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
    FROM words),
shingles AS (SELECT doc_id, unnest(s) AS s FROM sets),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * k >= 80 * (x.n + y.n - k)),
steps AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM steps UNION SELECT r.a, s.b FROM reach r JOIN steps s ON r.b = s.a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(min(b), doc_id)) AS component_id
FROM sizes LEFT JOIN reach ON doc_id = a GROUP BY doc_id, n"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _digest(text: str) -> str:
    form = f"regexp_replace(lower({text}), {_quoted(licenses.COPYRIGHT_LINE)}, '', 'g')"
    form = reduce(lambda x, p: f"replace({x}, {_quoted(p[0])}, {_quoted(p[1])})", licenses.SPELLINGS, form)
    form = rf"trim(regexp_replace({form}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return f"CASE WHEN {form} <> '' THEN sha256({form}) END"


def _known(texts: tuple[tuple[str, str], ...]) -> str:
    rows = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in texts)
    return f"SELECT license, {_digest('t')} AS digest FROM (VALUES {rows}) AS v(license, t)"


_LICENSES = f"""
WITH whole AS ({_known(licenses.LICENSES)}),
notice AS ({_known(licenses.NOTICES)}),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
named AS (SELECT doc_id, {_digest("line")} AS digest FROM lines WHERE contains(lower(line), 'licen')),
found AS (
    SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices
    FROM named JOIN notice USING (digest) GROUP BY doc_id),
digests AS (SELECT doc_id, {_digest("text")} AS digest FROM documents)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
FROM digests LEFT JOIN whole USING (digest) LEFT JOIN found USING (doc_id)"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
_BLOCKED = ", ".join(f"('{h}', '{p}')" for h, p in url_filter.BLOCKED)

_URLS = f"""
WITH rest AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
bare AS (SELECT page_id, regexp_extract(r, '^[^?#]*') AS r FROM rest),
parts AS (
    SELECT page_id, translate(regexp_extract(r, '^[^/]*'), '{ascii_uppercase}', '{ascii_lowercase}') AS host,
           CASE WHEN contains(r, '/') THEN substr(r, instr(r, '/')) ELSE '' END AS path
    FROM bare),
rules(h, p, v) AS (VALUES {_RULES}),
blocked(h, p) AS (VALUES {_BLOCKED}),
fits AS (
    SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
    FROM (SELECT DISTINCT page_id, host, path FROM parts) JOIN rules
         ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
listed AS (
    SELECT DISTINCT page_id FROM parts JOIN blocked
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN listed.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM parts LEFT JOIN fits USING (page_id) LEFT JOIN listed USING (page_id)"""

_VALUE = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LOWERED = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_VALUE.format(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, start: str) -> str:
    return f"""{name} AS (
    {start}
    UNION ALL
    SELECT level + 1, tree, pos // 16, sha256(string_agg(node, '' ORDER BY pos))
    FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}) WHERE n > 1
    GROUP BY level, tree, pos // 16),
{name}_top AS (SELECT tree, max(level) AS depth, arg_max(node, level) AS node FROM {name} GROUP BY tree)"""


def _beside(docs: str, name: str, steps: str) -> str:
    """What stands left and right of each document's node, on each level but the last."""
    return f"""SELECT doc_id, {steps} + level AS step,
           coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (n.pos < d.pos // CAST(pow(16, level) AS BIGINT)), '') AS l,
           coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (n.pos > d.pos // CAST(pow(16, level) AS BIGINT)), '') AS r
    FROM {docs} d JOIN {name} n ON n.tree = d.tree JOIN {name}_top t ON t.tree = n.tree AND level < depth
    WHERE n.pos // 16 = d.pos // CAST(pow(16, level + 1) AS BIGINT) GROUP BY doc_id, level"""


_MERKLE = f"""
WITH RECURSIVE
crc_table AS (
    SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], LAMBDA c, x:
        CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS c FROM range(256) AS v(i)),
chosen AS (
    SELECT doc_id, xor(4294967295, list_reduce(
        [4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), LAMBDA x: CAST(ascii(x) AS BIGINT)),
        LAMBDA c, x: xor(c // 256, crc_table.c[1 + xor(c % 256, x)]))) % 5 = 0 AS tampered
    FROM documents, crc_table),
leaves AS (
    SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf("text")} AS leaf,
           CASE WHEN tampered THEN {_leaf(_LOWERED)} ELSE {_leaf("text")} END AS checked,
           row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos
    FROM documents JOIN chosen USING (doc_id)),
{_levels("inner_nodes", "SELECT 0 AS level, tree, pos, leaf AS node FROM leaves")},
sources AS (SELECT tree AS name, node, row_number() OVER (ORDER BY tree) - 1 AS pos, '' AS tree FROM inner_nodes_top),
{_levels("outer_nodes", "SELECT 0 AS level, tree, pos, node FROM sources")},
placed AS (SELECT doc_id, s.tree, s.pos FROM leaves JOIN sources s ON s.name = leaves.tree),
beside AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS k FROM (
    {_beside("leaves", "inner_nodes", "0")}
    UNION ALL
    {_beside("placed", "outer_nodes", "100")})),
folded AS (
    SELECT doc_id, 0 AS k, checked AS node FROM leaves
    UNION ALL
    SELECT doc_id, f.k + 1, sha256(l || node || r) FROM folded f JOIN beside b USING (doc_id) WHERE b.k = f.k + 1)
SELECT doc_id, leaf, s.node AS subroot, root.node AS root, coalesce(proof, sha256('')) AS proof_sha256,
       f.node AS folded_root, f.node = root.node AS verified
FROM leaves JOIN sources s ON s.name = leaves.tree CROSS JOIN (SELECT node FROM outer_nodes_top) root
LEFT JOIN (SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM beside GROUP BY doc_id) USING (doc_id)
JOIN (SELECT doc_id, arg_max(node, k) AS node FROM folded GROUP BY doc_id) f USING (doc_id)"""

_COPIES = r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM texts WINDOW w AS (PARTITION BY t)"""

_SHARE = "1 + CAST(1000000000 AS HUGEINT) * (c + 2) // (sum(c) OVER w + 2 * count(*) OVER w)"

_DIVERGENCE = rf"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
        translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents),
words AS (SELECT doc_id, lang, source, unnest(w) AS term FROM texts),
kept AS (
    SELECT lang, term FROM (SELECT DISTINCT doc_id, lang, term FROM words) GROUP BY lang, term HAVING count(*) >= 10),
groups AS (SELECT DISTINCT lang, source FROM texts),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
dense AS (
    SELECT lang, source, term, coalesce(c, 0) AS c
    FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
own AS (SELECT *, {_SHARE} AS p FROM dense WINDOW w AS (PARTITION BY lang, source)),
common AS (
    SELECT lang, term, {_SHARE} AS q FROM (SELECT lang, term, sum(c) AS c FROM dense GROUP BY lang, term)
    WINDOW w AS (PARTITION BY lang)),
apart AS (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM own x JOIN own y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (
    SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
    FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN apart a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
terms AS (
    SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
    FROM own JOIN common USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10"""

_PASSAGES = f"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), {_WORD}) AS w
    FROM documents),
places AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS place FROM words),
windows AS (SELECT doc_id, place, sha256(array_to_string(w[place + 1 : place + 50], ' ')) AS digest FROM places),
firsts AS (
    SELECT digest, min((doc_id, place)) AS f FROM windows GROUP BY digest HAVING count(*) > 1),
marked AS (
    SELECT doc_id, place, f[1] AS first_doc, (doc_id, place) <> f AS removed FROM windows JOIN firsts USING (digest)),
runs AS (
    SELECT *, place - row_number() OVER (PARTITION BY doc_id, first_doc, removed ORDER BY place) AS run FROM marked)
SELECT doc_id, min(place) AS first_word, count(*) + 49 AS n_words, first_doc, removed
FROM runs GROUP BY doc_id, first_doc, removed, run"""

ORACLES: dict[str, str] = {
    "op3_ngram_join": _JOIN,
    "op4_licenses": _LICENSES,
    "op5_url_filter": _URLS,
    "op7_passages": _PASSAGES,
    "op11_merkle_manifest": _MERKLE,
    "op12_exact_dedup": _COPIES,
    "op13_source_divergence": _DIVERGENCE,
}
