"""DuckDB SQL of the operators that SQL can express; plain joins over whole tables, another way than the operators'."""

from __future__ import annotations

from tallyjoin.llm.common import LOWER, UPPER


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


_STRICT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

#: Windows of items met with all windows of that length in each document; words have no blank in them. n_near: the two rarest
#: words of a window, by texts that hold them, stand within two words of their places.
DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words("text", _STRICT)} AS w FROM documents),
i AS (SELECT item_id, {_words("text", _STRICT)} AS w FROM benchmark),
iw AS (SELECT item_id, w, least(13, len(w)) AS n FROM i WHERE len(w) > 0),
ip AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM iw),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM ip),
dn AS (SELECT rid, w, n FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
dp AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dn),
met AS (SELECT rid, s, dp.n, item_id FROM dp JOIN windows ON dp.n = windows.n AND array_to_string(w[s : s + dp.n - 1], ' ') = win),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM met) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS joined FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY rid),
held AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT rid, unnest(w) AS term FROM d) GROUP BY term),
iat AS (SELECT item_id, w, s, unnest(range(s, s + n)) AS ix FROM ip),
ranked AS (SELECT item_id, w, s, ix, w[ix] AS term, coalesce(held.n, 0) AS n, row_number() OVER (PARTITION BY item_id, w, s ORDER BY coalesce(held.n, 0), ix) AS r FROM iat LEFT JOIN held ON term = w[ix]),
anchors AS (SELECT DISTINCT a.item_id, a.w, a.ix AS at_a, a.term AS term_a, b.ix AS at_b, b.term AS term_b FROM ranked a LEFT JOIN ranked b ON a.item_id IS NOT DISTINCT FROM b.item_id AND a.w = b.w AND a.s = b.s AND b.r = 2
  WHERE a.r = 1 AND a.n > 0),
used AS (SELECT term_a AS term FROM anchors UNION SELECT term_b FROM anchors),
places AS (SELECT rid, term, p FROM (SELECT rid, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS p FROM d) JOIN used USING (term)),
close AS (SELECT DISTINCT x.rid, item_id FROM anchors JOIN places x ON x.term = term_a LEFT JOIN places y ON y.term = term_b AND y.rid = x.rid AND abs((x.p - at_a) - (y.p - at_b)) <= 2
  WHERE term_b IS NULL OR y.rid IS NOT NULL),
near AS (SELECT rid, count(DISTINCT coalesce(CAST(item_id AS VARCHAR), '')) AS n_near FROM close GROUP BY rid),
f AS (SELECT doc_id, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(joined, '') AS joined
  FROM d LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid) LEFT JOIN near USING (rid))
SELECT doc_id, n_words, n_hit, n_items, sha256(joined) AS items_sha256, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated, n_near FROM f"""

#: Every pair of different sets that have a shingle in common; copies are one node.
JACCARD = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_words("text", _SPACED)} AS w FROM documents),
p AS (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM d WHERE len(w) > 0),
sets AS (SELECT rid, list_sort(list(DISTINCT array_to_string(w[s : s + 3], ' '))) AS shingles FROM p GROUP BY rid),
marked AS (SELECT rid, shingles, md5(array_to_string(shingles, chr(10))) AS node FROM sets),
nodes AS (SELECT node, any_value(shingles) AS shingles, any_value(len(shingles)) AS n FROM marked GROUP BY node),
places AS (SELECT node, n, unnest(shingles) AS shingle FROM nodes),
links AS (SELECT a.node AS a, b.node AS b FROM places a JOIN places b ON a.shingle = b.shingle AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
own AS (SELECT node, min(doc_id) AS id FROM marked JOIN d USING (rid) GROUP BY node),
least_ids AS (SELECT reach.a AS node, min(id) AS component_id FROM reach JOIN own ON own.node = reach.b GROUP BY reach.a)
SELECT doc_id, CAST(coalesce(len(shingles), 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM d LEFT JOIN marked USING (rid) LEFT JOIN least_ids USING (node)"""

#: Places of the base phrases, by joining the words of a text with those one and two behind them.
LICENSE_BASE = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words("text", _STRICT)} AS w FROM documents),
t AS (SELECT rid, unnest(w) AS term, unnest(range(len(w))) AS p FROM d),
two AS (SELECT a.rid, a.p, a.term AS label FROM t a JOIN t b ON b.rid = a.rid AND b.p = a.p + 1 WHERE a.term IN ('mit', 'apache') AND b.term = 'license'),
three AS (SELECT a.rid, a.p, 'gpl' AS label FROM t a JOIN t b ON b.rid = a.rid AND b.p = a.p + 1 JOIN t c ON c.rid = a.rid AND c.p = a.p + 2
  WHERE a.term = 'general' AND b.term = 'public' AND c.term = 'license'),
f AS (SELECT rid, count(*) AS n, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT * FROM two UNION ALL SELECT * FROM three) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels
FROM d LEFT JOIN f USING (rid)"""


def _either_case(word: str) -> str:
    """RE2 folds letters beyond ASCII too, so each letter is written in both cases."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEY = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = rf"""(?:{_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _spans(name: str, kind: int, pattern: str, group: int, least: int) -> str:
    """CTEs of one kind's matches: a match ends where the gaps and matches up to it end."""
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""{name}_m AS (SELECT rid, unnest(range(len(h))) AS i, unnest(g[1 : len(h)]) AS gap, unnest(h) AS hit, unnest(v) AS value
  FROM (SELECT rid, string_split_regex(t, {quoted}) AS g, regexp_extract_all(t, {quoted}) AS h, regexp_extract_all(t, {quoted}, {group}) AS v FROM d) WHERE len(h) > 0),
{name}_s AS (SELECT rid, {kind} AS kind, '{name}' AS label, value, length(hit) AS n, sum(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY i) AS e FROM {name}_m),
{name} AS (SELECT rid, kind, label, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM {name}_s WHERE length(value) >= {least})"""


#: The base spans of the secret scan.
SECRET_BASE = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{_spans("assign", 0, _ASSIGN, 1, 6)},
{_spans("access", 1, "AKIA[A-Z0-9]+", 0, 20)},
{_spans("hex", 2, "[0-9a-f]+", 0, 24)},
f AS (SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS x, string_agg(concat(label, ':', s, ':', e), ',' ORDER BY s, kind) AS joined
  FROM (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex) GROUP BY rid)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(k, 0) AS BIGINT) AS n_access, CAST(coalesce(x, 0) AS BIGINT) AS n_hex, sha256(coalesce(joined, '')) AS base_sha256
FROM d LEFT JOIN f USING (rid)"""

ORACLES: dict[str, str] = {"op2_decontamination": DECONTAMINATION, "op3_ngram_jaccard": JACCARD, "license_scan_base": LICENSE_BASE, "secret_scan_base": SECRET_BASE}
