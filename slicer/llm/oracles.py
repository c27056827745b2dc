"""DuckDB SQL that the queries must equal, where SQL can say what they mean."""

from __future__ import annotations

from slicer.llm.licenses import TEMPLATES, bigrams, marks, normalised

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLAIN = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _windows(n: int, source: str = "w", by: str = "doc_id, ws, len(ws) AS n") -> str:
    """(doc_id, i, win): every run of n words, from rows (doc_id, ws)."""
    return f"SELECT doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM {source} WHERE len(ws) >= {n})"


def licenses(least: float = 0.8) -> str:
    words = [normalised(text) for _, text in TEMPLATES]
    values = ", ".join(f"({k}, {_text(name)}, {len(w)}, [{', '.join(map(_text, bigrams(w)))}])" for k, ((name, _), w) in enumerate(zip(TEMPLATES, words, strict=True)))
    places = ", ".join(f"({k}, {_text(g)}, {i})" for k, w in enumerate(words) for g, i in marks(w, least))
    grams = "CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END"
    return rf"""
WITH t(k, name, n, tg) AS (VALUES {values}), p(k, gram, place) AS (VALUES {places}),
d AS (SELECT doc_id, row_number() OVER () AS r, string_split(trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM documents),
g AS (SELECT r, i, ws[i] || coalesce(' ' || ws[i + 1], '') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
s AS (SELECT DISTINCT r, k, i - 1 - place AS s FROM g JOIN p USING (gram)),
c AS (SELECT r, k, name, n, tg, greatest(s, 0) AS a, least(s + n, len(ws)) AS z, ws[greatest(s, 0) + 1:least(s + n, len(ws))] AS w FROM s JOIN t USING (k) JOIN d USING (r)),
m AS (SELECT r, k, name, a, z, len(list_intersect(x, tg)) AS n, len(x) + len(tg) AS total FROM (SELECT *, {grams} AS x FROM c)),
f AS (SELECT *, 2.0::DOUBLE * n / total AS dice FROM m WHERE 2.0::DOUBLE * n / total >= {least}),
e AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.r = f.r AND q.k = f.k AND q.a < f.z AND f.a < q.z AND (-q.n, -q.dice, q.a, q.z) < (-f.n, -f.dice, f.a, f.z))),
o AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e q WHERE q.r = e.r AND q.a < e.z AND e.a < q.z AND (-q.n, -q.dice, q.name, q.a, q.z) < (-e.n, -e.dice, e.name, e.a, e.z))),
b AS (SELECT r, arg_min(name, (-n, -dice, name)) AS license, arg_min(dice, (-n, -dice, name)) AS dice, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(*) AS n_matches FROM o GROUP BY r)
SELECT d.doc_id, b.license, round(coalesce(b.dice, 0.0)::DOUBLE, 6) AS dice, coalesce(b.licenses, '') AS licenses, coalesce(b.n_matches, 0)::BIGINT AS n_matches FROM d LEFT JOIN b USING (r)"""


def urls(rules: list[tuple[str, str]], rounds: int = 120, damping: float = 0.85, threshold: float = 1e-3) -> str:
    """What each round adds to the ranks, until 0.85 ** 120 of the seeds are left."""
    cases, verdicts = [], []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, below = rule.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{below}')"
        cases.append(f"WHEN {fits} THEN '{rule}'")
        verdicts.append(f"WHEN '{rule}' THEN '{verdict}'")

    def spread(name: str, edges: str, seeds: str) -> str:
        flow = f"{name}_f AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) * {damping} AS flow FROM {edges})"
        steps = f"{name}_r AS (SELECT 0 AS k, host, n * {1 - damping} AS part FROM {seeds} UNION ALL SELECT k + 1, dst, sum(part * flow) FROM {name}_r JOIN {name}_f ON src = host WHERE k < {rounds} GROUP BY k, dst)"
        return f"{flow}, {steps}, {name} AS (SELECT host, sum(part) AS rank FROM {name}_r GROUP BY host)"

    return rf"""
WITH RECURSIVE r AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT *, CASE {' '.join(cases)} END AS rule FROM p),
v AS (SELECT *, CASE rule {' '.join(verdicts)} END AS own FROM j),
l AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s<>]+)', 1)), '{UPPER}', '{LOWER}') AS dst FROM v),
e AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM l WHERE src <> '' AND src <> dst GROUP BY ALL),
back AS (SELECT dst AS src, src AS dst, weight FROM e),
h AS (SELECT host, count(*) FILTER (WHERE own = 'allow') AS good, count(*) FILTER (WHERE own = 'block') AS bad FROM v WHERE host <> '' GROUP BY host),
hg AS (SELECT host, (good - bad)::DOUBLE AS n FROM h WHERE good > bad), hb AS (SELECT host, (bad - good)::DOUBLE AS n FROM h WHERE bad > good),
{spread('t', 'e', 'hg')}, {spread('d', 'back', 'hb')}
SELECT page_id, v.host, path, rule, coalesce(own, CASE WHEN coalesce(d.rank, 0) - coalesce(t.rank, 0) > {threshold} THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN t ON v.host = t.host LEFT JOIN d ON v.host = d.host"""


def substrings(window: int = 20) -> str:
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{PLAIN}') AS ws FROM documents),
x AS ({_windows(window)}),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM x),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS i FROM f WHERE k > 1),
s AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM g GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(s.n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN s.n IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN s USING (doc_id)"""


def decontamination(width: int = 10) -> str:
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), '{UPPER}', '{LOWER}'), '{ALNUM}')"
    lengths = " UNION ALL ".join(f"SELECT doc_id, i, {n} AS n, array_to_string(ws[i:i + {n - 1}], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w WHERE len(ws) >= {n} AND {n} IN (SELECT n FROM b))" for n in range(1, width + 1))
    return f"""
WITH w AS (SELECT doc_id, {words('text')} AS ws FROM documents),
q AS (SELECT item_id, {words('text')} AS ws FROM benchmark),
b AS (SELECT DISTINCT item_id, least({width}, len(ws)) AS n, array_to_string(ws[i:i + least({width}, len(ws)) - 1], ' ') AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {width - 2}, 2))) AS i FROM q WHERE len(ws) > 0)),
x AS ({lengths}),
m AS (SELECT doc_id, i, x.n, item_id FROM x JOIN b ON x.n = b.n AND x.win = b.win),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


def quality(min_repeat: int = 8, max_covered: float = 0.4, max_repeat: int = 120) -> str:
    """The union of maximal repeats of k words or more is that of repeated k-word windows."""

    def repeated(n: int) -> str:
        return f"(SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM ({_windows(n)})) WHERE c > 1)"

    covered = lambda n: f"(SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + {n})) AS k FROM {repeated(n)}) GROUP BY doc_id)"
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{PLAIN}') AS ws FROM documents),
l AS (SELECT doc_id, len(x) - len(list_distinct(x)) AS n FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '{PLAIN}')) AS x FROM w)),
c3 AS {covered(3)}, c8 AS {covered(min_repeat)}, big AS (SELECT DISTINCT doc_id FROM {repeated(max_repeat + 1)}),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, l.n::BIGINT AS n_dup_lines, coalesce(c3.n, 0)::BIGINT AS n_repeat_words, coalesce(c8.n, 0) AS covered, big.doc_id IS NOT NULL AS long
  FROM w JOIN l USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN c8 USING (doc_id) LEFT JOIN big USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND covered <= {max_covered} * n_words AND NOT long AS kept FROM m"""


def warc() -> str:
    nibbles = "".join(f"{i:04b}" for i in range(16))
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digit = "list_sum(list_transform(range(0, 5), lambda j: substr(bits, (i * 5 + j + 1)::INTEGER, 1)::INTEGER * (16 // (2 ** j)::INTEGER)))"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, octet_length(encode(html)) AS n, array_to_string(list_transform(range(0, 40), lambda k: substr('{nibbles}', 1 + 4 * (strpos('0123456789abcdef', substr(sha1(html), k + 1, 1)) - 1), 4)), '') AS bits, max(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('{alphabet}', 1 + {digit}::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM b"""
