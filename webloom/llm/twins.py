"""SQL of those queries of this subpackage that DuckDB can say."""

from __future__ import annotations

from . import op13_secrets

#: The checksum's table of 256 numbers, from its polynomial.
_CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t"


def _bytes(text: str) -> str:
    digit = f"instr('0123456789ABCDEF', substr(hex({text}), i::INT + %d, 1)) - 1"
    return f"list_transform(range(1, length(hex({text})), 2), lambda i: (16 * ({digit % 0}) + {digit % 1})::BIGINT)"


def _crc32(text: str) -> str:
    """With ``t`` of crc_table in scope."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {_bytes(text)}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"


#: Depths gone through for maps: beyond the deepest path of the given tables.
_DEPTHS = 9


def nested_schema() -> str:
    name = "CASE WHEN len(steps) > {k} AND steps[{k} + 1] LIKE '.%' THEN steps[{k} + 1] END"
    rounds = ", ".join(
        f"names_{k} AS (SELECT steps[1:{k}] AS prefix, count(DISTINCT {name.format(k=k)}) AS n FROM r_{k - 1} WHERE {name.format(k=k)} IS NOT NULL GROUP BY ALL), "
        f"r_{k} AS (SELECT CASE WHEN n.n > 5 AND {k} > 1 AND {name.format(k=k)} IS NOT NULL THEN steps[1:{k}] || ['.*'] || steps[{k} + 2:] ELSE steps END AS steps, type, c, least, most FROM r_{k - 1} r LEFT JOIN names_{k} n ON n.prefix = r.steps[1:{k}] AND len(r.steps) > {k})"
        for k in range(1, _DEPTHS + 1)
    )
    counts = " UNION ALL ".join(f"SELECT prefix, n FROM names_{k}" for k in range(1, _DEPTHS + 1))
    return f"""
WITH crc_table AS ({_CRC_TABLE}),
clicked AS (SELECT click_id, props, CASE WHEN json_valid(props) THEN json_type(props) = 'OBJECT' ELSE FALSE END AS good, coalesce(client_id, 0) % 200 AS g FROM clicks),
placed AS (SELECT click_id, props, coalesce(good, FALSE) AS good, g, {_crc32("CAST(click_id AS VARCHAR)")} % (g % 37 + 1) AS x FROM clicked, crc_table),
tree AS (SELECT p.click_id, p.g, p.x, '$.' || fullkey AS key, j.type, CASE WHEN j.type = 'ARRAY' THEN json_array_length(j.value) END AS n
  FROM (SELECT * FROM placed WHERE good) p, json_tree(p.props) j),
seen AS (SELECT ['$', '.g' || g, '.x' || x] || CASE WHEN click_id % 9 = 0 THEN ['[]'] ELSE [] END || regexp_extract_all(substr(regexp_replace(key, '\\[[0-9]+\\]', '[]', 'g'), 4), '\\.[^.\\[]+|\\[\\]') AS steps, type, n FROM tree
  UNION ALL SELECT ['$'], 'OBJECT', NULL FROM placed WHERE good UNION ALL SELECT ['$', '.g' || g], 'OBJECT', NULL FROM placed WHERE good
  UNION ALL SELECT ['$', '.g' || g, '.x' || x], 'ARRAY', 1 FROM placed WHERE good AND click_id % 9 = 0
  UNION ALL SELECT ['!g' || g], 'BAD', NULL FROM placed WHERE NOT good),
r_0 AS (SELECT steps, CASE WHEN type LIKE '%INT' THEN 'integer' WHEN type = 'VARCHAR' THEN 'string' ELSE lower(type) END AS type, count(*) AS c, min(n) AS least, max(n) AS most FROM seen GROUP BY ALL),
{rounds},
counts AS ({counts}),
typed AS (SELECT steps, type, sum(c) AS c, min(least) AS least, max(most) AS most FROM r_{_DEPTHS} GROUP BY ALL),
paths AS (SELECT steps, string_agg(type || ':' || c::BIGINT, '|' ORDER BY type) AS types, sum(c) AS total, coalesce(sum(CASE WHEN type = 'object' THEN c END), 0) AS objects, min(least) AS least, max(most) AS most FROM typed GROUP BY steps)
SELECT array_to_string(p.steps, '') AS path, p.types, coalesce(n.n, 0)::BIGINT AS n_names, coalesce(n.n > 5 AND len(p.steps) > 1, FALSE) AS is_map,
  coalesce(p.steps[-1] LIKE '.%' AND p.steps[-1] <> '.*' AND p.total < o.objects, FALSE) AS optional, p.least::BIGINT AS min_len, p.most::BIGINT AS max_len
FROM paths p LEFT JOIN counts n ON n.prefix = p.steps LEFT JOIN paths o ON len(p.steps) > 1 AND o.steps = p.steps[1:len(p.steps) - 1]"""


def spelling_variants() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE crc_table AS ({_CRC_TABLE}),
runs AS (SELECT doc_id, translate(r, '{upper}', '{upper.lower()}') AS r, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL),
summed AS (SELECT r, n, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r")} AS h FROM runs, crc_table WHERE length(r) >= 5),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, n FROM summed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words),
holes AS (SELECT word, n, k, substr(word, 1, k::INT - 1) AS a, substr(word, k::INT + 1) AS b FROM cut),
near AS (SELECT x.word, y.word AS near, y.n AS m FROM holes x JOIN holes y ON x.k = y.k AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.a || h.b
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.a || h.b),
best AS (SELECT word, near, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM near),
known AS (SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.near END AS form, CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1),
walk AS (SELECT word, form AS at FROM known WHERE form IS NOT NULL UNION ALL SELECT k.word, f.form FROM walk k JOIN known f ON f.word = k.at WHERE f.form IS NOT NULL),
roots AS (SELECT walk.word, walk.at AS root FROM walk JOIN known f ON f.word = walk.at WHERE f.form IS NULL)
SELECT k.word, k.form, coalesce(r.root, k.word) AS root, k.n, k.n_near, k.form_n FROM known k LEFT JOIN roots r ON r.word = k.word"""


def trigram_secrets() -> str:
    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def spans(k: int, rule: op13_secrets.Rule) -> str:
        """The matches of a rule that are long enough: pieces between them give the places."""
        p = quoted(rule.pattern)
        kept = f"length({f'regexp_extract(hits[i], {p}, {rule.group})' if rule.group else 'hits[i]'}) >= {rule.least}"
        return f"""SELECT doc, {k} AS k, {quoted(rule.kind)} AS kind, starts[i] AS s, starts[i] + length(hits[i]) AS e FROM (
  SELECT doc, hits, starts, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT doc, hits, list_transform(range(1, len(hits) + 1), lambda i: (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT) AS starts
    FROM (SELECT doc, regexp_extract_all(text, {p}) AS hits, string_split_regex(text, {p}) AS pieces FROM numbered WHERE regexp_matches(text, {p})))) WHERE {kept}"""

    # shorter runs would match and be dropped
    rules = [(k, op13_secrets.Rule(r.kind, "[0-9a-f]{16,}", 16) if r.kind == "hex" else r) for k, r in enumerate(op13_secrets.RULES)]
    found = " UNION ALL ".join(spans(k, r) for k, r in rules)
    count = ", ".join(f"count(k) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(op13_secrets.BASE))
    digest = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) {}, '')"
    return f"""
WITH numbered AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found})
SELECT doc_id, {count}, sha256({digest.format(f"FILTER (k < {len(op13_secrets.BASE)})")}) AS base_sha256, {digest.format("")} AS spans, count(k) AS n_spans
FROM numbered LEFT JOIN found USING (doc) GROUP BY doc, doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op11_nested_schema": nested_schema(), "op12_spelling_variants": spelling_variants(), "op13_trigram_secrets": trigram_secrets()}
