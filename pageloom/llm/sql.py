"""DuckDB SQL for the queries that SQL can express, written apart from the Spark code."""

from __future__ import annotations

from pageloom.llm.licenses import COPYRIGHT_LINE, NOT_WORD, NOTICES, NUMBERING, SPELLINGS

# Windows of ten words (or an item's fewer) compared by brute force, word by word.
DECONTAMINATION_SQL = r"""
WITH lowered AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS row,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', item_id, row_number() OVER (), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
split AS (SELECT kind, id, row, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
items AS (
  SELECT id AS item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM split WHERE kind = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM items),
wins AS (
  SELECT row, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT row, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM split, sizes WHERE kind = 'd' AND len(w) >= m)),
hits AS (SELECT wins.row, wins.i, wins.m, items.item FROM wins JOIN items ON wins.m = items.m AND wins.win = items.win),
covered AS (
  SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT row, unnest(generate_series(i, i + m - 1)) AS p FROM hits) GROUP BY row),
found AS (
  SELECT row, count(*) AS n_items, string_agg(s, ',' ORDER BY s COLLATE "C") AS s
  FROM (SELECT DISTINCT row, CAST(item AS VARCHAR) AS s FROM hits) GROUP BY row)
SELECT d.id AS doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
       sha256(coalesce(f.s, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM split d LEFT JOIN covered c USING (row) LEFT JOIN found f USING (row) WHERE d.kind = 'd'"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical(x: str) -> str:
    out = f"regexp_replace(regexp_replace(lower({x}), {_text(COPYRIGHT_LINE)}, '', 'g'), {_text(NUMBERING)}, '', 'g')"
    out = f"' ' || replace(regexp_replace({out}, {_text(NOT_WORD)}, ' ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
    for other, usual in SPELLINGS.items():
        out = f"replace({out}, ' {other} ', ' {usual} ')"
    return out


def _digest(x: str) -> str:
    words = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    return f"CASE WHEN {words} <> '' THEN sha256({words}) END"


LICENSES_SQL = f"""
WITH known AS (
  SELECT DISTINCT license_id, {_digest("form")} AS unit
  FROM (SELECT license_id, {_canonical("text")} AS form FROM (VALUES {", ".join(f"({_text(k)}, {_text(t)})" for k, ts in NOTICES.items() for t in ts)}) v(license_id, text))),
forms AS (SELECT row_number() OVER () AS row, doc_id, {_canonical("coalesce(text, '')")} AS form FROM documents),
units AS (
  SELECT row, 'whole' AS kind, form AS unit FROM forms
  UNION ALL SELECT row, 'part', unnest(string_split(form, chr(10))) FROM forms WHERE contains(form, chr(10))
  UNION ALL SELECT row, 'part', p FROM (SELECT row, unnest(string_split_regex(form, '\\n *\\n')) AS p FROM forms) WHERE contains(p, chr(10))),
hashed AS (SELECT row, kind, row_number() OVER () AS u, {_digest("unit")} AS d FROM units),
met AS (SELECT h.row, h.kind, h.u, k.license_id FROM hashed h JOIN known k ON h.d = k.unit)
SELECT f.doc_id, (SELECT max(h.d) FROM hashed h WHERE h.row = f.row AND h.kind = 'whole') AS digest,
       coalesce(m.whole_licenses, '') AS whole_licenses, coalesce(m.n_matches, 0) AS n_matches, coalesce(m.licenses, '') AS licenses
FROM forms f LEFT JOIN (
  SELECT row, string_agg(DISTINCT license_id, ',' ORDER BY license_id) FILTER (kind = 'whole') AS whole_licenses, count(DISTINCT u) AS n_matches,
         string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS licenses FROM met GROUP BY row) m USING (row)"""


def _codes_sql() -> str:
    """Two rounds and the last assignment, every part against every entry."""
    finite = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    gap = "list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = (
        "SELECT row, label, vec_id, p, any_value(x) AS x, min(d * 64 + e) % 64 AS e, min(d * 64 + e) // 64 AS d FROM ("
        f"SELECT row, label, vec_id, parts.p, x, e, CAST({gap} AS BIGINT) AS d FROM parts JOIN {{book}} b ON parts.p = b.p) t GROUP BY row, label, vec_id, p")
    mean = (
        "SELECT o.p, o.e, coalesce(m.y, o.y) AS y FROM {book} o LEFT JOIN (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS y FROM ("
        "SELECT p, e, i, CAST(sum(x[i]) AS DOUBLE) AS s, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM {near}) u GROUP BY p, e, i) v "
        "GROUP BY p, e) m ON o.p = m.p AND o.e = m.e")
    return f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND {finite}),
parts AS (SELECT row, vec_id, label, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS x FROM (SELECT *, unnest(range(16)) AS p FROM kept) k),
b0 AS (SELECT p, row - 1 AS e, x AS y FROM parts WHERE row <= 64),
n0 AS ({near.format(book='b0')}), b1 AS ({mean.format(book='b0', near='n0')}),
n1 AS ({near.format(book='b1')}), b2 AS ({mean.format(book='b1', near='n1')}),
n2 AS ({near.format(book='b2')}),
coded AS (SELECT row, vec_id, label, string_agg(lower(printf('%02x', CAST(e AS INT))), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n2 GROUP BY row, vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS h FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, books"""


CODES_SQL = _codes_sql()
