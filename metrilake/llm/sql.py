"""DuckDB SQL for the queries that SQL can express."""
from __future__ import annotations

from .licenses import RULES, SENTENCES, STEMS

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: Links from shared shingles, components by reachability.
OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: The level after 64 rounds of clamping (it stands after a few), the seeded order by md5.
OP2 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS cap,
             CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM d GROUP BY source),
v(i, level) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT v.i + 1, (SELECT (sum(source_size) * 1.5::DOUBLE - coalesce(sum(cap) FILTER (WHERE cap < v.level * weight), 0.0))
                          / sum(weight) FILTER (WHERE NOT cap < v.level * weight) FROM s)
  FROM v WHERE v.i < 64),
t AS (SELECT source, source_size, least(cap, (SELECT level FROM v WHERE i = 64) * weight) AS target FROM s),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
o AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN ahead + size / 2.0::DOUBLE < rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""

OP5 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM d
"""

OP6 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
        AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, min(r.other) AS component_id, v.vec_id = min(r.other) AS kept
FROM v JOIN r USING (vec_id) GROUP BY v.vec_id
"""


def _op8() -> str:
    """Sentences as the operator cuts them; each rule takes its sequence out of the list of identifiers in turn."""
    known = ", ".join(f"'{s}': {i}" for i, s in sorted(SENTENCES.items()))
    steps, names = [], []
    for k, (name, seq) in enumerate(RULES):
        part = "".join(f",{i}," for i in seq)
        steps.append(f"r{k + 1} AS (SELECT *, contains(s{k}, '{part}') AS h{k}, replace(s{k}, '{part}', ';') AS s{k + 1} FROM r{k})")
        before = [f"h{j}" for j in range(k) if RULES[j][0] == name]
        names.append(f"CASE WHEN h{k}" + (f" AND NOT ({' OR '.join(before)})" if before else "") + f" THEN '{name}' END")
    last = len(RULES)
    return rf"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[.!?;](\s|$)', chr(1) || '\1', 'g'),
             chr(1) || '|\n[^\p{{L}}\p{{N}}\n]*\n'), lambda x: trim(x, E' \t\r\n')), lambda x: regexp_matches(x, '{STEMS}')) AS parts FROM documents),
b AS (SELECT doc_id, flatten(list_transform(parts, lambda x: CASE WHEN contains(x, chr(10)) THEN list_concat([x], string_split(x, chr(10))) ELSE [x] END)) AS parts FROM p),
m AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: MAP {{{known}}}[trim(regexp_replace(x, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))]), lambda x: x IS NOT NULL) AS ids FROM b),
r0 AS (SELECT doc_id, ids, CASE WHEN len(ids) > 0 THEN ',' || array_to_string(ids, ',,') || ',' ELSE '' END AS s0 FROM m),
{', '.join(steps)}
SELECT doc_id, concat_ws(',', {', '.join(names)}) AS licenses, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       CAST(len(regexp_extract_all(s{last}, '\d+')) AS BIGINT) AS unmatched FROM r{last}
"""


OP8 = _op8()


def _crc32(text: str) -> str:
    """SQL for the crc32 of an ASCII text: the usual table by its rule (polynomial 0xEDB88320), one look-up a byte."""
    table = []
    for b in range(256):
        for _ in range(8):
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        table.append(b)
    return (f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda x: unicode(x)::BIGINT), "
            f"lambda c, b: xor(c >> 8, ({table}::BIGINT[])[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295::BIGINT)")


def _op13() -> str:
    """Costs and audits of all turns up to each by state (nothing, s, u, a), the cost as nine digits before the audit."""
    def plus(x: str, cost: str, edit: str) -> str:
        return f"(lpad(CAST(CAST({x}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {x}[10:] || '{edit}')"

    def stays(x: str, role: str) -> str:
        keep = plus(x, "late", "K")
        return (f"CASE WHEN gone THEN NULL WHEN letter = '{role}' THEN {keep}" + ("" if role == "s" else f" ELSE {plus(x, '1 + late', 'R')}") + " END")

    closed = f"""SELECT *, q0 AS c0, q1 AS c1, least(q2, {plus('q0', '5', 'I')}, {plus('q1', '5', 'I')}, {plus('q3', '5', 'I')}) AS c2"""
    step = f"""SELECT conv_id, i + 1 AS i, {plus('c0', '2', 'D')} AS q0, least({plus('c1', '2', 'D')}, {stays('c0', 's')}) AS q1,
      least({plus('c2', '2', 'D')}, {stays('c0', 'u')}, {stays('c1', 'u')}, {stays('c3', 'u')}) AS q2, least({plus('c3', '2', 'D')}, {stays('c2', 'a')}) AS q3"""
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
             regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS mark FROM d),
f AS (SELECT *, CASE WHEN mark = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
                     WHEN mark NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault, left(role, 1) AS letter,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o),
g AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
             count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
             count(*) FILTER (WHERE before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
a AS (SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
             coalesce(illegal, 0) AS illegal, coalesce(n, 0) AS n
      FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id),
w AS (SELECT conv_id, 0 AS i, '000000000' AS q0, NULL::VARCHAR AS q1, NULL::VARCHAR AS q2, NULL::VARCHAR AS q3 FROM a
  UNION ALL
  {step} FROM (SELECT *, least(q3, {plus('c2', '5', 'I')}) AS c3 FROM ({closed} FROM (
    SELECT w.*, f.letter, f.fault IN ('b', 'd') AS gone, CASE f.fault WHEN 't' THEN 5 ELSE 0 END AS late
    FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = w.i + 1)))),
r AS (SELECT conv_id, least(q0, q3, {plus('c2', '5', 'I')}) AS best
      FROM ({closed} FROM (SELECT w.* FROM w JOIN a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.n = w.i))),
u AS (SELECT conv_id, unnest(string_split(best[10:], '')) AS edit, generate_subscripts(string_split(best[10:], ''), 1) AS nth FROM r WHERE length(best) > 9),
p AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY nth) AS pos,
             count(*) FILTER (WHERE edit <> 'D') OVER (PARTITION BY conv_id ORDER BY nth) AS place FROM u),
l AS (SELECT p.*, f.role, f.text, max(CASE WHEN edit = 'K' AND place = 1 AND f.letter = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS lead
      FROM p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos AND p.edit <> 'I'),
s AS (SELECT conv_id, string_agg((CASE WHEN edit = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':'
             || (CASE WHEN edit = 'I' THEN '' ELSE text END), E'
' ORDER BY nth) AS body FROM l WHERE edit <> 'D' GROUP BY conv_id)
SELECT a.conv_id, a.gaps, a.blank, a.duplicate, a.truncated, a.illegal, CAST(r.best[1:9] AS BIGINT) AS cost, r.best[10:] AS audit,
       sha256(coalesce(s.body, '')) AS repaired_sha256
FROM a JOIN r ON a.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN s ON a.conv_id IS NOT DISTINCT FROM s.conv_id
"""


OP13 = _op13()
