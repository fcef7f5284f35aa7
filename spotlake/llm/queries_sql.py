"""DuckDB SQL for the operators that SQL can express; written from the contracts."""

from __future__ import annotations

import math

from spotlake.llm.license_scan import DIGESTS, KNOWN, MENTION, SPELLINGS
from spotlake.llm.url_filter import DAMPING, RULES, THRESHOLD, TOLERANCE

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


EXACT_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (body)
"""


def _canonical(low: str) -> str:
    line = r"(?m)^[^a-z0-9\n]*(?:copyright[^\n]*(?:\(c\)|©|[0-9]{4})|\(c\) *[0-9]{4}|© *[0-9]{4})[^\n]*$"
    plain = rf"trim(regexp_replace(regexp_replace({low}, {_quoted(line)}, '', 'g'), '[\x00-\x2F\x3A-\x60\x7B-\x7F©“”‘’–—]+', ' ', 'g'))"
    spelled = f"(' ' || {plain} || ' ')"
    for old, new in SPELLINGS:
        spelled = f"replace({spelled}, ' {old} ', ' {new} ')"
    return f"CASE WHEN regexp_matches({plain}, '{MENTION}') THEN trim({spelled}) ELSE {plain} END"


LICENSES_SQL = f"""
WITH texts AS (SELECT sha256({_canonical("low")}) AS digest, license_id
  FROM (SELECT license_id, {_LOW.format("t")} AS low FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in KNOWN)}) v(license_id, t))),
known AS MATERIALIZED (SELECT digest, min(license_id) AS license_id FROM (SELECT digest, license_id FROM texts
  UNION ALL SELECT digest, license_id FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(d)})" for k, d in DIGESTS)}) v(license_id, digest)) GROUP BY 1),
low AS (SELECT doc_id, {_LOW.format("coalesce(text, '')")} AS low FROM documents),
lines AS (SELECT doc_id, unnest(string_split(low, chr(10))) AS low, generate_subscripts(string_split(low, chr(10)), 1) AS line_no FROM low),
noted AS (SELECT doc_id, line_no, regexp_matches(low, '{MENTION}') AS mentions, sha256({_canonical("low")}) AS digest FROM lines),
units AS (SELECT doc_id, 'text' AS unit, CAST(0 AS BIGINT) AS line_no, sha256({_canonical("low")}) AS digest FROM low
  UNION ALL SELECT doc_id, 'line', line_no, digest FROM noted WHERE mentions OR digest IN (SELECT digest FROM known))
SELECT doc_id, unit, line_no, digest, license_id FROM units LEFT JOIN known USING (digest)
"""


def _urls() -> str:
    rest = "CASE WHEN coalesce(instr(url, '://'), 0) > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    case = {what: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if what == 'rule' else v}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END" for what in ("rule", "ruled")}
    link = r"""(?:[Hh][Rr][Ee][Ff]|[Ss][Rr][Cc])\s*=\s*["']?\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s"'<>]+)"""
    rounds = math.ceil(math.log(TOLERANCE / 4) / math.log(DAMPING))
    return f"""
WITH RECURSIVE r AS (SELECT page_id, html, {rest} AS rest FROM pages),
b AS (SELECT page_id, html, split_part(split_part(rest, '#', 1), '?', 1) AS before FROM r),
h AS (SELECT page_id, html, {_LOW.format("split_part(before, '/', 1)")} AS host, substr(before, length(split_part(before, '/', 1)) + 1) AS path FROM b),
j AS MATERIALIZED (SELECT page_id, host, path, {case["rule"]} AS rule, {case["ruled"]} AS ruled FROM h),
l AS MATERIALIZED (SELECT host AS src, {_LOW.format("unnest(regexp_extract_all(html, " + _quoted(link) + ", 1))")} AS dst FROM h WHERE host <> ''),
e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst GROUP BY 1, 2),
w AS (SELECT src AS host, dst AS to_host, 'trust' AS kind, n FROM e UNION ALL SELECT dst, src, 'distrust', n FROM e),
ways AS MATERIALIZED (SELECT host, kind, to_host, n / sum(n) OVER (PARTITION BY host, kind) AS share FROM w),
p AS (SELECT host, CASE ruled WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, count(*) AS mass FROM j WHERE ruled IS NOT NULL GROUP BY 1, 2),
seeds AS MATERIALIZED (SELECT host, kind, mass / sum(mass) OVER (PARTITION BY kind) AS seed FROM p),
it AS (SELECT 0 AS nth, host, kind, seed AS score FROM seeds UNION ALL
  SELECT nth, host, kind, sum(score) FROM (
    SELECT it.nth + 1 AS nth, to_host AS host, kind, {DAMPING} * score * share AS score FROM it JOIN ways USING (host, kind)
    UNION ALL SELECT lost.nth + 1, host, kind, seed * again FROM seeds JOIN (
      SELECT it.nth, kind, sum(CASE WHEN o.host IS NULL THEN score ELSE score * {1 - DAMPING} END) AS again
      FROM it LEFT JOIN (SELECT DISTINCT host, kind FROM ways) o USING (host, kind) GROUP BY 1, 2) lost USING (kind))
  WHERE nth <= (SELECT CASE WHEN count(*) > 0 THEN {rounds} ELSE 0 END FROM ways) GROUP BY 1, 2, 3),
x AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END) AS trust, sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END) AS distrust
  FROM it WHERE nth = (SELECT max(nth) FROM it) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN round(distrust / (trust + distrust), 9) > {THRESHOLD} THEN 'block' END, 'allow') AS verdict FROM j LEFT JOIN x USING (host)
"""


URLS_SQL = _urls()


def _field(column: str) -> str:
    return f"coalesce(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _tree(name: str, leaves: str) -> str:
    """Levels of all trees over ``leaves`` (grp, pos, node), and what stands left and right of each node in its run."""
    return f"""
{name}_up AS (
  SELECT grp, 0 AS lvl, pos, count(*) OVER (PARTITION BY grp) AS n, node FROM {leaves}
  UNION ALL
  SELECT grp, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM {name}_up WHERE n > 1 GROUP BY grp, lvl, n, pos // 16),
{name}_sides AS (
  SELECT a.grp, a.lvl, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name}_up a JOIN {name}_up b ON a.grp = b.grp AND a.lvl = b.lvl AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY a.grp, a.lvl, a.pos),
{name}_path AS (
  SELECT x.grp, x.pos, list(s.l || '|' || s.r ORDER BY s.lvl) FILTER (s.l IS NOT NULL) AS path
  FROM {leaves} x LEFT JOIN {name}_sides s ON s.grp = x.grp AND s.pos = x.pos // CAST(pow(16, s.lvl) AS BIGINT) GROUP BY x.grp, x.pos),
{name}_top AS (SELECT grp, node AS top FROM {name}_up WHERE n = 1)"""


# CRC-32 (reflected polynomial 0xEDB88320) over the digits of doc_id.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)))"""

MERKLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '') AS grp, {_leaf("text")} AS node,
    CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(_LOW.format("text"))} ELSE {_leaf("text")} END AS presented FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, node) - 1 AS pos FROM d),
{_tree("doc", "leaves")},
tops AS (SELECT '' AS grp, grp AS src, top AS node, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos FROM doc_top),
{_tree("src", "tops")},
paths AS (SELECT x.doc_id, x.node AS leaf, x.presented, t.node AS subroot, s.top AS root, coalesce(p.path, []) || coalesce(q.path, []) AS path
  FROM leaves x JOIN doc_path p USING (grp, pos) JOIN tops t ON t.src = x.grp JOIN src_path q ON q.pos = t.pos CROSS JOIN src_top s),
f AS (SELECT *, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
  list_reduce(list_prepend(presented, path), lambda node, x: sha256(split_part(x, '|', 1) || node || split_part(x, '|', 2))) AS folded_root FROM paths)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
