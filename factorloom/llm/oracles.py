"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import secrets
from . import substring_dedup as spans
from .common import WORD
from .exact_dedup import LOWER, UPPER

OP8 = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""

OP10 = f"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         md5(concat_ws('|', '0', doc_id::VARCHAR, text)) AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank, 3 * source_size AS cap FROM sizes),
weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked),
filled AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS budget,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::BIGINT AS budget_left,
         (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS weight_left
  FROM weighed
  WINDOW before AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levelled AS (
  SELECT *, max(CASE WHEN cap::DOUBLE / weight >= budget_left::DOUBLE / weight_left THEN budget_left::DOUBLE / weight_left END) OVER () AS level
  FROM filled),
targets AS (SELECT source, rank, source_size, budget, least(cap::DOUBLE, level * weight) AS target FROM levelled),
queued AS (
  SELECT row_number() OVER () AS row_no, b.*, t.rank, t.source_size, t.budget, t.target,
         (sum(b.size) OVER (PARTITION BY t.rank ORDER BY b.key, b.doc_id, b.size ROWS UNBOUNDED PRECEDING))::BIGINT AS cum
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
runs AS (
  SELECT *, (source_size * epoch + cum)::DOUBLE / target AS vft
  FROM queued CROSS JOIN (VALUES (0), (1), (2)) e(epoch) WHERE size > 0),
cut AS (
  SELECT *, sum(size) OVER (ORDER BY vft, rank, epoch, key, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM runs),
took AS (SELECT row_no, sum(size)::BIGINT AS taken FROM cut WHERE running <= budget GROUP BY row_no)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM queued LEFT JOIN took USING (row_no)
"""


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spans(kind: str, pattern: str, keep: str = "true", text: str = "t") -> str:
    """Matches of one pattern with their positions, by the lengths of the gaps between them."""
    p = _literal(pattern)
    return f"""
  SELECT row_no, {secrets.KINDS.index(kind)} AS kind_no, '{kind}' AS kind, found,
         list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT row_no, hits, gaps, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS found
        FROM (SELECT row_no, regexp_extract_all({text}, {p}) AS hits, string_split_regex({text}, {p}) AS gaps FROM d))
  WHERE {keep}"""


def _op4() -> str:
    assign = secrets.ASSIGN
    base = "\n  UNION ALL".join([
        _spans("assign", assign, f"length(regexp_extract(found, {_literal(assign)}, 2)) >= {secrets.LEAST_VALUE}"),
        _spans("access", secrets.ACCESS), _spans("hex", secrets.HEX),
    ])
    no_allowed = " AND ".join(f"NOT regexp_matches(found, {_literal(a)})" for a in secrets.ALLOWED)
    runs = "\n  UNION ALL".join(_spans(c.kind, f"{c.pattern}{{{c.window},}}", no_allowed, "bare") for c in secrets.CLASSES)
    bare = "coalesce(text, '')"
    for word in secrets.PLACEHOLDERS:
        bare = f"regexp_replace({bare}, '(?i:{word})', '{' ' * len(word)}', 'g')"
    hot = "\n  UNION ALL".join(
        f"""
  SELECT row_no, kind_no, kind, start AS run_start, start + p AS start, start + p + {c.window} AS stop
  FROM (SELECT *, unnest(range(0, length(found) - {c.window} + 1)) AS p FROM runs WHERE kind = '{c.kind}')
  WHERE list_sum(list_transform(map_values(list_histogram(string_split(found[p + 1:p + {c.window}], ''))), lambda n: {c.terms}[n::BIGINT + 1])) <= {c.limit}"""
        for c in secrets.CLASSES
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t, {bare} AS bare FROM documents),
base AS (SELECT row_no, kind_no, kind, start::BIGINT AS start, (start + length(found))::BIGINT AS stop FROM ({base})),
runs AS ({runs}),
hot AS ({hot}),
steps AS (
  SELECT *, CASE WHEN start <= lag(stop) OVER (PARTITION BY row_no, kind_no, run_start ORDER BY start) THEN 0 ELSE 1 END AS opens FROM hot),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY row_no, kind_no, run_start ORDER BY start ROWS UNBOUNDED PRECEDING) AS island FROM steps),
found AS (SELECT row_no, kind_no, kind, min(start)::BIGINT AS start, max(stop)::BIGINT AS stop FROM islands GROUP BY row_no, kind_no, kind, run_start, island),
added AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row_no = f.row_no AND b.start <= f.start AND f.stop <= b.stop)),
b AS (SELECT row_no, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, kind_no, stop) AS spans FROM base GROUP BY row_no),
a AS (SELECT row_no, string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, kind_no, stop) AS spans
      FROM (SELECT * FROM base UNION ALL SELECT row_no, kind_no, kind, start, stop FROM added) GROUP BY row_no)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(a.spans, '') AS spans
FROM d LEFT JOIN b USING (row_no) LEFT JOIN a USING (row_no)
"""


OP4 = _op4()

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT row_no, doc_id, regexp_extract_all(text, '{spans.SENTENCE}') AS p FROM d),
plains AS (SELECT row_no, doc_id, list_transform(p, lambda s: trim(regexp_replace(lower(s), '{spans.SPACES}', ' ', 'g'))) AS plain FROM parts),
counted AS (
  SELECT *, list_transform(plain, lambda s: len(regexp_extract_all(s, '{WORD}')) + len(regexp_extract_all(s, '{spans.UNSPACED}')) // 2) AS words FROM plains),
places AS (SELECT *, unnest(range(0, len(plain))) AS place FROM counted),
grown AS (
  SELECT *, list_filter(range({spans.SPAN}, least({spans.LEAST_WORDS + 1}, len(plain) - place) + 1),
                        lambda n: list_sum(words[place + 1:place + n]) >= {spans.LEAST_WORDS})[1] AS n FROM places),
runs AS (
  SELECT row_no, doc_id, place, n, plain[place + 1:place + n] AS run FROM grown WHERE n IS NOT NULL
  UNION ALL SELECT row_no, doc_id, place, 1, plain[place + 1:place + 1] FROM places WHERE words[place + 1] >= {spans.ALONE_WORDS}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, place) AS k FROM runs),
covered AS (SELECT DISTINCT row_no, place + j AS place FROM (SELECT row_no, place, unnest(range(0, n)) AS j FROM ranked WHERE k > 1)),
gone AS (SELECT row_no, list(place::INTEGER ORDER BY place) AS removed FROM covered GROUP BY row_no)
SELECT doc_id, len(p)::BIGINT AS n_sentences, coalesce(len(removed), 0)::BIGINT AS n_removed,
       coalesce(array_to_string(removed, ','), '') AS removed,
       coalesce(array_to_string(list_filter(p, lambda x, i: NOT list_contains(coalesce(removed, []), (i - 1)::INTEGER)), ''), '') AS text
FROM parts LEFT JOIN gone USING (row_no)
"""

OP6 = """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda c: CASE WHEN isfinite(c) THEN floor(c::DOUBLE * 1024) END) AS v FROM embeddings),
usable AS (SELECT row_number() OVER () AS no, vec_id, list_transform(v, lambda c: c::BIGINT) AS v FROM x
           WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda c: c IS NULL)) = 0),
scored AS (
  SELECT q.no, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP1 = r"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS payload, 'day ' || floor(page_id / 7)::BIGINT AS changed, page_id % 5 AS turn, length(coalesce(html, '')) AS size,
         regexp_replace(url, '#.*$', '') AS bare FROM pages),
h AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z]+://([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_replace(bare, '^[A-Za-z]+://[^/?]*', ''), '([?&])utm_[a-z]+=[^&]*', '\1', 'g') AS rest FROM p),
c AS (
  SELECT *, host || regexp_replace(regexp_replace(regexp_replace(rest, '[?]&+', '?', 'g'), '[?&]+$', ''), '/+([?]|$)', '\1', 'g') AS canonical_url,
         '"' || payload[1:16] || '"' AS tag FROM h),
v AS (SELECT page_id * 2 + 1 AS record_id, CASE WHEN page_id % 29 <> 0 THEN canonical_url END AS canonical_url, page_id + CASE turn WHEN 4 THEN -1 ELSE 1000 END AS ts, turn, tag, changed, payload FROM c),
j AS (
  SELECT v.record_id, v.canonical_url, v.ts, v.turn, v.tag, v.changed, v.payload, r.page_id * 2 AS resolved_id, r.page_id AS r_ts, r.tag AS r_tag,
         r.changed AS r_changed, r.payload AS r_payload, r.size AS r_size,
         row_number() OVER (PARTITION BY v.record_id ORDER BY r.page_id DESC) AS k
  FROM v LEFT JOIN c r ON r.canonical_url = v.canonical_url AND r.page_id < v.ts),
o AS (
  SELECT *, CASE WHEN canonical_url IS NULL THEN 'no_url' WHEN resolved_id IS NULL THEN 'no_response'
                 WHEN turn = 3 THEN 'no_validator' WHEN (turn IN (0, 4) AND tag = r_tag) OR (turn = 1 AND changed = r_changed) OR (turn = 2 AND payload = r_payload) THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM j WHERE k = 1)
SELECT record_id, canonical_url, ts, outcome, resolved_id,
       CASE WHEN outcome = 'resolved' THEN concat('content-length: ', r_size, '; content-type: text/html; date: ', ts, '; etag: ', CASE WHEN turn IN (0, 4) THEN 'W/' ELSE '' END, r_tag,
                                                  '; last-modified: ', r_changed, '; x-cache: HIT') END AS headers,
       CASE WHEN outcome = 'resolved' THEN r_payload END AS digest
FROM o
"""

#: The table of CRC-32 (polynomial 0xEDB88320), computed by SQL.
CRC_TABLE = """SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))"""


def _crc(text: str) -> str:
    """CRC-32 of an ASCII text, where the table is ``t``."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295]::BIGINT[], {codes}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


def _added(way: str, cost: str, letters: str) -> str:
    return f"CASE WHEN {way} IS NOT NULL THEN {{'c': {way}.c + {cost}, 'a': {way}.a || '{letters}'}} END"


def _op11() -> str:
    best = "list_min([{}])".format
    rerole = [_added(f"w{i}", "2 + late", "R") for i in range(4)]

    def keep(initial: str, i: int) -> str:
        return f"CASE WHEN initial = '{initial}' THEN {_added(f'w{i}', 'late', 'K')} END"


    def open_(way: str) -> str:
        return f"CASE WHEN NOT gone THEN {way} END"

    ways = [[_added(f"w{i}", "3", "D")] for i in range(4)]
    ways[1] += [open_(keep("s", 0))]
    ways[2] += [open_(x) for i in (0, 1, 3) for x in (keep("u", i), rerole[i])]
    ways[3] += [open_(x) for x in (keep("a", 2), rerole[2])]
    edits = ", ".join(f"{best(', '.join(w))} AS e{i}" for i, w in enumerate(ways))
    way = "STRUCT(c BIGINT, a VARCHAR)"
    return f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
ids AS (SELECT conv_id, row_number() OVER () AS no FROM (SELECT DISTINCT conv_id FROM conversations)),
faults AS (
  SELECT no, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc("coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f
  FROM conversations c JOIN ids ON c.conv_id IS NOT DISTINCT FROM ids.conv_id CROSS JOIN crc),
damaged AS (
  SELECT no, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM faults),
ordered AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY no, role, text ORDER BY i) AS k, role[1] AS initial,
         regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last FROM ordered),
turns AS (
  SELECT *, last = '' AS blank, last <> '' AND k > 1 AS duplicate, last <> '' AND k = 1 AND last NOT IN ('.', '!', '?') AS truncated,
         last = '' OR k > 1 AS gone, CASE WHEN last NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS late,
         lag(initial) OVER (PARTITION BY no ORDER BY i) AS before FROM placed),
scan AS (
  SELECT no, 0::BIGINT AS i, {{'c': 0, 'a': ''}}::{way} AS w0, NULL::{way} AS w1, {{'c': 2, 'a': 'I'}}::{way} AS w2, {{'c': 4, 'a': 'II'}}::{way} AS w3 FROM ids
  UNION ALL
  SELECT no, i, e0, e1, {best(", ".join(["e2", *(_added(f"e{j}", "2", "I") for j in (0, 1, 3))]))}, {best(", ".join(["e3", _added("e2", "2", "I"), *(_added(f"e{j}", "4", "II") for j in (0, 1))]))}
  FROM (SELECT t.no, t.i, {edits} FROM scan s JOIN turns t ON t.no = s.no AND t.i = s.i + 1)),
plans AS (SELECT no, list_min([w0, w3]) AS best FROM scan QUALIFY row_number() OVER (PARTITION BY no ORDER BY i DESC) = 1),
letters AS (SELECT no, best.a[p] AS letter, p FROM plans, unnest(range(1, length(best.a) + 1)) u(p)),
spent AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY no ORDER BY p) AS i, count(*) FILTER (letter <> 'D') OVER (PARTITION BY no ORDER BY p) - 1 AS j FROM letters),
left_over AS (
  SELECT s.no, p, letter, CASE WHEN letter <> 'I' THEN t.role END AS role, CASE WHEN letter = 'I' THEN '' ELSE t.text END AS text,
         j - max(CASE WHEN letter = 'K' AND t.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.no) AS place
  FROM spent s LEFT JOIN turns t ON t.no = s.no AND t.i = s.i WHERE letter <> 'D'),
repaired AS (
  SELECT no, string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS lines FROM left_over GROUP BY no),
counts AS (
  SELECT no, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY no)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       best.c AS cost, best.a AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM ids JOIN plans USING (no) LEFT JOIN counts USING (no) LEFT JOIN repaired USING (no)
"""


OP11 = _op11()

OP13 = f"""
WITH crc AS ({CRC_TABLE}),
own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
ids AS (SELECT *, {_crc("conv_id::VARCHAR")} % 6 AS h FROM own CROSS JOIN crc),
rebuilt AS (SELECT i.conv_id, list_concat(coalesce(b.turns, [])[1:h], i.turns[h + 1:]) AS turns FROM ids i LEFT JOIN own b ON b.conv_id = i.conv_id - i.conv_id % 100),
prefixes AS (SELECT conv_id, d, turns[1:d] AS p, len(turns) = d AS ends FROM rebuilt, unnest(range(0, len(turns) + 1)) u(d)),
nodes AS (
  SELECT min(conv_id) AS conv_id, d AS depth, p, count(*) AS n_convs, count(*) FILTER (ends) = count(*) AS childless,
         coalesce((count(*) - 1) * length(p[d].t), 0) AS own_saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY d, p),
links AS (SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id FROM nodes n JOIN nodes u ON u.depth = n.depth - 1 AND u.p = n.p[1:n.depth - 1]),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM links GROUP BY 1, 2),
below AS (
  SELECT a.conv_id, a.depth, sum(w.own_saved)::BIGINT AS saved_tokens, count(*) FILTER (w.childless) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM nodes) w JOIN nodes a ON a.depth = w.d AND a.p = w.p[1:w.d] GROUP BY 1, 2)
SELECT n.conv_id, n.depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM nodes n JOIN below USING (conv_id, depth) LEFT JOIN links USING (conv_id, depth) LEFT JOIN children USING (conv_id, depth)
"""

ORACLE_SQL = {"op1_warc_revisits": OP1, "op6_exact_topk": OP6, "op9_substring_dedup": OP9, "op4_secret_scan": OP4, "op8_exact_dedup": OP8, "op10_mixing": OP10, "op11_conversation_repair": OP11, "op13_conversation_trie": OP13}
