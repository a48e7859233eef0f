"""DuckDB twins of the text operators that SQL can express. They state the contracts by brute force, not by the operators'
methods. Without a twin: op2 (knapsack), op3 (compression), op8 (robust estimates) and op9 (embedded checksums)."""

from __future__ import annotations

from gradewright.llm.common import LOWER, UPPER
from gradewright.llm.language_id import PROFILE, SAMPLE, UNKNOWN
from gradewright.llm.sharding import BUCKETS, Node, grow, tree
from gradewright.llm.source_audit import EXTRA, LEAST, SCALE, TOP
from gradewright.llm.turn_repair import DELETE, INSERT, KEPT, NEXT, REROLE, ROLE, SPACES, TRUNCATED
from gradewright.llm.url_filter import DAMPING, LINK, RULES, SAME, THRESHOLD, TWIN_STEPS

WORDS = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


OP1 = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents
), w AS (
  SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(line, '{WORDS}'))) AS s FROM l WHERE regexp_matches(line, '{WORDS}')
), c AS (
  SELECT s, min({{'d': doc_id, 'l': line_no}}) AS place, len(s) AS n, row_number() OVER (ORDER BY min({{'d': doc_id, 'l': line_no}})) AS id FROM w GROUP BY s
), t AS (
  SELECT id, n, unnest(s) AS tok FROM c
), p AS (
  SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.tok = b.tok AND a.id < b.id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 4 * count(*) >= 3 * (a.n + b.n - count(*))
), k AS (
  SELECT id, count(*) AS n_links, bool_or(later) AS later FROM (SELECT a AS id, false AS later FROM p UNION ALL SELECT b, true FROM p) GROUP BY id
)
SELECT w.doc_id, w.line_no::BIGINT AS line_no, c.place.d AS class_doc_id, c.place.l::BIGINT AS class_line_no, coalesce(k.n_links, 0)::BIGINT AS n_links,
  (w.doc_id = c.place.d AND w.line_no = c.place.l AND NOT coalesce(k.later, false)) AS kept
FROM w JOIN c ON w.s = c.s LEFT JOIN k ON k.id = c.id
"""


def _links() -> str:
    """Hosts whose distrust is above their trust once both have settled."""
    link = LINK.replace("'", "''")
    return f"""
l AS (
  SELECT src, lower_host AS dst FROM (
    SELECT src, translate(regexp_extract('http:' || regexp_extract(link, '(?s)(//.*)$', 1), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS lower_host
    FROM (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM p WHERE host <> '')
  ) WHERE lower_host <> '' AND lower_host <> src
), named AS (
  SELECT host FROM p WHERE host <> '' UNION SELECT dst FROM l
), chain AS (
  SELECT DISTINCT array_to_string(s[i:], '.') AS low, array_to_string(s[i + 1:], '.') AS high
  FROM (SELECT s, unnest(range(1, len(s) - 1)) AS i FROM (SELECT string_split(host, '.') AS s FROM named))
), g AS MATERIALIZED (
  SELECT src, dst, sum(weight) AS weight FROM (
    SELECT src, dst, 1.0::DOUBLE AS weight FROM l UNION ALL SELECT low, high, 1.0 FROM chain UNION ALL SELECT high, low, 1.0 FROM chain
  ) GROUP BY src, dst
), e AS MATERIALIZED (
  SELECT 'trust' AS kind, src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM g
  UNION ALL SELECT 'distrust', dst, src, weight / sum(weight) OVER (PARTITION BY dst) FROM g
), r0 AS MATERIALIZED (
  SELECT if(by_rule = 'allow', 'trust', 'distrust') AS kind, host, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY by_rule) AS mass
  FROM p WHERE host <> '' AND by_rule IS NOT NULL GROUP BY by_rule, host
), terms AS (
  SELECT 0 AS step, kind, host, mass * (1 - {DAMPING}) AS term FROM r0
  UNION ALL
  SELECT t.step + 1, t.kind, e.dst, sum(t.term * e.share * {DAMPING}) FROM terms t JOIN e ON e.kind = t.kind AND e.src = t.host
  WHERE t.step < {TWIN_STEPS} GROUP BY t.step, t.kind, e.dst
), bad AS (
  SELECT host FROM terms GROUP BY host
  HAVING coalesce(sum(term) FILTER (kind = 'distrust'), 0) > {THRESHOLD} * (1 + {SAME}) * coalesce(sum(term) FILTER (kind = 'trust'), 0)
)"""


def _rules(column: int) -> str:
    out = "CASE "
    for r in sorted(RULES, key=lambda r: (-len(r), r)):
        name, start = r.split("/", 1)
        out += f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}') THEN '{(r, RULES[r])[column]}' "
    return out + "END"


OP4 = rf"""
WITH RECURSIVE u AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), p AS MATERIALIZED (
  SELECT *, {_rules(0)} AS rule, {_rules(1)} AS by_rule FROM u
), {_links()}
SELECT page_id, p.host, path, rule, coalesce(by_rule, if(bad.host IS NULL, 'allow', 'block')) AS verdict FROM p LEFT JOIN bad ON bad.host = p.host
"""

CONTROLS = r"<s>|</s>|\[INST\]|\[/INST\]|\[SYS\]|\[/SYS\]|\[BOT\]|\[ROLE\]|\[TEXT\]|\[/ROLE\]"
# what a turn adds: its text, one more for each backslash, two for each control string inside, and the marks around
_ESCAPED = rf"length({{0}}) + length({{0}}) - length(replace({{0}}, '\', '')) + 2 * len(regexp_extract_all(replace({{0}}, '\', '\\'), '{CONTROLS}'))"
OP5 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT *, {_ESCAPED.format("said")}
    + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 WHEN 'system' THEN 11 ELSE 19 + {_ESCAPED.format("role")} END AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY turn NULLS FIRST, role, said)) AS turns_sha256,
  coalesce(sum(length(said)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(said, '' ORDER BY turn NULLS FIRST, role, said) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(chars))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def _draw(name: str, weight: float = 1.0) -> str:
    text = f"md5('s0:{name}:' || coalesce(doc_id::VARCHAR, 'null'))"
    u = f"((('0x' || substr({text}, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"
    return u if name == "slot" else f"(-ln({u}) / {weight})"


def _shard(node: Node) -> str:
    if not node.children:
        return str(node.shard)
    if len(node.children) == 1:
        return _shard(node.children[0])
    draws = [_draw(c.name, c.weight) for c in node.children]
    cases = " ".join(f"WHEN {d} = least({', '.join(draws)}) THEN {_shard(c)}" for d, c in zip(draws, node.children, strict=True))
    return f"CASE {cases} END"


def _crc_table() -> str:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return f"{out}::BIGINT[]"


_TREE = tree(24)
_NEW = grow(_TREE).children[-1]
OP6 = f"""
WITH b AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {_crc_table()} AS crcs,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents
), d AS (
  SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: xor(a >> 8, crcs[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32,
    {_shard(_TREE)} AS shard, {_draw(_NEW.name, _NEW.weight)} < least({", ".join(_draw(c.name, c.weight) for c in _TREE.children)}) AS moves,
    floor({_draw("slot")} * {BUCKETS}) AS bucket FROM b
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, if(moves, 24, shard) AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1 AS slot FROM d
"""

OP7 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_lowered("text")}, '{WORDS}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram FROM w WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), r AS (
  SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), m AS (
  SELECT a, min(b) AS low FROM r GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id,
  w.doc_id <= coalesce(m.low, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""

OP10 = rf"""
WITH i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_lowered("text")}, '{LETTERS}') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: w[k:k + 9])) AS gram FROM i WHERE len(w) > 0
), d AS (
  SELECT doc_id, regexp_extract_all({_lowered("text")}, '{LETTERS}') AS w FROM documents
), z AS (
  SELECT DISTINCT len(gram) AS size FROM g
), v AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, w FROM d, z WHERE len(w) >= size
), h AS (
  SELECT doc_id, pos, size, item FROM (SELECT doc_id, pos, size, w[pos:pos + size - 1] AS gram FROM v) x JOIN g USING (gram)
), hit AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM h) GROUP BY doc_id
), item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN item ON item.doc_id = d.doc_id
"""

TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
OP11 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_lowered("text")}, '{TERMS}') AS w FROM documents
), g AS (
  SELECT DISTINCT lang, source FROM d
), o AS (
  SELECT id, lang, source, unnest(w) AS term FROM d
), k AS (
  SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST}
), v AS (
  SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang
), c AS (
  SELECT o.lang, source, term, count(*)::HUGEINT AS n FROM o JOIN k USING (lang, term) GROUP BY o.lang, source, term
), t AS (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {SCALE} * (coalesce(c.n, 0) + {EXTRA}) // (coalesce(t.total, 0) + 2 * v.v) AS p
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
  SELECT lang, term, 1 + {SCALE} * (sum(n) + {EXTRA}) // (any_value(total) + 2 * any_value(v)) AS q
  FROM c JOIN (SELECT lang, sum(total) AS total FROM t GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM k)
  UNION ALL
  SELECT p.lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""


def _crc32(text: str) -> str:
    """CRC-32 of an expression's UTF-8 bytes, with ``crcs`` in scope."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda a, x: xor(a >> 8, crcs[(xor(a, x) & 255) + 1])), 4294967295)"


def _repair_step() -> str:
    """The four best ends (cost, letters, repaired) of a conversation before a turn, from those after it in ``r``."""
    late = f"if(cut, {TRUNCATED}, 0)"
    end = lambda cost, letter, state, said: f"{{{{'c': {cost} + {state}.c, 'a': '{letter}' || {state}.a, 'o': {said} || {state}.o}}}}".replace("{{", "{").replace("}}", "}")
    out = []
    for s in range(4):
        ways = [end(DELETE, "D", f"r.s{s}", "''")]
        ways.append(f"if(NOT must_go, {end(f'{REROLE} + {late}', 'R', f'r.s{NEXT[s]}', f'chr(10) || {chr(39)}{ROLE[s]}:{chr(39)} || text')}, NULL)")
        for kind, moves in KEPT.items():
            if s in moves:
                ways.append(f"if(NOT must_go AND initial = '{kind}', {end(late, 'K', f'r.s{moves[s]}', 'chr(10) || role || chr(58) || text')}, NULL)")
        out.append(f"list_min([x FOR x IN [{', '.join(ways)}] IF x IS NOT NULL]) AS b{s}")
    return ", ".join(out)


def _inserted(names: str, state: int, to: str) -> str:
    said = f"chr(10) || '{ROLE[state]}:'"
    return f"list_min([{names}{state}, {{'c': {INSERT} + {to}.c, 'a': 'I' || {to}.a, 'o': {said} || {to}.o}}])"


OP12 = rf"""
WITH RECURSIVE raw AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc_table()} AS crcs,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), way AS MATERIALIZED (
  SELECT conv_id, turn, role, text, {_crc32("k")} % 20 AS way FROM raw
), m AS MATERIALIZED (
  SELECT conv_id, turn, if(way = 4, 'user', role) AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(if(way = 3, [1, 2], [1])) AS copy FROM way WHERE way <> 0)
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS place FROM m
), n AS MATERIALIZED (
  SELECT *, place > 1 AS again, NOT regexp_matches(text, '{WORDS}') AS blank, role[1] AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, place) AS i,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, place) AS former FROM placed
), f AS MATERIALIZED (
  SELECT *, (blank OR again) AS must_go, right(rtrim(text, {"||".join(f"chr({ord(c)})" for c in SPACES)}), 1) NOT IN ('.', '!', '?') AS cut FROM n
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate,
    count_if(cut AND NOT again AND NOT blank) AS truncated, count_if(former IS NOT NULL AND former || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS turns
  FROM f GROUP BY conv_id
), r AS (
  SELECT conv_id, turns AS i, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS s0,
    {{'c': {2 * INSERT}::BIGINT, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s1, {{'c': {INSERT}::BIGINT, 'a': 'I', 'o': chr(10) || 'assistant:'}} AS s2, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS s3
  FROM figures
  UNION ALL
  SELECT conv_id, i, {_inserted("b", 0, "t2")} AS s0, {_inserted("b", 1, "t2")} AS s1, t2 AS s2, t3 AS s3 FROM (
    SELECT *, {_inserted("b", 2, "b3")} AS t2, {_inserted("b", 3, "b2")} AS t3 FROM (
      SELECT r.conv_id, r.i - 1 AS i, {_repair_step()} FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i
    ))
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(r.s0.c, 0)::BIGINT AS cost, coalesce(r.s0.a, '') AS audit,
  sha256(coalesce(substr(r.s0.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = 0
"""

OP13 = rf"""
WITH raw AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, lang, text, {_crc_table()} AS crcs, encode(coalesce(text, '')) AS bytes FROM documents
), d AS MATERIALIZED (
  SELECT row, doc_id, lang, text, coalesce({_crc32("doc_id::VARCHAR")} % 5 = 0, false) AS held_out,
    {_crc32("coalesce(text, '')")} AS crc FROM raw
), g AS MATERIALIZED (
  SELECT row, gram, count(*) AS n FROM (
    SELECT row, unnest(list_concat(
      list_transform(range(2, len(w)), lambda i: w[i]), list_transform(range(1, len(w)), lambda i: w[i:i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]))) AS gram
    FROM (SELECT row, ' ' || lower(unnest(regexp_extract_all(text, '\pL+'))) || ' ' AS w FROM d)
  ) GROUP BY row, gram
), ranked AS (
  SELECT row, gram, row_number() OVER (PARTITION BY row ORDER BY n DESC, length(gram), gram) - 1 AS pos FROM g
), mine AS MATERIALIZED (
  SELECT row, gram, pos FROM ranked WHERE pos < {PROFILE}
), taught AS (
  SELECT row, lang, (('0x' || substr(md5('language:' || coalesce(doc_id::VARCHAR, 'null') || ':' || crc), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS draw,
    {SAMPLE}.0::DOUBLE / count(*) OVER (PARTITION BY lang) AS share FROM d WHERE NOT held_out AND lang IS NOT NULL AND text IS NOT NULL
), known AS (
  SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(gram), gram) - 1 AS pos FROM taught JOIN g USING (row) WHERE draw < share GROUP BY lang, gram
), profiles AS MATERIALIZED (
  SELECT * FROM known WHERE pos < {PROFILE}
), far AS (
  SELECT row, lang, sum(abs(m.pos - p.pos) - {PROFILE}) AS less FROM mine m JOIN profiles p USING (gram) GROUP BY row, lang
), every AS (
  SELECT n.row, l.lang, n.n, n.n * {PROFILE} + coalesce(far.less, 0) AS distance
  FROM (SELECT row, count(*) AS n FROM mine GROUP BY row) n CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN far ON far.row = n.row AND far.lang = l.lang
), best AS (
  SELECT row, list_min(list({{'distance': distance, 'lang': lang, 'n': n}})) AS b FROM every GROUP BY row
)
SELECT doc_id, held_out, coalesce(b.lang, '{UNKNOWN}') AS lang_pred, coalesce(1 - b.distance / (b.n * {PROFILE}.0::DOUBLE), 0.0::DOUBLE) AS score FROM d LEFT JOIN best USING (row)
"""

SQL: dict[str, str] = {
    "op1_line_dedup": OP1,
    "op4_url_filter": OP4,
    "op5_chat_format": OP5,
    "op6_hash_tree_shards": OP6,
    "op7_minhash_dedup": OP7,
    "op10_decontaminate": OP10,
    "op11_source_audit": OP11,
    "op12_turn_repair": OP12,
    "op13_language_id": OP13,
}
