"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_MIX = r"""
WITH d AS (
  SELECT doc_id, source, md5('9:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(rn - 1) % 3 + 1] AS wt, 3 * ss AS cap FROM s),
c AS (
  SELECT *, coalesce(sum(wt) OVER before, 0) AS wb, coalesce(sum(cap) OVER before, 0) AS cb,
         sum(wt) OVER () AS wall, sum(ss) OVER () AS total
  FROM w WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / wt, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT *, min(CASE WHEN CAST(cap AS DOUBLE) * CAST(wall - wb AS DOUBLE) <= CAST(wt AS DOUBLE) * CAST(total - cb AS DOUBLE) THEN 1 ELSE 0 END)
            OVER (ORDER BY CAST(cap AS DOUBLE) / wt, rn) AS capped
  FROM c),
t AS (
  SELECT source, ss, CASE WHEN capped = 1 THEN CAST(cap AS DOUBLE)
         ELSE wt * (CAST(total - coalesce(sum(CASE WHEN capped = 1 THEN cap END) OVER (), 0) AS DOUBLE)
                    / CAST(wall - coalesce(sum(CASE WHEN capped = 1 THEN wt END) OVER (), 0) AS DOUBLE)) END AS target
  FROM f),
p AS (
  SELECT d.doc_id, d.size, t.ss, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS quota,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, ss AS source_size, target,
       CAST(least(greatest(quota - a, 0), size) + least(greatest(quota - a - ss, 0), size)
            + least(greatest(quota - a - 2 * ss, 0), size) AS BIGINT) AS taken
FROM p
"""

_CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(length(replace(role, '<|', '<|/|')) + length(replace(text, '<|', '<|/|')) + 23) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

# No masks: every alignment with three equal words in a row is scored (a stretch that counts has such a run).
_LEAKS = r"""
WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
b0 AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
b AS (SELECT min(item_id) AS item_id, w FROM b0 WHERE len(w) > 0 GROUP BY w),
dg AS (SELECT doc_id, p, w[p + 1:p + 3] AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS p FROM d WHERE len(w) > 2)),
bg AS (SELECT item_id, p, w[p + 1:p + 3] AS g FROM (SELECT item_id, w, unnest(range(0, len(w) - 2)) AS p FROM b WHERE len(w) > 8)),
h AS (SELECT DISTINCT dg.doc_id, bg.item_id, dg.p - bg.p AS shift FROM dg JOIN bg USING (g)),
x AS (SELECT h.doc_id, h.item_id, h.shift, len(b.w) AS n, d.w AS dw, b.w AS bw,
             unnest(range(greatest(0, -h.shift), least(len(b.w), len(d.w) - h.shift))) AS j
      FROM h JOIN d ON d.doc_id = h.doc_id JOIN b ON b.item_id = h.item_id),
e AS (SELECT doc_id, item_id, shift, n, j, CASE WHEN dw[j + shift + 1] = bw[j + 1] THEN 1 ELSE -2 END AS v FROM x),
s AS (SELECT *, sum(v) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j) AS total,
             sum(v) OVER t AS near, count(*) OVER t AS wide FROM e
      WINDOW t AS (PARTITION BY doc_id, item_id, shift ORDER BY j ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)),
r AS (SELECT *, least(0, coalesce(min(total) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM s),
a AS (SELECT doc_id, item_id, shift, n, max(total - low) AS score, bool_or(wide = 13 AND near >= 7) AS dense FROM r GROUP BY ALL),
u AS (SELECT doc_id, item_id, n, score, shift FROM a WHERE dense OR score >= least(12, ceil(CAST(0.55 AS DOUBLE) * n))
      UNION ALL
      SELECT doc_id, item_id, len(bw), len(bw), p
      FROM (SELECT doc_id, item_id, d.w AS dw, b.w AS bw, unnest(range(0, len(d.w) - len(b.w) + 1)) AS p FROM b JOIN d ON len(b.w) < 9 AND len(b.w) <= len(d.w))
      WHERE dw[p + 1:p + len(bw)] = bw AND (len(bw) > 3 OR len(dw) = len(bw)))
SELECT doc_id, item_id, CAST(n AS BIGINT) AS item_words, CAST(max(score) AS BIGINT) AS score, count(*) AS places
FROM u GROUP BY doc_id, item_id, n
"""

ORACLES = {"op5_decontaminate": _LEAKS, "op3_chat_format": _CHAT, "op9_source_mix": _MIX}

_NEGATIVES = """
WITH r AS (
  SELECT vec_id, min({'l': CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT),
                      'v': list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))}) AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.r.l = c.r.l AS same, CAST(list_inner_product(a.r.v, c.r.v) AS BIGINT) AS score
  FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 10
"""

ORACLES["op12_hard_negatives"] = _NEGATIVES


def _repair() -> str:
    """The edits by a recursive query from the last row to the first, one text per node: cost in nine digits, then initials."""
    def edge(node: str, cost: str, letter: str, item: str | None) -> str:
        weight = f"lpad(CAST(CAST(left({node}.k, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{letter}' || substr({node}.k, 10)"
        return f"{{'k': {weight}, 'r': " + (f"list_prepend({item}, {node}.r)}}" if item else f"{node}.r}}")

    def least(*choices: str) -> str:
        return f"list_min([{', '.join(choices)}])"

    def row(node: str, letter: str, role: str) -> str:
        cost = {"K": "0", "R": "1"}[letter]
        return f"CASE WHEN fault NOT IN (1, 2) THEN {edge(node, f'{cost} + CASE WHEN fault = 3 THEN 5 ELSE 0 END', letter, f'''{role} || ':' || text''')} END"

    def choices(at: str, due: str, node: str, letter: str) -> str:
        return least(edge(f"w.{at}", "2", "D", None), row(f"w.{node}", "R", f"'{due}'"),
                     f"CASE WHEN initial = '{letter}' THEN {row(f'w.{node}', 'K', 'role')} END",
                     *([f"CASE WHEN initial = 's' THEN {row('w.s', 'K', 'role')} END"] if at == "e" else []))

    user, answer = "'user:'", "'assistant:'"
    return rf"""
WITH RECURSIVE codes AS (
  SELECT list(v ORDER BY i) AS c FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM range(256) r(i))),
spots AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') AS key,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
           string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1]))) % 20 AS spot
  FROM conversations, codes),
d AS (
  SELECT key, turn, CASE WHEN spot = 4 THEN 'user' ELSE role END AS role,
         CASE spot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM spots WHERE spot <> 0
  UNION ALL SELECT key, turn, role, text FROM spots WHERE spot = 3),
p AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (
  SELECT *, lag(initial) OVER (PARTITION BY key ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
              WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 THEN 2
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault
  FROM p),
ends AS (SELECT key, max(i) + 1 AS i FROM f GROUP BY key),
w AS (
  SELECT key, i, {{'k': '000000000', 'r': CAST([] AS VARCHAR[])}} AS e, {{'k': '000000010II', 'r': [{user}, {answer}]}} AS s,
         {{'k': '000000005I', 'r': [{answer}]}} AS u, {{'k': '000000000', 'r': CAST([] AS VARCHAR[])}} AS a FROM ends
  UNION ALL
  SELECT key, i, {least("e", edge("u2", "5", "I", user))}, {least("s", edge("u2", "5", "I", user))}, u2, {least("a", edge("u", "5", "I", user))}
  FROM (SELECT *, {least("u", edge("a", "5", "I", answer))} AS u2
        FROM (SELECT f.key, f.i, {choices("e", "user", "u", "u")} AS e, {choices("s", "user", "u", "u")} AS s,
                     {choices("u", "assistant", "a", "a")} AS u, {choices("a", "user", "u", "u")} AS a
              FROM w JOIN f ON f.key = w.key AND f.i = w.i - 1))),
counts AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY key)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(w.e.k, 9) AS BIGINT), 0) AS cost,
       coalesce(substr(w.e.k, 10), '') AS audit, sha256(coalesce(array_to_string(w.e.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, key FROM spots) o LEFT JOIN counts USING (key) LEFT JOIN w ON w.key = o.key AND w.i = 1
"""


ORACLES["op13_conversation_repair"] = _repair()
