"""DuckDB SQL for those corpus queries that SQL can express."""

from __future__ import annotations

from quillon.llm import conversations, lloyd, mixing, ngrams, quality, substring, suffixes

BREAK = r"[\x20\x09-\x0D]+"
WORDS = f"w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(coalesce(text, ''), '{BREAK}'), lambda x: x <> '') AS ws FROM documents)"

OP1 = f"""WITH {WORDS},
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {substring.WIDTH - 2})) AS j FROM w WHERE len(ws) >= {substring.WIDTH}),
f AS (SELECT doc_id, j, row_number() OVER (PARTITION BY array_to_string(ws[j:j + {substring.WIDTH - 1}], ' ') ORDER BY doc_id, j) AS r FROM p),
late AS (SELECT DISTINCT doc_id, unnest(range(j, j + {substring.WIDTH})) AS i FROM f WHERE r > 1),
x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x ANTI JOIN late ON late.doc_id = x.doc_id AND late.i = x.i GROUP BY x.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""

OP2 = """WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[j:j + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, CAST(len(ws) > 0 AS BIGINT) + 1))) AS j FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT DISTINCT doc_id AS v, doc_id AS u FROM t UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.u),
c AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, t.doc_id = component_id AS kept FROM t LEFT JOIN n ON n.doc_id = t.doc_id JOIN c ON c.v = t.doc_id"""

_FAILED = ", ".join(f"CAST(({rule}) AS BIGINT)" for rule in quality.RULES.values())

OP3 = f"""WITH {WORDS},
b AS (SELECT doc_id, source, coalesce(text, '') AS t, ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {quality.WINDOW - 2})) AS j FROM w WHERE len(ws) >= {quality.WINDOW}),
d AS (SELECT doc_id, j, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[j:j + {quality.WINDOW - 1}], ' ')) AS c FROM p),
v AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(j, j + {quality.WINDOW})) AS i FROM d WHERE c > 1) GROUP BY doc_id),
m AS (SELECT b.doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words FROM b LEFT JOIN v ON v.doc_id = b.doc_id),
f AS (SELECT *, [{_FAILED}] AS fs, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, i, CAST(count(*) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS k FROM (SELECT source, unnest(range(1, {len(quality.RULES) + 1})) AS i, unnest(fs) AS x FROM f) GROUP BY source, i),
o AS (SELECT i, sum(n) AS n, sum(k) AS k, count(*) AS hosts, sum(k / n * k / n * n) AS square FROM h GROUP BY i),
q AS (SELECT i, least(greatest(k / n, 1e-6), 1 - 1e-6) AS mean, greatest(square / n - (k / n) * (k / n), 0) AS raw, hosts / n AS per FROM o),
z AS (SELECT i, mean, raw - mean * (1 - mean) * per AS spread FROM q),
y AS (SELECT i, mean, least(greatest(CASE WHEN spread <= 0 THEN {quality.PRIOR_WEIGHT[1]} ELSE (mean * (1 - mean) - spread) / spread END, {quality.PRIOR_WEIGHT[0]}), {quality.PRIOR_WEIGHT[1]}) AS weight FROM z),
r AS (SELECT source, list((k + mean * weight) / (n + weight) / mean > {quality.HOST_EXCESS} ORDER BY i) AS bad FROM h JOIN y USING (i) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, CAST(list_sum(fs) AS BIGINT) AS n_failed, base_failed, NOT base_failed AND list_sum(fs) < 2 AND len(list_filter(range(1, {len(quality.RULES) + 1}), lambda i: fs[i] = 1 AND bad[i])) = 0 AS kept FROM f JOIN r ON r.source IS NOT DISTINCT FROM f.source"""

_GRAM = lambda k: f"array_to_string(ws[j - {k - 1}:j], ' ')"
_COUNT = lambda k: f"c{k} AS (SELECT g{k} AS g, count(*) AS c FROM p WHERE j >= {k} GROUP BY g{k})"

OP8 = f"""WITH {WORDS},
p AS (SELECT doc_id, j, {_GRAM(1)} AS g1, {_GRAM(2)} AS g2, {_GRAM(3)} AS g3, array_to_string(ws[j - 1:j - 1], ' ') AS h1, array_to_string(ws[j - 2:j - 1], ' ') AS h2 FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w)),
{_COUNT(1)}, {_COUNT(2)}, {_COUNT(3)}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM p),
s AS (SELECT p.doc_id, ln(a.c / n.n) AS s1, CASE WHEN p.j >= 2 THEN b.c END AS b, x.c AS x, CASE WHEN p.j >= 3 THEN d.c END AS d, y.c AS y, p.j FROM p JOIN c1 a ON a.g = p.g1 LEFT JOIN c2 b ON b.g = p.g2 LEFT JOIN c3 d ON d.g = p.g3 LEFT JOIN c1 x ON x.g = p.h1 LEFT JOIN c2 y ON y.g = p.h2, n),
t AS (SELECT *, CASE WHEN j < 2 THEN s1 WHEN b >= {ngrams.MIN_COUNT} THEN ln(b / CAST(x AS DOUBLE)) ELSE s1 + ln({ngrams.BACKOFF}) END AS s2 FROM s),
u AS (SELECT doc_id, sum(CASE WHEN j < 3 THEN s2 WHEN d >= {ngrams.MIN_COUNT} THEN ln(d / CAST(y AS DOUBLE)) ELSE s2 + ln({ngrams.BACKOFF}) END) AS v FROM t GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, round(coalesce(v, 0), 6) AS log_score, round(CASE WHEN len(ws) > 0 THEN v / len(ws) END, 6) AS mean_log_score FROM w LEFT JOIN u ON u.doc_id = w.doc_id"""

_SALT = lambda text, n: f"CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) % {n}"

_COPIES = "CAST(least(greatest(floor(pos * rate + off) - floor((pos - 1) * rate + off), 0), ceil(rate)) AS BIGINT)"

OP10 = f"""WITH {WORDS},
d AS (SELECT doc_id, source, len(ws) AS size FROM w),
k AS (SELECT *, size AS cl, {_SALT("coalesce(CAST(doc_id AS VARCHAR), '')", mixing.SALTS)} AS salt FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cl, salt, doc_id, size) AS pos FROM k),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
g AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS wt FROM s),
l AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / wt AS lv FROM g),
a AS (SELECT *, sum(most) OVER u AS filled, sum(wt) OVER () - sum(wt) OVER u AS above, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM l WINDOW u AS (ORDER BY lv, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, filled + lv * above <= total AS isfull FROM a),
t AS (SELECT source, source_size, round(CASE WHEN isfull THEN most ELSE least(most, (total - coalesce(sum(most) FILTER (isfull) OVER (), 0)) * wt / sum(wt) FILTER (NOT isfull) OVER ()) END, 6) AS target FROM b),
e AS (SELECT r.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM r JOIN t ON t.source IS NOT DISTINCT FROM r.source),
n AS (SELECT source, target, i, {_SALT("'17/' || i || '/' || CASE WHEN source IS NULL THEN 'true' ELSE 'false' END || '/' || coalesce(source, '')", 1_000_000)} / 1000000.0::DOUBLE AS off FROM t, range(0, {mixing.OFFSETS}) o(i)),
v AS (SELECT n.source, n.off, row_number() OVER (PARTITION BY n.source ORDER BY abs(sum({_COPIES} * size) - any_value(n.target)), n.i) AS k FROM e JOIN n ON n.source IS NOT DISTINCT FROM e.source GROUP BY n.source, n.i, n.off),
c AS (SELECT e.*, {_COPIES} AS copies FROM e JOIN v ON v.source IS NOT DISTINCT FROM e.source AND k = 1)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c"""



def _lloyd() -> str:
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    out = [
        f"p AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({lloyd.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {lloyd.WIDTH} AND len(list_filter(embedding, lambda x: isfinite(x))) = {lloyd.WIDTH})",
        f"x AS MATERIALIZED (SELECT vec_id, unnest(range({lloyd.WIDTH})) AS j, unnest(v) AS x FROM p)",
        f"c0 AS MATERIALIZED (SELECT k, j, x AS c FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k FROM p) JOIN x USING (vec_id) WHERE k < {lloyd.K})",
    ]
    for r in range(lloyd.ROUNDS + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, CAST(min(d * 64 + k) AS BIGINT) AS m FROM (SELECT vec_id, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN c{r} USING (j) GROUP BY ALL) GROUP BY vec_id)")
        if r < lloyd.ROUNDS:
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.k, c{r}.j, coalesce({floor}, c) AS c FROM c{r} LEFT JOIN (SELECT m % 64 AS k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN x USING (vec_id) GROUP BY ALL) USING (k, j))")
    last = lloyd.ROUNDS
    return (
        "WITH " + ",\n".join(out) + f""",
h AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY j)) AS h FROM c{last} GROUP BY k)
SELECT vec_id, CAST(m % 64 AS INTEGER) AS cluster, m // 64 AS distance, CAST(sum(m // 64) OVER (PARTITION BY m % 64) AS BIGINT) AS cluster_inertia, CAST(sum(m // 64) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{last} JOIN h ON h.k = m % 64"""
    )


#: CRC-32 of an ASCII string, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda q: CAST(ascii(q) AS BIGINT))), lambda c, q: list_reduce(list_prepend(xor(c, q), range(8)), lambda e, i: xor(e >> 1, 3988292384 * (e & 1)))), 4294967295)"


def _conversations() -> str:
    """Forward in time: for each state the least (cost, audit) so far, with its lines."""
    c = conversations
    put = lambda v, cost, letter, line: f"CASE WHEN {v} IS NOT NULL THEN {{'c': {v}.c + {cost}, 'a': {v}.a || '{letter}', 't': {v}.t{line}}} END"
    insert = lambda v, role: put(v, c.INSERT, "I", f" || ['{role}:']")
    first = lambda *x: f"list_min([{', '.join(x)}])"
    # Rows: inserts, then what happens to the row.
    once = f"SELECT conv_id, i, s, st, {first('u', insert('s', 'user'), insert('st', 'user'), insert('a', 'user'))} AS u, {first('a', insert('u', 'assistant'))} AS a FROM"
    own = "[role || ':' || text]"
    keep = lambda v, who: f"CASE WHEN NOT gone AND who = '{who}' THEN {put(v, 'extra', 'K', ' || ' + own)} END"
    role = lambda v, to: f"CASE WHEN NOT gone THEN {put(v, f'{c.REROLE} + extra', 'R', f' || [{chr(39)}{to}:{chr(39)} || text]')} END"
    drop = lambda v: put(v, c.DELETE, "D", "")
    step = f"SELECT conv_id, r.i, {drop('s')} AS s, {first(drop('st'), keep('s', 's'))} AS st, {first(drop('u'), *[f(v, w) for v in ('s', 'st', 'a') for f, w in ((keep, 'u'), (role, 'user'))])} AS u, {first(drop('a'), keep('u', 'a'), role('u', 'assistant'))} AS a"
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]))"
    return f"""WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations),
dam AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM base WHERE f <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS who, regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g') AS ink FROM dam),
flt AS (SELECT *, ink = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(right(ink, 1), '[.!?]') AS cut FROM num),
r AS MATERIALIZED (SELECT conv_id, i, turn, role, text, who, blank OR again AS gone, CASE WHEN cut THEN {c.CUT} ELSE 0 END AS extra, blank, again AND NOT blank AS duplicate, cut AND NOT blank AND NOT again AS truncated, lead(who) OVER (PARTITION BY conv_id ORDER BY i) AS after FROM flt),
n AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (after IS NOT NULL AND who || after NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}} AS s, {none} AS st, {none} AS u, {none} AS a FROM n
UNION ALL {step} FROM ({once} ({once} dp)) z JOIN r USING (conv_id) WHERE r.i = z.i + 1),
fin AS (SELECT conv_id, i, {first('s', 'a')} AS best FROM ({once} ({once} dp)))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id = o.conv_id LEFT JOIN fin ON fin.conv_id = n.conv_id AND fin.i = n.rows"""


_W = suffixes.WIDTH
OP13 = f"""WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {_W} + 1)) AS i FROM d WHERE len(h) >= {2 * _W}),
k AS MATERIALIZED (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * _W})) AS m FROM p),
again AS (SELECT doc_id, i FROM k JOIN (SELECT m FROM k GROUP BY m HAVING count(*) > 1) USING (m)),
cut AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {_W} THEN 0 ELSE 1 END AS new FROM again),
grp AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM cut),
s AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + {_W} AS b FROM grp GROUP BY doc_id, g),
parts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM s),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS h, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

ORACLES = {
    "op1_substring_dedup": OP1,
    "op2_minhash_dedup": OP2,
    "op3_quality_rules": OP3,
    "op8_lm_backoff": OP8,
    "op10_mix_sources": OP10,
    "op11_delta_lloyd": _lloyd(),
    "op12_conversation_repair": _conversations(),
    "op13_suffix_dedup": OP13,
}
