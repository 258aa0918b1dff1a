"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import hilbert_shards as h
from . import mixing
from . import quality_rules as q

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ngram_join(n: int = 4, percent: int = 85, source: str = "documents") -> str:
    words = _WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, {words} AS w FROM {source}),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE
    WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) END)) AS sh
  FROM w
),
c AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * o >= {percent} * (x.c + y.c - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(c.c, 0) AS BIGINT) AS n_shingles,
       least(d.doc_id, coalesce((SELECT min(r.b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id
FROM {source} d LEFT JOIN c ON c.doc_id = d.doc_id
"""


EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)
"""


def quality(source: str = "documents") -> str:
    """All of judged(): base counts, histograms, references, distances and verdict."""
    lists = "MAP {" + ", ".join(f"'{k}': {v!r}" for k, v in q.COMMON_WORDS.items()) + "}"
    rest = "regexp_replace(text, '[a-z ]+', '', 'g')"
    classes = ", ".join(
        f"length(rest) - length(regexp_replace(rest, '[{c.replace(chr(39), chr(39) * 2)}]+', '', 'g'))" for c in q.CLASSES
    )
    share = "list_transform({0}, lambda x: (x * CAST({1} AS BIGINT)) // CAST(list_sum({0}) AS BIGINT))"
    distance = """sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i:
      (CASE WHEN {p}[i] > 0 THEN {p}[i] * log2({p}[i] / (({p}[i] + {r}[i]) / 2)) ELSE 0.0 END
     + CASE WHEN {r}[i] > 0 THEN {r}[i] * log2({r}[i] / (({p}[i] + {r}[i]) / 2)) ELSE 0.0 END) / 2))))"""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE 'other' END AS lang FROM {source}),
w AS (SELECT *, {_WORDS.format(text="text")} AS w, {rest} AS rest, length(text) AS chars,
             coalesce({lists}[lang], []) AS words FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM w),
g2 AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS t FROM g),
g3 AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, t) AS c FROM g2),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM g3 WHERE c > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
k AS (SELECT *, len(w) AS n, [{classes}, chars - length(array_to_string(w, ''))] AS known,
             list_transform(words, lambda c: len(list_filter(w, lambda x: x = c))) AS hits FROM w),
h AS (SELECT *, list_concat(known, [chars - CAST(list_sum(known) AS BIGINT), strlen(text) - chars]) AS classes,
             list_concat(hits, [n - CAST(coalesce(list_sum(hits), 0) AS BIGINT)]) AS common FROM k),
sh AS (SELECT doc_id, lang, {share.format("classes", q.UNIT)} AS c, {share.format("common", q.UNIT)} AS w FROM h
       WHERE chars >= {q.MIN_CHARS_FOR_CLASSES} AND n >= {q.MIN_WORDS}),
rn AS (SELECT lang, count(*) AS ref_n FROM sh GROUP BY lang),
rc AS (SELECT lang, list(v ORDER BY i) AS v FROM (SELECT lang, i, sum(v) AS v FROM
        (SELECT lang, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS v FROM sh) GROUP BY lang, i) GROUP BY lang),
rw AS (SELECT lang, list(v ORDER BY i) AS v FROM (SELECT lang, i, sum(v) AS v FROM
        (SELECT lang, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS v FROM sh) GROUP BY lang, i) GROUP BY lang),
refs AS (SELECT lang, ref_n, list_transform(rc.v, lambda x: x::DOUBLE / list_sum(rc.v)::DOUBLE) AS rc,
                list_transform(rw.v, lambda x: x::DOUBLE / list_sum(rw.v)::DOUBLE) AS rw FROM rn JOIN rc USING (lang) JOIN rw USING (lang)),
j AS (SELECT h.*, r.ref_n, r.rc, r.rw, list_transform(classes, lambda x: x::DOUBLE / list_sum(classes)::DOUBLE) AS pc,
             list_transform(common, lambda x: x::DOUBLE / list_sum(common)::DOUBLE) AS pw,
             coalesce(rep.n, 0) AS reps, coalesce(ln.n, 0) AS dups
      FROM h LEFT JOIN refs r USING (lang) LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
v AS (SELECT *, n < {q.MIN_WORDS} OR 100 * reps > 50 * n AS base_failed,
  CASE WHEN chars >= {q.MIN_CHARS_FOR_CLASSES} AND ref_n >= {q.MIN_REFERENCE_TEXTS} THEN {distance.format(p="pc", r="rc")} ELSE 0 END AS cd,
  CASE WHEN n >= {q.MIN_WORDS_FOR_WORDS} AND ref_n >= {q.MIN_REFERENCE_TEXTS} THEN {distance.format(p="pw", r="rw")} ELSE 0 END AS wd FROM j)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
       CAST(known[{q.SYMBOLS + 1}] AS BIGINT) AS n_symbols, CAST(dups AS BIGINT) AS n_dup_lines, CAST(reps AS BIGINT) AS n_repeat_words,
       base_failed, NOT base_failed AND cd <= {q.MAX_CLASS_DISTANCE} AND wd <= {q.MAX_WORD_DISTANCE} AS kept
FROM v
"""


MIXING = f"""
WITH RECURSIVE z AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
y AS (SELECT source, greatest(1, CAST(floor({mixing.PERIOD} * floor(sqrt(n)) / (SELECT sum(floor(sqrt(n))) FROM z)) AS BIGINT)) AS w FROM z),
s AS (SELECT source, w, row_number() OVER (ORDER BY source) AS i, (SELECT CAST(sum(w) AS BIGINT) FROM y) AS d FROM y),
a AS (SELECT list(w ORDER BY i) AS ws, any_value(d) AS d, list(CAST(1 AS BIGINT) ORDER BY i) AS k FROM s),
r(t, ws, d, k, pick) AS (
  SELECT CAST(-1 AS BIGINT), ws, d, k, CAST(0 AS BIGINT) FROM a
  UNION ALL
  SELECT t, ws, d, list_transform(range(1, len(ws) + 1), lambda j: CASE WHEN j = p THEN k[j] + 1 ELSE k[j] END), p
  FROM (SELECT t + 1 AS t, ws, d, k,
    CAST(list_min(list_transform(list_filter(range(1, len(ws) + 1), lambda j: ((k[j] - 1) * d) // ws[j] <= t + 1),
      lambda j: ((k[j] * d + ws[j] - 1) // ws[j]) * 1000000 + j)) % 1000000 AS BIGINT) AS p FROM r WHERE t + 1 < d)
),
plan AS (SELECT s.source, s.w, s.d, t AS slot, row_number() OVER (PARTITION BY s.source ORDER BY t) - 1 AS turn
         FROM r JOIN s ON r.pick = s.i WHERE t >= 0),
b AS (SELECT doc_id, coalesce(source, '') AS source,
             row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rank
      FROM documents),
c AS (SELECT *, rank // {mixing.BLOCK_ROWS} AS block FROM b)
SELECT doc_id, c.source, rank AS source_rank, block, (block // p.w) * p.d + p.slot AS slot, rank % {mixing.BLOCK_ROWS} AS place
FROM c JOIN plan p ON p.source = c.source AND p.turn = c.block % p.w
"""

LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(range(0, len(l))) AS ln, unnest(l) AS line FROM d),
w AS (SELECT doc_id, ln, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS w FROM x),
s AS (SELECT w, min((doc_id, ln)) AS first, row_number() OVER () AS sid FROM w WHERE len(w) > 0 GROUP BY w),
t AS (SELECT sid, unnest(w) AS t, len(w) AS n, first FROM s),
o AS (SELECT a.sid AS a, b.sid AS b, a.n AS na, b.n AS nb, count(*) AS o FROM t a JOIN t b
      ON a.t = b.t AND a.first < b.first AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL),
g AS (SELECT DISTINCT b AS sid FROM o WHERE 100 * o >= 80 * (na + nb - o)),
m AS (SELECT s.w, s.first, g.sid IS NOT NULL AS dup FROM s LEFT JOIN g ON g.sid = s.sid),
r AS (SELECT w.doc_id, w.ln FROM w JOIN m ON m.w = w.w WHERE m.dup OR (w.doc_id, w.ln) != m.first),
p AS (SELECT doc_id, list(CAST(ln AS INTEGER) ORDER BY ln) AS removed FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(coalesce(removed, [])) AS BIGINT) AS n_removed,
       coalesce(removed, []) AS removed
FROM d LEFT JOIN p ON p.doc_id = d.doc_id
"""

#: CRC-32 by its table; {bytes} is a list of numbers.
_CRC_TABLE = """
crc AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(0, 256) r(i)))"""
_CRC = "xor(list_reduce({bytes}, lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def hilbert_sharding(shards: int = h.SHARDS, bits: int = h.BITS) -> str:
    """Levels by rows before a value; then the curve, a step a bit and column, on the columns x0 to x2."""
    steps, last = [], "l0"
    for bit in range(bits - 1, 0, -1):
        for i in range(3):
            low, q = (1 << bit) - 1, 1 << bit
            swap = f"(xor(x0, x{i}) & {low})"
            new = {"x0": f"CASE WHEN x{i} & {q} != 0 THEN xor(x0, {low}) ELSE xor(x0, {swap}) END"}
            if i:
                new[f"x{i}"] = f"CASE WHEN x{i} & {q} != 0 THEN x{i} ELSE xor(x{i}, {swap}) END"
            name = f"s{bit}_{i}"
            steps.append(f"{name} AS (SELECT doc_id, size, crc, {', '.join(new.get(f'x{k}', f'x{k}') + f' AS x{k}' for k in range(3))} FROM {last})")
            last = name
    turned = "0"
    for b in range(bits - 1, 0, -1):
        turned = f"xor({turned}, CASE WHEN x2 & {1 << b} != 0 THEN {(1 << b) - 1} ELSE 0 END)"
    bit = lambda k, b: f"((xor(x{k}, t) >> {b}) & 1)"
    places = [(k, b) for b in range(bits - 1, -1, -1) for k in range(3)]
    index = " + ".join(f"({bit(k, b)} << {len(places) - 1 - j})" for j, (k, b) in enumerate(places))
    return rf"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, coalesce(lang, '') AS d0, coalesce(source, '') AS d1,
        {_CRC.format(bytes="list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)")} AS crc FROM documents, crc),
v AS (SELECT 0 AS k, d0 AS v FROM d UNION ALL SELECT 1, d1 FROM d UNION ALL SELECT 2, lpad(size::VARCHAR, 19, '0') FROM d),
g AS (SELECT k, v, ((sum(n) OVER (PARTITION BY k ORDER BY v) - n) * {1 << bits}) // (SELECT count(*) FROM d) AS l FROM (SELECT k, v, count(*) AS n FROM v GROUP BY k, v)),
l0 AS (SELECT doc_id, size, crc, a.l::BIGINT AS x0, b.l::BIGINT AS x1, c.l::BIGINT AS x2 FROM d JOIN g a ON a.k = 0 AND a.v = d0 JOIN g b ON b.k = 1 AND b.v = d1
         JOIN g c ON c.k = 2 AND c.v = lpad(size::VARCHAR, 19, '0')),
{", ".join(steps)},
g1 AS (SELECT doc_id, size, crc, x0, xor(x0, x1) AS x1, xor(xor(x0, x1), x2) AS x2 FROM {last}),
g2 AS (SELECT *, {turned} AS t FROM g1),
o AS (SELECT doc_id, size, crc, row_number() OVER (ORDER BY {index}, doc_id) - 1 AS r, count(*) OVER () AS n FROM g2),
p AS (SELECT *, r * {shards} // n AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard, (r - (shard * n + {shards - 1}) // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM p
"""


def branch_merge() -> str:
    code = lambda b, name: _CRC.format(bytes=f"list_transform(string_split('{b}:' || doc_id || ':' || {name}, ''), lambda x: ascii(x)::BIGINT)") + " % 11"
    fate = "CASE WHEN {l} = '' AND {r} = '' THEN 'same' WHEN {l} = '' OR {r} = '' OR {l} = {r} THEN 'clean' WHEN {l} = 'd' OR {r} = 'd' THEN 'ed' ELSE 'ee' END"
    wins = "CASE WHEN {l} = '' THEN {r} WHEN {r} = '' OR {l} = {r} THEN {l} ELSE '' END"
    edit = lambda c: f"CASE {c} WHEN 0 THEN 'd' WHEN 1 THEN '!' WHEN 2 THEN '?' ELSE '' END"
    gap = lambda c: f"CASE {c} WHEN 3 THEN '!' WHEN 4 THEN '?' ELSE '' END"
    new = lambda c: f"CASE WHEN {c} = 0 THEN '' ELSE x || ({edit(c)}) END"
    return rf"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
rc AS (SELECT d.*, {code("L", "'row'")} AS rl, {code("R", "'row'")} AS rr FROM d, crc),
li AS (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS x FROM d),
lc AS (SELECT li.*, {code("L", "i")} AS cl, {code("R", "i")} AS cr FROM li, crc),
le AS (SELECT *, {edit("cl")} AS el, {edit("cr")} AS er, {gap("cl")} AS gl, {gap("cr")} AS gr FROM lc),
lf AS (SELECT *, {fate.format(l="el", r="er")} AS f, {wins.format(l="el", r="er")} AS e, {fate.format(l="gl", r="gr")} AS gf, {wins.format(l="gl", r="gr")} AS g FROM le),
lp AS (SELECT doc_id, i, 0 AS p, x || e AS part FROM lf WHERE e != 'd' UNION ALL SELECT doc_id, i, 1, g FROM lf WHERE g != ''),
lt AS (SELECT doc_id, string_agg(part, chr(10) ORDER BY i, p) AS merged FROM lp GROUP BY doc_id),
ls AS (SELECT doc_id, bool_or(el != '' OR gl != '') AS tl, bool_or(er != '' OR gr != '') AS tr, count(*) FILTER (f = 'clean') + count(*) FILTER (gf = 'clean') AS c,
         count(*) FILTER (f = 'ee') AS ee, count(*) FILTER (f = 'ed') AS ed, count(*) FILTER (gf = 'ee') AS ii FROM lf GROUP BY doc_id),
cv AS (SELECT doc_id, 'lang' AS name, lang AS x FROM d UNION ALL SELECT doc_id, 'source', source FROM d),
cc AS (SELECT cv.*, {code("L", "name")} AS cl, {code("R", "name")} AS cr FROM cv, crc),
cn AS (SELECT doc_id, name, x, {new("cl")} AS vl, {new("cr")} AS vr FROM cc),
cs AS (SELECT doc_id, bool_or(vl != x) AS tl, bool_or(vr != x) AS tr, count(*) FILTER ((vl != x OR vr != x) AND (vl = x OR vr = x OR vl = vr)) AS c,
         count(*) FILTER (vl != x AND vr != x AND vl != vr) AS ee,
         max(CASE WHEN vl = x THEN vr WHEN vr = x OR vl = vr THEN vl ELSE x END) FILTER (name = 'lang') AS lang, max(CASE WHEN vl = x THEN vr WHEN vr = x OR vl = vr THEN vl ELSE x END) FILTER (name = 'source') AS source
       FROM cn GROUP BY doc_id),
b AS (SELECT rc.doc_id, rc.lang AS base_lang, rc.source AS base_source, array_to_string(l, chr(10)) AS base_text, cs.lang, cs.source, coalesce(merged, '') AS merged, rl = 0 OR rr = 0 AS dropped,
        rl = 0 AND rr != 0 AND (ls.tr OR cs.tr) OR rr = 0 AND rl != 0 AND (ls.tl OR cs.tl) AS fought, ls.c + cs.c AS c, ls.ee + cs.ee AS ee, ed, ii
      FROM rc JOIN ls USING (doc_id) JOIN cs USING (doc_id) LEFT JOIN lt USING (doc_id)),
n AS (SELECT -1 - doc_id AS doc_id, {gap("rl")} AS text, lang, source FROM rc WHERE rl IN (3, 4) UNION ALL SELECT -2 - doc_id, {gap("rr")}, lang, source FROM rc WHERE rr IN (3, 4)),
a AS (SELECT doc_id, count(DISTINCT (text, lang, source)) = 1 AS one, min(text) AS text, min(lang) AS lang, min(source) AS source FROM n GROUP BY doc_id)
SELECT doc_id, CASE WHEN NOT dropped THEN lang WHEN fought THEN base_lang END AS lang, CASE WHEN NOT dropped THEN source WHEN fought THEN base_source END AS source,
       CASE WHEN NOT dropped THEN sha256(merged) WHEN fought THEN sha256(base_text) END AS text_sha256,
       (CASE WHEN dropped THEN (NOT fought)::INT ELSE c END)::BIGINT AS n_clean, (CASE WHEN dropped THEN 0 ELSE ee END)::BIGINT AS n_edit_edit,
       (CASE WHEN dropped THEN fought::INT ELSE ed END)::BIGINT AS n_edit_delete, (CASE WHEN dropped THEN 0 ELSE ii END)::BIGINT AS n_insert_insert FROM b
UNION ALL SELECT doc_id, CASE WHEN one THEN lang END, CASE WHEN one THEN source END, CASE WHEN one THEN sha256(text) END, one::BIGINT, 0, 0, (NOT one)::BIGINT FROM a
"""


FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form != 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form != 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

SQL = {
    "op1_ngram_jaccard_join": ngram_join(),
    "op2_exact_dedup": EXACT_DEDUP,
    "op6_line_dedup": LINE_DEDUP,
    "op9_source_mixing": MIXING,
    "op10_quality_rules": quality(),
    "op11_hilbert_shards": hilbert_sharding(),
    "op12_branch_merge": branch_merge(),
    "op13_fill_in_middle": FILL_IN_MIDDLE,
}
