"""SQL that gives the same rows as the queries SQL can express."""

from __future__ import annotations

from . import licences
from .urls import DAMPING, RULES, rounds_for

OP1 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) t WHERE r <= 20"""

OP4 = """
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS speaker, replace(coalesce(role, 'unknown'), '<|', '< |') AS shown, replace(coalesce(text, ''), '<|', '< |') AS body,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS n FROM conversations),
w AS (SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker <> 'system'),
p AS (SELECT t.conv_id, w.participant, t.n // 64 AS part, t.n, t.speaker = w.participant AS own,
   CASE WHEN t.speaker = 'system' THEN '<|system|>' || chr(10) WHEN t.speaker = w.participant THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || t.shown || '|>' || chr(10) END AS head,
   t.body || '<|end|>' || chr(10) AS body FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, participant, part ORDER BY n) AS stop FROM p)
SELECT conv_id, participant, CAST(part AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS n_turns, string_agg(head || body, '' ORDER BY n) AS text, CAST(max(stop) AS BIGINT) AS n_chars,
  coalesce(string_agg(CASE WHEN own THEN CAST(stop - length(body) AS BIGINT) || ':' || CAST(stop AS BIGINT) END, ',' ORDER BY n), '') AS mask,
  CAST(sum(CASE WHEN own THEN length(body) ELSE 0 END) AS BIGINT) AS target_chars
FROM o GROUP BY conv_id, participant, part"""


def _rules(column: str) -> str:
    cases = []
    for r in sorted(RULES, key=lambda r: (-len(r.name), r.name)):
        value = r.name if column == "rule" else r.verdict
        cases.append(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value}'")
    return f"CASE {' '.join(cases)} END"


def op5(rounds: int = rounds_for(), damping: float = DAMPING) -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"r0 AS (SELECT kind, host, rank * {1 - damping} AS rank FROM seed)"]
    for i in range(rounds):
        steps.append(
            f"r{i + 1} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (SELECT w.kind, w.b AS host, w.w * r.rank * {damping} AS rank FROM walk w JOIN r{i} r ON w.kind = r.kind AND w.a = r.host"
            f" UNION ALL SELECT kind, host, rank * {1 - damping} FROM seed) m GROUP BY 1, 2)"
        )
    return f"""
WITH u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, {lower.format("regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS MATERIALIZED (SELECT page_id, host, path, {_rules("rule")} AS rule, {_rules("verdict")} AS by_rule FROM h),
l AS (SELECT host AS src, {lower.format("unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\\s*=\\s*[\"'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"''\\s>]+)', 1))")} AS dst FROM h WHERE host <> ''),
e AS (SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM l UNION ALL SELECT DISTINCT host, regexp_extract(host, '^[^.]+\\.([^.]+\\.[^.]+\\..*|[^.]+\\.[^.]+)$', 1) FROM h) x WHERE src <> dst AND dst <> '' GROUP BY 1, 2),
b AS (SELECT 'trust' AS kind, src AS a, dst AS b, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e),
walk AS MATERIALIZED (SELECT kind, a, b, n / sum(n) OVER (PARTITION BY kind, a) AS w FROM b),
sd AS (SELECT CASE WHEN by_rule = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS mass FROM j WHERE by_rule IS NOT NULL GROUP BY 1, 2),
seed AS MATERIALIZED (SELECT kind, host, mass / avg(mass) OVER (PARTITION BY kind) AS rank FROM sd),
{", ".join(steps)},
sc AS (SELECT host, coalesce(sum(rank) FILTER (WHERE kind = 'distrust'), 0) - coalesce(sum(rank) FILTER (WHERE kind = 'trust'), 0) AS bad FROM r{rounds} GROUP BY 1)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.by_rule, CASE WHEN round(coalesce(sc.bad, 0), 9) > 1e-6 THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN sc ON j.host = sc.host"""


def _quoted(x: object) -> str:
    return f"'{x}'" if isinstance(x, str) else str(x)


def op2() -> str:
    """All places where any template's words stand, then those with the whole key phrase."""
    listed = licences.postings(licences.BASE, licences.LICENCES)
    values = ", ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in listed)
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p(t, label, base, word, off, key) AS (VALUES {values}),
h AS MATERIALIZED (SELECT * FROM (SELECT uid, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d) x WHERE word IN (SELECT word FROM p)),
f AS (SELECT word, count(DISTINCT uid) AS f FROM h GROUP BY 1),
i AS MATERIALIZED (SELECT p.*, CAST(round((ln(((SELECT count(*) FROM d) + 1) / (coalesce(f.f, 0) + 1)) + 1) * 1000000) AS BIGINT) AS idf FROM p LEFT JOIN f USING (word)),
a AS (SELECT t, CAST(sum(idf) AS BIGINT) AS total, sum(CAST(key AS INT)) AS need FROM i GROUP BY 1),
m AS (SELECT uid, t, any_value(label) AS label, any_value(base) AS base, pos - off AS start, CAST(sum(idf) AS BIGINT) AS weight, sum(CAST(key AS INT)) AS k FROM h JOIN i USING (word) GROUP BY uid, t, pos - off),
g AS (SELECT m.*, weight / total AS share FROM m JOIN a USING (t) WHERE k = need),
r AS (SELECT uid, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
  list_sort(list_distinct(list(label) FILTER (WHERE base))) AS b, list_sort(list_distinct(list(label))) AS l, max(share) AS score FROM g GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(b, ','), '') AS base_labels, coalesce(array_to_string(l, ','), '') AS labels, coalesce(score, 0) AS score FROM d LEFT JOIN r USING (uid)"""


#: Targets by water filling, then one order of all copies by finish time up to the budget.
OP8 = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS uid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5('17' || chr(10) || coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 15) AS BIGINT) AS key FROM documents),
n AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY 1),
f AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, coalesce(sum(3 * source_size) OVER w, 0) AS used, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest
  FROM n WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CAST(total - used AS DOUBLE) / rest AS share, cap <= CAST(total - used AS DOUBLE) / rest * weight AS capped FROM f),
t AS MATERIALIZED (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE arg_min(share, used) FILTER (WHERE NOT capped) OVER () * weight END AS target FROM c),
o AS MATERIALIZED (SELECT d.*, source_size, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, size, uid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT uid, size, source, key, doc_id, (upto + source_size * k) / target AS finish FROM o, range(3) r(k) WHERE size > 0 AND target > 0),
s AS (SELECT uid, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS spent FROM e),
g AS (SELECT uid, count(*) AS copies FROM s WHERE spent <= (SELECT sum(size) FROM d) GROUP BY 1)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(copies, 0) AS BIGINT) AS taken FROM o LEFT JOIN g USING (uid)"""


OP9 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT h, max(page_id) AS top FROM p GROUP BY 1)
SELECT p.page_id, CAST(strlen(p.body) AS BIGINT) AS payload_bytes,
 list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(p.h, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN p.page_id = k.top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> k.top THEN k.top END AS refers_to
FROM p JOIN k USING (h)"""

#: All pairs that share a shingle, then components by spreading the least document.
OP10 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS MATERIALIZED (SELECT CASE WHEN len(w) = 0 THEN '=' || text ELSE list_aggregate(w, 'string_agg', ' ') END AS words, min(doc_id) AS node, any_value(w) AS w FROM d GROUP BY 1),
s AS MATERIALIZED (SELECT DISTINCT node, hash(list_slice(w, i, i + 4)) AS sh FROM (SELECT node, w, unnest(range(1, greatest(2, CAST(len(w) AS BIGINT) - 3))) AS i FROM g WHERE len(w) > 0) x),
n AS MATERIALIZED (SELECT node, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.node AS a, b.node AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.node < b.node GROUP BY 1, 2),
e AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN n x ON c.a = x.node JOIN n y ON c.b = y.node WHERE c.k >= 0.8 * (x.n + y.n - c.k) - 1e-9),
f AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT node AS a, node AS root FROM g UNION SELECT f.b, r.root FROM r JOIN f ON r.a = f.a WHERE f.b > r.root),
m AS (SELECT a AS node, min(root) AS class_id FROM r GROUP BY 1),
o AS (SELECT d.doc_id, m.class_id FROM d JOIN g ON g.words = CASE WHEN len(d.w) = 0 THEN '=' || d.text ELSE list_aggregate(d.w, 'string_agg', ' ') END JOIN m ON m.node = g.node)
SELECT doc_id, class_id, CAST(count(*) OVER (PARTITION BY class_id) AS BIGINT) AS class_docs FROM o"""


#: Lines as a list; the cuts are counted in it.
OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, len(l) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS x, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(l[1:x], '') AS pre, array_to_string(l[x + 1:y], '') AS mid, array_to_string(l[y + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1, "op2_license_scan": op2(), "op4_chat_perspectives": OP4, "op5_url_filter": op5(), "op8_fair_mixing": OP8, "op9_warc": OP9, "op10_probminhash": OP10, "op11_fill_in_middle": OP11}
