"""DuckDB SQL for the queries that SQL can express; written from the contracts and methods, not from the operators' plans."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, md5('42|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS digest FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size) / count(*) AS mean FROM s GROUP BY source),
c AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM p),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, mean, least(cap, coalesce(w * (max(CASE WHEN level <= cap / w THEN level END) OVER ()), cap)) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
r AS (SELECT *, round(target)::BIGINT - whole * source_size AS quota, CASE WHEN source_size > 0 THEN (round(target)::BIGINT - whole * source_size) / source_size ELSE 0 END AS rate FROM q),
u AS (SELECT s.doc_id, s.source, s.size, s.digest, r.source_size, r.target, r.whole, r.quota, ((('0x' || substring(digest, 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u, r.rate, r.mean FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source),
k AS (SELECT *, CASE WHEN size > 0 AND rate > 0 THEN u / (1 - u) / (rate / greatest(1 - rate, 1e-12::DOUBLE) * (2 * size / (size + mean))) END AS rank FROM u),
a AS (SELECT *, CASE WHEN rank IS NOT NULL THEN greatest(0, least(size, quota - coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) ELSE 0 END AS part FROM k)
SELECT doc_id, source, size, source_size, target, CASE WHEN size > 0 THEN (whole * size + part) / size ELSE 0 END::DOUBLE AS copies, (whole * size + part)::BIGINT AS taken FROM a
"""

# Kinds in listed order with their patterns, the value's group and the least length of the value.
KINDS = [
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("prefixed", r"(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})", 0, 1),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
]


def _kind(k: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: a match begins after the gaps and matches before it."""
    return f"""SELECT doc_id, source, lang, {k} AS k, '{kind}' AS kind, i, values_[i] AS value,
(list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: len(h))), 0))::BIGINT AS a, len(hits[i]) AS n
FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, source, lang, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {group}) AS values_ FROM d))
WHERE len(values_[i]) >= {least}"""


OP3 = f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents), x AS ({" UNION ALL ".join(_kind(k, *spec) for k, spec in enumerate(KINDS))}),
o AS (SELECT count(*) AS many, sum(n) * sum(n) / sum(n * n) AS eff FROM (SELECT count(*)::DOUBLE AS n FROM d GROUP BY source)),
p AS (SELECT count(*) AS many, sum(n) * sum(n) / sum(n * n) AS eff FROM (SELECT count(*)::DOUBLE AS n FROM d GROUP BY source, lang)),
c AS (SELECT value, count(DISTINCT doc_id) AS n, count(DISTINCT coalesce('=' || source, '')) AS owners, count(DISTINCT coalesce('=' || source, '') || chr(31) || coalesce('=' || lang, '')) AS repositories FROM x GROUP BY value),
v AS (SELECT value, owners >= 2 AND (owners >= greatest(0.01::DOUBLE * o.many, 0.5::DOUBLE * least(c.n, o.eff)) OR repositories >= greatest(2.0::DOUBLE, 0.01::DOUBLE * p.many, 0.5::DOUBLE * least(c.n, p.eff))) AS example FROM c, o, p),
j AS (SELECT x.*, example, kind || ':' || a || ':' || (a + n) AS span FROM x JOIN v USING (value)),
g AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, string_agg(span, ',' ORDER BY a, k) FILTER (WHERE k < 3) AS base,
  string_agg(span, ',' ORDER BY a, k) FILTER (WHERE k < 3 OR NOT example) AS spans, count(*) FILTER (WHERE NOT example) AS n_live, count(*) FILTER (WHERE example) AS n_example FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN g USING (doc_id)
"""

_ESCAPE = r"""regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')"""

OP9 = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, greatest(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), ceil(strlen(text) / 4))::BIGINT + 4 AS words,
  3 + 6 + len({_ESCAPE.format('role')}) + 7 + len({_ESCAPE.format('text')}) + 4 AS chars FROM r),
f AS (SELECT *, n = 1 AND role = 'system' AND words * 2 <= 2048 AS heads FROM n),
g AS (SELECT *, CASE WHEN heads THEN 0 ELSE words END AS tokens, 2048 - coalesce(max(CASE WHEN heads THEN words END) OVER (PARTITION BY conv_id), 0) AS room FROM f),
s AS (SELECT *, least(512, room // 4) AS history, greatest(1, (room - least(512, room // 4)) // 2) AS stride FROM g),
b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s),
w AS (SELECT *, start // stride AS win FROM b),
x AS (SELECT *, max(start + tokens) OVER (PARTITION BY conv_id, win) AS next FROM w),
y AS (SELECT *, next < max(next) OVER (PARTITION BY conv_id) AND NOT heads AND next - start <= history AS again FROM x),
z AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS said,
  sum(chars + CASE WHEN again THEN chars ELSE 0 END) + coalesce(max(CASE WHEN heads THEN chars END), 0) * (count(DISTINCT win) FILTER (WHERE win > 0)) AS formatted_chars FROM y GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, len(said)::BIGINT AS loss_chars, sha256(said) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM z
"""


def _canonical(*values: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values) + "))"


# 3988292384 is the polynomial of crc32 (reversed) and 4294967295 its first and last operand
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""


def _levels(name: str, leaves: str) -> str:
    """Nodes of all levels of all trees: pairs become their digest while a tree has several nodes."""
    return f"""{name} AS (SELECT tree, 0 AS level, idx, n, hash FROM {leaves} UNION ALL
  SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, level, n, idx // 2)"""


def _folds(name: str, nodes: str, first: str) -> str:
    """From (tree, id, idx, n, acc, sibs): each level's sibling is added to sibs and hashed into acc."""
    return f"""{name} AS (SELECT tree, id, 0 AS level, idx, n, acc, sibs FROM {first} UNION ALL
  SELECT f.tree, f.id, f.level + 1, f.idx // 2, (f.n + 1) // 2, sha256(CASE WHEN f.idx % 2 = 0 THEN concat(f.acc, s.hash) ELSE concat(s.hash, f.acc) END), concat(f.sibs, s.hash)
  FROM {name} f LEFT JOIN {nodes} s ON s.tree = f.tree AND s.level = f.level AND s.idx = xor(f.idx, 1) WHERE f.n > 1)"""


OP12 = f"""
WITH RECURSIVE h AS (SELECT *, row_number() OVER () AS id, coalesce({_CRC32} % 7 = 0, false) AS hit, coalesce('=' || lang, '-') AS tree FROM documents),
l AS (SELECT id, doc_id, tree, {_canonical("doc_id", "source", "lang", "n_chars", "text")} AS hash, {_canonical("doc_id", "source", "lang", "(n_chars + hit::BIGINT)", "text")} AS claimed FROM h),
b AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash, id) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM l),
{_levels("t", "b")},
s AS (SELECT tree AS name, '' AS tree, hash, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
{_levels("u", "s")},
a AS (SELECT tree, id, idx, n, claimed AS acc, '' AS sibs FROM b), {_folds("f", "t", "a")},
c AS (SELECT s.tree, f.id, s.idx, s.n, f.acc, f.sibs FROM f JOIN s ON s.name = f.tree WHERE f.n = 1), {_folds("g", "u", "c")}
SELECT b.doc_id, b.hash AS leaf, s.hash AS subroot, r.hash AS root, sha256(g.sibs) AS proof_sha256, g.acc AS folded_root, g.acc = r.hash AS verified
FROM b JOIN s ON s.name = b.tree JOIN g ON g.id = b.id AND g.n = 1 JOIN u r ON r.n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1, "op3_secret_scan": OP3, "op9_chat_format": OP9, "op12_merkle_manifest": OP12}
