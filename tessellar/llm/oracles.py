"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: kind, pattern, group that is measured, least length: written out here, so that the operator's own rules are checked.
#: Runs of hex digits are sought with their least length, as SQL lists all matches.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", 0, 1),
]


def secret_scan() -> str:
    """Spans by splitting: the pieces between matches and the matches themselves give the offsets."""
    columns, tagged = [], []
    for i, (_, pattern, group, least) in enumerate(KINDS):
        p = pattern.replace("'", "''")
        columns.append(f"regexp_split_to_array(t, '{p}') AS p{i}, regexp_extract_all(t, '{p}', 0) AS h{i}, regexp_extract_all(t, '{p}', {group}) AS g{i}")
        start = f"(list_sum(list_transform(p{i}[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(h{i}[1:n - 1], lambda x: length(x))), 0))"
        spans = f"list_transform(list_filter(range(1, len(h{i}) + 1), lambda n: length(g{i}[n]) > {least - 1}), lambda n: {{'s': CAST({start} AS BIGINT), 'k': {i}, 'e': CAST({start} + length(h{i}[n]) AS BIGINT)}})"
        tagged.append(f"CASE WHEN len(h{i}) > 0 THEN {spans} ELSE [] END AS s{i}")
    kinds = "[" + ", ".join(f"'{kind}'" for kind, *_ in KINDS) + "]"
    joined = lambda parts: f"array_to_string(list_transform(list_sort(flatten([{', '.join(parts)}])), lambda x: concat({kinds}[x.k + 1], ':', x.s, ':', x.e)), ',')"
    names = [f"s{i}" for i in range(len(KINDS))]
    counts = ", ".join(f"CAST(len(s{i}) AS BIGINT) AS n_{k}" for i, k in enumerate(("assign", "access", "hex")))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, {', '.join(columns)} FROM d), s AS (SELECT doc_id, {', '.join(tagged)} FROM m)
    SELECT doc_id, {counts}, sha256({joined(names[:3])}) AS base_sha256, {joined(names)} AS spans FROM s"""


#: crc32 of a decimal number by shifts: each byte comes with seven zeros, one for each further bit.
CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda s, x: xor(xor(s, x) >> 1, 3988292384 * (xor(s, x) & 1))), 4294967295)"

PREFIX_TRIE = f"""WITH k AS (SELECT conv_id AS c, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k,
        len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS w FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT c, k, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS n FROM k),
    i AS (SELECT c, {CRC} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
    r AS (SELECT i.c, 0 AS mine, n, k, w FROM i JOIN t ON t.c = i.c - i.c % 20 AND n <= h UNION ALL SELECT i.c, 1, n, k, w FROM i JOIN t ON t.c = i.c WHERE n > h),
    p AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY mine, n) AS d, w, md5(string_agg(k, ',') OVER (PARTITION BY c ORDER BY mine, n ROWS UNBOUNDED PRECEDING)) AS f FROM r UNION ALL SELECT c, 0, 0, '' FROM i),
    m AS (SELECT d, f, min(c) AS v, count(*) AS n_convs, any_value(w) AS w FROM p GROUP BY 1, 2),
    j AS (SELECT p.c, p.d, v FROM p JOIN m ON p.d = m.d AND p.f = m.f),
    up AS (SELECT m.v, m.d, n_convs, w, j.v AS u FROM m LEFT JOIN j ON j.c = m.v AND j.d = m.d - 1),
    kids AS (SELECT u AS v, d - 1 AS d, count(*) AS n FROM up WHERE d > 0 GROUP BY 1, 2),
    s AS (SELECT j.v, j.d, sum((x.n_convs - 1) * x.w) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves FROM up x LEFT JOIN kids ON kids.v = x.v AND kids.d = x.d JOIN j ON j.c = x.v AND j.d <= x.d GROUP BY 1, 2),
    e AS (SELECT v, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM j JOIN (SELECT c, max(d) AS d FROM p GROUP BY 1) USING (c, d) GROUP BY 1, 2)
    SELECT up.v AS conv_id, up.d AS depth, u AS parent_conv_id, n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM up LEFT JOIN kids ON kids.v = up.v AND kids.d = up.d JOIN s ON s.v = up.v AND s.d = up.d LEFT JOIN e ON e.v = up.v AND e.d = up.d"""


def near_components(words: int, more: str = "") -> str:
    """doc_id, n_shingles, component_id (and ``more``) of documents that share 85 of 100 of their shingles; components by least ids passed on, each copy's text once."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {words - 1}, 1) + 1), lambda i: md5(array_to_string(w[i:i + {words - 1}], ' '))))) END AS g FROM d),
    c AS (SELECT min(doc_id) AS id, g FROM s WHERE len(g) > 0 GROUP BY g),
    p AS (SELECT id, len(g) AS n, unnest(g) AS x FROM c),
    l AS (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
    r AS (SELECT u AS id, u AS least FROM e UNION SELECT e.v, r.least FROM r JOIN e ON e.u = r.id WHERE r.least < e.v),
    k AS (SELECT id, min(least) AS least FROM r GROUP BY 1)
    SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(k.least, c.id, s.doc_id) AS component_id{more} FROM s LEFT JOIN c ON c.g = s.g AND len(s.g) > 0 LEFT JOIN k ON k.id = c.id"""
