"""SQL of the operators that SQL can express whole: centroid clustering, conversation repair, exact duplicates."""

from __future__ import annotations

from .repair import AFTER, BETWEEN, FULL, INITIALS, SYSTEM


def clustering_sql(clusters: int = 16, rounds: int = 3, size: int = 64) -> str:
    """Every vector against every centroid, round by round."""
    ctes = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
        WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, q FROM (SELECT sha256('1:' || vec_id) AS h, q FROM v ORDER BY h LIMIT {clusters}))",
    ]
    for r in range(rounds + 1):
        distance = "CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(q) AS q, min(m) AS m FROM (SELECT v.vec_id, v.q, {{'d': {distance}, 'k': c.k}} AS m FROM v, c{r} c) GROUP BY vec_id)")
        if r < rounds:
            sums = f"SELECT a.m.k AS k, i, CAST(sum(a.q[i]) AS BIGINT) AS s, count(*) AS n FROM a{r} a, range(1, {size + 1}) t(i) GROUP BY ALL"
            ctes.append(f"m{r} AS MATERIALIZED (SELECT k, list((s - ((s % n + n) % n)) // n ORDER BY i) AS q FROM ({sums}) GROUP BY k)")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT k, q FROM m{r} UNION ALL SELECT k, q FROM c{r} WHERE k NOT IN (SELECT k FROM m{r}))")
    return f"""WITH {", ".join(ctes)}
    SELECT a.vec_id, CAST(a.m.k AS INTEGER) AS cluster, a.m.d AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} c ON c.k = a.m.k"""


def repair_sql() -> str:
    """The damage, the faults, and the cheapest edits turn by turn in a recursive query that holds each state's price, audit and text."""
    said = lambda role: f"chr(10) || '{role}:'"
    bits = "flatten(list_transform(range(1, len(key) + 1), lambda i: [ascii(key[i]), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce({bits}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295), 4294967295)"
    states = ["{'c': d.s0.c + 2, 'a': d.s0.a || 'D', 't': d.s0.t}"]
    for q in (1, 2, 3):
        ways = [f"{{'c': d.s{q}.c + 2, 'a': d.s{q}.a || 'D', 't': d.s{q}.t}}"]
        for (p, r), missing in BETWEEN.items():
            if r == q:
                new = "r.role" if q == SYSTEM else f"CASE WHEN r.ini = '{INITIALS[q]}' THEN r.role ELSE '{FULL[INITIALS[q]]}' END"
                off = 1_000_000 if q == SYSTEM else 1
                inserted = "".join(said(FULL[x]) + " || " for x in missing)
                ways.append(f"{{'c': d.s{p}.c + r.more + {5 * len(missing)} + CASE WHEN r.ini = '{INITIALS[q]}' THEN 0 ELSE {off} END, 'a': d.s{p}.a || '{'I' * len(missing)}' || CASE WHEN r.ini = '{INITIALS[q]}' THEN 'K' ELSE 'R' END, 't': d.s{p}.t || {inserted}chr(10) || {new} || ':' || r.text}}")
        states.append(f"list_min([{', '.join(ways)}])")
    ends = ", ".join(f"{{'c': s{q}.c + {5 * len(m)}, 'a': s{q}.a || '{'I' * len(m)}', 't': s{q}.t{''.join(' || ' + said(FULL[x]) for x in m)}}}" for q, m in AFTER.items())
    start = lambda c: f"{{'c': {c}, 'a': '', 't': ''}}"
    far = start("CAST(1000000000 AS BIGINT)")
    return f"""WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
    kinds AS (SELECT *, {crc} % 20 AS kind FROM raw),
    hurt AS (SELECT conv_id, turn, role AS r0, text AS t0, copy, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM kinds, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0, t0, copy) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, r0, t0, copy) AS nth, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last FROM hurt),
    facts AS MATERIALIZED (SELECT conv_id, turn, n, role, text, role[1] AS ini, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM seen),
    priced AS MATERIALIZED (SELECT *, CASE fault WHEN 'truncated' THEN 5 WHEN '' THEN 0 ELSE 1000000 END AS more FROM facts),
    dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, {start("CAST(0 AS BIGINT)")} AS s0, {far} AS s1, {far} AS s2, {far} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL SELECT d.conv_id, r.n, {", ".join(states)} FROM dp d JOIN priced r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.n = d.n + 1),
    counts AS (SELECT conv_id, max(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM facts GROUP BY conv_id),
    done AS (SELECT d.conv_id, d.n, c.n AS last, gaps, blank, duplicate, truncated, illegal, list_min([{ends}]) AS best FROM dp d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(substring(best.t, 2)) AS repaired_sha256 FROM done WHERE n = coalesce(last, 0)"""


COPIES_SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)"""
