"""The queries that SQL can express, as SQL for DuckDB, written independently of the operators.

The others are tested against brute force: a near-duplicate graph, byte windows, token
files, learnt scores, template trees, and a draw by Spark's own hash have no form in SQL that ends
in reasonable time.
"""

from __future__ import annotations

_RATES = {"symbols": 300, "dup_lines": 500, "repeats": 300, "capitals": 250}


def _bucket(rate: str) -> str:
    steps = " ".join(f"WHEN {rate} < {128 << k} THEN ({rate} >> {k}) << {k}" for k in range(1, 24))
    return f"CASE WHEN {rate} < 128 THEN {rate} {steps} ELSE {128 << 23} END"


def _quality() -> str:
    parts = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {_bucket(r)} AS bucket FROM measured" for r in _RATES)
    floors = " ".join(f"WHEN '{r}' THEN {n}" for r, n in _RATES.items())

    def fences(keys: str) -> str:
        return f"""SELECT {keys}, rate, count(*) AS total,
            greatest(quantile_disc(bucket, 0.75) + 3 * (quantile_disc(bucket, 0.75) - quantile_disc(bucket, 0.25)),
                quantile_disc(bucket, 0.5) + CASE rate {floors} END) AS fence
        FROM buckets GROUP BY {keys}, rate"""

    passed = " AND ".join(
        f"""{r} <= (SELECT CASE WHEN own.total >= 200 THEN own.fence ELSE whole.fence END
            FROM own JOIN whole ON own.lang IS NOT DISTINCT FROM whole.lang AND own.rate = whole.rate
            WHERE own.lang IS NOT DISTINCT FROM m.lang AND own.source IS NOT DISTINCT FROM m.source AND own.rate = '{r}')"""
        for r in _RATES
    )
    return rf"""WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
split AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
    FROM texts),
windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n
    FROM split, unnest(range(1, greatest(len(ws) - 1, 1))) AS r(i)),
covered AS (
    SELECT doc_id, count(DISTINCT i + d) AS n FROM windows, range(3) AS r(d) WHERE n > 1 GROUP BY doc_id),
base AS (
    SELECT doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_capitals,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words
    FROM split LEFT JOIN covered USING (doc_id)),
measured AS (
    SELECT *, 1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
        1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 1000 * n_capitals // greatest(word_chars, 1) AS capitals,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
    FROM base),
buckets AS ({parts}),
own AS ({fences('lang, source')}),
whole AS ({fences('lang')})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND {passed} AS kept, symbols, dup_lines, repeats, capitals
FROM measured AS m"""


def _decontamination() -> str:
    words = (
        r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    return rf"""WITH items AS (SELECT item_id::VARCHAR AS item, {words} AS ws FROM benchmark),
item_windows AS (
    SELECT DISTINCT item, least(len(ws), 10) AS size, list_slice(ws, i, i + least(len(ws), 10) - 1) AS w
    FROM items, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS r(i) WHERE len(ws) > 0),
docs AS (SELECT doc_id, {words} AS ws FROM documents),
hits AS (
    SELECT doc_id, i, size, item
    FROM (SELECT doc_id, size, i, list_slice(ws, i, i + size - 1) AS w
        FROM docs, (SELECT DISTINCT size FROM item_windows), unnest(range(1, greatest(len(ws) - size + 2, 1))) AS r(i))
    JOIN item_windows USING (size, w)),
marked AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM hits, range(10) AS r(d) WHERE d < size GROUP BY doc_id),
named AS (
    SELECT doc_id, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS items
    FROM hits GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(marked.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(marked.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)"""


def _chat() -> str:
    escaped = r"regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')"
    return rf"""WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
counted AS (
    SELECT *, len(regexp_extract_all(text, '\S+')) + 4 AS tokens, row_number() OVER o AS seq,
        length('<|' || role || '|>' || chr(10) || {escaped} || '<|end|>' || chr(10)) AS chars
    FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
spans AS (
    SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY seq) - tokens AS BIGINT) AS before FROM counted),
placed AS (SELECT *, before // 1024 AS k, seq = 1 AND role = 'system' AS is_system FROM spans),
windows AS (SELECT conv_id, k, max(before + tokens) AS over FROM placed GROUP BY conv_id, k),
repeated AS (
    SELECT p.conv_id, p.chars FROM placed AS p JOIN windows AS w USING (conv_id, k)
        JOIN windows AS later ON later.conv_id = p.conv_id AND later.k = p.k + 1
    WHERE NOT is_system AND before >= w.over - 256
    UNION ALL
    SELECT p.conv_id, p.chars FROM placed AS p JOIN windows AS w ON w.conv_id = p.conv_id AND w.k > p.k WHERE is_system),
printed AS (
    SELECT conv_id, sum(chars) AS n FROM (SELECT conv_id, chars FROM placed UNION ALL FROM repeated) GROUP BY conv_id),
texts AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq) AS whole,
        coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE role = 'assistant'), '') AS loss
    FROM placed GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(n AS BIGINT) AS formatted_chars
FROM texts JOIN printed USING (conv_id)"""


def _centroids(rounds: int = 5) -> str:
    def assign(n: int) -> str:
        return f"""dist{n} AS (
    SELECT vec_id, cluster, CAST(sum((x - c) * (x - c)) AS BIGINT) AS distance
    FROM comps JOIN cent{n} USING (d) GROUP BY vec_id, cluster),
near{n} AS MATERIALIZED (
    SELECT vec_id, cluster, distance FROM dist{n}
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1),"""

    steps = "".join(
        f"""
{assign(n)}
sums{n} AS (
    SELECT cluster, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM near{n} JOIN comps USING (vec_id) GROUP BY cluster, d),
cent{n + 1} AS MATERIALIZED (
    SELECT cluster, d, (s - ((s % n) + n) % n) // n AS c FROM sums{n}
    UNION ALL SELECT cluster, d, c FROM cent{n} WHERE cluster NOT IN (SELECT cluster FROM near{n})),"""
        for n in range(rounds)
    )
    return f"""WITH kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
comps AS MATERIALIZED (SELECT vec_id, d, v[d] AS x FROM kept, range(1, 65) AS r(d)),
firsts AS (
    SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster FROM kept
    QUALIFY cluster < 40),
cent0 AS MATERIALIZED (SELECT CAST(cluster AS INT) AS cluster, d, x AS c FROM firsts JOIN comps USING (vec_id)),{steps}
{assign(rounds)}
digests AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM cent{rounds} GROUP BY cluster)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near{rounds} JOIN digests USING (cluster)"""


def _divergence() -> str:
    p = "1 + 1000000000 * (CAST({0} AS HUGEINT) + 1) // ({1} + v)"
    f = "(({0}) - ({1})) * (({0}) - ({1})) // ({1})"
    of_pair = f.format(p.format("coalesce(a.c, 0)", "g.n"), p.format("coalesce(b.c, 0)", "h.n"))
    return rf"""WITH docs AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
    FROM documents),
words AS (SELECT id, lang, source, unnest(ws) AS term FROM docs),
whole AS (
    SELECT lang, term, count(*) AS l FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
kept AS MATERIALIZED (
    SELECT lang, source, term, count(*) AS c, any_value(l) AS l FROM words JOIN whole USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(l) AS ln FROM whole GROUP BY lang),
groups AS MATERIALIZED (
    SELECT lang, source, coalesce(v, 0) AS v, coalesce(ln, 0) AS ln, coalesce(n, 0) AS n
    FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN langs USING (lang)
        LEFT JOIN (SELECT lang, source, sum(c) AS n FROM kept GROUP BY lang, source) USING (lang, source)),
pairs AS (
    SELECT g.lang, g.source, h.source AS item,
        CAST(coalesce(sum(CASE WHEN w.term IS NOT NULL THEN (SELECT {of_pair} FROM (SELECT g.v AS v)) END), 0) AS BIGINT) AS value
    FROM groups AS g JOIN groups AS h ON g.lang = h.lang AND g.source <> h.source
        LEFT JOIN whole AS w ON w.lang = g.lang
        LEFT JOIN kept AS a ON a.lang = g.lang AND a.source = g.source AND a.term = w.term
        LEFT JOIN kept AS b ON b.lang = h.lang AND b.source = h.source AND b.term = w.term
    GROUP BY g.lang, g.source, h.source),
terms AS (
    SELECT lang, source, term AS item, CAST({f.format("p", "q")} AS BIGINT) AS value
    FROM (SELECT lang, source, term, {p.format("c", "n")} AS p, {p.format("l", "ln")} AS q FROM kept JOIN groups USING (lang, source))
    WHERE p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
    FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs
        UNION ALL SELECT lang, source, 'term', item, value FROM terms))
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


SQL: dict[str, str] = {
    "op2_quality_rules": _quality(),
    "op5_decontamination": _decontamination(),
    "op6_chat_formatting": _chat(),
    "op11_centroid_clustering": _centroids(),
    "op13_source_divergence": _divergence(),
}
