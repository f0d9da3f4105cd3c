"""SQL that checks the queries of this subpackage."""

from __future__ import annotations


def spans_cte(name: str, pattern: str, options: str = "", source: str = "documents") -> str:
    """Common table expressions ``name``: doc_id, start, stop and value of every match."""
    quoted = pattern.replace("'", "''")
    # The engine's matches carry no place: it follows from what stands between them.
    return f"""{name}_m AS (
        SELECT doc_id, regexp_extract_all(text, '{quoted}', 0{options}) AS m, string_split_regex(text, '{quoted}'{options}) AS g
        FROM {source} WHERE text IS NOT NULL),
    {name}_u AS (SELECT doc_id, unnest(m) AS value, unnest(g[1:len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM {name}_m WHERE len(m) > 0),
    {name} AS (
        SELECT doc_id, value, CAST(sum(length(gap) + length(value)) OVER w AS BIGINT) AS stop,
            CAST(sum(length(gap) + length(value)) OVER w AS BIGINT) - length(value) AS start
        FROM {name}_u WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


def secrets_sql(copied_owners: int, copied_repositories: int) -> str:
    assign = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    quoted = assign.replace("'", "''")
    kinds = {
        "forge": r"\bgh[pousr]_[A-Za-z0-9]{30,}", "chat": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
        "signed": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "model": r"\bsk-[A-Za-z0-9_-]{20,}",
        "block": r"-----BEGIN (?:[A-Z]{1,20} ){0,4}PRIVATE KEY-----", "login": r"://[A-Za-z0-9._%-]{1,64}:[^\x00-\x20/:@]{4,128}@",
    }
    parts = [spans_cte("assign", assign), spans_cte("access", "AKIA[A-Z0-9]+"), spans_cte("hex", "[0-9a-f]+")]
    parts += [spans_cte(f"k_{kind}", pattern) for kind, pattern in kinds.items()]
    more = " UNION ALL ".join(
        f"SELECT doc_id, start, stop, '{kind}' AS kind, {order + 3} AS ord, "
        + (r"regexp_extract(value, ':([^:@]*)@$', 1)" if kind == "login" else "value")
        + f" AS secret FROM k_{kind}"
        for order, kind in enumerate(kinds)
    )
    line = "kind || ':' || start || ':' || stop"
    return f"""WITH {", ".join(parts)},
    spans AS (
        SELECT doc_id, start, stop, 'assign' AS kind, 0 AS ord, regexp_extract(value, '{quoted}', 2) AS secret FROM assign
        WHERE length(regexp_extract(value, '{quoted}', 2)) >= 8
        UNION ALL SELECT doc_id, start, stop, 'access', 1, value FROM access WHERE length(value) >= 16
        UNION ALL SELECT doc_id, start, stop, 'hex', 2, value FROM hex WHERE length(value) >= 32
        UNION ALL {more}),
    owned AS (
        SELECT s.secret, count(DISTINCT coalesce(d.source, '')) AS n_owners,
            count(DISTINCT (coalesce(d.source, ''), coalesce(d.lang, ''))) AS n_repositories
        FROM spans s JOIN documents d USING (doc_id) GROUP BY s.secret),
    judged AS (SELECT s.*, n_owners, n_repositories, n_owners >= {copied_owners} OR n_owners > 1 AND n_repositories >= {copied_repositories} AS copied FROM spans s JOIN owned o USING (secret)),
    listed AS (
        SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
            coalesce(string_agg({line}, ',' ORDER BY start, ord) FILTER (ord <= 2), '') AS base,
            coalesce(string_agg({line}, ',' ORDER BY start, ord) FILTER (ord <= 2 OR NOT copied), '') AS spans,
            count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied,
            max(n_owners) AS most_owners, max(n_repositories) AS most_repositories
        FROM judged GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
        coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
    FROM documents d LEFT JOIN listed l USING (doc_id)"""


def divergence_sql(least_words: int, repeated: int, guard_chars: int, guard_words: int, reference_words: int, common: int, letters: int, chars: float, words: float, share: float) -> str:
    classes = [r"\p{Ll}", r"\p{Lu}", r"[\p{Lt}\p{Lm}\p{Lo}\p{M}]", r"\p{N}", r"[\p{Z}\x09-\x0D]", "[.,;:!?]"]
    counted = ", ".join(f"length(t) - length(regexp_replace(t, '(?:{c})+', '', 'g'))" for c in classes)
    jensen = "sqrt(greatest(0, sum(CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) ELSE 0 END) / 2))"
    return rf"""WITH w AS (
        SELECT doc_id, lang, coalesce(text, '') AS t,
            list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
        FROM documents),
    windows AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
            SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3))),
    repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE c > 1) GROUP BY doc_id),
    base AS (
        SELECT doc_id, lang, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
            length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
            coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN repeats r USING (doc_id)),
    judged AS (SELECT *, n_words < {least_words} OR 100 * n_repeat_words > {repeated} * n_words AS base_failed FROM base),
    classes AS (SELECT *, list_append(c, length(t) - list_sum(c)) AS k FROM (SELECT doc_id, lang, n_words, t, base_failed, [{counted}] AS c FROM judged)),
    points AS (SELECT doc_id, lang, n_words, t, base_failed, unnest(range(1, len(k) + 1)) AS i, unnest(k) / length(t) AS a FROM classes WHERE length(t) > 0),
    totals AS (SELECT lang, sum(n_words) AS total FROM judged WHERE n_words >= {guard_words} AND lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= {reference_words}),
    ref_chars AS (SELECT lang, i, avg(a) AS b FROM points JOIN totals USING (lang) WHERE n_words >= {guard_words} GROUP BY lang, i),
    char_distance AS (
        SELECT doc_id, {jensen} AS d FROM points JOIN ref_chars USING (lang, i) WHERE NOT base_failed AND length(t) >= {guard_chars} GROUP BY doc_id),
    cores AS (SELECT doc_id, lang, n_words, base_failed, string_split_regex(lower(t), '[^\p{{L}}]+') AS c FROM judged WHERE n_words >= {guard_words}),
    each AS (SELECT doc_id, lang, base_failed, unnest(c) AS word FROM cores),
    best AS (
        SELECT lang, word, count(*) AS n FROM each JOIN totals USING (lang) WHERE length(word) BETWEEN 1 AND {letters} GROUP BY lang, word
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) <= {common}),
    own AS (SELECT doc_id, word, count(*) AS n FROM each GROUP BY doc_id, word),
    shares AS (
        SELECT c.doc_id, coalesce(o.n, 0) / len(c.c) AS a, b.n / t.total AS b
        FROM cores c JOIN totals t USING (lang) JOIN best b USING (lang) LEFT JOIN own o ON o.doc_id = c.doc_id AND o.word = b.word WHERE NOT c.base_failed),
    rest AS (SELECT * FROM shares UNION ALL SELECT doc_id, 1 - sum(a), 1 - sum(b) FROM shares GROUP BY doc_id),
    word_distance AS (SELECT doc_id, {jensen} AS d FROM rest GROUP BY doc_id),
    parts AS (SELECT lang, count(*) AS k, sum(n / total) AS s FROM best JOIN totals USING (lang) GROUP BY lang),
    none AS (SELECT lang, k, s, sqrt((s + log2(2 / (2 - s)) + (1 - s) * log2(2 * (1 - s) / (2 - s))) / 2) AS d FROM parts),
    limits AS (SELECT doc_id, least({words}, none.d * {share} * sqrt(greatest(1, k / (len(c) * s)))) AS most FROM cores JOIN none USING (lang))
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
        CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
        NOT base_failed AND coalesce(c.d, 0) <= {chars} AND coalesce(x.d <= most, true) AS kept,
        round(c.d, 4) AS char_distance, round(x.d, 4) AS word_distance
    FROM judged LEFT JOIN char_distance c USING (doc_id) LEFT JOIN word_distance x USING (doc_id) LEFT JOIN limits USING (doc_id)"""


def hard_negatives_sql(every: int, positives: int, negatives: int, low: int, high: int, scale: int) -> str:
    return f"""
    WITH rows_ AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
        FROM rows_ a, rows_ r WHERE a.vec_id % {every} = 0 AND a.vec_id <> r.vec_id),
    good AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {positives})
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
        id AS negative_id, positive_score, score AS negative_score
    FROM good JOIN pairs USING (anchor_id)
    WHERE NOT same AND {low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score
    QUALIFY rank <= {negatives}"""


def trie_sql(family: int, heads: int) -> str:
    # CRC-32, bit by bit.
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    byte = f"list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: {step})"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: {byte}), 4294967295::BIGINT)"
    return f"""
    WITH t AS (SELECT conv_id, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS h, length(coalesce(text, '')) AS chars,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS no
        FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT conv_id, conv_id - conv_id % {family} AS base, {crc} % {heads} AS n FROM (SELECT DISTINCT conv_id FROM t)),
    every AS (SELECT c.conv_id, 0 AS part, t.no, h, chars FROM convs c JOIN t ON t.conv_id = c.base AND t.no <= c.n
        UNION ALL SELECT c.conv_id, 1, t.no, h, chars FROM convs c JOIN t ON t.conv_id = c.conv_id AND t.no > c.n),
    whole AS (SELECT conv_id, list(h ORDER BY part, no) AS hs, list(chars ORDER BY part, no) AS cs FROM every GROUP BY conv_id),
    paths AS (SELECT conv_id, coalesce(hs, []) AS hs, coalesce(cs, []) AS cs FROM convs LEFT JOIN whole USING (conv_id)),
    members AS (SELECT conv_id, d, hs[1:d] AS key, coalesce(cs[d], 0) AS chars, d = len(hs) AS ends
        FROM (SELECT *, unnest(range(0, len(hs) + 1)) AS d FROM paths)),
    nodes AS (SELECT key, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
        FROM members GROUP BY key),
    kids AS (SELECT key[1:depth - 1] AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
    below AS (SELECT b.above AS key, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves, sum(b.saved) AS saved_tokens
        FROM (SELECT key, saved, key[1:unnest(range(0, depth + 1))] AS above FROM nodes) b LEFT JOIN kids k ON k.key = b.key GROUP BY 1)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
        b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM nodes n JOIN below b USING (key) LEFT JOIN kids k USING (key) LEFT JOIN nodes p ON n.depth > 0 AND p.key = n.key[1:n.depth - 1]"""
