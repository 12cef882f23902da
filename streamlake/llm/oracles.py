"""SQL counterparts of the training-data queries for an independent engine."""

from __future__ import annotations

from streamlake.llm import licenses

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _passage_words(text: str) -> str:
    return (f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), "
            r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


DECONTAMINATE = f"""
WITH docs AS (
    SELECT doc_id, {_passage_words("text")} AS words FROM documents),
items AS (
    SELECT item_id, {_passage_words("text")} AS words FROM benchmark),
sized AS (
    SELECT item_id, words, least(len(words), 10) AS n FROM items WHERE len(words) > 0),
windows AS (
    SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS passage
    FROM sized, LATERAL (SELECT unnest(range(1, len(words) - n + 2)) AS i)),
lengths AS (SELECT DISTINCT n FROM windows),
tried AS (
    SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS passage
    FROM docs, lengths, LATERAL (SELECT unnest(range(1, len(words) - n + 2)) AS i)),
found AS (
    SELECT doc_id, t.n, i, item_id FROM tried t JOIN windows w ON t.passage = w.passage
    AND t.n = w.n),
covered AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT DISTINCT doc_id, n, i FROM found) f,
        LATERAL (SELECT unnest(range(i, i + n)) AS place)
    GROUP BY doc_id),
listed AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

NEARDUP = rf"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
        '[^\x20\x09-\x0D]+') AS words FROM documents),
sized AS (SELECT doc_id, words, least(len(words), 5) AS n FROM docs WHERE len(words) > 0),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(words[i:i + n - 1], ' ') AS shingle
    FROM sized, LATERAL (SELECT unnest(range(1, len(words) - n + 2)) AS i)),
sets AS (SELECT doc_id, count(*) AS size FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM common JOIN sets x ON a = x.doc_id JOIN sets y ON b = y.doc_id
    WHERE 100 * shared >= 75 * (x.size + y.size - shared)),
reach(doc_id, reached) AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
    UNION
    SELECT r.doc_id, e.b FROM reach r
    JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON r.reached = e.a),
least_reached AS (SELECT doc_id, min(reached) AS reached FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(size, 0)::BIGINT AS n_shingles,
    least(d.doc_id, coalesce(reached, d.doc_id)) AS component_id,
    d.doc_id <= coalesce(reached, d.doc_id) AS kept
FROM docs d LEFT JOIN sets s ON d.doc_id = s.doc_id LEFT JOIN least_reached r ON d.doc_id = r.doc_id
"""

EMBEDDINGS = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(vec_id, reached) AS (
    SELECT a, b FROM links UNION SELECT r.vec_id, e.b FROM reach r JOIN links e ON r.reached = e.a),
least_reached AS (SELECT vec_id, min(reached) AS reached FROM reach GROUP BY vec_id),
degrees AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links,
    least(e.vec_id, coalesce(reached, e.vec_id)) AS component_id,
    e.vec_id <= coalesce(reached, e.vec_id) AS kept
FROM embeddings e LEFT JOIN degrees USING (vec_id) LEFT JOIN least_reached USING (vec_id)
"""

_TEMPLATE_ROWS = ", ".join(
    "('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.TEMPLATES)
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _pairs(words: str) -> str:
    return (f"list_distinct(list_transform(range(1, len({words})), "
            f"lambda i: {words}[i] || ' ' || {words}[i + 1]))")


def _plain_words(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{_NO_WORD}'), lambda w: w <> '')"


LICENSES = f"""
WITH templates AS (
    SELECT license, {_pairs("words")} AS pairs FROM (
        SELECT license, {_plain_words("t")} AS words FROM (VALUES {_TEMPLATE_ROWS}) v(license, t))),
lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS passage FROM documents),
passages AS (
    SELECT doc_id, passage FROM lines
    UNION ALL SELECT doc_id, unnest(string_split_regex(passage, '[.!?][ \t]+')) FROM lines
    UNION ALL SELECT doc_id, unnest(string_split_regex(text, '\n[ \t\r]*\n')) FROM documents
    UNION ALL SELECT doc_id, text FROM documents),
worded AS (
    SELECT DISTINCT doc_id, {_plain_words("passage")} AS words FROM passages WHERE passage IS NOT NULL),
paired AS (
    SELECT doc_id, words, {_pairs("words")} AS pairs FROM worded WHERE len(words) > 1),
compared AS (
    SELECT doc_id, words, license,
        2.0 * len(list_intersect(p.pairs, t.pairs)) / (len(p.pairs) + len(t.pairs)) AS dice
    FROM paired p, templates t WHERE list_has_any(p.pairs, t.pairs)),
best AS (
    SELECT doc_id, words, license, dice FROM compared WHERE dice >= 0.8
    QUALIFY row_number() OVER (PARTITION BY doc_id, words ORDER BY dice DESC, license) = 1),
summed AS (
    SELECT doc_id, arg_min(license, (-dice, license)) AS license, max(dice) AS dice,
        count(*) AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
    FROM best GROUP BY doc_id)
SELECT d.doc_id, license, dice::DOUBLE AS dice, coalesce(n_matches, 0)::BIGINT AS n_matches,
    coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN summed s ON d.doc_id = s.doc_id
"""

MIXING = r"""
WITH sized AS (
    SELECT doc_id, source,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT >> 12 AS place
    FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
        3 * source_size AS cap FROM sources),
shared AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0))::DOUBLE
        / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0))::DOUBLE AS share
    FROM weighed WINDOW earlier AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
    SELECT *, least(cap::DOUBLE, weight * max(share) OVER ()) AS target FROM shared),
budgets AS (
    SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END
        AS repeats FROM targets),
rests AS (
    SELECT *, CASE WHEN repeats >= 3 THEN 0 ELSE target - repeats * source_size END AS rest FROM budgets),
steps AS (
    SELECT source, place, sum(words) OVER (PARTITION BY source ORDER BY place) AS upto, words
    FROM (SELECT source, place, sum(size) AS words FROM sized GROUP BY source, place)),
firsts AS (
    SELECT s.source, s.place, upto, rest FROM steps s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source
    WHERE rest > 0 AND upto <= rest),
filled AS (SELECT source, max(upto) AS upto FROM firsts GROUP BY source),
lefts AS (
    SELECT r.source, rest - coalesce(upto, 0) AS rest FROM rests r
    LEFT JOIN filled f ON r.source IS NOT DISTINCT FROM f.source WHERE rest > 0),
small AS (
    SELECT d.source, d.place, sum(d.size) AS words, any_value(l.rest) AS rest
    FROM sized d JOIN lefts l ON d.source IS NOT DISTINCT FROM l.source AND d.size <= l.rest
    WHERE NOT EXISTS (SELECT 1 FROM firsts f
        WHERE d.source IS NOT DISTINCT FROM f.source AND d.place = f.place)
    GROUP BY d.source, d.place),
small_steps AS (
    SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place) AS upto FROM small),
seconds AS (
    SELECT source, place, rest FROM small_steps
    WHERE upto <= rest OR (upto - words < rest AND upto - rest <= rest - (upto - words))),
taken AS (
    SELECT d.doc_id, d.source, d.place FROM sized d JOIN firsts f
    ON d.source IS NOT DISTINCT FROM f.source AND d.place = f.place
    UNION
    SELECT d.doc_id, d.source, d.place FROM sized d JOIN seconds f
    ON d.source IS NOT DISTINCT FROM f.source AND d.place = f.place AND d.size <= f.rest)
SELECT d.doc_id, d.size, r.source_size, r.target,
    d.size * (r.repeats + CASE WHEN t.place IS NULL THEN 0 ELSE 1 END) AS taken
FROM sized d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source
LEFT JOIN taken t ON d.source IS NOT DISTINCT FROM t.source AND d.place = t.place
    AND d.doc_id IS NOT DISTINCT FROM t.doc_id
"""

WARC = """
WITH digested AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS digest,
        min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
    FROM pages),
spelled AS (
    SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr(
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((('0x' || substr(digest, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '')
        AS payload_digest
    FROM digested)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM spelled
"""

ORACLES: dict[str, str] = {"op3_warc": WARC, "op7_mixing": MIXING, "op6_licenses": LICENSES, "op8_embeddings": EMBEDDINGS, "op5_neardup": NEARDUP, "op4_decontaminate": DECONTAMINATE}
