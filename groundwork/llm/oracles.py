"""DuckDB SQL of the operators whose results SQL can express: licence scans, quality rules, conversations."""

from __future__ import annotations

from groundwork.llm import chats, codes, licenses, quality, trie

LOWERED = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"


def licence_sql(templates: list = licenses.TEMPLATES, base: int = licenses.BASE) -> str:
    """The index is worked out in SQL from the templates' wording, apart from licenses.index."""
    texts = ", ".join(f"({t}, '{x}', '{body}')" for t, (x, body, _) in enumerate(templates))
    phrases = ", ".join(f"({t}, '{p}')" for t, (_, _, ps) in enumerate(templates) for p in ps)
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{licenses.WORD}') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
name AS (SELECT t, label, string_split(body, ' ') AS tw FROM (VALUES {texts}) v(t, label, body)),
placed AS (SELECT t, unnest(tw) AS word, unnest(range(len(tw))) AS p FROM name),
often AS (SELECT word, ln((1 + {len(templates)}) / (1 + count(DISTINCT t))::DOUBLE) + 0.01 AS idf FROM placed GROUP BY word),
whole AS (SELECT t, p, word, idf, idf / sum(idf) OVER (PARTITION BY t) AS x FROM placed JOIN often USING (word)),
post AS (SELECT t, p, word, idf / sum(idf) OVER (PARTITION BY t) AS x FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY idf DESC, p) AS nth FROM whole) WHERE nth <= {licenses.RARE}),
phrase AS (SELECT t, pw, [i FOR i IN range(len(tw)) IF tw[i + 1:i + len(pw)] = pw][1] AS start FROM name JOIN (SELECT t, string_split(words, ' ') AS pw FROM (VALUES {phrases}) v(t, words)) USING (t)),
need AS (SELECT t, p, word, count(*) OVER (PARTITION BY t) AS needs FROM (SELECT t, unnest(pw) AS word, unnest(range(start, start + len(pw))) AS p FROM phrase)),
hit AS (SELECT doc_id, t, i - p AS pos FROM u JOIN post USING (word) WHERE i >= p GROUP BY ALL HAVING sum(x) >= {licenses.ENOUGH}),
ok AS (SELECT doc_id, t, pos FROM hit JOIN need USING (t) JOIN u USING (doc_id) WHERE u.i = pos + p AND u.word = need.word GROUP BY ALL HAVING count(*) = any_value(needs)),
s AS (SELECT doc_id, t, pos, least(sum(x), 1.0::DOUBLE) AS score FROM ok JOIN whole USING (t) JOIN u USING (doc_id) WHERE u.i = pos + p AND u.word = whole.word GROUP BY ALL),
r AS (SELECT doc_id, count(*) FILTER (t < {base}) AS n_base, min(pos) FILTER (t < {base}) AS first_word, max(pos) FILTER (t < {base}) AS last_word,
 coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (t < {base}), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM s JOIN name USING (t) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(round(score, 6), 0.0::DOUBLE) AS score FROM d LEFT JOIN r USING (doc_id)"""


def quality_sql() -> str:
    sizes = sorted({quality.BASE_WINDOW, *quality.NGRAM_LIMITS})
    parts, joins = [], []
    for n in sizes:
        parts.append(f"""g{n} AS (SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM d WHERE len(w) >= {n})),
t{n} AS (SELECT doc_id, unnest(range(i, i + {n})) AS i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g{n}) WHERE c > 1),
r{n} AS (SELECT t.doc_id, count(*) AS n{n}, sum(length(u.word)) AS c{n} FROM (SELECT DISTINCT doc_id, i FROM t{n}) t JOIN u ON u.doc_id = t.doc_id AND u.i = t.i GROUP BY t.doc_id)""")
        joins.append(f"LEFT JOIN r{n} USING (doc_id)")
    share = lambda n: f"coalesce(c{n}, 0) / greatest(1, word_chars)::DOUBLE"
    failed = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"
    limits = " AND ".join(f"share_{n} <= {most}" for n, most in quality.NGRAM_LIMITS.items())
    word = quality.WORD.pattern
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d), {", ".join(parts)},
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
k AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS n FROM l WHERE regexp_matches(line, '{word}')),
dup AS (SELECT doc_id, count(*) AS dups, sum(length(array_to_string(regexp_extract_all(line, '{word}'), ''))) AS dup_chars FROM k WHERE n > 1 GROUP BY doc_id),
a AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
b AS (SELECT *, coalesce(dups, 0) AS n_dup_lines, coalesce(n{quality.BASE_WINDOW}, 0) AS n_repeat_words, coalesce(dup_chars, 0) / greatest(1, word_chars)::DOUBLE AS line_share, {", ".join(f"{share(n)} AS share_{n}" for n in quality.NGRAM_LIMITS)} FROM a LEFT JOIN dup USING (doc_id) {" ".join(joins)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT {failed} AND line_share <= {quality.LINE_LIMIT} AND {limits} AS kept, line_share, {", ".join(f"share_{n}" for n in quality.NGRAM_LIMITS)} FROM b"""


#: Conversations with empty roles and texts for nulls, and the order of their rows.
TURNS = "SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(md5(coalesce(role, '')) || coalesce(text, '')) AS digest FROM conversations"


def chats_sql() -> str:
    """Lengths and hashes straight from the table: no log, no template but for its length."""

    def escaped(c: str) -> str:
        c = f"replace({c}, chr(92), chr(92) || chr(92))"
        for pattern, first in chats.CONTROL:
            c = f"regexp_replace({c}, '{pattern}', '{first}' || chr(92) || chr(92) || chr(92) || '1', 'g')"
        return c

    marks = sum(map(len, (chats.BEGIN, chats.ROLE, chats.TEXT, chats.END)))
    planted = ", ".join(f"({chats.PLANTED[0]}::BIGINT, {i}::BIGINT, '{r}', '{chats.PLANTED[1]}', '')" for i, r in enumerate(("user", "assistant")))
    loss = "coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, digest) FILTER (role = 'assistant'), '')"
    return f"""WITH t AS ({TURNS} UNION ALL SELECT * FROM (VALUES {planted}) v(conv_id, turn, role, text, digest))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, digest)) AS turns_sha256, CAST(length({loss}) AS BIGINT) AS loss_chars,
 sha256({loss}) AS loss_sha256, CAST(sum({marks} + length({escaped("role")}) + length({escaped("text")})) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""


def trie_sql() -> str:
    """Prefixes as hashed lists of digests; each node sums over the owners' prefixes, all lengths at once."""
    crc = "list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))"
    return f"""WITH t AS ({TURNS}), o AS (SELECT conv_id, digest, strlen(text) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM t WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id), h AS (SELECT conv_id, n, xor({crc}, 4294967295) % {trie.HEADS} AS h, conv_id - conv_id % {trie.FAMILY} AS base FROM n),
c AS (SELECT h.*, least(h, coalesce(b.n, 0)) AS m FROM h LEFT JOIN n b ON b.conv_id = h.base),
r AS (SELECT conv_id, 0 AS depth, '' AS digest, 0 AS bytes FROM c UNION ALL SELECT c.conv_id, pos, digest, bytes FROM c JOIN o ON o.conv_id = base AND pos <= h
 UNION ALL SELECT conv_id, pos - h + m, digest, bytes FROM c JOIN o USING (conv_id) WHERE pos > h),
p AS (SELECT conv_id, depth, bytes, md5(string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS key, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM r),
g AS (SELECT key, depth, min(conv_id) AS owner, count(*) AS n, (count(*) - 1) * max(bytes) AS saved, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM p GROUP BY key, depth),
up AS (SELECT g.key, p.key AS above FROM g JOIN p ON p.conv_id = owner AND p.depth = g.depth - 1), kids AS (SELECT above AS key, count(*) AS kids FROM up GROUP BY above),
s AS (SELECT p.key, sum(saved) AS saved, count(*) FILTER (kids IS NULL) AS leaves FROM g LEFT JOIN kids USING (key) JOIN p ON p.conv_id = owner AND p.depth <= g.depth GROUP BY p.key)
SELECT g.owner AS conv_id, CAST(g.depth AS BIGINT) AS depth, a.owner AS parent_conv_id, g.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(g.ids) AS ends_sha256
FROM g JOIN s USING (key) LEFT JOIN kids USING (key) LEFT JOIN up USING (key) LEFT JOIN g a ON a.key = up.above"""


def codes_sql() -> str:
    """Every part against every entry, round by round."""
    near = "list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)])"
    mean = "(s - ((s % n) + n) % n) // n"
    rounds = [f"a0 AS (SELECT vec_id, p, min({near} * {codes.ENTRIES} + entry) AS least FROM q JOIN b0 USING (p) GROUP BY vec_id, p)"]
    for k in range(codes.ROUNDS):
        rounds.append(f"""m{k} AS (SELECT p, entry, list({mean} ORDER BY i) AS mean FROM (SELECT p, least % {codes.ENTRIES} AS entry, i, sum(v) AS s, count(*) AS n
 FROM (SELECT p, least, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{k} JOIN q USING (vec_id, p)) GROUP BY ALL) GROUP BY p, entry),
b{k + 1} AS MATERIALIZED (SELECT p, entry, coalesce(mean, c) AS c FROM b{k} LEFT JOIN m{k} USING (p, entry)),
a{k + 1} AS MATERIALIZED (SELECT vec_id, p, min({near} * {codes.ENTRIES} + entry) AS least FROM q JOIN b{k + 1} USING (p) GROUP BY vec_id, p)""")
    return f"""WITH e AS (SELECT vec_id, label, [floor({codes.SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
q AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // {codes.PARTS}) + 1:(p + 1) * (len(v) // {codes.PARTS})] AS x FROM e, range({codes.PARTS}) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry, x AS c FROM q QUALIFY entry < {codes.ENTRIES}),
{", ".join(rounds)},
r AS (SELECT vec_id, string_agg(printf('%02x', (least % {codes.ENTRIES})::INT), '' ORDER BY p) AS code, CAST(sum(least // {codes.ENTRIES}) AS BIGINT) AS error FROM a{codes.ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) FROM b{codes.ROUNDS}) AS codebooks_sha256 FROM r JOIN e USING (vec_id)"""
