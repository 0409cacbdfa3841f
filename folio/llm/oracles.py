"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Words of both sides, runs of ten of them (an item of fewer: all), and where they meet.
ORACLES["op1_decontaminate"] = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM windows
), runs AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS run
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc_words, sizes WHERE len(w) >= n)
), met AS (
  SELECT r.doc_id, r.k, r.n, x.item_id FROM runs r JOIN windows x ON r.n = x.n AND r.run = x.run
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM met) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM met) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

# Lines weigh words; grams of 25 words; the least gram of each stretch of 50 words; first
# places; diagonals; runs of equal lines along them; and all stretches that occur earlier.
ORACLES["op6_line_dedup"] = r"""
WITH body AS (
  SELECT doc_id, ('0x' || md5(text)[1:15])::BIGINT AS digest, string_split(text, chr(10)) AS parts FROM documents
), cut AS (
  SELECT DISTINCT doc_id, digest, line_no,
         trim(parts[line_no + 1], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT *, unnest(range(len(parts))) AS line_no FROM body)
), measured AS (
  SELECT doc_id, digest, line_no, ('0x' || md5(line)[1:15])::BIGINT AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM cut WHERE line <> ''
), lines AS (
  SELECT *, row_number() OVER w - 1 AS pos, sum(words) OVER w - words AS before, sum(words) OVER w AS after
  FROM measured WINDOW w AS (PARTITION BY doc_id, digest ORDER BY line_no)
), framed AS (
  SELECT *, max(after) OVER g AS gram_end, max(after) OVER s AS stretch_end, max(pos) OVER s AS until, list(h) OVER g AS hs, list(h) OVER s AS following,
         min(before) OVER u AS stretch_start, min(pos) OVER u AS since, list(h) OVER u AS preceding
  FROM lines WINDOW g AS (PARTITION BY doc_id, digest ORDER BY before RANGE BETWEEN CURRENT ROW AND 24 FOLLOWING),
                    s AS (PARTITION BY doc_id, digest ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
                    u AS (PARTITION BY doc_id, digest ORDER BY after RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), grams AS (
  SELECT doc_id, digest, pos, before, gram_end, ('0x' || md5(array_to_string(hs, ','))[1:15])::BIGINT AS gram FROM framed WHERE gram_end - before >= 25
), selected AS (
  SELECT DISTINCT s.doc_id, s.digest, g.pos, g.gram
  FROM framed s JOIN grams g
    ON g.doc_id = s.doc_id AND g.digest = s.digest AND g.before >= s.before AND g.gram_end <= s.stretch_end
  WHERE s.stretch_end - s.before >= 50
  QUALIFY row_number() OVER (PARTITION BY s.doc_id, s.digest, s.pos ORDER BY g.gram, g.pos) = 1
), first_place AS (
  SELECT gram, doc_id AS doc0, digest AS digest0, pos AS pos0 FROM selected
  QUALIFY row_number() OVER (PARTITION BY gram ORDER BY doc_id, digest, pos) = 1
), diagonals AS (
  SELECT DISTINCT doc_id, digest, doc0, digest0, pos0 - pos AS shift FROM selected JOIN first_place USING (gram)
  WHERE (doc0, digest0, pos0) < (doc_id, digest, pos)
), equal AS (
  SELECT d.*, a.pos, a.line_no, a.words,
         a.pos - row_number() OVER (PARTITION BY d.doc_id, d.digest, d.doc0, d.digest0, d.shift ORDER BY a.pos) AS run
  FROM diagonals d JOIN lines a ON a.doc_id = d.doc_id AND a.digest = d.digest
  JOIN lines b ON b.doc_id = d.doc0 AND b.digest = d.digest0 AND b.pos = a.pos + d.shift AND b.h = a.h
), stretches AS (
  SELECT doc_id, digest, pos, until, array_to_string(following, ',') AS stretch FROM framed WHERE stretch_end - before >= 50
  UNION
  SELECT doc_id, digest, since, pos, array_to_string(preceding, ',') FROM framed WHERE after - stretch_start >= 50
), again AS (
  SELECT doc_id, digest, pos, until FROM stretches
  QUALIFY (doc_id, digest, pos) > min((doc_id, digest, pos)) OVER (PARTITION BY stretch)
), gone AS (
  SELECT DISTINCT doc_id, digest, line_no FROM (
    SELECT *, sum(words) OVER (PARTITION BY doc_id, digest, doc0, digest0, shift, run) AS weight FROM equal)
  WHERE weight >= 25
  UNION
  SELECT l.doc_id, l.digest, l.line_no FROM again a JOIN lines l ON l.doc_id = a.doc_id AND l.digest = a.digest AND l.pos BETWEEN a.pos AND a.until
), listed AS (
  SELECT doc_id, digest, list(line_no ORDER BY line_no) AS lines FROM gone GROUP BY doc_id, digest
)
SELECT b.doc_id, len(parts)::BIGINT AS n_lines, coalesce(len(lines), 0)::BIGINT AS n_deleted,
       coalesce(array_to_string(lines, ','), '') AS deleted,
       array_to_string(list_filter(parts, lambda p, k: NOT coalesce(list_contains(lines, k - 1), false)), chr(10)) AS text
FROM body b LEFT JOIN listed l ON l.doc_id = b.doc_id AND l.digest = b.digest
"""

# Shingle sets of distinct texts, pairs by shared shingles, and the smallest id by iteration.
ORACLES["op5_jaccard_join"] = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM worded WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reached AS (
  SELECT a AS doc_id, a AS other FROM links
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
), least AS (
  SELECT doc_id, min(other) AS least FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least, d.doc_id) AS component_id
FROM worded d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

# The table filled turn by turn, then one lookup per row.
ORACLES["op7_sharding"] = r"""
WITH RECURSIVE shards AS (
  SELECT list(('0x' || md5('start:' || name)[1:15])::BIGINT % 2039 ORDER BY name) AS starts,
         list(('0x' || md5('step:' || name)[1:15])::BIGINT % 2038 + 1 ORDER BY name) AS steps, list(name ORDER BY name) AS names
  FROM (SELECT 'shard-' || lpad(k::VARCHAR, 2, '0') AS name FROM range(16) t(k))
), fill AS (
  SELECT 0 AS t, list_resize([]::INTEGER[], 2039, -1) AS taken
  UNION ALL
  SELECT t + 1, list_concat(taken[:slot], [t % 16], taken[slot + 2:])
  FROM (SELECT t, taken, (SELECT arg_min(p, j)
                          FROM (SELECT j, (starts[t % 16 + 1] + j * steps[t % 16 + 1]) % 2039 AS p FROM range(2039) r(j))
                          WHERE taken[p + 1] = -1) AS slot
        FROM fill, shards WHERE t < 2039)
), placed AS (
  SELECT doc_id, ('0x' || md5(doc_id::VARCHAR)[1:15])::BIGINT % 2039 AS slot FROM documents
)
SELECT doc_id, slot, names[taken[slot + 1] + 1] AS shard FROM placed, (SELECT taken FROM fill WHERE t = 2039), shards
"""

# Terms in ten documents of a language; shares in every group, whether it has the term or
# not; distances of pairs of sources and of a source from its language.
ORACLES["op13_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), words AS (
  SELECT doc, lang, source, unnest(w) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT lang, source, coalesce(total, 0)::HUGEINT AS total, coalesce(v, 0)::HUGEINT AS v
  FROM (SELECT DISTINCT lang, source FROM docs)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counted GROUP BY lang, source) USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) USING (lang)
), shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p
  FROM groups JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)
), of_lang AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (max(total) + 2 * max(v)) AS q
  FROM shares JOIN (SELECT lang, sum(total) AS total, max(v) AS v FROM groups GROUP BY lang) USING (lang)
  GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, b.source, 0 FROM groups a JOIN groups b USING (lang) WHERE a.source <> b.source AND a.v = 0
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM shares JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

# crc32 of an id and a run, byte by byte through its table; runs that lose a code point;
# words one edit apart meet at what is left when a code point is taken out; forms of forms.
ORACLES["op12_spelling_variants"] = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t
  FROM range(256) AS r(k)
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), of_document AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, run, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc || ':' || run, ''),
           lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM of_document, crc_table
), words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), shorter AS (
  SELECT word, n, k, left(word, k::INT) || substr(word, k::INT + 2) AS less
  FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.less = b.less AND a.k = b.k AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.less = b.word
  UNION
  SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.less = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM near GROUP BY word
), judged AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), paths AS (
  SELECT word, word AS at, form AS next, 0 AS steps FROM judged
  UNION ALL
  SELECT p.word, j.word, j.form, steps + 1 FROM paths p JOIN judged j ON p.next = j.word
)
SELECT j.word, j.form, p.at AS root, j.n, j.n_near::BIGINT AS n_near, j.form_n FROM judged j JOIN paths p ON p.word = j.word AND p.next IS NULL
"""
