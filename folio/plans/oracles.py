"""DuckDB SQL that gives the same rows as the registered queries.

Written from the meaning of each query over the source tables, not from its Spark plan:
the parsers, for instance, are checked against the rows their text was rendered from.
"""

from __future__ import annotations

from folio import constants as K
from folio.functions import text as X
from folio.plans import standins as S


def _s(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def _list(items: list[str]) -> str:
    return "[" + ", ".join(_s(i) for i in items) + "]"


WS = _s(X.WHITESPACE)


def _strip(e: str) -> str:
    return f"trim({e}, {WS})"


def _hash(e: str, digits: int = 7) -> str:
    return f"CAST(('0x' || substr(md5({e}), 1, {digits})) AS BIGINT)"


def _word_ids(e: str) -> str:
    words = f"list_filter(regexp_split_to_array({_strip(e)}, '\\s+'), lambda w: w <> '')"
    return f"list_transform({words}, lambda w: CAST({_hash('w')} % 31999 + 1 AS INTEGER))"


def _pad(ids: str, length: int, pad: int) -> str:
    cut = f"list_slice({ids}, 1, {length})"
    return f"list_concat({cut}, list_resize(CAST([] AS INTEGER[]), {length} - len({cut}), {pad}))"


def _ones(ids: str, length: int) -> str:
    return _pad(f"list_transform({ids}, lambda x: CAST(1 AS INTEGER))", length, 0)


def _masked(ids: str, length: int) -> str:
    return f"list_transform({_pad(ids, length, 0)}, lambda x: CASE WHEN x = 0 THEN CAST(-100 AS INTEGER) ELSE x END)"


ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- text and chunks

_LINES = "string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
ORACLES["corpus_lines"] = f"""
SELECT doc_id, CAST(i AS INTEGER) AS line_no, {_strip('parts[i + 1]')} AS line
FROM (SELECT doc_id, {_LINES} AS parts FROM documents), unnest(range(len(parts))) AS t(i)
"""

_CHUNKS = """
chunks AS (
  SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, substring(text, CAST(i * 450 + 1 AS BIGINT), 500) AS chunk
  FROM (SELECT doc_id, text, CAST(greatest(ceil((length(text) - 50) / 450.0), 1) AS BIGINT) AS n
        FROM documents WHERE length(text) > 0), unnest(range(n)) AS t(i))
"""
ORACLES["chunk_fixed"] = f"WITH {_CHUNKS} SELECT * FROM chunks"

# Pieces cut at line breaks, long ones again at spaces; neighbouring pieces of a run walked
# one by one, and a chunk put out whenever the next piece does not fit.
ORACLES["chunk_recursive"] = f"""
WITH RECURSIVE lines AS (
  SELECT doc_id, i, CASE WHEN i = 0 THEN parts[1] ELSE chr(10) || parts[i + 1] END AS piece, (len(parts) > 1) AS cut
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE length(text) > 0), unnest(range(len(parts))) AS t(i)
), kinds AS (
  SELECT *, length(piece) >= 500 OR NOT cut AS long FROM lines WHERE piece <> ''
), pieces AS (
  SELECT doc_id, i, 0 AS j, piece, false AS long FROM kinds WHERE NOT long
  UNION ALL
  SELECT doc_id, i, j, CASE WHEN j = 0 THEN words[1] ELSE ' ' || words[j + 1] END, true
  FROM (SELECT doc_id, i, string_split(piece, ' ') AS words FROM kinds WHERE long), unnest(range(len(words))) AS t(j)
), marked AS (
  SELECT *, length(piece) AS n,
         CASE WHEN long THEN i ELSE -1 - (i - row_number() OVER (PARTITION BY doc_id, long ORDER BY i, j)) END AS part
  FROM pieces WHERE piece <> ''
), runs AS (
  SELECT doc_id, long, part, min(i) AS first_i, list(piece ORDER BY i, j) AS ps,
         list_concat([0], list(total ORDER BY i, j)) AS upto
  FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, long, part ORDER BY i, j) AS total FROM marked)
  GROUP BY doc_id, long, part
), walk AS (
  SELECT doc_id, first_i, 0 AS i, 0 AS first, -1 AS from_piece, -1 AS to_piece, len(ps) AS n_pieces, upto FROM runs
  UNION ALL
  SELECT doc_id, first_i, i + 1, CASE WHEN full_now THEN kept ELSE first END,
         CASE WHEN full_now THEN first ELSE -1 END, CASE WHEN full_now THEN i ELSE -1 END, n_pieces, upto
  FROM (
    SELECT *, i < n_pieces AND i > first AND upto[i + 2] - upto[first + 1] > 500 AS full_now,
           list_filter(range(first, i + 1), lambda f: upto[i + 1] - upto[f + 1] <= 50
                       AND (f = i OR upto[i + 2] - upto[f + 1] <= 500))[1] AS kept
    FROM walk WHERE i <= n_pieces)
  WHERE i < n_pieces
), cuts AS (
  SELECT doc_id, first_i, i AS step, from_piece AS a, to_piece AS b FROM walk WHERE from_piece >= 0
  UNION ALL
  SELECT doc_id, first_i, n_pieces + 1, first, n_pieces FROM walk WHERE i = n_pieces
), chunks AS (
  SELECT c.doc_id, c.first_i, c.step, trim(array_to_string(r.ps[c.a + 1 : c.b], ''), {WS}) AS chunk
  FROM cuts c JOIN runs r ON r.doc_id = c.doc_id AND r.first_i = c.first_i
)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_i, step) - 1 AS INTEGER) AS chunk_no, chunk
FROM chunks WHERE chunk <> ''
"""

ORACLES["chunk_append_ids"] = f"""
WITH {_CHUNKS}
SELECT CAST((SELECT count(*) FROM benchmark) + row_number() OVER (ORDER BY doc_id, chunk_no) AS VARCHAR) AS id,
       doc_id, chunk_no, chunk
FROM chunks
"""

_T = "html"
_T = f"regexp_replace({_T}, {_s(X._DROPPED_MARKUP)}, '', 'g')"
_T = f"regexp_replace({_T}, {_s(X._BLOCK_MARKUP)}, chr(10), 'g')"
_T = f"regexp_replace({_T}, {_s(X._ANY_MARKUP)}, '', 'g')"
for _entity, _char in X._ENTITIES:
    _T = f"replace({_T}, {_s(_entity)}, {_s(_char)})"
_T = f"regexp_replace({_T}, '[ \\t]*\\n[ \\t\\n]*', chr(10), 'g')"
ORACLES["pages_text"] = f"SELECT page_id, url, {_strip(_T)} AS text FROM pages"

ORACLES["book_text"] = f"""
WITH {_CHUNKS}
SELECT CAST(doc_id AS VARCHAR) AS stem, string_agg(chunk, '' ORDER BY chunk_no) AS body
FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
GROUP BY doc_id
"""

# ---------------------------------------------------------------- parsers and knowledge base

_RANK = f"coalesce(list_position({_list(S.PART_TITLES)}, p_type), 0)"
_PAIRS = f"""
SELECT p_brand AS path, CAST({_RANK} * {S.ROWS_PER_SECTION} + p_partkey + 1 AS BIGINT) AS line_no,
       p_name AS medicine_a, p_brand AS medicine_b, CAST(p_size AS VARCHAR) || 'g' AS dosage,
       'use ' || CAST(p_partkey AS VARCHAR) AS function,
       CASE WHEN p_type = '{S.UNTITLED}' THEN '' ELSE p_type END AS type
FROM part
"""
ORACLES["section_rows"] = _PAIRS + " WHERE p_size > 1"
ORACLES["section_rejects"] = f"""
SELECT path, line_no, medicine_a, medicine_b, dosage, type, 'fewer than 4 fields' AS reject
FROM ({_PAIRS} WHERE p_size <= 1)
"""


def _load(prefix: str, types: list[str]) -> str:
    names = ", ".join(_s(t) for t in types)
    return f"""
SELECT p_name AS medicine_a, p_brand AS medicine_b,
       '{prefix}' || CAST(min(p_partkey) AS VARCHAR) AS id,
       arg_max(CAST(p_size AS VARCHAR) || 'g', p_partkey) AS dosage,
       'use ' || CAST(max(p_partkey) AS VARCHAR) AS function,
       arg_max(p_type, p_partkey) AS type
FROM part WHERE p_type IN ({names}) GROUP BY p_name, p_brand
"""


ORACLES["kb_upsert"] = f"""
WITH old AS ({_load('kb-', S.FIRST_LOAD)}), new AS ({_load('in-', S.SECOND_LOAD)})
SELECT coalesce(old.id, new.id) AS id, medicine_a, medicine_b,
       coalesce(new.dosage, old.dosage) AS dosage,
       coalesce(new.function, old.function) AS function, coalesce(new.type, old.type) AS type
FROM old FULL OUTER JOIN new USING (medicine_a, medicine_b)
"""
ORACLES["kb_lookup"] = f"""
WITH kb AS ({ORACLES["kb_upsert"]})
SELECT l_orderkey, l_linenumber, l_partkey, kb.id, kb.dosage, kb.type
FROM lineitem JOIN part ON l_partkey = p_partkey
JOIN kb ON medicine_a = p_name AND medicine_b = p_brand
"""

_FORMULAS = """
SELECT 'book-' || CAST(l_orderkey // 1000 AS VARCHAR) AS path,
       row_number() OVER (PARTITION BY l_orderkey // 1000 ORDER BY l_orderkey) AS formula_no,
       '桂枝' || CAST(l_orderkey AS VARCHAR) || '汤方' AS name,
       list_concat(list(p_name ORDER BY l_linenumber, p_name), ['甘草一两', '大枣三枚']) AS ingredients,
       ['右' || CAST(count(*) AS VARCHAR) || '味，以水七升'] AS methods
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY l_orderkey
"""
ORACLES["formula_parse"] = _FORMULAS
ORACLES["formula_rejects"] = """
SELECT DISTINCT 'book-' || CAST(l_orderkey // 1000 AS VARCHAR) AS path, CAST(-1 AS BIGINT) AS line_no,
       '序言' AS line, 'before the first header' AS reject
FROM lineitem
"""
_QA = f"""
SELECT path, formula_no,
       {_s(K.INGREDIENTS_MARK)} || array_to_string(ingredients, chr(10)) || chr(10)
         || {_s(K.METHODS_MARK)} || array_to_string(methods, chr(10)) AS input,
       {_s(K.NAME_MARK)} || name AS output
FROM ({_FORMULAS})
"""
ORACLES["formula_qa"] = _QA
_DAMAGED = f"""
SELECT path, formula_no,
       CASE formula_no % 5 WHEN 1 THEN replace(input, {_s(K.METHODS_MARK)}, '') WHEN 2 THEN '' ELSE input END AS input,
       CASE formula_no % 5 WHEN 3 THEN replace(output, {_s(K.NAME_MARK)}, '') WHEN 4 THEN NULL ELSE output END AS output
FROM ({_QA})
"""
ORACLES["qa_extract"] = f"""
SELECT path, formula_no,
       replace(split_part(split_part(input, {_s(K.INGREDIENTS_MARK)}, 2), {_s(K.METHODS_MARK)}, 1), chr(10), '') AS input,
       split_part(output, {_s(K.NAME_MARK)}, 2) AS output
FROM ({_DAMAGED})
WHERE length(input) > 0 AND length(output) > 0 AND contains(input, {_s(K.INGREDIENTS_MARK)})
  AND contains(input, {_s(K.METHODS_MARK)}) AND contains(output, {_s(K.NAME_MARK)})
"""
ORACLES["qa_rejects"] = f"""
SELECT path, formula_no, CASE WHEN output IS NULL THEN 'missing value' ELSE 'no name marker' END AS reject
FROM ({_DAMAGED})
WHERE output IS NULL OR (length(input) > 0 AND contains(input, {_s(K.METHODS_MARK)})
                         AND NOT contains(output, {_s(K.NAME_MARK)}))
"""

# ---------------------------------------------------------------- datasets

_SPLIT_KEY = "'42|' || CAST(doc_id AS VARCHAR)"
ORACLES["split_exact"] = f"""
SELECT doc_id, lang,
       CASE WHEN row_number() OVER (ORDER BY md5({_SPLIT_KEY}), doc_id) <= ceil(count(*) OVER () * 20 / 100.0)
            THEN 'validation' ELSE 'train' END AS split
FROM documents
"""
_SPLIT = f"CASE WHEN {_hash(_SPLIT_KEY)} % 100 < 20 THEN 'validation' ELSE 'train' END"
ORACLES["split_hash"] = f"SELECT doc_id, lang, {_SPLIT} AS split FROM documents"
ORACLES["dataset_summary"] = f"""
SELECT {_SPLIT} AS split, count(*) AS n_rows, 'doc_id,text' AS columns FROM documents GROUP BY 1
"""
ORACLES["completion_prompts"] = f"SELECT item_id, {_s(K.PARAPHRASE_PROMPT)} || text AS prompt FROM benchmark"

_RESPONSE = "'1.' || text || chr(10) || '2. ' || replace(text, 'e', 'E') || '3两' || chr(10) || '10.' || reverse(text)"
ORACLES["expand_variants"] = f"""
WITH v AS (
  SELECT item_id, list_concat([text], list_filter(
           regexp_split_to_array(replace(replace({_RESPONSE}, chr(10), ''), ' ', ''), '[\\d.]+'),
           lambda x: x <> '')) AS items
  FROM benchmark WHERE item_id % 7 <> 6)
SELECT item_id, '方' || CAST(item_id AS VARCHAR) AS output, CAST(i AS INTEGER) AS variant_no, items[i + 1] AS input
FROM v, unnest(range(len(items))) AS t(i)
"""


def _choose(templates: list[str], salt: str, value: str) -> str:
    at = _hash(f"'{salt}42|' || CAST(item_id AS VARCHAR) || '|' || CAST(copy_no AS VARCHAR)")
    return f"replace({_list(templates)}[{at} % {len(templates)} + 1], '{{}}', {value})"


ORACLES["template_augment"] = f"""
WITH worded AS (
  SELECT item_id, CAST(copy_no AS INTEGER) AS copy_no, {_choose(K.INPUT_TEMPLATES, 'in', 'text')} AS input,
         {_choose(K.OUTPUT_TEMPLATES, 'out', f"{_s(K.NAME_MARK + '方')} || CAST(item_id AS VARCHAR)")} AS output
  FROM benchmark, unnest(range({K.TEMPLATE_COPIES})) AS t(copy_no))
SELECT *, '<|im_start|>system' || chr(10) || {_s(K.SYSTEM_TURN)} || chr(10) || '<|im_end|>' || chr(10)
          || '<|im_start|>user' || chr(10) || input || '<|im_end|>' || chr(10)
          || '<|im_start|>assistant' || chr(10) || output || '<|im_end|>' AS formatted
FROM worded
"""


def _chat(start: str, end: str) -> str:
    return f"""
SELECT conv_id, string_agg('{start}' || role || chr(10) || text || '{end}' || chr(10), '' ORDER BY turn)
                || '{start}assistant' || chr(10) AS {{}}
FROM conversations GROUP BY conv_id
"""


ORACLES["chat_template"] = _chat("<|im_start|>", "<|im_end|>").format("prompt")
ORACLES["special_tokens"] = _chat("", "").format("plain")

# ---------------------------------------------------------------- token arrays

ORACLES["tokenize_pad_mask"] = f"""
SELECT conv_id, turn, {_pad('ids', 512, 0)} AS input_ids, {_ones('ids', 512)} AS attention_mask,
       {_masked('ids', 512)} AS labels
FROM (SELECT conv_id, turn, {_word_ids('text')} AS ids FROM conversations)
"""
_QUESTION = f"{_s(K.INGREDIENTS_MARK)} || input || {_s(K.NAME_QUESTION_SUFFIX)}"
ORACLES["tokenize_prompt_unmasked"] = f"""
SELECT path, formula_no, {_pad('ids', 128, 0)} AS input_ids, {_ones('ids', 128)} AS attention_mask,
       {_pad('target', 128, 0)} AS labels
FROM (SELECT path, formula_no, {_word_ids(_QUESTION)} AS ids, {_word_ids('output')} AS target FROM ({_QA}))
"""
ORACLES["tokenize_pair_masked"] = f"""
SELECT path, formula_no, {_pad('ids', 128, 0)} AS input_ids, {_ones('ids', 128)} AS attention_mask,
       {_masked('target', 128)} AS labels
FROM (SELECT path, formula_no, {_word_ids('input')} AS ids, {_word_ids('output')} AS target FROM ({_QA}))
"""


def _fill(ids: str, pad: int) -> str:
    return f"list_concat({ids}, list_resize(CAST([] AS INTEGER[]), width - len(ids), {pad}))"


ORACLES["collate_batches"] = f"""
WITH rows AS (
  SELECT conv_id, turn, {_word_ids('text')} AS ids,
         (row_number() OVER (ORDER BY conv_id, turn) - 1) // 8 AS batch_id
  FROM conversations),
wide AS (
  SELECT *, CAST(ceil(max(len(ids)) OVER (PARTITION BY batch_id) / 8.0) * 8 AS BIGINT) AS width FROM rows)
SELECT conv_id, turn, batch_id, {_fill('ids', 0)} AS input_ids,
       {_fill('list_transform(ids, lambda x: CAST(1 AS INTEGER))', 0)} AS attention_mask, {_fill('ids', -100)} AS labels
FROM wide
"""
ORACLES["drop_prompt_prefix"] = f"SELECT conv_id, turn, {_word_ids('text')} AS answer_ids FROM conversations"

# ---------------------------------------------------------------- requests and retrieval


def _requests(model: str) -> str:
    return f"""
SELECT item_id AS request_id, text AS question, {model} AS model,
       CASE item_id % 3 WHEN 1 THEN false ELSE true END AS external_db
FROM benchmark
"""


_ASKED = f"{_list(S.ASKED_MODELS)}[item_id % 4 + 1]"
_NAMED = f"CASE WHEN contains({_ASKED}, '/') THEN {_ASKED} ELSE 'Qwen/' || {_ASKED} END"
_MODELS = "(VALUES " + ", ".join(f"({_s(m)}, {_s(p)}, {a})" for m, p, a in S.MODELS) + ") AS m(model, path, active)"
ORACLES["parse_requests"] = _requests(_ASKED)
ORACLES["request_rejects"] = f"""
SELECT item_id AS request_id,
       CASE item_id % 5 WHEN 1 THEN '{{' || text WHEN 2 THEN '{{"model":"m"}}' WHEN 3 THEN '{{"question":" \u3000"}}' END AS value,
       CASE item_id % 5 WHEN 2 THEN 'no question' WHEN 3 THEN 'blank question' ELSE 'malformed' END AS reject
FROM benchmark WHERE item_id % 5 <> 0
"""
_ROUTED = f"""
SELECT request_id, question, model, external_db, path
FROM ({_requests(_NAMED)}) JOIN {_MODELS} USING (model) WHERE active
"""
ORACLES["route_requests"] = _ROUTED
ORACLES["route_rejects"] = f"""
SELECT * FROM ({_requests(_NAMED)}) WHERE model NOT IN (SELECT model FROM {_MODELS} WHERE active)
"""

_UNIT = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
ORACLES["near_vector"] = f"""
WITH e AS ({_UNIT}), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS len FROM e),
r AS (
  SELECT q.vec_id AS query_id, b.vec_id,
         row_number() OVER (PARTITION BY q.vec_id
           ORDER BY round(1 - list_dot_product(q.v, b.v) / (q.len * b.len), 9), b.vec_id) AS rank
  FROM n q JOIN n b ON q.vec_id <> b.vec_id
  WHERE q.vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label))
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
"""
ORACLES["near_vector_rows"] = f"""
WITH e AS ({_UNIT}), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS len FROM e),
r AS (
  SELECT q.vec_id AS query_id, b.vec_id,
         row_number() OVER (PARTITION BY q.vec_id
           ORDER BY round(1 - list_dot_product(q.v, b.v) / (q.len * b.len), 9), b.vec_id) AS rank
  FROM n q JOIN n b ON q.vec_id <> b.vec_id
  WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
"""
ORACLES["near_vector_centroids"] = f"""
WITH e AS ({_UNIT}),
means AS (SELECT label, i, avg(v[i]) AS x FROM e, unnest(range(1, 65)) AS t(i) GROUP BY label, i),
q AS (SELECT label, list(x ORDER BY i) AS v FROM means GROUP BY label),
r AS (
  SELECT q.label, e.vec_id,
         row_number() OVER (PARTITION BY q.label
           ORDER BY round(1 - list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)), 9),
                    e.vec_id) AS rank
  FROM q, e)
SELECT label, vec_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
"""


def _hits(base_tokens: str, query_tokens: str) -> str:
    """CTEs up to ``hits(request_id, doc_id, rank)``."""
    return f"""
n AS (SELECT count(*) AS n FROM documents),
bp AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({base_tokens}) AS token FROM documents) GROUP BY ALL),
dfs AS (SELECT token, count(*) AS df FROM bp GROUP BY token),
bw AS (SELECT doc_id, token, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM bp JOIN dfs USING (token), n),
bn AS (SELECT doc_id, sqrt(sum(w * w)) AS len FROM bw GROUP BY doc_id),
qp AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest({query_tokens}) AS token FROM benchmark) GROUP BY ALL),
qw AS (SELECT item_id, token, tf * (ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1) AS w FROM qp LEFT JOIN dfs USING (token), n),
qn AS (SELECT item_id, sqrt(sum(w * w)) AS len FROM qw GROUP BY item_id),
dots AS (SELECT item_id, doc_id, sum(qw.w * bw.w) AS dot FROM qw JOIN bw USING (token) GROUP BY ALL),
ranked AS (
  SELECT item_id, doc_id,
         row_number() OVER (PARTITION BY item_id ORDER BY round(1 - dot / (qn.len * bn.len), 9), doc_id) AS rank
  FROM dots JOIN qn USING (item_id) JOIN bn USING (doc_id)),
hits AS (SELECT item_id AS request_id, doc_id, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10)
"""


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_WORD_HITS = _hits(_WORDS, _WORDS)
ORACLES["near_text"] = f"WITH {_WORD_HITS} SELECT request_id, doc_id, rank FROM hits"
# All two-letter windows of the lower-case text that hold letters or digits only.
_LOW = "lower(text)"
_PAIRS_OF = (
    f"list_filter(list_transform(list_zip(string_split({_LOW}, ''), list_slice(string_split({_LOW}, ''), 2, length(text))), "
    "lambda p: p[1] || p[2]), lambda w: regexp_full_match(w, '[\\p{L}\\p{N}]{2}'))"
)
ORACLES["near_text_pairs"] = f"WITH {_hits(_PAIRS_OF, _PAIRS_OF)} SELECT request_id, doc_id, rank FROM hits"

_CONTEXT = f"""
{_WORD_HITS},
lines AS (
  SELECT request_id, rank,
         '''' || lang || '  ' || source || '  ' || CAST(doc_id AS VARCHAR) || '  ' || CAST(n_chars AS VARCHAR)
         || '  ' || text || ''' ' || chr(10) AS line
  FROM hits JOIN documents USING (doc_id)),
contexts AS (SELECT request_id, string_agg(line, '' ORDER BY rank) AS context FROM lines GROUP BY request_id)
"""
ORACLES["rag_context"] = f"WITH {_CONTEXT} SELECT request_id, context FROM contexts"
ORACLES["rag_prompt"] = f"""
WITH {_CONTEXT}, routed AS ({_ROUTED})
SELECT request_id, model, external_db,
       CASE WHEN external_db AND length(coalesce(context, '')) > 0 THEN 'Context: ' || context || chr(10) ELSE '' END
       || 'Question: ' || question || {_s(K.ANSWER_REQUEST)} AS prompt
FROM routed LEFT JOIN contexts USING (request_id)
"""

# ---------------------------------------------------------------- answers

_DOC_CHUNKS = """
chunks AS (
  SELECT doc_id, CAST(i AS INTEGER) AS seq, parts[i + 1] AS chunk
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(len(parts))) AS t(i))
"""
_MARK = "'the'"
ORACLES["answer_assemble"] = f"""
WITH {_DOC_CHUNKS}, firsts AS (SELECT doc_id, min(seq) FILTER (WHERE contains(chunk, {_MARK})) AS first FROM chunks GROUP BY doc_id)
SELECT doc_id, coalesce(string_agg(CASE WHEN contains(chunk, {_MARK}) THEN split_part(chunk, {_MARK}, 2) ELSE chunk END,
                                   '' ORDER BY seq) FILTER (WHERE seq >= first), '') AS answer
FROM chunks JOIN firsts USING (doc_id) GROUP BY doc_id
"""
ORACLES["answers_streamed"] = ORACLES["answer_assemble"]
ORACLES["answer_snapshots"] = f"""
WITH {_DOC_CHUNKS}, firsts AS (SELECT doc_id, min(seq) FILTER (WHERE contains(chunk, {_MARK})) AS first FROM chunks GROUP BY doc_id)
SELECT doc_id, seq,
       coalesce(string_agg(CASE WHEN seq >= first THEN CASE WHEN contains(chunk, {_MARK}) THEN split_part(chunk, {_MARK}, 2) ELSE chunk END END, '')
                OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING), '') AS answer
FROM chunks JOIN firsts USING (doc_id)
"""
ORACLES["cumulative_text"] = f"""
WITH {_DOC_CHUNKS}
SELECT doc_id, seq, string_agg(chunk, '') OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS so_far
FROM chunks
"""
ORACLES["sse_frame"] = f"""
WITH {_DOC_CHUNKS} SELECT doc_id, seq, 'data: ' || chunk || chr(10) || chr(10) AS frame FROM chunks
"""
ORACLES["message_log"] = """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'bot' END AS sender, text,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn, role = 'user' DESC) - 1 AS position
FROM conversations
"""

# ---------------------------------------------------------------- files and tables

ORACLES["kb_streamed"] = f"""
WITH old AS ({_load('kb-', S.FIRST_LOAD)}), new AS ({_load('in-', S.SECOND_LOAD)})
SELECT medicine_a, medicine_b, coalesce(new.dosage, old.dosage) AS dosage,
       coalesce(new.function, old.function) AS function, coalesce(new.type, old.type) AS type
FROM old FULL OUTER JOIN new USING (medicine_a, medicine_b)
"""
ORACLES["csv_round_trip"] = """
SELECT conv_id, turn, role,
       CASE WHEN turn % 7 = 6 THEN '' WHEN conv_id % 11 = 10 THEN NULL
            ELSE [' ', chr(9), chr(10), '', '"', ','][conv_id % 6 + 1] || text || [' ', chr(9), chr(10), '', '"', ','][conv_id % 6 + 1]
       END AS text
FROM conversations
"""
ORACLES["splits_loaded"] = """
SELECT item_id, text, CASE WHEN item_id % 4 = 0 THEN 'validation' ELSE 'train' END AS split FROM benchmark
"""
ORACLES["books_round_trip"] = "SELECT CAST(doc_id AS VARCHAR) AS stem, replace(text, chr(10), ' ') AS body FROM documents"

for _name in ("near_text_pruned", "index_reused"):
    ORACLES[_name] = ORACLES["near_text"]

_WORDS = f"list_filter(regexp_split_to_array({_strip('text')}, '\\s+'), lambda w: w <> '')"
ORACLES["vocabulary_ranks"] = f"""
SELECT word, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, encode(word)) + 1 AS INTEGER) AS id
FROM (SELECT unnest({_WORDS}) AS word FROM conversations) GROUP BY word
"""
ORACLES["tokenize_vocabulary"] = f"""
WITH ranks AS ({ORACLES["vocabulary_ranks"]}
), texts AS (
  SELECT row_number() OVER () AS k, conv_id, turn, text, {_WORDS} AS ws FROM conversations
), words AS (
  SELECT k, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM texts
), coded AS (
  SELECT k, list(coalesce(id, 1) ORDER BY pos) AS ids, string_agg(CASE WHEN id IS NULL THEN '?' ELSE word END, ' ' ORDER BY pos) AS words
  FROM words LEFT JOIN (SELECT * FROM ranks WHERE id < 1000) USING (word) GROUP BY k
)
SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN coalesce(ids, CAST([] AS INTEGER[])) END AS ids,
       CASE WHEN text IS NOT NULL THEN coalesce(words, '') END AS words
FROM texts LEFT JOIN coded USING (k)
"""

ORACLES["requests_streamed"] = f"""
SELECT request_id, model, external_db, prompt, NULL AS reject FROM ({ORACLES["rag_prompt"]})
UNION ALL
SELECT request_id, NULL, NULL, NULL, 'no such model' FROM ({ORACLES["route_rejects"]})
UNION ALL
SELECT -1 - item_id, NULL, NULL, NULL, 'blank question' FROM benchmark
UNION ALL
SELECT request_id + {S.DAMAGED}, NULL, NULL, NULL, reject FROM ({ORACLES["request_rejects"]})
UNION ALL
SELECT item_id + {S.DAMAGED}, NULL, NULL, NULL, 'no such model' FROM benchmark WHERE item_id % 5 = 0
"""

ORACLES["completions_resumed"] = f"""
SELECT item_id, CASE WHEN h < 3 THEN md5(prompt) END AS response, CASE WHEN h = 3 THEN 'ValueError: busy' END AS reject,
       CAST(least(h + 1, 3) AS INTEGER) AS attempts
FROM (SELECT item_id, prompt, {_hash('prompt')} % 4 AS h FROM ({ORACLES["completion_prompts"]}))
"""
_OPENED = _s("<|im_start|>system\n" + S.SYSTEM + "<|im_end|>\n")
ORACLES["chat_template_system"] = f"""
SELECT conv_id, CASE WHEN first_role = 'system' THEN prompt ELSE {_OPENED} || prompt END AS prompt
FROM ({ORACLES["chat_template"]}) JOIN (SELECT conv_id, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id) USING (conv_id)
"""
ORACLES["byte_chunks_decoded"] = "SELECT doc_id, text FROM documents WHERE length(text) > 0"
