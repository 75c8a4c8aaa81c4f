"""SQL for the queries that SQL can express, written independently of the DataFrame code for another engine.

Its regular expressions have no look-around, so cuts after a mark put a separator there first.
"""

from __future__ import annotations

from galley import constants as K
from galley.operators.review_map import RETRY_HINT
from galley.plans import catalog as C

SPACE = r"[ \t\n\x0b\x0c\r]"
#: White space as in the data model: Unicode's and the four ASCII separators.
WIDE = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ENDS = "[.!?]"


def texts(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def any_of(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def picked(values, n: str) -> str:
    return f"{texts(values)}[({n}) % {len(values)} + 1]"


def layer_map() -> str:
    return f"CASE layer WHEN '{K.QUOTATION}' THEN 3 WHEN '{K.DOUBTFUL}' THEN 2 WHEN '{K.OPTIONAL}' THEN 1 ELSE 0 END"


def no_space(c: str) -> str:
    return f"regexp_replace({c}, '{WIDE}+', '', 'g')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WIDE}+|{WIDE}+$', '', 'g')"


def cut(c: str) -> str:
    return f"list_filter(string_split(regexp_replace({c}, '({ENDS})', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


BLOCKS = f"""b AS (
  SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS block_index
  FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x <> '') AS l FROM documents))"""

NORMALISE = {
    "lines": "regexp_replace(replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '([a-zA-Z])-\n([a-zA-Z])', '\\1\\2', 'g')",
}


def normalised(c: str) -> str:
    """Runs of white space between Latin letters or digits get a private mark, the others go, the mark becomes a blank.
    Twice, as neighbouring runs share a character."""
    even = strip(NORMALISE["lines"].format(c=c))
    for _ in range(2):
        even = f"regexp_replace({even}, '([A-Za-z0-9]){WIDE}+([A-Za-z0-9])', '\\1' || chr(57345) || '\\2', 'g')"
    return f"replace({no_space(even)}, chr(57345), ' ')"


#: Pieces of each document in their places, and sentences of the text that they make.
PIECES = f"""{BLOCKS},
l AS (SELECT doc_id, block_index, unnest(string_split({NORMALISE["lines"].format(c="text")}, chr(10))) AS line, unnest(range(len(string_split({NORMALISE["lines"].format(c="text")}, chr(10))))) AS n FROM b),
p AS (SELECT doc_id, block_index, n, {normalised("line")} AS piece FROM l),
q AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY block_index, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p WHERE piece <> ''),
t AS (SELECT doc_id, string_agg(piece, '' ORDER BY start, n) AS text FROM q GROUP BY doc_id)"""


def sentences(source: str, c: str = "text") -> str:
    return f"""s AS (
  SELECT doc_id, seq, sentence, coalesce(sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM (SELECT doc_id, unnest({cut(c)}) AS sentence, unnest(range(len({cut(c)}))) AS seq FROM {source}))"""


FINDINGS = f"""{BLOCKS},
k AS (SELECT doc_id, block_index, text AS t, doc_id * 31 + block_index * 7 AS k FROM b),
f AS (
  SELECT doc_id, block_index AS ord, t,
    CASE k % 8 WHEN 0 THEN t[1:40] WHEN 1 THEN '"' || t[1:12] || '"' WHEN 2 THEN '1998年' || t[1:10] WHEN 3 THEN '主任' || t[1:9]
      WHEN 4 THEN '之乎者也' WHEN 5 THEN chr(1) || t[1:9] WHEN 6 THEN t[1:3] || ' ' || t[4:8] ELSE t[greatest(length(t) - 19, 1):] END AS original_text,
    {picked(C.TYPES, "k")} AS issue_type, {picked(K.CATEGORIES, "k")} AS category, {picked(K.CONFIDENCES, "k")} AS confidence,
    {picked(C.SUGGESTIONS, "k")} AS suggestion, {picked(C.REASONS, "k")} AS reason,
    CASE WHEN k % 9 <> 0 THEN (block_index // 2) * 2 END AS block_index, k % 9 <> 0 AS located
  FROM k)"""

WHY = f"""CASE WHEN {any_of("reason || suggestion", K.NON_ISSUE_WORDS)} THEN 'self_declared'
  WHEN regexp_matches(original_text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]') THEN 'control_chars'
  WHEN {any_of("reason || suggestion", K.LAYOUT_WORDS)} THEN 'layout' ELSE 'kept' END"""

QUOTE = f"(len(list_filter(regexp_extract_all(original_text, '\"([^\"]+)\"', 1), lambda x: length(x) >= {K.QUOTE_CHARS})) > 0 OR len(list_filter(regexp_extract_all(original_text, '''([^'']+)''', 1), lambda x: length(x) >= {K.QUOTE_CHARS})) > 0)"
CLASSICAL = f"(length(original_text) - length(translate(original_text, '{K.PARTICLES}', '')) >= {K.PARTICLE_COUNT} AND length(original_text) - length(translate(original_text, '{K.PARTICLES}', '')) >= {K.PARTICLE_DENSITY} * length(original_text))"
FACT_TEXT = f"({strip('suggestion')} <> {strip('original_text')} AND (regexp_matches(original_text, '(?:19|20)[0-9][0-9]') OR {any_of('original_text', K.TITLE_WORDS + K.ORG_WORDS)}))"


def classified(mode: str, tag: str) -> str:
    simple = "TRUE" if mode == K.SIMPLIFIED else "FALSE"
    from galley.operators import classify as R

    n = R.NOTE
    label = "CASE confidence WHEN 'high' THEN '高' WHEN 'medium' THEN '中' ELSE '低' END"
    return f"""{tag} AS (
  SELECT *, CASE rule WHEN 'quotation' THEN '{K.QUOTATION}' WHEN 'optional' THEN '{K.OPTIONAL}' ELSE CASE WHEN confidence = 'high' THEN '{K.CONFIRMED}' ELSE '{K.DOUBTFUL}' END END AS layer,
    CASE rule WHEN 'quotation' THEN '{K.LOW}' WHEN 'optional' THEN '{K.LEISURE}' ELSE '{K.MEDIUM}' END AS priority,
    CASE WHEN rule = 'quotation' THEN '{R.AS_QUOTED_WITH}' || reason
         WHEN rule = 'factual' AND confidence <> 'high' AND NOT starts_with(suggestion, '{R.VERIFY_START}') THEN '{R.TO_VERIFY}' || suggestion ELSE suggestion END AS new_suggestion,
    CASE rule WHEN 'quotation' THEN list_filter([CASE WHEN q1 THEN '{n["q1"]}' END, CASE WHEN q2 THEN '{n["q2"]}' END, CASE WHEN q3 THEN '{n["q3"]}' END], lambda x: x IS NOT NULL)
      WHEN 'factual' THEN list_filter([CASE WHEN f1 THEN '{n["f1"]}' END, CASE WHEN f2 THEN '{n["f2"]}' END, CASE WHEN f3 THEN '{n["f3"]}' END,
        CASE WHEN confidence = 'high' THEN '{n["f_high"]}' ELSE '事实类' || {label} || '置信,降级为存疑待核实' END], lambda x: x IS NOT NULL)
      WHEN 'optional' THEN [CASE WHEN g THEN '{n["grammar"]}' WHEN d THEN '{n["dash"].replace(chr(39), chr(39) * 2)}' ELSE '{n["style"]}' END]
      ELSE [CASE WHEN confidence = 'high' THEN '{n["high"]}' ELSE '默认归层:' || {label} || '置信度→存疑待核实' END] END AS notes
  FROM (
    SELECT *, CASE WHEN q1 OR q2 OR q3 THEN 'quotation' WHEN f1 OR f2 OR f3 THEN 'factual' WHEN g OR d OR s THEN 'optional' ELSE 'default' END AS rule
    FROM (
      SELECT *, category = 'quotation' AS q1, issue_type = '{K.TYPE_QUOTATION}' AS q2, {QUOTE} OR {CLASSICAL} AS q3,
        category = 'factual' AS f1, issue_type = '{K.TYPE_FACT}' AS f2, {FACT_TEXT} AS f3,
        {simple} AND issue_type = '{K.TYPE_GRAMMAR}' AS g, {simple} AND issue_type = '{K.TYPE_TYPO}' AND {any_of("reason || suggestion", K.DASH_WORDS)} AS d,
        category = 'style' OR {any_of("reason || suggestion", K.STYLE_WORDS)} AS s
      FROM f WHERE {WHY} = 'kept')))"""


def final() -> str:
    from galley.operators import classify as R

    return f"""{FINDINGS}, {classified(K.DEEP, "c")},
m AS (
  SELECT doc_id, ord, block_index, original_text,
    CASE WHEN (ocr OR NOT located) AND layer = '{K.CONFIRMED}' THEN '{K.DOUBTFUL}' ELSE layer END AS layer,
    CASE WHEN urgent THEN '{K.HIGH}' ELSE priority END AS priority,
    CASE WHEN ocr THEN '{R.FROM_OCR}' || new_suggestion ELSE new_suggestion END AS suggestion,
    len(notes) + ocr::INT + (NOT located)::INT + urgent::INT AS n_notes
  FROM (
    SELECT c.*, c.issue_type IN ({texts(K.HIGH_PRIORITY_TYPES)[1:-1]}) AS urgent,
      coalesce(c.block_index % 5 = 0 AND (c.block_index % 10 + 85) / 100 < {K.OCR_DOWNGRADE} AND c.issue_type IN ('{K.TYPE_TYPO}', '{K.TYPE_PUNCTUATION}'), FALSE) AS ocr
    FROM c)),
d AS (
  SELECT doc_id, ord, ord AS position, block_index, layer, priority FROM m WHERE block_index IS NULL
  UNION ALL
  SELECT doc_id, ord, position, block_index, layer, priority FROM (
    SELECT *, min(ord) OVER w AS position, row_number() OVER (PARTITION BY doc_id, block_index, {no_space("original_text")} ORDER BY {layer_map()} DESC, ord) AS n
    FROM m WHERE block_index IS NOT NULL WINDOW w AS (PARTITION BY doc_id, block_index, {no_space("original_text")})) WHERE n = 1),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_index ASC NULLS LAST, position) - 1 AS seq FROM d)"""


def oversized(most: int, ends: str = ENDS) -> str:
    """Pieces by a recursive walk over sentences: held text, and what has been put out."""
    return f"""{BLOCKS},
w AS (
  SELECT doc_id, block_index, {cut("text")} AS s, 1 AS i, ''::VARCHAR AS held, []::VARCHAR[] AS done FROM b
  UNION ALL
  SELECT doc_id, block_index, s, i + 1,
    CASE WHEN length(s[i]) > {most} THEN '' WHEN length(held) + length(s[i]) <= {most} THEN held || s[i] ELSE s[i] END,
    CASE WHEN length(s[i]) > {most} THEN list_concat(CASE WHEN held <> '' THEN list_append(done, held) ELSE done END, list_transform(range(1, length(s[i]) + 1, {most}), lambda a: s[i][a:a + {most} - 1]))
         WHEN length(held) + length(s[i]) <= {most} THEN done ELSE list_append(done, held) END
  FROM w WHERE i <= len(s)),
o AS (SELECT doc_id, block_index, CASE WHEN held <> '' THEN list_append(done, held) ELSE done END AS pieces FROM w WHERE i > len(s))"""


LEAD = len(K.OVERLAP_MARK) + len(K.BODY_MARK) + 3

#: Chunks by a recursive walk over units (pieces of blocks): lengths of the last two blocks of the chunk that is filling.
CHUNKS = f"""{oversized(K.CHUNK_MAX)},
u AS (
  SELECT doc_id, block_index, piece, row_number() OVER (PARTITION BY doc_id ORDER BY block_index, j) AS i
  FROM (SELECT doc_id, block_index, unnest(pieces) AS piece, unnest(range(len(pieces))) AS j FROM o)),
g AS (
  SELECT doc_id, i, block_index, length(piece) AS n, 0 AS chunk, length(piece) AS used, {K.CHUNK_TARGET} AS room, length(piece) AS last1, NULL::BIGINT AS last2, 0::BIGINT AS lead FROM u WHERE i = 1
  UNION ALL
  SELECT u.doc_id, u.i, u.block_index, length(u.piece),
    CASE WHEN fits THEN g.chunk ELSE g.chunk + 1 END, CASE WHEN fits THEN g.used + length(u.piece) ELSE length(u.piece) END,
    CASE WHEN fits THEN g.room ELSE {K.CHUNK_TARGET} - {LEAD} - g.last1 - coalesce(g.last2, 0) END,
    CASE WHEN NOT fits THEN length(u.piece) WHEN u.block_index = g.block_index THEN g.last1 + length(u.piece) ELSE length(u.piece) END,
    CASE WHEN NOT fits THEN NULL WHEN u.block_index = g.block_index THEN g.last2 ELSE g.last1 END,
    CASE WHEN fits THEN g.lead ELSE {LEAD} + g.last1 + coalesce(g.last2, 0) END
  FROM (SELECT g.*, g.used + length(v.piece) <= g.room AS fits FROM g JOIN u v ON v.doc_id = g.doc_id AND v.i = g.i + 1) g JOIN u ON u.doc_id = g.doc_id AND u.i = g.i + 1),
h AS (
  SELECT doc_id, chunk AS chunk_index, min(block_index) AS first_block, max(block_index) AS last_block, count(DISTINCT block_index) AS n_blocks,
    any_value(lead) + sum(n) + count(DISTINCT block_index) - 1 AS char_count
  FROM g GROUP BY doc_id, chunk),
e AS (SELECT *, least(coalesce(lag(n_blocks) OVER (PARTITION BY doc_id ORDER BY chunk_index), 0), {K.OVERLAP}) AS n_overlap FROM h)"""


RECORDS = f"""r AS (SELECT o_orderkey AS record_id, o_custkey AS task_id, o_orderpriority AS author, CASE WHEN o_orderstatus = 'P' THEN '{K.RECORD_COMPARE}' ELSE '{K.RECORD_STANDARD}' END AS task_type FROM orders)"""
REJECTIONS = f"""x AS (
  SELECT event_id AS feedback_id, {picked(C.TYPES, "event_id")} AS issue_type, CASE WHEN event_id % 7 > 0 THEN event_id * CASE WHEN event_id % 10 = 0 THEN -1 ELSE 1 END END AS source_record_id
  FROM events WHERE event_type = 'error')"""
FEEDBACK = f"{RECORDS}, {REJECTIONS}, y AS (SELECT x.*, r.task_type AS source_task_type FROM x LEFT JOIN r ON x.source_record_id = r.record_id)"
STATUS = f"CASE l_returnflag WHEN 'A' THEN '{K.ACCEPTED}' WHEN 'R' THEN '{K.REJECTED}' ELSE '{K.PENDING}' END"
PAGES = """pg AS (
  SELECT *, block_index // 12 + 1 AS page, block_index % 12 AS i, CASE block_index % 12 WHEN 0 THEN 'top' WHEN 11 THEN 'bottom' ELSE 'body' END AS zone FROM b)"""
BOXES = f"""{BLOCKS}, {PAGES},
bx AS (
  SELECT doc_id, page, block_index AS ord, zone, CASE WHEN length(text) < 40 THEN 14.0 ELSE 10.0 END::DOUBLE AS avg_size,
    (CASE WHEN block_index % 7 = 3 THEN 50 ELSE 50 + 460 * (i % 2) END)::DOUBLE AS x0, (CASE WHEN block_index % 7 = 3 THEN 950 ELSE 490 + 460 * (i % 2) END)::DOUBLE AS x1,
    ((i * 5) % 12 * 60 + 40)::DOUBLE AS y0 FROM pg)"""

#: What the stand-in for the model is asked: n, the length of the question, and body, with the hint of a second try.
ANSWERS = f"""px AS (SELECT g.doc_id, g.chunk, g.i, g.block_index, u.piece, lag(g.block_index) OVER (PARTITION BY g.doc_id, g.chunk ORDER BY g.i) AS before FROM g JOIN u ON u.doc_id = g.doc_id AND u.i = g.i),
py AS (SELECT doc_id, chunk, string_agg(CASE WHEN before <> block_index THEN chr(10) || piece ELSE piece END, '' ORDER BY i) AS body FROM px GROUP BY doc_id, chunk),
pz AS (
  SELECT e.doc_id, e.chunk_index, e.char_count::BIGINT + CASE WHEN e.char_count % 17 = 0 THEN {len(RETRY_HINT)} ELSE 0 END AS n,
    py.body || CASE WHEN e.char_count % 17 = 0 THEN '{RETRY_HINT}' ELSE '' END AS body, py.body AS bare
  FROM e JOIN py ON py.doc_id = e.doc_id AND py.chunk = e.chunk_index)"""

SQL = {
    "blocks_from_documents": f"WITH {BLOCKS} SELECT doc_id, block_index, text FROM b",
    "context_snippet": f"WITH {BLOCKS} SELECT doc_id, block_index, string_agg(text, chr(10) ORDER BY block_index) OVER (PARTITION BY doc_id ORDER BY block_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS snippet FROM b".replace("string_agg(text, chr(10) ORDER BY block_index)", "string_agg(text, chr(10))"),
    "ws_strip_dedup_key": f"WITH {BLOCKS} SELECT doc_id, block_index, {no_space('text')} AS key FROM b",
    "compare_normalize": f"SELECT doc_id, {normalised('text')} AS normalized FROM documents",
    "sentence_split_offsets": f"WITH {sentences('documents')} SELECT doc_id, seq, start, sentence FROM s",
    "stream_block_asof": f"WITH {PIECES}, {sentences('t')} SELECT s.doc_id, s.seq, s.start, q.block_index FROM s ASOF JOIN (SELECT doc_id, start::BIGINT AS start, block_index FROM q) q ON s.doc_id = q.doc_id AND s.start >= q.start",
    "unreadable_clause_drop": f"WITH {BLOCKS} SELECT doc_id, block_index, CASE WHEN contains(text, 'z') THEN array_to_string(list_filter({cut('text')}, lambda x: NOT contains(x, 'z')), '') ELSE text END AS readable FROM b",
    "oversized_split": f"WITH RECURSIVE {oversized(200)} SELECT doc_id, block_index, unnest(range(len(pieces))) AS piece_no, unnest(pieces) AS piece FROM o",
    "chunk_greedy_overlap": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_index, first_block, last_block, n_blocks, n_overlap, char_count FROM e",
    "chunk_tail_blocks": f"WITH RECURSIVE {CHUNKS} SELECT DISTINCT doc_id, last_block AS block_index FROM (SELECT *, max(chunk_index) OVER (PARTITION BY doc_id) AS m FROM e) WHERE chunk_index < m",
    "chunk_owner": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, block_index, min(chunk) AS chunk_index FROM g GROUP BY doc_id, block_index",
    "chunk_sizes": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, count(*) AS n_chunks, round(avg(char_count), 4) AS avg_chars, max(char_count) AS max_chars FROM e GROUP BY doc_id",
    "locate_snippet": f"""WITH {BLOCKS},
n AS (SELECT doc_id, block_index, {no_space("text")} AS t FROM b),
c AS (SELECT DISTINCT i.item_id, d.doc_id, {no_space("i.text")} AS s FROM benchmark i JOIN documents d ON contains({no_space("d.text")}, {no_space("i.text")})),
l AS (SELECT doc_id, block_index, t, lead(t, 1) OVER w AS t2, lead(t, 2) OVER w AS t3 FROM n WHERE doc_id IN (SELECT doc_id FROM c) WINDOW w AS (PARTITION BY doc_id ORDER BY block_index)),
r AS (
  SELECT doc_id, block_index, 1 AS win, t FROM l UNION ALL SELECT doc_id, block_index, 2, t || t2 FROM l WHERE t2 IS NOT NULL
  UNION ALL SELECT doc_id, block_index, 3, t || t2 || t3 FROM l WHERE t3 IS NOT NULL),
h AS (SELECT c.doc_id, c.item_id, r.block_index, r.win, row_number() OVER (PARTITION BY c.doc_id, c.item_id ORDER BY r.win, r.block_index) AS n FROM c JOIN r ON c.doc_id = r.doc_id AND contains(r.t, c.s))
SELECT doc_id, item_id, block_index, win AS "window" FROM h WHERE n = 1""",
    "control_char_filter": f"WITH {FINDINGS} SELECT doc_id, count(*) AS n_kept FROM f WHERE NOT regexp_matches(original_text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]') GROUP BY doc_id",
    "linewrap_artifact": f"WITH {FINDINGS} SELECT f.doc_id, f.ord FROM f JOIN b ON f.doc_id = b.doc_id AND f.block_index = b.block_index WHERE contains(f.original_text, ' ') AND NOT contains(b.text, f.original_text) AND contains(replace(b.text, chr(10), ''), replace(f.original_text, ' ', ''))",
    "recency_filter": f"""WITH {FINDINGS},
y AS (SELECT *, list_transform(regexp_extract_all(original_text, '(?:19|20)[0-9][0-9]'), lambda x: x::INT) AS a, list_transform(regexp_extract_all(reason || suggestion, '(?:19|20)[0-9][0-9]'), lambda x: x::INT) AS z FROM f)
SELECT doc_id, ord, issue_type FROM y WHERE (category = 'factual' OR issue_type = '{K.TYPE_FACT}') AND {any_of("reason || suggestion", K.RECENCY_WORDS)}
  AND list_max(CASE WHEN len(a) > 0 THEN a ELSE z END) BETWEEN {K.CUTOFF_YEAR + 1} AND {K.CUTOFF_YEAR + K.GRACE_YEARS}""",
    "boundary_truncation": f"""WITH RECURSIVE {CHUNKS}, {FINDINGS[len(BLOCKS) + 1:]},
v AS (SELECT DISTINCT doc_id, last_block FROM (SELECT *, max(chunk_index) OVER (PARTITION BY doc_id) AS m FROM e) WHERE chunk_index < m)
SELECT f.doc_id, f.ord FROM f JOIN v ON f.doc_id = v.doc_id AND f.block_index = v.last_block JOIN b ON b.doc_id = f.doc_id AND b.block_index = f.block_index
WHERE right(b.text, 1) NOT IN ('!', '?') AND {strip("f.original_text")} <> '' AND ends_with(b.text, {strip("f.original_text")})""",
    "drop_reason_counts": f"WITH {FINDINGS} SELECT {WHY} AS why, count(*) AS n FROM f GROUP BY 1",
    "classify_base": f"WITH {FINDINGS}, {classified(K.DEEP, 'c1')}, {classified(K.SIMPLIFIED, 'c2')} SELECT m AS mode, doc_id, ord, layer, priority, new_suggestion AS suggestion, array_to_string(notes, '|') AS notes FROM (SELECT '{K.DEEP}' AS m, * FROM c1 UNION ALL SELECT '{K.SIMPLIFIED}' AS m, * FROM c2)",
    "classify_modifiers": f"WITH {final()} SELECT doc_id, ord, layer, priority, suggestion, n_notes FROM m",
    "conservative_dedup": f"WITH {final()} SELECT doc_id, ord, position, block_index, layer FROM d",
    "issue_sort": f"WITH {final()} SELECT doc_id, seq, ord FROM z",
    "record_stats": f"WITH {final()} SELECT doc_id, count(*) AS total_issues, " + ", ".join(f"count(*) FILTER (layer = '{a}') AS {n}" for a, n in zip(K.LAYERS, ("count_confirmed", "count_doubtful", "count_quotation", "count_optional"), strict=True)) + f", count(*) FILTER (priority = '{K.HIGH}') AS high_priority_count FROM z GROUP BY doc_id",
    "layer_groups": f"WITH {final()} SELECT list_position({texts(K.LAYERS)}, layer) - 1 AS place, layer, priority, count(*) AS n FROM z GROUP BY layer, priority",
    "records_by_task": "SELECT o_custkey AS task_id, count(*) AS n_records FROM orders GROUP BY o_custkey",
    "accepted_rejected_counts": "SELECT l_orderkey AS record_id, count(*) FILTER (l_returnflag = 'A') AS accepted_count, count(*) FILTER (l_returnflag = 'R') AS rejected_count FROM lineitem GROUP BY l_orderkey",
    "authors_union": "SELECT c_mktsegment AS name FROM customer WHERE c_mktsegment <> '' UNION SELECT o_orderpriority FROM orders WHERE o_orderpriority <> ''",
    "feedback_left_join": f"WITH {FEEDBACK} SELECT feedback_id, issue_type, source_record_id, source_task_type FROM y",
    "feedback_eligible": f"WITH {FEEDBACK} SELECT feedback_id FROM y WHERE issue_type NOT IN ({texts(K.EXEMPT_TYPES)[1:-1]}) AND source_task_type IS DISTINCT FROM '{K.RECORD_COMPARE}'",
    "rules_min_support": f"SELECT user_id AS rule_id, count(*) AS n_ids, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= {K.REJECTION_THRESHOLD}",
    "followup_last_turns": f"""SELECT conv_id AS issue_id, string_agg('Q: ' || role || chr(10) || 'A: ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) FILTER (n <= {K.HISTORY_TURNS}) AS transcript, count(*) AS turns
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS n FROM conversations) GROUP BY conv_id""",
    "export_projection": f"""SELECT l_orderkey AS record_id, l_orderkey * 10 + l_linenumber AS issue_id, CASE WHEN n % 5 > 0 THEN '第' || l_linenumber || '页' ELSE '{K.UNLOCATED}' END AS page_location,
  'part ' || l_partkey AS original_text, {picked(C.TYPES, "n")} AS issue_type, {picked(K.PRIORITIES, "n")} AS priority, {picked(K.LAYERS, "l_suppkey")} AS layer, 'supplier ' || l_suppkey AS suggestion, {STATUS} AS status,
  CASE WHEN n % 3 = 0 THEN 'seen' ELSE '' END AS note, CASE WHEN {picked(K.PRIORITIES, "n")} = '{K.HIGH}' THEN 'FFFFC7CE' WHEN {picked(K.LAYERS, "l_suppkey")} = '{K.QUOTATION}' THEN 'FFFFF2CC' END AS fill
FROM (SELECT *, l_partkey + l_linenumber AS n FROM lineitem) WHERE l_returnflag = 'A'""",
    "retention_topk": f"SELECT user_id, event_id::VARCHAR AS path FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR DESC) AS n FROM events) WHERE n > {K.KEEP_FILES}",
    "latest_values": "SELECT user_id, event_type, arg_max(props, event_id) AS props FROM events GROUP BY user_id, event_type",
    "header_footer_strip": f"""WITH {BLOCKS}, {PAGES}, s AS (SELECT pg.*, documents.source FROM pg JOIN documents USING (doc_id)),
o AS (SELECT source, text FROM s WHERE zone <> 'body' GROUP BY source, text HAVING count(DISTINCT doc_id) >= 2)
SELECT s.source, s.doc_id AS page, s.block_index FROM s LEFT JOIN o ON s.source = o.source AND s.text = o.text
WHERE s.zone = 'body' OR (o.text IS NULL AND NOT regexp_matches(s.text, '^[0-9IVXLCDMivxlcdm.\\s-]{{1,10}}$'))""",
    "reading_order": f"""WITH {BOXES},
g AS (
  SELECT *, x1 - x0 > 700 AS wide, CASE WHEN (x0 + x1) / 2 >= 500 THEN 1 ELSE 0 END AS c,
    (SELECT count(*) FROM bx o WHERE o.doc_id = bx.doc_id AND o.page = bx.page AND o.x1 - o.x0 > 700 AND (o.y0 < bx.y0 OR (o.y0 = bx.y0 AND (bx.x1 - bx.x0 <= 700 OR o.ord < bx.ord)))) AS k FROM bx)
SELECT doc_id, page, ord, CASE WHEN wide THEN 'span' WHEN c = 0 THEN 'left' ELSE 'right' END AS "column",
  row_number() OVER (PARTITION BY doc_id, page ORDER BY k, wide, CASE WHEN wide THEN 0 ELSE c END, y0, ord) - 1 AS place FROM g""",
    "block_kinds": f"""WITH {BOXES}, m AS (SELECT *, median(avg_size) OVER (PARTITION BY doc_id, page) AS body_size FROM bx)
SELECT doc_id, page, ord, body_size, CASE WHEN avg_size > 1.15 * body_size THEN 'heading' WHEN zone = 'bottom' AND avg_size < 0.9 * body_size THEN 'footnote' ELSE 'paragraph' END AS block_type FROM m""",
    "majority_layout": f"""WITH {BLOCKS}, {PAGES}, m AS (SELECT doc_id, page, CASE WHEN sum(length(text)) % 3 = 0 THEN 'single' ELSE 'double' END AS mode FROM pg GROUP BY doc_id, page)
SELECT doc_id, CASE WHEN 2 * count(*) FILTER (mode = 'single') > count(*) THEN 'single' WHEN 2 * count(*) FILTER (mode = 'double') > count(*) THEN 'double' ELSE 'mixed' END AS layout_mode FROM m GROUP BY doc_id""",
    "region_assignment": f"""WITH {BOXES}, r AS (SELECT i AS region, (i % 2) * 500 AS a, (i // 2) * 200 AS c FROM range(6) t(i)),
j AS (
  SELECT doc_id, page, ord, region, greatest(a - x, 0, x - a - 520) AS dx, greatest(c - y, 0, y - c - 260) AS dy
  FROM (SELECT *, (x0 + x1) / 2 AS x, y0 + 25 AS y FROM bx), r)
SELECT doc_id, page, ord AS line, region FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY dx * dx + dy * dy, region) AS n FROM j) WHERE n = 1""",
    "noise_metrics": f"""WITH {BLOCKS}, p AS (
  SELECT doc_id, (coalesce(right(lag(text) OVER (PARTITION BY doc_id ORDER BY block_index), 1) NOT IN ('.', '!', '?'), FALSE))::INT AS a, length(text) - length(replace(text, 'z', '')) AS d,
    regexp_matches(text, '《\\s|[0-9]\\s*《\\s*\\.')::INT AS c,
    CASE WHEN contains(text, 'z') THEN length(text) - length(array_to_string(list_filter({cut("text")}, lambda x: NOT contains(x, 'z')), '')) ELSE 0 END AS e FROM b)
SELECT doc_id, sum(a)::BIGINT AS mid_sentence_breaks, 0::BIGINT AS location_breaks, sum(c)::BIGINT AS bracket_misorder, sum(d)::BIGINT AS unreadable_marks, sum(e)::BIGINT AS excluded_chars, count(*) AS n_blocks FROM p GROUP BY ROLLUP (doc_id)""",
    "file_fingerprint_md5": "SELECT doc_id, md5(coalesce(text, '')) AS fingerprint, md5(coalesce(text, '') || source) AS pair_fingerprint FROM documents",
    "format_dispatch": f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'pdf' ELSE 'docx' END AS kind, CASE WHEN length({strip('text')}) >= 200 THEN 'native' ELSE 'ocr' END AS route FROM documents",
    "variant_fold": "SELECT doc_id, md5(coalesce(text, '')) AS folded_md5, md5(regexp_replace(coalesce(text, ''), '[\\x00-\\x09\\x0b-\\x1f\\x7f]', '', 'g')) AS clean_md5 FROM documents",
    "overlap_routing": f"""WITH RECURSIVE {CHUNKS},
px AS (
  SELECT g.doc_id, g.chunk, g.i, g.block_index, u.piece, lag(g.block_index) OVER (PARTITION BY g.doc_id, g.chunk ORDER BY g.i) AS before,
    dense_rank() OVER (PARTITION BY g.doc_id, g.chunk ORDER BY g.block_index DESC) AS back
  FROM g JOIN u ON u.doc_id = g.doc_id AND u.i = g.i),
py AS (
  SELECT doc_id, chunk, string_agg(CASE WHEN before <> block_index THEN chr(10) || piece ELSE piece END, '' ORDER BY i) AS body,
    string_agg(piece, '' ORDER BY i) FILTER (back <= {K.OVERLAP}) AS tail FROM px GROUP BY doc_id, chunk),
pz AS (SELECT y.doc_id, y.body, p.tail, unnest([p.tail[1:30], y.body[1:30], '§ ' || y.doc_id]) AS snippet FROM py y JOIN py p ON p.doc_id = y.doc_id AND p.chunk = y.chunk - 1)
SELECT doc_id, CASE WHEN contains({no_space("body")}, {no_space("snippet")}) THEN 'body' WHEN contains({no_space("tail")}, {no_space("snippet")}) THEN 'drop' ELSE 'unlocated' END AS route, count(*) AS n
FROM pz GROUP BY 1, 2""",
    "noise_delta": f"""WITH {FINDINGS},
fo AS (SELECT doc_id, original_text[1:6] || chr(10) || original_text[7:46] AS o, original_text[1:6] || original_text[7:46] AS s FROM f),
fn AS (
  SELECT doc_id, length(o) >= 40 AS long, (regexp_matches(o, '《{SPACE}') OR regexp_matches(o, '[0-9]{SPACE}*《{SPACE}*\\.'))::INT AS c,
    len(list_filter(range(1, length(s) - 2), lambda i: contains(s, s[i:i + 3]) AND NOT contains(o, s[i:i + 3]))) > 0
      OR (length(o) >= 11 AND contains(s, o[3:6]) AND contains(s, o[8:11])) AS wrap
  FROM fo),
fg AS (SELECT doc_id, count(*) AS total, sum(c)::BIGINT AS n1, 0::BIGINT AS n2, count(*) FILTER (wrap AND long) AS n3_long, count(*) FILTER (wrap AND NOT long) AS n3_short FROM fn GROUP BY doc_id)
SELECT a.doc_id AS baseline, b.doc_id AS current, b.total - a.total AS d_total, b.n1 - a.n1 AS d_n1, b.n2 - a.n2 AS d_n2, b.n3_long - a.n3_long AS d_n3_long, b.n3_short - a.n3_short AS d_n3_short
FROM fg a JOIN fg b ON b.doc_id = a.doc_id + 1""",
    "glyph_lines": f"""WITH {BLOCKS},
r1 AS (SELECT doc_id, block_index, regexp_replace(text, '([A-Za-z0-9])[\\x00-\\x1f]([A-Za-z0-9])', '\\1 \\2', 'g') AS t FROM b),
r2 AS (SELECT doc_id, block_index, regexp_replace(t, '([A-Za-z0-9])[\\x00-\\x1f]([A-Za-z0-9])', '\\1 \\2', 'g') AS t FROM r1)
SELECT doc_id, block_index, {strip("t")} AS line FROM r2""",
    "finding_counts": f"WITH {FINDINGS} SELECT doc_id, category, count(*) AS n, count(*) FILTER (NOT located) AS n_unlocated FROM f GROUP BY doc_id, category",
    "text_source_rollup": f"""WITH {BLOCKS}, {PAGES}, m AS (SELECT doc_id, page, CASE WHEN sum(length(text)) % 4 = 0 THEN 'ocr' ELSE 'native' END AS route FROM pg GROUP BY doc_id, page)
SELECT d.doc_id, CASE WHEN count(DISTINCT m.route) = 1 THEN any_value(m.route) ELSE 'mixed' END AS text_source FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id""",
    "result_summary": f"WITH {final()}, st AS (SELECT doc_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (layer = '{a}') AS n{i}" for i, a in enumerate(K.LAYERS)) + f""", count(*) FILTER (priority = '{K.HIGH}') AS high FROM z GROUP BY doc_id)
SELECT d.doc_id, '本次共发现 ' || coalesce(total, 0) || ' 处：' || {" || '、' || ".join(f"'{a} ' || coalesce(n{i}, 0)" for i, a in enumerate(K.LAYERS))} || '（其中高优先级 ' || coalesce(high, 0) || '）。' AS summary,
  CASE WHEN coalesce(total, 0) = 0 AND d.doc_id % 3 = 0 THEN '本次结果为0条问题，但同时有1条处理失败/异常提示' END AS alarm
FROM documents d LEFT JOIN st ON d.doc_id = st.doc_id""",
    "issue_cards": f"""SELECT l_orderkey AS record_id, l_orderkey * 10 + l_linenumber AS issue_id, CASE WHEN n % 5 > 0 THEN '第' || l_linenumber || '页' ELSE '{K.UNLOCATED}' END AS page_location,
  'part ' || l_partkey AS original_text, '&lt;b a=&#x27;1&#x27;&gt;&amp;&quot;supplier ' || l_suppkey AS suggestion, CASE WHEN n % 3 = 0 THEN 'seen' ELSE '' END AS note, 0 AS n_notes
FROM (SELECT *, l_partkey + l_linenumber AS n FROM lineitem)""",
    "dangling_tasks": "SELECT o_orderkey AS record_id, o_custkey AS task_id FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 7)",
    "export_file_name": "SELECT o_orderkey AS record_id, strftime(o_orderdate::TIMESTAMP, '%Y%m%d%H%M%S') || '_' || CASE WHEN o_orderkey % 9 > 0 THEN 'a_b_' || o_orderkey ELSE '未命名文档' END || '_校对清单.xlsx' AS file_name FROM orders",
    "zone_of_block": f"WITH {BOXES} SELECT doc_id, page, ord, CASE WHEN y0 + 50 <= {K.ZONE_RATIO} * 800 THEN 'top' WHEN y0 >= (1 - {K.ZONE_RATIO}) * 800 THEN 'bottom' ELSE 'body' END AS zone FROM bx",
    "open_tasks": f"SELECT c_custkey AS task_id, {picked(K.STATUSES_TASK, 'c_custkey')} AS status FROM customer WHERE c_custkey % 3 <> 2",
    "task_names_twice": "SELECT 'task ' || c_nationkey AS name, count(*) AS n FROM customer WHERE c_custkey % 3 <> 2 GROUP BY c_nationkey HAVING count(*) > 1",
    "issue_filters": f"SELECT l_orderkey AS record_id, l_orderkey * 10 + l_linenumber AS issue_id FROM lineitem WHERE l_suppkey % {len(K.LAYERS)} = 1 AND l_returnflag NOT IN ('A', 'R')",
    "fabricated_glyphs": f"WITH {BOXES} SELECT doc_id, page, ord FROM bx WHERE ord % 6 = 0",
    "same_rows": f"""WITH {BOXES}
SELECT a.doc_id, a.ord, least(a.y0, b.y0) + 50 - greatest(a.y0, b.y0) >= 25 AND greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 150 AS same
FROM bx a JOIN bx b ON a.doc_id = b.doc_id AND a.page = b.page AND b.ord = a.ord + 1""",
    "block_location": f"""WITH {BOXES}
SELECT doc_id, ord, '第' || page || '页' || CASE WHEN page % 2 = 0 THEN '' WHEN x1 - x0 > 700 THEN '通栏' WHEN (x0 + x1) / 2 < 500 THEN '左栏' ELSE '右栏' END AS source_location FROM bx""",
    "label_types": f"SELECT doc_id, CASE WHEN label IN ({texts(K.DROPPED_LABELS)[1:-1]}) THEN NULL " + " ".join(f"WHEN label IN ({texts(v)[1:-1]}) THEN '{k}'" for k, v in K.LABEL_TYPES.items()) + f" ELSE 'other' END AS block_type FROM (SELECT doc_id, {picked(C.LABELS, 'coalesce(doc_id, 0)')} AS label FROM documents)",
    "unsure_scraps": f"WITH {BLOCKS} SELECT doc_id, block_index FROM b WHERE NOT (block_index % 10 / 10 < {K.OCR_DROP_CONFIDENCE} AND length(text) < {K.OCR_DROP_CHARS})",
    "repair_report": f"WITH {BLOCKS}, r AS (SELECT (doc_id + block_index) % 11 AS k FROM b) SELECT round(k / 10, 1) AS rate, count(*) AS lines, " + ", ".join(f"CASE WHEN k >= {g // 10} THEN count(*) ELSE 0 END AS kept_{g}" for g in (0, 50, 70, 80, 90, 100)) + " FROM r GROUP BY k",
    "llm_map_fake": f"""WITH RECURSIVE {CHUNKS},
{ANSWERS}
SELECT doc_id, chunk_index, CASE WHEN n % 17 = 0 THEN -1 ELSE 0 END AS item, CASE WHEN n % 17 > 0 THEN {strip("body")}[1:20] END AS original_text, CASE WHEN n % 17 > 0 THEN {picked(C.TYPES, "n")} END AS issue_type,
  CASE WHEN n % 17 = 0 THEN 'ReplyError: Expecting value: line 1 column 1 (char 0)' END AS error
FROM pz""",
    "model_findings": f"""WITH RECURSIVE {CHUNKS},
{ANSWERS},
za AS (SELECT doc_id, chunk_index, {strip("body")}[1:20] AS original_text, bare FROM pz WHERE n % 17 > 0),
zb AS (SELECT DISTINCT g.doc_id, g.chunk, g.block_index, {no_space("b.text")} AS t FROM g JOIN b ON b.doc_id = g.doc_id AND b.block_index = g.block_index),
zl AS (SELECT *, lead(t, 1) OVER w AS t2, lead(t, 2) OVER w AS t3 FROM zb WINDOW w AS (PARTITION BY doc_id, chunk ORDER BY block_index)),
zw AS (
  SELECT doc_id, chunk, block_index, 1 AS win, t FROM zl UNION ALL SELECT doc_id, chunk, block_index, 2, t || t2 FROM zl WHERE t2 IS NOT NULL
  UNION ALL SELECT doc_id, chunk, block_index, 3, t || t2 || t3 FROM zl WHERE t3 IS NOT NULL),
zh AS (
  SELECT za.doc_id, za.chunk_index, min_by(zw.block_index, zw.win * 1000000000::BIGINT + zw.block_index) AS block_index
  FROM za JOIN zw ON zw.doc_id = za.doc_id AND zw.chunk = za.chunk_index AND contains(zw.t, {no_space("za.original_text")}) AND contains({no_space("za.bare")}, {no_space("za.original_text")})
  GROUP BY ALL)
SELECT za.doc_id, za.chunk_index, za.chunk_index::BIGINT * 1000000 AS ord, za.original_text, zh.block_index, '第' || (zh.block_index + 1) || '段' AS page_location, zh.block_index IS NOT NULL AS located
FROM za LEFT JOIN zh ON zh.doc_id = za.doc_id AND zh.chunk_index = za.chunk_index""",
}
