"""The same queries as SQL over the test tables."""

from __future__ import annotations

from supportgraph.functions.rules import (
    CATEGORIES,
    CATEGORY_UNKNOWN,
    DESCRIPTION_EMPTY,
    FALLBACK_TITLE,
    TITLE_MAX_CHARS,
    TITLE_MAX_WORDS,
    TITLE_TOO_LONG,
    TITLE_TOO_MANY_WORDS,
)
from supportgraph.operators.search import Planes
from workloads.queries import NEW_PROMPT
from workloads.tables import DIM, OPTIONS, RELATED_FROM, TEXT_OPTIONS

PLANES = Planes(DIM)


# The gate's wording, written out: a slip in the library's lists must not be repeated here.
_ASKS_FOR_HELP = (
    "access|bug|bugs|can't|cant|cannot|crash|crashes|crashed|crashing|denied|error|errors|fail|fails|failed|"
    "failing|failure|feature|features|freeze|freezes|freezing|how can|how do|how should|how to|issue|issues|"
    "login|log in|not work|not working|password|permission|permissions|problem|problems|slow|timeout|timeouts|"
    "upload|wrong"
)
_CHATS = (
    "bye|goodbye|good morning|good afternoon|good evening|hello|hey|hi|how are you|thanks|thank you|what is|"
    "who are you"
)


def _wording(words: str) -> str:
    return "regexp_matches(lower(question), " + _text(f"(^|[^a-z])({words})([^a-z]|$)") + ")"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


# --- node tables --------------------------------------------------------------------------------

USERS = """users AS (
  SELECT 'c' || c_custkey AS userId, c_mktsegment AS role FROM customer
  UNION ALL
  SELECT 's' || s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

TICKETS = """tickets AS (
  SELECT o_orderkey AS ticketId,
         concat_ws(' ', 'Order', o_orderkey, o_orderpriority) AS title,
         text AS description,
         CASE WHEN o_orderpriority <> '5-LOW'
              THEN 'Filled for customer ' || o_custkey END AS resolutionSummary,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS resolvedDate,
         'c' || o_custkey AS createdByUserId,
         CASE WHEN o_orderstatus <> 'O' THEN 's' || (o_custkey % 100) END AS assignedToUserId,
         o_orderstatus AS statusId,
         o_orderpriority AS priorityId,
         'Brand#' || (o_orderkey % 28) AS categoryId
  FROM orders LEFT JOIN documents ON doc_id = o_orderkey)"""

COMMENTS = """comments AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   strftime(l_shipdate, '%Y%m%d')) AS commentId,
         concat_ws(' ', 'part', l_partkey, 'quantity', CAST(l_quantity AS INTEGER)) AS content,
         l_shipdate AS creationDate,
         l_returnflag = 'R' AS isSolution,
         l_orderkey AS ticketId,
         's' || l_suppkey AS authorUserId,
         CASE WHEN l_linestatus = 'O' THEN 'p' || l_partkey END AS articleId
  FROM lineitem)"""

ARTICLES = """articles AS (
  SELECT 'p' || p_partkey AS articleId, p_brand AS categoryId FROM part)"""

# --- search -------------------------------------------------------------------------------------

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S+00:00')"


def _scores(mode: str = "normalized") -> str:
    cosine = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
    value = f"(1 + {cosine}) / 2" if mode == "normalized" else cosine
    return f"""scores AS (
  SELECT q.vec_id AS query_id, v.vec_id AS ticketId, round({value}, 9) AS score
  FROM embeddings q, embeddings v)"""


def _hits(k: int, min_score: float, pre: bool = False, source: str = "scores") -> str:
    join = "JOIN orders ON o_orderkey = ticketId AND o_orderstatus = 'F'" if pre else ""
    return f"""hits AS (
  SELECT query_id, ticketId, score FROM (
    SELECT query_id, ticketId, score, row_number() OVER (
      PARTITION BY query_id ORDER BY score DESC, ticketId) AS place
    FROM {source} {join})
  WHERE place <= {k} AND score >= {min_score})"""


def _context(limit: int) -> str:
    return f"""context AS MATERIALIZED (
  SELECT * FROM (
    SELECT s.ticketId, s.commentId AS solutionId, c.commentId, c.content, c.creationDate,
           c.authorUserId,
           row_number() OVER (PARTITION BY s.commentId
                              ORDER BY c.creationDate DESC, c.commentId) AS position
    FROM comments s JOIN comments c
      ON c.ticketId = s.ticketId AND c.creationDate < s.creationDate
    WHERE s.isSolution)
  WHERE position <= {limit})"""


_COLLECTED = f"""collected AS (
  SELECT solutionId,
         string_agg(commentId, ',' ORDER BY position) AS contextIds,
         string_agg(content, ',' ORDER BY position) AS contextTexts,
         string_agg({_ISO.format('creationDate')}, ',' ORDER BY position) AS contextDates,
         string_agg(role, ',' ORDER BY position) AS contextRoles,
         string_agg('- ' || role || ': ' || content, chr(10) ORDER BY position) AS contextLines,
         '[' || string_agg(
           '{{"commentId":"' || commentId || '","content":"' || content || '","creationDate":"'
           || {_ISO.format('creationDate')} || '","author":{{"role":"' || role || '"}}}}',
           ',' ORDER BY position) || ']' AS contextJson,
         count(*) AS contextCount
  FROM context LEFT JOIN users ON userId = authorUserId GROUP BY solutionId)"""

_RESULTS = f"""results AS MATERIALIZED (
  SELECT h.query_id, t.ticketId, t.title, t.description, t.resolutionSummary,
         h.score AS similarityScore, h.score,
         s.commentId AS solutionId, s.content AS solutionContent,
         {_ISO.format('s.creationDate')} AS solutionDate, u.role AS solutionRole,
         coalesce(contextIds, '') AS contextIds, coalesce(contextTexts, '') AS contextTexts,
         coalesce(contextDates, '') AS contextDates, coalesce(contextRoles, '') AS contextRoles,
         coalesce(contextCount, 0) AS contextCount, contextLines,
         coalesce(contextJson, '[]') AS contextJson
  FROM hits h
  JOIN tickets t ON t.ticketId = h.ticketId AND t.statusId = 'F'
  JOIN comments s ON s.ticketId = t.ticketId AND s.isSolution
  JOIN users u ON u.userId = s.authorUserId
  LEFT JOIN collected c ON c.solutionId = s.commentId)"""

_RESULT_COLUMNS = """query_id, ticketId, title, description, resolutionSummary, similarityScore,
  solutionId, solutionContent, solutionDate, solutionRole, contextIds, contextTexts, contextDates,
  contextRoles, contextCount"""


def _result_ctes(pre: bool = False) -> list[str]:
    return [
        USERS,
        TICKETS,
        COMMENTS,
        _scores(),
        _hits(OPTIONS.top_k, OPTIONS.min_score, pre),
        _context(OPTIONS.context_limit),
        _COLLECTED,
        _RESULTS,
    ]


_FROM_RESULTS = _ctes(*_result_ctes())

_RESULT_TEXT = """concat_ws(chr(10), 'TICKET: ' || title, 'Ticket ID: ' || ticketId,
         'Description: ' || coalesce(nullif(description, ''), 'No description'),
         'Resolution: ' || resolutionSummary,
         chr(10) || 'CONTEXT COMMENTS:' || chr(10) || contextLines,
         chr(10) || 'SOLUTION by ' || solutionRole || ':', solutionContent,
         chr(10) || 'Similarity Score: '
         || CAST(round(CAST(score AS DECIMAL(18, 9)), 3) AS DECIMAL(18, 3))) AS text"""

_TEXT_COLUMNS = f"""query_id, {_RESULT_TEXT}, ticketId AS ticket_id,
       similarityScore AS similarity_score, solutionId AS solution_comment_id,
       contextCount AS context_comment_count"""


def _topk(mode: str = "normalized", floor: float = -2) -> str:
    return f"""{_ctes(_scores(mode))}
SELECT query_id, ticketId, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ticketId) AS rank
  FROM scores) WHERE rank <= 5 AND score >= {floor}"""


# --- default embedding --------------------------------------------------------------------------

_WORD = r"[\p{L}\p{N}]+"
_SPACE = r"[\s\p{Z}]+"
_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _buckets(name: str, source: str, key: str, text: str) -> str:
    return f"""{name}_words AS (
  SELECT {key} AS id, unnest(regexp_extract_all(lower({text}), '{_WORD}')) AS token FROM {source}),
{name}_counts AS (
  SELECT id, CAST(('0x' || substr(md5(token), 1, 8))::BIGINT % {DIM} AS BIGINT) AS bucket,
         count(*) AS n
  FROM {name}_words GROUP BY ALL),
{name} AS (
  SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight FROM {name}_counts)"""


_QUESTIONS = """questions AS (
  SELECT concat_ws('-', conv_id, turn) AS query_id, text AS question
  FROM conversations WHERE role = 'user')"""

_TEXT_SCORES = """text_scores AS (
  SELECT q.id AS query_id, d.id AS ticketId, round((1 + sum(q.weight * d.weight)) / 2, 9) AS score
  FROM question_vectors q JOIN document_vectors d USING (bucket) GROUP BY ALL)"""


def _codes(name: str, vectors: str) -> str:
    """Buckets of an index: ``vectors`` has id, d and x for every part of a vector that is not
    zero."""
    return f"""{name} AS MATERIALIZED (
  SELECT id, p // {PLANES.bits} AS band,
         sum(CASE WHEN total >= -1e-9 THEN 1 << (p % {PLANES.bits}) ELSE 0 END) AS code
  FROM (SELECT id, p, sum(x * s) AS total FROM ({vectors}) JOIN signs USING (d) GROUP BY ALL)
  GROUP BY ALL)"""


_SIGNS = f"""signs AS MATERIALIZED (
  SELECT p, d, CASE WHEN substr(md5(p || ':' || d), 1, 1) < '8' THEN 1.0 ELSE -1.0 END AS s
  FROM range({PLANES.bands * PLANES.bits}) AS a(p), range({DIM}) AS b(d))"""


def _near(queries: str, tickets: str, scores: str) -> str:
    return f"""near_scores AS (
  SELECT * FROM {scores} WHERE (query_id, ticketId) IN (
    SELECT q.id, v.id FROM {queries} q JOIN {tickets} v USING (band, code)))"""


_DENSE = f"""SELECT id, d, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM (
  SELECT vec_id AS id, unnest(range({DIM})) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings)"""

_INDEXED = [_SIGNS, _codes("codes", _DENSE), _scores(), _near("codes", "codes", "scores")]

_APPROX_HITS = f"""{_ctes(*_INDEXED)},
found AS (
  SELECT query_id, ticketId, score, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ticketId) AS rank
    FROM near_scores) WHERE rank <= 5)"""


def _indexed_ctes() -> list[str]:
    return [
        USERS,
        TICKETS,
        COMMENTS,
        *_INDEXED,
        _hits(OPTIONS.top_k, OPTIONS.min_score, source="near_scores"),
        _context(OPTIONS.context_limit),
        _COLLECTED,
        _RESULTS,
    ]


_TEXT_INDEX = [
    _SIGNS,
    _codes("question_codes", "SELECT id, bucket AS d, weight AS x FROM question_vectors"),
    _codes("document_codes", "SELECT id, bucket AS d, weight AS x FROM document_vectors"),
    _near("question_codes", "document_codes", "text_scores"),
]


def _text_results(question_source: str, key: str, text: str, indexed: bool = False) -> list[str]:
    return [
        USERS,
        TICKETS,
        COMMENTS,
        _buckets("question_vectors", question_source, key, text),
        _buckets("document_vectors", "documents", "doc_id", "text"),
        _TEXT_SCORES,
        *(_TEXT_INDEX if indexed else []),
        _hits(
            TEXT_OPTIONS.top_k,
            TEXT_OPTIONS.min_score,
            source="near_scores" if indexed else "text_scores",
        ),
        _context(TEXT_OPTIONS.context_limit),
        _COLLECTED,
        _RESULTS,
    ]


_CATEGORY_VALUES = ", ".join(f"({_text(c)}, {_text(topic)})" for c, topic in CATEGORIES)

_TITLE = (
    "array_to_string(list_slice(list_filter("
    f"regexp_split_to_array(question, '{_SPACE}'), lambda w: w <> ''), 1, {TITLE_MAX_WORDS}), ' ')"
)

def _triage(topics: str, related_from: float) -> list[str]:
    return [
        _QUESTIONS,
        f"topics AS ({topics})",
        _buckets("plain_vectors", "questions", "query_id", "question"),
        _buckets("topic_vectors", "topics", "code", "topic"),
        """pairs AS (
  SELECT q.id AS query_id, c.code, round(coalesce(sum(p.weight * w.weight), 0), 9) AS score
  FROM (SELECT DISTINCT id FROM plain_vectors) q CROSS JOIN topics c
  LEFT JOIN topic_vectors w ON w.id = c.code
  LEFT JOIN plain_vectors p ON p.id = q.id AND p.bucket = w.bucket
  GROUP BY ALL)""",
        """best AS (
  SELECT query_id, code, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code) AS place
    FROM pairs) WHERE place = 1)""",
        f"""analyzed AS (
  SELECT q.query_id, coalesce(score >= {related_from}, false) AS related, score,
         CASE WHEN score >= {related_from} THEN code END AS code,
         {_STRIP.format(f'substr({_TITLE}, 1, {TITLE_MAX_CHARS})')} AS title,
         {_STRIP.format('question')} AS stripped
  FROM questions q LEFT JOIN best b USING (query_id))""",
        f"""analysis AS (
  SELECT query_id, related AND stripped <> '' AS is_related,
         CASE WHEN stripped <> '' THEN code END AS category,
         CASE WHEN stripped <> '' THEN title ELSE {_text(FALLBACK_TITLE)} END AS title,
         CASE WHEN stripped <> '' THEN stripped
              ELSE {_text(DESCRIPTION_EMPTY)} END AS description,
         score AS category_score
  FROM analyzed)""",
    ]


_TRIAGE = _triage(f"SELECT * FROM (VALUES {_CATEGORY_VALUES}) AS v(code, topic)", RELATED_FROM)

_TABLE_TRIAGE = _triage(
    "SELECT DISTINCT p_brand AS code, p_brand || ' Parts of ' || p_brand AS topic FROM part", 0.05
)

_RELATED = """related AS (
  SELECT query_id, title || ' ' || description AS question FROM analysis WHERE is_related)"""

_GATED = f"""{_ctes(*_TRIAGE, _RELATED, *_text_results('related', 'query_id', 'question'))}
SELECT {_RESULT_COLUMNS} FROM results"""

# --- edges --------------------------------------------------------------------------------------


def _edge(name: str, src: str, dst: str, src_label: str, dst_label: str, tables: str) -> str:
    return (
        f"SELECT CAST({src} AS VARCHAR) AS src, CAST({dst} AS VARCHAR) AS dst, "
        f"'{name}' AS edge_type, '{src_label}' AS src_label, '{dst_label}' AS dst_label "
        f"FROM {tables}"
    )


_BRANDS = "(SELECT DISTINCT p_brand AS id FROM part)"

EDGES = "edges AS (\n  " + "\n  UNION ALL ".join(
    [
        _edge("SUBMITS", "userId", "ticketId", "user", "ticket",
              "tickets JOIN users ON createdByUserId = userId"),
        _edge("ASSIGNED_TO", "userId", "ticketId", "user", "ticket",
              "tickets JOIN users ON assignedToUserId = userId"),
        _edge("HAS_STATUS", "ticketId", "id", "ticket", "status",
              "tickets JOIN (SELECT DISTINCT o_orderstatus AS id FROM orders) ON statusId = id"),
        _edge("HAS_PRIORITY", "ticketId", "id", "ticket", "priority",
              "tickets JOIN (SELECT DISTINCT o_orderpriority AS id FROM orders) ON priorityId = id"),
        _edge("HAS_CATEGORY", "ticketId", "id", "ticket", "category",
              f"tickets JOIN {_BRANDS} ON categoryId = id"),
        _edge("CONTAINS", "t.ticketId", "commentId", "ticket", "comment",
              "comments c JOIN tickets t ON c.ticketId = t.ticketId"),
        _edge("POSTS", "userId", "commentId", "user", "comment",
              "comments JOIN users ON authorUserId = userId"),
        _edge("HAS_CATEGORY", "id", "articleId", "category", "article",
              f"articles JOIN {_BRANDS} ON categoryId = id"),
        _edge("REFERENCED_BY", "a.articleId", "commentId", "article", "comment",
              "comments c JOIN articles a ON c.articleId = a.articleId"),
    ]
) + ")"

_GRAPH = _ctes(USERS, TICKETS, COMMENTS, ARTICLES, EDGES)


def _missing(label: str, key: str, column: str, target: str, target_key: str) -> str:
    return (
        f"SELECT '{label}' AS label, CAST({key} AS VARCHAR) AS key, '{column}' AS \"column\", "
        f"CAST({column} AS VARCHAR) AS value FROM {label}s WHERE {column} IS NOT NULL AND NOT "
        f"EXISTS (SELECT 1 FROM {target} r WHERE r.{target_key} = {column})"
    )


_REFERENCES = "\nUNION ALL ".join(
    [
        _missing("ticket", "ticketId", "createdByUserId", "users", "userId"),
        _missing("ticket", "ticketId", "assignedToUserId", "users", "userId"),
        _missing("ticket", "ticketId", "categoryId", _BRANDS, "id"),
        _missing("comment", "commentId", "authorUserId", "users", "userId"),
        _missing("article", "articleId", "categoryId", _BRANDS, "id"),
    ]
)

_LAST_TURNS = """last_turns AS (
  SELECT conv_id, max(turn) AS last_turn,
         bool_or(role = 'system') AS has_system,
         arg_max(text, turn) FILTER (WHERE role = 'system') AS system_prompt
  FROM conversations GROUP BY conv_id)"""

_ASKED = """asked AS (
  SELECT conv_id, max(turn) AS question_id, arg_max(text, turn) AS question
  FROM conversations WHERE role = 'user' GROUP BY conv_id)"""

_HISTORY = """history AS (
  SELECT conv_id, turn, role, text AS content FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back
    FROM conversations)
  WHERE back <= 3 AND role IN ('user', 'assistant', 'system'))"""

_LINE_KEYS = "SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1"

_ANALYSIS_ERROR = f"""CASE
    WHEN category IS NOT NULL AND category NOT IN ({', '.join(_text(c) for c, _ in CATEGORIES)})
      THEN {_text(CATEGORY_UNKNOWN)}
    WHEN length(title) > {TITLE_MAX_CHARS} THEN {_text(TITLE_TOO_LONG)}
    WHEN len(list_filter(regexp_split_to_array(title, '{_SPACE}'), lambda w: w <> ''))
      > {TITLE_MAX_WORDS} THEN {_text(TITLE_TOO_MANY_WORDS)}
    WHEN {_STRIP.format('description')} = '' THEN {_text(DESCRIPTION_EMPTY)} END"""

_VECTOR_ERRORS = """SELECT vec_id AS ticketId, CASE vec_id % 7 WHEN 1 THEN 'missing'
  WHEN 2 THEN 'dimension' WHEN 3 THEN 'element' WHEN 4 THEN 'zero' END AS error FROM embeddings"""

ORACLE: dict[str, str] = {
    "retrieve_solutions": f"{_FROM_RESULTS} SELECT {_RESULT_COLUMNS} FROM results",
    "retrieve_prefilter": f"{_ctes(*_result_ctes(pre=True))} SELECT {_RESULT_COLUMNS} FROM results",
    "stream_questions": f"{_FROM_RESULTS} SELECT {_RESULT_COLUMNS} FROM results",
    "results_ordered": f"""{_FROM_RESULTS}
SELECT query_id, similarityScore, ticketId, solutionId FROM results""",
    "topk_similar": _topk(),
    "topk_shuffled": _topk(),
    "topk_raw_cosine": _topk("raw", 0.25),
    "context_window": f"""{_ctes(COMMENTS, _context(3))}
SELECT ticketId, solutionId, position, commentId FROM context""",
    "context_collect": f"""{_ctes(USERS, COMMENTS, _context(3), _COLLECTED)}
SELECT s.ticketId, s.commentId AS solutionId, u.role AS solutionRole,
       coalesce(contextIds, '') AS contextIds, coalesce(contextRoles, '') AS contextRoles,
       coalesce(contextCount, 0) AS contextCount
FROM comments s JOIN users u ON u.userId = s.authorUserId
LEFT JOIN collected c ON c.solutionId = s.commentId WHERE s.isSolution""",
    "result_text": f"{_FROM_RESULTS} SELECT {_TEXT_COLUMNS} FROM results",
    "result_json": f"{_FROM_RESULTS} SELECT {_RESULT_COLUMNS} FROM results",
    "result_sources": f"""{_ctes(USERS, TICKETS, COMMENTS, _scores(), _hits(OPTIONS.top_k, OPTIONS.min_score))},
found AS MATERIALIZED (
  SELECT h.query_id, h.score, t.ticketId, t.title, t.description, t.resolutionSummary,
         s.commentId AS solutionId, s.content AS solutionContent, s.creationDate AS solutionAt,
         u.role AS solutionRole
  FROM hits h JOIN tickets t ON t.ticketId = h.ticketId AND t.statusId = 'F'
  JOIN comments s ON s.ticketId = t.ticketId AND s.isSolution
  JOIN users u ON u.userId = s.authorUserId),
earlier AS MATERIALIZED (
  SELECT * FROM (
    SELECT f.ticketId, f.solutionId, c.commentId, c.content, c.creationDate, u.role,
           row_number() OVER (PARTITION BY f.ticketId, f.solutionId
                              ORDER BY c.creationDate DESC, c.commentId) AS position
    FROM (SELECT DISTINCT ticketId, solutionId, solutionAt FROM found) f
    JOIN comments c ON c.ticketId = f.ticketId AND c.creationDate < f.solutionAt
    LEFT JOIN users u ON u.userId = c.authorUserId)
  WHERE position <= {OPTIONS.context_limit}),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ticketId, solutionId) AS rank
  FROM found)
SELECT f.query_id, f.rank, f.ticketId, f.title, f.description, f.resolutionSummary, f.score AS similarityScore,
       f.solutionId, f.solutionContent, {_ISO.format('f.solutionAt')} AS solutionDate, f.solutionRole,
       e.position AS contextPosition, e.commentId AS contextId, e.content AS contextContent,
       {_ISO.format('e.creationDate')} AS contextDate, e.role AS contextRole
FROM ranked f LEFT JOIN earlier e USING (ticketId, solutionId)""",
    "hit_counts": f"""{_FROM_RESULTS}
SELECT vec_id AS query_id, count(r.query_id) AS n_results
FROM embeddings LEFT JOIN results r ON r.query_id = vec_id GROUP BY vec_id""",
    "retrieve_by_text": f"""{_ctes(_QUESTIONS, *_text_results('questions', 'query_id', 'question'))}
SELECT {_TEXT_COLUMNS} FROM results""",
    "retrieve_by_text_with_index": f"""
{_ctes(_QUESTIONS, *_text_results('questions', 'query_id', 'question', indexed=True))}
SELECT {_TEXT_COLUMNS} FROM results""",
    "approx_topk_hits": f"{_APPROX_HITS} SELECT * FROM found",
    "approx_recall": f"""{_APPROX_HITS},
exact AS (
  SELECT query_id, ticketId FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ticketId) AS rank
    FROM scores) WHERE rank <= 5)
SELECT query_id, count(*) AS expected, count(f.ticketId) AS found,
       count(f.ticketId) / count(*) AS recall
FROM exact LEFT JOIN found f USING (query_id, ticketId) GROUP BY query_id""",
    "retrieve_with_index": f"{_ctes(*_indexed_ctes())} SELECT {_RESULT_COLUMNS} FROM results",
    "stream_with_index": f"{_ctes(*_indexed_ctes())} SELECT {_RESULT_COLUMNS} FROM results",
    "topk_ties": f"""{_ctes(
        "kinds AS (SELECT doc_id, concat_ws(' ', lang, source) AS kind FROM documents)",
        _buckets('kind_vectors', 'kinds', 'doc_id', 'kind'))}
SELECT query_id, ticketId, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ticketId) AS rank FROM (
    SELECT q.id AS query_id, v.id AS ticketId, round((1 + sum(q.weight * v.weight)) / 2, 9) AS score
    FROM kind_vectors q JOIN kind_vectors v USING (bucket) GROUP BY ALL))
WHERE rank <= 5""",
    "gated_search": _GATED,
    "stream_gated": _GATED,
    "walk_from_statuses": f"""{_GRAPH},
links AS MATERIALIZED (
  SELECT src, src_label, dst, dst_label FROM edges UNION SELECT dst, dst_label, src, src_label FROM edges),
step1 AS MATERIALIZED (
  SELECT DISTINCT o_orderstatus AS start, dst_label AS label, dst AS node
  FROM orders JOIN links ON src = o_orderstatus AND src_label = 'status'),
step2 AS MATERIALIZED (
  SELECT DISTINCT start, dst_label AS label, dst AS node
  FROM step1 JOIN links ON src = node AND src_label = label),
step3 AS MATERIALIZED (
  SELECT DISTINCT start, dst_label AS label, dst AS node
  FROM step2 JOIN links ON src = node AND src_label = label)
SELECT start, label, node, CAST(min(depth) AS INTEGER) AS depth FROM (
  SELECT *, 1 AS depth FROM step1 UNION ALL SELECT *, 2 FROM step2
  UNION ALL SELECT *, 3 FROM step3)
WHERE NOT (label = 'status' AND node = start) GROUP BY ALL""",
    "refreshed_counts": f"""{_ctes(USERS)}
SELECT 'user' AS label, count(*) AS n FROM users
UNION ALL SELECT 'status', count(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'priority', count(DISTINCT o_orderpriority) FROM orders
UNION ALL SELECT 'category', count(DISTINCT p_brand) FROM part
UNION ALL SELECT 'ticket', count(*) FROM orders
UNION ALL SELECT 'comment', count(*) FROM lineitem
UNION ALL SELECT 'article', count(*) FROM part""",
    "iso_dates": f"""SELECT o_orderkey, {_ISO.format('o_orderdate')} AS iso,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp FROM orders""",
    "iso_event_times": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S')
       || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN '.' || strftime(ts, '%f') ELSE '' END
       || '+00:00' AS iso FROM events""",
    "parsed_datetimes": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P'
       THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS parsed FROM orders""",
    "score_texts": """SELECT printf('%.3f', l_discount) AS score,
       printf('%.1f%%', l_discount * 100) AS percent, count(*) AS n
FROM lineitem GROUP BY l_discount""",
    "name_labels": "SELECT page_id, split_part(url, '.', 1) AS label FROM pages",
    "rows_by_key": f"""{_ctes(COMMENTS)}
SELECT commentId, articleId, articleId IS NOT NULL AS kept FROM comments""",
    "cosine_pairs": """SELECT a.vec_id AS query_id,
       round((1 + list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2, 9)
         AS score,
       round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "typed_priority": """SELECT o_orderkey,
       CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS level,
       CAST(trunc(o_totalprice) AS INTEGER) AS whole_price,
       TRY_CAST(o_orderpriority AS INTEGER) AS bad_level FROM orders""",
    "typed_flags": """SELECT l_returnflag, l_linestatus,
       l_returnflag = 'R' OR (l_returnflag = 'N' AND l_linestatus = 'O') AS flag, count(*) AS n
       FROM lineitem GROUP BY ALL""",
    "joined_text": f"""{_ctes(TICKETS)}
SELECT ticketId, concat_ws(' ', title, resolutionSummary) AS joined,
       title || ' ' || coalesce(resolutionSummary, 'nan') AS joined_with_nan FROM tickets""",
    "edges_all": f"{_GRAPH} SELECT * FROM edges",
    "edge_counts_by_kind": f"""{_GRAPH}
SELECT edge_type, src_label, dst_label, count(*) AS n FROM edges GROUP BY ALL""",
    "expand_two_hop": f"""{_ctes(TICKETS, COMMENTS)}
SELECT createdByUserId AS userId, CAST(t.ticketId AS VARCHAR) AS ticketId, commentId, articleId
FROM tickets t JOIN comments c ON c.ticketId = t.ticketId""",
    "ticket_nodes": f"""{_ctes(TICKETS)}
SELECT ticketId, title, resolutionSummary,
       strftime(resolvedDate, '%Y-%m-%d %H:%M:%S') AS resolved FROM tickets""",
    "duplicate_line_keys": """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
GROUP BY ALL HAVING count(*) > 1""",
    "quarantined_lines": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       (l_orderkey, l_linenumber) IN ({_LINE_KEYS}) AS quarantined FROM lineitem""",
    "key_violations": f"""{_ctes(USERS)}
SELECT 'user' AS label, userId AS key, count(*) AS n FROM users GROUP BY ALL HAVING count(*) > 1
UNION ALL
SELECT 'comment', l_orderkey || '-' || l_returnflag AS key, count(*) FROM lineitem GROUP BY key
HAVING count(*) > 1
UNION ALL
SELECT 'ticket', CAST(o_orderkey AS VARCHAR), count(*) FROM orders GROUP BY ALL
HAVING count(*) > 1
UNION ALL
SELECT 'article', p_brand, count(*) FROM part GROUP BY ALL HAVING count(*) > 1""",
    "vector_rejects": f"""SELECT * FROM ({_VECTOR_ERRORS}) WHERE error IS NOT NULL""",
    "load_rejects": f"""{_ctes(USERS, TICKETS, COMMENTS.replace("comments AS (", "lines AS ("), ARTICLES)},
comments AS (
  SELECT * REPLACE (CASE WHEN ticketId % 5 <> 0 THEN ticketId || '-' || authorUserId END AS commentId)
  FROM lines)
SELECT 'comment' AS label, 'no key' AS reason, count(*) AS n FROM comments WHERE commentId IS NULL
HAVING count(*) > 0
UNION ALL
SELECT 'comment', 'duplicate key', count(*) FROM (
  SELECT commentId FROM comments WHERE commentId IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
HAVING count(*) > 0
UNION ALL
SELECT label, 'dangling reference', count(*) FROM ({_REFERENCES})
WHERE label <> 'comment' OR key IS NOT NULL GROUP BY label
UNION ALL
SELECT 'ticket', 'vector', count(*) FROM ({_VECTOR_ERRORS}) WHERE error IS NOT NULL""",
    "reference_report": f"{_ctes(USERS, TICKETS, COMMENTS, ARTICLES)}\n{_REFERENCES}",
    "dangling_refs": """SELECT o_orderkey AS vec_id FROM orders
WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = o_orderkey)""",
    "attach_vectors_to_tickets": f"""SELECT o_orderkey AS ticketId,
       CASE WHEN embedding IS NULL THEN 'missing'
            WHEN len(embedding) <> {DIM} THEN 'dimension' END AS error,
       array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE * 1e6)::BIGINT), ',')
         AS millionths
FROM orders LEFT JOIN embeddings ON vec_id = o_orderkey""",
    "attached_count": "SELECT count(*) AS n FROM orders JOIN embeddings ON vec_id = o_orderkey",
    "csv_roundtrip": f"""{_ctes(COMMENTS)}
SELECT commentId, content, strftime(creationDate, '%Y-%m-%d %H:%M:%S') AS created, isSolution,
       ticketId, authorUserId, articleId FROM comments""",
    "csv_text_roundtrip": "SELECT doc_id, text FROM documents",
    "csv_edges_roundtrip": """SELECT doc_id, ' ' || chr(9) || ' ' || text || chr(9) || '  ' AS text
FROM documents""",
    "vectors_csv_roundtrip": """SELECT ticketId, CAST(pos - 1 AS BIGINT) AS pos,
       round(CAST(value AS DOUBLE), 9) AS value FROM (
  SELECT vec_id AS ticketId, unnest(embedding) AS value,
         generate_subscripts(embedding, 1) AS pos FROM embeddings)""",
    "index_changes": """WITH now AS (SELECT vec_id % 10 AS kind, embedding FROM embeddings)
SELECT 'inserted' AS change, count(*) AS n FROM now WHERE kind = 0
UNION ALL
SELECT 'changed', count(*) FROM now WHERE kind = 1 AND embedding <> list_reverse(embedding)
UNION ALL
SELECT 'deleted', count(*) FROM now WHERE kind = 2""",
    "index_after_upkeep": """WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
lengths AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS length FROM vectors)
SELECT ticketId, CAST(pos - 1 AS BIGINT) AS pos, round(value / length, 6) AS value FROM (
  SELECT vec_id AS ticketId, length, unnest(v) AS value, generate_subscripts(v, 1) AS pos FROM lengths)""",
    "embed_tokens": f"""{_ctes(_buckets('v', 'documents', 'doc_id', 'text'))}
SELECT id AS doc_id, bucket, n FROM v_counts""",
    "embed_documents": f"""{_ctes(_buckets('v', 'documents', 'doc_id', 'text'))}
SELECT id AS doc_id, bucket, round(weight, 9) AS weight FROM v""",
    "embed_csv_batch": f"""{_ctes(_buckets('v', 'documents', 'doc_id', 'text'))}
SELECT id AS doc_id, bucket, round(weight, 9) AS weight FROM v""",
    "embedded_by_content": f"""{_ctes(_buckets('v', 'documents', 'doc_id', 'text'))}
SELECT id AS doc_id, bucket, round(weight, 9) AS weight FROM v""",
    "texts_to_embed": """WITH runs AS (
  SELECT * FROM (VALUES (0, 'en'), (1, 'de'), (2, 'fr'), (3, 'es'), (4, 'all')) AS runs(run, arrived)),
arrivals AS (
  SELECT DISTINCT run, arrived, coalesce(text, '') AS text
  FROM runs JOIN documents ON arrived = 'all' OR arrived = lang),
first_runs AS (SELECT text, min(run) AS run FROM arrivals GROUP BY text)
SELECT arrived, count(text) AS n_texts FROM runs LEFT JOIN first_runs USING (run) GROUP BY arrived""",
    "title_rules": f"""WITH records AS (
  SELECT doc_id, CASE WHEN doc_id % 12 <> 11 THEN 'cat_00' || (doc_id % 12) END AS category,
         split_part(text, '.', 1) AS title,
         CASE WHEN lang <> 'es' THEN text ELSE '  ' END AS description FROM documents),
checked AS (SELECT *, {_ANALYSIS_ERROR} AS error FROM records)
SELECT doc_id, error IS NULL AS is_related, CASE WHEN error IS NULL THEN category END AS category,
       CASE WHEN error IS NULL THEN {_STRIP.format('title')}
            ELSE {_text(FALLBACK_TITLE)} END AS title,
       CASE WHEN error IS NULL THEN {_STRIP.format('description')} ELSE error END AS description
FROM checked""",
    "triage_category": f"""{_ctes(*_TRIAGE)}
SELECT query_id, is_related, category, title, description, category_score FROM analysis""",
    "triage_by_table": f"""{_ctes(*_TABLE_TRIAGE)}
SELECT query_id, is_related, category, title, description, category_score FROM analysis""",
    "search_gate": f"""{_ctes(_QUESTIONS)}
SELECT query_id FROM questions
WHERE {_STRIP.format('question')} <> ''
  AND NOT ({_wording(_CHATS)} AND NOT {_wording(_ASKS_FOR_HELP)})""",
    "history_window": f"{_ctes(_HISTORY)} SELECT conv_id, turn, role, content FROM history",
    "prompt_assembly": f"""{_ctes(_ASKED, _HISTORY)},
parts AS (
  SELECT conv_id, question_id, 0 AS section, 0 AS turn, 'system' AS role,
         {_text(NEW_PROMPT + ' Search first.')} AS content FROM asked
  UNION ALL
  SELECT conv_id, question_id, 1, turn, role, content FROM asked JOIN history USING (conv_id)
  UNION ALL
  SELECT conv_id, question_id, 2, 0, 'user', question FROM asked)
SELECT conv_id, question_id,
       string_agg(role || ': ' || content, chr(10) ORDER BY section, turn) AS prompt,
       count(*) AS n_messages
FROM parts GROUP BY conv_id, question_id""",
    "system_upsert": f"""{_ctes(_LAST_TURNS)}
SELECT conv_id, turn, role,
       CASE WHEN role = 'system' THEN {_text(NEW_PROMPT)} ELSE text END AS content
FROM conversations
UNION ALL
SELECT conv_id, last_turn + 1, 'system', {_text(NEW_PROMPT)} FROM last_turns WHERE NOT has_system""",
    "last_system_prompt": f"""{_ctes(_LAST_TURNS)}
SELECT conv_id, coalesce(system_prompt, {_text(NEW_PROMPT)}) AS system_prompt FROM last_turns""",
    "stream_prompts": f"""WITH turns AS (
  SELECT *, coalesce(last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (
           PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           {_text(NEW_PROMPT)}) || ' Search first.' AS system_prompt,
         list({{'role': role, 'text': text}}) OVER (
           PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before
  FROM conversations),
kept AS (
  SELECT conv_id, turn, text, system_prompt,
         list_filter(coalesce(before, []), lambda m: m.role IN ('user', 'assistant')) AS before
  FROM turns WHERE role = 'user')
SELECT conv_id, turn,
       array_to_string(list_concat(['system: ' || system_prompt],
         list_transform(before, lambda m: m.role || ': ' || coalesce(m.text, '')),
         ['user: ' || text]), chr(10)) AS prompt,
       len(before) + 2 AS n_messages
FROM kept""",
    "display_turns": """SELECT conv_id, turn, role, text AS content FROM conversations
WHERE role IN ('user', 'assistant') OR (role = 'function' AND text <> '')""",
    "append_turns": f"""{_ctes(_LAST_TURNS)},
again AS (
  SELECT conv_id, text, last_turn + 1 + CASE WHEN has_system THEN 0 ELSE 1 END
         + 2 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS start
  FROM conversations JOIN last_turns USING (conv_id) WHERE role = 'user')
SELECT conv_id, turn, role, text AS content FROM conversations
UNION ALL
SELECT conv_id, last_turn + 1, 'system', {_text(NEW_PROMPT)}
FROM last_turns WHERE NOT has_system AND conv_id IN (SELECT conv_id FROM again)
UNION ALL
SELECT conv_id, start, 'user', text FROM again
UNION ALL
SELECT conv_id, start + 1, 'assistant', 'Re: ' || text FROM again""",
    "conversation_files": """SELECT conv_id, role, text AS content,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations""",
    "conversation_lists": """SELECT CASE conv_id % 4 WHEN 0 THEN lpad(conv_id::VARCHAR, 8, '0')
         WHEN 1 THEN conv_id::VARCHAR || '.50' WHEN 2 THEN '2024-01-01 ' || conv_id::VARCHAR
         ELSE 'a+b/' || conv_id::VARCHAR || '%20' END AS conv_id,
       role, text AS content,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations""",
    "recent_files": """SELECT 'part-' AS kind, true AS dated, count(DISTINCT conv_id) AS n
FROM conversations""",
    "conversation_roundtrip": f"""{_ctes(_LAST_TURNS, _ASKED)}
SELECT conv_id, turn, role, text AS content FROM conversations
UNION ALL
SELECT conv_id, last_turn + 1, 'user', question FROM asked JOIN last_turns USING (conv_id)
UNION ALL
SELECT conv_id, last_turn + 2, 'assistant', 'Done.' FROM asked JOIN last_turns USING (conv_id)""",
}
