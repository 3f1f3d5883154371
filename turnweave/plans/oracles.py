"""SQL for DuckDB that says independently what the catalogue's queries return.

The statements are relational where the queries nest: windows and joins over one row per
turn and edge, so that agreement means something.
"""

from __future__ import annotations

from turnweave.schema import ACTIONS, MOVES

ORACLES: dict[str, str] = {}


def _thread(length: int, corpus: str) -> str:
    return f"""SELECT event_id // {length} AS ordinal, '{corpus}:' || (event_id // {length}) AS conv_id, (event_id % {length})::INT AS pos,
      event_type || ' ' || props AS text, 'S' || (user_id % 4) AS speaker,
      CASE event_type WHEN 'signup' THEN 'question' WHEN 'error' THEN 'clarify' WHEN 'click' THEN 'answer' WHEN 'view' THEN 'comment' ELSE 'acknowledge' END AS action,
      greatest(0, event_id % {length} - 1 - ((event_id * 7 + user_id) % 3))::INT AS target FROM events"""


LIB = f"""WITH th AS ({_thread(9, "threads")} UNION ALL {_thread(40, "long")}),
turns AS (
  SELECT 'chat:' || conv_id AS conv_id, turn::INT AS pos, text, role AS speaker, role AS action, 'source-role' AS annotation FROM conversations
  UNION ALL SELECT conv_id, pos, text, speaker, action, 'synthetic-example' FROM th),
edges AS (
  SELECT 'chat:' || conv_id AS conv_id, turn::INT - 1 AS ord, turn::INT AS source, turn::INT - 1 AS target, 'temporal' AS type, 'chronological' AS provenance FROM conversations WHERE turn > 0
  UNION ALL SELECT conv_id, pos - 1, pos, target, CASE action WHEN 'clarify' THEN 'Clarification_question' WHEN 'answer' THEN 'QAP' ELSE 'Comment' END, 'synthetic-example' FROM th WHERE pos > 0),
trusted AS (SELECT * FROM edges WHERE provenance IN ('human-discourse', 'platform-reply', 'human-link', 'synthetic-example')),
convs AS (
  SELECT DISTINCT 'chat:' || conv_id AS conv_id, 'chat' AS corpus, 0 AS corpus_ord, conv_id AS ordinal FROM conversations
  UNION ALL SELECT DISTINCT conv_id, split_part(conv_id, ':', 1), CASE WHEN conv_id LIKE 'threads:%' THEN 1 ELSE 2 END, ordinal FROM th),
gs AS (
  SELECT t.conv_id, t.turns, t.speakers, coalesce(e.edges, 0) AS edges, coalesce(e.nonadjacent, 0) AS nonadjacent, coalesce(e.typed, 0) AS typed
  FROM (SELECT conv_id, count(*) AS turns, count(DISTINCT speaker) AS speakers FROM turns GROUP BY 1) t
  LEFT JOIN (SELECT conv_id, count(*) AS edges, count(*) FILTER (abs(source - target) > 1) AS nonadjacent, count(*) FILTER (type NOT IN ('reply', 'temporal')) AS typed FROM trusted GROUP BY 1) e USING (conv_id)),
eps AS (
  SELECT row_number() OVER (ORDER BY corpus_ord, ordinal, start) AS episode_id, conv_id, corpus, ordinal, start::INT AS start, least(start + 12, n)::INT AS stop
  FROM (SELECT c.*, g.turns AS n, unnest(CASE WHEN g.turns >= 4 THEN range(0, g.turns - 3, 6)[1:64] ELSE [] END) AS start FROM convs c JOIN gs g USING (conv_id))),
et AS (
  SELECT e.episode_id, e.corpus, e.conv_id, e.ordinal, e.start, t.pos - e.start AS i, t.speaker AS voice, t.action, t.text
  FROM eps e JOIN turns t ON t.conv_id = e.conv_id AND t.pos >= e.start AND t.pos < e.stop),
cs AS (
  SELECT *, 'S' || dense_rank() OVER (PARTITION BY episode_id ORDER BY first) AS speaker
  FROM (SELECT *, min(i) OVER (PARTITION BY episode_id, voice) AS first FROM et)),
ee AS (
  SELECT e.episode_id, x.ord, x.source - e.start AS source, x.target - e.start AS target, x.type, x.provenance
  FROM eps e JOIN edges x ON x.conv_id = e.conv_id AND x.source >= e.start AND x.source < e.stop AND x.target >= e.start AND x.target < e.stop),
te AS (SELECT * FROM ee WHERE provenance IN ('human-discourse', 'platform-reply', 'human-link', 'synthetic-example')),
mv AS (
  SELECT *, CASE WHEN action IN ('user', 'assistant', '0', 'unknown') THEN 'unknown' WHEN action IN ({", ".join(repr(m) for m in MOVES)}) THEN action ELSE 'other' END AS move,
    coalesce(nullif(trim(regexp_replace(lower(action), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS clean FROM cs)
"""

# Per-episode figures, one row an episode.
DESC = (
    LIB
    + """, base AS (
  SELECT episode_id, any_value(corpus) AS corpus, any_value(conv_id) AS conv_id, any_value(ordinal) AS ordinal, any_value(start) AS start, count(*) AS n, count(DISTINCT speaker) AS speakers,
    count(*) FILTER (move = 'unknown') AS unknown, count(*) FILTER (move = 'clarify') AS clarify, count(*) FILTER (move = 'answer') AS answer,
    count(*) FILTER (move = 'question') AS question, count(*) FILTER (move = 'acknowledge') AS acknowledge, count(*) FILTER (move = 'propose') AS propose,
    avg(ln(1 + len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')))) AS mlw FROM mv GROUP BY 1),
adj AS (
  SELECT episode_id, count(*) FILTER (speaker <> nspeaker) AS switches, sum(CASE WHEN nwords IS NULL THEN 0 ELSE len(list_intersect(words, nwords)) / greatest(1, len(list_distinct(list_concat(words, nwords)))) END) AS recur
  FROM (SELECT episode_id, speaker, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS words,
    lead(speaker) OVER w AS nspeaker, lead(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) OVER w AS nwords FROM mv WINDOW w AS (PARTITION BY episode_id ORDER BY i)) GROUP BY 1),
sp AS (SELECT episode_id, max(k) AS top, sum(-k / n * ln(k / n)) / ln(greatest(2, count(*))) AS h
  FROM (SELECT episode_id, speaker, count(*) AS k, sum(count(*)) OVER (PARTITION BY episode_id) AS n FROM mv GROUP BY 1, 2) GROUP BY 1),
ac AS (SELECT episode_id, sum(-k / n * ln(k / n)) / ln(greatest(2, count(*))) AS h
  FROM (SELECT episode_id, move, count(*) AS k, sum(count(*)) OVER (PARTITION BY episode_id) AS n FROM mv GROUP BY 1, 2) GROUP BY 1),
lg AS (SELECT episode_id, count(*) AS m, count(*) FILTER (abs(source - target) > 1) AS far, avg(abs(source - target)) AS mean_lag, max(abs(source - target)) AS max_lag FROM te GROUP BY 1),
br AS (SELECT episode_id, count(*) AS branch FROM (SELECT episode_id, target FROM te GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1),
d AS (
  SELECT b.*, coalesce(m, 0) AS m, coalesce(far, 0) AS far, mean_lag, coalesce(max_lag, 0) AS max_lag, coalesce(branch, 0) AS branch, switches, recur, sp.top, abs(sp.h) AS sh, abs(ac.h) AS ah,
    (speakers >= 3)::INT + 2 * (coalesce(far, 0) > 0)::INT + 4 * (clarify > 0)::INT + 8 * (coalesce(branch, 0) > 0)::INT + 16 * (coalesce(m, 0) > 0)::INT AS flags,
    round(mean_lag, 3) AS reach, round(1 - unknown / n, 4) AS known, coalesce(mean_lag, 0) / greatest(1, n - 1) AS x, sp.top / n AS y
  FROM base b JOIN adj USING (episode_id) JOIN sp USING (episode_id) JOIN ac USING (episode_id) LEFT JOIN lg USING (episode_id) LEFT JOIN br USING (episode_id)),
prs AS (SELECT te.episode_id, e.corpus, e.conv_id, e.start, te.ord, a.move AS from_move, b.move AS to_move
  FROM te JOIN eps e USING (episode_id) JOIN mv a ON a.episode_id = te.episode_id AND a.i = te.target JOIN mv b ON b.episode_id = te.episode_id AND b.i = te.source)
"""
)

TOKENS = (
    LIB
    + """, tk AS (
  SELECT episode_id, 1 AS kind, i AS nth, 'a_' || clean AS token FROM mv
  UNION ALL SELECT episode_id, 2, i, 'b_' || clean || '_' || nclean FROM (SELECT *, lead(clean) OVER (PARTITION BY episode_id ORDER BY i) AS nclean FROM mv) WHERE nclean IS NOT NULL
  UNION ALL SELECT episode_id, 3, i, CASE WHEN speaker = nspeaker THEN 's_same' ELSE 's_different' END FROM (SELECT *, lead(speaker) OVER (PARTITION BY episode_id ORDER BY i) AS nspeaker FROM mv) WHERE nspeaker IS NOT NULL
  UNION ALL SELECT te.episode_id, 4, te.ord, 'e_' || coalesce(nullif(trim(regexp_replace(lower(te.type), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown')
    || CASE WHEN abs(te.source - te.target) = 1 THEN '_near' ELSE '_delayed' END || CASE WHEN a.speaker = b.speaker THEN '_same' ELSE '_different' END
    FROM te JOIN cs a ON a.episode_id = te.episode_id AND a.i = te.source JOIN cs b ON b.episode_id = te.episode_id AND b.i = te.target)
"""
)

ACTION_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ACTIONS.items()) + "}"

# --- Sources -----------------------------------------------------------------------------

ORACLES["src_molweni"] = f"""
WITH e AS (SELECT event_id // 6 AS id, (event_id % 6)::INT AS i, event_type || ' ' || props AS text, 'u' || (user_id % 3) AS speaker,
  CASE event_type WHEN 'click' THEN 'QAP' WHEN 'error' THEN 'Clarification_question' WHEN 'view' THEN 'Comment' WHEN 'signup' THEN 'Q-Elab' ELSE 'Other_Kind' END AS type FROM events)
SELECT 'molweni:train-' || id AS conv_id, i AS pos, text, speaker, CASE WHEN i = 0 THEN 'unknown' ELSE coalesce({ACTION_MAP}[type], lower(type)) END AS action,
  CASE WHEN i = 0 THEN 'unannotated' ELSE 'human-discourse' END AS annotation, CASE WHEN i > 0 THEN type END AS native_label FROM e"""

UTTER = """WITH u AS (SELECT event_id, event_id // 9 AS c, (event_id % 9)::INT AS pos, user_id, event_type, 'p' || (user_id % 5) AS speaker, event_type || ' ' || props AS text,
  CASE WHEN event_id % 9 > 0 THEN event_id - 1 - user_id % 3 END AS parent FROM events)"""
ORACLES["src_convokit"] = UTTER + """ SELECT 'chromium:' || c AS conv_id, pos, text, speaker, 'unknown' AS action, 'unannotated' AS annotation, NULL::VARCHAR AS native_label FROM u"""
ORACLES["src_reply_edges"] = UTTER + """ SELECT 'cmv:' || c AS conv_id, pos AS source, (parent % 9)::INT AS target, 'reply' AS type, 'platform-reply' AS provenance FROM u WHERE parent >= 0 AND parent // 9 = c AND parent <> event_id"""
ORACLES["j_parent"] = UTTER + """ SELECT c::VARCHAR AS cid, pos AS source, (parent % 9)::INT AS target FROM u WHERE parent >= 0 AND parent // 9 = c AND parent <> event_id"""
ORACLES["src_reddit"] = UTTER + """, es AS (SELECT 'reddit:' || c AS conv_id, pos AS source, (parent % 9)::INT AS target, 'reply' AS type, 'platform-reply' AS provenance FROM u WHERE parent >= 0 AND parent // 9 = c
  UNION ALL SELECT 'reddit:' || c, pos, ((event_id - 2) % 9)::INT, 'discourse', 'human-link' FROM u WHERE user_id % 2 <> 0 AND event_id >= 2 AND (event_id - 2) // 9 = c AND (parent IS NULL OR parent <> event_id - 2))
SELECT conv_id, source, target, type, provenance, count(*) AS n FROM es GROUP BY ALL"""
ORACLES["src_deli"] = UTTER + """ SELECT 'deli:' || c AS conv_id, (row_number() OVER (PARTITION BY c ORDER BY event_id) - 1)::INT AS pos, text, speaker,
  CASE user_id % 3 WHEN 0 THEN 'probe' WHEN 1 THEN 'social' ELSE 'unseen' END AS action, 'human-deliberation' AS annotation,
  CASE user_id % 3 WHEN 0 THEN 'Probing' WHEN 1 THEN 'Non-deliberation' ELSE 'unseen' END AS native_label FROM u WHERE event_type <> 'view'"""
ORACLES["src_wildchat"] = """WITH t AS (SELECT conv_id, list([role, text] ORDER BY turn)::VARCHAR AS body FROM conversations GROUP BY 1),
r AS (SELECT conv_id AS ordinal, conv_id, body FROM t WHERE conv_id % 11 NOT IN (3, 5) UNION ALL SELECT conv_id + 1000000, conv_id, body FROM t WHERE conv_id % 3 = 0),
k AS (SELECT min(ordinal) AS ordinal, arg_min(conv_id, ordinal) AS conv_id FROM r GROUP BY body)
SELECT k.ordinal, c.turn::INT AS pos, c.role AS speaker, c.role AS action, 'source-role' AS annotation, coalesce(c.text, '') AS text FROM k JOIN conversations c USING (conv_id)"""
PRISM = """WITH s AS (SELECT event_id // 12 AS c, ((event_id % 12) // 3)::INT AS round, event_id % 3 AS k, event_type || ' ' || props AS content, 'm' || (user_id % 4) AS model, (user_id % 100)::DOUBLE AS score,
  ((event_id % 3 = 1 AND user_id % 7 <> 0) OR (event_id % 3 = 2 AND user_id % 13 = 0)) AS chosen, event_id FROM events),
r AS (SELECT c, round, count(*) FILTER (k <> 0 AND chosen) AS good, arg_min(content, event_id) FILTER (k = 0) AS asked, arg_min(content, event_id) FILTER (k <> 0 AND chosen) AS answer FROM s GROUP BY 1, 2 HAVING count(*) FILTER (k = 0) > 0),
g AS (SELECT *, coalesce(max((good <> 1)::INT) OVER (PARTITION BY c ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM r),
p AS (SELECT *, ((row_number() OVER (PARTITION BY c ORDER BY round) - 1) * 2)::INT AS turn FROM g WHERE stopped = 0)"""
ORACLES["src_prism"] = PRISM + """ SELECT 'prism:' || c AS conv_id, turn AS pos, asked AS text, 'human' AS speaker, 'user' AS action FROM p
UNION ALL SELECT 'prism:' || c, turn + 1, answer, 'model', 'assistant' FROM p WHERE good = 1"""
ORACLES["variants_view"] = PRISM + """ SELECT 'prism:' || c AS conv_id, s.round, p.turn, s.content AS text, s.model, s.score, s.chosen, p.good <> 1 AS ambiguous FROM s JOIN p USING (c, round) WHERE k <> 0"""
ORACLES["src_daily"] = f"""SELECT 'dailydialog:' || conv_id AS conv_id, turn::INT AS pos, text, 'S' || (turn % 2 + 1) AS speaker, coalesce({ACTION_MAP}[((conv_id + turn) % 5)::VARCHAR], 'unknown') AS action,
  'human-dialogue-act' AS annotation, ((conv_id + turn) % 5)::VARCHAR AS native_label FROM conversations"""
ORACLES["src_demo"] = """WITH topic AS (SELECT * FROM (VALUES (1, 'a garden path'), (2, 'a bus route'), (3, 'a reading room'), (4, 'a bread recipe')) v(k, topic)),
step AS (SELECT * FROM (VALUES (0, 'S1', 'question', 'How should we plan ', '?'), (1, 'S2', 'clarify', 'Which part of ', ' do you mean?'), (2, 'S3', 'comment', 'I once saw ', ' done well.'),
  (3, 'S1', 'answer', 'The first part of ', '.'), (4, 'S2', 'propose', 'Then let us sketch ', ' together.'), (5, 'S1', 'acknowledge', 'Good, that settles ', '.')) v(pos, speaker, action, before, after)),
reply AS (SELECT * FROM (VALUES (0, 'human', 'user', 'Suggest a title.'), (1, 'model', 'assistant', 'A Walk in Spring'), (2, 'human', 'user', 'Something shorter?'), (3, 'model', 'assistant', 'Spring')) v(pos, speaker, action, text))
SELECT 'synthetic:example-' || k AS conv_id, pos, before || topic || after AS text, speaker, action, 'synthetic-example' AS annotation, NULL::VARCHAR AS native_label FROM topic CROSS JOIN step
UNION ALL SELECT 'synthetic_variants:example-1', pos, text, speaker, action, 'synthetic-example', NULL FROM reply"""
ORACLES["src_meta"] = """SELECT c_custkey::VARCHAR AS cid, 'title' AS key, c_name AS value FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'subreddit', c_mktsegment FROM customer"""
ORACLES["scan_payload"] = LIB + """SELECT conv_id, 'threads' AS corpus, 'train' AS split, 'turn' AS kind, pos AS at, speaker AS who, action AS label, text, NULL::INT AS target FROM turns WHERE conv_id = 'threads:7'
UNION ALL SELECT conv_id, 'threads', 'train', 'edge', source, provenance, type, NULL, target FROM edges WHERE conv_id = 'threads:7'"""

STATS = (
    LIB
    + """, st AS (SELECT corpus, count(*) AS conversations, sum(turns)::BIGINT AS turns, sum(edges)::BIGINT AS edges, sum(nonadjacent)::BIGINT AS nonadjacent, count(*) FILTER (speakers >= 3) AS multiparty,
  count(*) FILTER (turns >= 4) AS eligible, max(turns) AS max_turns, list_sort(list(turns))[count(*) // 2 + 1] AS median_turns FROM convs JOIN gs USING (conv_id) GROUP BY 1),
ew AS (SELECT corpus, count(*) AS episodes FROM eps GROUP BY 1), cst AS (SELECT st.*, coalesce(episodes, 0) AS episodes FROM st LEFT JOIN ew USING (corpus))
"""
)
_STATS_JSON = """SELECT corpus, '{"conversations":' || conversations || ',"edges":' || edges || ',"eligible":' || eligible || ',"episodes":' || episodes || ',"max_turns":' || max_turns || ',"median_turns":' || median_turns
  || ',"multiparty":' || multiparty || ',"nonadjacent":' || nonadjacent || ',"turns":' || turns || '}' AS json FROM cst"""
ORACLES["scan_stats"] = ORACLES["sink_stats"] = STATS + _STATS_JSON
ORACLES["corpus_stats"] = STATS + "SELECT * FROM cst"
ORACLES["collection_totals"] = STATS + "SELECT sum(conversations)::BIGINT AS conversations, sum(turns)::BIGINT AS turns, sum(edges)::BIGINT AS edges, sum(nonadjacent)::BIGINT AS nonadjacent, sum(episodes)::BIGINT AS episodes FROM cst"
ORACLES["scan_meta"] = STATS + """SELECT unnest(['conversations', 'turns', 'edges', 'nonadjacent', 'episodes']) AS key,
  unnest([sum(conversations)::BIGINT, sum(turns)::BIGINT, sum(edges)::BIGINT, sum(nonadjacent)::BIGINT, sum(episodes)::BIGINT]) AS value FROM cst"""
ORACLES["sink_index"] = STATS + """SELECT 'conversations' AS name, count(*) AS n FROM convs UNION ALL SELECT 'turns', count(*) FROM turns UNION ALL SELECT 'edges', count(*) FROM edges
UNION ALL SELECT 'episodes', count(*) FROM eps UNION ALL SELECT 'stats', count(*) FROM cst"""
ORACLES["sink_atlas"] = DESC + "SELECT corpus, count(*) AS n, sum(flags)::BIGINT AS flags FROM d GROUP BY 1"
ORACLES["sink_cohort"] = DESC + """SELECT episode_id, '{"schema":"turnweave-cohort/1","episode_id":' || episode_id || ',"filters":{"lens":"5"},"metrics":{"n":' || count(*) OVER () || '},"pinned":{"n":' || (SELECT count(*) FROM d WHERE (flags & 2) = 2) || '}}' AS json FROM d WHERE (flags & 5) = 5"""
ORACLES["corpus_examples"] = LIB + """SELECT corpus, place::INT AS place, conv_id FROM (SELECT corpus, conv_id, row_number() OVER (PARTITION BY corpus ORDER BY ordinal) AS place FROM convs JOIN gs USING (conv_id)
  WHERE turns >= 4 AND nonadjacent >= 2 AND speakers >= 3) WHERE place <= 8"""

# --- Projections -------------------------------------------------------------------------

ORACLES["canon_speakers"] = LIB + "SELECT conv_id, start, i, speaker FROM cs"
_clean = lambda x: f"coalesce(nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown')"
ORACLES["clean_label"] = f"SELECT p_partkey, {_clean('p_name')} AS name, {_clean('p_type')} AS type, {_clean('p_brand || chr(32) || chr(33)')} AS brand FROM part"
ORACLES["map_action"] = f"SELECT event_id, coalesce({ACTION_MAP}[(user_id % 6)::VARCHAR], 'unknown') AS action FROM events"
ORACLES["move_group"] = LIB + f"SELECT conv_id, pos, CASE WHEN action IN ('user', 'assistant', '0', 'unknown') THEN 'unknown' WHEN action IN ({', '.join(repr(m) for m in MOVES)}) THEN action ELSE 'other' END AS move FROM turns"
ORACLES["signature"] = LIB + "SELECT episode_id, string_agg(action, ' → ' ORDER BY i) AS signature FROM et GROUP BY 1"
_TITLE = "replace(substring(text, 1, 100), chr(10), ' ')"
ORACLES["title"] = LIB + f"SELECT conv_id AS id, {_TITLE} AS title FROM turns WHERE pos = 0"
ORACLES["conv_text"] = LIB + "SELECT conv_id, string_agg(text, chr(10) ORDER BY pos) AS text FROM turns GROUP BY 1"
_BRIEF = f"SELECT c.conv_id AS id, c.corpus, g.turns AS nturns, g.speakers AS nspeakers, g.edges AS nedges, g.nonadjacent, {_TITLE} AS title FROM convs c JOIN gs g USING (conv_id) LEFT JOIN turns t ON t.conv_id = c.conv_id AND t.pos = 0"
ORACLES["brief"] = LIB + _BRIEF
ORACLES["overlay"] = LIB + "SELECT conv_id, pos, CASE pos WHEN 1 THEN 'question' WHEN 3 THEN 'answer' ELSE action END AS action, CASE WHEN pos IN (1, 3) THEN 'user-overlay' ELSE annotation END AS annotation FROM turns"
_JX, _JY = "(x + ((episode_id * 2654435761) % 4294967296 / 4294967296.0 - 0.5) * 0.012)", "(y + ((episode_id * 1597334677) % 4294967296 / 4294967296.0 - 0.5) * 0.012)"
ORACLES["jitter"] = DESC + f"SELECT episode_id, round({_JX}::DOUBLE, 6) AS jx, round({_JY}::DOUBLE, 6) AS jy FROM d"
ORACLES["color_bins"] = DESC + """SELECT episode_id, least(speakers, 4)::INT AS speakers_bin, CASE WHEN reach IS NULL THEN 0 WHEN reach <= 1 THEN 1 WHEN reach <= 2 THEN 2 WHEN reach <= 4 THEN 3 ELSE 4 END AS reach_bin,
  CASE WHEN known < 0.1 THEN 0 WHEN known < 0.5 THEN 1 WHEN known < 0.9 THEN 2 ELSE 3 END AS known_bin FROM d"""

ORACLES["compact_num"] = """SELECT o_orderkey, CASE WHEN v >= 1000000 THEN format('{:,.1f}', round(v / 1000000, 1)) || 'M' WHEN v >= 1000 THEN format('{:,.1f}', round(v / 1000, 1)) || 'K' ELSE v::VARCHAR END AS shown
FROM (SELECT o_orderkey, o_orderkey * o_orderkey AS v FROM orders)"""

# --- Filters -----------------------------------------------------------------------------

_FACET = "SELECT c.conv_id AS id, turns AS nturns, speakers AS nspeakers, nonadjacent FROM convs c JOIN gs USING (conv_id) WHERE "
ORACLES["f_corpus"] = LIB + _FACET + "corpus = 'threads'"
ORACLES["f_delayed"] = LIB + _FACET + "nonadjacent > 0"
ORACLES["f_group"] = LIB + _FACET + "speakers >= 3"
ORACLES["f_variants"] = LIB + _FACET + "corpus = 'chat'"
ORACLES["f_clarify"] = LIB + _FACET + "corpus = 'threads' AND EXISTS (FROM edges e WHERE e.conv_id = c.conv_id AND e.type = 'Clarification_question')"
ORACLES["f_min_turns"] = LIB + _FACET + "turns >= 4"
ORACLES["f_bounds"] = LIB + """SELECT conv_id, start, stop, coalesce(start >= 0 AND start < stop AND stop <= turns AND stop - start <= 24, false) AS valid
FROM (SELECT DISTINCT 'threads:' || (event_id % 2000) AS conv_id, (user_id % 12 - 2)::INT AS start, (event_id % 11)::INT AS stop FROM events) LEFT JOIN gs USING (conv_id)"""
ORACLES["f_trusted"] = LIB + "SELECT conv_id, source, target, type FROM trusted"
ORACLES["f_not_self"] = LIB + "SELECT conv_id, start, stop FROM eps WHERE conv_id <> 'threads:7'"
ORACLES["f_lens"] = DESC + "SELECT episode_id, flags FROM d WHERE (flags & 5) = 5"
ORACLES["f_region"] = DESC + f"SELECT episode_id FROM d WHERE {_JX} BETWEEN 0.1 AND 0.25 AND {_JY} BETWEEN 0.2 AND 0.45"
ORACLES["f_pair_token"] = DESC + "SELECT DISTINCT episode_id FROM prs WHERE from_move = 'clarify' AND to_move = 'answer'"

# --- Joins -------------------------------------------------------------------------------


def _bm25(docs: str, asked: str) -> str:
    """CTEs docs(doc, token) one row per token, asked(query, token); gives ranked(query, doc, score)."""
    return f""", dt AS ({docs}), qs AS ({asked}), dl AS (SELECT doc, count(*) AS len FROM dt GROUP BY 1), nn AS (SELECT count(*) AS n, avg(len) AS mean FROM dl),
tf AS (SELECT doc, token, count(*) AS tf FROM dt WHERE token IN (SELECT token FROM qs) GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
ws AS (SELECT doc, token, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS w
  FROM tf JOIN df USING (token) JOIN dl USING (doc) CROSS JOIN nn),
ranked AS (SELECT query, doc, round(sum(w), 6) AS score FROM ws JOIN qs USING (token) GROUP BY 1, 2)
"""


_TEXT_DOCS = "SELECT conv_id AS doc, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')) AS token FROM turns"
_ASKED = " UNION ALL ".join(f"SELECT '{q}' AS query, unnest({q.split()!r}) AS token" for q in ("error 19 purchase", "the purchase", "view k 42"))
_TEXT = LIB + _bm25(_TEXT_DOCS, _ASKED)
ORACLES["bm25"] = _TEXT + "SELECT query, doc, score FROM ranked"
_RANKED = "SELECT query, doc, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM ranked) WHERE rank <= "
ORACLES["topk_text"] = _TEXT + _RANKED + "24"
ORACLES["eval_rank"] = _TEXT + _RANKED + "10"
ORACLES["j_fts_conv"] = LIB + """SELECT conv_id AS id, corpus, turns AS nturns FROM convs JOIN gs USING (conv_id) WHERE conv_id IN (SELECT conv_id FROM turns WHERE list_has_any(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ['error', '19', 'purchase']))"""
ORACLES["search"] = _TEXT + """SELECT c.conv_id AS id, corpus, turns AS nturns, score FROM convs c JOIN gs USING (conv_id) JOIN ranked r ON r.doc = c.conv_id
WHERE query = 'error 19 purchase' AND speakers >= 3 ORDER BY score DESC, id LIMIT 24"""
# the query episode [0, 6) of a thread of nine: its tokens come from the turns and edges before turn 6
_ASKED_EPISODE = """SELECT DISTINCT 0 AS query, token FROM tk JOIN eps e USING (episode_id) WHERE e.conv_id = 'threads:7' AND e.start = 0 AND
  ((kind = 1 AND nth < 6) OR (kind IN (2, 3) AND nth < 5) OR (kind = 4 AND nth < 5))"""
_MOTIF = TOKENS + _bm25("SELECT episode_id AS doc, token FROM tk", _ASKED_EPISODE)
ORACLES["j_fts_ep"] = _MOTIF + "SELECT e.episode_id, e.corpus, score FROM ranked JOIN eps e ON e.episode_id = doc"
ORACLES["topk_motif"] = _MOTIF + "SELECT doc, score FROM ranked ORDER BY score DESC, doc LIMIT 120"
ORACLES["j_ep_payload"] = LIB + """SELECT episode_id, (SELECT count(*)::INT FROM et t WHERE t.episode_id = e.episode_id) AS n_turns, (SELECT count(*)::INT FROM ee x WHERE x.episode_id = e.episode_id) AS n_edges,
  (SELECT count(*)::INT FROM edges x WHERE x.conv_id = e.conv_id AND x.source >= e.start AND x.source < e.stop AND NOT (x.target >= e.start AND x.target < e.stop)) AS n_external FROM eps e"""
ORACLES["j_edge_turns"] = LIB + """SELECT e.conv_id, source, target, type, a.action AS source_action, b.action AS target_action, a.speaker AS source_speaker, b.speaker AS target_speaker
FROM edges e JOIN turns a ON a.conv_id = e.conv_id AND a.pos = source JOIN turns b ON b.conv_id = e.conv_id AND b.pos = target"""
ORACLES["j_range_slice"] = LIB + """SELECT episode_id, true AS internal, source, target, type FROM ee UNION ALL
SELECT e.episode_id, false, x.source, x.target, x.type FROM eps e JOIN edges x ON x.conv_id = e.conv_id AND x.source >= e.start AND x.source < e.stop AND NOT (x.target >= e.start AND x.target < e.stop)"""
# texts as words between white space; the fixture's lines differ in nothing but that and their words
_FAM = """WITH f AS (SELECT 'f:' || (event_id // 9) AS conv_id, event_id // 9 AS ordinal, 'a turn about ' || event_type || ' by ' || ((event_id // 9) % 97) || ' at ' || CASE WHEN user_id % 10 = 0 THEN user_id ELSE event_id % 9 END AS words,
  words || CASE WHEN event_id % 3 = 0 THEN '+' ELSE '' END AS inner_length FROM events)"""
ORACLES["j_family"] = _FAM + " SELECT DISTINCT conv_id, words AS utterance FROM f WHERE length(inner_length) >= 20"
ORACLES["family_filter"] = _FAM.replace("WITH f", "WITH RECURSIVE f") + """, u AS (SELECT DISTINCT conv_id, words AS t FROM f WHERE length(inner_length) >= 20), n AS (SELECT conv_id, count(*) AS n FROM u GROUP BY 1),
p AS (SELECT a.conv_id AS a, b.conv_id AS b, count(*) AS k FROM u a JOIN u b ON a.t = b.t AND a.conv_id <> b.conv_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.conv_id = a JOIN n y ON y.conv_id = b WHERE k >= 4 AND k >= 0.8 * least(x.n, y.n)),
r AS (SELECT conv_id AS node, conv_id AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
fam AS (SELECT node AS conv_id, min(root) AS family FROM r GROUP BY 1),
s AS (SELECT DISTINCT f.conv_id, f.ordinal, CASE WHEN f.ordinal % 5 = 0 THEN 'test' ELSE 'train' END AS split, coalesce(family, f.conv_id) AS family FROM f LEFT JOIN fam USING (conv_id))
SELECT conv_id, split, row_number() OVER (PARTITION BY family ORDER BY split <> 'train', ordinal) = 1 AS kept FROM s"""
_DUP = """WITH dg AS (SELECT 'd:' || (event_id // 2) AS conv_id, event_id // 2 AS ordinal,
  sha256(string_agg(lower(event_type) || (user_id % 4) || CASE WHEN event_id % 7 = 0 THEN event_id::VARCHAR ELSE '' END, ' ' ORDER BY event_id)) AS digest FROM events GROUP BY 1, 2)"""
ORACLES["exact_dup"] = _DUP + " SELECT conv_id, digest FROM dg"
ORACLES["j_anti_dup"] = _DUP + " SELECT conv_id FROM dg WHERE ordinal % 5 = 0 AND digest NOT IN (SELECT digest FROM dg WHERE ordinal % 5 <> 0)"
ORACLES["j_semi"] = LIB + "SELECT conv_id, corpus FROM convs WHERE conv_id IN (SELECT conv_id FROM edges WHERE type = 'QAP')"

ORACLES["stats"] = STATS + """, ex AS (SELECT corpus, string_agg(conv_id, ' ' ORDER BY ordinal) AS ids FROM (SELECT corpus, conv_id, ordinal, row_number() OVER (PARTITION BY corpus ORDER BY ordinal) AS k FROM convs JOIN gs USING (conv_id)
  WHERE turns >= 4 AND nonadjacent >= 2 AND speakers >= 3) WHERE k <= 8 GROUP BY 1)
SELECT corpus, CASE corpus WHEN 'long' THEN 'Long threads' ELSE corpus END AS name, conversations, episodes, coalesce(ids, '') AS example_ids FROM cst LEFT JOIN ex USING (corpus)"""
ORACLES["atlas_summary"] = DESC + """, pc AS (SELECT corpus, from_move, to_move, n, row_number() OVER (PARTITION BY corpus ORDER BY n DESC, first) AS place
  FROM (SELECT corpus, from_move, to_move, count(*) AS n, min(ROW(conv_id, start, ord)) AS first FROM prs GROUP BY 1, 2, 3)),
fe AS (SELECT corpus, coalesce(max_by(episode_id, ROW(conv_id, start)) FILTER ((flags & 5) = 5 AND n <= 10), min_by(episode_id, ROW(conv_id, start))) AS episode_id FROM d GROUP BY 1)
SELECT (SELECT count(*) FROM d) AS episodes, (SELECT count(DISTINCT conv_id) FROM d) AS source_records, (SELECT string_agg(DISTINCT corpus, ' ' ORDER BY corpus) FROM d) AS corpora,
  (SELECT string_agg(corpus || ':' || from_move || ':' || to_move || ':' || n, ' ' ORDER BY corpus, place) FROM pc WHERE place <= 3) AS top_pairs,
  (SELECT string_agg(corpus || ':' || episode_id, ' ' ORDER BY corpus) FROM fe) AS examples, false AS synthetic"""

# --- Aggregations ------------------------------------------------------------------------

ORACLES["graph_stats"] = LIB + "SELECT * FROM gs"
ORACLES["descriptors"] = DESC + """SELECT episode_id, round(ln(1 + n), 6) AS log_turns, round(speakers / n, 6) AS speaker_fraction, round(switches / greatest(1, n - 1), 6) AS speaker_switching, round(sh, 6) AS speaker_entropy,
  round(top / n, 6) AS largest_speaker_share, round(1 - unknown / n, 6) AS known_action_fraction, round(m / n, 6) AS target_density, round(far / greatest(1, m), 6) AS nonadjacent_fraction,
  round(coalesce(mean_lag, 0) / greatest(1, n - 1), 6) AS mean_target_span, round(max_lag / greatest(1, n - 1), 6) AS max_target_span, round(branch / n, 6) AS branching_targets,
  round(clarify / n, 6) AS clarification_fraction, round(answer / n, 6) AS answer_fraction, round(question / n, 6) AS question_fraction, round(acknowledge / n, 6) AS acknowledgement_fraction,
  round(propose / n, 6) AS proposal_fraction, round(ah, 6) AS action_entropy, round(mlw, 6) AS mean_log_word_count, round(recur / greatest(1, n - 1), 6) AS lexical_recurrence FROM d"""
ORACLES["measures"] = DESC + "SELECT episode_id, n::INT AS turn_count, speakers::INT AS speakers, m::INT AS edge_count, far::INT AS nonadjacent, branch::INT AS branch, flags FROM d"
ORACLES["entropy"] = DESC + "SELECT episode_id, round(sh, 6) AS speaker_entropy, round(ah, 6) AS action_entropy FROM d"
ORACLES["pair_census"] = DESC + """SELECT corpus, from_move, to_move, n, row_number() OVER (PARTITION BY corpus ORDER BY n DESC, first)::INT AS place
FROM (SELECT corpus, from_move, to_move, count(*) AS n, min(ROW(conv_id, start, ord)) AS first FROM prs GROUP BY 1, 2, 3)"""
ORACLES["pathway_matrix"] = DESC + f""", ms AS (SELECT unnest({list(MOVES)!r}) AS m), t AS (SELECT from_move, to_move, count(*) AS n FROM prs GROUP BY 1, 2)
SELECT a.m AS from_move, b.m AS to_move, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN round(0.12 + 0.84 * ln(1 + n) / ln(1 + (SELECT max(n) FROM t)), 6) ELSE 0.0 END::DOUBLE AS intensity
FROM ms a CROSS JOIN ms b LEFT JOIN t ON t.from_move = a.m AND t.to_move = b.m"""
ORACLES["cohort_metrics"] = DESC + """SELECT count(*) AS n, round(avg(speakers), 6) AS mean_speakers, round(avg((speakers >= 3)::INT), 6) AS group_share, round(avg(reach), 6) AS mean_reach,
  round(sum(far) / sum(m), 6) AS nonadjacent_share, round(avg(known), 6) AS mean_known, round(avg((m > 0)::INT), 6) AS target_share FROM d WHERE (flags & 2) = 2"""
ORACLES["cohort_composition"] = DESC + "SELECT corpus, count(*) AS n FROM d WHERE (flags & 2) = 2 GROUP BY 1"
ORACLES["cohort_compare"] = DESC + """SELECT round((b.g - a.g) * 100, 6) AS group_points, round((b.k - a.k) * 100, 6) AS coverage_points FROM
(SELECT avg((speakers >= 3)::INT) AS g, avg(known) AS k FROM d WHERE corpus = 'threads') a, (SELECT avg((speakers >= 3)::INT) AS g, avg(known) AS k FROM d WHERE (flags & 4) = 4) b"""
_IR = "WITH r AS (SELECT event_id // 10 AS query, event_id % 10 + 1 AS rank, (user_id % 4 = 0)::INT AS rel FROM events), q AS (SELECT query, sum(rel) FILTER (rank <= 5) / 5 AS p5, sum(rel) / 10 AS p10, max(rel) AS success10, coalesce(1 / min(rank) FILTER (rel = 1), 0) AS rr10 FROM r GROUP BY 1)"
ORACLES["ir_metrics"] = _IR + " SELECT query, success10, round(p5, 6) AS p5, round(p10, 6) AS p10, round(rr10, 6) AS rr10 FROM q"
ORACLES["ir_means"] = _IR + " SELECT count(*) AS queries, round(avg(p5), 6) AS p5, round(avg(p10), 6) AS p10, round(avg(success10), 6) AS success10, round(avg(rr10), 6) AS rr10 FROM q"
ORACLES["latency_quantiles"] = "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events"

# --- Sequences ---------------------------------------------------------------------------

ORACLES["episode_windows"] = LIB + "SELECT episode_id, conv_id, corpus, start, stop FROM eps"
ORACLES["slice_episode"] = LIB + "SELECT episode_id, source, target, type, provenance FROM ee"
for _name, _kind in (("bigrams", 2), ("same_diff", 3), ("edge_tokens", 4)):
    ORACLES[_name] = TOKENS + f"SELECT episode_id, token, count(*) AS tf FROM tk WHERE kind = {_kind} GROUP BY 1, 2"
ORACLES["features"] = TOKENS + "SELECT episode_id, string_agg(token, ' ' ORDER BY kind, nth) AS tokens FROM tk GROUP BY 1"
ORACLES["prefix_dedupe"] = TOKENS + "SELECT episode_id, count(DISTINCT token)::INT AS distinct_tokens, arg_min(token, kind * 1000 + nth) AS first_token FROM tk GROUP BY 1"
ORACLES["lane_order"] = LIB + "SELECT conv_id, speaker, (row_number() OVER (PARTITION BY conv_id ORDER BY first) - 1)::INT AS lane FROM (SELECT conv_id, speaker, min(pos) AS first FROM turns GROUP BY 1, 2)"
_HELIX = LIB + """, h AS (SELECT *, CASE WHEN pos > 0 THEN (speaker <> lag(speaker) OVER w)::INT END AS switch FROM turns WHERE pos < 24 WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
hs AS (SELECT *, CASE WHEN pos = 0 THEN 0 ELSE 0.42 + 0.62 * avg(switch) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS step FROM h)
"""
ORACLES["helix_theta"] = _HELIX + "SELECT conv_id, pos, round(sum(step) OVER (PARTITION BY conv_id ORDER BY pos), 6) AS theta FROM hs"
ORACLES["helix_radius"] = LIB + """SELECT t.conv_id, t.pos, round((132 * (0.72 + 0.28 * least(coalesce(far, 0) / 6, 1)))::DOUBLE, 6) AS radius FROM turns t
LEFT JOIN (SELECT conv_id, source AS pos, max(abs(source - target)) AS far FROM trusted GROUP BY 1, 2) f ON f.conv_id = t.conv_id AND f.pos = t.pos WHERE t.pos < 24"""
ORACLES["bead_size"] = LIB + "SELECT conv_id, pos, round(least(17, 7 + 1.15 * sqrt(len(regexp_extract_all(text, '\\S+'))))::DOUBLE, 6) AS bead FROM turns WHERE pos < 24"
ORACLES["first_example"] = DESC + """SELECT corpus, coalesce(max_by(episode_id, ROW(conv_id, start)) FILTER ((flags & 5) = 5 AND n <= 10), min_by(episode_id, ROW(conv_id, start))) AS episode_id FROM d GROUP BY 1"""
ORACLES["cohort_example"] = DESC + "SELECT episode_id FROM d WHERE (flags & 2) = 2 ORDER BY CASE WHEN speakers >= 3 AND (flags & 4) > 0 AND n <= 10 THEN 0 WHEN speakers >= 3 THEN 1 ELSE 2 END, episode_id LIMIT 1"

# --- Ranking -----------------------------------------------------------------------------

_PARTS = """, pp AS (SELECT episode_id AS doc, list_filter(flatten(list(string_split(token, '_') ORDER BY kind, nth)), lambda x: x <> '') AS parts FROM tk GROUP BY 1),
ph AS (SELECT unnest([['a', 'clarify'], ['b', 'clarify', 'comment'], ['e', 'comment', 'near']]) AS phrase), pn AS (SELECT count(*) AS n, avg(len(parts)) AS mean FROM pp),
pt AS (SELECT doc, len(parts) AS len, phrase, len(list_filter(range(1, len(parts) - len(phrase) + 2), lambda i: parts[i:i + len(phrase) - 1] = phrase)) AS tf FROM pp CROSS JOIN ph),
pd AS (SELECT phrase, count(*) FILTER (tf > 0) AS df FROM pt GROUP BY 1)
SELECT doc, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
FROM pt JOIN pd USING (phrase) CROSS JOIN pn WHERE tf > 0 GROUP BY 1"""
ORACLES["bm25_phrase"] = TOKENS + _PARTS
ORACLES["safe_fts"] = """SELECT p_partkey, array_to_string(regexp_extract_all(lower('^x AND "' || p_name || '*)_' || p_type), '[\\p{L}\\p{N}]+')[1:16], ' OR ') AS terms FROM part"""
ORACLES["topk_pair"] = DESC + """SELECT episode_id, speakers::INT AS speakers, n::INT AS turn_count FROM d WHERE corpus = 'threads' AND episode_id IN (SELECT episode_id FROM prs WHERE from_move = 'clarify' AND to_move = 'answer')
ORDER BY speakers DESC, n, episode_id LIMIT 1"""
ORACLES["nearest_point"] = DESC + f""", q AS (SELECT * FROM (VALUES (1, 300.0, 250.0), (2, 120.0, 400.0), (3, -50.0, 10.0)) v(pointer, qx, qy)),
c AS (SELECT pointer, episode_id, sqrt(({_JX} * 1000 - qx) ** 2 + ({_JY} * 800 - qy) ** 2) AS distance FROM d CROSS JOIN q)
SELECT pointer, arg_min(episode_id, ROW(distance, episode_id)) AS episode_id, round(min(distance), 6) AS distance FROM c WHERE distance < 10 GROUP BY 1"""
_GRAMS = "SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM "
ORACLES["tfidf"] = LIB + f""", dw AS (SELECT conv_id AS id, regexp_extract_all(string_agg(lower(text), chr(10) ORDER BY pos), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM turns GROUP BY 1),
qw AS (SELECT 'error 19 purchase' AS id, ['error', '19', 'purchase'] AS w UNION ALL SELECT 'view click signup', ['view', 'click', 'signup']),
dg AS (SELECT id, term, count(*) AS tf FROM ({_GRAMS} dw) GROUP BY 1, 2), qg AS (SELECT id, term, count(*) AS tf FROM ({_GRAMS} qw) GROUP BY 1, 2),
vo AS (SELECT term, count(*) AS df FROM dg GROUP BY 1 HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 60000),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM dw)) / (1 + df)) + 1 AS idf FROM vo),
dv AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM dg JOIN idf USING (term)), qv AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM qg JOIN idf USING (term)),
dn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM dv GROUP BY 1), qn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM qv GROUP BY 1)
SELECT q.id AS query, d.id AS doc, round(sum(q.w / qn.norm * d.w / dn.norm), 6) AS score FROM qv q JOIN dv d USING (term) JOIN dn ON dn.id = d.id JOIN qn ON qn.id = q.id GROUP BY 1, 2"""
_DENSE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM v),
s AS (SELECT q.vec_id AS query, d.vec_id AS doc, round(list_dot_product(q.v, d.v), 6) AS score FROM u q CROSS JOIN u d WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INT AS rank FROM s)"""
ORACLES["dense"] = _DENSE + " SELECT query, doc, score, rank FROM r WHERE rank <= 10"
ORACLES["argsort_stable"] = _DENSE + " SELECT query, doc, rank FROM r WHERE rank <= 5"

# --- Alignment: the score matrix row by row; a gap chain in a row is a running maximum ---

ORACLES["sw_best_raw"] = LIB.replace("WITH th", "WITH RECURSIVE th") + """, q AS (SELECT list(action ORDER BY pos) AS q FROM turns WHERE conv_id = 'threads:7' AND pos < 6), c AS (SELECT episode_id, list(action ORDER BY i) AS c FROM et GROUP BY 1),
dp AS (SELECT episode_id, c, q, 0 AS i, list_transform(range(0, len(c) + 1), lambda x: 0.0::DOUBLE) AS line, 0.0::DOUBLE AS best FROM c CROSS JOIN q
  UNION ALL
  SELECT episode_id, c, q, i + 1, list_concat([0.0::DOUBLE], row_), greatest(best, list_max(row_)) FROM (
    SELECT *, list_transform(range(1, len(c) + 1), lambda j: list_max(base[1:j]) - j) AS row_ FROM (
      SELECT *, list_transform(range(1, len(c) + 1), lambda j: greatest(0.0, line[j] + CASE WHEN q[i + 1] = 'unknown' OR c[j] = 'unknown' THEN 0.25 WHEN q[i + 1] = c[j] THEN 2.0 ELSE -1.0 END, line[j + 1] - 1.0)::DOUBLE + j) AS base
      FROM dp WHERE i < len(q))))
SELECT episode_id, best FROM dp WHERE i = len(q)"""

ORACLES["sw_local"] = ORACLES["sw_best_raw"]

# --- Graphs ------------------------------------------------------------------------------

_M3 = LIB + """, pr AS (SELECT a.conv_id, list_sort(list_distinct([a.source, a.target, b.source, b.target])) AS nd, a.source AS a1, a.target AS a2, a.type AS atype, b.source AS b1, b.target AS b2, b.type AS btype
  FROM edges a JOIN edges b ON a.conv_id = b.conv_id AND a.ord < b.ord WHERE len(list_distinct([a.source, a.target, b.source, b.target])) = 3),
m AS (SELECT p.conv_id, x.action || ',' || y.action || ',' || z.action || '|S1,' || CASE WHEN y.speaker = x.speaker THEN 'S1' ELSE 'S2' END || ',' ||
    CASE WHEN z.speaker = x.speaker THEN 'S1' WHEN z.speaker = y.speaker THEN 'S2' WHEN y.speaker = x.speaker THEN 'S2' ELSE 'S3' END || '|' ||
    array_to_string(list_sort([(list_position(nd, a1) - 1) || '>' || (list_position(nd, a2) - 1) || ':' || atype, (list_position(nd, b1) - 1) || '>' || (list_position(nd, b2) - 1) || ':' || btype]), ',') AS key
  FROM pr p JOIN turns x ON x.conv_id = p.conv_id AND x.pos = nd[1] JOIN turns y ON y.conv_id = p.conv_id AND y.pos = nd[2] JOIN turns z ON z.conv_id = p.conv_id AND z.pos = nd[3]),
mk AS (SELECT DISTINCT conv_id, key FROM m), mi AS (SELECT key, count(*) AS conversations FROM mk GROUP BY 1)
"""
ORACLES["motif3"] = _M3 + "SELECT conv_id, key FROM mk"
ORACLES["motif_index"] = _M3 + "SELECT key, conversations FROM mi"
ORACLES["j_motif"] = _M3 + "SELECT conv_id, count(*) AS eligible FROM mk JOIN mi USING (key) WHERE conversations BETWEEN 2 AND 100 GROUP BY 1"
ORACLES["out_edges"] = LIB + "SELECT conv_id, target, type, provenance FROM edges WHERE source = 5"
ORACLES["evidence"] = LIB + "SELECT annotation AS badge FROM turns WHERE conv_id = 'threads:7' UNION SELECT provenance FROM edges WHERE conv_id = 'threads:7'"
ORACLES["union_sources"] = LIB + "SELECT corpus, corpus_ord, count(*) AS n FROM convs GROUP BY 1, 2"
ORACLES["episode_census"] = LIB + "SELECT corpus, count(*) AS episodes, count(DISTINCT conv_id) AS conversations, sum(stop - start)::BIGINT AS turns FROM eps GROUP BY 1"
