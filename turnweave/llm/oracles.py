"""SQL for DuckDB that says what the operators' queries return, for those that SQL can express.

The toxicity and quality queries depend on fitted models and have none; their tests hold
them against held-out labels.
"""

from __future__ import annotations

from turnweave.llm import licenses, mixing, secretscan, sharding, vecgraph

ORACLES: dict[str, str] = {}


def _both_cases(pattern: str) -> str:
    """A folded rule for RE2, whose (?i) would also fold non-ASCII letters: keyword letters as two-letter classes, value classes as they are."""
    out, depth, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            width = 4 if pattern[i + 1] == "x" else 2
            out.append(pattern[i : i + width])
            i += width
            continue
        depth += (c == "[") - (c == "]")
        out.append(f"[{c.lower()}{c.upper()}]" if c.isalpha() and not depth else c)
        i += 1
    return "".join(out)


def _secrets() -> str:
    parts = []
    for order, rule in enumerate(secretscan.RULES):
        # non-greedy repeats are not used, so RE2's leftmost-first matches are Java's and Python's
        pattern = "'" + (_both_cases(rule.pattern) if rule.folded else rule.pattern).replace("'", "''") + "'"
        parts.append(f"""SELECT doc_id, {order} AS ord, '{rule.kind}' AS kind, nth, gap, len(m) AS n, len(g) AS tested FROM (
          SELECT doc_id, unnest(range(1, len(ms) + 1)) AS nth, unnest(list_transform(gaps[1:len(ms)], lambda x: len(x))) AS gap, unnest(ms) AS m, unnest(gs) AS g FROM (
            SELECT doc_id, string_split_regex(text, {pattern}) AS gaps, regexp_extract_all(text, {pattern}) AS ms, regexp_extract_all(text, {pattern}, {rule.group}) AS gs FROM t)) WHERE len(m) > 0""")
    least = " ".join(f"WHEN {i} THEN tested >= {r.least}" for i, r in enumerate(secretscan.RULES))
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), a AS ({" UNION ALL ".join(parts)}),
b AS (SELECT *, (sum(gap + n) OVER (PARTITION BY doc_id, ord ORDER BY nth))::BIGINT AS stop FROM a),
s AS (SELECT doc_id, ord, kind, stop - n AS start, stop FROM b WHERE CASE ord {least} END),
g AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3) AS base,
  {", ".join(f"count(*) FILTER (ord = {i}) AS n_{k}" for i, k in enumerate(secretscan.BASE_KINDS))} FROM s GROUP BY 1)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secretscan.BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)"""


ORACLES["op1_secret_scan"] = _secrets()

_WORDS = "regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES["op2_minhash_near_dedup"] = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
sh AS (SELECT doc_id, s, count(*) AS k FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w) GROUP BY 1, 2),
n AS (SELECT doc_id, sum(k) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.k, b.k)) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE m >= 0.8 * (x.n + y.n - m)),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node AS doc_id, min(root) AS class_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, doc_id = coalesce(class_id, doc_id) AS kept FROM w LEFT JOIN c USING (doc_id)"""


def _licenses() -> str:
    places = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p))
        places.append(f"SELECT doc_id, unnest(list_filter(range(1, len(w) - {len(p) - 2}), lambda i: {test})) - 1 AS place, '{label}' AS label FROM w")
    templates = ", ".join(f"('{label}', {licenses.template_words(text)!r})" for label, text in licenses.TEMPLATES)
    return f"""WITH w AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents), pl AS ({" UNION ALL ".join(places)}),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM pl GROUP BY 1),
t AS (SELECT * FROM (VALUES {templates}) v(label, words)),
ln AS (SELECT doc_id, list_distinct({_WORDS.format(t="line")}) AS held FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
m AS (SELECT doc_id, label, len(list_intersect(words, held)) / len(words) AS containment FROM ln CROSS JOIN t WHERE len(list_intersect(words, held)) >= ceil({licenses.THRESHOLD} * len(words) - 1e-9)),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM pl UNION ALL SELECT doc_id, label FROM m) GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce((SELECT max(containment) FROM m WHERE m.doc_id = w.doc_id), 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN al USING (doc_id)"""


ORACLES["op3_license_scan"] = _licenses()


def _sharding() -> str:
    p, m = sharding.MODULUS, sharding.MULTIPLIER

    def spread(v: str, k: str) -> str:
        x = f"(({v} + {k}) % {p} * {m} % {p})"
        return f"(({x} * {x} + {k}) % {p} * {m} % {p})"

    bucket = "('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), size, text_crc32)), 1, 8))::BIGINT"
    rounds, last = [], "f0"
    for i, key in enumerate(sharding.ROUND_KEYS):
        rounds.append(f"l{i} AS (SELECT *, (l + {spread('r', str(key))}) % a AS l2 FROM {last})")
        rounds.append(f"f{i + 1} AS (SELECT * EXCLUDE (l, r, l2), l2 AS l, (r + {spread('l2', str(key + 1))}) % b AS r FROM l{i})")
        last = f"f{i + 1}"
    # all numbers of the domain are permuted once; a walk follows the images until they are below n
    return f"""WITH RECURSIVE sz AS (SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size, coalesce(text, '') AS text FROM documents),
tb AS (SELECT list(c ORDER BY b) AS tb FROM (SELECT b, list_reduce(range(0, 9), lambda x, i: CASE WHEN i = 0 THEN x WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, b) AS c FROM (SELECT unnest(range(0, 256)) AS b))),
cr AS (SELECT doc_id, size, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT), lambda x, y: xor(x >> 8, tb[xor(x & 255, y) + 1]), 4294967295), 4294967295) AS text_crc32 FROM sz CROSS JOIN tb),
nm AS (SELECT *, row_number() OVER (ORDER BY {bucket} % {sharding.BUCKETS}, doc_id, size, text_crc32) - 1 AS number, count(*) OVER () AS n FROM cr),
k AS (SELECT DISTINCT n, ceil(sqrt(n))::BIGINT AS a, (n + ceil(sqrt(n))::BIGINT - 1) // ceil(sqrt(n))::BIGINT AS b FROM nm),
f0 AS (SELECT x, n, a, b, x % a AS l, x // a AS r FROM (SELECT *, unnest(range(0, a * b)) AS x FROM k)), {", ".join(rounds)},
im AS (SELECT x, n, r * a + l AS y FROM {last}),
wk AS (SELECT x AS number, y, n FROM im WHERE x < n UNION ALL SELECT wk.number, im.y, wk.n FROM wk JOIN im ON im.x = wk.y WHERE wk.y >= wk.n)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (y % {sharding.SHARDS})::INT AS shard, y // {sharding.SHARDS} AS slot, NULL::INT AS grown_shard FROM nm JOIN wk USING (number) WHERE y < wk.n"""


ORACLES["op4_feistel_sharding"] = _sharding()

_RATIO = f"[{', '.join(str(float(w)) for w in mixing.WEIGHTS)}]"
ORACLES["op5_source_mixing"] = f"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(coalesce(text, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, {_RATIO}[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM d GROUP BY 1),
-- targets above the ceiling are set to it and the rest is shared again, until none is above
f AS (SELECT 0 AS round, source, source_size, weight, false AS fixed FROM s UNION ALL
  SELECT round + 1, source, source_size, weight, fixed OR weight * level >= {mixing.CEILING} * source_size FROM (
    SELECT *, ({mixing.BUDGET} * sum(source_size) OVER () - coalesce(sum({mixing.CEILING} * source_size) FILTER (fixed) OVER (), 0)) / nullif(sum(weight) FILTER (NOT fixed) OVER (), 0) AS level FROM f) WHERE round < (SELECT count(*) FROM s)),
e AS (SELECT *, ({mixing.BUDGET} * sum(source_size) OVER () - coalesce(sum({mixing.CEILING} * source_size) FILTER (fixed) OVER (), 0)) / nullif(sum(weight) FILTER (NOT fixed) OVER (), 0) AS level FROM f WHERE round = (SELECT max(round) FROM f)),
t AS (SELECT source, source_size, (CASE WHEN fixed THEN {mixing.CEILING} * source_size ELSE weight * level END)::DOUBLE AS target FROM e),
c AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
  ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || digest), 1, 8))::BIGINT / 4294967296.0 AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(rate) + (u < rate - floor(rate))::INT)::BIGINT * size AS taken, (floor(rate) + (u < rate - floor(rate))::INT)::INT AS copies FROM c"""

ORACLES["op7_embedding_near_dedup"] = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS n FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND a.n > 0 AND b.n > 0 WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= {vecgraph.THRESHOLD}),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT vec_id, coalesce((SELECT count(*) FROM l WHERE l.a = vec_id), 0) AS n_links, component_id, vec_id = component_id AS kept FROM (SELECT node AS vec_id, min(root) AS component_id FROM r GROUP BY 1)"""

ORACLES["op8_warc_round_trip"] = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT *, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to FROM g"""

ORACLES["op9_decontamination"] = f"""WITH d AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda k: w[k:k + 9]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM i),
ls AS (SELECT DISTINCT len(g) AS n FROM win),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d JOIN ls ON len(w) >= n),
h AS (SELECT doc_id, k, n, item_id FROM dw JOIN win ON g = w[k:k + n - 1]),
hw AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM (SELECT DISTINCT doc_id, k, n FROM h)) GROUP BY 1),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""
