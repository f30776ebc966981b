"""DuckDB SQL of the catalogue's queries."""

from __future__ import annotations

# For each direction its sides east-west and north-south.
DIRECTIONS = {"Northeast": ("east", "north"), "Northwest": ("west", "north"), "Southeast": ("east", "south"), "Southwest": ("west", "south"), "North": ("", "north"), "South": ("", "south"), "East": ("east", ""), "West": ("west", "")}

WORLD = """
w AS (SELECT l_orderkey AS map_id, l_partkey AS entity, max(l_extendedprice) AS x, max(l_quantity) AS y FROM lineitem GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY entity) AS rk FROM w),
r AS (SELECT a.map_id, row_number() OVER (PARTITION BY a.map_id ORDER BY a.rk, b.rk) AS seq, a.entity AS a,
    (CASE WHEN a.y > b.y THEN 'north' ELSE 'south' END) || (CASE WHEN a.x > b.x THEN 'east' ELSE 'west' END) AS dir, b.entity AS b
  FROM k a JOIN k b ON a.map_id = b.map_id AND a.rk - b.rk IN (1, 2) AND a.x <> b.x AND a.y <> b.y)"""
EDGES = (
    WORLD
    + """,
e AS (SELECT map_id, 'x' AS axis, CASE WHEN dir LIKE '%east' THEN a ELSE b END AS src, CASE WHEN dir LIKE '%east' THEN b ELSE a END AS dst FROM r
  UNION SELECT map_id, 'y', CASE WHEN dir LIKE 'north%' THEN a ELSE b END, CASE WHEN dir LIKE 'north%' THEN b ELSE a END FROM r)"""
)
CLOSED = (
    EDGES
    + """,
c AS (SELECT map_id, axis, src, dst FROM e UNION SELECT c.map_id, c.axis, c.src, e.dst FROM c JOIN e ON c.map_id = e.map_id AND c.axis = e.axis AND c.dst = e.src)"""
)
_IN = (
    CLOSED
    + """,
sides AS (SELECT map_id, dst AS ref, src AS obj, CASE axis WHEN 'x' THEN 'east' ELSE 'north' END AS side FROM c
  UNION SELECT map_id, src, dst, CASE axis WHEN 'x' THEN 'west' ELSE 'south' END FROM c),
held AS (SELECT map_id, ref, obj, list(side) AS s FROM sides GROUP BY ALL),
dirs AS (SELECT * FROM (VALUES """
    + ", ".join(f"('{d}', '{x}', '{y}')" for d, (x, y) in DIRECTIONS.items())
    + """) t(dir, ew, ns)),
lies AS (SELECT map_id, ref, obj, dir FROM held, dirs WHERE (ew = '' OR list_contains(s, ew)) AND (ns = '' OR list_contains(s, ns)))"""
)
_PASSAGE = """
SELECT map_id, 'Consider a map with multiple objects:' || chr(10) || 'Part ' || arg_min(b, seq) || ' is in the map. ' ||
  string_agg('Part ' || a || ' is to the ' || upper(dir[1]) || dir[2:] || ' of Part ' || b || '.', ' ' ORDER BY seq) AS text FROM r GROUP BY map_id"""

# each map's question is about its least (lo) and greatest (hi) entity
ASKED = (
    _IN
    + """,
ends AS (SELECT map_id, min(least(a, b)) AS lo, max(greatest(a, b)) AS hi FROM r GROUP BY map_id),
rel AS (SELECT n.map_id, lo, hi, coalesce(list_contains(h.s, 'east'), false) AS e, coalesce(list_contains(h.s, 'west'), false) AS w,
    coalesce(list_contains(h.s, 'north'), false) AS n, coalesce(list_contains(h.s, 'south'), false) AS s
  FROM ends n LEFT JOIN held h ON h.map_id = n.map_id AND h.ref = n.lo AND h.obj = n.hi),
up AS (SELECT n.map_id, count(l.obj) AS north FROM ends n LEFT JOIN lies l ON l.map_id = n.map_id AND l.ref = n.lo AND l.dir = 'North' GROUP BY n.map_id),
fit AS (SELECT rel.*, north, map_id % 3 AS kind,
    CASE WHEN e OR w OR n OR s THEN list_filter([CASE WHEN NOT s AND NOT w THEN 'A' END, CASE WHEN NOT s AND NOT e THEN 'B' END, CASE WHEN NOT n AND NOT w THEN 'C' END, CASE WHEN NOT n AND NOT e THEN 'D' END], lambda x: x IS NOT NULL) ELSE [] END AS known,
    list_filter([CASE WHEN NOT s AND NOT w THEN 'A' END, CASE WHEN NOT s AND NOT e THEN 'B' END, CASE WHEN NOT n AND NOT w THEN 'C' END, CASE WHEN NOT n AND NOT e THEN 'D' END], lambda x: x IS NOT NULL) AS open
  FROM rel JOIN up USING (map_id)),
counted AS (SELECT *, CASE WHEN north <= 3 THEN [chr(CAST(65 + north AS INTEGER))] ELSE [] END AS by_count FROM fit),
ans AS (SELECT map_id, lo, hi, kind, north,
    CASE kind WHEN 0 THEN known WHEN 1 THEN CASE WHEN n AND e THEN ['A'] ELSE ['A', 'B'] END ELSE by_count END AS definite,
    CASE kind WHEN 0 THEN open WHEN 1 THEN CASE WHEN NOT s AND NOT w THEN ['A', 'B', 'C'] ELSE ['B', 'C'] END ELSE by_count END AS possible
  FROM counted),
said AS (SELECT map_id, CASE WHEN len(definite) > 0 THEN array_to_string(definite, ',') ELSE 'No valid options found' END AS d,
    CASE WHEN len(possible) > 0 THEN array_to_string(possible, ',') ELSE 'No valid options found' END AS p, definite, lo, hi, kind FROM ans)"""
)
TASKS = """
t AS (SELECT user_id AS run_id, event_type AS task, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 10000 AS accuracy,
    avg(CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 100 AS DOUBLE) END) AS f1 FROM events GROUP BY ALL)"""
TOP = """
u AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
sim AS (SELECT q.vec_id AS query_id, i.vec_id, round(list_cosine_similarity(q.v, i.v), 6) AS score FROM u q, u i WHERE q.vec_id % 20 = 0),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sim) WHERE rank <= 3)"""


def _set(c: str) -> str:
    return f"list_sort(list_distinct(regexp_split_to_array({c}, '[,;| ]+')))"


SQL = {
    "map_relations": f"WITH {WORLD} SELECT * FROM r",
    "passage_text": f"WITH {WORLD} {_PASSAGE}",
    "parse_relations": f"WITH {WORLD} SELECT map_id, seq, first_value('Part ' || b) OVER (PARTITION BY map_id ORDER BY seq) AS first, 'Part ' || a AS a, dir, 'Part ' || b AS b FROM r",
    "axis_edges": f"WITH {EDGES} SELECT * FROM e",
    "axis_closure": f"WITH RECURSIVE {CLOSED} SELECT * FROM c",
    "closure_reduction": f"WITH RECURSIVE {CLOSED} SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c a JOIN c b ON a.map_id = b.map_id AND a.axis = b.axis AND a.dst = b.src WHERE a.map_id = c.map_id AND a.axis = c.axis AND a.src = c.src AND b.dst = c.dst)",
    "axis_relation_pairs": f"""WITH RECURSIVE {CLOSED}, p AS (SELECT a.map_id, a.entity AS a, b.entity AS b FROM w a JOIN w b ON a.map_id = b.map_id AND a.entity < b.entity),
d AS (SELECT map_id, axis, src AS a, dst AS b, 1 AS gt FROM c UNION ALL SELECT map_id, axis, dst, src, 0 FROM c)
SELECT p.map_id, p.a, p.b, coalesce(max(CASE WHEN axis = 'x' THEN CASE gt WHEN 1 THEN 'gt' ELSE 'lt' END END), 'unknown') AS x_rel, coalesce(max(CASE WHEN axis = 'y' THEN CASE gt WHEN 1 THEN 'gt' ELSE 'lt' END END), 'unknown') AS y_rel
FROM p LEFT JOIN d ON p.map_id = d.map_id AND p.a = d.a AND p.b = d.b GROUP BY p.map_id, p.a, p.b""",
    "count_in_direction": f"WITH RECURSIVE {_IN} SELECT map_id, ref, dir, count(*) AS n FROM lies GROUP BY ALL",
    "which_in_direction": f"WITH RECURSIVE {_IN} SELECT map_id, ref, dir, string_agg(CAST(obj AS VARCHAR), ',' ORDER BY obj) AS objects FROM lies GROUP BY ALL",
    "answers_definite": f"WITH RECURSIVE {ASKED} SELECT map_id, d AS answer FROM said",
    "answers_possible": f"WITH RECURSIVE {ASKED} SELECT map_id, p AS answer FROM said",
    "clean_oracle": f"""WITH RECURSIVE {ASKED},
v AS (SELECT *, CASE kind WHEN 0 THEN MAP {{'A': 'Northeast', 'B': 'Northwest', 'C': 'Southeast', 'D': 'Southwest'}} WHEN 1 THEN MAP {{'A': 'Part ' || hi, 'B': 'Part ' || lo, 'C': 'Nobody', 'D': ''}} ELSE MAP {{'A': '0', 'B': '1', 'C': '2', 'D': '3'}} END AS o FROM said)
SELECT map_id, array_to_string(definite, ',') AS oracle_option, CASE WHEN len(definite) > 0 THEN o[definite[1]] ELSE '' END AS oracle_answer,
  array_to_string([x || '. ' || o[x] FOR x IN definite], ' | ') AS oracle_full_answer, CASE WHEN len(definite) = 0 THEN d END AS clean_note FROM v""",
    "strict_loose_acc": f"""WITH RECURSIVE {ASKED} SELECT map_id, CASE WHEN {_set("d")} = {_set("p")} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS strict_acc,
  CASE WHEN list_has_all({_set("p")}, {_set("d")}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS loose_acc, CASE WHEN upper(p[1]) = upper(d) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS acc_gen FROM said""",
    "state_groups": f"""WITH RECURSIVE {CLOSED}, ax AS (SELECT map_id, entity, axis FROM w, (VALUES ('x'), ('y')) t(axis)),
nb AS (SELECT ax.map_id, ax.axis, ax.entity, list_sort(list(DISTINCT d.dst) FILTER (d.dst IS NOT NULL)) AS down, list_sort(list(DISTINCT u.src) FILTER (u.src IS NOT NULL)) AS up
  FROM ax LEFT JOIN c d ON d.map_id = ax.map_id AND d.axis = ax.axis AND d.src = ax.entity LEFT JOIN c u ON u.map_id = ax.map_id AND u.axis = ax.axis AND u.dst = ax.entity GROUP BY ALL)
SELECT map_id, axis, string_agg(CAST(entity AS VARCHAR), ',' ORDER BY entity) AS members, CAST(coalesce(any_value(len(down)), 0) AS BIGINT) AS level FROM nb GROUP BY map_id, axis, down, up""",
    "random_walk": """WITH m AS (SELECT *, event_id % 8 AS k FROM events), p AS (SELECT user_id, event_id,
  sum(CASE k WHEN 2 THEN 10 WHEN 3 THEN -10 WHEN 4 THEN 10 WHEN 5 THEN -10 WHEN 6 THEN 10 WHEN 7 THEN -10 ELSE 0 END) OVER o AS x,
  sum(CASE k WHEN 0 THEN 10 WHEN 1 THEN -10 WHEN 4 THEN 10 WHEN 5 THEN 10 WHEN 6 THEN -10 WHEN 7 THEN -10 ELSE 0 END) OVER o AS y
  FROM m WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CASE WHEN y < 0 AND x < 0 THEN 'Northeast' WHEN y < 0 AND x > 0 THEN 'Northwest' WHEN y > 0 AND x < 0 THEN 'Southeast' WHEN y > 0 AND x > 0 THEN 'Southwest'
  WHEN y < 0 THEN 'North' WHEN y > 0 THEN 'South' WHEN x < 0 THEN 'East' WHEN x > 0 THEN 'West' END AS home FROM p""",
    "choice_shuffle": """WITH s AS (SELECT p_partkey, p_name, unnest([p_brand, p_type, CAST(p_size AS VARCHAR), p_name]) AS v, unnest([0, 1, 2, 3]) AS k FROM part),
o AS (SELECT p_partkey, any_value(p_name) AS p_name, list(v ORDER BY md5(p_partkey || '|42|' || k), v) AS c FROM s GROUP BY p_partkey)
SELECT p_partkey, c[1] AS choice_a, c[2] AS choice_b, c[3] AS choice_c, c[4] AS choice_d, CAST(list_position(c, p_name) - 1 AS INTEGER) AS correct_index FROM o""",
    "extract_choice": r"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations),
f AS (SELECT conv_id, turn, coalesce(nullif(regexp_extract(t, '^\s*[(\[]?\s*([A-Da-d])[)\].:)]?\s', 1), ''), nullif(regexp_extract(t, '(?i)(?:answer|choice|option)\s+(?:is\s+)?[(\[]?\s*([A-Da-d])[)\].:)]?', 1), ''),
  nullif(regexp_extract(t, '(?:^|[^\pL\pN_\pM])([A-Da-d])(?:$|[^\pL\pN_\pM])', 1), '')) AS c FROM t)
SELECT conv_id, turn, CAST(coalesce(ascii(upper(c)) - 65, -1) AS INTEGER) AS choice FROM f""",
    "answer_last_match": r"SELECT conv_id, turn, list_last(regexp_extract_all(text, '\b([A-D])\b', 1)) AS last, nullif(regexp_extract(text, '\b([A-D])\b', 1), '') AS first FROM conversations",
    "chat_messages": "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chat, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS last_user FROM conversations GROUP BY conv_id",
    "macro_f1": """WITH l AS (SELECT quality AS x FROM labels UNION SELECT toxic FROM labels),
n AS (SELECT x, count(*) FILTER (quality = x) AS g, count(*) FILTER (toxic = x) AS p, count(*) FILTER (quality = x AND toxic = x) AS b FROM l, labels GROUP BY x)
SELECT round(avg(2.0::DOUBLE * b / (g + p)), 9) AS macro_f1 FROM n""",
    "mcc": "SELECT round(corr(quality, toxic), 9) AS mcc FROM labels",
    "run_summary": f"WITH {TASKS} SELECT run_id, round(avg(accuracy), 6) AS avg_accuracy, round(avg(f1), 6) AS avg_f1, count(*) AS n_tasks FROM t GROUP BY run_id",
    "best_run": f"WITH {TASKS} SELECT run_id, round(avg(accuracy), 6) AS avg_accuracy FROM t GROUP BY run_id ORDER BY 2 DESC, 1 LIMIT 1",
    "error_top5": f"""WITH {TASKS},
a AS (SELECT run_id, task, CAST(round(round(accuracy, 6) * 1000000) AS BIGINT) AS m FROM t),
low AS (SELECT 'Low accuracy on ' || task AS pattern, run_id, 0 AS pos, run_id || ': ' || (m + 50) // 10000 || '.' || lpad(CAST((m + 50) // 100 % 100 AS VARCHAR), 2, '0') || '%' AS example FROM a WHERE m < 500000),
w AS (SELECT user_id, event_type, event_id, event_id % 4 AS t, (event_id // 4) % 4 AS p FROM events WHERE event_id % 4 <> (event_id // 4) % 4),
mis AS (SELECT 'Misclassification in ' || event_type AS pattern, user_id AS run_id, event_id AS pos, user_id || ' doc=' || event_id || ': predicted=' || chr(CAST(65 + p AS INTEGER)) || ' (idx ' || p || '), expected=' || chr(CAST(65 + t AS INTEGER)) || ' (idx ' || t || ')' AS example
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM w) WHERE r <= 5),
k AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY run_id, pos) AS n FROM (SELECT * FROM low UNION ALL SELECT * FROM mis))
SELECT pattern, count(*) AS count, string_agg(example, '; ' ORDER BY n) FILTER (n <= 5) AS examples FROM k GROUP BY pattern""",
    "low_accuracy": f"WITH {TASKS} SELECT run_id, task FROM t WHERE accuracy < 0.5",
    "metric_matrix": "SELECT 'value' AS metric, user_id AS run_id, " + ", ".join(f"coalesce(round(max(value) FILTER (event_type = '{t}') * 100, 6), 0) AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id",
    "metric_grid": """WITH f AS (SELECT user_id AS run_id, event_type AS task, unnest(['value', 'loss']) AS metric, unnest([value, -abs(value)]) AS v FROM events),
r AS (SELECT metric, task, run_id, round(max(v) * 100, 6) AS v FROM f WHERE metric IN (SELECT metric FROM f GROUP BY metric HAVING max(v) > 0) GROUP BY ALL),
c AS (SELECT * FROM (SELECT DISTINCT metric, task FROM r), (SELECT DISTINCT run_id FROM r))
SELECT c.metric, c.task, c.run_id, coalesce(r.v, 0) AS value FROM c LEFT JOIN r ON r.metric = c.metric AND r.task = c.task AND r.run_id = c.run_id""",
    "props_metrics": "SELECT event_id AS run_id, 't' AS task, 'acc' AS metric, 'none' AS filter, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value, 0.5::DOUBLE AS stderr FROM events",
    "last_n_runs": "SELECT user_id AS run_id FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 5",
    "missing_runs": "SELECT c_custkey AS run_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
    "topk_neighbors": f"WITH {TOP} SELECT query_id, rank, vec_id, score FROM top",
    "rag_context": f"""WITH {TOP}, c AS (SELECT query_id, string_agg('- ' || d.text, chr(10) ORDER BY rank) AS context FROM top JOIN documents d ON d.doc_id = top.vec_id GROUP BY query_id)
SELECT query_id, length(context) AS n_chars, md5(context) AS context_md5 FROM c""",
    "chunk_documents": """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(greatest(1, CAST(ceil((len(w) - 100) / 700.0) AS BIGINT)))) AS chunk_no FROM d WHERE len(w) > 0)
SELECT doc_id, chunk_no, md5(array_to_string(w[chunk_no * 700 + 1 : chunk_no * 700 + 800], ' ')) AS text_md5 FROM c""",
    "train_test_split": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) > count(*) OVER () - floor(count(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS split FROM documents",
    "id_prefix_filter": r"SELECT page_id FROM pages WHERE starts_with(url, 'https://') AND regexp_matches(url, '/p\d*[02468]$|\d*[02468](\.html)?$')",
    "two_stage_generate": """WITH g AS (SELECT item_id, length(text) || ' characters' AS t, text FROM benchmark), a AS (SELECT *, ['A', 'B', 'C', 'D'][(length(text || chr(10) || t || chr(10) || chr(10) || 'Answer: ') % 4) + 1] AS x FROM g)
SELECT item_id, t || chr(10) || chr(10) || 'Answer: ' || x AS response, x AS answer FROM a""",
}
