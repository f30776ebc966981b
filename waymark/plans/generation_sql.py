"""DuckDB SQL of the queries that generate questions, narratives and walks."""

from __future__ import annotations

from waymark.operators.worlds import ENTITIES
from waymark.plans.oracles import DIRECTIONS, WORLD


def graph(rel: str) -> str:
    """CTEs e (edges) and c (closure) of a table of relations."""
    return f""",
e AS (SELECT map_id, 'x' AS axis, CASE WHEN dir LIKE '%east' THEN a ELSE b END AS src, CASE WHEN dir LIKE '%east' THEN b ELSE a END AS dst FROM {rel}
  UNION SELECT map_id, 'y', CASE WHEN dir LIKE 'north%' THEN a ELSE b END, CASE WHEN dir LIKE 'north%' THEN b ELSE a END FROM {rel}),
c AS (SELECT map_id, axis, src, dst FROM e UNION SELECT c.map_id, c.axis, c.src, e.dst FROM c JOIN e ON c.map_id = e.map_id AND c.axis = e.axis AND c.dst = e.src)"""


def states(nodes: str) -> str:
    """CTE st (map_id, axis, state) of the closure c and a table of nodes (map_id, node)."""
    return f""",
nax AS (SELECT map_id, node, axis FROM {nodes}, (VALUES ('x'), ('y')) t(axis)),
dn AS (SELECT map_id, axis, src AS node, list_sort(list(dst)) AS down FROM c GROUP BY ALL),
un AS (SELECT map_id, axis, dst AS node, list_sort(list(src)) AS up FROM c GROUP BY ALL),
nb AS (SELECT nax.map_id, nax.axis, nax.node, coalesce(down, []) AS down, coalesce(up, []) AS up FROM nax LEFT JOIN dn USING (map_id, axis, node) LEFT JOIN un USING (map_id, axis, node)),
gr AS (SELECT map_id, axis, list_sort(list(node)) AS members FROM nb GROUP BY map_id, axis, down, up),
lb AS (SELECT *, CASE WHEN len(members) = 1 THEN CAST(members[1] AS VARCHAR) ELSE '{{' || array_to_string(members, ', ') || '}}' END AS label FROM gr),
mb AS (SELECT map_id, axis, label, unnest(members) AS node FROM lb),
two AS (SELECT DISTINCT a.map_id, a.axis, a.src, b.dst FROM c a JOIN c b ON a.map_id = b.map_id AND a.axis = b.axis AND a.dst = b.src),
hop AS (SELECT DISTINCT c.map_id, c.axis, l.label AS lo, h.label AS hi FROM c ANTI JOIN two ON c.map_id = two.map_id AND c.axis = two.axis AND c.src = two.src AND c.dst = two.dst
  JOIN mb h ON h.map_id = c.map_id AND h.axis = c.axis AND h.node = c.src JOIN mb l ON l.map_id = c.map_id AND l.axis = c.axis AND l.node = c.dst WHERE h.label <> l.label),
walked AS (SELECT DISTINCT map_id, axis, lo AS chain, lo AS tail FROM hop h WHERE NOT EXISTS (SELECT 1 FROM hop g WHERE g.map_id = h.map_id AND g.axis = h.axis AND g.hi = h.lo)
  UNION ALL SELECT p.map_id, p.axis, p.chain || ' < ' || h.hi, h.hi FROM walked p JOIN hop h ON h.map_id = p.map_id AND h.axis = p.axis AND h.lo = p.tail),
chains AS (SELECT map_id, axis, chain FROM walked p WHERE NOT EXISTS (SELECT 1 FROM hop h WHERE h.map_id = p.map_id AND h.axis = p.axis AND h.lo = p.tail)
  UNION SELECT map_id, axis, label FROM lb WHERE (map_id, axis) IN (SELECT map_id, axis FROM hop) AND (map_id, axis, label) NOT IN (SELECT map_id, axis, lo FROM hop UNION SELECT map_id, axis, hi FROM hop)
  UNION SELECT map_id, axis, CAST(unnest(members) AS VARCHAR) FROM lb WHERE (map_id, axis) NOT IN (SELECT map_id, axis FROM hop)),
st AS (SELECT map_id, axis, string_agg(chain, ', ' ORDER BY chain) AS state FROM chains GROUP BY map_id, axis)"""


_NAMED = WORLD + ", rn AS (SELECT map_id, seq, 'Part ' || a AS a, dir, 'Part ' || b AS b FROM r), me AS (SELECT map_id, a AS entity FROM rn UNION SELECT map_id, b FROM rn)"
_SIDES = f""",
sd AS (SELECT map_id, dst AS ref, src AS obj, CASE axis WHEN 'x' THEN 'east' ELSE 'north' END AS side FROM c
  UNION SELECT map_id, src, dst, CASE axis WHEN 'x' THEN 'west' ELSE 'south' END FROM c),
hd AS (SELECT map_id, ref, obj, list(side) AS s FROM sd GROUP BY ALL),
ds AS (SELECT * FROM (VALUES {", ".join(f"('{d}', '{x}', '{y}')" for d, (x, y) in DIRECTIONS.items())}) t(dir, ew, ns)),
ins AS (SELECT map_id, ref, dir, list_sort(list(obj)) AS inside FROM hd, ds WHERE (ew = '' OR list_contains(s, ew)) AND (ns = '' OR list_contains(s, ns)) GROUP BY ALL),
ev AS (SELECT map_id, list_sort(list(entity)) AS every FROM me GROUP BY map_id),
al AS (SELECT me.map_id, me.entity AS ref, ds.dir, ew, ns, coalesce(inside, []) AS inside, every,
    list_filter(every, lambda x: x <> me.entity AND NOT list_contains(coalesce(inside, []), x)) AS outside
  FROM me CROSS JOIN ds JOIN ev ON ev.map_id = me.map_id LEFT JOIN ins ON ins.map_id = me.map_id AND ins.ref = me.entity AND ins.dir = ds.dir),
ax AS (SELECT al.*, x.dir AS x_dir, x.inside AS x_in, y.dir AS y_dir, y.inside AS y_in FROM al LEFT JOIN al x ON x.map_id = al.map_id AND x.ref = al.ref AND x.ns = '' AND x.ew = al.ew
  LEFT JOIN al y ON y.map_id = al.map_id AND y.ref = al.ref AND y.ew = '' AND y.ns = al.ns)"""


def _drawn(items: str, key: str) -> str:
    return f"list_transform(list_sort(list_transform({items}, lambda v: {{'h': md5({key} || '|' || v || '|1'), 'v': v}})), lambda s: s.v)"


def _options(right: str, pool: str, key: str) -> str:
    four = f"(list_concat({right}, {_drawn(f'list_filter({pool}, lambda o: NOT list_contains({right}, o))', key)}))[1:4]"
    return f"list_transform(list_sort(list_transform({four}, lambda v: {{'h': md5({key} || '|' || v || '|1|order'), 'v': v}})), lambda s: s.v)"


_FINISHED = """SELECT map_id, kind, answers, question, array_to_string(list_transform(o, lambda v, i: chr(CAST(64 + i AS INTEGER)) || '. ' || v), ', ') AS options,
  array_to_string([chr(CAST(64 + i AS INTEGER)) FOR i IN range(1, len(o) + 1) IF list_contains(correct, o[i])], ', ') AS answer, deduction"""
_PICKED = """,
pr AS (SELECT a.map_id, a.entity AS a, b.entity AS b FROM me a JOIN me b ON a.map_id = b.map_id AND a.entity < b.entity),
rl AS (SELECT pr.*, CASE WHEN xg.src IS NOT NULL THEN 'gt' WHEN xl.src IS NOT NULL THEN 'lt' ELSE 'unknown' END AS x_rel, CASE WHEN yg.src IS NOT NULL THEN 'gt' WHEN yl.src IS NOT NULL THEN 'lt' ELSE 'unknown' END AS y_rel FROM pr
  LEFT JOIN c xg ON xg.map_id = pr.map_id AND xg.axis = 'x' AND xg.src = a AND xg.dst = b LEFT JOIN c xl ON xl.map_id = pr.map_id AND xl.axis = 'x' AND xl.src = b AND xl.dst = a
  LEFT JOIN c yg ON yg.map_id = pr.map_id AND yg.axis = 'y' AND yg.src = a AND yg.dst = b LEFT JOIN c yl ON yl.map_id = pr.map_id AND yl.axis = 'y' AND yl.src = b AND yl.dst = a),
an AS (SELECT *, CASE WHEN x_rel <> 'unknown' AND y_rel <> 'unknown' THEN 1 WHEN x_rel <> 'unknown' OR y_rel <> 'unknown' THEN 2 ELSE 4 END AS answers FROM rl),
pk AS (SELECT map_id, answers, a AS target, b AS ref, x_rel, y_rel FROM an QUALIFY row_number() OVER (PARTITION BY map_id, answers ORDER BY md5(map_id || '|' || a || '|' || b || '|1'), a, b) = 1)"""


def _sure(rel: str, axis: str, up: str, down: str) -> str:
    return f"""CASE {rel} WHEN 'gt' THEN 'The ' || target || ' is strictly to the {up} of the ' || ref || '.' WHEN 'lt' THEN 'The ' || target || ' is strictly to the {down} of the ' || ref || '.'
    ELSE 'The exact {axis}-axis relationship between the ' || target || ' and the ' || ref || ' cannot be determined (could be {up} or {down}).' END"""


_DIRECTION = f""",
dd AS (SELECT *, map_id || '|' || target || '|' || ref AS key, list_filter([CASE WHEN y_rel <> 'lt' AND x_rel <> 'lt' THEN 'Northeast' END, CASE WHEN y_rel <> 'lt' AND x_rel <> 'gt' THEN 'Northwest' END,
    CASE WHEN y_rel <> 'gt' AND x_rel <> 'lt' THEN 'Southeast' END, CASE WHEN y_rel <> 'gt' AND x_rel <> 'gt' THEN 'Southwest' END], lambda x: x IS NOT NULL) AS correct FROM pk),
dq AS (SELECT map_id, 'direction' AS kind, answers, 'In which direction is the ' || target || ' relative to the ' || ref || '?' AS question, correct,
    {_options("correct", "['North', 'South', 'East', 'West', 'Northeast', 'Northwest', 'Southeast', 'Southwest']", "key")} AS o,
    '**Target**: ' || target || chr(10) || '**Reference**: ' || ref || chr(10) || '**X-Axis Analysis**: ' || {_sure("x_rel", "X", "East", "West")} || chr(10) || '**Y-Axis Analysis**: ' || {_sure("y_rel", "Y", "North", "South")}
      || chr(10) || '**Conclusion**: ' || CASE answers WHEN 1 THEN 'The ' || target || ' is to the ' || correct[1] || ' of the ' || ref || '.'
      WHEN 2 THEN 'Due to partial information, the ' || target || ' could be to the ' || correct[1] || ' or ' || correct[2] || ' of the ' || ref || '.'
      ELSE 'The spatial relationship is completely undetermined. The ' || target || ' could be to the Northeast, Northwest, Southeast, or Southwest of the ' || ref || '.' END AS deduction FROM dd)"""


def _deduced(last: str) -> str:
    listed = lambda c: f"CASE WHEN len({c}) > 0 THEN array_to_string({c}, ', ') ELSE 'None' END"
    axis = lambda a, up: (
        f"CASE WHEN {a}_dir IS NULL THEN '' ELSE chr(10) || '**{a.upper()}-Axis Analysis**: Entities to the ' || {a}_dir || ' of the ' || ref || ' (' || "
        f"CASE WHEN {a}_dir = '{up}' THEN ref || ' < Entity' ELSE 'Entity < ' || ref END || ' on {a.upper()}-axis): ' || {listed(f'{a}_in')} END"
    )
    both = f"CASE WHEN x_dir IS NULL OR y_dir IS NULL THEN '' ELSE chr(10) || '**Entities in ' || dir || ' (intersection)**: ' || {listed('inside')} END"
    return f"'**Reference**: ' || ref || chr(10) || '**Direction Query**: ' || dir || {axis('x', 'East')} || {axis('y', 'North')} || {both} || chr(10) || {last}"


_COUNT = f""",
cp AS (SELECT *, map_id || '|' || ref || '|' || dir AS key, [CAST(len(inside) AS VARCHAR)] AS correct FROM ax QUALIFY row_number() OVER (PARTITION BY map_id ORDER BY md5(map_id || '|' || ref || '|' || dir || '|1'), ref, dir) = 1),
cq AS (SELECT map_id, 'count' AS kind, 1 AS answers, 'How many objects are in the ' || dir || ' of the ' || ref || '?' AS question, correct,
    {_options("correct", "[CAST(i AS VARCHAR) FOR i IN range(0, greatest(len(every) - 1, 3) + 1)]", "key")} AS o,
    {_deduced("'**Count**: ' || len(inside) || chr(10) || '**Conclusion**: ' || CASE len(inside) WHEN 0 THEN 'There are no objects' WHEN 1 THEN 'There is 1 object' ELSE 'There are ' || len(inside) || ' objects' END || ' in the ' || dir || ' of the ' || ref || '.'")} AS deduction FROM cp)"""
_WHICH = f""",
wp AS (SELECT ax.*, answers, map_id || '|' || ref || '|' || dir AS key FROM ax, (VALUES (1), (2)) t(answers) WHERE len(inside) >= answers AND len(outside) >= 4 - answers
  QUALIFY row_number() OVER (PARTITION BY map_id, answers ORDER BY md5(map_id || '|' || ref || '|' || dir || '|1'), ref, dir) = 1),
wc AS (SELECT *, ({_drawn("inside", "key")})[1:answers] AS correct FROM wp),
wq AS (SELECT map_id, 'which' AS kind, answers, 'Which object is in the ' || dir || ' of the ' || ref || '?' AS question, correct, {_options("correct", "outside", "key")} AS o,
    {_deduced("'**Conclusion**: Among the given options, the ' || CASE len(correct) WHEN 1 THEN correct[1] || ' is' ELSE correct[1] || ' and the ' || correct[2] || ' are' END || ' in the ' || dir || ' of the ' || ref || '.'")} AS deduction FROM wc)"""
_ALL = _NAMED + graph("rn") + _PICKED + _SIDES + _DIRECTION + _COUNT + _WHICH + f",\nquestions AS ({_FINISHED} FROM dq UNION ALL {_FINISHED} FROM cq UNION ALL {_FINISHED} FROM wq)"

_STEPS = (
    _NAMED
    + """, pf AS (SELECT s.map_id || '#' || s.seq AS map_id, r.seq, r.a, r.dir, r.b FROM rn s JOIN rn r ON r.map_id = s.map_id AND r.seq <= s.seq),
pn AS (SELECT map_id, a AS node FROM pf UNION SELECT map_id, b FROM pf)"""
    + graph("pf")
    + states("pn")
    + """,
nm AS (SELECT map_id, string_agg(entity, ', ' ORDER BY entity) AS names FROM me GROUP BY map_id),
said AS (SELECT rn.map_id, rn.seq, 'The ' || a || ' is to the ' || upper(dir[1]) || dir[2:] || ' of the ' || b || '.' AS sentence, '### Step ' || seq || chr(10) || '**Sentence**: "' || sentence || '"' || chr(10)
    || '**X-Extraction**: ' || CASE WHEN dir LIKE '%east' THEN b || ' < ' || a ELSE a || ' < ' || b END || chr(10) || '**Y-Extraction**: ' || CASE WHEN dir LIKE 'north%' THEN b || ' < ' || a ELSE a || ' < ' || b END || chr(10)
    || '**X-State**: ' || x.state || chr(10) || '**Y-State**: ' || y.state || chr(10) AS t
  FROM rn JOIN st x ON x.map_id = rn.map_id || '#' || rn.seq AND x.axis = 'x' JOIN st y ON y.map_id = rn.map_id || '#' || rn.seq AND y.axis = 'y'),
told AS (SELECT said.map_id, '### Initialization' || chr(10) || '**Entities Detected**: ' || any_value(names) || chr(10) || '**Initial X-State**: ' || any_value(names) || chr(10) || '**Initial Y-State**: ' || any_value(names) || chr(10) || chr(10) || chr(10)
    || string_agg(t, chr(10) || chr(10) ORDER BY seq) AS text, string_agg(sentence, ' ' ORDER BY seq) AS sentences FROM said JOIN nm ON nm.map_id = said.map_id GROUP BY said.map_id)"""
)


def hashed(n: str, key: str) -> str:
    """A number of 0 .. n - 1 drawn by md5 of the key."""
    return f"(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % ({n}))"


_NAMES = "[" + ", ".join(f"'{e}'" for e in ENTITIES) + "]"
_SAMPLED = f"""
mp AS (SELECT range AS map_id, 5 + {hashed("6", "range || '|1'")} AS k FROM range(200)),
li AS (SELECT map_id, k, list_transform(list_sort(list_transform({_NAMES}, lambda v: {{'h': md5(map_id || '|' || v || '|1e'), 'v': v}})), lambda s: s.v) AS e,
    list_transform(list_sort(list_transform(range(101), lambda v: {{'h': md5(map_id || '|' || v || '|1x'), 'v': v}})), lambda s: s.v) AS x,
    list_transform(list_sort(list_transform(range(101), lambda v: {{'h': md5(map_id || '|' || v || '|1y'), 'v': v}})), lambda s: s.v) AS y FROM mp),
sw AS (SELECT map_id, unnest(e[1:k]) AS entity, CAST(unnest(x[1:k]) AS INTEGER) AS x, CAST(unnest(y[1:k]) AS INTEGER) AS y, unnest(range(1, k + 1)) AS rk FROM li)"""

_WALKS = """
ev AS (SELECT user_id, event_id, event_id % 8 AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
mv AS (SELECT user_id || '-' || n // 10 AS walk_id, n % 10 + 1 AS step, 'Place ' || event_id AS place,
    CASE k WHEN 2 THEN 10 WHEN 3 THEN -10 WHEN 4 THEN 10 WHEN 5 THEN -10 WHEN 6 THEN 10 WHEN 7 THEN -10 ELSE 0 END AS dx, CASE k WHEN 0 THEN 10 WHEN 1 THEN -10 WHEN 4 THEN 10 WHEN 5 THEN 10 WHEN 6 THEN -10 WHEN 7 THEN -10 ELSE 0 END AS dy FROM ev),"""


def _toward(dx: str, dy: str) -> str:
    return f"nullif(concat(CASE WHEN {dy} > 0 THEN CASE WHEN {dx} = 0 THEN 'North' ELSE 'North' END WHEN {dy} < 0 THEN 'South' ELSE '' END, CASE WHEN {dx} > 0 THEN CASE WHEN {dy} = 0 THEN 'East' ELSE 'east' END WHEN {dx} < 0 THEN CASE WHEN {dy} = 0 THEN 'West' ELSE 'west' END ELSE '' END), '')"


def _why(d: str, x: str, y: str) -> str:
    sign = lambda up, down: f"CASE WHEN {d} ILIKE '%{up}%' THEN '>' WHEN {d} ILIKE '%{down}%' THEN '<' ELSE '=' END"
    return f"'x ' || {sign('east', 'west')} || ' ' || {x} || ', y ' || {sign('north', 'south')} || ' ' || {y}"


def _change(c: str, axis: str) -> str:
    return f"CASE WHEN {c} > 0 THEN '{axis} increases (0->' || {c} || ')' WHEN {c} < 0 THEN '{axis} decreases (0->' || {c} || ')' ELSE '{axis} stays same' END"


_WALK = (
    _WALKS
    + f"""
ps AS (SELECT walk_id, step, place, CAST(sum(CASE WHEN step > 1 THEN dx ELSE 0 END) OVER o AS BIGINT) AS x, CAST(sum(CASE WHEN step > 1 THEN dy ELSE 0 END) OVER o AS BIGINT) AS y FROM mv WINDOW o AS (PARTITION BY walk_id ORDER BY step)),
oa AS (SELECT s.walk_id, s.step, o.step AS other, row_number() OVER (PARTITION BY s.walk_id, s.step ORDER BY md5(s.walk_id || '|' || s.step || '|' || o.step || '|1')) AS rk FROM ps s JOIN ps o ON o.walk_id = s.walk_id AND o.step < s.step - 1),
rf AS (SELECT walk_id, step, step - 1 AS other, 0 AS rk FROM ps WHERE step > 1 UNION ALL SELECT walk_id, step, other, rk FROM oa WHERE rk <= {hashed("least(3, step - 2) + 1", "walk_id || '|' || step || '|1'")}),
sx AS (SELECT rf.*, s.place, o.place AS ref, o.x, o.y, {_toward("(s.x - o.x)", "(s.y - o.y)")} AS dir FROM rf JOIN ps s ON s.walk_id = rf.walk_id AND s.step = rf.step JOIN ps o ON o.walk_id = rf.walk_id AND o.step = other),
sk AS (SELECT *, row_number() OVER (PARTITION BY walk_id, step ORDER BY rk) AS i, count(*) OVER (PARTITION BY walk_id, step) AS n, {_why("dir", "x", "y")} AS why FROM sx WHERE dir IS NOT NULL),
ls AS (SELECT walk_id, step, string_agg('- Relation' || CASE WHEN n > 1 THEN ' ' || i ELSE '' END || ': ' || dir || ' of "' || ref || '" (' || x || ', ' || y || ') -> implies ' || why || '.', chr(10) || chr(10) ORDER BY i)
    || CASE WHEN count(*) > 1 THEN chr(10) || chr(10) || '- Intersection: ' || string_agg(why, ' AND ' ORDER BY i) || '.' ELSE '' END AS t FROM sk GROUP BY ALL),
sp AS (SELECT ps.walk_id, ps.step, CASE WHEN ps.step = 1 THEN 'Step 1: Reference Point' || chr(10) || chr(10) || '- Entity: "' || place || '"' || chr(10) || chr(10) || '- Assignment: Set as origin (0, 0).'
    ELSE 'Step ' || ps.step || ': Locate "' || place || '"' || chr(10) || chr(10) || t || chr(10) || chr(10) || '- Assignment: Set to (' || x || ', ' || y || ').' END AS t FROM ps LEFT JOIN ls ON ls.walk_id = ps.walk_id AND ls.step = ps.step),
fl AS (SELECT walk_id, arg_min(place, step) AS a, arg_max(place, step) AS z, arg_max(x, step) AS x, arg_max(y, step) AS y, count(*) AS n FROM ps GROUP BY walk_id),
ho AS (SELECT *, {_toward("x", "y")} AS home FROM fl WHERE n > 1),
re AS (SELECT walk_id, string_agg(t, chr(10) || chr(10) ORDER BY step) AS t FROM sp GROUP BY walk_id),
se AS (SELECT walk_id, string_agg(s, ' ' ORDER BY md5(walk_id || '|' || s || '|1'), s) AS t FROM (SELECT walk_id, place || ' is to the ' || dir || ' of ' || ref || '.' AS s FROM sk) GROUP BY walk_id),
op AS (SELECT *, [CASE WHEN home IN ('Northeast', 'Northwest', 'Southwest', 'Southeast') THEN 'Northeast' ELSE home END, 'Northwest', 'Southwest', 'Southeast'] AS o FROM ho WHERE home IS NOT NULL)
SELECT op.walk_id, md5('Consider a map with multiple objects:' || chr(10) || chr(10) || se.t || chr(10) || chr(10)
    || 'Please answer the following multiple-choice question based on the provided information. In which direction is ' || z || ' relative to ' || a || '? Available options:' || chr(10) || chr(10)
    || array_to_string(list_transform(o, lambda v, i: chr(CAST(64 + i AS INTEGER)) || '. ' || v), chr(10) || chr(10)) || '.') AS user_md5,
  md5(re.t || chr(10) || chr(10) || 'Step ' || (n + 1) || ': Final Check' || chr(10) || chr(10) || '- Target: Direction of "' || z || '" (' || x || ', ' || y || ') from "' || a || '" (0, 0).' || chr(10) || chr(10)
    || '- Calculation: ' || {_change("x", "x")} || ', ' || {_change("y", "y")} || '.' || chr(10) || chr(10) || '- Result: ' || home || '.') AS reasoning_md5, chr(CAST(64 + list_position(o, home) AS INTEGER)) AS answer, n AS n_places
FROM op JOIN re USING (walk_id) JOIN se USING (walk_id)"""
)

_STRATA = "CASE kind WHEN 'direction' THEN 'direction-' || answers WHEN 'count' THEN 'count' ELSE 'which-' || answers END"
PLAN = {"direction-1": 300, "direction-2": 300, "direction-4": 150, "count": 750, "which-1": 400, "which-2": 200}

SQL = {
    "state_text": f"WITH RECURSIVE {WORLD}, no AS (SELECT map_id, entity AS node FROM w){graph('r')}{states('no')} SELECT * FROM st",
    "ambiguous_pairs": f"WITH RECURSIVE {_NAMED}{graph('rn')}{_PICKED} SELECT * FROM pk",
    "direction_questions": f"WITH RECURSIVE {_NAMED}{graph('rn')}{_PICKED}{_DIRECTION} {_FINISHED} FROM dq",
    "count_questions": f"WITH RECURSIVE {_NAMED}{graph('rn')}{_SIDES}{_COUNT} {_FINISHED} FROM cq",
    "which_questions": f"WITH RECURSIVE {_NAMED}{graph('rn')}{_SIDES}{_WHICH} {_FINISHED} FROM wq",
    "stratified_plan": f"""WITH RECURSIVE {_ALL}, s AS (SELECT map_id, {_STRATA} AS stratum FROM questions), p AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in PLAN.items())}) t(stratum, n))
SELECT stratum, map_id FROM s JOIN p USING (stratum) QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5(CAST(map_id AS VARCHAR)), map_id) <= any_value(n) OVER (PARTITION BY stratum)""",
    "narratives": f"WITH RECURSIVE {_STEPS} SELECT map_id, length(text) AS n_chars, md5(text) AS text_md5 FROM told",
    "sft_samples": f"""WITH RECURSIVE {_STEPS}, qs AS (WITH RECURSIVE {_ALL} SELECT * FROM questions)
SELECT q.map_id, kind, answers, md5('Consider a map with multiple locations:' || chr(10) || chr(10) || sentences || chr(10) || chr(10) || 'Question: ' || question || ' Available options: ' || options) AS user_md5,
  md5('<think>' || chr(10) || text || chr(10) || chr(10) || '### Final Deduction' || chr(10) || deduction || chr(10) || chr(10) || '</think>' || chr(10) || 'Answer: ' || answer) AS assistant_md5
FROM qs q JOIN told ON told.map_id = q.map_id""",
    "sampled_worlds": f"WITH {_SAMPLED} SELECT * FROM sw",
    "sampled_relations": f"""WITH {_SAMPLED},
pr AS (SELECT a.map_id, a.entity AS a, (CASE WHEN a.y > b.y THEN 'north' ELSE 'south' END) || (CASE WHEN a.x > b.x THEN 'east' ELSE 'west' END) AS dir, b.entity AS b FROM sw a JOIN sw b ON a.map_id = b.map_id AND a.rk > b.rk),
rs AS (SELECT pr.*, row_number() OVER (PARTITION BY map_id ORDER BY md5(map_id || '|' || a || '|' || b || '|1'), a, b) AS seq FROM pr)
SELECT rs.map_id, seq, a, dir, b FROM rs JOIN mp USING (map_id) WHERE seq <= k + {hashed("6", "map_id || '|1m'")}""",
    "walk_scenarios": f"WITH {_WALK}",
}
