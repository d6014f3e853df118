"""Union, intersection and difference of polygons, and their triangles, for any number of paths at once.

Polygons are rows (path_id, seq, x, y), a simple closed ring a path; a subject and a clip meet under their path_id. They are in general
position: no vertex lies on the other's edge and no edges coincide. Edges are dealt to strips of rows, and only those of one
strip are held against each other, for crossings as for the parity that tells inside from outside.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sqlop import operator
from ..plans.staged import checkpointed

#: Height of the strips that edges are dealt to.
STRIP = 16.0
#: Names of vertices: those of subjects, those of clips, and crossings by the places of both edges (below 2^20 each).
_OWN, _CROSSING = 1 << 40, 1 << 42

#: By operation: for subjects and clips, which pieces stay (0 outside the other, 1 inside) and whether they are turned round.
KEEP = {"union": ((0, False), (0, False)), "intersect": ((1, False), (1, False)), "subtract": ((0, False), (1, True))}


def _oriented(r: str, own: int) -> str:
    """Subquery (path_id, own, seq, x, y), the rings turned so that their areas are positive."""
    over = "OVER (PARTITION BY path_id ORDER BY seq)"
    ends = f"(SELECT path_id, seq, x, y, coalesce(lead(x) {over}, first_value(x) {over}) AS x1, coalesce(lead(y) {over}, first_value(y) {over}) AS y1 FROM {r} r)"
    areas = f"(SELECT path_id, sum(x * y1 - x1 * y) AS area FROM {ends} e GROUP BY path_id)"
    return (f"SELECT r.path_id, {own} AS own, CAST(row_number() OVER (PARTITION BY r.path_id ORDER BY CASE WHEN a.area < 0 THEN -r.seq ELSE r.seq END) AS BIGINT) - 1 AS seq, r.x, r.y "
            f"FROM {r} r JOIN {areas} a ON a.path_id = r.path_id")


@operator(2)
def pieces(d, a, b):
    """(path_id, own, u, v, x0, y0, x1, y1, inside): the edges of subjects (own 0) and clips (own 1), cut where they cross.

    u and v name their ends; inside is 1 where the other polygon holds them, by the parity of its edges to their right.
    """
    over = "OVER (PARTITION BY path_id, own ORDER BY seq)"
    strip = lambda y: f"CAST(floor(({y}) / {d.num(STRIP)}) AS BIGINT)"
    first, count = f"{strip('least(y0, y1)')}", f"{strip('greatest(y0, y1)')} - {strip('least(y0, y1)')} + 1"
    spread = d.expand(f"(SELECT e.*, {first} AS low, {count} AS many FROM edges e)", "many", "k")
    den = "((p.x1 - p.x0) * (q.y1 - q.y0) - (p.y1 - p.y0) * (q.x1 - q.x0))"
    t = "((q.x0 - p.x0) * (q.y1 - q.y0) - (q.y0 - p.y0) * (q.x1 - q.x0))"
    u = "((q.x0 - p.x0) * (p.y1 - p.y0) - (q.y0 - p.y0) * (p.x1 - p.x0))"
    by = "OVER (PARTITION BY path_id, own ORDER BY seq, t)"
    return f"""WITH points AS ({_oriented(a, 0)} UNION ALL {_oriented(b, 1)}),
edges AS (SELECT path_id, own, seq, x AS x0, y AS y0, coalesce(lead(x) {over}, first_value(x) {over}) AS x1, coalesce(lead(y) {over}, first_value(y) {over}) AS y1 FROM points),
spread AS (SELECT path_id, own, seq, x0, y0, x1, y1, low, low + k AS strip FROM {spread} s),
met AS (
  SELECT p.path_id, p.seq AS ps, q.seq AS qs, p.x0, p.y0, p.x1, p.y1, {den} AS den, {t} AS t, {u} AS u FROM spread p JOIN spread q
  ON p.own = 0 AND q.own = 1 AND q.path_id = p.path_id AND q.strip = p.strip AND p.strip = greatest(p.low, q.low)
), crossings AS (
  SELECT path_id, ps, qs, t, u, x0 + t * (x1 - x0) AS x, y0 + t * (y1 - y0) AS y
  FROM (SELECT path_id, ps, qs, x0, y0, x1, y1, t / nullif(den, 0e0) AS t, u / nullif(den, 0e0) AS u FROM met) m WHERE t > 0 AND t < 1 AND u > 0 AND u < 1
), stops AS (
  SELECT path_id, own, seq, 0e0 AS t, own * {_OWN} + seq AS node, x, y FROM points
  UNION ALL SELECT path_id, 0 AS own, ps AS seq, t, {_CROSSING} + ps * 1048576 + qs AS node, x, y FROM crossings
  UNION ALL SELECT path_id, 1 AS own, qs AS seq, u AS t, {_CROSSING} + ps * 1048576 + qs AS node, x, y FROM crossings
), cut AS (
  SELECT path_id, own, node AS u, coalesce(lead(node) {by}, first_value(node) {by}) AS v, x AS x0, y AS y0, coalesce(lead(x) {by}, first_value(x) {by}) AS x1, coalesce(lead(y) {by}, first_value(y) {by}) AS y1 FROM stops
), middles AS (SELECT c.*, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM cut c),
right_of AS (
  SELECT m.path_id, m.own, m.u, count(*) AS n FROM middles m JOIN spread e ON e.path_id = m.path_id AND e.own = 1 - m.own AND e.strip = {strip('m.my')}
  AND ((e.y0 <= m.my AND e.y1 > m.my) OR (e.y1 <= m.my AND e.y0 > m.my)) WHERE e.x0 + (m.my - e.y0) / nullif(e.y1 - e.y0, 0e0) * (e.x1 - e.x0) > m.mx GROUP BY m.path_id, m.own, m.u
)
SELECT m.path_id, m.own, m.u, m.v, m.x0, m.y0, m.x1, m.y1, CAST(coalesce(r.n, 0) % 2 AS INT) AS inside
FROM middles m LEFT JOIN right_of r ON r.path_id = m.path_id AND r.own = m.own AND r.u = m.u"""


@operator(2)
def boundary(d, a, b, op: str = "union"):
    """(path_id, u, v, x0, y0, x1, y1): the directed pieces around the union, intersection or difference of subject and clip."""
    rows = []
    for own, (inside, turned) in enumerate(KEEP[op]):
        ends = "v AS u, u AS v, x1 AS x0, y1 AS y0, x0 AS x1, y0 AS y1" if turned else "u, v, x0, y0, x1, y1"
        rows.append(f"SELECT path_id, {ends} FROM pieces WHERE own = {own} AND inside = {inside}")
    return f"WITH pieces AS ({pieces.write(d, a, b)}) {' UNION ALL '.join(rows)}"


@operator(2)
def boolean_areas(d, a, b, op: str = "union"):
    """(path_id, area) of the union, intersection or difference; paths of which nothing is left are not there."""
    return f"SELECT path_id, sum(x0 * y1 - x1 * y0) / 2 AS area FROM ({boundary.write(d, a, b, op=op)}) e GROUP BY path_id"


def _runs(edges: DataFrame) -> DataFrame:
    """edges(path_id, u, x0, y0, v) with run, the number in its path of the run that u is in, k, its place by u, and turn, -1 in runs that go down.

    A run is a row of nodes, by their names, of which each goes on at its neighbour: what lies between two crossings.
    """
    over = Window.partitionBy("path_id").orderBy("u")
    linked = edges.select("path_id", "u", "v", F.col("x0").alias("x"), F.col("y0").alias("y")).withColumns({
        "k": F.row_number().over(over), "turn": F.when(F.lag("v").over(over) == F.col("u"), 1).when(F.lag("u").over(over) == F.col("v"), -1)})
    parted = linked.withColumn("fresh", F.col("turn").isNull() | F.coalesce(F.lag("turn").over(over) != F.col("turn"), F.lit(False)))
    return parted.select("path_id", "u", "v", "x", "y", "k", F.sum(F.col("fresh").cast("int")).over(over).cast("int").alias("run"), F.when(~F.col("fresh"), F.col("turn")).cast("byte").alias("turn"))


def walked(edges: DataFrame) -> DataFrame:
    """Rings (path_id, part, ring, seq, x, y) of directed pieces (path_id, u, v, x0, y0) that each go on at one other.

    Nodes are put in runs, which are few to a path, and only these are walked. Every run looks twice as far ahead in each round: first
    for the least node of its ring, which names it, then for the number of steps to the run that this node is in. Rounds are the
    logarithm of the most runs of a path.
    """
    nodes = checkpointed(_runs(edges))
    ends = nodes.groupBy("path_id", "run").agg(
        F.min("u").alias("low"), F.max("u").alias("high"), F.min("k").alias("k0"), F.count("*").alias("n"), F.coalesce(F.max("turn"), F.lit(1)).alias("turn"),
        F.max_by("v", "u").alias("up"), F.min_by("v", "u").alias("down"))
    down = F.col("turn") < 0
    runs = checkpointed(ends.select("path_id", "run", "low", "k0", "n", "turn", F.when(down, F.col("high")).otherwise(F.col("low")).alias("u"), F.when(down, F.col("down")).otherwise(F.col("up")).alias("v")))
    most = runs.groupBy("path_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    rounds = max(1, math.ceil(math.log2(most)))

    def ahead(now: DataFrame, combine) -> DataFrame:
        for _ in range(rounds):
            far = now.select("path_id", F.col("u").alias("to"), F.col("value").alias("next_value"), F.col("to").alias("next_to"))
            now = checkpointed(now.join(far, ["path_id", "to"]).select("path_id", "u", F.col("next_to").alias("to"), combine(F.col("value"), F.col("next_value")).alias("value")))
        return now

    heads = ahead(runs.select("path_id", "u", F.col("v").alias("to"), F.col("low").alias("value")), F.least).select("path_id", "u", F.col("value").alias("ring"))
    named = checkpointed(runs.join(heads, ["path_id", "u"]))
    at_head = F.col("low") == F.col("ring")
    steps = ahead(named.select("path_id", "u", F.when(at_head, F.col("u")).otherwise(F.col("v")).alias("to"), F.when(at_head, 0).otherwise(F.col("n")).alias("value")), lambda x, y: x + y)
    sizes = named.groupBy("path_id", "ring").agg(F.sum("n").alias("size"), F.max(F.when(at_head & down, F.col("n") - 1).otherwise(0)).alias("skip"))
    placed = (named.join(steps.select("path_id", "u", "value"), ["path_id", "u"]).join(sizes, ["path_id", "ring"])
              .select("path_id", "run", "ring", "size", "k0", "turn", (F.when(down, F.col("n") - 1).otherwise(0) - F.col("value") - F.col("skip")).alias("first")))
    rings = nodes.drop("turn").join(placed, ["path_id", "run"])
    return rings.select("path_id", F.lit(0).alias("part"), "ring", F.pmod(F.col("first") + F.col("turn") * (F.col("k") - F.col("k0")), F.col("size")).alias("seq"), "x", "y")


def boolean(a: DataFrame, b: DataFrame, op: str = "union") -> DataFrame:
    """Rings (path_id, part, ring, seq, x, y) of `union`, `intersect`, `subtract` or `xor` of the polygons a and b of each path_id.

    Outer rings have positive areas and holes negative ones. xor is what either takes from the other, as parts 0 and 1. A path
    with only one of the two counts the other as empty.
    """
    if op == "xor":
        return boolean(a, b, "subtract").unionByName(boolean(b, a, "subtract").withColumn("part", F.lit(1)))
    return walked(boundary(a, b, op=op))


# ---------------------------------------------------------------- triangles

def _cross(a, b, c):
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def _ring(points: np.ndarray) -> np.ndarray:
    """The vertices without a repeated first one, turned so that the area is positive."""
    if len(points) > 1 and np.abs(points[0] - points[-1]).max() < 1e-9:
        points = points[:-1]
    x, y = points.T if len(points) else (np.zeros(0), np.zeros(0))
    return points[::-1] if (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() < 0 else points


def _ears(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triangles (g, m - 2, 3, 2) of g rings of m vertices each, and how many there are; all rings lose a vertex in each round."""
    g, m = p.shape[:2]
    out, count, own = np.zeros((g, max(m - 2, 0), 3, 2)), np.zeros(g, np.int64), np.arange(g)
    for left in range(m, 3, -1):
        before, after = np.roll(p, 1, axis=1), np.roll(p, -1, axis=1)
        convex = _cross(before, p, after) > 0
        ear, todo = np.full(len(p), -1), np.flatnonzero(convex.any(1))
        while len(todo):  # the first convex corner of each ring, then the next one of those where it is none
            i, rows = convex[todo].argmax(1), np.arange(len(todo))
            a, b, c, others = before[todo, i][:, None], p[todo, i][:, None], after[todo, i][:, None], p[todo]
            one, two, three = _cross(others, a, b), _cross(others, b, c), _cross(others, c, a)
            held = ((one >= 0) & (two >= 0) & (three >= 0)) | ((one <= 0) & (two <= 0) & (three <= 0))
            for k in (-1, 0, 1):
                held[rows, (i + k) % left] = False
            free = ~held.any(1)
            ear[todo[free]] = i[free]
            convex[todo, i] = False
            todo = todo[~free]
            todo = todo[convex[todo].any(1)]
        some = np.flatnonzero(ear >= 0)  # a ring without an ear crosses itself
        ear, own = ear[some], own[some]
        out[own, count[own]] = np.stack((before[some, ear], p[some, ear], after[some, ear]), 1)
        count[own] += 1
        keep = np.ones((len(some), left), bool)
        keep[np.arange(len(some)), ear] = False
        p = p[some][keep].reshape(len(some), left - 1, 2)
    if m >= 3:
        out[own, count[own]] = p
        count[own] += 1
    return out, count


def ears(polygons: list[np.ndarray]) -> list[np.ndarray]:
    """Triangles (n, 3, 2) of each of some simple polygons (m, 2) by ear clipping: again and again the first convex corner with no other vertex in it."""
    rings = [_ring(points) for points in polygons]
    sizes, found = np.array([len(r) for r in rings]), [np.zeros((0, 3, 2))] * len(rings)
    for m in np.unique(sizes[sizes >= 3]):
        some = np.flatnonzero(sizes == m)
        triangles, count = _ears(np.stack([rings[k] for k in some]).astype(float))
        for k, t, n in zip(some, triangles, count):
            found[k] = t[:n]
    return found


TRIANGLES = "path_id long, triangle int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double"


def tessellate(polygons: DataFrame) -> DataFrame:
    """Triangles of the polygons (path_id, seq, x, y), a polygon a row of its task; of one that crosses itself those found until no ear is left."""
    rings = polygons.groupBy(F.col("path_id").cast("long").alias("path_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("points"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                points = some.column(1).flatten()
                found = ears(np.split(np.stack([points.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")], 1), np.cumsum(some.column(1).value_lengths().to_numpy())[:-1]))
                many = [len(f) for f in found]
                corners = np.concatenate(found).reshape(-1, 6) if found else np.zeros((0, 6))
                ids = np.repeat(some.column(0).to_numpy(), many)
                number = np.concatenate([np.arange(n, dtype=np.int32) for n in many]) if many else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(number), *(pa.array(np.ascontiguousarray(c)) for c in corners.T)], ["path_id", "triangle", "x0", "y0", "x1", "y1", "x2", "y2"])

    return rings.select("path_id", F.expr("transform(points, p -> struct(p.x AS x, p.y AS y))").alias("points")).mapInArrow(run, TRIANGLES)


def located(places: DataFrame, triangles: DataFrame, strip: float = STRIP) -> DataFrame:
    """places(x, y, ...) with path_id and triangle of each triangle that holds them, edges included; met within strips of rows."""
    low, high = F.least("y0", "y1", "y2"), F.greatest("y0", "y1", "y2")
    dealt = triangles.withColumn("strip", F.explode(F.sequence(F.floor(low / strip), F.floor(high / strip))))

    def side(a: int, b: int):
        return (F.col(f"x{b}") - F.col(f"x{a}")) * (F.col("y") - F.col(f"y{a}")) - (F.col(f"y{b}") - F.col(f"y{a}")) * (F.col("x") - F.col(f"x{a}"))

    one, two, three = side(0, 1), side(1, 2), side(2, 0)
    inside = ((one >= 0) & (two >= 0) & (three >= 0)) | ((one <= 0) & (two <= 0) & (three <= 0))
    met = places.withColumn("strip", F.floor(F.col("y") / strip)).join(dealt, "strip").where((F.col("x") >= F.least("x0", "x1", "x2")) & (F.col("x") <= F.greatest("x0", "x1", "x2")) & inside)
    return met.select(*[f"`{c}`" for c in places.columns], "path_id", "triangle")
