"""The engine's queries and, beside each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairforge.functions import predicates as P, text as T
from pairforge.functions.regions import parse_region, usable_regions
from pairforge.operators import grid as G, join as J, partitioning as K
from pairforge.plans.spec import JoinSpec, run_join
from pairforge.queries import fixtures as X
from pairforge.sources.synthetic import synthetic_regions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SIG = F.col
R1 = """r1 AS (SELECT vec_id AS id, 3 + CAST(vec_id % 6 AS INT) AS num_points,
  list_transform(range(1, 4 + CAST(vec_id % 6 AS INT)), lambda k: CAST(embedding[2*k-1] AS DOUBLE) + (vec_id % 25)*0.25::DOUBLE) AS x,
  list_transform(range(1, 4 + CAST(vec_id % 6 AS INT)), lambda k: CAST(embedding[2*k] AS DOUBLE) + (label % 5)*0.25::DOUBLE) AS y
  FROM embeddings),
i AS (SELECT id, num_points, x, y, list_min(x) AS x_min, list_max(x) AS x_max, list_min(y) AS y_min, list_max(y) AS y_max FROM r1)"""
EXTENT = """e AS (SELECT a - (b-a)*0.001::DOUBLE AS x_min, b + (b-a)*0.001::DOUBLE AS x_max, c - (d-c)*0.001::DOUBLE AS y_min, d + (d-c)*0.001::DOUBLE AS y_max
  FROM (SELECT min(x_min) AS a, max(x_max) AS b, min(y_min) AS c, max(y_max) AS d FROM i))"""
INDEX = "least(greatest(CAST(trunc((i.{v} - e.{a}_min) * 3.0::DOUBLE / (e.{a}_max - e.{a}_min)) AS INT), 0), 2)"
CELLS = f"""g AS (SELECT i.*, {INDEX.format(v='x_min', a='x')} AS l, {INDEX.format(v='x_max', a='x')} AS r, {INDEX.format(v='y_min', a='y')} AS b, {INDEX.format(v='y_max', a='y')} AS t FROM i, e),
c1 AS (SELECT *, unnest(range(b, t + 1)) AS j FROM g), c2 AS (SELECT *, unnest(range(l, r + 1)) AS k FROM c1),
c AS (SELECT id, num_points, x, y, x_min, x_max, y_min, y_max, CAST(j * 3 + k AS BIGINT) AS cell FROM c2)"""
PAIRS = """n AS (SELECT range AS c FROM range(9)), p AS (SELECT c AS cell_l, c AS cell_r FROM n UNION ALL SELECT c, c + 1 FROM n WHERE c % 3 < 2 UNION ALL SELECT c, c + 3 FROM n WHERE c < 6)"""
OVERLAP = "l.x_min < r.x_max AND r.x_min < l.x_max AND l.y_min < r.y_max AND r.y_min < l.y_max"
BRUTE = f"SELECT l.id AS id_l, r.id AS id_r FROM i l JOIN i r ON l.id < r.id AND {OVERLAP}"
BOX = "x_min, x_max, y_min, y_max"


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def gridded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, G.Grid]:
    items = usable_regions(X.polygons(spark, sf_dir))
    return items, G.Grid.of(items)


@query(f"WITH {R1} SELECT id, num_points, {BOX} FROM i")
def region_mbr(spark, sf_dir):
    return X.polygons(spark, sf_dir).select("id", "payload.num_points", "signature.*")


@query(f"WITH {R1}, {EXTENT} SELECT 3 AS strips, {BOX} FROM e")
def grid_extent(spark, sf_dir):
    return G.extent(usable_regions(X.polygons(spark, sf_dir)))


@query(f"WITH {R1}, {EXTENT}, {CELLS} SELECT id, cell FROM c")
def grid_cells(spark, sf_dir):
    items, grid = gridded(spark, sf_dir)
    return K.replicate(items, grid.cells(SIG("signature"))).select("id", "cell")


@query(f"WITH {R1}, {EXTENT}, {CELLS} SELECT cell, count(*) AS n_records FROM c GROUP BY cell")
def partition_counts(spark, sf_dir):
    items, grid = gridded(spark, sf_dir)
    return K.partition_counts(K.replicate(items, grid.cells(SIG("signature"))))


@query(f"WITH {PAIRS} SELECT cell_l, cell_r FROM p")
def cell_pairs(spark, sf_dir):
    return G.cell_pairs(spark)


@query(f"""WITH {R1}, {EXTENT}, {CELLS}, {PAIRS}, s AS (SELECT cell, count(*) AS n FROM c GROUP BY cell)
SELECT cell_l, cell_r, CASE WHEN cell_l = cell_r THEN a.n ELSE a.n + b.n END AS io_cost, CASE WHEN cell_l = cell_r THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS cpu_cost
FROM p JOIN s a ON a.cell = cell_l JOIN s b ON b.cell = cell_r""")
def pair_costs(spark, sf_dir):
    return K.pair_costs(G.cell_pairs(spark), partition_counts(spark, sf_dir))


@query(f"""WITH {R1}, {EXTENT}, {CELLS}, {PAIRS}, s AS (SELECT cell, id % 4 AS sub, count(*) AS n FROM c GROUP BY ALL)
SELECT cell_l, a.sub AS sub_l, cell_r, b.sub AS sub_r, a.n AS n_l, b.n AS n_r FROM p JOIN s a ON a.cell = cell_l JOIN s b ON b.cell = cell_r WHERE cell_l <> cell_r OR a.sub <= b.sub""")
def split_pairs(spark, sf_dir):
    items, grid = gridded(spark, sf_dir)
    parts = K.partition_counts(K.salted(K.replicate(items, grid.cells(SIG("signature"))), 4, F.col("id") % 4), sub="sub")
    return K.split_pairs(G.cell_pairs(spark), parts)


@query(f"WITH {R1} {BRUTE}")
def join_signature(spark, sf_dir):
    items, grid = gridded(spark, sf_dir)
    return J.signature_join(items, grid.cells(SIG("signature")), P.mbr_intersects)


@query(f"WITH {R1}, {EXTENT}, {CELLS} SELECT l.id AS id_l, r.id AS id_r FROM c l JOIN c r ON l.cell = r.cell AND l.id < r.id AND {OVERLAP}")
def join_signature_bag(spark, sf_dir):
    items, grid = gridded(spark, sf_dir)
    return J.signature_join(items, grid.cells(SIG("signature")), P.mbr_intersects, distinct=False)


@query(f"WITH {R1} {BRUTE} AND l.num_points = r.num_points")
def join_clone(spark, sf_dir):
    items, grid = gridded(spark, sf_dir)
    return J.clone_join(items, grid.cells(SIG("signature")), P.mbr_intersects, P.same_num_points)


@query(f"WITH {R1} SELECT l.id AS id_l, r.id AS id_r, l.num_points AS n_l, r.num_points AS n_r, l.x[1] AS x_l, r.x[1] AS x_r FROM i l JOIN i r ON l.id < r.id AND {OVERLAP} AND l.num_points = r.num_points")
def join_shadow(spark, sf_dir):
    items, grid = gridded(spark, sf_dir)
    out = J.shadow_join(items, grid.cells(SIG("signature")), P.mbr_intersects, P.same_num_points, with_payload=True)
    return out.select("id_l", "id_r", F.col("payload_l.num_points").alias("n_l"), F.col("payload_r.num_points").alias("n_r"), F.col("payload_l.x")[0].alias("x_l"), F.col("payload_r.x")[0].alias("x_r"))


@query(f"WITH {R1}, {EXTENT}, {CELLS} SELECT l.id AS id_l, r.id AS id_r FROM c l JOIN c r ON l.cell = r.cell AND l.id < r.id AND {OVERLAP} AND l.num_points = r.num_points")
def join_shadow_bag(spark, sf_dir):
    def cells(items):
        return G.Grid.of(items).cells(SIG("signature"))

    spec = JoinSpec("Bag", build=usable_regions, cells=cells, has_signature=True, accept_signature=P.mbr_intersects, accept_payload=P.same_num_points, algorithm="shadow", skip_dedup=True)
    return run_join(X.polygons(spark, sf_dir), spec)


@query(f"WITH {R1} {BRUTE} AND l.num_points = r.num_points")
def join_split(spark, sf_dir):
    """Crowded cells are split by their statistics and joined part by part."""
    def cells(items):
        return G.Grid.of(items).cells(SIG("signature"))

    spec = JoinSpec("Split", build=usable_regions, cells=cells, has_signature=True, pairs=lambda items: G.cell_pairs(items.sparkSession), accept_signature=P.mbr_intersects, accept_payload=P.same_num_points, split_rows=50)
    return run_join(X.polygons(spark, sf_dir), spec)


@query(f"WITH {R1}, {EXTENT}, {CELLS} SELECT DISTINCT l.id AS id_l, r.id AS id_r FROM c l JOIN c r ON l.cell = r.cell AND l.id < r.id AND l.num_points = r.num_points")
def join_payload(spark, sf_dir):
    items, grid = gridded(spark, sf_dir)
    return J.payload_join(items, grid.cells(SIG("signature")), P.same_num_points)


@query(f"""WITH {R1}, {EXTENT}, {CELLS}, {PAIRS} SELECT DISTINCT least(l.id, r.id) AS id_l, greatest(l.id, r.id) AS id_r
FROM p JOIN c l ON l.cell = cell_l JOIN c r ON r.cell = cell_r AND l.id <> r.id WHERE {OVERLAP}""")
def join_cross_cells(spark, sf_dir):
    items, grid = gridded(spark, sf_dir)
    return J.signature_join(items, grid.cells(SIG("signature")), P.mbr_intersects, pairs=G.cell_pairs(spark))


R2 = """i AS (SELECT p_partkey AS id, p_retailprice - (p_partkey % 7) AS x_min, p_retailprice + 1 + (p_partkey % 5) AS x_max,
 p_size - 0.5::DOUBLE * (p_partkey % 3) AS y_min, p_size + 0.5::DOUBLE + 0.5::DOUBLE * (p_partkey % 4) AS y_max FROM part)"""


@query(f"WITH {R2} {BRUTE}")
def join_refpoint(spark, sf_dir):
    items = X.rectangles(spark, sf_dir)
    return J.refpoint_join(items, G.Grid.of(items, 32), P.mbr_intersects)


def hashed(items: DataFrame) -> F.Column:
    """One cell by the signature's hash: equal signatures always meet."""
    return F.array(F.xxhash64("signature"))


@query("SELECT l.c_custkey AS id_l, r.c_custkey AS id_r FROM customer l JOIN customer r ON l.c_custkey < r.c_custkey AND l.c_nationkey = r.c_nationkey AND l.c_mktsegment = r.c_mktsegment")
def equality_join(spark, sf_dir):
    items = X.customers(spark, sf_dir)
    # one cell each, so no pair is found twice
    return J.clone_join(items, hashed(items), P.same_signature, P.same_payload, distinct=False)


@query("SELECT l.doc_id AS id_l, r.doc_id AS id_r FROM documents l JOIN documents r ON l.doc_id < r.doc_id AND l.lang = r.lang AND l.n_chars = r.n_chars AND l.text = r.text")
def text_exact_dups(spark, sf_dir):
    # the payload's hash rides in the signature, so the candidates are the result but for collisions, and texts are
    # fetched for those alone
    items = X.texts(spark, sf_dir).withColumn("signature", F.struct("signature", F.xxhash64("payload")))
    return J.shadow_join(items, hashed(items), P.same_signature, P.same_payload, distinct=False)


TEXT_R2 = """t AS (SELECT p_partkey AS id, CAST(p_partkey % 100 AS DOUBLE) AS x1, (p_partkey % 100) + 1.5::DOUBLE AS x2,
 p_size - 0.5::DOUBLE * (p_partkey % 3) AS y1, p_size + 0.5::DOUBLE + 0.5::DOUBLE * (p_partkey % 4) AS y2 FROM part)"""


@query(f"WITH {TEXT_R2} SELECT id, printf('[IP],,{{%d}},,{{[2],(%.6f,%.6f),(%.6f,%.6f)}}', id, x1, y1, x2, y2) AS dump, printf('%d,2,%.6f,%.6f,%.6f,%.6f', id, x1, y1, x2, y2) AS line FROM t")
def region_text_out(spark, sf_dir):
    items = X.text_rectangles(spark, sf_dir)
    return items.select("id", T.item_text(F.col("id"), T.region_text(F.col("payload"))).alias("dump"), T.region_line(F.col("id"), F.col("payload")).alias("line"))


@query(f"WITH {TEXT_R2} SELECT id, 2 AS num_points, x1, x2 AS x_max, y1, y2 AS y_max, printf('%d,[2],%.6f,%.6f,%.6f,%.6f', id, x1, y1, x2, y2) AS from_dump FROM t")
def region_text_in(spark, sf_dir):
    lines = region_text_out(spark, sf_dir)
    read = parse_region(lines.withColumnRenamed("line", "value"))
    dumps = lines.select("id", T.dump_to_region_text(F.col("dump")).alias("from_dump"))
    dumps = dumps.withColumn("from_dump", F.regexp_replace("from_dump", r"^(\d+),(\d+),", "$1,[$2],"))
    return read.join(dumps, "id").select("id", "payload.num_points", F.col("payload.x")[0].alias("x1"), F.col("signature.x_max"), F.col("payload.y")[0].alias("y1"), F.col("signature.y_max"), "from_dump")


@query(f"WITH {TEXT_R2} SELECT id, printf('%.6f,%.6f,%.6f,%.6f', x1, x2, least(y1, y2), greatest(y1, y2)) AS mbr FROM t")
def mbr_text(spark, sf_dir):
    return X.text_rectangles(spark, sf_dir).select("id", T.mbr_text(F.col("signature")).alias("mbr"))


@query("SELECT p_partkey AS id, printf('%016X-%016X', p_partkey, 9223372036854775807) AS whole, printf('%016X-%016X', p_partkey, p_size::BIGINT) AS part_id, p_partkey AS cell, p_size::BIGINT AS sub FROM part")
def partition_id_text(spark, sf_dir):
    p = X.table(spark, sf_dir, "part")
    ids = p.select(F.col("p_partkey").alias("id"), T.partition_id_text(F.col("p_partkey")).alias("whole"), T.partition_id_text(F.col("p_partkey"), F.col("p_size")).alias("part_id"))
    return ids.select("*", T.parse_partition_id(F.col("part_id")).alias("p")).select("id", "whole", "part_id", "p.cell", "p.sub")


@query("SELECT -1::BIGINT AS key, concat(range % 10, ',3,0,0,1,0,1,1') AS value FROM range(30)")
def synthetic_lines(spark, sf_dir):
    return synthetic_regions(spark)


@query(f"WITH {R1}, {EXTENT}, {CELLS} SELECT count(*) AS item_count FROM c")
def item_counter(spark, sf_dir):
    items, grid = gridded(spark, sf_dir)
    return K.replicate(items, grid.cells(SIG("signature"))).agg(F.count("*").alias("item_count"))


@query("SELECT * FROM (VALUES (true, 'shadow', 2, false), (false, 'clone', 2, false)) t(has_signature, algorithm, task_slots, skip_dedup)")
def plan_defaults(spark, sf_dir):
    specs = [JoinSpec("x", build=lambda d: d, cells=hashed, has_signature=s).plan() for s in (True, False)]
    return spark.createDataFrame([(s.has_signature, s.algorithm, s.task_slots, s.skip_dedup) for s in specs], "has_signature boolean, algorithm string, task_slots int, skip_dedup boolean")
