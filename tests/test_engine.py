import datetime

import pytest
from pyspark.sql import functions as F

from pairforge.functions import predicates as P, text as T
from pairforge.functions.regions import parse_region, usable_regions
from pairforge.operators import grid as G, join as J, partitioning as K
from pairforge.plans.runner import StagedRun, stage_name, stage_report
from pairforge.plans.spec import JoinSpec, run_join
from pairforge.queries import fixtures as X
from pairforge.sources import shapefile as S, text as ST

SF = "/root/testdata/sf0.001"
LINES = ["1,3,0,0,1,0,1,1", "2,4,1,0,2,0,2,1,1,1", "3,0", "4,1,0.5,0.5", "5,1,0.5,0.5", "6,2,0,0.5,1,0.5"]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def edge_items(spark):
    return usable_regions(parse_region(spark.createDataFrame([(x,) for x in LINES], "value string")))


def overlap_spec(**kw):
    def cells(items):
        return G.Grid.of(usable_regions(items)).cells(F.col("signature"))

    return JoinSpec("Overlap", build=usable_regions, cells=cells, has_signature=True, accept_signature=P.mbr_intersects, accept_payload=P.same_num_points, **kw)


def test_edge_cases(edge_items):
    for n in (1, 2, 3, 8):
        grid = G.Grid.of(edge_items, n)
        assert rows(J.refpoint_join(edge_items, grid, P.mbr_intersects)) == [(1, 4), (1, 5), (1, 6)]
        assert rows(J.signature_join(edge_items, grid.cells(F.col("signature")), P.mbr_intersects)) == [(1, 4), (1, 5), (1, 6)]


def test_zero_width_and_empty(spark):
    items = parse_region(spark.createDataFrame([("1,2,0,0,0,1",), ("2,1,0,0.5",)], "value string"))
    grid = G.Grid.of(items, 3)
    assert {r.cell % 3 for r in K.replicate(items, grid.cells(F.col("signature"))).collect()} == {0}
    assert G.Grid.of(items.where("id < 0")) is None


def test_malformed_line_fails(spark):
    for bad in ("1,3,0,0", "x,1,0,0", "1,1,0,y"):
        with pytest.raises(Exception):  # noqa: B017
            parse_region(spark.createDataFrame([(bad,)], "value string")).collect()


def test_surplus_fields_are_ignored(spark):
    r = parse_region(spark.createDataFrame([("7,1,2,3,99",)], "value string")).first()
    assert (r.id, r.payload.num_points, r.payload.x, r.payload.y) == (7, 1, [2.0], [3.0])


def test_items_outside_the_grid(spark, edge_items):
    grid = G.Grid(3, 0.4, 0.6, 0.4, 0.6)
    assert rows(J.refpoint_join(edge_items, grid, P.mbr_intersects)) == [(1, 4), (1, 5), (1, 6)]


def test_plans_agree(spark):
    items = X.polygons(spark, SF)
    want = None
    for n in (1, 2, 3, 8):
        cells = G.Grid.of(items, n).cells(F.col("signature"))
        clone = rows(J.clone_join(items, cells, P.mbr_intersects, P.same_num_points))
        shadow = rows(J.shadow_join(items, cells, P.mbr_intersects, P.same_num_points))
        want = want or clone
        assert clone == shadow == want
    assert len(want) == 755
    bag = J.signature_join(items, G.Grid.of(items).cells(F.col("signature")), P.mbr_intersects, distinct=False)
    assert bag.count() == 6250
    assert bag.distinct().count() == 4877


def test_salting(spark):
    replicas = K.replicate(X.polygons(spark, SF).select("id", "signature"), G.Grid.of(X.polygons(spark, SF)).cells(F.col("signature")))
    assert J.block_join(replicas, P.mbr_intersects, salt=4).count() == 6250
    counts = K.partition_counts(replicas)
    splits = {r.n_records: r.n_splits for r in K.split_sizes(counts, 50).collect()}
    assert all(k == max(1, -(-(n - 5) // 50)) for n, k in splits.items())
    parts = K.salted_by_size(replicas, K.split_sizes(counts, 50))
    assert parts.count() == replicas.count() and parts.groupBy("cell", "sub").count().count() == sum(r.n_splits for r in K.split_sizes(counts, 50).collect())
    report = stage_report(replicas).collect()
    assert sum(r.share for r in report) == pytest.approx(1) and report[0].n_records == max(splits)


def test_join_is_on_the_cell(spark):
    items = X.polygons(spark, SF)
    plan = J.signature_join(items, G.Grid.of(items).cells(F.col("signature")), P.mbr_intersects)._jdf.queryExecution().toString()
    assert "cell" in plan.split("Join")[-1] and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_spec(spark):
    spec = overlap_spec()
    assert spec.plan().algorithm == "shadow"
    with pytest.raises(ValueError, match="shadowrandom"):
        overlap_spec(algorithm="shadowrandom").plan()
    with pytest.raises(ValueError, match="build"):
        JoinSpec("x").plan()
    with pytest.raises(ValueError, match="signature"):
        JoinSpec("x", build=lambda d: d, cells=lambda d: None, has_signature=False, algorithm="shadow").plan()
    items = X.polygons(spark, SF)
    assert run_join(items, overlap_spec(algorithm="clone")).count() == run_join(items, spec).count() == 755


def test_resume(spark, tmp_path):
    items = X.polygons(spark, SF)
    first = StagedRun(spark, str(tmp_path), overlap_spec())
    assert first.run(items).count() == 755
    assert first.ran == ["PartitionJoin", "RefinementJoin"]
    again = StagedRun(spark, str(tmp_path), overlap_spec())
    assert again.run(items).count() == 755 and again.ran == []
    changed = StagedRun(spark, str(tmp_path), overlap_spec(version="2"))
    changed.run(items)
    assert changed.ran == ["PartitionJoin", "RefinementJoin"]
    assert stage_name("a", 5, "b") == "a-Stage-05-b"


def test_resume_on_other_input(spark, tmp_path):
    """Other rows, other files under the same path and other code are not taken for a finished run."""
    polygons = X.polygons(spark, SF)
    polygons.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.read.parquet(str(tmp_path / "in"))
    go = lambda df, **kw: (run := StagedRun(spark, str(tmp_path / "work"), overlap_spec(**kw)), run.run(df).count(), run.ran)[1:]
    assert go(read()) == (755, ["PartitionJoin", "RefinementJoin"])
    assert go(read()) == (755, [])
    half = run_join(read().where("id % 2 = 0"), overlap_spec()).count()
    assert go(read().where("id % 2 = 0"))[0] == half < 755
    assert go(read())[0] == 755
    polygons.where("id % 2 = 0").write.mode("overwrite").parquet(str(tmp_path / "in"))
    spark.catalog.refreshByPath(str(tmp_path / "in"))
    assert go(read())[0] == half
    digests = {JoinSpec("x", build=f, cells=len, has_signature=True).digest() for f in (lambda d: d.where("id > 1"), lambda d: d.where("id > 2"))}
    assert len(digests) == 2
    assert "accept_signature" in spark.read.text(str(tmp_path / "work/Overlap-Stage-01-PartitionJoin/_plan/spec")).first().value


def test_bag_under_shadow(spark, tmp_path):
    items = X.polygons(spark, SF)
    n = {a: run_join(items, overlap_spec(algorithm=a, skip_dedup=True)).count() for a in ("clone", "shadow")}
    assert n["clone"] == n["shadow"] > 755
    assert StagedRun(spark, str(tmp_path), overlap_spec(algorithm="shadow", skip_dedup=True)).run(items).count() == n["shadow"]


def test_split_in_the_plan(spark):
    items = X.polygons(spark, SF)
    for kw in ({}, {"pairs": lambda d: G.cell_pairs(spark)}, {"algorithm": "clone"}, {"task_slots": 9}):
        for split in (1, 20, 10**6):
            assert rows(run_join(items, overlap_spec(split_rows=split, **kw))) == rows(run_join(items, overlap_spec()))
    assert run_join(items, overlap_spec(split_rows=20, skip_dedup=True)).count() == run_join(items, overlap_spec(skip_dedup=True)).count()
    # a cell with nearly all rows
    crowded = items.withColumn("signature", F.struct(F.lit(0.0).alias("x_min"), F.when(F.col("id") == 0, 9.0).otherwise(0.5).alias("x_max"), F.lit(0.0).alias("y_min"), F.lit(0.5).alias("y_max")))
    replicas = K.replicate(crowded.select("id", "signature"), F.array(F.lit(7).cast("long")))
    n = replicas.count()
    assert J.block_join(replicas, P.mbr_intersects, split_rows=30).distinct().count() == n * (n - 1) // 2
    with pytest.raises(ValueError, match="split_rows"):
        overlap_spec(split_rows=0).plan()


def test_handler_in_the_plan(spark):
    import pandas as pd

    def ids(pdf):
        return pd.DataFrame({"cell": pdf["cell"][:1], "n": [len(pdf)]})

    spec = overlap_spec(handler=ids, handler_schema="cell long, n long")
    items = X.polygons(spark, SF)
    assert rows(run_join(items, spec)) == rows(K.partition_counts(K.replicate(items, spec.cells(items))))
    with pytest.raises(ValueError, match="handler"):
        overlap_spec(handler=ids).plan()


def test_infinite_coordinates(spark):
    lines = [*LINES, "7,2,0.2,0.2,Infinity,0.4", "8,2,-Infinity,-Infinity,Infinity,Infinity", "9,1,NaN,0", "10,2,5,5,6,6"]
    items = usable_regions(parse_region(spark.createDataFrame([(x,) for x in lines], "value string")))
    a, b = items.alias("a"), items.alias("b")
    want = rows(a.join(b, (F.col("a.id") < F.col("b.id")) & P.mbr_intersects("a", "b")).select("a.id", "b.id"))
    assert (8, 10) in want and (7, 8) in want
    for n in (1, 3, 8):
        assert rows(J.refpoint_join(items, G.Grid.of(items, n), P.mbr_intersects)) == want
    endless = items.where("id = 8")
    assert G.Grid.of(endless).cells(F.col("signature")) is not None and K.replicate(endless, G.Grid.of(endless).cells(F.col("signature"))).count() >= 1


def test_cogroup_hatch(spark):
    import pandas as pd

    replicas = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "id long, cell long")

    def pairs(pdf):
        ids = sorted(pdf["id"])
        return pd.DataFrame([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]], columns=["id_l", "id_r"])

    assert rows(J.cogroup_join(replicas, pairs, "id_l long, id_r long")) == [(1, 2)]


def test_files(spark, tmp_path):
    items = X.text_rectangles(spark, SF)
    lines = items.select(T.region_line(F.col("id"), F.col("payload")).alias("value"))
    lines.write.text(str(tmp_path / "regions"))
    assert rows(ST.read_regions(spark, str(tmp_path / "regions")).select("id", "payload.x")) == rows(items.select("id", "payload.x"))
    pairs = G.cell_pairs(spark)
    ST.write_cell_pairs(pairs, str(tmp_path / "pairs"))
    assert rows(ST.read_cell_pairs(spark, str(tmp_path / "pairs"))) == rows(pairs)
    replicas = K.replicate(items, G.Grid.of(items).cells(F.col("signature")))
    ST.write_partitions(replicas, str(tmp_path / "cells"))
    assert spark.read.parquet(str(tmp_path / "cells")).count() == replicas.count()
    counts = K.partition_counts(replicas)
    ST.write_summary(counts, str(tmp_path / "summary"))
    assert ST.read_summary(spark, str(tmp_path / "summary")).agg(F.sum("n_records")).first()[0] == replicas.count()
    grid = G.Grid.of(items)
    grid.save(spark, str(tmp_path / "grid"))
    assert G.Grid.load(spark, str(tmp_path / "grid")) == grid
    ST.write_pairs(lines.select(F.col("value").alias("a"), F.col("value").alias("b")), "a", "b", str(tmp_path / "out"))
    assert "\t" in spark.read.text(str(tmp_path / "out")).first().value
    assert ST.records_by_split(spark.range(10).repartition(2)).agg(F.sum("n_records")).first()[0] == 10


def test_partition_files_and_dump(spark, edge_items, tmp_path):
    parts, summary, dump = (str(tmp_path / x) for x in ("parts", "summary", "dump"))
    grid = G.Grid.of(edge_items)
    replicas = K.replicate(edge_items, grid.cells(F.col("signature")))
    ST.write_partitions(replicas, parts)
    files = ST.partition_files(spark, parts)
    assert rows(files.groupBy("cell").agg(F.sum("n_records"))) == rows(K.partition_counts(replicas))
    ST.write_summary(files, summary)
    back = ST.read_summary(spark, summary)
    assert back.columns == ["id", "file", "start", "length", "n_records"]
    assert rows(back.drop("id")) == rows(files.drop("cell"))
    moved = back.withColumn("file", F.substring_index("file", "/", -1)).withColumn("cell", T.parse_partition_id(F.col("id")).cell)
    ST.write_summary(moved, summary + "2")
    found = ST.read_summary(spark, summary + "2", folder="/elsewhere/").collect()
    assert all(r.file.startswith("/elsewhere/part-") for r in found)
    text = ST.dump_partition(spark, parts, dump)
    assert rows(spark.read.text(dump)) == rows(text) and text.count() == replicas.count()
    assert text.first().value.startswith("[IPS],,{")


def test_negative_partition_ids(spark):
    df = spark.createDataFrame([(-1, -5), (7, 2**63 - 1)], "cell long, sub long")
    back = df.select(T.parse_partition_id(T.partition_id_text(F.col("cell"), F.col("sub"))).alias("p")).select("p.*")
    assert rows(back) == rows(df)


def test_item_text(spark):
    r = spark.range(1).select(T.item_text(F.lit(5)).alias("a"), T.item_text(F.lit(5), None, F.lit("s")).alias("b")).first()
    assert (r.a, r.b) == ("[I],,{5}", "[IS],,{5},,{s}")


def test_shapefile(spark, tmp_path):
    shapes = [{"x": [0, 1, 1, 5, 6, 6], "y": [0, 0, 1, 5, 5, 6], "parts": [0, 3]}, {}, {"x": [0.2, 0.9, 0.9], "y": [0.1, 0.1, 0.8]}]
    shp, shx = S.encode_shp(shapes, 5)
    (tmp_path / "a.shp").write_bytes(shp)
    (tmp_path / "a.shx").write_bytes(shx)
    fields = [("NAME", "C", 8, 0), ("N", "N", 6, 1), ("D", "D", 8, 0), ("L", "L", 1, 0)]
    (tmp_path / "a.dbf").write_bytes(S.encode_dbf(fields, [{"NAME": "x", "N": 1.5, "D": datetime.date(2020, 1, 2), "L": True}, {}, {"NAME": "z", "L": False}]))
    read = S.read_shapes(spark, str(tmp_path))
    assert [r.shape_type for r in read.orderBy("record").collect()] == [5, 0, 5]
    regions = S.shape_regions(read)
    ids = [10**16, 10**16 + 1, (10**10 + 2) * 10**6]
    assert [r.id for r in regions.orderBy("id").collect()] == ids
    assert rows(J.refpoint_join(regions, G.Grid.of(regions), P.mbr_intersects)) == [(ids[0], ids[2])]
    both = S.shape_records(read, S.read_attributes(spark, str(tmp_path))).orderBy("record").collect()
    assert both[0].attributes == {"NAME": "x", "N": "1.5", "D": "2020-01-02", "L": "true"}
    assert both[1].attributes["L"] is None and both[2].attributes["L"] == "false"


def test_typed_attributes_and_single_shapes(spark, tmp_path):
    shapes = [{"x": [0, 1, 1], "y": [0, 0, 1]}, {}, {"x": [5, 6, 6, 8, 9, 9], "y": [5, 5, 6, 8, 8, 9], "parts": [0, 3]}]
    shp, shx = S.encode_shp(shapes, 5)
    (tmp_path / "a.shp").write_bytes(shp)
    (tmp_path / "a.shx").write_bytes(shx)
    fields = [("ID", "N", 6, 0), ("SIZE", "N", 8, 2), ("DAY", "D", 8, 0), ("OPEN", "L", 1, 0), ("NAME", "C", 5, 0)]
    (tmp_path / "a.dbf").write_bytes(S.encode_dbf(fields, [{"ID": 7, "SIZE": 1.25, "DAY": datetime.date(2020, 1, 2), "OPEN": True, "NAME": "x"}, {}, {"ID": -3}]))
    (tmp_path / "b.dbf").write_bytes(S.encode_dbf([("ID", "C", 4, 0)], [{"ID": "q"}]))
    assert S.read_fields(spark, str(tmp_path / "a.dbf")) == [("ID", "bigint"), ("SIZE", "double"), ("DAY", "date"), ("OPEN", "boolean"), ("NAME", "string")]
    assert dict(S.read_fields(spark, str(tmp_path)))["ID"] == "string"
    typed = [tuple(r.attributes) for r in S.read_table(spark, str(tmp_path / "a.dbf")).orderBy("record").collect()]
    assert typed == [(7, 1.25, datetime.date(2020, 1, 2), True, "x"), (None,) * 5, (-3, None, None, None, None)]
    at = str(tmp_path / "a.shp")
    assert S.parse_shx(shx)[0] == 100
    by_index = [S.read_shape(spark, at, i) for i in (0, 1, 2, -1)]
    assert [(s["record"], s["shape_type"], list(s["x"])) for s in by_index] == [(0, 5, [0, 1, 1]), (1, 0, []), (2, 5, [5, 6, 6, 8, 9, 9]), (2, 5, [5, 6, 6, 8, 9, 9])]
    (tmp_path / "a.shx").unlink()
    assert [S.read_shape(spark, at, i)["parts"] for i in (2, -1)] == [[0, 3]] * 2
    for i in (3, -4):
        with pytest.raises(IndexError):
            S.read_shape(spark, at, i)


@pytest.mark.parametrize("kind", [11, 13, 15, 18, 21, 23, 25, 28])
def test_shapes_with_z_and_m(kind):
    n = 1 if kind in (11, 21) else 3
    shape = {"x": [1.0, 2.0, 3.0][:n], "y": [4.0, 5.0, 4.0][:n], "z": [7.0, 8.0, 9.0][:n], "m": [0.5, 1.5, 2.5][:n]}
    got = next(S.parse_shp(S.encode_shp([shape], kind)[0]))
    assert (got["shape_type"], got["x"], got["y"], got["m"]) == (kind, shape["x"], shape["y"], shape["m"])
    assert got["z"] == (shape["z"] if kind in S.WITH_Z else None)


def test_several_shapefiles(spark, tmp_path):
    for name, x in (("a", 0.0), ("b", 0.5)):
        (tmp_path / f"{name}.shp").write_bytes(S.encode_shp([{"x": [x, x + 1, x + 1], "y": [0, 0, 1]}], 5)[0])
    regions = S.shape_regions(S.read_shapes(spark, str(tmp_path)))
    assert [r.id for r in regions.orderBy("id").collect()] == [10**16, 2 * 10**16]
    assert rows(J.refpoint_join(regions, G.Grid.of(regions), P.mbr_intersects)) == [(10**16, 2 * 10**16)]


def test_shape_kinds():
    import struct

    for kind in (1, 8):
        shp, _ = S.encode_shp([{"x": [1.0], "y": [2.0]}], kind)
        assert next(S.parse_shp(shp))["x"] == [1.0]
    z = S.parse_shape(struct.pack("<i4d", 11, 1, 2, 3, 4))
    assert (z["z"], z["m"]) == ([3.0], [4.0])
    body = struct.pack("<i4di2d2d1d2d1d", 18, 0, 0, 1, 1, 1, 5, 6, 0, 9, 9, 0, 7, 7)
    z = S.parse_shape(body)
    assert (z["x"], z["z"], z["m"]) == ([5.0], [9.0], [7.0])
