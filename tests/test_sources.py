"""File scans on small files of our own."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from footfall.plans import catalogue
from footfall.sources import files
from footfall.streaming import ingest
from tests.oracle import same


def put(path, text):
    path.write_text(text)
    return str(path)


def test_both_detection_headers(spark, tmp_path):
    new = put(tmp_path / "new.csv", "date_time;mac_address;kind;station_name\n2024-01-01 00:00:01;m1;wifi;Site-1\n")
    old = put(tmp_path / "old.csv", "date_time;mac-address;kind;station_name\n2024-01-01 00:00:01;m1;wifi;Site (1)\n")
    a, b = files.detections_csv(spark, new).first(), files.detections_csv(spark, old).first()
    assert a["mac_address"] == b["mac_address"] == "m1" and a["date_time"] == b["date_time"]


def test_road_files(spark, tmp_path):
    pro = put(tmp_path / "a.pro", "h h\n5 1 2 100.5 0.0 1 0 x 50.0 0 Via Roma\n6 2 3 20 1.5 1 0 x 30 1 Corso\n")
    pnt = put(tmp_path / "a.pnt", "5 0 2\n44000000 11000000\n44000010 11000010\n6 0 3\n1 2\n3 4\n5 6\n")
    roads = {r["lid"]: r for r in files.road_table(spark, pro).collect()}
    assert roads[5]["name"] == "Via Roma" and roads[6]["speed"] == 30 and roads[5]["length"] == 100.5
    points = [tuple(r) for r in files.road_points(spark, pnt).orderBy("lid", "seq").collect()]
    assert points == [(5, 0, 44000000, 11000000), (5, 1, 44000010, 11000010), (6, 0, 1, 2), (6, 1, 3, 4), (6, 2, 5, 6)]


def test_points_over_many_splits(spark, tmp_path):
    """Blocks that begin in one split and end some splits later keep their places."""
    sizes = [3, 90, 1, 0, 40, 7]
    text = "".join(f"{lid} 0 {n}\n" + "".join(f"{lid * 100 + i} {i}\n" for i in range(n)) for lid, n in enumerate(sizes))
    path = put(tmp_path / "a.pnt", text)
    put(tmp_path / "b.pnt", "77 0 1\n5 6\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        got = sorted(map(tuple, files.road_points(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([(lid, i, lid * 100 + i, i) for lid, n in enumerate(sizes) for i in range(n)] + [(77, 0, 5, 6)])


def test_ranges_of_a_database(spark):
    """A table of an embedded database read in chunks of hours: each row once, bounds of the range as [start, stop)."""
    url, options = "jdbc:derby:memory:footfall;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.sql("SELECT id AS ID, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 30 * CAST(id AS INT)) AS DATE_TIME FROM range(20)")
    rows.write.jdbc(url, "detections", mode="overwrite", properties=options)
    got = files.jdbc_range(spark, url, "detections", "date_time", "2024-01-01 01:00:00", "2024-01-01 08:00:00", 2, **options)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(r["ID"] for r in got.collect()) == list(range(2, 16))


def test_counts_turns_barriers(spark, tmp_path):
    counts = files.edge_counts(spark, put(tmp_path / "a.fluxes", "# lid cid FT TF\n0 10 0 5\n1 11 3 0\n"))
    assert sorted(map(tuple, counts.collect())) == [(0, 10, 1, 5), (1, 11, 3, 1)]
    turns = files.forbidden_turns(spark, put(tmp_path / "t.csv", "1;2\n1;3\n2;1\n"))
    assert sorted((r[0], r[1]) for r in turns.collect()) == [(1, [2, 3]), (2, [1])]
    bars = files.barriers(spark, put(tmp_path / "b.csv", "gate_IN;44.1;11.1\ngate_OUT;44.1;11.1\nweir_IN;44.2;11.2\n"))
    assert sorted(r["base"] for r in bars.collect()) == ["gate", "weir"]


def test_geojson_both_ways(spark, tmp_path):
    shape = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"uid": "4"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}, {"type": "Feature", "properties": {"PK_UID": "5"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[9, 9], [10, 9], [10, 10], [9, 9]]]]}}]}
    got = {r["uid"]: len(r["ring"]) for r in files.polygons(spark, put(tmp_path / "p.json", json.dumps(shape, indent=1))).collect()}
    assert got == {4: 4, 5: 4}
    cells = spark.createDataFrame([(1, 2, 7)], "row int, col int, cnt int")
    feature = json.loads(files.cell_features(cells, 0.0, 0.0, 10.0).first()["value"])
    assert feature["geometry"]["coordinates"][0][0] == [20.0, 10.0] and feature["properties"]["cnt"] == 7


def test_transit_and_lines(spark, tmp_path):
    legs = files.transit_legs(spark, put(tmp_path / "t.csv", "x;trip1;r1;A;10;B;20;C;35\n"))
    assert [(r["from"], r["to"], r["leaves"], r["arrives"]) for r in legs.orderBy("seq").collect()] == [("A", "B", 10, 20), ("B", "C", 20, 35)]
    lines = files.line_protocol(spark, put(tmp_path / "l.txt", "gridstate,id=3 cnt=4 1700000000000000000\ngridstate,id=4 cnt=0 1700000000000000000\n"))
    assert [tuple(r) for r in lines.collect()] == [(3, 4, 1700000000)]


def test_placemarks(spark, tmp_path):
    kml = "<kml><Document><Placemark><name>Dock</name><description>source north</description><Point><coordinates>11.5,44.8,0</coordinates></Point></Placemark></Document></kml>"
    row = files.placemarks(spark, put(tmp_path / "a.kml", kml), {"^source": "source", "^attr": "attraction"}).first()
    assert (row["name"], row["lon"], row["lat"], row["role"]) == ("Dock", 11.5, 44.8, "source")


def test_range_predicates_cover_each_instant_once():
    got = files.range_predicates("t", "2024-01-01T00:00:00", "2024-01-01T05:00:00", 2)
    assert len(got) == 3 and got[0] == "t >= '2024-01-01 00:00:00' AND t < '2024-01-01 02:00:00'" and got[-1].endswith("t < '2024-01-01 05:00:00'")


def test_fallback(spark):
    a, b = spark.range(0), spark.range(3)
    assert files.with_fallback(a, b).count() == 3 and files.with_fallback(b, a).count() == 3


def test_stream_store_is_idempotent(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(20).selectExpr("id % 5 AS k", "id AS v").write.parquet(str(source))
    schema = "k BIGINT, v BIGINT"
    for _ in range(2):
        stream = ingest.file_stream(spark, str(source), schema)
        ingest.store_once(stream, ["k"], str(tmp_path / "store"), str(tmp_path / "state"), "v").awaitTermination()
    got = spark.read.schema(schema).parquet(str(tmp_path / "store")).select("k", "v")
    assert sorted(tuple(r) for r in got.collect()) == [(i, i) for i in range(5)]


def test_stream_store_reads_the_days_of_a_batch(spark, tmp_path):
    """A file a batch: keys that came on that day before are not stored again, and another day's files aren't read."""
    schema = "k BIGINT, t TIMESTAMP_NTZ, v BIGINT"
    batches = [[(1, "2024-01-01 05:00:00", 1), (1, "2024-01-01 05:00:00", 2), (2, "2024-01-02 00:00:00", 3)], [(1, "2024-01-01 05:00:00", 0), (2, "2024-01-03 00:00:00", 4)], [(2, "2024-01-02 00:00:00", 9), (3, None, 1)], [(3, None, 0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, t, v) for k, t, v in rows], "k bigint, t string, v bigint").selectExpr("k", "cast(t AS timestamp_ntz) AS t", "v").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
        stream = ingest.file_stream(spark, str(tmp_path / "in"), schema, recursiveFileLookup="true")
        ingest.store_once(stream, ["k", "t"], str(tmp_path / "store"), str(tmp_path / "state"), "v", "t").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "store")).select("k", F.col("t").cast("string"), "v")
    want = [(1, "2024-01-01 05:00:00", 1), (2, "2024-01-02 00:00:00", 3), (2, "2024-01-03 00:00:00", 4), (3, None, 1)]
    # Null times are of no day, and are equal to nothing.
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([*want, (3, None, 0)], key=repr)
    assert {p.name for p in (tmp_path / "store").glob("_day=*")} == {"_day=2024-01-01", "_day=2024-01-02", "_day=2024-01-03", "_day=__HIVE_DEFAULT_PARTITION__"}


def test_barrier_files(spark, tmp_path):
    path = put(tmp_path / "bar_1.json", json.dumps([{"cam_name": "c", "timestamp": 5, "datetime": "x", "counter": {"b": {"IN": 2, "OUT": 3}}}]))
    rows = spark.read.option("multiLine", True).schema(ingest.BARRIER_FILE).json(path)
    meta = spark.createDataFrame([("c", "b", "IN", 1), ("c", "b", "OUT", 2)], "cam_name string, barrier string, direction string, uid int")
    assert sorted(tuple(r) for r in ingest.barrier_rows(rows, meta).collect()) == [(5, 1, 2), (5, 2, 3)]


def test_cell_answers(spark):
    rows = spark.createDataFrame([('{"10": {"a": 1, "b": 2}}',)], "value string")
    assert sorted(tuple(r) for r in files.cell_answers(rows).collect()) == [(10, "a", 1), (10, "b", 2)]
    assert files.randomised_counts(spark.createDataFrame([(0,)], "t bigint")).select(F.hour("date_time")).first()[0] == 1


def test_edge_usage(spark, tmp_path):
    lines = ["p.cid; p.lid; nF.cid; nT.cid; FT.cnt; TF.cnt; tot.cnt; length", " 2; 1; 41; 13; 4; 5; 9; 1013.58", "3;2;13;7;0;0;0;5", "3;2;13;7;1;1;2;5"]
    usage = files.edge_usage(spark, put(tmp_path / "usage.csv", "\n".join(lines)))
    assert tuple(usage.filter("lid = 1").first()) == (2, 1, 41, 13, 4, 5, 9, 1013.58)
    edges = spark.createDataFrame([(1,), (2,), (3,)], "lid bigint")
    assert sorted(tuple(r) for r in files.with_usage(edges, usage).collect()) == [(1, 9), (2, 2), (3, 1)]
    assert sorted(tuple(r) for r in files.with_usage(edges, usage.limit(0)).collect()) == [(1, 1), (2, 1), (3, 1)]


def test_stream_fans_out_to_stores(spark, tmp_path):
    source, schema = tmp_path / "in", "k int, v int"
    stores = {str(tmp_path / "low"): "v < 5", str(tmp_path / "all"): "true"}
    for part in ([(1, 1), (2, 9)], [(3, 3)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(source))
        ingest.fan_out(ingest.file_stream(spark, str(source), schema), stores, str(tmp_path / "state")).awaitTermination()
    got = [sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) for path in stores]
    assert got == [[(1, 1), (3, 3)], [(1, 1), (2, 9), (3, 3)]]


def test_progress_goes_on_after_a_restart(spark, tmp_path):
    """Snapshots told by timers over several runs are those of the batch, each once; a late row is left out."""
    from footfall.streaming import progress

    minutes = {"a": [1, 2, 3, 14, 15, 61, 200], "b": [5, 90, 91, 92, 199], None: [7, 150]}
    rows = [(k, m) for k, ms in minutes.items() for m in ms]
    schema = "key string, at timestamp"
    frame = lambda part: spark.createDataFrame(part, "key string, m int").selectExpr("key", "timestamp_seconds(1700000000 + m * 60) AS at")
    where = str(tmp_path / "in")
    runs = [[r for r in rows if r[1] < 60], [r for r in rows if 60 <= r[1] < 160] + [("a", 4)], [r for r in rows if r[1] >= 160]]
    for part in runs:
        frame(part).coalesce(1).write.mode("append").parquet(where)
        stream = ingest.file_stream(spark, where, schema)
        progress.progress_stream(stream, "key", "at", 600_000, 3, "5 minutes", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    key = lambda r: (r[0] or "", *r[1:])
    got = sorted(map(key, spark.read.parquet(str(tmp_path / "out")).select("key", "step", "cnt", "fresh").collect()))
    want = sorted(map(key, progress.progress_batch(frame(rows), "key", "at", 600_000, 3, 300_000).select("key", "step", "cnt", "fresh").collect()))
    assert got == want and len(got) > 20 and any(r[3] == 0 for r in got)


@pytest.mark.parametrize("name", ["progress_snapshots", "stream_fan_out", "stream_unique_devices"])
def test_streams_of_a_table_in_several_files(spark, sf, tmp_path, name):
    """A table may be a folder of files; the stream of it was empty then."""
    path = f"{tmp_path}/events.parquet"
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    same(catalogue.QUERIES[name](spark, str(tmp_path)), con, catalogue.SQL[name])


def test_progress_at_the_end_of_a_step(spark, sf, tmp_path):
    """A row in the last half millisecond of an hour counts in the next one, as in the SQL; it was told an hour early."""
    path = f"{tmp_path}/events.parquet"
    con = duckdb.connect()
    rows = ", ".join(f"({900000 + k}, TIMESTAMP '2024-02-01 0{k}:59:59.{part}', 1, '{kind}', 1.0, NULL)" for k, (part, kind) in enumerate([("999499", "a"), ("9995", "a"), ("9999", "b"), ("000001", "b"), ("9996", "a")]))
    con.execute(f"COPY (SELECT * FROM '{sf}/events.parquet' UNION ALL VALUES {rows}, (900009, TIMESTAMP '2024-02-01 06:09:59.9996', 1, 'a', 1.0, NULL)) TO '{path}'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    same(catalogue.QUERIES["progress_snapshots"](spark, str(tmp_path)), con, catalogue.SQL["progress_snapshots"])
