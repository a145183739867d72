"""Catalogue functions, hexagonal cells, archives by ranges."""

import io
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import hexgrid
from sedimenta.operators.catalogue import review_catalogue
from sedimenta.sources import archives

SF = "/root/testdata/sf0.001"


def review(spark):
    review_catalogue(spark, *[spark.read.parquet(f"{SF}/{t}.parquet") for t in ("customer", "nation", "orders")])


def test_role_filter_reaches_the_scan(spark):
    review(spark)
    plan = lambda q: spark.sql(q)._jdf.queryExecution().executedPlan().toString()
    curator = plan("SELECT c_custkey FROM visible_customers('curator')")
    assert "LessThanOrEqual(n_regionkey,2)" in curator and "c_acctbal" not in curator and "Python" not in curator
    assert spark.sql("SELECT * FROM visible_customers('guest')").collect() == spark.sql("SELECT * FROM visible_customers(NULL)").collect() == []
    assert spark.sql("SELECT may_see('administrator', NULL), may_see('curator', NULL), may_see(NULL, 1), balance_for('curator', -1.0), balance_for('administrator', -1.0)").first()[:] == (True, False, False, None, -1.0)
    low = spark.sql("SELECT count_if(balance < 0) FROM visible_customers('curator')").first()[0]
    assert low == 0 < spark.sql("SELECT count_if(balance < 0) FROM visible_customers('administrator')").first()[0]


def points(n, seed):
    r = random.Random(seed)
    return [(i, r.uniform(-180, 180), math.degrees(math.asin(r.uniform(-1, 1)))) for i in range(n)]


@pytest.mark.parametrize("res", [0, 1, 4, 9])
def test_a_point_is_in_the_cell_with_the_nearest_centre(spark, res):
    df = spark.createDataFrame(points(300, res) + [(900, 180.0, 90.0), (901, -180.0, -90.0), (902, 0.0, 0.0)], "i long, lon double, lat double")
    cells = df.withColumn("c", hexgrid.cell(F.col("lon"), F.col("lat"), res))
    around = F.array(*[F.struct(F.lit(res).alias("res"), (F.col("c.q") + a).alias("q"), (F.col("c.r") + b).alias("r")) for a, b in ((0, 0), *hexgrid.AROUND)])
    scale = hexgrid._scale(res)
    for x in cells.select("lon", "lat", around.alias("near")).collect():
        z = complex(math.radians(x.lon), math.sin(math.radians(x.lat))) * scale
        gaps = [abs(z - complex(c.q + c.r / 2, c.r * math.sqrt(3) / 2)) for c in x.near]
        assert gaps[0] <= min(gaps) + 1e-9 and gaps[0] <= 1 / math.sqrt(3) + 1e-9


@pytest.mark.parametrize("res", [1, 3, 6])
def test_a_childs_centre_lies_in_its_parent(spark, res):
    df = spark.createDataFrame([(i, lon * 0.9, lat * 0.8) for i, lon, lat in points(300, res + 50)], "i long, lon double, lat double")
    rows = df.select(hexgrid.cell(F.col("lon"), F.col("lat"), res).alias("c")).withColumn("p", hexgrid.parent(F.col("c"))).withColumn("m", hexgrid.centre(F.col("c"), res))
    rows = rows.withColumn("of_centre", hexgrid.cell(F.col("m.lon"), F.col("m.lat"), res - 1)).withColumn("kids", hexgrid.children(F.col("p")))
    for x in rows.collect():
        assert abs(x.m.lat) >= 89 or x.of_centre is None or x.of_centre == x.p
        assert x.c in x.kids and len(set(x.kids)) == 7
    # the seven children of a cell have it as their parent, whatever its coordinates
    grid = spark.range(-40, 41).select(F.col("id").alias("q")).join(spark.range(-40, 41).select(F.col("id").alias("r")), F.lit(True)).select(F.struct(F.lit(res).alias("res"), "q", "r").alias("p"))
    back = grid.select("p", F.explode(hexgrid.children(F.col("p"))).alias("c")).select("p", "c", hexgrid.parent(F.col("c")).alias("up"))
    assert back.where("p.q <> up.q OR p.r <> up.r OR p.res <> up.res").count() == 0
    assert back.select("c").distinct().count() == back.count()


def test_hexagons_have_edges_in_common_and_nulls(spark):
    df = spark.createDataFrame([(0.0, 0.0), (None, 1.0), (181.0, 0.0), (0.0, -91.0)], "lon double, lat double")
    got = df.select(hexgrid.cell(F.col("lon"), F.col("lat"), 2).alias("c")).select("c", hexgrid.name(F.col("c")).alias("n"), hexgrid.boundary(F.col("c"), 2).alias("b"), hexgrid.parent(F.col("c")).alias("p")).collect()
    assert got[0].n == "2:0:0" and len(got[0].b) == 6 and [x.c for x in got[1:]] == [None] * 3
    beside = df.limit(1).select(hexgrid.boundary(F.struct(F.lit(2).alias("res"), F.lit(1).cast("long").alias("q"), F.lit(0).cast("long").alias("r")), 2).alias("b")).first().b
    near = lambda a, b: abs(a.lon - b.lon) + abs(a.lat - b.lat) < 1e-9
    assert sum(near(a, b) for a in got[0].b for b in beside) == 2
    assert df.limit(1).select(hexgrid.parent(hexgrid.cell(F.col("lon"), F.col("lat"), 0))).first()[0] is None
    with pytest.raises(ValueError):
        hexgrid.cell(F.col("lon"), F.col("lat"), 16)


# --- archives


def archive(path, members, method):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in members.items():
            z.writestr(name, data)


def reader_of(data, most):
    """read(n, at) over bytes, which fails when asked for more than `most`."""
    asked = []

    def read(n, at):
        asked.append(n)
        assert n <= most, n
        return data[at : at + n]

    return read, asked


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
@pytest.mark.parametrize("text", [b"", b"h\n", b"h\na\n\nbb\r\nccc", b"one line", b"\n\n\n", "h\nä€\U0001f600\n".encode() * 40])
def test_ranges_give_each_line_once(method, text):
    buffer = io.BytesIO()
    archive(buffer, {"x.csv": text, "y/z.csv": b"other"}, method)
    data = buffer.getvalue()
    read, _ = reader_of(data, 1 << 17)
    name, kind, header, size = next(archives.members(read, len(data)))
    assert (name, kind) == ("x.csv", archives.STORED if method == zipfile.ZIP_STORED else archives.DEFLATED)
    want = [x.removesuffix(b"\r") for x in text.split(b"\n")]
    want = want[:-1] if want[-1] == b"" else want
    for step in (1, 2, 3, 7, 1000):
        step = step if kind == archives.STORED else max(size, 1)
        got = [x for at in range(0, size, step) for x in archives.lines_of(read, archives.Range("", name, kind, header, size, at, min(at + step, size)))]
        assert [x for _, x in got] == want
        if text:
            assert [at for at, _ in got] == sorted({at for at, _ in got})


def test_archives_are_read_by_directory_and_ranges_only():
    text = b"id,name\n" + b"".join(b"%d,%s\n" % (i, b"x" * 50) for i in range(200_000))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z, z.open(zipfile.ZipInfo("big.csv"), "w", force_zip64=True) as f:
        f.write(text)
    data = buffer.getvalue()
    read, asked = reader_of(data, archives.CHUNK)
    (name, kind, header, size), = archives.members(read, len(data))
    assert size == len(text) and sum(asked) < 1 << 17
    asked.clear()
    middle = archives.Range("", name, kind, header, size, size // 2, size // 2 + 1000)
    assert 15 <= len(list(archives.lines_of(read, middle))) <= 20 and sum(asked) <= archives.CHUNK + 30
    for bad in (b"", b"no archive at all", data[:-40]):
        with pytest.raises((ValueError, IndexError)):
            list(archives.members(reader_of(bad, 1 << 20)[0], len(bad)))


def test_unsafe_members_are_errors():
    for name in ("../x.csv", "/x.csv", "a\\b.csv"):
        buffer = io.BytesIO()
        archive(buffer, {name: b"x"}, zipfile.ZIP_STORED)
        data = buffer.getvalue()
        if name == "a\\b.csv" and b"a\\b" not in data:
            continue
        with pytest.raises(ValueError):
            list(archives.members(reader_of(data, 1 << 20)[0], len(data)))


def test_archives_round_trip_with_columns_and_partitions_pushed(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f'n "{i}", é', i % 3) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, name string, k int")
    at = f"file://{tmp_path}/zips"
    assert archives.write_zip_csv(df.repartition(3, "id"), at) == 3
    back = archives.read_zip_ranges(spark, at, ["name", "id"], range_bytes=5000)
    assert back.columns == ["archive", "member", "byte_offset", "name", "id"] and back.rdd.getNumPartitions() > 20
    assert sorted((int(r.id), r.name) for r in back.collect()) == [(i, n) for i, n, _ in rows]
    one = back.select("archive").distinct().orderBy("archive").first().archive
    part = archives.read_zip_ranges(spark, at, ["id"]).where(F.col("archive") == one)
    assert part.rdd.getNumPartitions() == 1 and 0 < part.count() < 5000
    places = archives.numbered(back).groupBy("archive").agg(F.min("row_number").alias("a"), F.max("row_number").alias("b"), F.countDistinct("row_number").alias("n"), F.count("*").alias("all")).collect()
    assert all(p.a == 1 and p.b == p.n == p["all"] for p in places)
    with pytest.raises(Exception, match="gone"):
        archives.read_zip_ranges(spark, at, ["gone"]).collect()
    (tmp_path / "none").mkdir()
    assert archives.read_zip_ranges(spark, f"file://{tmp_path}/none", ["id"]).collect() == []
    assert archives.write_zip_csv(df.where("false"), f"file://{tmp_path}/empty") == 0
