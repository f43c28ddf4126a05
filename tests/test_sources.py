import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrel.sources import images, project, reports
from rastrel.streaming import grids
from tests.conftest import DATA


def pixels(spark, high=6, wide=5):
    rows = [("a", y, x, float(40 * x), float(30 * y), float((x * y * 7) % 256)) for y in range(high) for x in range(wide)]
    return spark.createDataFrame(rows, "image_id string, y int, x int, r double, g double, b double")


def test_png_round_trip(spark, tmp_path):
    df = pixels(spark)
    images.save(images.encoded(df, "image_id"), str(tmp_path / "i"), "image_id")
    back = images.read_images(spark, str(tmp_path / "i"))
    want = {(r["y"], r["x"], int(r["r"]), int(r["g"]), int(r["b"])) for r in df.collect()}
    assert {(r["y"], r["x"], r["r"], r["g"], r["b"]) for r in back.collect()} == want
    assert back.agg(F.max("height"), F.max("width"), F.max("channels"), F.min("a")).first() == (6, 5, 3, 255)


def test_gray_and_transparent(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "gray.png").write_bytes(images.png(np.arange(20, dtype=np.uint8).reshape(4, 5)))
    (tmp_path / "g" / "rgba.png").write_bytes(images.png(np.full((2, 2, 4), 9, np.uint8)))
    got = images.read_images(spark, str(tmp_path / "g"))
    assert got.where("channels = 1 and r = g and g = b").count() == 20 and got.where("channels = 4 and a = 9").count() == 4


def test_bad_files_raise(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="not an image"):
        images.read_images(spark, str(tmp_path / "b")).collect()


def test_frames(spark, tmp_path):
    df = pixels(spark).withColumn("frame", F.explode(F.array(F.lit(0), F.lit(10), F.lit(50)))).drop("image_id")
    images.save_frames(images.draw_points(df, [(0.5, 0.5)], 6, 5), str(tmp_path / "f"))
    assert sorted(p.name for p in (tmp_path / "f").iterdir()) == ["0.png", "0_color0.png", "10.png", "50.png", "50_color0.png"]


def test_project_round_trip(spark, tmp_path):
    made = project.Project("a.png", "b.png", (project.Layer(points=((0.1, 0.2, 0.3, 0.4),), ssim_clamp=0.25, boundary="border"), project.Layer(mask1="m.png", max_iter=50)))
    project.write_project(spark, made, str(tmp_path / "p"))
    assert project.read_project(spark, str(tmp_path / "p")) == made
    assert project.control_points(spark, made).collect()[0][2:] == (0.1, 0.2, 0.3, 0.4)
    assert project.parameters(spark, made).count() == 2
    assert project.parse("<project><layers num='1'/></project>") == project.Project()
    for bad in ("<project><layers num='9'/></project>", "<project><layers num='1'><l0><parameters><boundary lock='7'/></parameters></l0></layers></project>", "<project><layers num='1'><l0><parameters><points image1='0 0' image2=''/></parameters></l0></layers></project>"):
        with pytest.raises(ValueError):
            project.parse(bad)


def test_reports(spark, tmp_path):
    field = spark.createDataFrame([(1, 0, 0.5, -0.25), (0, 1, 2.0, 3.0), (0, 0, 1.0, 0.0)], "y int, x int, vx double, vy double")
    reports.export_field(field, str(tmp_path / "d"))
    text = [r[0] for r in spark.read.text(str(tmp_path / "d")).collect()]
    assert text == ["1.000000 0.000000", "2.000000 3.000000", "0.500000 -0.250000"]
    metrics = reports.Metrics()
    with metrics.stage("all"):
        for _ in range(2):
            with metrics.stage("part", 10):
                pass
    rows = {r["stage"]: r for r in metrics.table(spark).collect()}
    assert rows["all/part"]["runs"] == 2 and rows["all"]["percent"] == 100 and rows["all/part"]["percent"] <= 100
    assert reports.rate(2.5e6) == "2.50 M" and reports.rate(3) == "3.00 "


def test_stream(spark, tmp_path):
    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{DATA}/events.parquet").coalesce(1).write.parquet(str(tmp_path / "in" / "e"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "e"))
    grids.to_table(grids.density(stream), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    total = spark.read.parquet(f"{DATA}/events.parquet").count()
    assert 0.9 * total < got.agg(F.sum("v")).first()[0] <= total
    with grids.stoppable(spark, "g") as stop:
        assert spark.range(5).count() == 5
        stop()
