"""Rasters in files as a data source, and metrics written country by country."""

import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_fields import tiff

from parcelspark.plans.bindings import tiled_tiff
from parcelspark.sources import raster_files as files
from parcelspark.sources.tiff import Raster, decoded


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Images of three countries: strips and tiles, one band and several."""
    root = tmp_path_factory.mktemp("rasters")
    rng = np.random.default_rng(3)
    images = {}
    for n, (country, size, tile) in enumerate((("a", (40, 25), None), ("a", (64, 48), (16, 16)), ("country=b", (33, 70), (16, 32)), ("c", (5, 5), None))):
        image = rng.integers(0, 60000, (1 + n % 3, *size)).astype("u2")
        (root / country).mkdir(exist_ok=True)
        (root / country / f"{n}.tif").write_bytes(tiff(image, "<>"[n % 2], (1, 8, 5, 8)[n], 1 + n % 2, n == 2, tile))
        images[country.removeprefix("country="), f"{n}.tif"] = image
    (root / "a" / "notes.txt").write_text("no image")
    return f"file://{root}", images


def read(df):
    return {(r.country, r.file.rsplit("/", 1)[1], r.top, r.left): np.array(r.image).reshape(r.bands, r.h, r.w) for r in df.collect()}


@pytest.mark.parametrize("most", [1 << 30, 2000])
@pytest.mark.parametrize("window", [0, 7, 16])
def test_windows_are_parts_of_whole_images(spark, folder, window, most):
    root, images = folder
    got = read(files.raster_windows(spark, root, window, None, most))
    seen = {k: np.full(i.shape, -1.0) for k, i in images.items()}
    for (country, name, top, left), part in got.items():
        whole = seen[country, name]
        assert (whole[:, top : top + part.shape[1], left : left + part.shape[2]] == -1).all()
        whole[:, top : top + part.shape[1], left : left + part.shape[2]] = part
    assert all((seen[k] == i).all() for k, i in images.items())
    if not window:
        assert len(got) == 4


def test_country_filters_reach_the_source(spark, folder):
    root, _ = folder
    for countries in (["a"], ["b", "c", "zz"], ["none"], []):
        wanted = files.raster_windows(spark, root, 0, countries, 2000).where("h > 0")
        assert {k[0] for k in read(wanted)} == set(countries) & {"a", "b", "c"}
        plan = wanted._jdf.queryExecution().executedPlan().toString()
        if countries:
            assert "h#" in plan and " IN (" not in plan and "country#" not in plan.split("Filter")[1].split("BatchScan")[0].replace("isnotnull(country#", "")
    assert files.raster_windows(spark, root, 0, ["c"], 2000).rdd.getNumPartitions() == 1 < files.raster_windows(spark, root, 0, None, 2000).rdd.getNumPartitions()


def test_a_frame_keeps_its_rows_after_a_narrower_use(spark, folder):
    root, _ = folder
    for df, n in ((files.raster_windows(spark, root), 4), (files.raster_windows(spark, root, 0, ["a", "b"]), 3)):
        assert [df.count(), df.where("country = 'b'").count(), df.count(), df.where("country = 'none'").count(), df.count()] == [n, 1, n, 0, n]


def test_reader_takes_only_filters_that_hold_anyway():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = files.Reader({"path": "file:///nowhere", "countries": '["b"]'})
    more, other = GreaterThan(("h",), 3), EqualTo(("country",), "c")
    assert list(reader.pushFilters([In(("country",), ("a", "b")), more, other, EqualTo(("country",), "b")])) == [more, other]
    assert reader.countries == {"b"} and reader.partitions()[0].files == []
    assert list(files.Reader({"path": "file:///nowhere"}).pushFilters([other])) == [other]


def test_partitions_are_planned_by_bytes():
    listed = [("a", f"f{i}", 10) for i in range(10)] + [("b", "large", 95)]
    parts = files.planned(listed, 30)
    assert [len(p) for p in parts] == [3, 3, 3, 1, 1, 1, 1, 1]
    assert [p[0] for p in parts[3:7]] == [("b", "large", k, 4) for k in range(4)]
    every = [w for k in range(7) for w in files.windows(50, 30, 8, k, 7)]
    assert every == files.windows(50, 30, 8, 0, 1) and len(every) == 7 * 4


def test_windows_read_only_the_tiles_they_touch():
    image = np.arange(64 * 64, dtype=np.float32).reshape(64, 64)
    data = tiled_tiff(image, 16)
    assert (decoded(data)[0] == image).all()
    touched = []

    def some(at, size):
        touched.append((at, size))
        return data[at : at + size]

    raster = Raster(some)
    touched.clear()
    assert (raster.window(20, 3, 8, 8)[0] == image[20:28, 3:11]).all() and touched == [raster.places[4]]
    touched.clear()
    assert (raster.window(30, 30, 4, 40)[0] == image[30:34, 30:]).all() and touched == [raster.places[k] for k in (5, 6, 7, 9, 10, 11)]


def test_odd_folders_and_files(spark, tmp_path):
    assert files.raster_windows(spark, f"file://{tmp_path}/none").collect() == []
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "bad.tif").write_bytes(b"no image at all")
    with pytest.raises(Exception, match="bad.tif: not a TIFF file"):
        files.raster_windows(spark, f"file://{tmp_path}").collect()


# ---------------------------------------------------------------- metrics by country


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(0)
    rows = [("xyz"[i % 3], f"p{i}", 8 + i % 2, 8, 1, rng.uniform(0, 10000, (8 + i % 2) * 8).tolist(), rng.integers(0, 2, (8 + i % 2) * 8).tolist()) for i in range(30)]
    return spark.createDataFrame(rows, "country string, patch_id string, h int, w int, bands int, image array<float>, gt array<int>").repartition(3).cache()


def test_a_run_that_ended_goes_on_where_it_ended(spark, samples, tmp_path):
    from parcelspark.operators import scorers
    from parcelspark.sources import catalog
    from parcelspark.sources.metrics_folder import MetricsFolder

    make, asked = scorers.threshold_scorer(0.5), []
    path, out = f"file://{tmp_path}/folder", f"file://{tmp_path}/out"

    def rows_of(country):
        asked.append(country)
        if country == "y" and asked.count("y") == 1:
            raise RuntimeError("killed")
        return scorers.evaluated(samples.where(F.col("country") == country), make)

    folder = MetricsFolder(spark, path, {"scorer": "a"})
    with pytest.raises(RuntimeError):
        folder.fill(["x", "y", "none", "z"], rows_of, out)
    assert folder.committed() == ["x"]
    (tmp_path / "folder" / "rows" / "z").mkdir()  # begun, not committed
    (tmp_path / "folder" / "rows" / "z" / "part-0.parquet").write_bytes(b"half")
    folder = MetricsFolder(spark, path, {"scorer": "a"})
    assert folder.fill(["x", "y", "none", "z"], rows_of, out) == ["y", "none", "z"]
    assert asked == ["x", "y", "y", "none", "z"] and folder.fill(["x", "z"], rows_of) == []
    got = {r.country: r for r in catalog.metrics(spark, out).collect()}
    want = {r.country: r for r in scorers.evaluated(samples, make).collect()}
    assert set(got) == {"x", "y", "z"} and all(got[c].pq == pytest.approx(want[c].pq, abs=1e-6) and got[c].n_patches == want[c].n_patches for c in got)
    with pytest.raises(ValueError, match="holds metrics of"):
        MetricsFolder(spark, path, {"scorer": "b"})


def test_files_that_a_layout_lacks(spark, tmp_path):
    from parcelspark.sources import catalog

    for name in ("a/1.tif", "b/1.tif", "a/2.tif", "splits/chips_x.parquet"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"some")
    (tmp_path / "a" / "empty.tif").write_bytes(b"")
    elsewhere = str(tmp_path / "b" / "1.tif")
    index = [("x", 1, "a/1.tif", "b/1.tif", elsewhere), ("x", 2, "a/2.tif", "b/2.tif", "a/empty.tif"), ("other", 3, "no", "no", "no")]
    index = spark.createDataFrame(index, "country string, patch_id long, image_a_path string, image_b_path string, label_path string")
    got = catalog.absent_of_layout(spark, str(tmp_path), index, ["x", "y"])
    assert "content" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("x", "2", "window_b", "b/2.tif"), ("x", "2", "label", "a/empty.tif"), ("y", None, "split", "splits/chips_y.parquet")], key=str
    )


def test_a_scorer_is_made_once_a_worker_and_sees_stacks(spark, samples, tmp_path):
    from parcelspark.operators import scorers

    def note(what, n):  # files, as a kept scorer outlives the task that counts
        (tmp_path / f"{what}-{n}-{uuid.uuid4().hex}").touch()

    def make(weights):
        note("made", os.getpid())

        def scorer(x):
            assert x.ndim == 4 and len(x) <= scorers.STACK
            note("stack", len(x))
            return np.stack([np.full(x[:, 0].shape, weights["threshold"]), x[:, 0]], 1)

        scorer.batched = True
        return scorer

    many = samples.repartition(12)
    factory = scorers.with_weights(spark, make, {"threshold": 0.5})
    got = {r.patch_id: r.pred for r in scorers.classified(many, factory, symmetries=False).collect()}
    made, stacks = ([int(f.name.split("-")[1]) for f in tmp_path.glob(f"{what}-*")] for what in ("made", "stack"))
    assert sum(stacks) == 30 > len(stacks)
    # Another frame, the same factory: a worker that has made the scorer keeps it.
    assert {r.patch_id: r.pred for r in scorers.classified(many.repartition(9), factory, symmetries=True).collect()} == got
    made = [int(f.name.split("-")[1]) for f in tmp_path.glob("made-*")]
    assert len(made) == len(set(made)) <= 8  # 21 tasks, no worker made it twice
    assert got == {r.patch_id: r.pred for r in scorers.classified(many, scorers.threshold_scorer(0.5), symmetries=False).collect()}


def trained():
    return os.environ["TRAINED_WEIGHTS"]


def test_reproduce_trains_evaluates_and_reports(spark, samples, tmp_path, monkeypatch, capsys):
    from parcelspark import cli, regions
    from parcelspark.operators import scorers

    names = list(regions.SPLITS["dense10"])[:3]
    (tmp_path / "weights").write_text("0.5")
    monkeypatch.setenv("TRAINED_WEIGHTS", str(tmp_path / "weights"))
    samples.replace(dict(zip("xyz", names, strict=True)), subset="country").write.parquet(str(tmp_path / "data" / "samples_3m"))
    options = ["--data", str(tmp_path / "data"), "--min-pad", "32", "--no-tta", "--no-watershed"]
    plain = scorers.evaluated(samples, scorers.threshold_scorer(0.5), symmetries=False, watershed=False, least=32).agg(F.avg("pq")).first()[0]
    argv = ["reproduce", "--train", "test_raster_files:trained", "--scorer", "parcelspark.operators.scorers:bright_by_weights", "--out", str(tmp_path / "one"), *options]
    assert cli.main(argv) == 0
    shown = capsys.readouterr().out
    assert "macro average over 3/10" in shown and "published" in shown and f"{plain:.4f}" in shown
