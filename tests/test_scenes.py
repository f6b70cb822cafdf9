"""Outlines, distances and reconstruction against plain re-statements; scenes of tiles; percentiles; one scoring pass."""

import struct
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelspark.operators import graphs, kernels, metrics, scorers, scoring, selection


def plain_distance(mask):
    y, x = np.nonzero(~mask)
    if not len(y):
        return np.full(mask.shape, np.inf)
    at = np.indices(mask.shape)
    return np.sqrt(((at[0][..., None] - y) ** 2 + (at[1][..., None] - x) ** 2).min(-1))


def test_distance_is_that_to_the_nearest_pixel():
    rng = np.random.default_rng(0)
    for _ in range(80):
        h, w = rng.integers(1, 20, 2)
        mask = rng.random((h, w)) < rng.choice([0.0, 0.3, 0.9, 0.99, 1.0])
        assert np.array_equal(kernels.distance(mask), plain_distance(mask))


def test_distance_of_a_far_pixel_takes_linear_time():
    mask = np.ones((2048, 2048), bool)
    mask[2047, 0] = False
    d = kernels.distance(mask)
    assert d[0, 2047] == pytest.approx(np.hypot(2047, 2047)) and d[2047, 0] == 0
    mask[:, 1000] = False
    mask[17] = False
    assert kernels.distance(mask)[1000, 1500] == 500


def dilated_to_the_end(marker, surface):
    while True:
        new = np.minimum(kernels._around(marker, -np.inf, np.maximum), surface)
        if np.array_equal(new, marker):
            return marker
        marker = new


def test_reconstruction_is_dilation_to_the_end():
    rng = np.random.default_rng(2)
    for k in range(40):
        surface = rng.integers(0, 9, rng.integers(1, 25, 2)).astype(float) if k % 2 else rng.normal(0, 3, rng.integers(1, 25, 2))
        assert np.array_equal(kernels.reconstructed(surface - 2, surface), dilated_to_the_end(surface - 2, surface))


def test_reconstruction_follows_a_long_way():
    """A ridge that winds through the whole image: every pixel rises once, not the image once a pixel."""
    surface = np.zeros((400, 400))
    surface[::4] = 5
    for k, row in enumerate(range(2, 400, 4)):
        surface[row - 1 : row + 2, -1 if k % 2 == 0 else 0] = 5
    marker = np.full_like(surface, -1.0)
    marker[0, 0] = 5
    out = kernels.reconstructed(marker, surface)
    assert out[396, 200] == 5 and out[surface == 0].max() == 0


def read_wkb(data):
    """The rings of a polygon's well-known binary."""
    order, kind, n = struct.unpack_from("<BII", data)
    assert (order, kind) == (1, 3)
    at, out = 9, []
    for _ in range(n):
        (size,) = struct.unpack_from("<I", data, at)
        points = np.frombuffer(data, "<f8", 2 * size, at + 4).reshape(-1, 2)
        assert (points[0] == points[-1]).all() and size > 4
        assert ((points[1:] != points[:-1]).sum(1) == 1).all()  # every step is along one axis, and turns
        at += 4 + 16 * size
        out.append(points[:-1])
    assert at == len(data)
    return out


def inside(rings, y, x):
    """Whether the pixel's centre is in the polygon: rings to its right are crossed an odd number of times."""
    crossed = 0
    for p in rings:
        a, b = p, np.roll(p, -1, 0)
        crossed += ((a[:, 0] == b[:, 0]) & (a[:, 0] > x + 0.5) & ((a[:, 1] > y + 0.5) != (b[:, 1] > y + 0.5))).sum()
    return crossed % 2 == 1


def area(ring):
    x, y = ring.T
    return (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2


@pytest.mark.parametrize("share", [0.3, 0.5, 0.6, 0.8, 1.0])
def test_outlines_hold_the_pixels_of_their_component(share):
    rng = np.random.default_rng(int(share * 10))
    for _ in range(6):
        mask = rng.random(rng.integers(1, 14, 2)) < share
        label = kernels.components(mask)
        found = kernels.polygons(label)
        assert sorted(found["comp_id"].tolist()) == np.unique(label[label >= 0]).tolist()
        for k, comp in enumerate(found["comp_id"]):
            rings = read_wkb(found["wkb"][k])
            own = label == comp
            assert found["area"][k] == own.sum() == sum(map(area, rings))
            assert area(rings[0]) > 0 and all(area(r) < 0 for r in rings[1:])
            assert found["n_holes"][k] == len(rings) - 1 and found["n_points"][k] == sum(map(len, rings))
            assert all(inside(rings, y, x) == own[y, x] for y in range(own.shape[0]) for x in range(own.shape[1]))


def test_outlines_of_rings_islands_and_corners():
    mask = np.zeros((9, 9), bool)
    mask[1:8, 1:8] = True
    mask[2:7, 2:7] = False
    mask[4, 4] = True  # an island in the hole
    mask[0, 0] = True  # touches a corner
    found = kernels.polygons(kernels.components(mask))
    assert found["comp_id"].tolist() == [0, 10, 40] and found["area"].tolist() == [1, 24, 1] and found["n_holes"].tolist() == [0, 1, 0]
    pinched = np.array([[1, 1, 1], [1, 0, 1], [1, 1, 0]], bool)  # the hole meets the outside at a corner
    found = kernels.polygons(kernels.components(pinched))
    assert found["area"].tolist() == [7] and found["n_holes"].tolist() == [1] and found["n_points"].tolist() == [10]
    assert kernels.polygons(np.full((3, 3), -1))["wkb"] == []


def test_seeds_that_touch_at_a_corner_are_two():
    classes = np.ones((2, 2), int)
    depth = np.array([[3.0, 0.0], [0.0, 3.0]])
    assert kernels.watershed_instances(classes, depth).max() == 2


@pytest.mark.parametrize("few", [1, 100, 4096])
def test_percentiles_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    rng = np.random.default_rng(5)
    groups = {
        "normal": rng.normal(size=5001), "ties": rng.integers(0, 3, 4000).astype(float), "one": np.array([7.0]), "two": np.array([1.0, 2.0]),
        "wide": np.concatenate([rng.normal(size=500) * 1e-12, rng.normal(size=500) * 1e12, [1.7e308, -1.7e308]]), "same": np.full(50, 0.1),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("normal", None), ("normal", float("nan")), ("none", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(7)
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: r.percentile for r in selection.percentiles(df.withColumn("share", F.lit(share)), ["g"]).collect()}
        assert set(got) <= set(groups) | {None}
        for g, values in groups.items():
            assert got[g] == pytest.approx(np.percentile(values, 100 * share), rel=1e-12), (g, share)


def test_percentiles_plan_gathers_no_values(spark):
    rasters = spark.createDataFrame([("a", "p", 2, 2, [1, 1, 0, 0], [1, 1, 0, 1])], "country string, patch_id string, h int, w int, gt array<int>, pred array<int>")
    scored = scoring.objects(rasters, chamfer=True)
    for df in (metrics.boundary_error(scored), metrics.count_delta(scored), metrics.country_metrics(rasters)):
        plan = df._jdf.queryExecution().toString().lower()
        assert "percentile(" not in plan and "median(" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("watershed", [True, False])
@pytest.mark.parametrize("symmetries", [True, False])
def test_every_image_is_scored_once(spark, watershed, symmetries, tmp_path):
    rng = np.random.default_rng(0)
    rows = [("x" if i % 2 else "y", f"p{i}", 8, 8, 1, rng.uniform(0, 10000, 64).tolist(), rng.integers(0, 2, 64).tolist()) for i in range(10)]
    samples = spark.createDataFrame(rows, "country string, patch_id string, h int, w int, bands int, image array<float>, gt array<int>").repartition(3)

    def make():
        plain = scorers.threshold_scorer(0.5)()

        def scorer(image):
            (tmp_path / uuid.uuid4().hex).touch()
            return plain(image)

        return scorer

    out = scorers.evaluated(samples, make, symmetries=symmetries, watershed=watershed, least=32)
    assert sorted(r.country for r in out.collect()) == ["x", "y"] and out.count() == 2
    assert len(list(tmp_path.iterdir())) == 10 * (8 if symmetries else 1)


# ---------------------------------------------------------------- scenes


def cut(scene, image, tile, null=False):
    h, w = image.shape
    return [
        (scene, ty, tx, *(part := image[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile]).shape, None if null and not part.any() else part.ravel().tolist())
        for ty in range(-(-h // tile))
        for tx in range(-(-w // tile))
    ]


TILES = "scene string, tile_y int, tile_x int, h int, w int, mask array<int>"


@pytest.mark.parametrize("share", [0.45, 0.6, 0.75])
def test_scenes_are_labelled_as_whole_images(spark, share):
    from parcelspark.operators import scenes

    rng = np.random.default_rng(int(100 * share))
    images = {f"s{k}": (rng.random((23 + 5 * k, 31)) < share).astype(int) for k in range(3)}
    images["spiral"] = np.zeros((31, 31), int)
    images["spiral"][::2] = 1
    for k, row in enumerate(range(1, 31, 2)):
        images["spiral"][row, -1 if k % 2 == 0 else 0] = 1
    rows = [r for name, image in images.items() for r in cut(name, image, 7, null=True)]
    df = spark.createDataFrame(rows, TILES).repartition(5)
    want = {name: kernels.components(image == 1) for name, image in images.items()}
    sizes = {(n, int(c)): int((label == c).sum()) for n, label in want.items() for c in np.unique(label) if c >= 0}
    assert {(r.scene, r.comp_id): r.area for r in scenes.components(df, 7, 31).collect()} == sizes
    for r in scenes.labels(df, 7, 31).collect():
        part = want[r.scene][r.tile_y * 7 : r.tile_y * 7 + r.h, r.tile_x * 7 : r.tile_x * 7 + r.w]
        assert r.label == part.ravel().tolist()


def test_scenes_with_gaps_and_wrong_tiles(spark):
    from parcelspark.operators import scenes

    full = [1] * 4
    df = spark.createDataFrame([("a", 0, 0, 2, 2, full), ("a", 0, 2, 2, 2, full), ("a", 1, 0, 2, 2, None), ("b", 0, 1, 2, 2, full)], TILES)
    assert sorted(tuple(r) for r in scenes.components(df, 2, 6).collect()) == [("a", 0, 4), ("a", 4, 4), ("b", 2, 4)]
    assert scenes.components(df.limit(0), 2, 6).collect() == []
    with pytest.raises(ValueError, match="more than once"):
        scenes.components(df.union(df), 2, 6)
    with pytest.raises(ValueError, match="width"):
        scenes.components(df, 2, 5)


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    """One table for links that are stars already, and one more for each round of others."""
    tables = []
    monkeypatch.setattr(graphs, "staged", lambda df, name, staged=graphs.staged: tables.append(name) or staged(df, name))
    links = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    got = graphs.connected_components(links([(1, k) for k in range(2, 20)] + [(k, 30) for k in range(31, 35)] + [(2, 1), (7, 7)])).collect()
    assert len(tables) == 1
    assert {r.node: r.component for r in got} == {k: 1 for k in range(1, 20)} | {k: 30 for k in range(30, 35)}
    assert len(got) == 24
    chain = graphs.connected_components(links([(k, k + 1) for k in range(40)])).collect()
    assert len(tables) > 2
    assert sorted((r.node, r.component) for r in chain) == [(k, 0) for k in range(41)]


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_links(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = rng.integers(0, 60, (45, 2)).tolist()
    label = list(range(60))
    for _ in range(60):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = graphs.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted({(x, label[x]) for a, b in pairs if a != b for x in (a, b)})
