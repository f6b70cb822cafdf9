"""Operators on fields: hand-checked rasters, properties, and every query against its SQL."""

import math
import struct
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from parcelspark import cli, regions, report
from parcelspark.functions import rasters as R
from parcelspark.operators import kernels, metrics, records, scoring
from parcelspark.plans import oracles
from parcelspark.plans import queries as fields
from parcelspark.sources import catalog
from parcelspark.sources.tiff import decoded, samples

DATA = "/root/testdata/sf0.001"


def patch(spark, gt, pred, country="x"):
    gt, pred = np.asarray(gt), np.asarray(pred)
    row = (country, "1", *gt.shape, gt.ravel().tolist(), pred.ravel().tolist())
    return spark.createDataFrame([row], "country string, patch_id string, h int, w int, gt array<int>, pred array<int>")


@pytest.fixture
def partial(spark):
    """Two fields, each matched in part."""
    gt, pred = np.zeros((6, 6), int), np.zeros((6, 6), int)
    gt[:3, :3] = gt[3:, 4:] = 1
    pred[:3, :2] = pred[3:, 3:] = 1
    return patch(spark, gt, pred)


def test_partial_matches(partial):
    scored = scoring.objects(partial, chamfer=True)
    row = metrics.panoptic(scored).first()
    two_thirds = float(np.float32(6 / 9))
    assert (row.n_patches, row.tp, row.fp, row.fn, row.rq) == (1, 2, 0, 0, 1)
    assert row.sq == pytest.approx(two_thirds) and row.pq == pytest.approx(two_thirds)
    grid = {r.threshold: (r.tp, r.fp, r.fn) for r in metrics.match_grid(scored).collect()}
    assert all(grid[t] == ((2, 0, 0) if t <= 65 else (0, 2, 2)) for t in grid) and len(grid) == 10
    assert metrics.f1_grid(scored).first().ap_5_95 == pytest.approx(0.4)
    pixels = metrics.pixel_confusion(partial, ["country"]).first()
    assert (pixels.tp, pixels.fp, pixels.fn) == (12, 3, 3) and pixels.iou == pytest.approx(12 / 18)
    delta = metrics.count_delta(scored).first()
    assert (delta.polygon_count_delta_mean, delta.polygon_count_delta_median) == (0, 0)
    error = metrics.boundary_error(scored).first()
    assert error.boundary_error_m_mean == pytest.approx(1.65) and error.boundary_error_m_p95 == pytest.approx(1.65)


def test_boundary_pixels():
    gt = np.zeros((6, 6), bool)
    gt[:3, :3] = True
    assert {tuple(p) for p in np.argwhere(kernels.edge_pixels(gt))} == {(0, 2), (1, 2), (2, 0), (2, 1), (2, 2)}
    assert not kernels.edge_pixels(np.ones((3, 3), bool)).any()


def test_half_is_no_match(spark):
    gt, pred = np.zeros((4, 4), int), np.zeros((4, 4), int)
    gt[:2, :2] = pred[:2, :1] = 1
    row = metrics.match_counts(scoring.objects(patch(spark, gt, pred))).first()
    assert (row.tp, row.fp, row.fn) == (0, 1, 1)
    with pytest.raises(ValueError):
        scoring.matched(F.col("pairs"), 0.4)


def test_empty_patch_counts(spark):
    none = np.zeros((4, 4), int)
    scored = scoring.objects(patch(spark, none, none), chamfer=True)
    row = metrics.panoptic(scored).first()
    assert (row.n_patches, row.tp, row.sq, row.rq, row.pq) == (1, 0, 0, 0, 0)
    assert metrics.boundary_error(scored).first().boundary_error_m_mean is None
    assert metrics.count_delta(scored).first().polygon_count_delta_mean == 0


def test_matching_in_order_below_one_half(spark):
    gt, pred = np.zeros((2, 6), int), np.zeros((2, 6), int)
    gt[0, :4] = gt[1, 5] = 1
    pred[0, 0] = pred[0, 2:4] = 1
    scored = scoring.objects(patch(spark, gt, pred))
    pairs = scored.select(scoring.matched_in_order(F.col("pairs"), 0.2).alias("m")).first().m
    assert [(p.gt, p.pred) for p in pairs] == [(0, 0)]


def test_country_metrics_and_switches(spark, partial):
    row = metrics.country_metrics(partial).first()
    # Whole components are kept here, so that both modes agree, and F1 of objects equals RQ.
    assert row.object_ws_f1 == row.pq_rq == row.object_pix_f1
    assert metrics.country_metrics(partial, watershed=False).first().object_ws_f1 is None


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 2**32 - 1))
def test_kernel_properties(h, w, seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((h, w)) < 0.6
    four, eight = kernels.components(mask), kernels.components(mask, eight=True)
    assert (four[mask] >= eight[mask]).all() and (four[~mask] == -1).all()
    for c in np.unique(four[mask]):
        assert four.ravel()[c] == c
    outside = np.argwhere(~mask)
    d = kernels.distance(mask)
    for y, x in np.ndindex(h, w):
        want = min((math.dist((y, x), o) for o in outside.tolist()), default=math.inf)
        assert d[y, x] == pytest.approx(want)
    classes = rng.integers(0, 3, (h, w))
    depth = kernels.distance(classes != 2)
    kept = kernels.watershed_mask(classes, depth)
    if not np.isinf(depth).any():
        assert ((kernels.watershed_instances(classes, depth) > 0) == kept).all()
    assert set(np.unique(kernels.components(kept))) <= set(np.unique(kernels.components(classes == 1)))
    grown = kernels.dilated(rng.integers(0, 4, (h, w)), 0)
    assert grown.shape == (h, w)


def test_diagonal_touch():
    mask = np.eye(2, dtype=bool)
    assert len(np.unique(kernels.components(mask)[mask])) == 2
    assert len(np.unique(kernels.components(mask, eight=True)[mask])) == 1


def test_dilation_keeps_ignored():
    mask = np.zeros((3, 3), int)
    mask[1, 1], mask[0, 0] = 2, 3
    assert kernels.dilated(mask, 1).tolist() == [[3, 2, 2], [2, 2, 2], [2, 2, 2]]


def test_turns_are_undone(spark):
    df = spark.createDataFrame([(list(range(16)),)], "v array<int>")
    by_name = {n: f for n, _, f in R.D4}
    size = F.lit(4)
    columns = [R.turned(R.turned(F.col("v"), size, f), size, by_name[inverse]).alias(n) for n, inverse, f in R.D4]
    row = df.select(*columns).first()
    assert all(list(v) == list(range(16)) for v in row)
    turned = df.select(*(R.turned(F.col("v"), size, f).alias(n) for n, _, f in R.D4)).first()
    assert len({tuple(v) for v in turned}) == 8
    grid = np.arange(16).reshape(4, 4)
    assert turned.turn_90 == np.rot90(grid).ravel().tolist() and turned.flip_x == grid[:, ::-1].ravel().tolist()


def test_padding_and_cropping(spark):
    df = spark.createDataFrame([(33, 40), (32, 64)], "h int, w int")
    size = lambda least: df.select(R.padded_size(F.col("h"), least), R.padded_size(F.col("w"), least)).collect()
    assert [tuple(r) for r in size(0)] == [(64, 64), (32, 64)]
    assert tuple(size(512)[0]) == (512, 512)
    v = spark.createDataFrame([([1, 2, 3, 4, 5, 6],)], "v array<int>")
    h, w = F.lit(2), F.lit(3)
    padded = R.padded(F.col("v"), h, w, F.lit(3), F.lit(4), 9)
    assert v.select(padded).first()[0] == [1, 2, 3, 9, 4, 5, 6, 9, 9, 9, 9, 9]
    back = R.window(padded, F.lit(3), F.lit(4), F.lit(0), F.lit(0), h, w, None)
    assert v.select(back).first()[0] == [1, 2, 3, 4, 5, 6]


def test_softmax_and_argmax(spark):
    df = spark.createDataFrame([([0.0, 5.0, 5.0, -1000.0],)], "v array<double>")
    p, top = df.select(R.softmax(F.col("v")), R.argmax(F.col("v"))).first()
    assert sum(p) == pytest.approx(1) and top == 1 and p[1] == p[2]


def test_uniform_draws_do_not_depend_on_partitions(spark):
    df = spark.range(100)
    one = df.coalesce(1).select("id", R.uniform(0.5, 1.5, F.lit(7), "id").alias("u")).collect()
    many = df.repartition(8).select("id", R.uniform(0.5, 1.5, F.lit(7), "id").alias("u")).collect()
    assert sorted(one) == sorted(many) and all(0.5 <= r.u < 1.5 for r in one)


def test_country_sets():
    assert "kenya" in regions.HELD_OUT and "kenya" not in regions.SPLITS["dense10"]
    assert len(regions.SPLITS["dense10"]) == 10 and len(regions.FULL) == 23 and len(regions.HELD_OUT) == 11


def test_macro_average(spark):
    rows = [("belgium", 0.7, 0.6), ("germany", 0.8, 0.4), ("kenya", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "country string, pixel_level_iou double, object_ws_f1 double")
    row = metrics.macro_average(df, regions.SPLITS["dense10"], ["pixel_level_iou", "object_ws_f1", "pq"]).first()
    assert (row.n_countries, row.n_expected) == (2, 10)
    assert row.pixel_level_iou == pytest.approx(0.75) and row.object_ws_f1 == pytest.approx(0.5)
    nan = spark.createDataFrame([("a", 0.5), ("a", float("nan")), ("a", None)], "country string, pq double")
    row = metrics.macro_average(nan, ["a"], ["pq"]).first()
    assert row.pq == 0.5 and row.n_countries == 3


def test_metrics_file_there_and_back(spark, tmp_path):
    from parcelspark.schemas import METRICS

    values = [0.1234565, float("nan"), None] + [0.5] * (len(METRICS) - 3)
    schema = "checkpoint string, country string, n_patches bigint, " + ", ".join(f"{m} double" for m in METRICS)
    df = spark.createDataFrame([("c", "x", 3, *values)], schema)
    catalog.write_metrics(df, str(tmp_path / "m"))
    text = next((tmp_path / "m").glob("*.csv")).read_text()
    assert "0.123456,nan,," in text
    back = catalog.metrics(spark, str(tmp_path / "m")).first()
    assert back.n_patches == 3 and math.isnan(back[METRICS[1]]) and back[METRICS[2]] is None
    assert catalog.by_country(df.withColumnRenamed("country", "countries")).columns == df.columns == catalog.by_country(df).columns
    with pytest.raises(KeyError):
        catalog.by_country(df.select("n_patches"))


def test_layout(spark, tmp_path):
    (tmp_path / "belgium").mkdir()
    missing = catalog.missing_countries(spark, ["belgium", "germany"], str(tmp_path))
    assert [r.country for r in missing.collect()] == ["germany"]
    assert catalog.missing_countries(spark, ["belgium"], str(tmp_path / "none")).count() == 1


def test_countries_with_usable_patches_are_not_missing(spark, tmp_path):
    tables = {
        "nation": ([(0, "A"), (1, "B"), (2, "C")], "n_nationkey int, n_name string"),
        "customer": ([(1, 0), (2, 1)], "c_custkey long, c_nationkey int"),
        "orders": ([(1, 1, "O"), (97, 2, "P")], "o_orderkey long, o_custkey long, o_orderstatus string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert sorted(r.country for r in fields.missing_countries(spark, str(tmp_path)).collect()) == ["b", "c", "nowhere"]


def test_records(spark):
    patches = spark.createDataFrame(
        [("a", 1, True, "x", "y", "/l"), ("a", 2, None, "x", "y", "l"), ("A", 3, True, "x", "y", "l")],
        "country string, patch_id int, usable_pair boolean, image_a_path string, image_b_path string, label_path string",
    )
    chips = spark.createDataFrame([("a", "1", "val"), ("a", "2", "val"), ("A", "3", "val")], "country string, aoi_id string, split string")
    got = records.split_records(patches, chips, "A", "val")
    assert [r.patch_id for r in got.collect()] == ["1"]
    assert records.split_records(patches, chips, "a", "val", usable_only=False).count() == 2
    assert records.split_union(patches, chips, ["a", "a"], "val").count() == 2
    row = records.record_paths(got, "/root/").first()
    assert (row.window_a, row.label) == ("/root/x", "/l")
    with pytest.raises(ValueError):
        records.split_records(patches, chips, "a", "all")
    with pytest.raises(ValueError):
        records.split_records(patches, chips, "a", "train")
    assert records.split_records(patches, chips, "a", "train", may_be_empty=True).count() == 0
    every = records.split_records(patches, chips, "a", "val", usable_only=False)
    assert [records.nth(every, i).first().patch_id for i in (0, 1)] == ["1", "2"]
    for place in (2, -1):
        with pytest.raises(IndexError):
            records.nth(every, place)


def test_split_tables_of_mixed_types(spark, tmp_path):
    spark.createDataFrame([(1, "val")], "aoi_id int, split string").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([("b1", "test")], "aoi_id string, split string").write.parquet(str(tmp_path / "b"))
    rows = catalog.split_table(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")}).collect()
    assert sorted((r.country, r.aoi_id) for r in rows) == [("a", "1"), ("b", "b1")]


def test_report(spark):
    means = spark.createDataFrame([(0.3, 0.25)], "pq double, pq_sq double")
    rows = report.summary(means, "dense10").collect()
    assert [r.label for r in rows] == ["PQ", "SQ"] and rows[0].published == 0.355
    assert report.summary(means, "full23").first().published is None
    assert report.lines(rows) == ["metric |   ours | published", "PQ     | 0.3000 |     0.355", "SQ     | 0.2500 |         -"]


def test_command_line(capsys):
    with pytest.raises(SystemExit):
        cli.parser().parse_args([])
    args = cli.parser().parse_args(["score", "--rasters", "r"])
    assert args.split == "dense10" and args.watershed


def test_metrics_from_one_pass_equal_those_from_each(spark):
    rng = np.random.default_rng(2)
    rows = [
        (str(i % 3), str(i), 9, 9, rng.integers(0, 2, 81).tolist(), np.where(rng.random(81) < 0.8, 1, rng.integers(0, 3, 81)).tolist())
        for i in range(40)
    ] + [("none", "99", 2, 2, [0] * 4, [0] * 4)]
    df = spark.createDataFrame(rows, "country string, patch_id string, h int, w int, gt array<int>, pred array<int>")
    rasters = df.withColumn("gt", F.when(F.col("patch_id").cast("int") % 2 == 0, F.col("pred")).otherwise(F.col("gt")))
    for flood in (True, False):
        got = {r.country: r for r in metrics.country_metrics(rasters, flood, 3.0, "c").collect()}
        scored = scoring.objects(rasters, watershed=flood, chamfer=True)
        for r in metrics.panoptic(scored).collect():
            one = got[r.country]
            assert (one.n_patches, one.pq_sq, one.pq_rq, one.pq) == pytest.approx((r.n_patches, r.sq, r.rq, r.pq))
        for r in metrics.f1_grid(scored).collect():
            assert got[r.country].ap_5_95 == pytest.approx(r.ap_5_95)
        for part in (metrics.count_delta(scored), metrics.boundary_error(scored)):
            for r in part.collect():
                want = [math.nan if v is None else v for k, v in r.asDict().items() if k != "country"]
                assert [got[r.country][k] for k in part.columns[1:]] == pytest.approx(want, nan_ok=True)
        for r in metrics.with_ratios(metrics.match_counts(scoring.objects(rasters))).collect():
            assert got[r.country].object_pix_f1 == pytest.approx(r.f1)
        assert math.isnan(got["none"].boundary_error_m_mean) and (got["0"].object_ws_f1 is None) == (not flood)


def voronoi(n=512, fields=500):
    """A patch of fields with boundaries between them."""
    rng = np.random.default_rng(0)
    y, x = np.mgrid[:n, :n]
    best, own = np.full((n, n), 1 << 30), np.zeros((n, n), int)
    for i, (a, b) in enumerate(rng.integers(0, n, (fields, 2))):
        d = (y - a) ** 2 + (x - b) ** 2
        own, best = np.where(d < best, i, own), np.minimum(d, best)
    edge = np.zeros((n, n), bool)
    edge[:-1] |= own[1:] != own[:-1]
    edge[:, :-1] |= own[:, 1:] != own[:, :-1]
    return np.where(edge, 2, 1)


def test_large_patches_take_seconds_and_little_memory(spark):
    import time
    import tracemalloc

    gt = voronoi()
    pred = np.roll(gt, 1, 0)
    start = time.monotonic()
    tracemalloc.start()
    labels = [kernels.components(x == 1) for x in (gt, pred)]
    edges = [kernels.points_of(x, kernels.edges_of(x)) for x in labels]
    depth = kernels.distance(pred != 2)
    assert kernels.watershed_mask(pred, depth).any() and len(edges[0]) > 450
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    row = metrics.country_metrics(patch(spark, gt, pred)).first()
    # The other patch is a row further down: so are most boundary pixels.
    assert row.pq > 0.7 and 1 < row.boundary_error_m_mean < 3
    assert time.monotonic() - start < 60


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32 - 1))
def test_edges_and_distances_of_all_fields_at_once(h, w, seed):
    rng = np.random.default_rng(seed)
    label = kernels.components(rng.random((h, w)) < 0.6)
    want = np.zeros((h, w), bool)
    for c in np.unique(label[label >= 0]):
        want |= kernels.edge_pixels(label == c)
    assert (kernels.edges_of(label) == want).all()
    points = kernels.points_of(label, want)
    assert sum(len(p) for p in points.values()) == want.sum() and all((label[tuple(p.T)] == c).all() for c, p in points.items())
    for a in points.values():
        for b in points.values():
            assert kernels.mean_nearest(a, b) == pytest.approx(np.mean([min(math.dist(p, q) for q in b) for p in a]))


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 9), st.integers(2, 9), st.integers(0, 2**32 - 1))
def test_watershed_instances_by_plain_flood(h, w, seed):
    """Seeds flood the fields: of all pixels at the front the deepest goes first, of equal ones the one that came first."""
    rng = np.random.default_rng(seed)
    classes = np.where(rng.random((h, w)) < 0.85, 1, 2)
    depth = kernels.distance(classes != 2)
    seeds = kernels.markers(classes, depth)
    number, owner = {}, {}
    step = lambda y, x, eight: [
        (y + v, x + u) for v in (-1, 0, 1) for u in (-1, 0, 1) if (v or u) and (eight or not (v and u)) and 0 <= y + v < h and 0 <= x + u < w
    ]
    whole = np.array_equal(seeds, classes == 1)
    for p in map(tuple, np.argwhere(seeds).tolist()):
        if p not in number:
            number[p], todo = len(set(number.values())) + 1, [p]
            while todo:
                for q in step(*todo.pop(), not whole):
                    if seeds[q] and q not in number:
                        number[q] = number[p]
                        todo.append(q)
    owner = dict(number)
    front = [(tuple(p), i) for i, p in enumerate(map(tuple, np.argwhere(seeds).tolist()))]
    age = len(front)
    while front:
        best = min(front, key=lambda f: (-depth[f[0]], f[1]))
        front.remove(best)
        (y, x), _ = best
        for q in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= q[0] < h and 0 <= q[1] < w and classes[q] == 1 and q not in owner:
                owner[q] = owner[best[0]]
                front.append((q, age))
                age += 1
    want = np.zeros((h, w), int)
    for p, v in owner.items():
        want[p] = v
    assert (kernels.watershed_instances(classes, depth) == want).all()


def tiff(array, order="<", packing=1, predictor=1, apart=False, tile=None, strip=3) -> bytes:
    """A plain TIFF writer for the tests."""
    bands, h, w = array.shape
    planes = [array[i : i + 1] for i in range(bands)] if apart else [array]
    blocks = []
    for p in planes:
        th, tw = tile or (min(strip, h), w)
        for y in range(0, h, th):
            for x in range(0, w, tw):
                part = p[:, y : y + th, x : x + tw]
                if tile:
                    part = np.pad(part, ((0, 0), (0, th - part.shape[1]), (0, tw - part.shape[2])))
                part = part.transpose(1, 2, 0)
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                raw = part.astype(part.dtype.newbyteorder(order)).tobytes()
                blocks.append(zlib.compress(raw) if packing == 8 else lzw(raw) if packing == 5 else raw)
    kind = {"u": 1, "i": 2, "f": 3}[array.dtype.kind]
    at, places, body = 8, [], b""
    for b in blocks:
        places.append(at + len(body))
        body += b
    fields = {256: w, 257: h, 258: [array.dtype.itemsize * 8] * bands, 259: packing, 277: bands, 284: 2 if apart else 1, 317: predictor, 339: [kind] * bands}
    fields |= {322: tile[1], 323: tile[0], 324: places, 325: [len(b) for b in blocks]} if tile else {273: places, 278: min(strip, h), 279: [len(b) for b in blocks]}
    entries, extra = b"", b""
    begin = 8 + len(body)
    after = begin + 2 + 12 * len(fields) + 4
    for tag in sorted(fields):
        v = fields[tag] if isinstance(fields[tag], list) else [fields[tag]]
        raw = struct.pack(f"{order}{len(v)}I", *v)
        if len(raw) > 4:
            raw, extra = struct.pack(order + "I", after + len(extra)), extra + raw
        entries += struct.pack(order + "HHI", tag, 4, len(v)) + raw
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, begin)
    return head + body + struct.pack(order + "H", len(fields)) + entries + bytes(4) + extra


def lzw(data: bytes) -> bytes:
    bits, out, table, word = "", [], {bytes([i]): i for i in range(256)}, b""
    put = lambda code, n: out.append(format(code, f"0{n}b"))
    width, free = 9, 258
    put(256, 9)
    for b in data:
        more = word + bytes([b])
        if more in table:
            word = more
            continue
        put(table[word], width)
        table[more] = free
        free += 1
        width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
        if free >= 4094:
            put(256, width)
            table, free, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = bytes([b])
    if word:
        put(table[word], width)
        free += 1
        width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
    put(257, width)
    bits = "".join(out)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


@settings(max_examples=60, deadline=None)
@given(
    st.integers(1, 4), st.integers(1, 40), st.integers(1, 40), st.sampled_from(["u1", "u2", "i2", "f4", "u4"]), st.sampled_from("<>"),
    st.sampled_from([1, 5, 8]), st.booleans(), st.booleans(), st.booleans(), st.integers(0, 2**32 - 1),
)
def test_tiff_there_and_back(bands, h, w, kind, order, packing, differences, apart, tiled, seed):
    array = np.random.default_rng(seed).integers(0, 250, (bands, h, w)).astype(kind)
    differences = 2 if differences and kind != "f4" else 1
    data = tiff(array, order, packing, differences, apart, (16, 16) if tiled else None)
    got = decoded(data)
    assert got.dtype == array.dtype and (got == array).all()


def test_odd_tiffs_are_refused():
    with pytest.raises(ValueError):
        decoded(b"PNG" * 10)
    with pytest.raises(ValueError):
        decoded(tiff(np.zeros((1, 2, 2), "u1"), packing=7))


def test_from_files_to_metrics(spark, tmp_path, monkeypatch, capsys):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(4):
        truth = np.zeros((20, 24), "u1")
        truth[2:9, 3:11] = truth[12:18, 5:20] = 1
        image = np.where(np.roll(truth, i % 2, 1), 9000, 100).astype("u2")[None].repeat(4, 0)
        for role, x in (("window_a", rng.integers(0, 9, (4, 21, 24)).astype("u2")), ("window_b", image), ("label", truth[None])):
            (tmp_path / "files" / role).mkdir(parents=True, exist_ok=True)
            (tmp_path / "files" / role / f"{i}.tif").write_bytes(tiff(x, packing=8))
        rows.append(("belgium", str(i), *(f"{tmp_path}/files/{r}/{i}.tif" for r in ("window_a", "window_b", "label"))))
    rows.append(("belgium", "9", "/none.tif", "/none.tif", "/none.tif"))
    paths = spark.createDataFrame(rows, "country string, patch_id string, window_a string, window_b string, label string")
    got = samples(spark, paths, str(tmp_path / "files"))
    first = got.where("patch_id = '0'").first()
    assert got.count() == 4 and (first.h, first.w, first.bands) == (20, 24, 8) and sum(first.gt) == 7 * 8 + 6 * 15
    assert set(first.image[: 20 * 24 * 4]) == {100.0, 9000.0} and max(first.image[20 * 24 * 4 :]) < 9
    got.write.parquet(str(tmp_path / "samples_3m"))
    monkeypatch.setattr(cli.SparkSession.builder.__class__, "getOrCreate", lambda self: spark)
    run = lambda *args: cli.main([*args])
    common = ("--data", str(tmp_path), "--scorer", "parcelspark.operators.scorers:bright", "--min-pad", "32")
    assert run("eval", *common, "--out", str(tmp_path / "m1")) == 0
    assert "1/10 dense10" in capsys.readouterr().out
    assert run("eval", *common, "--no-tta", "--no-watershed", "--out", str(tmp_path / "m2")) == 0
    one, two = (catalog.metrics(spark, str(tmp_path / m)).first() for m in ("m1", "m2"))
    assert one.pixel_level_iou == two.pixel_level_iou == pytest.approx((2 * 146 + 2 * 133) / (2 * 146 + 2 * 159), abs=1e-6)
    assert one.pq_rq == two.pq_rq == 1 and two.object_ws_f1 is None and one.n_patches == 4
    with pytest.raises(ValueError):
        catalog.samples(spark, str(tmp_path), "30m")
    spark.createDataFrame([("belgium", "0", 4, 4, [1] * 16, [1] * 16)], "country string, patch_id string, h int, w int, gt array<int>, pred array<int>").write.parquet(str(tmp_path / "r"))
    assert run("score", "--rasters", str(tmp_path / "r"), "--out", str(tmp_path / "m3")) == 0 and "PQ" in capsys.readouterr().out
    assert run("report", "--metrics", str(tmp_path / "m3")) == 0 and "0.355" in capsys.readouterr().out
    (tmp_path / "belgium").mkdir()
    assert run("check-data", "--root", str(tmp_path)) == 1 and "germany" in capsys.readouterr().out


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(fields.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = fields.QUERIES[name](spark, DATA)
    if name not in oracles.SQL:
        assert df.count() > 0
        return
    found = duck.execute(oracles.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(found.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_few_patches_are_held_before_they_leave():
    """A task's rows leave after BATCH_PATCHES patches, however few rows these have, and all of them leave."""

    class Frame:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    n, read = 3 * scoring.BATCH_PATCHES + 7, []

    def batches():
        for k in range(n):
            read.append(k)
            columns = {"country": ["x"], "patch_id": [str(k)], "h": [1], "w": [2], "gt": [[1, 0]], "pred": [[1, 1]]}
            yield pa.RecordBatch.from_pydict(columns)

    held, ids = 0, []
    for batch in scoring.objects(Frame())(batches()):
        held = max(held, len(read) - len(ids))
        ids += batch.column("patch_id").to_pylist()
    assert held <= scoring.BATCH_PATCHES
    assert ids == [str(k) for k in range(n)]
