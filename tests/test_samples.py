"""Scorers and random changes of samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelspark.operators import augment as A
from parcelspark.operators import metrics, records, scorers


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(0)
    rows = [
        ("x", f"p{i}", 12, 10, 8, rng.uniform(0, 10000, 960).astype(np.float32).tolist(), rng.integers(0, 4, 120).tolist()) for i in range(6)
    ]
    return spark.createDataFrame(rows, "country string, patch_id string, h int, w int, bands int, image array<float>, mask array<int>")


def test_symmetric_scorers_need_no_symmetries(samples):
    df = samples.withColumnRenamed("mask", "gt")
    make = scorers.threshold_scorer(0.5)
    one = {r.patch_id: r.pred for r in scorers.classified(df, make, symmetries=False).collect()}
    all_ = {r.patch_id: r.pred for r in scorers.classified(df, make, least=64).collect()}
    assert one == all_
    first = df.first()
    assert one[first.patch_id] == [int(v > 5000) for v in first.image[:120]]
    assert metrics.country_metrics(scorers.classified(df, make)).first().n_patches == 6
    with pytest.raises(ValueError):
        scorers.classified(df, make, source="30m")


def test_symmetries_average():
    rng = np.random.default_rng(1)
    image = rng.normal(size=(2, 6, 6))
    weight = rng.normal(size=(3, 2, 6, 6))
    scorer = lambda x: (weight * x[None]).sum(1)
    p = scorers.over_symmetries(scorer, image)
    assert np.allclose(p.sum(0), 1)
    assert np.allclose(scorers.over_symmetries(scorer, np.rot90(image, 1, (-2, -1))), np.rot90(p, 1, (-2, -1)))


def test_warps():
    image = np.arange(30.0).reshape(1, 5, 6)
    assert np.allclose(A.warped(image, np.eye(2, 3), (5, 6), nearest=False), image)
    square = np.arange(25.0).reshape(1, 5, 5)
    quarter = np.array([[0.0, -1.0, 4.0], [1.0, 0.0, 0.0]])
    for nearest in (True, False):
        turned = A.warped(square, quarter, (5, 5), nearest=nearest)
        assert np.allclose(turned[0], np.rot90(square[0], -1)) or np.allclose(turned[0], np.rot90(square[0]))
    part = A.warped(image, np.array([[1.0, 0, 1], [0, 1, 2]]), (3, 3), nearest=True)
    assert np.allclose(part[0], image[0, 1:4, 2:5])


def test_draws_do_not_depend_on_partitions(samples):
    plan = A.Plan(random_scale=True, small_rotate=0.5, shear=0.5, gamma=0.5, affine=0.5, blur=0.5, noise=0.5, drop_window=0.5, jitter=0.5)
    rows = lambda df, epoch: sorted(map(str, A.augmented(df, epoch, plan=plan).collect()))
    one, many = rows(samples.coalesce(1), 0), rows(samples.repartition(5), 0)
    assert one == many and one != rows(samples, 1)
    for r in A.augmented(samples, 0, plan=plan).collect():
        assert len(r.image) == 960 and len(r.mask) == 120 and set(r.mask) <= {0, 1, 2, 3} and np.isfinite(r.image).all()


def test_without_training_only_scaled(samples):
    out = A.augmented(samples, 0, training=False).select("patch_id", F.col("image").alias("scaled"), F.col("mask").alias("same"))
    for r in out.join(samples, "patch_id").collect():
        assert np.allclose(np.array(r.scaled) * 10000, r.image, rtol=1e-5) and r.same == r.mask


def table(spark, images, masks, names=None):
    """Samples of images (bands, h, w) and masks (h, w)."""
    rows = [(names[k] if names else str(k), *x.shape[1:], x.shape[0], x.ravel().tolist(), m.ravel().tolist()) for k, (x, m) in enumerate(zip(images, masks, strict=True))]
    return spark.createDataFrame(rows, "patch_id string, h int, w int, bands int, image array<double>, mask array<int>")


def changed(df, epoch=0, **options):
    out = A.augmented(df, epoch, **options).collect()
    return {r.patch_id: (np.array(r.image).reshape(r.bands, r.h, r.w), np.array(r.mask).reshape(r.h, r.w)) for r in out}


def test_one_window_is_dropped(spark):
    df = table(spark, [np.ones((8, 4, 4))] * 20, [np.zeros((4, 4), int)] * 20)
    plan = A.Plan(scale=1, rotate=0, flip=0, sharpen=0, resized_crop=0, drop_window=1)
    sums = {tuple(x.sum((1, 2))) for x, _ in changed(df, plan=plan).values()}
    assert sums == {(16.0,) * 4 + (0.0,) * 4, (0.0,) * 4 + (16.0,) * 4}


def test_crops_are_padded_and_seeded(spark):
    rows = [(f"p{i}", h, w, [float(v + 1) for v in range(2 * h * w)], [v % 3 for v in range(h * w)]) for i in range(40) for h, w in ((7, 3),)]
    df = spark.createDataFrame(rows, "patch_id string, h int, w int, image array<float>, mask array<int>")
    source = np.pad(np.arange(1.0, 43.0).reshape(2, 7, 3), ((0, 0), (0, 0), (0, 2)))
    labels = np.pad(np.arange(21).reshape(7, 3) % 3, ((0, 0), (0, 2)), constant_values=3)

    def tops(frame):
        out = {}
        for r in frame.collect():
            image, mask = np.array(r.image).reshape(2, 5, 5), np.array(r.mask).reshape(5, 5)
            (out[r.patch_id],) = [t for t in range(3) if np.array_equal(image, source[:, t : t + 5]) and np.array_equal(mask, labels[t : t + 5])]
            assert (r.h, r.w) == (5, 5)
        return out

    assert set(tops(A.cropped(df, 5, 2, 0, training=False)).values()) == {1}
    one = tops(A.cropped(df.coalesce(1), 5, 2, 0))
    assert one == tops(A.cropped(df.repartition(5), 5, 2, 0)) != tops(A.cropped(df, 5, 2, 1)) and set(one.values()) == {0, 1, 2}


def test_windows_are_swapped_by_seed(spark):
    df = spark.createDataFrame([(f"p{i}", [1.0], [2.0]) for i in range(60)], "patch_id string, image_a array<double>, image_b array<double>")
    images = lambda **options: {r.patch_id: tuple(r.image) for r in A.stacked(df, 1, **options).collect()}
    assert set(images(epoch=0).values()) == {(2.0, 1.0)}
    swapped = images(epoch=0, swap_order=True)
    assert swapped == images(epoch=0, swap_order=True) != images(epoch=1, swap_order=True)
    assert 15 < sum(v == (1.0, 2.0) for v in swapped.values()) < 45


def test_batches(spark, samples):
    rows = [(c, str(i)) for c in ("b", "a") for i in range(25)]
    df = spark.createDataFrame(rows, "country string, patch_id string")
    plain = [(r.country, r.patch_id) for r in records.batches(df, 8).orderBy("batch", "place").collect()]
    assert plain == sorted(rows)
    mixed = records.batches(df.repartition(5), 8, 1, training=True)
    order = [(r.batch, r.place, r.country, r.patch_id) for r in mixed.orderBy("batch", "place").collect()]
    assert [r[:2] for r in order] == [(i // 8, i % 8) for i in range(50)] and sorted(r[2:] for r in order) == sorted(rows)
    again = lambda epoch: sorted(map(tuple, records.batches(df.coalesce(1), 8, epoch, training=True).select("batch", "place", "country", "patch_id").collect()))
    assert again(1) == order != again(2) and [r[2:] for r in order] != plain


def test_factories_and_plans(spark, samples, tmp_path):
    def fails():
        raise KeyError("weights of another kind")

    make = scorers.first_that_works(fails, scorers.bright)
    assert make()(np.ones((1, 2, 2))).shape == (2, 2, 2)
    with pytest.raises(KeyError):
        scorers.first_that_works(scorers.bright, fails) and scorers.first_that_works(fails)()
    with pytest.raises(ValueError):
        scorers.named_factory("no_colon")
    (tmp_path / "plan.json").write_text('{"rotate": 0.0, "gamma": 1.0}')
    assert A.Plan.read(spark, str(tmp_path / "plan.json")) == A.Plan(rotate=0.0, gamma=1.0)
    (tmp_path / "odd.json").write_text('{"spin": 1}')
    with pytest.raises(TypeError):
        A.Plan.read(spark, str(tmp_path / "odd.json"))
    bright = lambda df, draw: df.withColumns({"image": F.transform("image", lambda v: v + 1), "mask": F.transform("mask", lambda v: F.greatest(v, F.lit(2)))})
    plan = A.Plan(rotate=0, flip=0, sharpen=0, resized_crop=0)
    for r in A.augmented(samples, 0, plan=plan, changes=[bright]).collect():
        assert min(r.image) >= 1 and min(r.mask) == 2


def test_training_logs(spark):
    log = spark.createDataFrame([(0, 0.9, 1e-3), (0, 0.9, 3e-3), (1, 0.4, 2e-3), (2, 0.4, 1e-3), (3, float("nan"), 1e-3)], "epoch int, loss double, rate double")
    means = {r.epoch: r.rate for r in metrics.epoch_means(log, ["rate"]).collect()}
    assert means == pytest.approx({0: 2e-3, 1: 2e-3, 2: 1e-3, 3: 1e-3})
    assert {r.kind: r.epoch for r in metrics.best_and_last(log).collect()} == {"best": 1, "last": 3}


ONE = {"rotate": 0, "flip": 0, "sharpen": 0, "resized_crop": 0, "scale": 1}


@pytest.mark.parametrize("name", ["flip", "sharpen", "gamma", "affine", "blur", "noise", "jitter", "shear", "small_rotate", "rotate", "resized_crop"])
def test_each_change_alone(spark, name):
    """What a change does, from its definition, to a sample of seeded draws."""
    rng = np.random.default_rng(3)
    image, mask = rng.uniform(0.1, 1, (4, 9, 11)), rng.integers(0, 3, (9, 11))
    df, plan = table(spark, [image], [mask], ["s"]), A.Plan(**ONE | {name: 1.0})
    ((x, m),) = changed(df, plan=plan).values()
    assert x.shape == image.shape and m.shape == mask.shape and np.isfinite(x).all()

    def u(what, low=0.0, high=1.0, n=None):
        draws = [A.hashed(7, 0)(what, low, high, None if n is None else F.lit(k)) for k in range(n or 1)]
        found = df.select(*(d.alias(str(k)) for k, d in enumerate(draws))).first()
        return found[0] if n is None else np.array(found)

    close = lambda a, b: np.allclose(a, b, rtol=1e-6, atol=1e-7)  # noqa: E731 - images are floats
    if name == "flip":
        assert close(x, image[:, ::-1, ::-1]) and np.array_equal(m, mask[::-1, ::-1])
    elif name == "gamma":
        assert close(x, np.stack([b**e for b, e in zip(image, u("exponents", 0.8, 1.2, 4), strict=True)]))
    elif name == "affine":
        assert close(x, [b * f + o for b, f, o in zip(image, u("factors", 0.9, 1.1, 4), u("offsets", -0.02, 0.02, 4), strict=True)])
    elif name == "noise":
        d = (x - image).ravel()
        assert 0.012 < d.std() < 0.018 and abs(d.mean()) < 0.003 and abs((d**3).mean() / d.std() ** 3) < 0.6
        assert not np.array_equal(x, changed(df, 1, plan=plan)["s"][0])
    elif name == "sharpen":
        f = u("sharpness", 0.0, 0.5)
        y, z = 4, 5
        smooth = (image[:, 3:6, 4:7].sum((1, 2)) + 4 * image[:, y, z]) / 13
        assert close(x[:, y, z], image[:, y, z] + f * (image[:, y, z] - smooth)) and close(x[:, 0], image[:, 0])
    elif name == "blur":
        s = u("sigma", 0.5, 1.5)
        g = np.exp(-np.array([1, 0, 1]) / (2 * s * s))
        g /= g.sum()
        assert close(x[:, 4, 5], np.einsum("bij,i,j->b", image[:, 3:6, 4:7], g, g))
        assert close(x[:, 0, 5], np.einsum("bij,i,j->b", image[:, [1, 0, 1], 4:7], g, g))
    elif name == "jitter":
        n = int(u("pixels", 0, 3))
        want = np.array([[2 if (mask[max(0, i - n) : i + n + 1, max(0, j - n) : j + n + 1] == 2).any() else mask[i, j] for j in range(11)] for i in range(9)])
        assert np.array_equal(m, want)
    else:
        if name == "resized_crop":
            area, shape = u("area", 0.3, 0.9) * 99, np.exp(u("shape", np.log(0.75), np.log(1.33)))
            hh, ww = min(9, np.sqrt(area / shape)), min(11, np.sqrt(area * shape))
            top, left = u("top") * (9 - hh), u("left") * (11 - ww)
            source = lambda i, j: (top + (i + 0.5) * hh / 9 - 0.5, left + (j + 0.5) * ww / 11 - 0.5)
        else:
            a = np.radians({"rotate": lambda: u("angle", -90, 90), "small_rotate": lambda: u("small angle", -30, 30), "shear": lambda: u("shear", -5, 5)}[name]())
            turn = np.array([[1, 0], [np.tan(a), 1]] if name == "shear" else [[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
            source = lambda i, j: tuple(turn @ [i - 4, j - 5] + [4, 5])
        for i in range(9):
            for j in range(11):
                a, b = source(i, j)
                near = (int(np.rint(a)), int(np.rint(b)))
                inside = 0 <= near[0] < 9 and 0 <= near[1] < 11
                assert m[i, j] == (mask[near] if inside else 3)
                v, w = int(np.floor(a + 1e-9)), int(np.floor(b + 1e-9))
                at = lambda p, q: image[:, p, q] if 0 <= p < 9 and 0 <= q < 11 else np.zeros(4)
                da, db = a - v, b - w
                want = at(v, w) * (1 - da) * (1 - db) + at(v, w + 1) * (1 - da) * db + at(v + 1, w) * da * (1 - db) + at(v + 1, w + 1) * da * db
                assert close(x[:, i, j], want)


def test_random_scale_divides_by_a_draw_of_the_sample(spark):
    df = table(spark, [np.full((1, 2, 2), 10000.0)] * 50, [np.zeros((2, 2), int)] * 50)
    plan = A.Plan(rotate=0, flip=0, sharpen=0, resized_crop=0, random_scale=True)
    found = [x[0, 0, 0] for x, _ in changed(df, plan=plan).values()]
    assert all(1 / 1.5 <= v <= 2 for v in found) and len(set(found)) == 50


def test_only_resampling_leaves_the_jvm(samples):
    plan = A.Plan(random_scale=True, rotate=0, resized_crop=0, gamma=0.5, affine=0.5, blur=0.5, noise=0.5, drop_window=0.5, jitter=0.5)
    python = lambda p: A.augmented(samples, 0, plan=p)._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert python(plan) == 0 and python(A.Plan()) == 2


def test_scored_images_are_cut_back_to_their_size(samples):
    df = samples.withColumnRenamed("mask", "gt")
    for least in (0, 64):
        out = scorers.classified(df, scorers.threshold_scorer(0.5), symmetries=False, least=least).collect()
        assert all(len(r.pred) == r.h * r.w for r in out)
    assert scorers.padded(np.ones((2, 33, 40)), 0).shape == (2, 64, 64) and scorers.padded(np.ones((33, 40)), 512).shape == (512, 512)
