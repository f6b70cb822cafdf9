"""The same queries in SQL, for DuckDB. Written apart from the operators: pixels are rows here."""

from __future__ import annotations

import math

from ..operators.records import named
from ..schemas import METRICS
from . import bindings as B

_IN = ", ".join(f"'{c}'" for c in named(B.COUNTRIES))
_COUNTRY = """placed AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice, lower(n_name) AS country
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
_PATCHES = f"""{_COUNTRY}, patches AS (
  SELECT country, CAST(o_orderkey AS VARCHAR) AS patch_id, o_orderstatus <> 'P' AS usable_pair,
    'window_a/' || o_orderkey || '.tif' AS image_a_path, 'window_b/' || o_orderkey || '.tif' AS image_b_path,
    CASE WHEN o_orderkey % 2 = 0 THEN '/labels/' ELSE 'labels/' END || o_orderkey || '.tif' AS label_path
  FROM placed)"""
_CHIPS = """chips AS (
  SELECT DISTINCT country, CAST(l_orderkey AS VARCHAR) AS aoi_id,
    CASE l_orderkey % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split
  FROM lineitem JOIN placed ON l_orderkey = o_orderkey)"""
_SPLIT = f"""{_PATCHES}, {_CHIPS}, records AS (
  SELECT p.*, split FROM patches p JOIN chips c ON p.country = c.country AND patch_id = aoi_id
  WHERE usable_pair AND p.country IN ({_IN}))"""

_PIXELS = """pixels AS (
  SELECT vec_id, label, CAST(i - 1 AS INT) AS i, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x,
    CAST(embedding[i] AS DOUBLE) AS v
  FROM embeddings, range(1, 65) r(i))"""
_CLASSES = f"""{_PIXELS}, classes AS (
  SELECT *, CASE WHEN v > {B.PRED} THEN 1 WHEN v > {B.GT} THEN 2 ELSE 0 END AS c,
    CASE WHEN (vec_id + y + x) % 17 = 0 THEN 3 WHEN v > {B.PRED} THEN 1 WHEN v > {B.GT} THEN 2 ELSE 0 END AS t
  FROM pixels)"""


def _parts(name: str, mask: str, source: str) -> str:
    """(vec_id, i, y, x, id): pixels of a mask with the least pixel of their component."""
    return f"""{name}_m AS (SELECT vec_id, i, y, x FROM {source} WHERE {mask}),
{name}_r AS (
  SELECT vec_id, i, y, x, i AS id FROM {name}_m
  UNION
  SELECT n.vec_id, n.i, n.y, n.x, r.id FROM {name}_r r JOIN {name}_m n
    ON n.vec_id = r.vec_id AND abs(n.y - r.y) + abs(n.x - r.x) = 1 AND n.i > r.id),
{name} AS (SELECT vec_id, i, y, x, min(id) AS id FROM {name}_r GROUP BY vec_id, i, y, x)"""


def _objects(gt: str = f"v > {B.GT}", pred: str = f"v > {B.PRED}", more: str = "") -> str:
    """gt, pred, their areas and numbers, and pairs with IoU."""
    return f"""WITH RECURSIVE {_CLASSES}, {_parts("gt", gt, "classes")}, {_parts("pred0", pred, "classes")}{more},
{"" if more else "pred AS (SELECT * FROM pred0),"}
gt_a AS (SELECT vec_id, id, count(*) AS area FROM gt GROUP BY ALL), pred_a AS (SELECT vec_id, id, count(*) AS area FROM pred GROUP BY ALL),
pairs AS (
  SELECT vec_id, gt, pred, inter, CAST(CAST(inter AS DOUBLE) / (a.area + b.area - inter) AS FLOAT) AS iou
  FROM (SELECT gt.vec_id, gt.id AS gt, pred.id AS pred, count(*) AS inter FROM gt JOIN pred ON gt.vec_id = pred.vec_id AND gt.i = pred.i GROUP BY ALL)
  JOIN gt_a a USING (vec_id) JOIN pred_a b USING (vec_id) WHERE a.id = gt AND b.id = pred),
numbers AS (
  SELECT e.vec_id, CAST(e.label AS VARCHAR) AS country, coalesce(g.n, 0) AS n_gt, coalesce(p.n, 0) AS n_pred FROM embeddings e
  LEFT JOIN (SELECT vec_id, count(*) AS n FROM gt_a GROUP BY 1) g USING (vec_id)
  LEFT JOIN (SELECT vec_id, count(*) AS n FROM pred_a GROUP BY 1) p USING (vec_id))"""


def _counts(by: str = "country", thresholds: str = "(VALUES (50)) t(threshold)") -> str:
    return f"""per AS (
  SELECT n.country, n.vec_id, threshold, n_gt, n_pred, count(p.vec_id) AS tp FROM numbers n CROSS JOIN {thresholds}
  LEFT JOIN pairs p ON p.vec_id = n.vec_id AND p.iou > CAST(threshold / 100.0 AS FLOAT) GROUP BY ALL),
counts AS (
  SELECT {by}, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_pred - tp) AS BIGINT) AS fp, CAST(sum(n_gt - tp) AS BIGINT) AS fn FROM per GROUP BY ALL),
ratios AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM counts),
scores AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM ratios)"""


_F1 = "SELECT country, tp, fp, fn, CAST(round(p, 6) AS DOUBLE) AS precision, CAST(round(r, 6) AS DOUBLE) AS recall, CAST(round(f, 6) AS DOUBLE) AS f1 FROM scores"
_GRID = "(SELECT CAST(t AS INT) AS threshold FROM range(50, 100, 5) r(t)) t"


def _confusion(source: str, by: str, truth: str, found: str) -> str:
    return f"""SELECT {by}, tp, fp, fn, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0.0::DOUBLE END AS iou,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall
FROM (SELECT {by}, count(*) FILTER ({truth} AND {found}) AS tp, count(*) FILTER (NOT ({truth}) AND {found}) AS fp,
  count(*) FILTER ({truth} AND NOT ({found})) AS fn FROM {source} GROUP BY {by})"""


#: Distance to the nearest boundary pixel; patches without one are left out.
_DEPTH = """depth AS (
  SELECT a.vec_id, a.i, a.y, a.x, sqrt(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))) AS d
  FROM classes a JOIN classes b ON a.vec_id = b.vec_id AND b.c = 2 GROUP BY ALL)"""
#: Fields that a seed lies in. A seed's flood over ground above its height less 2 meets nothing higher; a patch
#: that spans less than 2, or has no boundary, keeps all its fields.
_FLOOD = f""", {_DEPTH},
land AS (SELECT d.vec_id, d.i, d.y, d.x, d.d FROM depth d JOIN classes c USING (vec_id, i) WHERE c.c = 1),
flood AS (
  SELECT vec_id, i AS start, d AS height, i, y, x, d FROM land WHERE d >= 2
  UNION
  SELECT f.vec_id, f.start, f.height, n.i, n.y, n.x, n.d FROM flood f JOIN land n
    ON n.vec_id = f.vec_id AND abs(n.y - f.y) <= 1 AND abs(n.x - f.x) <= 1 AND n.d > f.height - 2 + 1e-5),
seeds AS (SELECT vec_id, start AS i FROM flood GROUP BY vec_id, start, height HAVING max(d) <= height),
flat AS (SELECT vec_id FROM embeddings EXCEPT SELECT vec_id FROM land WHERE d >= 2),
seeded AS (SELECT DISTINCT p.vec_id, p.id FROM pred0 p JOIN seeds USING (vec_id, i)),
pred AS (
  SELECT p.* FROM pred0 p JOIN seeded USING (vec_id, id)
  UNION ALL SELECT p.* FROM pred0 p JOIN flat USING (vec_id))"""
_FLOODED = _objects(pred="c = 1", more=_FLOOD)

#: The flood itself, pixel by pixel: the deepest of those reached first, of equals the one reached first. A patch is a row with its lists.
_INSTANCES = f"""WITH RECURSIVE {_CLASSES}, {_parts("pred0", "c = 1", "classes")}{_FLOOD},
seed AS (
  SELECT c.vec_id, c.i, c.y, c.x FROM classes c JOIN (
    SELECT vec_id, i FROM seeds UNION SELECT vec_id, i FROM classes JOIN flat USING (vec_id) WHERE c = 1) s USING (vec_id, i)),
{_parts("grain", "true", "seed")},
numbered AS (SELECT vec_id, i, dense_rank() OVER (PARTITION BY vec_id ORDER BY id) AS n, row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS age FROM grain),
ground AS (
  SELECT vec_id, list(c = 1 ORDER BY i) AS field, list(coalesce(d, CAST('infinity' AS DOUBLE)) ORDER BY i) AS depth, list(coalesce(n, 0) ORDER BY i) AS out
  FROM classes LEFT JOIN depth USING (vec_id, i) LEFT JOIN numbered USING (vec_id, i) GROUP BY vec_id),
flow AS (
  SELECT vec_id, out, queue, CAST(len(queue) AS BIGINT) AS age FROM ground JOIN (
    SELECT vec_id, list({{'k': -coalesce(d, CAST('infinity' AS DOUBLE)), 'age': CAST(age AS BIGINT), 'i': CAST(i AS BIGINT)}}) AS queue
    FROM numbered LEFT JOIN depth USING (vec_id, i) GROUP BY vec_id) USING (vec_id)
  UNION ALL
  SELECT vec_id, list_transform(out, lambda v, j: CASE WHEN list_contains(more, j - 1) THEN out[top.i + 1] ELSE v END),
    list_concat(list_filter(queue, lambda q: q.age <> top.age), list_transform(more, lambda j, k: {{'k': -depth[j + 1], 'age': age + k - 1, 'i': j}})),
    age + len(more)
  FROM (
    SELECT *, list_filter([CASE WHEN top.i >= 8 THEN top.i - 8 END, CASE WHEN top.i % 8 > 0 THEN top.i - 1 END,
      CASE WHEN top.i % 8 < 7 THEN top.i + 1 END, CASE WHEN top.i < 56 THEN top.i + 8 END], lambda j: j IS NOT NULL AND field[j + 1] AND out[j + 1] = 0) AS more
    FROM (SELECT f.vec_id, f.out, f.queue, f.age, list_min(f.queue) AS top, g.field, g.depth FROM flow f JOIN ground g USING (vec_id) WHERE len(f.queue) > 0)))
SELECT CAST(vec_id AS VARCHAR) AS patch_id, CAST(value AS INT) AS value, count(*) AS n
FROM (SELECT vec_id, unnest(out) AS value FROM flow WHERE len(queue) = 0) WHERE value > 0 GROUP BY ALL"""

#: Boundary pixels: an eight-neighbour in the image is not of the same component.
def _edges(name: str, parts: str) -> str:
    return f"""{name} AS (
  SELECT DISTINCT a.vec_id, a.i, a.y, a.x, a.id FROM {parts} a, (VALUES (-1), (0), (1)) dy(dy), (VALUES (-1), (0), (1)) dx(dx)
  WHERE a.y + dy BETWEEN 0 AND 7 AND a.x + dx BETWEEN 0 AND 7 AND NOT EXISTS (
    SELECT 1 FROM {parts} b WHERE b.vec_id = a.vec_id AND b.i = (a.y + dy) * 8 + a.x + dx AND b.id = a.id))"""


def _nearest(name: str, a: str, b: str) -> str:
    return f"""{name} AS (
  SELECT vec_id, gt, pred, avg(d) AS d FROM (
    SELECT p.vec_id, p.gt, p.pred, a.i, sqrt(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))) AS d
    FROM pairs p JOIN {a}_e a ON a.vec_id = p.vec_id AND a.id = p.{a} JOIN {b}_e b ON b.vec_id = p.vec_id AND b.id = p.{b}
    WHERE p.iou > CAST(0.5 AS FLOAT) GROUP BY ALL) GROUP BY ALL)"""


_CHAMFER = f"""{_objects()}, {_edges("gt_e", "gt")}, {_edges("pred_e", "pred")}, {_nearest("there", "gt", "pred")}, {_nearest("back", "pred", "gt")},
far AS (SELECT vec_id, gt, pred, (a.d + b.d) / 2 AS d FROM there a JOIN back b USING (vec_id, gt, pred))"""

_METRICS = f"""{_COUNTRY}, metric AS (
  SELECT country, count(*) AS n_patches, round(avg(o_totalprice) / 1e6, 6) AS price FROM placed GROUP BY 1),
rows AS (
  SELECT country, n_patches, CASE WHEN country = 'nation_3' THEN CAST('nan' AS DOUBLE) ELSE price END AS pixel_level_iou,
    CASE WHEN country <> 'nation_5' THEN price / 2 END AS object_ws_f1, price / 4 AS pq FROM metric)"""


def _text(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '' WHEN isnan({c}) THEN 'nan' ELSE printf('%.6f', {c}) END"


def _column(i: int, metric: str) -> str:
    return metric if metric in ("pixel_level_iou", "object_ws_f1", "pq") else f"(pq * 4 / {i + 2})"


_TURNS = {
    "identity": "y, x", "flip_x": "y, 7 - x", "flip_y": "7 - y, x", "turn_180": "7 - y, 7 - x",
    "turn_90": "x, 7 - y", "turn_270": "7 - x, y", "transpose": "x, y", "anti_transpose": "7 - x, 7 - y",
}
#: A row for each transform and target pixel: the source pixel.
_D4 = " UNION ALL ".join(
    f"SELECT '{n}' AS name, y * 8 + x AS i, ({s.split(',')[0]}) * 8 + ({s.split(',')[1]}) AS s FROM range(8) a(y), range(8) b(x)" for n, s in _TURNS.items()
)
_MIRROR = "CASE WHEN {c} < 0 THEN -({c}) WHEN {c} >= 8 THEN 14 - ({c}) ELSE {c} END"



def _u(name: str, low: float = 0, high: float = 1, index: str = "0") -> str:
    """The draw of a name for a sample, as in the queries."""
    return f"({low}::DOUBLE + ((vec_id * 7 + {13 * len(name)} + ({index}) * 31) % 97 + 0.5::DOUBLE) / 97 * ({high - low})::DOUBLE)"


def _seen(matrix: tuple[str, str, str, str, str, str], gate: str, likely: float) -> str:
    """Images and classes seen through a matrix, target to source, where the gate is open."""
    a, b, down, c, d, right = matrix
    return f"""WITH {_CLASSES}, moved AS (
  SELECT vec_id, i, CASE WHEN goes THEN ({a}) * y + ({b}) * x + ({down}) ELSE y END AS sy, CASE WHEN goes THEN ({c}) * y + ({d}) * x + ({right}) ELSE x END AS sx
  FROM (SELECT *, {_u(gate + " gate")} < {likely} AS goes FROM classes)),
near AS (SELECT *, floor(sy + 1e-9) AS fy, floor(sx + 1e-9) AS fx FROM moved),
mixed AS (
  SELECT m.vec_id, m.i, sum(coalesce(p.v, 0) * CASE WHEN oy = 0 THEN 1 - (sy - fy) ELSE sy - fy END * CASE WHEN ox = 0 THEN 1 - (sx - fx) ELSE sx - fx END) AS v
  FROM near m CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(oy, ox) LEFT JOIN classes p ON p.vec_id = m.vec_id AND p.y = fy + oy AND p.x = fx + ox GROUP BY ALL)
SELECT m.vec_id AS patch_id, m.i, round(CAST(CAST(mixed.v AS FLOAT) AS DOUBLE), 6) AS value, coalesce(n.c, 3) AS class
FROM near m JOIN mixed USING (vec_id, i) LEFT JOIN classes n ON n.vec_id = m.vec_id AND n.y = round(sy) AND n.x = round(sx)"""


def _about(a: str, b: str, c: str, d: str) -> tuple[str, str, str, str, str, str]:
    return a, b, f"3.5 - ({a}) * 3.5 - ({b}) * 3.5", c, d, f"3.5 - ({c}) * 3.5 - ({d}) * 3.5"


def _turned(name: str, most: int, gate: str) -> str:
    angle = f"radians({_u(name, -most, most)})"
    return _seen(_about(f"cos({angle})", f"-sin({angle})", f"sin({angle})", f"cos({angle})"), gate, 0.5)


def _cropped() -> str:
    area, shape = f"({_u('area', 0.3, 0.9)} * 64)", f"exp({_u('shape', math.log(0.75), math.log(1.33))})"
    height, width = f"least(8, sqrt({area} / {shape}))", f"least(8, sqrt({area} * {shape}))"
    place = lambda name, size: f"{_u(name)} * (8 - {size}) + ({size} / 8 - 1) / 2"
    return _seen((f"{height} / 8", "0", place("top", height), "0", f"{width} / 8", place("left", width)), "resized crop", 0.5)


SQL = {
    "eval_batches": f"""WITH {_PATCHES} SELECT country, patch_id, k // 64 AS batch, CAST(k % 64 AS INT) AS place
FROM (SELECT country, patch_id, row_number() OVER (ORDER BY country, patch_id) - 1 AS k FROM patches)""",
    "reader_shares": f"""WITH {_PATCHES}, dealt AS (
  SELECT patch_id, CAST(k % 7 AS INT) AS reader, k // 7 // 32 AS batch, CAST(k // 7 % 32 AS INT) AS place
  FROM (SELECT patch_id, row_number() OVER (ORDER BY country, patch_id) - 1 AS k FROM patches))
SELECT reader, batch, count(*) AS n, min(place) AS first, max(place) AS last, min(patch_id) AS least FROM dealt GROUP BY reader, batch""",
    "record_at": f"""WITH {_PATCHES}, ordered AS (SELECT country, patch_id, CAST(row_number() OVER (ORDER BY country, patch_id) - 1 AS INT) AS nth FROM patches)
SELECT country, patch_id, nth FROM ordered WHERE nth IN (0, 100)""",
    "epoch_means": "SELECT l_linenumber AS epoch, round(avg(l_discount), 6) AS rate FROM lineitem GROUP BY 1",
    "epochs_kept": """SELECT 'best' AS kind, o_orderkey AS epoch, o_totalprice AS loss FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1)
UNION ALL SELECT 'last', o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 1)""",
    "evaluate_scorer": f"""{_objects()}, {_counts()}, patches AS (SELECT country, count(*) AS n_patches, avg(abs(n_pred - n_gt)) AS delta FROM numbers GROUP BY 1),
sq AS (SELECT country, avg(CAST(iou AS DOUBLE)) AS sq FROM numbers JOIN pairs USING (vec_id) WHERE iou > CAST(0.5 AS FLOAT) GROUP BY 1),
pixel AS (
  SELECT CAST(label AS VARCHAR) AS country, count(*) FILTER (v > {B.GT} AND v > {B.PRED}) / count(*) FILTER (v > {B.GT} OR v > {B.PRED}) AS iou FROM pixels GROUP BY 1)
SELECT s.country, n_patches, round(iou, 6) AS pixel_level_iou, CAST(round(f, 6) AS DOUBLE) AS object_pix_f1, round(coalesce(sq, 0), 6) AS pq_sq,
  CAST(round(f, 6) AS DOUBLE) AS pq_rq, round(coalesce(sq, 0) * f, 6) AS pq, round(delta, 6) AS polygon_count_delta_mean
FROM scores s JOIN patches USING (country) LEFT JOIN sq USING (country) JOIN pixel USING (country)""",
    "random_divisor": f"""WITH {_PIXELS} SELECT vec_id AS patch_id, i, round(CAST(CAST(v / 3.0::DOUBLE * (1 / {_u("scale", 0.5, 1.5)}) AS FLOAT) AS DOUBLE), 6) AS value FROM pixels""",
    "rotate_image": _turned("angle", 90, "rotate"),
    "small_rotate_image": _turned("small angle", 30, "small rotate"),
    "shear_image": _seen(_about("1", "0", f"tan(radians({_u('shear', -5, 5)}))", "1"), "shear", 0.3),
    "resized_crop_image": _cropped(),
    "sharpen_image": f"""WITH {_PIXELS}, mean AS (
  SELECT a.vec_id, a.i, sum(b.v * CASE WHEN a.i = b.i THEN 5 ELSE 1 END) / 13 AS m FROM pixels a JOIN pixels b
  ON b.vec_id = a.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 GROUP BY ALL)
SELECT vec_id AS patch_id, i, round(CAST(CAST(CASE WHEN m IS NOT NULL AND {_u("sharpen gate")} < 0.5 THEN v + {_u("sharpness", 0, 0.5)} * (v - m) ELSE v END AS FLOAT) AS DOUBLE), 6) AS value
FROM pixels LEFT JOIN mean USING (vec_id, i)""",
    "noise_image": f"""WITH {_PIXELS} SELECT vec_id AS patch_id, i, round(CAST(CAST(CASE WHEN {_u("noise gate")} < 0.3
  THEN v + 0.015::DOUBLE * sqrt(-2 * ln(1 - {_u("noise far", index="i")})) * cos(2 * pi() * {_u("noise turn", index="i")}) ELSE v END AS FLOAT) AS DOUBLE), 6) AS value FROM pixels""",
    "jitter_boundary": f"""WITH {_CLASSES} SELECT a.vec_id AS patch_id, a.i, CASE WHEN {_u("jitter gate").replace("vec_id", "a.vec_id")} < 0.5 AND EXISTS (
  SELECT 1 FROM classes b WHERE b.vec_id = a.vec_id AND b.c = 2 AND greatest(abs(a.y - b.y), abs(a.x - b.x)) <= floor({_u("pixels", 0, 3).replace("vec_id", "a.vec_id")}))
  THEN 2 ELSE a.c END AS value FROM classes a""",
    # Bands of 4 x 4: a flip is a change of the source pixel.
    "training_changes": f"""WITH {_PIXELS}, placed AS (
  SELECT vec_id, i, i // 16 AS b, CASE WHEN {_u("flip y gate")} < 0.5 THEN 3 - i % 16 // 4 ELSE i % 16 // 4 END AS sy,
    CASE WHEN {_u("flip x gate")} < 0.5 THEN 3 - i % 4 ELSE i % 4 END AS sx FROM pixels),
taken AS (SELECT p.vec_id, p.i, p.b, s.v / 2 AS v FROM placed p JOIN pixels s ON s.vec_id = p.vec_id AND s.i = p.b * 16 + sy * 4 + sx),
risen AS (SELECT *, CASE WHEN {_u("gamma gate")} < 0.3 THEN pow(greatest(v, 1e-6), {_u("exponents", 0.8, 1.2, "b")}) ELSE v END AS g FROM taken),
moved AS (SELECT *, CASE WHEN {_u("affine gate")} < 0.3 THEN g * {_u("factors", 0.9, 1.1, "b")} + {_u("offsets", -0.02, 0.02, "b")} ELSE g END AS f FROM risen)
SELECT vec_id AS patch_id, i, true AS training, round(CAST(CAST(
  CASE WHEN {_u("drop window gate")} < 0.5 AND (i >= 32) = ({_u("which window")} < 0.5) THEN 0 ELSE f END AS FLOAT) AS DOUBLE), 6) AS value FROM moved
UNION ALL SELECT vec_id, i, false, round(CAST(CAST(v / 2 AS FLOAT) AS DOUBLE), 6) FROM pixels""",
    "index_scan": f"WITH {_PATCHES} SELECT * FROM patches",
    "chips_scan": f"WITH {_COUNTRY}, {_CHIPS} SELECT * FROM chips",
    "raster_scan": f"""WITH {_PIXELS} SELECT CAST(label AS VARCHAR) AS country, CAST(vec_id AS VARCHAR) AS patch_id, 8 AS h, 8 AS w,
  count(*) FILTER (v > {B.GT}) AS gt_pixels, count(*) FILTER (v > {B.PRED}) AS pred_pixels FROM pixels GROUP BY label, vec_id""",
    "raster_files": f"""WITH {_PIXELS}, found AS (
  SELECT vec_id, count(*) FILTER (v > 0) AS n, max(v) AS highest FROM pixels GROUP BY 1),
places AS (SELECT scene, CAST(p AS INT) AS p FROM (SELECT DISTINCT vec_id // 16 AS scene FROM embeddings), range(16) r(p) WHERE scene % 10 IN (1, 4, 7))
SELECT CAST(scene % 10 AS VARCHAR) AS country, scene, CAST(p // 4 * 8 AS INT) AS top, CAST(p % 4 * 8 AS INT) AS "left", 8 AS h, 8 AS w, 1 AS bands,
  CAST(coalesce(n, 0) AS INT) AS above_0_0, coalesce(highest, 0.0::DOUBLE) AS highest FROM places LEFT JOIN found ON vec_id = scene * 16 + p""",
    "absent_files": """WITH scenes AS (SELECT DISTINCT vec_id // 16 AS s FROM embeddings)
SELECT CAST(s % 10 AS VARCHAR) AS country, CAST(s AS VARCHAR) AS patch_id, 'window_b' AS role, 'country=' || (s + 3) % 10 || '/' || s + 3 || '.tif' AS path
FROM scenes WHERE s + 3 NOT IN (SELECT s FROM scenes)
UNION ALL SELECT CAST(s % 10 AS VARCHAR), CAST(s AS VARCHAR), 'label', 'labels/' || s FROM scenes
UNION ALL SELECT CAST(c AS VARCHAR), NULL, 'split', 'splits/chips_' || c || '.parquet' FROM range(12) r(c)""",
    "scene_components": f"""WITH RECURSIVE {_PIXELS}, field AS (
  SELECT CAST(label // 5 AS VARCHAR) AS scene, vec_id // 32 * 8 + y AS y, vec_id % 32 * 8 + x AS x, (vec_id // 32 * 8 + y) * 256 + vec_id % 32 * 8 + x AS i
  FROM pixels WHERE v > {B.PRED}),
near AS (
  SELECT a.scene, a.i, b.i AS j FROM field a JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx) ON true
  JOIN field b ON b.scene = a.scene AND b.y = a.y + dy AND b.x = a.x + dx),
reach AS (SELECT scene, i, i AS id FROM field UNION SELECT n.scene, n.j, r.id FROM reach r JOIN near n ON n.scene = r.scene AND n.i = r.i WHERE n.j > r.id)
SELECT scene, comp_id, count(*) AS area FROM (SELECT scene, i, min(id) AS comp_id FROM reach GROUP BY scene, i) GROUP BY ALL""",
    # Corners of an outline by the number of its pixels at each grid point: one or three give one, two at a diagonal two.
    "polygon_outlines": f"""WITH RECURSIVE {_PIXELS}, {_parts("gt", f"v > {B.GT}", "pixels")},
point AS (
  SELECT vec_id, id, y + dy AS py, x + dx AS px, count(*) AS n, count(DISTINCT y) * count(DISTINCT x) AS spread
  FROM gt, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx) GROUP BY ALL),
corner AS (
  SELECT vec_id, id, count(*) FILTER (n = 1) AS one, count(*) FILTER (n = 3) AS three, count(*) FILTER (n = 2 AND spread = 4) AS across FROM point GROUP BY ALL),
field AS (SELECT vec_id, id, count(*) AS area FROM gt GROUP BY ALL)
SELECT CAST(label AS VARCHAR) AS country, CAST(vec_id AS VARCHAR) AS patch_id, id AS comp_id, area, CAST(1 - (one - three - 2 * across) // 4 AS INT) AS n_holes,
  CAST(one + three + 2 * across AS INT) AS n_points, CAST(16 * (one + three + 2 * across) AS INT) + 0 AS point_bytes
FROM corner JOIN field USING (vec_id, id) JOIN embeddings USING (vec_id)""",
    "country_filter": f"WITH {_PATCHES} SELECT country, count(*) AS n FROM patches WHERE country IN ({_IN}) GROUP BY 1",
    "usable_filter": f"WITH {_PATCHES} SELECT country, count(*) AS n FROM patches WHERE usable_pair GROUP BY 1",
    "split_join": f"WITH {_SPLIT} SELECT country, patch_id, image_a_path FROM records WHERE split = 'val'",
    "split_union": " UNION ALL ".join(
        f"""SELECT * FROM (WITH {_PATCHES}, {_CHIPS} SELECT p.country, patch_id FROM patches p JOIN chips c ON p.country = c.country AND patch_id = aoi_id
  WHERE split = 'test' AND p.country = '{c}')""" for c in ("nation_2", "nation_1", "nation_2")
    ),
    "split_counts": f"WITH {_SPLIT} SELECT split, count(r.split) AS n FROM (VALUES ('train'), ('val'), ('test')) s(split) LEFT JOIN records r USING (split) GROUP BY 1",
    "record_paths": f"""WITH {_SPLIT} SELECT country, patch_id, '{B.ROOT}/' || image_a_path AS window_a, '{B.ROOT}/' || image_b_path AS window_b,
  CASE WHEN label_path LIKE '/%' THEN label_path ELSE '{B.ROOT}/' || label_path END AS label FROM records WHERE split = 'test'""",
    "path_country": f"""WITH {_PATCHES}, paths AS (SELECT 'data{B.MARKER}' || country || '/images/window_b/' || patch_id || '.tif' AS path FROM patches)
SELECT split_part(split_part(path, '{B.MARKER}', 2), '/', 1) AS country, count(*) AS n FROM paths GROUP BY 1""",
    "dense_countries": f"SELECT lower(n_name) AS country FROM nation WHERE lower(n_name) IN ({_IN}) EXCEPT SELECT 'nation_4'",
    "missing_countries": f"""WITH {_PATCHES} (SELECT lower(n_name) AS country FROM nation UNION ALL SELECT 'nowhere')
EXCEPT SELECT country FROM patches WHERE usable_pair""",
    "normalize": f"WITH {_PIXELS} SELECT vec_id AS patch_id, i, v / 3000.0::DOUBLE AS value FROM pixels",
    "binarize": f"WITH {_CLASSES} SELECT CAST(vec_id AS VARCHAR) AS patch_id, i, CAST(c > 0 AS INT) AS value FROM classes",
    "eval_relabel": f"WITH {_CLASSES} SELECT CAST(vec_id AS VARCHAR) AS patch_id, i, CASE WHEN t = 2 THEN 0 ELSE t END AS value FROM classes",
    "argmax": f"""WITH {_PIXELS} SELECT vec_id AS patch_id, CAST(i % 16 AS INT) AS i, CAST(arg_max(i // 16, struct_pack(v := v, c := -(i // 16))) AS INT) AS value
FROM pixels GROUP BY vec_id, i % 16""",
    "softmax": f"""WITH {_PIXELS} SELECT vec_id AS patch_id, CAST(i % 16 AS INT) AS i, CAST(i // 16 AS INT) AS class,
  round(exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id, i % 16), 9) AS p FROM pixels""",
    "clip_stack": f"""WITH {_PIXELS}, cut AS (SELECT vec_id, y * 7 + x AS i, v FROM pixels WHERE y < 7 AND x < 7)
SELECT a.vec_id AS patch_id, CAST(a.i + 49 AS INT) AS i, a.v AS value FROM cut a JOIN cut b ON b.vec_id = a.vec_id + 1 AND a.i = b.i
UNION ALL SELECT a.vec_id, CAST(a.i AS INT), b.v FROM cut a JOIN cut b ON b.vec_id = a.vec_id + 1 AND a.i = b.i""",
    "pad_mask": f"""WITH {_PIXELS}, all_ AS (
  SELECT vec_id, CAST(v > {B.GT} AS INT) AS value, y * 32 + x AS place FROM pixels
  UNION ALL SELECT vec_id, 3, p FROM embeddings, range(1024) r(p) WHERE p // 32 >= 8 OR p % 32 >= 8)
SELECT CAST(vec_id AS VARCHAR) AS patch_id, value, count(*) AS n, CAST(sum(place) AS BIGINT) AS places FROM all_ GROUP BY vec_id, value""",
    "center_crop": f"""WITH {_PIXELS} SELECT CAST(vec_id AS VARCHAR) AS patch_id, CAST((y - 1) * 5 + x - 1 AS INT) AS i, CAST(v > {B.GT} AS INT) AS value
FROM pixels WHERE y BETWEEN 1 AND 5 AND x BETWEEN 1 AND 5""",
    "d4_transform": f"""WITH {_PIXELS}, d4 AS ({_D4}) SELECT vec_id AS patch_id, name, CAST(d4.i AS INT) AS i, v AS value
FROM pixels p JOIN d4 ON d4.s = p.i""",
    # Of the eight transforms of 32 x 32 pixels two each bring a pixel to the column x, 31 - x, y and 31 - y.
    "tta_mean": f"""WITH {_PIXELS}, scored AS (SELECT vec_id, i, CAST(CAST(v AS FLOAT) / CAST(10000 AS FLOAT) AS DOUBLE) * 5e4::DOUBLE AS v, x, y FROM pixels)
SELECT vec_id AS patch_id, i, round(avg(1 / (1 + exp(-v * (1 + c % 8)))), 9) AS value
FROM (SELECT vec_id, i, v, unnest([x, 31 - x, y, 31 - y]) AS c FROM scored) GROUP BY vec_id, i""",
    "pixel_confusion": _confusion("documents JOIN labels USING (doc_id)", "lang", "quality = 1", "toxic = 1"),
    "country_confusion": f"WITH {_CLASSES} "
    + _confusion(f"(SELECT CAST(label AS VARCHAR) AS country, t, v > {B.PRED} AS p FROM classes WHERE t <> 3)", "country", "t = 1", "p"),
    "pixel_metrics": f"WITH {_CLASSES} "
    + _confusion(f"(SELECT CAST(label AS VARCHAR) AS country, CASE WHEN t = 2 THEN 0 ELSE t END AS t, v > {B.PRED} AS p FROM classes WHERE t <> 3)", "country", "t = 1", "p"),
    "components": f"""WITH RECURSIVE {_PIXELS}, {_parts("gt", f"v > {B.GT}", "pixels")}
SELECT CAST(label AS VARCHAR) AS country, CAST(vec_id AS VARCHAR) AS patch_id, id AS comp_id, count(*) AS area FROM gt JOIN embeddings USING (vec_id) GROUP BY ALL""",
    "polygon_iou": f"""{_objects()} SELECT CAST(label AS VARCHAR) AS country, CAST(vec_id AS VARCHAR) AS patch_id, gt, pred, inter,
  round(CAST(iou AS DOUBLE), 6) AS iou FROM pairs JOIN embeddings USING (vec_id)""",
    "match_at_05": f"{_objects()} SELECT CAST(vec_id AS VARCHAR) AS patch_id, gt, pred, round(CAST(iou AS DOUBLE), 6) AS iou FROM pairs WHERE iou > CAST(0.5 AS FLOAT)",
    "match_in_order": f"{_objects()} SELECT CAST(vec_id AS VARCHAR) AS patch_id, gt, pred FROM pairs WHERE iou > CAST(0.5 AS FLOAT)",
    "match_grid": f"{_objects()}, {_counts('country, threshold', _GRID)} SELECT country, threshold, tp, fp, fn FROM counts",
    "f1_grid": f"{_objects()}, {_counts('country, threshold', _GRID)} SELECT country, round(avg(f), 6) AS ap_5_95 FROM scores GROUP BY 1",
    "object_pix_f1": f"{_objects(pred='c = 1')}, {_counts()} {_F1}",
    "object_ws_f1": f"{_FLOODED}, {_counts()} {_F1}",
    "panoptic_quality": f"""{_objects()}, {_counts()}, patches AS (SELECT country, count(*) AS n_patches FROM numbers GROUP BY 1),
sq AS (SELECT country, avg(CAST(iou AS DOUBLE)) AS sq FROM numbers JOIN pairs USING (vec_id) WHERE iou > CAST(0.5 AS FLOAT) GROUP BY 1)
SELECT s.country, n_patches, tp, fp, fn, round(coalesce(sq, 0), 6) AS sq, CAST(round(f, 6) AS DOUBLE) AS rq, round(coalesce(sq, 0) * f, 6) AS pq
FROM scores s JOIN patches USING (country) LEFT JOIN sq USING (country)""",
    "count_delta": f"""{_objects()} SELECT country, round(avg(abs(n_pred - n_gt)), 6) AS polygon_count_delta_mean,
  CAST(median(abs(n_pred - n_gt)) AS DOUBLE) AS polygon_count_delta_median FROM numbers GROUP BY 1""",
    "boundary_pixels": f"WITH RECURSIVE {_PIXELS}, {_parts('gt', f'v > {B.GT}', 'pixels')}, {_edges('e', 'gt')} SELECT CAST(vec_id AS VARCHAR) AS patch_id, i, id AS value FROM e",
    "chamfer": f"{_CHAMFER} SELECT CAST(vec_id AS VARCHAR) AS patch_id, gt, pred, round(d, 6) AS chamfer FROM far",
    "boundary_error": f"""{_CHAMFER} SELECT country, round(avg(d * 3), 6) AS boundary_error_m_mean, round(quantile_cont(d * 3, 0.95), 6) AS boundary_error_m_p95
FROM numbers LEFT JOIN far USING (vec_id) GROUP BY 1""",
    "distance_transform": f"WITH {_CLASSES}, {_DEPTH} SELECT CAST(vec_id AS VARCHAR) AS patch_id, y, x, round(d, 6) AS value FROM depth",
    "watershed_mask": f"{_FLOODED} SELECT CAST(vec_id AS VARCHAR) AS patch_id, i FROM pred",
    "watershed_instances": _INSTANCES,
    "dilate_boundary": f"""WITH {_CLASSES} SELECT CAST(a.vec_id AS VARCHAR) AS patch_id, a.i, CASE WHEN a.t <> 3 AND EXISTS (
  SELECT 1 FROM classes b WHERE b.vec_id = a.vec_id AND b.t = 2 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1) THEN 2 ELSE a.t END AS value FROM classes a""",
    "band_gamma": f"WITH {_PIXELS} SELECT vec_id AS patch_id, i, round(pow(greatest(v, 1e-6), 0.8), 9) AS value FROM pixels",
    "band_affine": f"WITH {_PIXELS} SELECT vec_id AS patch_id, i, round(v * 1.1::DOUBLE - 0.02::DOUBLE, 9) AS value FROM pixels",
    "window_dropout": f"WITH {_PIXELS} SELECT vec_id AS patch_id, i, CASE WHEN (i >= 32) = (vec_id % 2 = 0) THEN 0.0::DOUBLE ELSE v END AS value FROM pixels",
    "gaussian_blur": f"""WITH {_PIXELS}, k AS (SELECT d, exp(-d * d / 2.0::DOUBLE) / (1 + 2 * exp(-0.5::DOUBLE)) AS g FROM (VALUES (-1), (0), (1)) t(d))
SELECT a.vec_id AS patch_id, a.i, round(sum(b.v * ky.g * kx.g), 9) AS value FROM pixels a, k ky, k kx, pixels b
WHERE b.vec_id = a.vec_id AND b.y = {_MIRROR.format(c="a.y + ky.d")} AND b.x = {_MIRROR.format(c="a.x + kx.d")} GROUP BY a.vec_id, a.i""",
    "metrics_scan": f"""WITH {_METRICS} SELECT 'c' AS checkpoint, country, n_patches, {", ".join(
        f"CASE WHEN isnan({_column(i, m)}) THEN -1 WHEN {_column(i, m)} IS NOT NULL THEN CAST({_text(_column(i, m))} AS DOUBLE) END AS {m}"
        for i, m in enumerate(METRICS))} FROM rows""",
    "metrics_format": f"""WITH {_METRICS} SELECT 'c' AS checkpoint, country, n_patches, {", ".join(
        f"{_text(_column(i, m))} AS {m}" for i, m in enumerate(METRICS))} FROM rows""",
    "macro_average": f"""WITH {_METRICS} SELECT round(avg(pixel_level_iou) FILTER (NOT isnan(pixel_level_iou)), 6) AS pixel_level_iou,
  round(avg(object_ws_f1), 6) AS object_ws_f1, round(avg(pq), 6) AS pq, count(*) AS n_countries, CAST(10 AS BIGINT) AS n_expected
FROM rows WHERE country IN ({_IN}) AND country <> 'nation_4'""",
    "summary_report": f"""WITH {_METRICS}, chosen AS (SELECT * FROM rows WHERE country IN ({_IN}))
SELECT 0 AS place, 'PQ' AS label, round(avg(pq), 4) AS value, 0.355::DOUBLE AS published FROM chosen
UNION ALL SELECT 4, 'Obj F1 (WS+TTA)', round(avg(object_ws_f1), 4), 0.452::DOUBLE FROM chosen
UNION ALL SELECT 5, 'Pixel IoU', round(avg(pixel_level_iou) FILTER (NOT isnan(pixel_level_iou)), 4), 0.688::DOUBLE FROM chosen""",
}
