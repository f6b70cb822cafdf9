"""Schemas of the tables."""

PATCHES = "country string, patch_id string, usable_pair boolean, image_a_path string, image_b_path string, label_path string"
CHIPS = "country string, aoi_id string, split string"
#: Rasters are flat, row by row, band by band.
RASTERS = "country string, patch_id string, h int, w int, gt array<int>, pred array<int>"

# The columns of a metrics file, by name and in order.
METRICS = (
    "pixel_level_iou", "pixel_level_precision", "pixel_level_recall",
    "object_pix_precision", "object_pix_recall", "object_pix_f1", "object_ws_precision", "object_ws_recall", "object_ws_f1",
    "pq_sq", "pq_rq", "pq", "ap_5_95",
    "polygon_count_delta_mean", "polygon_count_delta_median", "boundary_error_m_mean", "boundary_error_m_p95",
)
METRICS_CSV = "checkpoint string, country string, n_patches bigint, " + ", ".join(f"{m} double" for m in METRICS)
#: IoU thresholds of the F1 grid, in percent.
THRESHOLDS = tuple(range(50, 100, 5))
BACKGROUND, FIELD, BOUNDARY, IGNORE = 0, 1, 2, 3
