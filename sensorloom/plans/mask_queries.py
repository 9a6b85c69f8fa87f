"""Masks as runs, coloured voxels and clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes as B
from ..operators import detect as D
from ..operators import masks as M
from ..operators import raster as R
from .detail_queries import CROPPED
from .raster_queries import DEPTH, K8, MASK, raster
from .registry import query, rounded


def runs_sql(source: str, keys: str = "vec_id") -> str:
    """SQL: runs of the pixels (v, u) of a table as text, for each key, by gaps and islands."""
    return f"""SELECT {keys}, string_agg(v || ':' || u0 || '-' || u1, ' ' ORDER BY v, u0) AS runs, CAST(sum(u1 - u0) AS BIGINT) AS area FROM (
  SELECT {keys}, v, min(u) AS u0, max(u) + 1 AS u1 FROM (SELECT *, u - row_number() OVER (PARTITION BY {keys}, v ORDER BY u) AS g FROM {source}) GROUP BY {keys}, v, g) GROUP BY {keys}"""


def mask_rows(fx, least: float = 0.1):
    """Each raster as the runs of its components over `least`."""
    bits = F.transform("embedding", lambda e: e.cast("double") > least)
    return B.computed(fx.raw("embeddings").select("vec_id", "embedding"), mask=M.encoded(bits, 8))


def shown(rows, *keys: str, mask: str = "mask"):
    """Masks that aren't empty, as text."""
    return rows.where(F.size(mask) > 0).select(*(keys or ("vec_id",)), M.text(F.col(mask)).alias("runs"), M.area(F.col(mask)).alias("area"))


@query("a8_run_regions", MASK + "SELECT r.*, x0, y0, x1, y1 FROM (" + runs_sql("mk") + ") r JOIN (SELECT vec_id, min(u) AS x0, min(v) AS y0, max(u) + 1 AS x1, max(v) + 1 AS y1 FROM mk GROUP BY 1) USING (vec_id)")
def _(fx):
    """Encoded masks with their regions."""
    rows = mask_rows(fx).withColumn("box", M.region(F.col("mask")))
    return shown(rows, "vec_id", *(F.col(f"box.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("m1_run_resize", "WITH px AS (SELECT vec_id, CAST(i AS INTEGER) AS u, CAST(j AS INTEGER) AS v, CAST(embedding[least(7, CAST(floor((j + 0.5e0) * 8 / 13) AS INTEGER)) * 8 + least(7, CAST(floor((i + 0.5e0) * 8 / 5) AS INTEGER)) + 1] AS DOUBLE) AS e FROM embeddings, LATERAL (SELECT unnest(generate_series(0, 4)) AS i), LATERAL (SELECT unnest(generate_series(0, 12)) AS j)), mk AS (SELECT * FROM px WHERE e > 0.1e0) " + runs_sql("mk"))
def _(fx):
    """8 x 8 masks made 5 wide and 13 high."""
    return shown(mask_rows(fx).withColumn("mask", M.resized(F.col("mask"), 8, 8, 5, 13)))


@query("m2_run_paste", MASK + ", ps AS (SELECT vec_id, u + vec_id % 9 - 4 AS u, v + vec_id % 7 - 3 AS v FROM mk WHERE u + vec_id % 9 - 4 BETWEEN 0 AND 9 AND v + vec_id % 7 - 3 BETWEEN 0 AND 8) " + runs_sql("ps"))
def _(fx):
    """Each mask at a place of its own on a canvas of 10 x 9."""
    return shown(mask_rows(fx).withColumn("mask", M.moved(F.col("mask"), F.col("vec_id") % 9 - 4, F.col("vec_id") % 7 - 3, 10, 9)))


@query("m2_run_union", "WITH px AS (SELECT vec_id, CAST(p AS INTEGER) // 8 AS v, CAST(p AS INTEGER) % 8 AS u, CAST(embedding[p + 1] AS DOUBLE) AS e FROM embeddings, LATERAL (SELECT unnest(generate_series(0, 63)) AS p)), un AS (SELECT vec_id, u, v FROM px WHERE e > 0.1e0 UNION SELECT vec_id, u + 2, v - 1 FROM px WHERE e > 0.15e0 AND u + 2 < 8 AND v >= 1) " + runs_sql("un"))
def _(fx):
    """A mask and another of the same raster, moved: one mask."""
    rows = B.computed(mask_rows(fx), other=M.moved(M.encoded(F.transform("embedding", lambda e: e.cast("double") > 0.15), 8), 2, -1, 8, 8))
    return shown(M.united(rows, F.array("mask", "other"), "mask"))


@query("p21_points_in_masks", MASK + ", pt AS (SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(embedding[2 * i + 1] AS DOUBLE) * 20 + 3 AS x, CAST(embedding[2 * i + 2] AS DOUBLE) * 20 + 3 AS y FROM embeddings, LATERAL (SELECT unnest(generate_series(0, 31)) AS i)) SELECT pt.vec_id, CAST(count(*) AS BIGINT) AS n_points, CAST(count(mk.u) AS BIGINT) AS n_inside, CAST(coalesce(sum(CASE WHEN mk.u IS NOT NULL THEN i END), 0) AS BIGINT) AS places FROM pt LEFT JOIN mk ON mk.vec_id = pt.vec_id AND mk.u = floor(x) AND mk.v = floor(y) GROUP BY 1")
def _(fx):
    """Of 32 points for each mask, those whose pixel is in it."""
    at = lambda i: F.element_at("embedding", i).cast("double") * 20 + 3
    points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(at(2 * i + 1).alias("x"), at(2 * i + 2).alias("y")))
    rows = mask_rows(fx).select("vec_id", M.holds(F.col("mask"), points).alias("inside"))
    number = F.filter(F.transform("inside", lambda b, i: F.when(b, i)), lambda i: i.isNotNull())
    return rows.select("vec_id", F.size("inside").cast("long").alias("n_points"), F.size(number).cast("long").alias("n_inside"), F.aggregate(number, F.lit(0).cast("long"), lambda a, i: a + i).alias("places"))


def masked_points(rows, mask: str, *keys: str):
    """Depth points of the pixels in each row's mask, no others: places are the mask's own, so masks and depths aren't joined."""
    out = rows.select(*keys, "embedding", F.explode(M.places(F.col(mask), 8)).alias("p"))
    z = 5.0 + 100.0 * F.abs(F.get("embedding", F.col("p")).cast("double"))
    pixel = out.select(*keys, (F.col("p") % 8).alias("u"), F.floor(F.col("p") / 8).cast("int").alias("v"), z.alias("z"))
    return R.depth_points(pixel, K8)


@query("p19_run_mask_filter", DEPTH + "SELECT vec_id, u, v, round((u - 4.08e0) * z / 6.33e0, 6) + 0e0 AS x, round((v - 2.455e0) * z / 6.33e0, 6) + 0e0 AS y, round(z, 6) AS z FROM dp WHERE e > 0.1e0")
def _(fx):
    return masked_points(mask_rows(fx), "mask", "vec_id").select("vec_id", "u", "v", *rounded(x="x", y="y", z="z"))


@query("j19_run_list_of_masks", DEPTH + ", m AS (SELECT vec_id, 0 AS mask_id, u, v FROM px WHERE e > 0 UNION ALL SELECT vec_id, 1, u - 2, v FROM px WHERE e > 0.1e0 AND u >= 2 UNION ALL SELECT vec_id, 2, u, v FROM px WHERE e > 0.2e0) SELECT vec_id, mask_id, u, v, round(z, 6) AS z FROM dp JOIN m USING (vec_id, u, v) WHERE z <= 25")
def _(fx):
    """Three masks of each raster: one row set a mask, cut off at 25."""
    over = lambda t: M.encoded(F.transform("embedding", lambda e: e.cast("double") > t), 8)
    rows = fx.raw("embeddings").select("vec_id", "embedding", F.posexplode(F.array(over(0.0), M.moved(over(0.1), -2, 0, 8, 8), over(0.2))).alias("mask_id", "mask"))
    return R.kept_pixels(masked_points(rows, "mask", "vec_id", "mask_id"), cut_off=25.0).select("vec_id", "mask_id", "u", "v", F.round("z", 6).alias("z"))


RUN_CROPPED = CROPPED.rsplit("\nSELECT", 1)[0] + ", mk AS (SELECT vec_id, nx0, ny0, nx1, ny1, i + nx0 AS u, j + ny0 AS v FROM sm JOIN px USING (vec_id, u, v) WHERE e > 0.15e0) " + runs_sql("mk", "vec_id, nx0, ny0, nx1, ny1")


@query("m5_f25_run_instances_to_original", f"SELECT vec_id, nx0 AS rx0, ny0 AS ry0, nx1 AS rx1, ny1 AS ry1, runs, area FROM ({RUN_CROPPED})")
def _(fx):
    """Masks of resized crops as runs in the original image: the region outward to whole pixels, the mask resampled to it."""
    e = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    crop = dict(zip(("cx0", "cy0", "cx1", "cy1"), D.crop_window(10 + 40 * e(0), 5 + 40 * e(1), 40 + 60 * e(2), 50 + 60 * e(3)), strict=True))
    rows = mask_rows(fx, 0.15).withColumns(crop).where("cx1 > cx0 AND cy1 > cy0").where(F.size("mask") > 0)
    rows = R.run_instances_to_original(rows, tuple(F.col(c) for c in crop), (8, 8))
    return shown(rows, "vec_id", "rx0", "ry0", "rx1", "ry1")


COLOURED = DEPTH + """, pt AS (SELECT vec_id, (u - 4.08e0) * z / 6.33e0 AS x, (v - 2.455e0) * z / 6.33e0 AS y, z, (u * 32 % 256) / 255e0 AS red, (v * 48 % 256) / 255e0 AS green, (u * v % 256) / 255e0 AS blue FROM dp),
lo AS (SELECT vec_id, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pt GROUP BY 1)
SELECT vec_id, CAST(floor((x - lx + 1.5e0) / 3) AS BIGINT) AS ix, CAST(floor((y - ly + 1.5e0) / 3) AS BIGINT) AS iy, CAST(floor((z - lz + 1.5e0) / 3) AS BIGINT) AS iz, count(*) AS n_points,
  round(avg(x), 6) + 0e0 AS x, round(avg(y), 6) + 0e0 AS y, round(avg(z), 6) + 0e0 AS z, round(avg(red), 6) AS red, round(avg(green), 6) AS green, round(avg(blue), 6) AS blue FROM pt JOIN lo USING (vec_id) GROUP BY 1, 2, 3, 4"""


@query("a11_coloured_voxels", COLOURED)
def _(fx):
    """Every point has the colour of its pixel; cells have the mean of both."""
    shade = lambda c: c % 256 / 255
    points = R.depth_points(raster(fx), K8).withColumns({"red": shade(F.col("u") * 32), "green": shade(F.col("v") * 48), "blue": shade(F.col("u") * F.col("v"))})
    cells = R.voxels(points, 3.0, ["vec_id"], ("red", "green", "blue"))
    return cells.select("vec_id", "ix", "iy", "iz", "n_points", *rounded(x="x", y="y", z="z", red="red", green="green", blue="blue"))


@query("u1_c6_coloured_comparison", DEPTH + """, pt AS (SELECT vec_id, 1 AS pseudo, (u - 4.08e0) * z / 6.33e0 AS x, (v - 2.455e0) * z / 6.33e0 AS y, z, 1e0 AS red, 0e0 AS green, 0e0 AS blue FROM dp WHERE NOT sky UNION ALL
  SELECT vec_id, 0, (u - 4.08e0) * z / 6.33e0, (v - 2.455e0) * z / 6.33e0, z + 1, 0.117647e0, 0.564706e0, 1e0 FROM dp WHERE mask),
lo AS (SELECT vec_id, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pt GROUP BY 1)
SELECT vec_id, CAST(floor((x - lx + 4) / 8) AS BIGINT) AS ix, CAST(floor((y - ly + 4) / 8) AS BIGINT) AS iy, CAST(floor((z - lz + 4) / 8) AS BIGINT) AS iz, CAST(sum(pseudo) AS BIGINT) AS n_pseudo, CAST(sum(1 - pseudo) AS BIGINT) AS n_measured,
  round(avg(x), 6) + 0e0 AS x, round(avg(red), 4) AS red, round(avg(green), 4) AS green, round(avg(blue), 4) AS blue FROM pt JOIN lo USING (vec_id) GROUP BY 1, 2, 3, 4""")
def _(fx):
    """Two clouds in one, each in its colour, and cells of both."""
    points = R.depth_points(raster(fx), K8)
    measured = R.kept_pixels(points, mask=F.col("mask")).withColumn("z", F.col("z") + 1)
    cells = R.compared_clouds(R.kept_pixels(points, sky=F.col("sky")), measured, ["vec_id"], 8.0, coloured=True)
    return cells.select("vec_id", "ix", "iy", "iz", "n_pseudo", "n_measured", *rounded(x="x"), *(F.round(c, 4).alias(c) for c in ("red", "green", "blue")))
