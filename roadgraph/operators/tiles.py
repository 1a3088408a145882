"""Operators on pixel tables (tile_id, r, c, ...): resampling, stretching, filtering, rasterising, blending.

A mask is sparse: one row per foreground pixel; tiles(tile_id, h, w) gives the sizes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadgraph.functions.columns import CHANNEL_MEAN, CHANNEL_STD, road_width, sigmoid

#: Pixels that one task blurs, about.
PIXELS = 250_000


def resample_nearest(px: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """Pixels of size x size tiles; each takes the source pixel floor((i + 0.5) * S / T)."""
    t = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    src = lambda i, s: F.floor((F.col(i) + 0.5) * F.col(s) / size)
    rows = tiles.select("tile_id", "h", "w", t.alias("r2")).withColumn("r", src("r2", "h"))
    cols = tiles.select("tile_id", t.alias("c2"), "w").withColumn("c", src("c2", "w"))
    rest = [x for x in px.columns if x not in ("tile_id", "r", "c")]
    by_row = px.join(rows.select("tile_id", "r", "r2"), ["tile_id", "r"])
    return by_row.join(cols.select("tile_id", "c", "c2"), ["tile_id", "c"]).select("tile_id", F.col("r2").alias("r"), F.col("c2").alias("c"), *rest)


def letterbox(tiles: DataFrame, size: int = 512) -> DataFrame:
    """new_h, new_w, off_r, off_c of each tile when fitted into size x size, centred."""
    scale = F.lit(float(size)) / F.greatest("w", "h")
    t = tiles.withColumn("new_w", (F.col("w") * scale).cast("int")).withColumn("new_h", (F.col("h") * scale).cast("int"))
    return t.withColumn("off_r", F.floor((size - F.col("new_h")) / 2).cast("int")).withColumn("off_c", F.floor((size - F.col("new_w")) / 2).cast("int"))


def _stretched(px: DataFrame, keys: list[str], change: Column, cut: bool) -> DataFrame:
    ends = px.groupBy(*keys).agg(F.expr("percentile(v, array(0.02, 0.98))").alias("p"), F.max("v").alias("top"))
    lo, hi = F.col("p")[0], F.col("p")[1]
    v = (F.greatest(lo, F.least(hi, F.col("v"))) - lo) / (hi - lo + (1e-8 if cut else 0)) * 255
    out = F.when(change, F.floor(v) if cut else v).otherwise(F.col("v")).cast("double")
    return px.join(ends, keys).withColumn("v", out).drop("p", "top")


def stretch_image(px: DataFrame) -> DataFrame:
    """Tiles with any value over 255 are stretched from their 2nd to their 98th percentile, all bands together."""
    return _stretched(px, ["tile_id"], F.col("top") > 255, True)


def stretch_bands(px: DataFrame) -> DataFrame:
    """Each band of a tile is stretched by its own percentiles if they are more than 10 apart."""
    return _stretched(px, ["tile_id", "band"], F.col("p")[1] - F.col("p")[0] > 10, False)


def normalize(px: DataFrame) -> DataFrame:
    """(v / 255 - mean) / deviation of the band."""
    mean, std = (F.array(*map(F.lit, x))[F.col("band")] for x in (CHANNEL_MEAN, CHANNEL_STD))
    return px.withColumn("v", (F.col("v") / 255 - mean) / std)


def threshold(px: DataFrame, t: float = 0.5, logit: str = "logit") -> DataFrame:
    """Foreground pixels: probability over t. The test is on the logit, so it can be pushed to the scan."""
    return px.filter(F.col(logit) > math.log(t / (1 - t))).withColumn("p", sigmoid(F.col(logit)))


def binarize(px: DataFrame, level: float = 127) -> DataFrame:
    return px.filter(F.col("v") > level)


def gaussian_kernel(spark, radius: float) -> DataFrame:
    """(dr, dc, k) of a Gaussian with deviation radius, cut at three deviations, sum 1."""
    reach = math.ceil(3 * radius)
    cells = [(i, j, math.exp(-(i * i + j * j) / (2 * radius * radius))) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    total = sum(k for *_, k in cells)
    return spark.createDataFrame([(i, j, k / total) for i, j, k in cells], "dr int, dc int, k double")


def convolve(px: DataFrame, kernel: DataFrame) -> DataFrame:
    """Weighted sum over each pixel's neighbourhood, divided by the weights that lie on the tile. kernel: its size is fixed."""
    keys = [c for c in ("tile_id", "band") if c in px.columns]
    spread = px.join(F.broadcast(kernel)).select(*keys, (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), (F.col("v") * F.col("k")).alias("x"), "k")
    sums = spread.groupBy(*keys, "r", "c").agg((F.sum("x") / F.sum("k")).alias("blur"))
    return px.join(sums, [*keys, "r", "c"])


def blur(px: DataFrame, radius: float) -> DataFrame:
    """Adds blur: the Gaussian mean of each pixel's neighbourhood, over the pixels that there are. A Gaussian is a product of
    one along rows and one along columns, so each pixel is sent to 2 * (6 * radius + 1) places, not to the square of that.
    Pixels are dealt by the line along which they are summed before they are sent, so what is sent is summed in its task; there
    are as many parts as keep one at about PIXELS pixels, at any size of the input."""
    keys = [c for c in ("tile_id", "band") if c in px.columns]
    reach = math.ceil(3 * radius)
    parts = max(px.sparkSession.sparkContext.defaultParallelism, -(-px.count() // PIXELS))
    steps = F.array(*(F.struct(F.lit(i).alias("d"), F.lit(math.exp(-i * i / (2 * radius * radius))).alias("k")) for i in range(-reach, reach + 1)))

    def along(sums: DataFrame, at: str, other: str) -> DataFrame:
        sent = sums.repartition(parts, *keys, other).select(*keys, other, at, "x", "k", F.explode(steps).alias("s")).select(*keys, other, (F.col(at) + F.col("s.d")).alias(at), (F.col("x") * F.col("s.k")).alias("x"), (F.col("k") * F.col("s.k")).alias("k"))
        return sent.groupBy(*keys, "r", "c").agg(F.sum("x").alias("x"), F.sum("k").alias("k"))

    both = along(along(px.select(*keys, "r", "c", F.col("v").alias("x"), F.lit(1.0).alias("k")), "c", "r"), "r", "c")
    return px.join(both.select(*keys, "r", "c", (F.col("x") / F.col("k")).alias("blur")), [*keys, "r", "c"])


def unsharp(px: DataFrame, radius: float = 2, amount: float = 0.3) -> DataFrame:
    """v + amount * (v - blur), clipped to 0..255."""
    v = F.col("v") + amount * (F.col("v") - F.col("blur"))
    return blur(px, radius).withColumn("v", F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).drop("blur")


def sample_grid(cities: DataFrame, per_city: int = 8) -> DataFrame:
    """Sample points around each city, offsets -3, -1, 1, 3 in x then y, the first per_city of them."""
    offsets = F.array(*map(F.lit, (-3, -1, 1, 3)))
    x = cities.select("*", F.posexplode(offsets).alias("i", "dx"))
    xy = x.select("*", F.posexplode(offsets).alias("j", "dy")).withColumn("sample", F.col("i") * 4 + F.col("j"))
    return xy.filter(F.col("sample") < per_city).select(*cities.columns, "sample", "dx", "dy")


def to_pixel_space(vertices: DataFrame, geo: DataFrame, size: int) -> DataFrame:
    """World coordinates to pixels of size x size tiles. geo(tile_id, a, b, c, d, e, f, src_w, src_h): x = a col + b row + c,
    y = d col + e row + f. Every part of a geometry is projected."""
    det = F.col("a") * F.col("e") - F.col("b") * F.col("d")
    x, y = F.col("x") - F.col("c"), F.col("y") - F.col("f")
    col, row = (F.col("e") * x - F.col("b") * y) / det, (F.col("a") * y - F.col("d") * x) / det
    keep = vertices.columns
    return vertices.join(geo, "tile_id").withColumn("px", col * size / F.col("src_w")).withColumn("py", row * size / F.col("src_h")).select(*keep, "px", "py")


def patch_grid(tiles: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Patches (tile_id, patch_r, patch_c). Without overlap only whole ones; with it, enough to cover a padded tile."""
    stride = size - overlap
    last = lambda d: F.col(d) - size if not overlap else F.greatest(F.lit(0), F.ceil((F.col(d) - size) / stride)) * stride
    ok = tiles.filter((F.col("h") >= size) & (F.col("w") >= size)) if not overlap else tiles
    steps = lambda d: F.explode(F.sequence(F.lit(0).cast("long"), last(d).cast("long"), F.lit(stride).cast("long")))
    return ok.withColumn("patch_r", steps("h")).withColumn("patch_c", steps("w")).select("tile_id", "patch_r", "patch_c")


def pixels_to_patches(px: DataFrame, tiles: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Pixels with each patch that holds them; a pixel's patches follow from its place, so no join of all pairs."""
    stride = size - overlap
    own = lambda x: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(x) - size) / stride) + 1).cast("long"), F.floor(F.col(x) / stride).cast("long")))
    at = px.withColumn("i", own("r")).withColumn("j", own("c")).withColumn("patch_r", F.col("i") * stride).withColumn("patch_c", F.col("j") * stride).drop("i", "j")
    return at.join(patch_grid(tiles, size, overlap), ["tile_id", "patch_r", "patch_c"])


def rasterize(segments: DataFrame, half_width: float = 4.0, size: int | None = None) -> DataFrame:
    """Pixels (tile_id, r, c) whose centre lies within half_width of a segment (r0, c0)-(r1, c1), flat at its ends.

    Candidates are the pixels of each segment's bounding box. A column half_width in segments overrides the argument.
    """
    hw = F.col("half_width") if "half_width" in segments.columns else F.lit(float(half_width))
    box = lambda a, b: F.sequence(F.floor(F.least(a, b) - hw).cast("long"), F.ceil(F.greatest(a, b) + hw).cast("long"))
    cand = segments.withColumn("hw", hw).withColumn("r", F.explode(box("r0", "r1"))).withColumn("c", F.explode(box("c0", "c1")))
    dr, dc = F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")
    pr, pc = F.col("r") - F.col("r0"), F.col("c") - F.col("c0")
    along, len2 = pr * dr + pc * dc, dr * dr + dc * dc
    cross = pr * dc - pc * dr
    hit = cand.filter((len2 > 0) & (along >= 0) & (along <= len2) & (cross * cross <= F.col("hw") * F.col("hw") * len2))
    inside = (F.col("r") >= 0) & (F.col("c") >= 0)
    if size is not None:
        inside = inside & (F.col("r") < size) & (F.col("c") < size)
    return hit.filter(inside).select("tile_id", "r", "c").distinct()


def rasterize_typed(segments: DataFrame, types: str = "types", size: int | None = None) -> DataFrame:
    """rasterize with half the width of each segment's road type."""
    return rasterize(segments.withColumn("half_width", road_width(F.col(types)) / 2), size=size)


def straight_points(r0: Column | str, c0: Column | str, r1: Column | str, c1: Column | str) -> Column:
    """Points of a straight path: max(2, ceil(distance))."""
    r0, c0, r1, c1 = (F.col(x) if isinstance(x, str) else x for x in (r0, c0, r1, c1))
    return F.greatest(F.lit(2), F.ceil(F.sqrt((r1 - r0) * (r1 - r0) + (c1 - c0) * (c1 - c0)))).cast("int")


def straight_point(a: Column, b: Column, t: Column, last: Column) -> Column:
    """Coordinate of point t of 0 to last between a and b, halves to even."""
    return F.rint((a + (b - a) * t / last).cast("double")).cast("long")


def straight_path(r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    """array<struct<r, c>> of a straight path's points from one end to the other."""
    last = straight_points(r0, c0, r1, c1) - 1
    point = lambda t, n: F.struct(straight_point(r0, r1, t, n).alias("r"), straight_point(c0, c1, t, n).alias("c"))
    # last is bound once for a path; inside the lambda it would be told anew for each point
    return F.transform(F.array(last), lambda n: F.transform(F.sequence(F.lit(0), n), lambda t: point(t, n)))[0]


def class_mask(mask: DataFrame, critical: DataFrame, destroyed: DataFrame, level: float = 0.7) -> DataFrame:
    """Class of every road pixel: destroyed before critical (crit over level) before normal."""
    k = ["tile_id", "r", "c"]
    both = mask.select(*k).join(critical.select(*k, "crit"), k, "left").join(destroyed.select(*k).distinct().withColumn("gone", F.lit(True)), k, "left")
    return both.select(*k, F.when(F.col("gone"), "destroyed").when(F.col("crit") > level, "critical").otherwise("normal").alias("class"))


def blend_patches(pred: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """One probability per pixel from overlapping patches (tile_id, patch_r, patch_c, r, c in the tile, p), weighted by a
    Gaussian around each patch's centre."""
    y, x = F.col("r") - F.col("patch_r") - size / 2, F.col("c") - F.col("patch_c") - size / 2
    g = F.exp(-(x * x + y * y) / (2 * (size / 4) ** 2))
    sums = pred.groupBy("tile_id", "r", "c").agg((F.sum(F.col("p") * g) / F.greatest(F.sum(g), F.lit(1e-8))).alias("p"))
    return sums.join(tiles, "tile_id").filter("r < h and c < w").select("tile_id", "r", "c", "p")


def flip_mean(pred: DataFrame, tiles: DataFrame) -> DataFrame:
    """Mean of the predictions on a tile and on its mirror images: flip is none, h, v or hv."""
    c = F.when(F.col("flip").isin("h", "hv"), F.col("w") - 1 - F.col("c")).otherwise(F.col("c"))
    r = F.when(F.col("flip").isin("v", "hv"), F.col("h") - 1 - F.col("r")).otherwise(F.col("r"))
    back = pred.join(tiles, "tile_id").select("tile_id", r.alias("r"), c.alias("c"), "p")
    return back.groupBy("tile_id", "r", "c").agg(F.avg("p").alias("p"))
