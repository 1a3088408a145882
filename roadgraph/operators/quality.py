"""Scores of predicted masks, tiles, patches and training runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-7
K = ["tile_id", "r", "c"]
#: Pixels of a part of the soft centre lines, about.
PIXELS = 100_000
#: The eight neighbours, row by row.
AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


def offsets(cells: list[tuple[int, int]]):
    """A column of structs (dr, dc) to explode."""
    return F.array(*(F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i, j in cells))


def shifted(px: DataFrame, cells: list[tuple[int, int]], *keep: str) -> DataFrame:
    """Every pixel once for each offset, moved by it."""
    at = px.select("tile_id", "r", "c", *keep, F.explode(offsets(cells)).alias("o"))
    return at.select("tile_id", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), *keep, "o")


def half_widths(radius: float) -> list[int]:
    """For each row of a disk, from its middle on, how far it reaches to either side."""
    return [max(j for j in range(int(radius) + 1) if i * i + j * j <= radius * radius) for i in range(int(radius) + 1)]


def near_mask(px: DataFrame, other: DataFrame, radius: float) -> DataFrame:
    """Pixels of px with a pixel of other at most radius away (none for a negative radius); px keeps its columns and repeated rows.

    Separable: along columns each pixel of other is sent to 2 * radius + 1 rows, of which each (row, column) keeps the nearest;
    along rows a running maximum and a running minimum of how far the pixels so far reach tell who is covered.
    """
    if radius < 0:
        return px.limit(0)
    widths = half_widths(radius)
    n = len(widths) - 1
    sent = other.dropna(subset=K).select("tile_id", "c", F.col("r").alias("at"), F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("d"))
    near = sent.groupBy("tile_id", (F.col("at") + F.col("d")).alias("r"), "c").agg(F.min(F.abs("d")).alias("g"))
    reach = F.element_at(F.array(*map(F.lit, widths)), F.col("g") + 1)
    row = F.struct(*px.columns)
    asked = px.dropna(subset=K).select(*K, F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"), row.alias("row"))
    both = asked.unionByName(near.select(*K, (F.col("c") - reach).cast("long").alias("low"), (F.col("c") + reach).cast("long").alias("high")), allowMissingColumns=True)
    w = Window.partitionBy("tile_id", "r")
    met = both.withColumn("high", F.max("high").over(w.orderBy("c"))).withColumn("low", F.min("low").over(w.orderBy(F.desc("c"))))
    return met.filter(F.col("row").isNotNull() & ((F.col("high") >= F.col("c")) | (F.col("low") <= F.col("c")))).select("row.*")


def confusion(pred: DataFrame, truth: DataFrame, tiles: DataFrame) -> DataFrame:
    """tp, fp, fn of every tile, also of tiles that both masks leave empty."""
    both = pred.select(*K).withColumn("p", F.lit(1)).join(truth.select(*K).withColumn("t", F.lit(1)), K, "full_outer")
    p, t = F.col("p").isNotNull(), F.col("t").isNotNull()
    n = both.groupBy("tile_id").agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    return tiles.select("tile_id").join(n, "tile_id", "left").na.fill(0, ["tp", "fp", "fn"])


def pixel_metrics(pred: DataFrame, truth: DataFrame, tiles: DataFrame) -> DataFrame:
    """tile_id, iou, dice, precision, recall, f1."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = (tp + EPS) / (tp + fp + EPS), (tp + EPS) / (tp + fn + EPS)
    return confusion(pred, truth, tiles).select(
        "tile_id", ((tp + EPS) / (tp + fp + fn + EPS)).alias("iou"), ((2 * tp + EPS) / (2 * tp + fp + fn + EPS)).alias("dice"),
        p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + EPS)).alias("f1"),
    )


def relaxed_iou(pred: DataFrame, truth: DataFrame, tiles: DataFrame, radius: float = 3) -> DataFrame:
    """tile_id, relaxed_iou: pixels count as hit within radius. Both masks empty: 1; one empty: 0."""
    size = lambda df, name: df.groupBy("tile_id").agg(F.count(F.lit(1)).alias(name))
    t = tiles.select("tile_id")
    for df, name in ((pred, "n_p"), (truth, "n_t"), (near_mask(pred, truth, radius), "hit_p"), (near_mask(truth, pred, radius), "hit_t")):
        t = t.join(size(df, name), "tile_id", "left")
    t = t.na.fill(0)
    p, r = F.col("hit_p") / (F.col("n_p") + EPS), F.col("hit_t") / (F.col("n_t") + EPS)
    both, one = (F.col("n_p") == 0) & (F.col("n_t") == 0), (F.col("n_p") == 0) | (F.col("n_t") == 0)
    return t.select("tile_id", F.when(both, 1.0).when(one, 0.0).otherwise(p * r / (p + r - p * r + EPS)).alias("relaxed_iou"))


def batch_scores(pred: DataFrame, truth: DataFrame, tiles: DataFrame) -> DataFrame:
    """Mean IoU and F1 over the tiles, one row."""
    return pixel_metrics(pred, truth, tiles).agg(F.avg("iou").alias("iou"), F.avg("f1").alias("f1"))


def _line(how, value: str, along: str) -> Column:
    """how(value) over a pixel and its two neighbours in its row (along c) or column (along r) of a dense table."""
    across = "r" if along == "c" else "c"
    return how(value).over(Window.partitionBy("tile_id", across).orderBy(along).rowsBetween(-1, 1))


def _eroded(px: DataFrame, value: str, out: str, lines: str) -> DataFrame:
    """Least value in the cross of five pixels. Here and below lines says in which order windows run along rows and columns: one
    that runs as the one before it needs no sort."""
    return px.withColumn("_a", _line(F.min, value, lines[0])).withColumn(out, F.least("_a", _line(F.min, value, lines[1]))).drop("_a")


def _opened(px: DataFrame, value: str, out: str, lines: str) -> DataFrame:
    """Erosion, then the largest value in the square of nine pixels."""
    own = _eroded(px, value, "_e", lines).withColumn("_m", _line(F.max, "_e", lines[1]))
    return own.withColumn(out, _line(F.max, "_m", lines[0])).drop("_e", "_m")


def _soft_skeleton(px: DataFrame, iters: int) -> DataFrame:
    """Soft centre line of a dense table with values v in 0..1, as column skel: what openings of ever smaller
    erosions lose. Dealt by tile once; every window then runs where its tile is. There are as many parts as keep one at about
    PIXELS pixels, or one tile, at any size of the input, as a task holds several sorts of its part."""
    above = lambda a, b: F.greatest(F.lit(0.0), F.col(a) - F.col(b))
    parts = max(px.sparkSession.sparkContext.defaultParallelism, -(-px.count() // PIXELS))
    now = px.select(*K, "v").repartition(parts, "tile_id")
    lines = "cr"
    now = _opened(now, "v", "o", lines).withColumn("skel", above("v", "o"))
    for _ in range(iters):
        now = _opened(_eroded(now, "v", "e", lines), "e", "o", lines[::-1]).withColumn("d", above("e", "o"))
        now = now.select(*K, F.col("e").alias("v"), (F.col("skel") + F.greatest(F.lit(0.0), F.col("d") - F.col("skel") * F.col("d"))).alias("skel"))
        lines = lines[::-1]
    return now.select(*K, "skel")


def cl_dice(prob: DataFrame, truth: DataFrame, iters: int = 3) -> DataFrame:
    """tile_id, cl_dice: 1 - 2 tp ts / (tp + ts + EPS), with tp and ts the shares of each soft centre line that lies on
    the other mask, smoothed by 1. Both tables are dense, with v in 0..1."""
    p = prob.select(*K, F.col("v").alias("pv")).join(_soft_skeleton(prob, iters).withColumnRenamed("skel", "ps"), K)
    t = truth.select(*K, F.col("v").alias("tv")).join(_soft_skeleton(truth, iters).withColumnRenamed("skel", "ts"), K)
    s = p.join(t, K).groupBy("tile_id").agg(
        ((F.sum(F.col("ps") * F.col("tv")) + 1) / (F.sum("ps") + 1)).alias("tp"), ((F.sum(F.col("ts") * F.col("pv")) + 1) / (F.sum("ts") + 1)).alias("tn")
    )
    return s.select("tile_id", (1 - 2 * F.col("tp") * F.col("tn") / (F.col("tp") + F.col("tn") + EPS)).alias("cl_dice"))


def validate_tiles(img: DataFrame, mask: DataFrame) -> DataFrame:
    """tile_id, status: corrupt (image mean under 5 or mask mean over 250), empty (mask without a positive value) or valid. Dense tables with v."""
    i = img.groupBy("tile_id").agg(F.avg("v").alias("img_mean"))
    m = mask.groupBy("tile_id").agg(F.avg("v").alias("mask_mean"), F.max("v").alias("mask_max"))
    status = F.when((F.col("img_mean") < 5) | (F.col("mask_mean") > 250), "corrupt").when(F.col("mask_max") == 0, "empty").otherwise("valid")
    return i.join(m, "tile_id").select("tile_id", status.alias("status"))


def road_density(mask: DataFrame, tiles: DataFrame) -> DataFrame:
    n = mask.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"))
    return tiles.join(n, "tile_id", "left").select("tile_id", (F.coalesce("n", F.lit(0)) / (F.col("h") * F.col("w") + 1e-8)).alias("density"))


def summarize(metrics: DataFrame, names: list[str]) -> DataFrame:
    """metric, mean, std (population), min, max."""
    long = metrics.unpivot([], names, "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def tile_score(prob: DataFrame, t: float = 0.5) -> DataFrame:
    """tile_id, continuity (mean probability), n_road (pixels over t). prob is dense with p."""
    return prob.groupBy("tile_id").agg(F.avg("p").alias("continuity"), F.count_if(F.col("p") > t).alias("n_road"))


def select_patches(img: DataFrame, prob: DataFrame, t: float = 0.6, least: int = 500, cap: int = 1000, dark: float = 10, bright: float = 245) -> DataFrame:
    """Patches worth a pseudo label in scan order: not too dark or bright, at least so many road pixels, the first cap of them.

    Both tables have (tile_id, patch_r, patch_c); img has v, prob has p."""
    k = ["tile_id", "patch_r", "patch_c"]
    i = img.groupBy(*k).agg(F.avg("v").alias("mean")).filter(F.col("mean").between(dark, bright))
    p = prob.groupBy(*k).agg(F.count_if(F.col("p") > t).alias("n_road")).filter(F.col("n_road") >= least)
    return i.join(p, k).select(*k, "n_road").orderBy(*k).limit(cap)


def epoch_watch(log: DataFrame, patience: int = 15) -> DataFrame:
    """Adds best_iou (a new best, strictly), waited and stopped to a log (run_id, epoch, vl_loss, vl_iou); rows after a run's stop go.

    waited is 0 where the loss is a new best, 1 where only the IoU is, else one more than before.
    """
    run = Window.partitionBy("run_id").orderBy("epoch")
    past = run.rowsBetween(Window.unboundedPreceding, -1)
    new = lambda x, best, worst: F.col(x) > F.coalesce(F.max(x).over(past), F.lit(worst)) if best == "max" else F.col(x) < F.coalesce(F.min(x).over(past), F.lit(worst))
    marked = log.withColumn("best_loss", new("vl_loss", "min", float("inf"))).withColumn("best_iou", new("vl_iou", "max", 0.0))
    fresh = F.col("best_loss") | F.col("best_iou")
    island = marked.withColumn("island", F.sum(F.when(fresh, 1).otherwise(0)).over(run))
    own = Window.partitionBy("run_id", "island").orderBy("epoch")
    start = F.first(F.when(F.col("best_loss"), 0).when(F.col("best_iou"), 1).otherwise(1)).over(own)
    waited = island.withColumn("waited", (start + F.row_number().over(own) - 1).cast("long")).withColumn("stop", F.col("waited") >= patience)
    before = F.coalesce(F.max(F.col("stop").cast("int")).over(past), F.lit(0))
    return waited.withColumn("over", before).filter("over = 0").select("run_id", "epoch", "best_loss", "best_iou", "waited", F.col("stop").alias("stopped"))
