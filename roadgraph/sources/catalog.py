"""File catalogues, readers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadgraph.functions.columns import extension, image_id, stem
from roadgraph.plans.loops import kept

# fixed values: order of extensions by which one of several files with one stem is taken
IMAGE_ORDER = (".tif", ".tiff", ".png", ".jpg", ".jpeg")
MASK_ORDER = (".png", ".tif", ".tiff", ".jpg", ".jpeg")


def described(paths: DataFrame) -> DataFrame:
    """Adds stem, ext and image_id to a table with a column path."""
    p = F.col("path")
    return paths.withColumn("stem", stem(p)).withColumn("ext", extension(p)).withColumn("image_id", image_id(stem(p)))


def catalog(spark: SparkSession, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    """Files below a folder with one of the extensions, whatever their case: path, stem, ext, image_id. Contents are not
    read; files without any are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return described(files).filter(F.col("ext").isin([e.lower() for e in extensions]))


def read_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels of 8-bit images: tile_id, r, c, band, v. The first three bands stay; one or two are repeated to three."""
    img = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(folder).select("image.*")
    n, w = F.col("nChannels"), F.col("width")
    size = F.col("height") * w
    at = img.select(stem(F.col("origin")).alias("tile_id"), "data", n.alias("n"), w.alias("w"), F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
    bands = at.withColumn("band", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    have = F.least(F.col("n"), F.lit(3))
    # bytes are row by row and in the order blue, green, red, alpha
    own = F.pmod(F.col("band"), have)
    place = F.col("i") * F.col("n") + F.when(F.col("n") >= 3, 2 - own).otherwise(own)
    byte = F.conv(F.hex(F.substring(F.col("data"), place + 1, F.lit(1))), 16, 10).cast("int")
    return bands.select("tile_id", F.floor(F.col("i") / F.col("w")).cast("int").alias("r"), (F.col("i") % F.col("w")).alias("c"), "band", byte.alias("v"))


def dedup_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds kept: true for the first row of each key by order."""
    return df.withColumn("kept", F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1)


def pair_catalog(images: DataFrame, vectors: DataFrame) -> DataFrame:
    """image_id, image_path, vector_path and status: matched, missing_image or missing_vector. Ids are unique on each side."""
    both = images.select("image_id", F.col("path").alias("image_path")).join(vectors.select("image_id", F.col("path").alias("vector_path")), "image_id", "full_outer")
    status = F.when(F.col("image_path").isNull(), "missing_image").when(F.col("vector_path").isNull(), "missing_vector").otherwise("matched")
    return both.withColumn("status", status)


def pair_by_suffix(files: DataFrame, first: str = "_sat", second: str = "_mask") -> DataFrame:
    """Files X<first>.* and X<second>.png of one folder: first_path, second_path. Others are left out."""
    folder = F.regexp_replace(F.col("path"), r"[^/]*$", "")
    own = files.select("path", folder.alias("folder"), stem(F.col("path")).alias("stem"), extension(F.col("path")).alias("ext"))
    a = own.filter(F.col("stem").endswith(first)).select("folder", F.regexp_replace("stem", first, "").alias("id"), F.col("path").alias("first_path"))
    b = own.filter(F.col("stem").endswith(second) & (F.col("ext") == ".png")).select("folder", F.regexp_replace("stem", f"{second}$", "").alias("id"), F.col("path").alias("second_path"))
    return a.join(b, ["folder", "id"]).select("id", "first_path", "second_path")


def prefer_ext(files: DataFrame, order: tuple[str, ...] = IMAGE_ORDER, key: str = "stem") -> DataFrame:
    """One file for each key: the extension that comes first in order, then the path. Other extensions are left out."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("ext"))
    return files.filter(F.col("ext").isin(*order)).groupBy(key).agg(F.min_by("path", F.struct(place, F.col("path"))).alias("path"))


def read_roads(spark: SparkSession, folder: str) -> DataFrame:
    """Vertices of the lines in GeoJSON files: path, feature, part, place, x, y, properties. Files hold one collection each."""
    text = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).withColumn("path", F.input_file_name())
    return road_vertices(text.select("path", F.col("value").alias("json")))


def road_vertices(files: DataFrame) -> DataFrame:
    """The same from rows (path, json). Geometries that are no lines and empty ones are dropped; so are unreadable files."""
    shape = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    f = files.select("path", F.posexplode(F.from_json("json", f"struct<{shape}>")["features"]).alias("feature", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "LineString", F.array(F.from_json(text, "array<array<double>>"))).when(kind == "MultiLineString", F.from_json(text, "array<array<array<double>>>"))
    p = f.select("path", "feature", F.col("f.properties").alias("properties"), F.posexplode(parts).alias("part", "line"))
    v = p.select("path", "feature", "part", "properties", F.posexplode("line").alias("place", "xy"))
    return v.select("path", "feature", "part", "place", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"), "properties")


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of work whose key has no output yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header; doubles as text with six decimals, nulls as nothing."""
    kinds = dict(df.dtypes)
    df.select(*(F.when(F.col(c).isNotNull(), F.format_string("%.6f", F.col(c))).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns)).write.mode("overwrite").csv(path, header=True)


def write_splits(df: DataFrame, path: str) -> None:
    """Text files of stems, one folder for each value of split."""
    df.select("split", F.col("stem").alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def write_pixels(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Parquet in folders by a hash of tile_id, so that reading some tiles reads few folders."""
    df.withColumn("bucket", F.pmod(F.xxhash64("tile_id"), F.lit(buckets)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def add_tiles(df: DataFrame, table: str, replace: bool = False, parts: int = 16, buckets: int = 8) -> None:
    """Adds the tiles of df to a table that is bucketed by tile_id, so that joins and groups by tile_id need no exchange.

    A resumed run may hand in tiles that are there: they stay as they are, or are replaced, all other tiles stay in both
    cases. Tiles that the table holds are the list of what is finished, as a run's files appear when it ends. Replacing
    rewrites the parts (by a hash of tile_id) that hold a tile of df, and no others. Columns: as in the first run.
    """
    spark = df.sparkSession
    own = df.withColumn("part", F.pmod(F.xxhash64("tile_id"), F.lit(parts)).cast("int"))
    dealt = lambda x: x.repartition("part", F.pmod(F.hash("tile_id"), F.lit(buckets)))
    if not spark.catalog.tableExists(table):
        dealt(own).write.partitionBy("part").bucketBy(buckets, "tile_id").sortBy("tile_id").saveAsTable(table)
        return
    have = spark.table(table)
    own = own.select(*have.columns)
    if not replace:
        dealt(pending(own, have, "tile_id")).write.insertInto(table)
        return
    own = kept(own)
    touched = have.join(F.broadcast(own.select("part").distinct()), "part", "left_semi").select(*have.columns)
    whole = kept(pending(touched, own, "tile_id").union(own))
    mode, before = "spark.sql.sources.partitionOverwriteMode", spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set(mode, "dynamic")  # insertInto takes it from the session only
    try:
        dealt(whole).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(mode, before)
