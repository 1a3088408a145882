"""One query per operator over the derived inputs, and the SQL that DuckDB answers it with. Doubles have six decimals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgraph.fixtures import duck_with, fixture
from roadgraph.functions import columns as C
from roadgraph.operators import centrality as B
from roadgraph.operators import healing as L
from roadgraph.operators import impact as I
from roadgraph.operators import labels as Q
from roadgraph.operators import paths as P
from roadgraph.operators import quality as A
from roadgraph.operators import sampling as X
from roadgraph.operators import sketches as N
from roadgraph.operators import skeleton as K
from roadgraph.operators import tiles as T
from roadgraph.operators.ranking import ranked
from roadgraph.plans.loops import kept
from roadgraph.sources import catalog as S

G = "graph_id"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def six(df: DataFrame) -> DataFrame:
    """Doubles rounded to six decimals; -0 becomes 0."""
    return df.select(*((F.round(F.col(c), 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _joined(with_: str, sql: str) -> str:
    """The inputs' WITH list before sql; a + at sql's start continues the list."""
    more, body = sql.startswith("+"), sql.removeprefix("+")
    if with_.rstrip().endswith(("WITH", "RECURSIVE")):  # only given tables
        return f"{with_} {body}" if more else body
    return f"{with_}{',' if more else ''} {body}"


def query(name: str, *inputs: str, sql: str | None = None, recursive: bool = False):
    """Registers a function of the named inputs."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: six(fn(*(fixture(spark, sf_dir, x) for x in inputs)))
        if sql:
            ORACLE_SQL[name] = _joined(duck_with(*inputs, recursive=recursive), sql.strip())
        return fn

    return add


# catalogue -----------------------------------------------------------------------------------------------------------
STEM = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '')"
IMAGE_ID = rf"lower(trim(regexp_replace(regexp_replace({STEM}, '^SN3_roads_(train|test)_', '', 'gi'), '_(PS-(RGB|MS)|geojson_roads)', '', 'gi'), '_'))"
FILES = rf"+f AS (SELECT side, path, {STEM} AS stem, lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS ext, {IMAGE_ID} AS image_id FROM fx_files)"


@query("S2_catalog", "fx_files", sql=FILES + " SELECT path, stem, ext, image_id FROM f WHERE ext IN ('.tif', '.png')")
def _(files):
    return S.described(files.select("path")).filter(F.col("ext").isin(".tif", ".png"))


@query("S3_image_id", "fx_files", sql=FILES + " SELECT image_id, count(*) AS n FROM f GROUP BY 1")
def _(files):
    return S.described(files).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


FIRST = FILES + ", d AS (SELECT side, image_id, path, row_number() OVER (PARTITION BY side, image_id ORDER BY path) = 1 AS kept FROM f)"


@query("S4_dedup_first", "fx_files", sql=FIRST + " SELECT side || '/' || image_id AS id, path, kept FROM d")
def _(files):
    own = S.described(files).select(F.concat_ws("/", "side", "image_id").alias("id"), "path")
    return S.dedup_first(own, "id", "path")


def _sides(files):
    own = S.described(files)
    first = lambda s: S.dedup_first(own.filter(F.col("side") == s), "image_id", "path").filter("kept")
    return first("img"), first("vec")


@query(
    "S5_pair_catalog", "fx_files",
    sql=FIRST + """ SELECT coalesce(a.image_id, b.image_id) AS image_id, a.path AS image_path, b.path AS vector_path,
        CASE WHEN a.path IS NULL THEN 'missing_image' WHEN b.path IS NULL THEN 'missing_vector' ELSE 'matched' END AS status
        FROM (SELECT * FROM d WHERE kept AND side = 'img') a FULL JOIN (SELECT * FROM d WHERE kept AND side = 'vec') b ON a.image_id = b.image_id""",
)
def _(files):
    return S.pair_catalog(*_sides(files))


@query(
    "S6_suffix_pairs", "part",
    sql="""+x AS (SELECT p_partkey k FROM part) SELECT 'tile' || k AS id, 'd/' || k % 3 || '/tile' || k || '_sat.jpg' AS first_path, 'd/' || k % 3 || '/tile' || k || '_mask.png' AS second_path
        FROM x WHERE k % 5 <> 0 AND k % 7 <> 0""",
)
def _(part):
    k = F.col("p_partkey")
    name = lambda tail: F.concat(F.lit("d/"), (k % 3).cast("string"), F.lit("/tile"), k.cast("string"), F.lit(tail)).alias("path")
    return S.pair_by_suffix(part.filter(k % 5 != 0).select(name("_sat.jpg")).union(part.filter(k % 7 != 0).select(name("_mask.png"))))


@query(
    "S7_prefer_ext", "fx_files",
    sql=FILES + """ SELECT image_id, arg_min(path, ord) AS path FROM (SELECT image_id, path, CAST(list_position(['.tif', '.tiff', '.png', '.jpg', '.jpeg'], ext) AS VARCHAR) || path AS ord
        FROM f WHERE ext IN ('.tif', '.tiff', '.png', '.jpg', '.jpeg')) GROUP BY 1""",
)
def _(files):
    return S.prefer_ext(S.described(files), key="image_id")


@query("S8_road_vertices", "fx_lines", sql="SELECT CAST(tile_id AS VARCHAR) AS path, 0 AS part, p AS place, CAST(r0 + p * dr AS DOUBLE) AS x, CAST(c0 + p * dc AS DOUBLE) AS y, line_id FROM fx_lines CROSS JOIN (SELECT unnest([0, 1]) AS p)")
def _(lines):
    one = lambda a, b: F.concat(F.lit("["), a.cast("string"), F.lit(","), b.cast("string"), F.lit("]"))
    text = F.concat(
        F.lit('{"type":"Feature","geometry":{"type":"LineString","coordinates":['), one(F.col("r0"), F.col("c0")), F.lit(","), one(F.col("r0") + F.col("dr"), F.col("c0") + F.col("dc")),
        F.lit(']},"properties":{"line":"'), F.col("line_id").cast("string"), F.lit('"}}'),
    )
    files = lines.select(F.col("tile_id").cast("string").alias("path"), text.alias("t")).groupBy("path").agg(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("t"), ","), F.lit("]}")).alias("json")
    )
    return S.road_vertices(files).select("path", "part", "place", "x", "y", F.col("properties")["line"].cast("long").alias("line_id"))


@query("S9_pending", "fx_files", sql=FIRST + " SELECT DISTINCT image_id FROM d WHERE side = 'img' AND image_id NOT IN (SELECT image_id FROM d WHERE side = 'vec')")
def _(files):
    own = S.described(files)
    return S.pending(own.filter("side = 'img'").select("image_id").distinct(), own.filter("side = 'vec'"), "image_id")


for _name, _how in (("U1_union", "UNION"), ("U2_intersection", "INTERSECT"), ("U3_difference", "EXCEPT")):

    @query(_name, "fx_files", sql=FILES + f" SELECT image_id FROM f WHERE side = 'img' {_how} SELECT image_id FROM f WHERE side = 'vec'")
    def _(files, how=_how):
        a, b = (S.described(files.filter(F.col("side") == s)).select("image_id") for s in ("img", "vec"))
        return a.union(b).distinct() if how == "UNION" else a.intersect(b) if how == "INTERSECT" else a.subtract(b)


# projections ---------------------------------------------------------------------------------------------------------
TILES = "+t AS (SELECT DISTINCT tile_id, 8 AS h, 8 AS w FROM fx_prob)"


def _tiles(px):
    return px.select("tile_id").distinct().select("tile_id", F.lit(8).alias("h"), F.lit(8).alias("w"))


@query(
    "P1_resample", "fx_prob",
    sql="SELECT p.tile_id, i.i AS r, j.j AS c, round(logit, 6) AS logit FROM fx_prob p JOIN (SELECT unnest(range(12)) AS i) i ON p.r = floor((i.i + 0.5) * 8 / 12) JOIN (SELECT unnest(range(12)) AS j) j ON p.c = floor((j.j + 0.5) * 8 / 12)",
)
def _(px):
    return T.resample_nearest(px, _tiles(px), 12)


@query(
    "P2_letterbox", "part",
    sql="""SELECT tile_id, h, w, nw AS new_w, nh AS new_h, CAST(floor((512 - nh) / 2) AS INT) AS off_r, CAST(floor((512 - nw) / 2) AS INT) AS off_c FROM
        (SELECT tile_id, h, w, CAST(trunc(w * (512.0::DOUBLE / greatest(w, h))) AS INT) AS nw, CAST(trunc(h * (512.0::DOUBLE / greatest(w, h))) AS INT) AS nh FROM
        (SELECT p_partkey AS tile_id, CAST(100 + p_partkey * 37 % 900 AS INT) AS h, CAST(100 + p_partkey * 91 % 900 AS INT) AS w FROM part))""",
)
def _(part):
    k = F.col("p_partkey")
    return T.letterbox(part.select(k.alias("tile_id"), (100 + k * 37 % 900).cast("int").alias("h"), (100 + k * 91 % 900).cast("int").alias("w")))


@query(
    "P3_stretch_image", "fx_img",
    sql="""+i AS (SELECT tile_id, r, c, band, v * 2000 % 3001 AS v FROM fx_img), s AS (SELECT tile_id, quantile_cont(v, 0.02) lo, quantile_cont(v, 0.98) hi, max(v) m FROM i GROUP BY 1)
        SELECT tile_id, r, c, band, round(CASE WHEN m > 255 THEN floor((greatest(lo, least(hi, v)) - lo) / (hi - lo + 1e-8) * 255) ELSE v END, 6) AS v FROM i JOIN s USING (tile_id)""",
)
def _(img):
    return T.stretch_image(img.withColumn("v", F.col("v") * 2000 % 3001))


@query(
    "P4_stretch_bands", "fx_img",
    sql="""+s AS (SELECT tile_id, band, quantile_cont(v, 0.02) lo, quantile_cont(v, 0.98) hi FROM fx_img GROUP BY 1, 2)
        SELECT tile_id, r, c, band, round(CASE WHEN hi - lo > 10 THEN (greatest(lo, least(hi, v)) - lo) / (hi - lo) * 255 ELSE v END, 6) AS v FROM fx_img JOIN s USING (tile_id, band)""",
)
def _(img):
    return T.stretch_bands(img)


@query("P5_normalize", "fx_img", sql="SELECT tile_id, r, c, band, round((v / 255 - [0.485, 0.456, 0.406][band + 1]) / [0.229, 0.224, 0.225][band + 1], 6) AS v FROM fx_img")
def _(img):
    return T.normalize(img)


@query("P6_threshold", "fx_prob", sql="SELECT tile_id, r, c, round(logit, 6) AS logit, round(1 / (1 + exp(-logit)), 6) AS p FROM fx_prob WHERE 1 / (1 + exp(-logit)) > 0.6")
def _(px):
    return T.threshold(px, 0.6)


@query("P7_binarize", "fx_img", sql="SELECT tile_id, r, c, band, v FROM fx_img WHERE v > 127")
def _(img):
    return T.binarize(img)


@query(
    "P8_unsharp", "fx_prob",
    sql="""+k AS (SELECT i, exp(-i * i / 8.0) AS k FROM (SELECT unnest(range(-6, 7)) AS i)),
        v AS (SELECT tile_id, r, c, floor((logit + 8) * 15) AS v FROM fx_prob),
        x AS (SELECT v.tile_id, v.r, v.c + i AS c, sum(v * k) AS s, sum(k) AS n FROM v CROSS JOIN k GROUP BY 1, 2, 3),
        b AS (SELECT x.tile_id, x.r + i AS r, x.c, sum(s * k) / sum(n * k) AS blur FROM x CROSS JOIN k GROUP BY 1, 2, 3)
        SELECT tile_id, r, c, round(greatest(0, least(255, v + 0.3 * (v - blur))), 6) AS v FROM v JOIN b USING (tile_id, r, c)""",
)
def _(px):
    v = px.select("tile_id", "r", "c", F.floor((F.col("logit") + 8) * 15).cast("double").alias("v"))
    return T.unsharp(v, 2)


@query(
    "P9_latlon_to_pixel", "fx_city",
    sql="SELECT city_id, CAST(trunc((lon + 180) / 360 * 512) AS INT) AS x, CAST(trunc((80 - lat) / 160 * 512) AS INT) AS y FROM fx_city",
)
def _(city):
    x, y = C.latlon_to_pixel(F.col("lat"), F.col("lon"), F.lit(80.0), F.lit(-80.0), F.lit(-180.0), F.lit(180.0), 512)
    return city.select("city_id", x.alias("x"), y.alias("y"))


TILE = """+z AS (SELECT city_id, lat, lon, greatest(0, least(65535, CAST(floor((lon / 360.0 + 0.5) * 65536) AS BIGINT))) AS x,
    greatest(0, least(65535, CAST(floor((0.5 - 0.25 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / pi()) * 65536) AS BIGINT))) AS y FROM fx_city)"""


@query("P10_mercator_tile", "fx_city", sql=TILE + " SELECT city_id, x, y, round(x / 65536.0 * 360 - 180, 6) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * y / 65536.0)))), 6) AS north FROM z")
def _(city):
    x, y = C.lonlat_to_tile(F.col("lon"), F.col("lat"), 16)
    at = city.select("city_id", x.alias("x"), y.alias("y"))
    west, north = C.tile_corner(F.col("x"), F.col("y"), 16)
    return at.select("city_id", "x", "y", west.alias("west"), north.alias("north"))


@query(
    "P11_road_width", "part",
    sql="""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 10 WHEN 1 THEN 5 WHEN 2 THEN 8 WHEN 3 THEN 5 WHEN 4 THEN 7 ELSE 4 END AS width FROM part""",
)
def _(part):
    lists = [["motorway"], ["unknown"], ["nothing", "primary"], [], ["secondary", "trunk"], ["service"]]
    types = F.element_at(F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in lists)), (F.col("p_size") % 6 + 1))
    return part.select("p_partkey", C.road_width(types).alias("width"))


@query(
    "P12_sample_grid", "fx_city",
    sql="SELECT city_id, i * 4 + j AS sample, [-3, -1, 1, 3][i + 1] AS dx, [-3, -1, 1, 3][j + 1] AS dy FROM fx_city CROSS JOIN (SELECT unnest(range(2)) AS i) CROSS JOIN (SELECT unnest(range(4)) AS j)",
)
def _(city):
    return T.sample_grid(city.select("city_id"))


@query(
    "P13_to_pixel_space", "fx_lines",
    sql="SELECT tile_id, line_id, round(((r0 * 2.0 + 100) - 100) / 2.0 * 512 / 64, 6) AS px, round(((500 - c0 * 2.0) - 500) / -2.0 * 512 / 64, 6) + 0 AS py FROM fx_lines",
)
def _(lines):
    v = lines.select("tile_id", "line_id", (F.col("r0") * 2.0 + 100).alias("x"), (500 - F.col("c0") * 2.0).alias("y"))
    values = dict(a=2.0, b=0.0, c=100.0, d=0.0, e=-2.0, f=500.0, src_w=64, src_h=64)
    geo = lines.select("tile_id").distinct().select("tile_id", *(F.lit(x).alias(k) for k, x in values.items()))
    return T.to_pixel_space(v, geo, 512).select("tile_id", "line_id", "px", "py")


@query(
    "P14_patch_grid", "part",
    sql="""+t AS (SELECT p_partkey AS tile_id, 20 + p_partkey * 7 % 50 AS h, 20 + p_partkey * 11 % 50 AS w FROM part)
        SELECT tile_id, i * 12 AS patch_r, j * 12 AS patch_c FROM t JOIN (SELECT unnest(range(9)) AS i) ON i <= greatest(0, ceil((h - 16) / 12)) JOIN (SELECT unnest(range(9)) AS j) ON j <= greatest(0, ceil((w - 16) / 12))""",
)
def _(part):
    k = F.col("p_partkey")
    return T.patch_grid(part.select(k.alias("tile_id"), (20 + k * 7 % 50).alias("h"), (20 + k * 11 % 50).alias("w")), 16, 4)


RASTER = """SELECT DISTINCT tile_id, r, c FROM (SELECT l.tile_id, l.r0, l.c0, l.dr, l.dc, r.r, c.c, {hw} AS hw FROM fx_lines l
    JOIN (SELECT unnest(range(64)) AS r) r ON r.r BETWEEN least(r0, r0 + dr) - 9 AND greatest(r0, r0 + dr) + 9 JOIN (SELECT unnest(range(64)) AS c) c ON c.c BETWEEN least(c0, c0 + dc) - 9 AND greatest(c0, c0 + dc) + 9)
    WHERE dr * dr + dc * dc > 0 AND (r - r0) * dr + (c - c0) * dc BETWEEN 0 AND dr * dr + dc * dc AND ((r - r0) * dc - (c - c0) * dr) * ((r - r0) * dc - (c - c0) * dr) <= hw * hw * (dr * dr + dc * dc)"""


def _segments(lines):
    return lines.select("tile_id", "line_id", "r0", "c0", (F.col("r0") + F.col("dr")).alias("r1"), (F.col("c0") + F.col("dc")).alias("c1"))


@query("P15_rasterize", "fx_lines", sql=RASTER.format(hw="4"))
def _(lines):
    return T.rasterize(_segments(lines), 4, 64)


@query("P16_rasterize_typed", "fx_lines", sql=RASTER.format(hw="CASE WHEN line_id % 3 = 0 THEN 5.0 WHEN line_id % 3 = 1 THEN 2.0 ELSE 2.5 END"))
def _(lines):
    kind = F.when(F.col("line_id") % 3 == 0, F.array(F.lit("motorway"))).when(F.col("line_id") % 3 == 1, F.array(F.lit("service"))).otherwise(F.array(F.lit("footway")))
    return T.rasterize_typed(_segments(lines).withColumn("types", kind), size=64)


@query(
    "P17_straight_path", "fx_lines",
    sql="""+p AS (SELECT *, CAST(greatest(2, ceil(sqrt(dr * dr + dc * dc))) AS BIGINT) AS k FROM fx_lines)
        SELECT tile_id, line_id, t AS place, CAST(round_even(CAST(r0 + dr * t / (k - 1) AS DOUBLE), 0) AS BIGINT) AS r, CAST(round_even(CAST(c0 + dc * t / (k - 1) AS DOUBLE), 0) AS BIGINT) AS c
        FROM p JOIN (SELECT unnest(range(100)) AS t) ON t < k""",
)
def _(lines):
    s = _segments(lines)
    path = T.straight_path(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1"))
    return s.select("tile_id", "line_id", F.posexplode(path).alias("place", "p")).select("tile_id", "line_id", "place", "p.r", "p.c")


@query(
    "P18_class_mask", "fx_prob", "fx_skel",
    sql="""+m AS (SELECT * FROM fx_prob WHERE logit > 0) SELECT m.tile_id, m.r, m.c,
        CASE WHEN (m.r + m.c + m.tile_id) % 5 = 0 THEN 'destroyed' WHEN 1 / (1 + exp(-logit)) > 0.7 THEN 'critical' ELSE 'normal' END AS class FROM m""",
)
def _(px, skel):
    m = px.filter("logit > 0")
    return T.class_mask(m, m.withColumn("crit", C.sigmoid(F.col("logit"))), m.filter((F.col("r") + F.col("c") + F.col("tile_id")) % 5 == 0))


@query(
    "P19_edge_class", "fx_edges",
    sql="""SELECT graph_id, u, v, CASE WHEN (u + v) % 7 = 0 THEN 'removed' WHEN w > 40 THEN 'bottleneck' ELSE 'normal' END AS class, round(3 + 4 * (w / 50.0), 6) AS style FROM fx_edges""",
)
def _(e):
    flipped = e.filter((F.col("u") + F.col("v")) % 7 == 0).select(G, F.col("v").alias("u"), F.col("u").alias("v"))
    return I.edge_class(e.withColumn("criticality", F.col("w") / 50.0), flipped, e.filter("w > 40"))


@query("P20_band", "fx_edges", sql="SELECT graph_id, u, v, CASE WHEN p >= 70 THEN 'high' WHEN p >= 40 THEN 'medium' ELSE 'low' END AS band FROM (SELECT *, w * 3 - 20 AS p FROM fx_edges)")
def _(e):
    return e.select(G, "u", "v", C.band((F.col("w") * 3 - 20).cast("double")).alias("band"))


# joins ---------------------------------------------------------------------------------------------------------------
OFF = "(SELECT i, j FROM (SELECT unnest(range(-1, 2)) AS i) CROSS JOIN (SELECT unnest(range(-1, 2)) AS j) WHERE i <> 0 OR j <> 0)"


@query("J2_neighbors", "fx_skel", sql=f"SELECT a.tile_id, a.r, a.c, count(*) AS nb, round(sum(CASE WHEN i * j = 0 THEN 1 ELSE sqrt(2) END), 6) AS cost FROM fx_skel a CROSS JOIN {OFF} o JOIN fx_skel b ON b.tile_id = a.tile_id AND b.r = a.r + i AND b.c = a.c + j GROUP BY 1, 2, 3")
def _(skel):
    near = A.shifted(skel, A.AROUND).join(skel, A.K, "left_semi")
    cost = F.when(F.col("o.dr") * F.col("o.dc") == 0, 1.0).otherwise(2.0**0.5)
    return near.groupBy(*A.K).agg(F.count(F.lit(1)).alias("nb"), F.sum(cost).alias("cost"))


PT = "+p AS (SELECT tile_id, r, c FROM fx_prob WHERE logit > 0), g AS (SELECT CASE WHEN tile_id % 2 = 0 THEN tile_id + 1 ELSE tile_id - 1 END AS tile_id, r, c FROM p), t AS (SELECT DISTINCT tile_id FROM fx_prob)"


def _pred_truth(px):
    p = px.filter("logit > 0").select("tile_id", "r", "c")
    partner = F.when(F.col("tile_id") % 2 == 0, F.col("tile_id") + 1).otherwise(F.col("tile_id") - 1)
    tiles = _tiles(px)
    return p, p.withColumn("tile_id", partner).join(tiles.select("tile_id"), "tile_id", "left_semi"), tiles


@query("J3_near_mask", "fx_prob", sql=PT + " SELECT p.* FROM p WHERE EXISTS (SELECT 1 FROM g WHERE g.tile_id = p.tile_id AND (g.r - p.r) * (g.r - p.r) + (g.c - p.c) * (g.c - p.c) <= 1)")
def _(px):
    p, t, _ = _pred_truth(px)
    return A.near_mask(p, t, 1)


@query(
    "J5_nearest_node", "fx_nodes", "fx_scen",
    sql="""SELECT scenario_id AS point_id, s.graph_id, epi_r AS r, epi_c AS c, n.node_id, n.d2 FROM fx_scen s LEFT JOIN LATERAL (SELECT node_id, (pos_r - epi_r) * (pos_r - epi_r) + (pos_c - epi_c) * (pos_c - epi_c) AS d2
        FROM fx_nodes x WHERE x.graph_id = s.graph_id AND (pos_r - epi_r) * (pos_r - epi_r) + (pos_c - epi_c) * (pos_c - epi_c) <= 2500 ORDER BY 2, 1 LIMIT 1) n ON true""",
)
def _(nodes, scen):
    return I.nearest_node(scen.select(F.col("scenario_id").alias("point_id"), G, F.col("epi_r").alias("r"), F.col("epi_c").alias("c")), nodes, 50)


# customers around one graph of all parts, many of them far from every node
@query(
    "J5_nearest_any", "fx_big_nodes", "fx_city",
    sql="""SELECT point_id, q.graph_id, r, c, arg_min(node_id, ((r - pos_r) * (r - pos_r) + (c - pos_c) * (c - pos_c)) * 1000000 + node_id) AS node_id, min((r - pos_r) * (r - pos_r) + (c - pos_c) * (c - pos_c)) AS d2
        FROM (SELECT city_id AS point_id, CAST(0 AS BIGINT) AS graph_id, city_id * 7919 % 9000 - 2000 AS r, city_id * 613 % 7000 - 1000 AS c FROM fx_city) q JOIN fx_big_nodes n ON n.graph_id = q.graph_id GROUP BY 1, 2, 3, 4""",
)
def _(nodes, city):
    at = lambda k, n, low: (F.col("city_id") * k % n - low)
    return I.nearest_node(city.select(F.col("city_id").alias("point_id"), F.lit(0).cast("long").alias(G), at(7919, 9000, 2000).alias("r"), at(613, 7000, 1000).alias("c")), nodes)


HITS = "+h AS (SELECT scenario_id, s.graph_id, node_id FROM fx_scen s JOIN fx_nodes n ON n.graph_id = s.graph_id AND (pos_r - epi_r) * (pos_r - epi_r) + (pos_c - epi_c) * (pos_c - epi_c) <= radius * radius)"


@query("J6_blast", "fx_nodes", "fx_scen", sql=HITS + " SELECT * FROM h")
def _(nodes, scen):
    return I.blast_hits(nodes, scen)


ALIVE = HITS + """, en AS (SELECT scenario_id, n.node_id FROM fx_scen s JOIN fx_nodes n USING (graph_id) WHERE (scenario_id, node_id) NOT IN (SELECT scenario_id, node_id FROM h)),
    se AS (SELECT scenario_id, u, v, w FROM fx_scen s JOIN fx_edges e USING (graph_id) WHERE (scenario_id, u) NOT IN (SELECT scenario_id, node_id FROM h) AND (scenario_id, v) NOT IN (SELECT scenario_id, node_id FROM h))"""


@query("J7_survivors", "fx_nodes", "fx_edges", "fx_scen", sql=ALIVE + " SELECT scenario_id, u, v, w FROM se")
def _(nodes, edges, scen):
    gone = I.blast_hits(nodes, scen).select(F.col("scenario_id").alias(G), "node_id")
    _, e = B.survivors(I._per_scenario(nodes, scen), I._per_scenario(edges, scen), gone)
    return e.select(F.col(G).alias("scenario_id"), "u", "v", "w")


# aggregations --------------------------------------------------------------------------------------------------------
M = PT + """, n AS (SELECT tile_id, count(p.r) FILTER (g.r IS NOT NULL) AS tp, count(p.r) FILTER (g.r IS NULL) AS fp, count(g.r) FILTER (p.r IS NULL) AS fn FROM p FULL JOIN g USING (tile_id, r, c) GROUP BY 1),
    m AS (SELECT t.tile_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM t LEFT JOIN n USING (tile_id)),
    s AS (SELECT tile_id, (tp + 1e-7) / (tp + fp + fn + 1e-7) AS iou, (2 * tp + 1e-7) / (2 * tp + fp + fn + 1e-7) AS dice, (tp + 1e-7) / (tp + fp + 1e-7) AS precision, (tp + 1e-7) / (tp + fn + 1e-7) AS recall FROM m),
    f AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-7) AS f1 FROM s)"""


@query("A1_pixel_metrics", "fx_prob", sql=M + " SELECT tile_id, round(iou, 6) AS iou, round(dice, 6) AS dice, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def _(px):
    return A.pixel_metrics(*_pred_truth(px))


@query(
    "A2_relaxed_iou", "fx_prob",
    sql=PT + """, np AS (SELECT tile_id, count(*) AS np FROM p GROUP BY 1), nt AS (SELECT tile_id, count(*) AS nt FROM g GROUP BY 1),
        hp AS (SELECT p.tile_id, count(*) AS hp FROM p WHERE EXISTS (SELECT 1 FROM g WHERE g.tile_id = p.tile_id AND (g.r - p.r) * (g.r - p.r) + (g.c - p.c) * (g.c - p.c) <= 1) GROUP BY 1),
        ht AS (SELECT g.tile_id, count(*) AS ht FROM g WHERE EXISTS (SELECT 1 FROM p WHERE g.tile_id = p.tile_id AND (g.r - p.r) * (g.r - p.r) + (g.c - p.c) * (g.c - p.c) <= 1) GROUP BY 1),
        a AS (SELECT t.tile_id, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt, coalesce(hp, 0) / (coalesce(np, 0) + 1e-7) AS p, coalesce(ht, 0) / (coalesce(nt, 0) + 1e-7) AS r
              FROM t LEFT JOIN np USING (tile_id) LEFT JOIN nt USING (tile_id) LEFT JOIN hp USING (tile_id) LEFT JOIN ht USING (tile_id))
        SELECT tile_id, round(CASE WHEN np = 0 AND nt = 0 THEN 1 WHEN np = 0 OR nt = 0 THEN 0 ELSE p * r / (p + r - p * r + 1e-7) END, 6) AS relaxed_iou FROM a""",
)
def _(px):
    return A.relaxed_iou(*_pred_truth(px), 1)


@query("A3_batch_scores", "fx_prob", sql=M + " SELECT round(avg(iou), 6) AS iou, round(avg(f1), 6) AS f1 FROM f")
def _(px):
    return A.batch_scores(*_pred_truth(px))


def _cl_dice_sql() -> str:
    """The soft centre lines of both masks by look-ups of neighbours, one common table for each step."""
    out = [PT.removeprefix("+"), """v0 AS (SELECT 'p' AS k, tile_id, r, c, 1 / (1 + exp(-logit)) AS v FROM fx_prob UNION ALL
        SELECT 't', d.tile_id, d.r, d.c, CASE WHEN g.r IS NULL THEN 0.0 ELSE 1.0 END FROM fx_prob d LEFT JOIN g USING (tile_id, r, c))"""]
    near = "JOIN {b} b ON b.k = a.k AND b.tile_id = a.tile_id AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1"
    for k in range(4):
        v = f"v{k}"
        out.append(f"v{k + 1} AS MATERIALIZED (SELECT a.k, a.tile_id, a.r, a.c, min(b.v) AS v FROM {v} a {near.format(b=v)} AND (a.r = b.r OR a.c = b.c) GROUP BY 1, 2, 3, 4)")
        out.append(f"o{k} AS MATERIALIZED (SELECT a.k, a.tile_id, a.r, a.c, greatest(0, a.v - max(b.v)) AS d FROM {v} a {near.format(b=f'v{k + 1}')} GROUP BY 1, 2, 3, 4, a.v)")
        out.append("s0 AS (SELECT k, tile_id, r, c, d AS s FROM o0)" if not k else f"s{k} AS MATERIALIZED (SELECT k, tile_id, r, c, s + greatest(0, d - s * d) AS s FROM s{k - 1} JOIN o{k} USING (k, tile_id, r, c))")
    out.append("""x AS (SELECT tile_id, (sum(a.s * w.v) FILTER (a.k = 'p') + 1) / (sum(a.s) FILTER (a.k = 'p') + 1) AS tp, (sum(a.s * w.v) FILTER (a.k = 't') + 1) / (sum(a.s) FILTER (a.k = 't') + 1) AS ts
        FROM s3 a JOIN v0 w USING (tile_id, r, c) WHERE a.k <> w.k GROUP BY 1)""")
    return "+" + ", ".join(out) + " SELECT tile_id, round(1 - 2 * tp * ts / (tp + ts + 1e-7), 6) AS cl_dice FROM x"


@query("A4_cl_dice", "fx_prob", sql=_cl_dice_sql())
def _(px):
    v = px.select("tile_id", "r", "c", C.sigmoid(F.col("logit")).alias("v"))
    p, t, tiles = _pred_truth(px)
    dense = px.select("tile_id", "r", "c").join(t.withColumn("v", F.lit(1.0)), A.K, "left").na.fill(0.0, ["v"])
    return A.cl_dice(v, dense, 3)


@query(
    "A5_validate_tiles", "fx_img",
    sql="SELECT tile_id, CASE WHEN avg(v) FILTER (band = 0) < 118 OR avg(v) FILTER (band = 1) * 1.04 > 250 THEN 'corrupt' WHEN max(v) FILTER (band = 1) = 0 THEN 'empty' ELSE 'valid' END AS status FROM fx_img GROUP BY 1",
)
def _(img):
    return A.validate_tiles(img.filter("band = 0").withColumn("v", F.col("v") - 113), img.filter("band = 1").withColumn("v", F.col("v") * 1.04))


@query("A6_road_density", "fx_prob", sql=PT + " SELECT tile_id, round(count(p.r) / (64 + 1e-8), 6) AS density FROM t LEFT JOIN p USING (tile_id) GROUP BY 1")
def _(px):
    p, _, tiles = _pred_truth(px)
    return A.road_density(p, tiles).select("tile_id", "density")


@query(
    "A7_summary", "fx_prob",
    sql=M + """, l AS (SELECT unnest(['iou', 'dice', 'f1']) AS metric, unnest([iou, dice, f1]) AS value FROM f)
        SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM l GROUP BY 1""",
)
def _(px):
    return A.summarize(A.pixel_metrics(*_pred_truth(px)), ["iou", "dice", "f1"])


@query("A10_tile_score", "fx_prob", sql="SELECT tile_id, round(avg(1 / (1 + exp(-logit))), 6) AS continuity, count(*) FILTER (1 / (1 + exp(-logit)) > 0.5) AS n_road FROM fx_prob GROUP BY 1")
def _(px):
    return A.tile_score(px.withColumn("p", C.sigmoid(F.col("logit"))))


@query(
    "A11_select_patches", "fx_img", "fx_prob",
    sql="""+i AS (SELECT tile_id, r // 4 * 4 AS patch_r, c // 4 * 4 AS patch_c, avg(v) AS m FROM fx_img WHERE band = 0 GROUP BY 1, 2, 3), p AS (SELECT tile_id, r // 4 * 4 AS patch_r, c // 4 * 4 AS patch_c, count(*) FILTER (1 / (1 + exp(-logit)) > 0.6) AS n_road FROM fx_prob GROUP BY 1, 2, 3)
        SELECT tile_id, patch_r, patch_c, n_road FROM i JOIN p USING (tile_id, patch_r, patch_c) WHERE m BETWEEN 10 AND 245 AND n_road >= 8 ORDER BY 1, 2, 3 LIMIT 200""",
)
def _(img, px):
    patch = lambda df: df.withColumn("patch_r", (F.floor(F.col("r") / 4) * 4).cast("int")).withColumn("patch_c", (F.floor(F.col("c") / 4) * 4).cast("int"))
    return A.select_patches(patch(img.filter("band = 0")), patch(px).withColumn("p", C.sigmoid(F.col("logit"))), 0.6, 8, 200)


@query(
    "A14_blend_patches", "fx_skel",
    sql="""+p AS (SELECT s.tile_id, i * 12 AS pr, j * 12 AS pc, r, c, ((r * 7 + c * 3 + i + j) % 10) / 10.0 AS p FROM fx_skel s JOIN (SELECT unnest(range(5)) AS i) ON r BETWEEN i * 12 AND i * 12 + 15 JOIN (SELECT unnest(range(5)) AS j) ON c BETWEEN j * 12 AND j * 12 + 15),
        g AS (SELECT *, exp(-((r - pr - 8.0) * (r - pr - 8.0) + (c - pc - 8.0) * (c - pc - 8.0)) / 32) AS g FROM p)
        SELECT tile_id, r, c, round(sum(p * g) / greatest(sum(g), 1e-8), 6) AS p FROM g GROUP BY 1, 2, 3""",
)
def _(skel):
    tiles = skel.select("tile_id").distinct().select("tile_id", F.lit(64).alias("h"), F.lit(64).alias("w"))
    at = T.pixels_to_patches(skel, tiles, 16, 4)
    i, j = F.col("patch_r") / 12, F.col("patch_c") / 12
    return T.blend_patches(at.withColumn("p", ((F.col("r") * 7 + F.col("c") * 3 + i + j) % 10) / 10.0), tiles, 16)


@query(
    "A15_flip_mean", "fx_prob",
    sql="""+p AS (SELECT tile_id // 4 AS t, tile_id % 4 AS k, r, c, logit FROM fx_prob), b AS (SELECT t AS tile_id, CASE WHEN k IN (2, 3) THEN 7 - r ELSE r END AS r, CASE WHEN k IN (1, 3) THEN 7 - c ELSE c END AS c, 1 / (1 + exp(-logit)) AS p FROM p)
        SELECT tile_id, r, c, round(avg(p), 6) AS p FROM b GROUP BY 1, 2, 3""",
)
def _(px):
    flip = F.element_at(F.array(*map(F.lit, ("none", "h", "v", "hv"))), (F.col("tile_id") % 4 + 1).cast("int"))
    pred = px.select(F.floor(F.col("tile_id") / 4).alias("tile_id"), flip.alias("flip"), "r", "c", C.sigmoid(F.col("logit")).alias("p"))
    return T.flip_mean(pred, _tiles(pred))


# windows -------------------------------------------------------------------------------------------------------------
@query("W2_top_fraction", "fx_edges", sql="SELECT graph_id, u, v, w FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY w DESC, u, v) AS k, count(*) OVER (PARTITION BY graph_id) AS n FROM fx_edges) WHERE k <= greatest(1, ceil(n * 0.1))")
def _(e):
    return B.top_fraction(e, G, "w", 0.1, "u", "v")


@query("W2_top_fraction_large", "fx_big_edges", sql="SELECT graph_id, u, v, w FROM (SELECT *, row_number() OVER (ORDER BY w DESC, u, v) AS k, count(*) OVER () AS n FROM fx_big_edges) WHERE k <= greatest(1, ceil(n * 0.1))")
def _(e):
    return B.top_fraction(e, G, "w", 0.1, "u", "v")


@query("W1_ranks_large", "fx_big_edges", sql="""+d AS (SELECT graph_id, x AS node_id, count(*) AS degree FROM (SELECT graph_id, u AS x FROM fx_big_edges UNION ALL SELECT graph_id, v FROM fx_big_edges) GROUP BY 1, 2)
    SELECT *, row_number() OVER (ORDER BY degree DESC, node_id) AS rank FROM d""")
def _(e):
    return ranked(B.degree(e), G, [F.desc("degree"), F.asc("node_id")], "rank")


@query("W4_cap", "fx_edges", sql="SELECT graph_id, u, v, w FROM fx_edges QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY u, v) <= 8")
def _(e):
    return B.cap(e, 8, ["u", "v"], G)


@query("W5_degree", "fx_edges", sql="SELECT graph_id, node_id, count(*) AS degree FROM (SELECT graph_id, u AS node_id FROM fx_edges UNION ALL SELECT graph_id, v FROM fx_edges) GROUP BY 1, 2")
def _(e):
    return B.degree(e)


@query(
    "W6_epoch_watch", "fx_epoch",
    sql="""+a AS (SELECT *, vl_loss < coalesce(min(vl_loss) OVER w, 'infinity'::DOUBLE) AS best_loss, vl_iou > coalesce(max(vl_iou) OVER w, 0) AS best_iou FROM fx_epoch WINDOW w AS (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        b AS (SELECT *, max(CASE WHEN best_loss OR best_iou THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch) AS since FROM a),
        c AS (SELECT b.*, b.epoch - b.since + CASE WHEN s.best_loss THEN 0 ELSE 1 END AS waited FROM b JOIN b s ON s.run_id = b.run_id AND s.epoch = b.since),
        d AS (SELECT run_id, min(epoch) AS stop FROM c WHERE waited >= 15 GROUP BY 1)
        SELECT run_id, epoch, best_loss, best_iou, waited, waited >= 15 AS stopped FROM c LEFT JOIN d USING (run_id) WHERE stop IS NULL OR epoch <= stop""",
)
def _(log):
    return A.epoch_watch(log)


@query("W7_max_normalize", "fx_edges", sql="SELECT graph_id, u, v, w, round(w / max(w) OVER (PARTITION BY graph_id), 6) AS share FROM fx_edges")
def _(e):
    return B.max_normalize(e, G, "w", "share")


# sampling ------------------------------------------------------------------------------------------------------------
HASHED = "+h AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) AS k, count(*) OVER () AS n FROM customer)"


@query("X1_split3", "customer", sql=(HASHED + " SELECT c_custkey, CASE WHEN k <= n - CAST(floor(n * 0.15) AS INT) - CAST(floor(n * 0.05) AS INT) THEN 'train' WHEN k <= n - CAST(floor(n * 0.05) AS INT) THEN 'val' ELSE 'test' END AS split FROM h"))
def _(c):
    return X.split3(c.select("c_custkey"), "c_custkey")


@query("X2_split2", "customer", sql=(HASHED + " SELECT c_custkey, CASE WHEN k <= greatest(1, floor(n * 0.2)) THEN 'val' ELSE 'train' END AS split FROM h"))
def _(c):
    return X.split2(c.select("c_custkey"), "c_custkey")


@query(
    "X3_weighted_sample", "customer",
    sql="""+w AS (SELECT c_custkey, CAST(c_custkey % 7 + 1 AS DOUBLE) AS w FROM customer), l AS (SELECT c_custkey, w, sum(w) OVER (ORDER BY md5('42:' || c_custkey), c_custkey) AS hi, sum(w) OVER () AS total FROM w),
        d AS (SELECT i AS draw, CAST(('0x' || left(md5('42#' || i), 8))::BIGINT AS DOUBLE) / 4294967296 AS x FROM (SELECT unnest(range(500)) AS i))
        SELECT draw, c_custkey FROM d JOIN l ON x >= (hi - w) / total AND x < hi / total""",
)
def _(c):
    return X.weighted_sample(c.select("c_custkey", (F.col("c_custkey") % 7 + 1).cast("double").alias("w")), "c_custkey", "w", 500)


@query("X4_subsample", "customer", sql="SELECT c_custkey FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 100")
def _(c):
    return X.subsample(c.select("c_custkey"), "c_custkey", 100)


@query(
    "X5_sample_pairs", "fx_nodes",
    sql="""+r AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS k, count(*) OVER (PARTITION BY graph_id) AS n FROM fx_nodes),
        s AS (SELECT DISTINCT graph_id, slot, n, ('0x' || left(md5('42a:' || graph_id || ':' || slot), 7))::BIGINT % n AS i, ('0x' || left(md5('42b:' || graph_id || ':' || slot), 7))::BIGINT % (n - 1) AS d FROM r CROSS JOIN (SELECT unnest(range(5)) AS slot))
        SELECT s.graph_id, slot, a.node_id AS a, b.node_id AS b FROM s JOIN r a ON a.graph_id = s.graph_id AND a.k = i JOIN r b ON b.graph_id = s.graph_id AND b.k = (i + 1 + d) % s.n""",
)
def _(nodes):
    return X.sample_pairs(nodes.select(G, "node_id"), G, "node_id", 5)


# graphs --------------------------------------------------------------------------------------------------------------
BOTH = "e AS MATERIALIZED (SELECT graph_id AS g, u, v, w FROM fx_edges UNION ALL SELECT graph_id, v, u, w FROM fx_edges)"
COMP = """, c(g, x, l) USING KEY (g, x) AS (SELECT graph_id, node_id, node_id FROM fx_nodes UNION
    SELECT c.g, e.v, min(c.l) FROM c JOIN e ON c.g = e.g AND c.x = e.u LEFT JOIN recurring.c r ON r.g = c.g AND r.x = e.v WHERE r.l > c.l GROUP BY 1, 2)"""
HOPS = """, h(g, s, x, d) USING KEY (g, s, x) AS (SELECT graph_id, node_id, node_id, 0 FROM fx_nodes UNION SELECT h.g, h.s, e.v, min(h.d + 1) FROM h JOIN e ON h.g = e.g AND h.x = e.u
    LEFT JOIN recurring.h r ON r.g = h.g AND r.s = h.s AND r.x = e.v WHERE r.d IS NULL OR r.d > h.d + 1 GROUP BY 1, 2, 3)"""
DIST = """, h(g, s, x, d) USING KEY (g, s, x) AS (SELECT graph_id, node_id, node_id, CAST(0 AS BIGINT) FROM fx_nodes UNION SELECT h.g, h.s, e.v, min(h.d + e.w) FROM h JOIN e ON h.g = e.g AND h.x = e.u
    LEFT JOIN recurring.h r ON r.g = h.g AND r.s = h.s AND r.x = e.v WHERE r.d IS NULL OR r.d > h.d + e.w GROUP BY 1, 2, 3), dd AS MATERIALIZED (SELECT * FROM h)"""
SIGMA = DIST + """, p(g, s, x, k, c) AS (SELECT g, s, x, 0, 1.0::DOUBLE FROM dd WHERE s = x UNION ALL SELECT g, s, x, k + 1, sum(c) FROM (SELECT p.g, p.s, e.v AS x, p.k, p.c FROM p JOIN e ON p.g = e.g AND p.x = e.u
    JOIN dd a ON a.g = p.g AND a.s = p.s AND a.x = p.x JOIN dd b ON b.g = p.g AND b.s = p.s AND b.x = e.v WHERE a.d + e.w = b.d) GROUP BY g, s, x, k),
    sg AS MATERIALIZED (SELECT g, s, x, sum(c) AS sigma FROM p GROUP BY 1, 2, 3), ap AS MATERIALIZED (SELECT dd.g, dd.s, dd.x, d, sigma FROM dd JOIN sg USING (g, s, x))"""
NODE_BC = SIGMA + """, nn AS (SELECT graph_id AS g, count(*) AS n FROM fx_nodes GROUP BY 1), nb0 AS (SELECT st.g, sv.x AS v, sum(sv.sigma * vt.sigma / st.sigma) AS b FROM ap st JOIN ap sv ON sv.g = st.g AND sv.s = st.s
    JOIN ap vt ON vt.g = st.g AND vt.s = sv.x AND vt.x = st.x WHERE st.s <> st.x AND sv.x <> st.s AND sv.x <> st.x AND sv.d + vt.d = st.d GROUP BY 1, 2),
    nb AS MATERIALIZED (SELECT graph_id AS g, node_id AS v, coalesce(b, 0) / ((n - 1) * (n - 2)) AS b FROM fx_nodes f JOIN nn ON nn.g = f.graph_id LEFT JOIN nb0 ON nb0.g = f.graph_id AND nb0.v = f.node_id)"""
EDGE_BC = SIGMA + """, nn AS (SELECT graph_id AS g, count(*) AS n FROM fx_nodes GROUP BY 1), eb0 AS (SELECT st.g, least(e.u, e.v) AS u, greatest(e.u, e.v) AS v, sum(su.sigma * vt.sigma / st.sigma) AS b
    FROM ap st JOIN ap su ON su.g = st.g AND su.s = st.s JOIN e ON e.g = st.g AND e.u = su.x JOIN ap vt ON vt.g = st.g AND vt.s = e.v AND vt.x = st.x WHERE st.s <> st.x AND su.d + e.w + vt.d = st.d GROUP BY 1, 2, 3),
    eb AS MATERIALIZED (SELECT graph_id AS g, f.u, f.v, coalesce(b, 0) / (n * (n - 1)) AS b FROM fx_edges f JOIN nn ON nn.g = f.graph_id LEFT JOIN eb0 ON eb0.g = f.graph_id AND eb0.u = f.u AND eb0.v = f.v)"""
NE = ("fx_nodes", "fx_edges")


@query("H1_components", *NE, sql="+" + BOTH + COMP + " SELECT g AS graph_id, x AS node_id, l AS comp_id FROM c", recursive=True)
def _(n, e):
    return P.components(n, e)


BIG = ", z AS (SELECT g, l, count(*) AS size FROM c GROUP BY 1, 2), b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY g ORDER BY size DESC, l) = 1)"


@query("W3_largest_component", *NE, sql="+" + BOTH + COMP + BIG + " SELECT g AS graph_id, l AS comp_id, size FROM b", recursive=True)
def _(n, e):
    return P.largest_component(P.components(n, e))


@query("H2_hop_distances", *NE, sql="+" + BOTH + HOPS + " SELECT g AS graph_id, s AS src, x AS dst, d AS hops FROM h", recursive=True)
def _(n, e):
    return P.hop_distances(n, e)


EFF = """, ek AS (SELECT g, d, count(*) AS k FROM h GROUP BY 1, 2), en0 AS (SELECT g, sum(k)::BIGINT AS n FROM ek WHERE d = 0 GROUP BY 1), es0 AS (SELECT g, sum(k::DOUBLE / d ORDER BY d) AS s FROM ek WHERE d > 0 GROUP BY 1),
    ef AS (SELECT g, n, coalesce(s, 0.0) / (n * (n - 1)) AS e FROM en0 LEFT JOIN es0 USING (g))"""


@query("H3_efficiency", *NE, sql="+" + BOTH + HOPS + EFF + " SELECT g AS graph_id, n, round(e, 6) AS efficiency FROM ef", recursive=True)
def _(n, e):
    return P.efficiency(n, e)


@query("H4_path_counts", *NE, sql="+" + BOTH + SIGMA + " SELECT g AS graph_id, s AS src, x AS dst, d AS dist, sigma FROM ap", recursive=True)
def _(n, e):
    return P.path_counts(n, e).dist


AVG = ", av AS (SELECT dd.g, avg(d) AS a FROM dd JOIN c ON c.g = dd.g AND c.x = dd.s JOIN b ON b.g = c.g AND b.l = c.l WHERE dd.s <> dd.x GROUP BY 1)"


@query("H5_avg_path", *NE, sql="+" + BOTH + COMP + BIG + DIST + AVG + " SELECT b.g AS graph_id, round(a, 6) AS avg_path FROM b LEFT JOIN av USING (g)", recursive=True)
def _(n, e):
    return P.avg_shortest_path(n, e)


@query("H6_node_betweenness", *NE, sql="+" + BOTH + NODE_BC + " SELECT g AS graph_id, v AS node_id, round(b, 6) AS betweenness FROM nb", recursive=True)
def _(n, e):
    return B.node_betweenness(P.path_counts(n, e))


@query("H7_edge_betweenness", *NE, sql="+" + BOTH + EDGE_BC + " SELECT g AS graph_id, u, v, round(b, 6) AS betweenness FROM eb", recursive=True)
def _(n, e):
    return B.edge_betweenness(P.path_counts(n, e), e)


@query("H8_edge_criticality", *NE, sql="+" + BOTH + EDGE_BC + " SELECT g AS graph_id, u, v, round(b, 6) AS betweenness, round(b / max(b) OVER (PARTITION BY g), 6) AS criticality FROM eb", recursive=True)
def _(n, e):
    return B.edge_criticality(B.edge_betweenness(P.path_counts(n, e), e))


@query(
    "H9_gatekeepers", *NE, recursive=True,
    sql="+" + BOTH + NODE_BC + """, dg AS (SELECT g, u, count(*) AS k FROM e GROUP BY 1, 2) SELECT graph_id, node_id, pos_r, pos_c, kind, round(b, 6) AS betweenness, coalesce(k, 0) AS degree,
        row_number() OVER (PARTITION BY graph_id ORDER BY round(b, 9) DESC, node_id) AS rank FROM fx_nodes f JOIN nb ON nb.g = graph_id AND nb.v = node_id LEFT JOIN dg ON dg.g = graph_id AND dg.u = node_id QUALIFY rank <= 10""",
)
def _(n, e):
    bc = B.node_betweenness(P.path_counts(n, e)).withColumn("betweenness", F.round("betweenness", 9))
    return B.gatekeepers(bc, n, e, 10)


@query(
    "H10_snapshot", *NE, recursive=True,
    sql="+" + BOTH + COMP + BIG + DIST + AVG + HOPS.replace(", h(", ", hh(").replace(" h.", " hh.").replace("FROM h ", "FROM hh ").replace("recurring.h ", "recurring.hh ").replace("min(h.d", "min(hh.d").replace("SELECT h.g, h.s", "SELECT hh.g, hh.s")
    + EFF.replace("FROM h ", "FROM hh ") + """ SELECT b.g AS graph_id, round(e, 6) AS efficiency, CASE WHEN e = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS resilience, (SELECT count(DISTINCT l) FROM c WHERE c.g = b.g) AS n_components, size AS largest, n - size AS isolated, round(a, 6) AS avg_path
        FROM b JOIN ef USING (g) LEFT JOIN av USING (g)""",
)
def _(n, e):
    return B.snapshot(n, e)


#: Scenarios as graphs: nodes en(scenario_id, node_id) and edges se(scenario_id, u, v, w) that survive.
IMPACT = """, e AS MATERIALIZED (SELECT 'pre' AS k, graph_id AS g, u, v FROM fx_edges UNION ALL SELECT 'pre', graph_id, v, u FROM fx_edges UNION ALL SELECT 'post', scenario_id, u, v FROM se UNION ALL SELECT 'post', scenario_id, v, u FROM se),
    nd AS MATERIALIZED (SELECT 'pre' AS k, graph_id AS g, node_id AS x FROM fx_nodes UNION ALL SELECT 'post', scenario_id, node_id FROM en),
    h(k, g, s, x, d) USING KEY (k, g, s, x) AS (SELECT k, g, x, x, 0 FROM nd UNION SELECT h.k, h.g, h.s, e.v, min(h.d + 1) FROM h JOIN e ON h.k = e.k AND h.g = e.g AND h.x = e.u
        LEFT JOIN recurring.h r ON r.k = h.k AND r.g = h.g AND r.s = h.s AND r.x = e.v WHERE r.d IS NULL OR r.d > h.d + 1 GROUP BY 1, 2, 3, 4),
    ek AS (SELECT k, g, d, count(*) AS c FROM h GROUP BY 1, 2, 3), en0 AS (SELECT k, g, sum(c)::BIGINT AS n FROM ek WHERE d = 0 GROUP BY 1, 2), es0 AS (SELECT k, g, sum(c::DOUBLE / d ORDER BY d) AS s FROM ek WHERE d > 0 GROUP BY 1, 2),
    ef AS (SELECT k, g, n, coalesce(s, 0.0) / (n * (n - 1)) AS e FROM en0 LEFT JOIN es0 USING (k, g)),
    c AS MATERIALIZED (SELECT g, s AS x, min(x) AS l FROM h WHERE k = 'post' GROUP BY 1, 2), z AS (SELECT g, l, count(*) AS size FROM c GROUP BY 1, 2), b AS (SELECT g, count(*) AS nc, sum(size) - max(size) AS iso FROM z GROUP BY 1),
    ng AS (SELECT scenario_id, count(*) AS n FROM h0 GROUP BY 1), ec AS (SELECT scenario_id, count(*) AS n FROM fx_scen JOIN fx_edges USING (graph_id) GROUP BY 1), es AS (SELECT scenario_id, count(*) AS n FROM se GROUP BY 1)
    SELECT s.scenario_id, s.graph_id, coalesce(ng.n, 0) AS removed_nodes, coalesce(ec.n, 0) - coalesce(es.n, 0) AS removed_edges, round(p.e, 6) AS e_pre, round(q.e, 6) AS e_post, round(q.e / p.e, 6) AS resilience,
        round((p.e - q.e) / p.e * 100, 6) AS drop_pct, round(CASE WHEN q.e = 0 THEN 999 ELSE (p.e / q.e - 1) * 100 END, 6) AS time_penalty_pct, b.nc AS n_components, CAST(b.iso AS BIGINT) AS isolated
    FROM {scen} s JOIN ef p ON p.k = 'pre' AND p.g = s.graph_id JOIN ef q ON q.k = 'post' AND q.g = s.scenario_id JOIN b ON b.g = s.scenario_id LEFT JOIN ng USING (scenario_id) LEFT JOIN ec USING (scenario_id) LEFT JOIN es USING (scenario_id)"""
ALIVE0 = ALIVE.replace("+h AS", "+h0 AS").replace("FROM h)", "FROM h0)")


@query("H12_impact", "fx_nodes", "fx_edges", "fx_scen", sql=ALIVE0 + IMPACT.format(scen="fx_scen"), recursive=True)
def _(n, e, s):
    return I.impact(n, e, s)


@query(
    "H16_network_stats", *NE, "fx_skel", recursive=True,
    sql="+" + BOTH + HOPS + EFF + """ SELECT g AS graph_id, n AS n_nodes, (SELECT count(*) FROM fx_edges x WHERE x.graph_id = g) AS n_edges, (SELECT count(*) FROM fx_edges x WHERE x.graph_id = g AND w > 40) AS n_healed, round(e, 6) AS efficiency,
        (SELECT count(*) FROM fx_skel s WHERE s.tile_id = g) AS road_px, (SELECT count(*) FROM fx_skel s WHERE s.tile_id = g AND (r + c) % 2 = 0) AS skeleton_px FROM ef""",
)
def _(n, e, skel):
    return I.network_stats(n, e.withColumn("synthetic", F.col("w") > 40), skel, skel.filter("(r + c) % 2 = 0"))


@query("H17_pair_paths", *NE, sql="+" + BOTH + DIST + ", q AS (SELECT graph_id, node_id AS a, (node_id * 7 + 3) % 16 AS b FROM fx_nodes) SELECT graph_id, a, b, d AS dist FROM q LEFT JOIN dd ON g = graph_id AND s = a AND x = b", recursive=True)
def _(n, e):
    pairs = n.select(G, F.col("node_id").alias("a"), ((F.col("node_id") * 7 + 3) % 16).alias("b"))
    return P.pair_paths(n, e, pairs)


#: One large irregular graph of all orders: a junction for every part, a road for every order between two ranks or two neighbours.
LARGE = ("fx_big_nodes", "fx_big_edges")


@query("H2_hop_counts_large", *LARGE)
def _(n, e):
    return N.sketched_hops(n, e)[1]


@query("H3_efficiency_large", *LARGE)
def _(n, e):
    return N.estimated_efficiency(n, e)


H17 = "+" + BOTH + DIST + ", q AS (SELECT graph_id, node_id AS a, (node_id * 7 + 3) % 16 AS b FROM fx_nodes) SELECT graph_id, a, b, d AS dist FROM q LEFT JOIN dd ON g = graph_id AND s = a AND x = b"


@query("H17_pair_labels", *NE, sql=H17, recursive=True)
def _(n, e):
    pairs = n.select(G, F.col("node_id").alias("a"), ((F.col("node_id") * 7 + 3) % 16).alias("b"))
    return Q.labelled_pair_paths(Q.hub_labels(n, e), pairs)


@query(
    "H13_bottlenecks", "fx_nodes", "fx_edges", "fx_scen", recursive=True,
    sql=ALIVE + ", " + EDGE_BC.join(["e AS MATERIALIZED (SELECT scenario_id AS g, u, v, w FROM se UNION ALL SELECT scenario_id, v, u, w FROM se)", ""])
    .replace("graph_id, node_id, node_id", "scenario_id, node_id, node_id").replace("FROM fx_nodes", "FROM en").replace("SELECT graph_id AS g, count", "SELECT scenario_id AS g, count").replace("SELECT graph_id AS g, f.u", "SELECT scenario_id AS g, f.u").replace("fx_edges f", "se f").replace("f.graph_id", "f.scenario_id")
    .replace("h(g, s, x, d)", "hh(g, s, x, d)").replace("SELECT h.g, h.s", "SELECT hh.g, hh.s").replace("min(h.d", "min(hh.d").replace("FROM h JOIN e ON h.g = e.g AND h.x", "FROM hh JOIN e ON hh.g = e.g AND hh.x").replace("recurring.h r ON r.g = h.g AND r.s = h.s", "recurring.hh r ON r.g = hh.g AND r.s = hh.s").replace("r.d > h.d", "r.d > hh.d").replace("SELECT * FROM h)", "SELECT * FROM hh)")
    + " SELECT g AS scenario_id, u, v, round(b, 6) AS betweenness FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(b, 9) DESC, u, v) AS k, count(*) OVER (PARTITION BY g) AS n FROM eb) WHERE k <= greatest(1, ceil(n * 0.1))",
)
def _(n, e, s):
    return I.bottlenecks(n, e, s)


POINT = """+near AS (SELECT scenario_id, s.graph_id, n.node_id, n.pos_r, n.pos_c FROM fx_scen s JOIN LATERAL (SELECT node_id, pos_r, pos_c, (pos_r - epi_r) * (pos_r - epi_r) + (pos_c - epi_c) * (pos_c - epi_c) AS d2
    FROM fx_nodes x WHERE x.graph_id = s.graph_id AND (pos_r - epi_r) * (pos_r - epi_r) + (pos_c - epi_c) * (pos_c - epi_c) <= 1600 ORDER BY 4, 1 LIMIT 1) n ON true),
    h0 AS (SELECT scenario_id, s.graph_id, n.node_id FROM near s JOIN fx_nodes n ON n.graph_id = s.graph_id AND (n.pos_r - s.pos_r) * (n.pos_r - s.pos_r) + (n.pos_c - s.pos_c) * (n.pos_c - s.pos_c) <= 25),
    en AS (SELECT scenario_id, n.node_id FROM near s JOIN fx_nodes n USING (graph_id) WHERE (scenario_id, n.node_id) NOT IN (SELECT scenario_id, node_id FROM h0)),
    se AS (SELECT scenario_id, u, v, w FROM near s JOIN fx_edges e USING (graph_id) WHERE (scenario_id, u) NOT IN (SELECT scenario_id, node_id FROM h0) AND (scenario_id, v) NOT IN (SELECT scenario_id, node_id FROM h0))"""


@query("H14_point_failure", "fx_nodes", "fx_edges", "fx_scen", sql=POINT + IMPACT.format(scen="near"), recursive=True)
def _(n, e, s):
    points = s.select(F.col("scenario_id").alias("point_id"), G, F.col("epi_r").alias("r"), F.col("epi_c").alias("c"))
    return I.point_failure(points, n, e, 40, 5)


@query("H11_removal_curve", *NE)
def _(n, e):
    return B.removal_curve(n, e)


@query("H11_removal_static", *NE)
def _(n, e):
    return B.removal_curve(n, e, adaptive=False)


@query("H15_full_report", *NE)
def _(n, e):
    return B.full_report(n, e, 10)


@query(
    "J4_gap_candidates", *NE, recursive=True,
    sql="+" + BOTH + COMP + """ SELECT a.graph_id, a.node_id AS a, b.node_id AS b, round(sqrt((a.pos_r - b.pos_r) * (a.pos_r - b.pos_r) + (a.pos_c - b.pos_c) * (a.pos_c - b.pos_c)), 6) AS dist
        FROM fx_nodes a JOIN fx_nodes b ON a.graph_id = b.graph_id AND a.node_id < b.node_id JOIN c x ON x.g = a.graph_id AND x.x = a.node_id JOIN c y ON y.g = b.graph_id AND y.x = b.node_id
        WHERE x.l <> y.l AND (a.pos_r - b.pos_r) * (a.pos_r - b.pos_r) + (a.pos_c - b.pos_c) * (a.pos_c - b.pos_c) BETWEEN 1 AND 2500""",
)
def _(n, e):
    n, e = kept(n), kept(e)
    return L.gap_candidates(n, kept(P.components(n, e)), 50).select(G, "a", "b", "dist")


# masks to graphs -----------------------------------------------------------------------------------------------------
SQ = "(SELECT i, j FROM (SELECT unnest(range(-3, 4)) AS i) CROSS JOIN (SELECT unnest(range(-3, 4)) AS j) WHERE i * i + j * j <= 9)"
CLS = f"""n AS (SELECT a.tile_id, a.r, a.c, count(b.r) AS nb FROM fx_skel a CROSS JOIN {OFF} o LEFT JOIN fx_skel b ON b.tile_id = a.tile_id AND b.r = a.r + i AND b.c = a.c + j GROUP BY 1, 2, 3),
    cl AS MATERIALIZED (SELECT tile_id, r, c, nb, CASE WHEN nb > 2 THEN 'junction' WHEN nb = 1 THEN 'endpoint' ELSE 'arc' END AS class FROM n WHERE nb > 0)"""
#: Components of the pixels px by their first pixel's code.
BLOB = """, c(tile_id, x, l) USING KEY (tile_id, x) AS (SELECT tile_id, r * 1048576 + c, r * 1048576 + c FROM px UNION SELECT c.tile_id, q.r * 1048576 + q.c, min(c.l) FROM c
    JOIN px q ON q.tile_id = c.tile_id AND q.r BETWEEN c.x // 1048576 - 1 AND c.x // 1048576 + 1 AND q.c BETWEEN c.x % 1048576 - 1 AND c.x % 1048576 + 1
    LEFT JOIN recurring.c z ON z.tile_id = c.tile_id AND z.x = q.r * 1048576 + q.c WHERE z.l > c.l GROUP BY 1, 2)"""


def _square(px):
    return px.select("tile_id").distinct().select("tile_id", F.lit(64).alias("h"), F.lit(64).alias("w"))


@query(
    "G1_closing", "fx_skel",
    sql=f"""+d AS MATERIALIZED (SELECT DISTINCT tile_id, r + i AS r, c + j AS c FROM fx_skel CROSS JOIN {SQ} WHERE r + i BETWEEN 0 AND 63 AND c + j BETWEEN 0 AND 63)
        SELECT d.tile_id, d.r, d.c FROM d CROSS JOIN {SQ} o LEFT JOIN d q ON q.tile_id = d.tile_id AND q.r = d.r + i AND q.c = d.c + j GROUP BY 1, 2, 3
        HAVING count(*) FILTER (d.r + i BETWEEN 0 AND 63 AND d.c + j BETWEEN 0 AND 63 AND q.r IS NULL) = 0""",
)
def _(skel):
    return K.closing(skel, _square(skel))


@query("G2_thinning", "fx_skel")
def _(skel):
    return K.thin(K.closing(skel, _square(skel)))


@query("G3_classify", "fx_skel", sql="+" + CLS + " SELECT * FROM cl")
def _(skel):
    return K.classify(skel)


@query("G4_junction_clusters", "fx_skel", sql="+" + CLS + ", px AS MATERIALIZED (SELECT * FROM cl WHERE class = 'junction')" + BLOB + " SELECT tile_id, x // 1048576 AS r, x % 1048576 AS c, l AS blob FROM c", recursive=True)
def _(skel):
    return K.junction_clusters(K.classify(skel))


REP = """, m AS (SELECT tile_id, l AS blob, CAST(round_even(avg(x // 1048576), 0) AS BIGINT) AS r, CAST(round_even(avg(x % 1048576), 0) AS BIGINT) AS c FROM c GROUP BY 1, 2),
    rp AS (SELECT m.tile_id, m.blob, coalesce(s.r, m.r) AS pos_r, coalesce(s.c, m.c) AS pos_c FROM m LEFT JOIN fx_skel s ON s.tile_id = m.tile_id AND s.r BETWEEN m.r - 3 AND m.r + 3 AND s.c BETWEEN m.c - 3 AND m.c + 3
    QUALIFY row_number() OVER (PARTITION BY m.tile_id, m.blob ORDER BY (s.r - m.r) * (s.r - m.r) + (s.c - m.c) * (s.c - m.c), s.r, s.c) = 1)"""


@query("G5_representatives", "fx_skel", sql="+" + CLS + ", px AS MATERIALIZED (SELECT * FROM cl WHERE class = 'junction')" + BLOB + REP + " SELECT * FROM rp", recursive=True)
def _(skel):
    return K.representatives(K.junction_clusters(K.classify(skel)), skel)


@query("G6_trace_arcs", "fx_skel")
def _(skel):
    cls = kept(K.classify(skel))
    return K.trace_arcs(cls, kept(K.junction_clusters(cls)))[0]


@query("G7_assemble", "fx_skel")
def _(skel):
    return K.skeleton_graph(skel, 3.0, paths=False)[1].select(G, "u", "v", "w", "n_card", "n_diag")


@query("G8_ring_anchor", "fx_ring", sql="+" + CLS.replace("fx_skel", "fx_ring") + ", px AS MATERIALIZED (SELECT * FROM cl)" + BLOB + " SELECT c.tile_id AS graph_id, l AS node_id, l // 1048576 AS pos_r, l % 1048576 AS pos_c, 'junction' AS kind FROM c JOIN cl ON cl.tile_id = c.tile_id AND cl.r = x // 1048576 AND cl.c = x % 1048576 GROUP BY c.tile_id, l HAVING bool_and(class = 'arc')", recursive=True)
def _(skel):
    return K.ring_anchor(K.classify(skel))


def _with_paths(n, e):
    """Edges with straight paths between their nodes."""
    at = lambda k: n.select(G, F.col("node_id").alias(k), F.col("pos_r").alias(f"r{k}"), F.col("pos_c").alias(f"c{k}")).hint("merge")
    both = e.join(at("u"), [G, "u"]).join(at("v"), [G, "v"])
    return both.withColumn("path", T.straight_path(F.col("ru"), F.col("cu"), F.col("rv"), F.col("cv"))).select(G, "u", "v", "w", "path").withColumn("w_q", F.col("w") * 1000000).withColumn("synthetic", F.lit(False)).withColumn("healing_cost", F.lit(None).cast("double"))


@query("G9_tangents", *NE)
def _(n, e):
    return L.tangents(n, _with_paths(n, e)).select(G, "node_id", F.col("tangent.r").alias("r"), F.col("tangent.c").alias("c"))


@query("G10_bridge_costs", *NE)
def _(n, e):
    n, e = kept(n), kept(e)
    return L.costed_gaps(n, e, kept(P.components(n, e)), paths=lambda some: _with_paths(n, some)).select(G, "a", "b", "dist", "cost")


@query("G11_heal", *NE)
def _(n, e):
    n, e = kept(n), kept(e)
    return L.heal(n, e, 50, paths=lambda some: _with_paths(n, some)).filter("synthetic").select(G, "u", "v", "w", "healing_cost", F.size("path").alias("n_path"))


@query("G12_heal_stats", *NE)
def _(n, e):
    n, e = kept(n), kept(e)
    return L.heal_stats(n, L.heal(n, e, 50, paths=lambda some: _with_paths(n, some)))


@query("G13_mask_to_graph", "fx_lines")
def _(lines):
    mask = kept(T.rasterize(_segments(lines), 2, 64))
    _, edges, _ = L.mask_to_graph(mask, _square(mask), prune=3, max_gap=10)
    return edges.select(G, "u", "v", "w", "synthetic", "healing_cost", F.size("path").alias("n_path"))


PIX = """+px AS (SELECT e.graph_id, e.u, e.v, t, CAST(round_even(CAST(a.pos_r + (b.pos_r - a.pos_r) * t / (k - 1) AS DOUBLE), 0) AS BIGINT) AS r, CAST(round_even(CAST(a.pos_c + (b.pos_c - a.pos_c) * t / (k - 1) AS DOUBLE), 0) AS BIGINT) AS c FROM
    (SELECT e.*, CAST(greatest(2, ceil(sqrt((a.pos_r - b.pos_r) * (a.pos_r - b.pos_r) + (a.pos_c - b.pos_c) * (a.pos_c - b.pos_c)))) AS BIGINT) AS k FROM fx_edges e JOIN fx_nodes a ON a.graph_id = e.graph_id AND a.node_id = e.u JOIN fx_nodes b ON b.graph_id = e.graph_id AND b.node_id = e.v) e
    JOIN fx_nodes a ON a.graph_id = e.graph_id AND a.node_id = e.u JOIN fx_nodes b ON b.graph_id = e.graph_id AND b.node_id = e.v JOIN (SELECT unnest(range(800)) AS t) ON t < k),
    ep AS (SELECT graph_id, u, v, r, c FROM px WHERE r < 64 AND c < 64)"""


def _corner(n):
    """The first 64 rows and columns of every graph's square."""
    return n.select(F.col(G).alias("tile_id")).distinct().select("tile_id", F.lit(64).alias("h"), F.lit(64).alias("w"))


@query("J8_edge_pixels", *NE, sql=PIX + " SELECT * FROM ep")
def _(n, e):
    return I.straight_pixels(n, e, _corner(n))


@query("A12_criticality_raster", *NE, sql=PIX + ", m AS (SELECT graph_id, max(w) AS top FROM fx_edges GROUP BY 1) SELECT graph_id, r, c, round(max(w / top), 6) AS crit FROM ep JOIN fx_edges USING (graph_id, u, v) JOIN m USING (graph_id) GROUP BY 1, 2, 3")
def _(n, e):
    return I.criticality_raster(I.straight_pixels(n, e, _corner(n)), e.withColumn("betweenness", F.col("w").cast("double")))


@query("A13_destroyed_raster", *NE, sql=PIX + " SELECT DISTINCT graph_id, r, c FROM ep WHERE (u + v) % 7 = 0")
def _(n, e):
    return I.destroyed_raster(I.straight_pixels(n, e, _corner(n)), e.filter("(u + v) % 7 = 0"))


@query(
    "A8_connectivity_boost", "fx_nodes", "fx_edges", recursive=True,
    sql="+" + BOTH + COMP + BIG + """, ew AS (SELECT * FROM e WHERE w > 10), c2(g, x, l) USING KEY (g, x) AS (SELECT graph_id, node_id, node_id FROM fx_nodes UNION SELECT c2.g, ew.v, min(c2.l) FROM c2 JOIN ew ON c2.g = ew.g AND c2.x = ew.u
        LEFT JOIN recurring.c2 r ON r.g = c2.g AND r.x = ew.v WHERE r.l > c2.l GROUP BY 1, 2), b2 AS (SELECT g, max(size) AS pre FROM (SELECT g, l, count(*) AS size FROM c2 GROUP BY 1, 2) GROUP BY 1)
        SELECT g AS graph_id, round((size - pre) / pre * 100, 6) AS boost FROM b JOIN b2 USING (g)""",
)
def _(n, e):
    size = lambda x: P.largest_component(P.components(n, x)).select(G, "size")
    return I.connectivity_boost(size(e.filter("w > 10")), size(e))


@query(
    "A9_path_error", "fx_nodes", "fx_edges", recursive=True,
    sql="+" + BOTH + DIST + """, ew AS (SELECT * FROM e WHERE w > 5), k(g, s, x, d) USING KEY (g, s, x) AS (SELECT graph_id, node_id, node_id, CAST(0 AS BIGINT) FROM fx_nodes UNION SELECT k.g, k.s, ew.v, min(k.d + ew.w) FROM k JOIN ew ON k.g = ew.g AND k.x = ew.u
        LEFT JOIN recurring.k r ON r.g = k.g AND r.s = k.s AND r.x = ew.v WHERE r.d IS NULL OR r.d > k.d + ew.w GROUP BY 1, 2, 3),
        q AS (SELECT graph_id, node_id AS a, (node_id * 7 + 3) % 16 AS b FROM fx_nodes), x AS (SELECT q.graph_id, CASE WHEN k.d IS NULL THEN 1 ELSE least(1, abs(k.d - dd.d) / dd.d) END AS err
            FROM q JOIN dd ON dd.g = graph_id AND dd.s = a AND dd.x = b LEFT JOIN k ON k.g = graph_id AND k.s = a AND k.x = b WHERE dd.d >= 1e-5)
        SELECT n.graph_id, round(coalesce(avg(err), 0), 6) AS path_error FROM (SELECT DISTINCT graph_id FROM fx_nodes) n LEFT JOIN x USING (graph_id) GROUP BY 1""",
)
def _(n, e):
    pairs = n.select(G, F.col("node_id").alias("a"), ((F.col("node_id") * 7 + 3) % 16).alias("b"))
    return I.path_error((n, e), (n, e.filter("w > 5")), pairs)
