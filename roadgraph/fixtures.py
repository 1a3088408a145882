"""Inputs for the road-network queries, derived from the given tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "customer", "part", "lineitem", "events", "embeddings")

#: name -> SQL with the tables it reads in braces
SQL = {
    "fx_edges": """SELECT CAST(FLOOR(a.l_orderkey/16) AS BIGINT) AS graph_id,
        LEAST(a.l_partkey%16,b.l_partkey%16) AS u, GREATEST(a.l_partkey%16,b.l_partkey%16) AS v, MIN(CAST(a.l_quantity AS BIGINT)) AS w
        FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey=b.l_orderkey AND b.l_linenumber=a.l_linenumber+1
        WHERE a.l_partkey%16<>b.l_partkey%16 GROUP BY 1,2,3""",
    "fx_nodes": """SELECT g.graph_id, n.node_id, (n.node_id*37+g.graph_id*11)%512 AS pos_r, (n.node_id*101+g.graph_id*29)%512 AS pos_c,
        CASE WHEN n.node_id%3=0 THEN 'endpoint' ELSE 'junction' END AS kind
        FROM (SELECT DISTINCT graph_id FROM {fx_edges}) g JOIN (SELECT DISTINCT p_partkey%16 AS node_id FROM {part}) n ON 1=1""",
    "fx_big_edges": """SELECT CAST(0 AS BIGINT) AS graph_id, q.u, q.v, MIN(q.w) AS w FROM (SELECT LEAST(x.p,x.q) AS u, GREATEST(x.p,x.q) AS v, x.w FROM
            (SELECT a.l_partkey AS p, CASE WHEN b.l_partkey%16<15 THEN CAST(FLOOR(a.l_partkey/(2+b.l_partkey%3)) AS BIGINT) ELSE a.l_partkey+1 END AS q, CAST(a.l_quantity AS BIGINT) AS w
            FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey=b.l_orderkey AND a.l_linenumber=1 AND b.l_linenumber=2) x) q
        WHERE q.u>=1 AND q.u<q.v AND q.v<=(SELECT MAX(p_partkey) FROM {part}) GROUP BY 1,2,3""",
    "fx_big_nodes": """SELECT CAST(0 AS BIGINT) AS graph_id, p_partkey AS node_id, (p_partkey*7919)%4096 AS pos_r, (p_partkey*104729)%4096 AS pos_c, CASE WHEN p_partkey%3=0 THEN 'endpoint' ELSE 'junction' END AS kind FROM {part}""",
    "fx_scen": """SELECT g.graph_id*3+s.s AS scenario_id, g.graph_id, (g.graph_id*53+s.s*170)%512 AS epi_r, (g.graph_id*97+s.s*130)%512 AS epi_c, 60+40*s.s AS radius
        FROM (SELECT DISTINCT graph_id FROM {fx_edges}) g JOIN (SELECT r_regionkey AS s FROM {region} WHERE r_regionkey<3) s ON 1=1""",
    "fx_lines": """SELECT CAST(FLOOR(q.graph_id/8) AS BIGINT) AS tile_id, q.graph_id%8 AS line_id, q.r0, q.c0, q.r1-q.r0 AS dr, q.c1-q.c0 AS dc, GREATEST(ABS(q.r1-q.r0),ABS(q.c1-q.c0)) AS n
        FROM (SELECT graph_id, CAST(SUM(u*7+w)%64 AS BIGINT) AS r0, CAST(SUM(v*5+w)%64 AS BIGINT) AS c0, CAST(SUM(u+3*v)%64 AS BIGINT) AS r1, CAST(SUM(w)%64 AS BIGINT) AS c1 FROM {fx_edges} GROUP BY graph_id) q""",
    "fx_skel": """SELECT DISTINCT l.tile_id, l.r0+CAST(FLOOR((2*t.t*l.dr+l.n)/(2*l.n)) AS BIGINT) AS r, l.c0+CAST(FLOOR((2*t.t*l.dc+l.n)/(2*l.n)) AS BIGINT) AS c
        FROM {fx_lines} l JOIN (SELECT DISTINCT p_partkey%64 AS t FROM {part}) t ON t.t<=l.n WHERE l.n>0""",
    "fx_ring": """SELECT q.tile_id, 8+CASE q.side WHEN 0 THEN q.o WHEN 1 THEN q.k-q.o WHEN 2 THEN -q.o ELSE q.o-q.k END AS r, 8+CASE q.side WHEN 0 THEN q.k-q.o WHEN 1 THEN -q.o WHEN 2 THEN q.o-q.k ELSE q.o END AS c
        FROM (SELECT p.p_partkey AS tile_id, 2+p.p_partkey%5 AS k, CAST(FLOOR(t.t/(2+p.p_partkey%5)) AS BIGINT) AS side, t.t%(2+p.p_partkey%5) AS o
            FROM {part} p JOIN (SELECT DISTINCT p_partkey%64 AS t FROM {part}) t ON t.t<4*(2+p.p_partkey%5)) q
        UNION ALL SELECT p_partkey, CAST(8 AS BIGINT), 11+p_partkey%5 FROM {part} WHERE p_partkey%7=0""",
    "fx_files": """SELECT 'img' AS side, CONCAT('img/SN3_roads_train_AOI_',CAST(p_partkey%5 AS VARCHAR(20)),'_City_PS-RGB_img',CAST(p_partkey AS VARCHAR(20)),'.tif') AS path FROM {part} WHERE p_partkey%7<>0
        UNION ALL SELECT 'img', CONCAT('img/z/AOI_',CAST(p_partkey%5 AS VARCHAR(20)),'_City_img',CAST(p_partkey AS VARCHAR(20)),'.png') FROM {part} WHERE p_partkey%11=0
        UNION ALL SELECT 'vec', CONCAT('vec/SN3_roads_train_AOI_',CAST(p_partkey%5 AS VARCHAR(20)),'_City_geojson_roads_img',CAST(p_partkey AS VARCHAR(20)),'.geojson') FROM {part} WHERE p_partkey%5<>1""",
    "fx_city": """SELECT c_custkey AS city_id, CAST((c_custkey*7919)%36000 AS DOUBLE)/100-180 AS lon, CAST((c_custkey*104729)%16000 AS DOUBLE)/100-80 AS lat FROM {customer}""",
    "fx_epoch": """SELECT user_id AS run_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS vl_loss, CAST(event_id*37%100 AS DOUBLE)/100 AS vl_iou FROM {events}""",
    "fx_prob": """SELECT vec_id AS tile_id, CAST(FLOOR(i/8) AS INT) AS r, CAST(i%8 AS INT) AS c, 8*CAST(x AS DOUBLE) AS logit FROM {embeddings} LATERAL VIEW POSEXPLODE(embedding) AS i, x""",
    "fx_img": """SELECT p.tile_id, p.r, p.c, b.band, CAST(FLOOR((p.logit+8)*15) AS BIGINT) * (1+b.band%2) + b.band AS v
        FROM {fx_prob} p JOIN (SELECT r_regionkey AS band FROM {region} WHERE r_regionkey<3) b ON 1=1""",
}
#: Where DuckDB says it in other words.
DUCK = {
    "fx_prob": """SELECT vec_id AS tile_id, CAST(FLOOR(i/8) AS INT) AS r, CAST(i%8 AS INT) AS c, 8*CAST(embedding[i+1] AS DOUBLE) AS logit FROM embeddings CROSS JOIN (SELECT UNNEST(RANGE(64)) AS i)""",
}


def _reads(name: str) -> list[str]:
    return sorted({x for x in (*TABLES, *SQL) if "{" + x + "}" in SQL[name]})


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables or derived inputs."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(SQL[name], **{x: fixture(spark, sf_dir, x) for x in _reads(name)})


def duck_with(*names: str, recursive: bool = False) -> str:
    """DuckDB's WITH list that defines the named inputs and what they read."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in TABLES or n in order:
            return
        for x in _reads(n):
            visit(x)
        order.append(n)

    for n in names:
        visit(n)
    bare = {x: x for x in (*TABLES, *SQL)}
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{n} AS MATERIALIZED ({(DUCK.get(n) or SQL[n]).format(**bare)})" for n in order)
