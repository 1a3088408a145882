"""Clusters whose centre has no pixel near it, against the SQL of G5."""

import math

import duckdb

from roadgraph.operators import skeleton as K
from roadgraph.queries import BLOB, CLS, REP


def test_a_ring_keeps_its_centre(spark):
    wide = {(20 + round(q * math.sin(t / 200)), 20 + round(q * math.cos(t / 200))) for t in range(1257) for q in (9, 9.7)}
    cross = {(r, 5) for r in range(9)} | {(4, c) for c in range(9)}
    px = [(t, r, c) for t, some in ((1, wide), (2, cross)) for r, c in some]
    skel = spark.createDataFrame(px, "tile_id long, r long, c long")
    got = {tuple(r) for r in K.representatives(K.junction_clusters(K.classify(skel)), skel).collect()}
    con = duckdb.connect()
    con.sql("create table fx_skel (tile_id bigint, r bigint, c bigint)")
    con.sql("insert into fx_skel values " + ", ".join(map(str, px)))
    sql = "WITH RECURSIVE " + CLS + ", px AS MATERIALIZED (SELECT * FROM cl WHERE class = 'junction')" + BLOB + REP + " SELECT tile_id, blob, pos_r, pos_c FROM rp"
    assert got == set(con.sql(sql).fetchall()) and {r[0] for r in got} == {1, 2}
    assert {r[2:] for r in got if r[0] == 1} == {(20, 20)} and (20, 20) not in wide
