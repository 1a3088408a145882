"""Pixels and their eight neighbours, in blocks of SIDE x SIDE.

Joining every pixel with each of eight offsets shuffles eight rows a pixel. Here a pixel is sent to its own block, and to those
of which it is a neighbour, once: at most four rows, for most pixels one. A block holds at most (SIDE + 2) ** 2 pixels whatever
the tile's size, and what it needs to know of its pixels' neighbours is in it. Repeated pixels count once, and pixels with a
null in tile_id, r or c are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadgraph.operators.components import component_labels
from roadgraph.operators.quality import AROUND, K
from roadgraph.plans.loops import kept

SIDE = 64
WIDE = 2**20
#: A block with its halo is a square of so many pixels a side.
ROW = SIDE + 2
#: Blocks that a task turns into arrays at once.
BLOCKS = 256


class Block:
    """Pixels of several blocks with r, c, code and what they carry (x and y, masked where null), in order of block and code; inside:
    places of those that are no halo."""

    def __init__(self, batch: pa.RecordBatch):
        col = lambda name: batch.column(batch.schema.get_field_index(name))
        px = col("px")
        row = np.repeat(np.arange(batch.num_rows), px.value_lengths().to_numpy(zero_copy_only=False))
        items = px.flatten()
        self.key, first = np.unique(row * (ROW * ROW) + items.field(0).to_numpy(zero_copy_only=False), return_index=True)
        self.row = row[first]
        carried = lambda k: np.ma.array(items.field(k).fill_null(0).to_numpy(zero_copy_only=False), mask=items.field(k).is_null().to_numpy(zero_copy_only=False))[first]
        self.x, self.y = carried(1), carried(2)
        i, j = np.divmod(self.key % (ROW * ROW), ROW)
        br, bc = (col(k).to_numpy(zero_copy_only=False)[self.row] for k in ("br", "bc"))
        self.r, self.c = br * SIDE + i - 1, bc * SIDE + j - 1
        self.code = self.r * WIDE + self.c
        self.own = (i > 0) & (i <= SIDE) & (j > 0) & (j <= SIDE)
        self.inside = np.nonzero(self.own)[0]
        self.place = np.full(batch.num_rows * ROW * ROW, -1, np.int64)
        self.place[self.key] = np.arange(len(self.key))
        self.tiles = col("tile_id")

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of own pixels and of their neighbours, and whether a step is a diagonal."""
        found = []
        for i, j in AROUND:
            to = self.place[self.key[self.inside] + i * ROW + j]
            met = to >= 0
            found.append((self.inside[met], to[met], np.full(met.sum(), i * j != 0)))
        return tuple(np.concatenate(x) for x in zip(*found))


def _block(k: str) -> Column:
    return F.floor(F.col(k) / SIDE).cast("long")


def _within(k: str) -> Column:
    return F.pmod(F.col(k).cast("long"), F.lit(SIDE)).cast("int")


def in_blocks(px: DataFrame, x: Column | None, y: Column | None, fn: Callable[[Block], tuple[np.ndarray, list[np.ndarray]]], columns: str) -> DataFrame:
    """tile_id and columns that fn makes of blocks: for each row the place of a pixel, whose tile_id it gets, and the columns. x
    and y: longs that pixels carry; rows with these should not be repeated."""
    rows = px.dropna(subset=K).select("tile_id", *(f(k).alias(n) for k in ("r", "c") for f, n in ((_block, f"b{k}"), (_within, k))), *(v.cast("long").alias(n) for v, n in ((x, "x"), (y, "y")) if v is not None))
    end = lambda i, j: F.struct((F.col("br") + i).alias("br"), (F.col("bc") + j).alias("bc"), ((F.col("r") + 1 - i * SIDE) * ROW + F.col("c") + 1 - j * SIDE).cast("int").alias("at"))
    side = lambda k, i: F.col(k) == (0 if i < 0 else SIDE - 1)
    over = [F.when((side("r", i) if i else F.lit(True)) & (side("c", j) if j else F.lit(True)), end(i, j)) for i, j in AROUND]
    border = F.col("r").isin(0, SIDE - 1) | F.col("c").isin(0, SIDE - 1)
    # most pixels are on no border, and a filter of arrays is slow
    to = F.when(border, F.filter(F.array(end(0, 0), *over), lambda e: e.isNotNull())).otherwise(F.array(end(0, 0)))
    values = [n for n, v in (("x", x), ("y", y)) if v is not None]
    rows = rows.select("tile_id", F.explode(to).alias("e"), *values)
    null = F.lit(None).cast("long")
    item = F.struct("e.at", F.col("x") if x is not None else null.alias("x"), F.col("y") if y is not None else null.alias("y"))
    gather = F.collect_list(item) if values else F.transform(F.collect_set("e.at"), lambda at: F.struct(at.alias("at"), null.alias("x"), null.alias("y")))
    rows = rows.groupBy("tile_id", F.col("e.br").alias("br"), F.col("e.bc").alias("bc")).agg(gather.alias("px"))
    made = T._parse_datatype_string(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCKS):
                block = Block(batch.slice(k, BLOCKS))
                at, out = fn(block)
                cells = [pa.array(c.filled(0), mask=np.ma.getmaskarray(c)) if isinstance(c, np.ma.MaskedArray) else pa.array(c) for c in out]
                yield pa.RecordBatch.from_arrays([block.tiles.take(pa.array(block.row[at])), *cells], names=["tile_id", *made.names])

    return rows.mapInArrow(run, T.StructType([px.schema["tile_id"], *made.fields]))


def neighbour_counts(px: DataFrame) -> DataFrame:
    """tile_id, r, c, nb: how many of the eight neighbours of a pixel are in px."""

    def count(b: Block) -> tuple[np.ndarray, list[np.ndarray]]:
        nb = np.bincount(b.steps()[0], minlength=len(b.key)).astype(np.int32)
        return b.inside, [b.r[b.inside], b.c[b.inside], nb[b.inside]]

    return in_blocks(px, None, None, count, "r long, c long, nb int")


def touching(px: DataFrame, x: Column, y: Column) -> DataFrame:
    """tile_id, p, q, diagonal, xp, yp, xq, yq: pixels p and their neighbours q, as codes, with two longs that pixels carry."""

    def pairs(b: Block) -> tuple[np.ndarray, list[np.ndarray]]:
        p, q, diagonal = b.steps()
        return p, [b.code[p], b.code[q], diagonal, b.x[p], b.y[p], b.x[q], b.y[q]]

    return in_blocks(px, x, y, pairs, "p long, q long, diagonal boolean, xp long, yp long, xq long, yq long")


def _least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches; edges (i, j) in both directions (Zhang, Azad & Hu 2020)."""
    f = np.arange(n)
    while True:
        before, g = f.copy(), f[f]
        np.minimum.at(f, before[i], g[j])
        np.minimum.at(f, i, g[j])
        np.minimum(f, g, out=f)
        if (f == before).all():
            return f


def labelled(px: DataFrame, x: Column | None = None) -> DataFrame:
    """tile_id, r, c, blob, x: 8-connected components, named by their first pixel's code, and a long that pixels carry. Components
    of a block are told in the block; only those that touch at a border of blocks are joined in rounds."""

    def label(b: Block) -> tuple[np.ndarray, list[np.ndarray]]:
        i, j, _ = b.steps()
        within = b.own[j]
        blob = b.code[_least(len(b.key), i[within], j[within])]
        at = np.concatenate([b.inside, i[~within]])
        q = np.ma.array(np.concatenate([b.code[b.inside], b.code[j[~within]]]), mask=np.arange(len(at)) < len(b.inside))
        return at, [b.r[at], b.c[at], blob[at], b.x[at], q]

    rows = kept(in_blocks(px, x, None, label, "r long, c long, blob long, x long, q long"))
    own, over = rows.filter("q is null").drop("q"), rows.filter("q is not null")
    if over.isEmpty():
        return own
    other = own.select("tile_id", (F.col("r") * WIDE + F.col("c")).alias("q"), F.col("blob").alias("v"))
    pairs = over.select("tile_id", "q", F.col("blob").alias("u")).join(other, ["tile_id", "q"])
    names = component_labels(pairs, ["tile_id"]).select("tile_id", F.col("node").alias("blob"), "component")
    return own.join(names, ["tile_id", "blob"], "left").select(*K, F.coalesce("component", "blob").alias("blob"), "x")
