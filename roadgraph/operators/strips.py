"""Masks as rows of bits: closing and thinning by bitwise functions of a row and its neighbours.

A strip is one row of a tile between two columns, 64 bits in one long: tile_id, cb, r, bits. Its core starts at column
cb * (64 - 2 * halo); halo bits on each side repeat what the neighbouring strips hold, so that a neighbourhood of up to halo
pixels is inside the strip. Rows without road have no strip. Pixels with a null in tile_id, r or c are on no tile and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadgraph.operators.quality import K, half_widths
from roadgraph.plans.loops import kept

S = ["tile_id", "cb", "r"]
#: Largest halo: a strip's core then still holds a neighbour's whole halo.
WIDEST = 21
#: Sub-passes of thinning between two exchanges of halos, an even number, and the halo's width then.
PASSES = 8
#: Rows of a strip column that one window sees, without the halo above and below.
ROWS = 1024
MAX_ROUNDS = 10_000


def _long(bits: range) -> int:
    """The long with these bits set."""
    x = sum(1 << k for k in bits)
    return x - (1 << 64) if x >> 63 else x


def _left(x: Column, n: int) -> Column:
    return F.shiftleft(x, n) if n else x


def _right(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, n) if n else x


def _core(halo: int) -> int:
    return 64 - 2 * halo


def pack(px: DataFrame, halo: int) -> DataFrame:
    """Strips of pixels (tile_id, r, c)."""
    core = _core(halo)
    c = F.col("c").cast("long")
    cb, at = F.floor(c / core), F.pmod(c, F.lit(core))
    places = F.array(*(F.struct((cb + i).alias("cb"), (at + halo - i * core).cast("int").alias("k")) for i in (-1, 0, 1)))
    own = px.dropna(subset=K).select("tile_id", F.col("r").cast("long").alias("r"), F.explode(F.filter(places, lambda p: p["k"].between(0, 63))).alias("p"))
    return own.groupBy("tile_id", F.col("p.cb").alias("cb"), "r").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p.k"))).alias("bits"))


def unpack(strips: DataFrame, halo: int) -> DataFrame:
    """tile_id, r, c of the bits in the cores."""
    core = _core(halo)
    set_ = F.filter(F.sequence(F.lit(halo), F.lit(halo + core - 1)), lambda k: F.call_function("getbit", F.col("bits"), k) == 1)
    return strips.select("tile_id", "r", "cb", F.explode(set_).alias("k")).select("tile_id", "r", (F.col("cb") * core + F.col("k") - halo).alias("c"))


def rehalo(strips: DataFrame, halo: int) -> DataFrame:
    """The same cores with halos taken from the neighbours' cores."""
    core, x = _core(halo), F.col("bits")
    to = F.array(
        F.struct(F.col("cb").alias("cb"), x.bitwiseAND(_long(range(halo, halo + core))).alias("bits")),
        F.struct((F.col("cb") - 1).alias("cb"), _left(x.bitwiseAND(_long(range(halo, 2 * halo))), core).alias("bits")),
        F.struct((F.col("cb") + 1).alias("cb"), _right(x.bitwiseAND(_long(range(core, core + halo))), core).alias("bits")),
    )
    sent = strips.select("tile_id", "r", F.explode(F.filter(to, lambda s: s["bits"] != 0)).alias("s"))
    return sent.groupBy("tile_id", F.col("s.cb").alias("cb"), "r").agg(F.bit_or("s.bits").alias("bits"))


def _spread(x: str, n: int) -> str:
    """Bits at most n places from one that is set in x; what crosses the ends is lost."""
    return " | ".join([x, *(f"{f}({x}, {k})" for k in range(1, n + 1) for f in ("shiftleft", "shiftrightunsigned"))])


def _inside(halo: int) -> Column:
    """Bits whose column is on the tile, for strips with the tile's width w."""
    start = F.col("cb") * _core(halo) - halo
    low = F.greatest(-start, F.lit(0)).cast("int")
    high = F.least(F.col("w") - 1 - start, F.lit(63)).cast("int")
    ones = F.call_function("shiftleft", F.lit(-1).cast("long"), low).bitwiseAND(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 63 - high))
    return F.when((low > 63) | (high < 0), F.lit(0).cast("long")).otherwise(ones)


def closed(mask: DataFrame, tiles: DataFrame, radius: float) -> DataFrame:
    """tile_id, r, c after dilation by a disk and erosion by it; what lies off the tile counts as road while eroding. A strip
    sends 2 * radius + 1 rows of bits in both steps, already widened along the row."""
    halo = max(1, int(radius))
    if halo > WIDEST:
        raise ValueError(f"strips close up to a radius of {WIDEST}")
    widths = half_widths(radius)
    size = tiles.select("tile_id", "h", "w")

    def sent(form: str, x: str) -> Column:
        rows = (f"named_struct('d', {i}, 'bits', {form.format(_spread(x, widths[abs(i)]))})" for i in range(1 - len(widths), len(widths)))
        return F.expr(f"explode(array({', '.join(rows)}))")

    wide = pack(mask, halo).select("tile_id", "cb", "r", sent("{}", "bits").alias("s")).groupBy("tile_id", "cb", (F.col("r") + F.col("s.d")).alias("r")).agg(F.bit_or("s.bits").alias("bits"))
    on = wide.join(size, "tile_id").filter("r >= 0 and r < h").select(*S, F.col("bits").bitwiseAND(_inside(halo)).alias("bits"))
    road = rehalo(on, halo).join(size, "tile_id").select(*S, "h", "w", F.bitwise_not("bits").bitwiseAND(_inside(halo)).alias("x"))
    lean = road.select(*S, "h", "w", sent("~({})", "x").alias("s"))
    met = lean.groupBy("tile_id", "cb", (F.col("r") + F.col("s.d")).alias("r")).agg(F.bit_and("s.bits").alias("bits"), F.count(F.lit(1)).alias("have"), F.first("h").alias("h"), F.first("w").alias("w"))
    n = len(widths) - 1
    want = F.least(F.col("r") + n, F.col("h") - 1) - F.greatest(F.col("r") - n, F.lit(0)) + 1
    return unpack(met.filter(F.col("r").between(0, F.col("h") - 1) & (F.col("have") == want)).select(*S, F.col("bits").bitwiseAND(_inside(halo)).alias("bits")), halo)


def _some(planes: list[str]) -> tuple[str, str]:
    """SQL for the bits that are set in one plane or more, and in two or more."""
    if len(planes) == 1:
        return planes[0], "0L"
    half = len(planes) // 2
    (a, aa), (b, bb) = _some(planes[:half]), _some(planes[half:])
    return f"({a} | {b})", f"({aa} | {bb} | ({a} & {b}))"


def _thinner(first: bool) -> str:
    """SQL for m after a sub-pass of Zhang and Suen's thinning; u, d: the rows above and below. A pixel goes if it has two to six
    neighbours, one change from empty to road around it, and the sub-pass's sides are open. A string, as a tree of columns
    of this size takes seconds to send to the JVM."""
    west, east = "shiftleft({}, 1)", "shiftrightunsigned({}, 1)"
    around = ["u", east.format("u"), east.format("m"), east.format("d"), "d", west.format("d"), west.format("m"), west.format("u")]
    n, e, s, w = around[::2]
    one, two = _some([f"(~{p} & {q})" for p, q in zip(around, around[1:] + around[:1])])
    shut = f"({e} & {s} & ({n} | {w}))" if first else f"({n} & {w} & ({e} | {s}))"
    return f"m & ~({one} & ~{two} & {_some(around)[1]} & {_some([f'~{p}' for p in around])[1]} & ~{shut})"


def _passes(strips: DataFrame, halo: int) -> DataFrame:
    """Cores after PASSES sub-passes. Each makes one more ring of the halo stale, so none reaches the core. One window order
    serves all of them."""
    rb, at = F.floor(F.col("r") / ROWS), F.pmod("r", F.lit(ROWS))
    blocks = F.filter(F.array(rb, F.when(at < halo, rb - 1), F.when(at >= ROWS - halo, rb + 1)), lambda b: b.isNotNull())
    w = Window.partitionBy("tile_id", "cb", "rb").orderBy("r")
    fixed = ["tile_id", "cb", "rb", "r", "above", "below"]
    now = strips.withColumn("rb", F.explode(blocks)).select(
        "tile_id", "cb", "rb", "r", F.coalesce(F.lag("r").over(w) == F.col("r") - 1, F.lit(False)).alias("above"), F.coalesce(F.lead("r").over(w) == F.col("r") + 1, F.lit(False)).alias("below"), F.col("bits").alias("m")
    )
    none = F.lit(0).cast("long")
    for k in range(PASSES):
        near = now.select(*fixed, "m", F.lag("m").over(w).alias("up"), F.lead("m").over(w).alias("down"))
        rows = near.select(*fixed, "m", F.when(F.col("above"), F.col("up")).otherwise(none).alias("u"), F.when(F.col("below"), F.col("down")).otherwise(none).alias("d"))
        now = rows.select(*fixed, F.expr(_thinner(k % 2 == 0)).alias("m"))
    return now.filter(F.col("rb") == rb).select(*S, F.col("m").alias("bits"))


def thinned(mask: DataFrame) -> DataFrame:
    """tile_id, r, c of one-pixel centre lines (Zhang & Suen 1984): two sub-passes until neither takes a pixel away."""
    halo = PASSES
    own = _long(range(halo, halo + _core(halo)))
    size = lambda x: x.agg(F.coalesce(F.sum(F.bit_count(F.col("bits").bitwiseAND(own))), F.lit(0))).first()[0]
    now = kept(pack(mask, halo))
    n = size(now)
    for _ in range(MAX_ROUNDS):
        now = kept(rehalo(_passes(now, halo), halo))
        left = size(now)
        if left == n:
            return unpack(now, halo)
        n = left
    raise RuntimeError("thinning did not end")
