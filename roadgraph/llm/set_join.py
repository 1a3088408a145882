"""N-gram Jaccard self-join that skips work by relations between sets, and the groups that its links form.

A set is a document's distinct shingle hashes. Equal sets are one class; only classes are compared.

Index. Two linked sets of about n tokens differ in few tokens, at most d. The range of hashes is cut into more than d parts,
so some part holds exactly the same tokens in both. A set is indexed by signatures of whole parts, not of tokens: texts that
share a common passage or word do not meet, only near copies do. Sizes are cut into intervals so wide that partners lie in
one or in two neighbouring ones, and a set has parts for both that it may meet in. Of k parts, k - d agree at least, so the
parts with the fewest tokens, which chance might make equal, can be left out: all sets order parts alike. Where PERCENT is
so low that parts would hold few tokens, the first tokens by hash are indexed instead.

Answers. First only one class of every list, its leader (of those with most copies), is compared with the others.
Linked sets fall into groups at once, and a list whose members are all in one group is done: it never reaches the
next step, so a group of near copies costs no more than a comparison with its leader each. A leader may lie at the
edge of a group, too far from some members; so long lists that still hold several groups get another one, drawn by a
hash, in a few more rounds of the same kind. Of the lists that are left only pairs between groups are formed, list by list; long lists are parted into blocks, and every pair of blocks is a
cell of its own. In a cell a group is first compared by one member, its representative. What is known about both sets' overlap with a common leader bounds theirs: too small a bound
skips the pair, a large enough one links it. A sketch of every set holds the parities of its hashes in 256 slots;
two sketches differ in no more slots than their sets differ in tokens, which skips further pairs. The overlap of
two sets with a common leader is then derived from the leader's answers, by what each of them lacks of the leader
and has beyond it; only pairs without one are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgraph.operators.components import component_labels

from .common import gathered, row_key, small_batches, stored, table, text_of
from .wordhash import grams, hashes, mixed, split

SHINGLE_WORDS = 3
#: Percent of the union that the intersection must reach.
PERCENT = 90
#: From this percentage on sets are indexed by parts, of which one in so many is left out.
BY_PARTS = 85
LEFT_OUT = 8
NARROW = 50_000
#: Members of a list that meet in one cell; longer lists are parted into blocks of about half of it.
CELL = 8_192
#: Members of lists with one leader that go to one task.
LEADER_ROWS = 200_000
#: Slots of a set's sketch, 64 to a column.
SKETCH = ["k0", "k1", "k2", "k3"]
CELLS = ["token", "i", "j", "block", "class", "n", "group", "lead", "shared", "n_lead", *SKETCH]
PAIRS = "a long, b long, na int, nb int, lead long, sure boolean"
#: Pairs that a task looks at, and that it holds before it counts and emits them, at once.
SEEN_PAIRS = 500_000
HELD_PAIRS = 2_000_000
#: Rounds with drawn leaders at most, which end when one finds no link, and the least members of a list that takes part.
ROUNDS = 4
#: Members of a group in a cell from which on they are met through their representative.
MANY = 32
LONG = 8
#: A class number takes the lower bits of a leader's rank.
CLASS_BITS = 57


def shingle_set(text: str, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of k words in a row, A-Z lower-cased; with fewer words, of all words as one."""
    h = hashes([w.lower() for w in split(text)])
    return np.unique(grams(h, min(k, len(h)))) if len(h) else np.zeros(0, np.uint64)


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def _both(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of two linked sets: 100 i >= percent (na + nb - i)."""
    return -(-percent * (na + nb) // (100 + percent))


def intervals(percent: int, most: int) -> np.ndarray:
    """Rows (low, high, d, k) of intervals of sizes up to most: a set of low to high tokens and a linked one that is no smaller,
    which lies in the same interval or in the next one, differ in d tokens at most; k parts are made."""
    rows, low = [], 1
    while low <= most:
        high = low * 100 // percent
        d = (high + high * 100 // percent) * (100 - percent) // (100 + percent)
        rows.append((low, high, d, d + 1 + (d + 1) // LEFT_OUT))
        low = high + 1
    return np.array(rows, np.int64).reshape(-1, 4)


@lru_cache(4096)
def _edges(k: int) -> np.ndarray:
    """Least hashes of the second to the last of k parts."""
    return np.array([-(-(x << 64) // k) for x in range(1, k)], np.uint64)


def signatures(s: np.ndarray, at: int, d: int, k: int) -> np.ndarray:
    """Signatures of the d + 1 parts of a sorted set with most tokens, of k; at numbers the interval. Equal parts have equal ones."""
    ends = np.concatenate([[0], np.searchsorted(s, _edges(k)), [len(s)]])
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s + np.uint64(2)), dtype=np.uint64)])
        part = mixed(total[ends[1:]] - total[ends[:-1]] + mixed(np.arange(k, dtype=np.uint64) + np.uint64(at << 32)))
    return part[np.lexsort((part, np.diff(ends)))[k - d - 1 :]]


def indexed(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """What each set is indexed by: any two linked, different sets have some of it in common."""
    n = [len(s) for s in sets]
    if percent < BY_PARTS:
        return [s[: len(s) - int(_need(len(s), percent)) + 1] if len(s) else s for s in sets]
    if percent == 100:
        return [s[:0] for s in sets]
    table = intervals(percent, max(n, default=0))
    own = np.searchsorted(table[:, 0], n, side="right") - 1
    out = []
    for s, i in zip(sets, own.tolist(), strict=True):
        of = [(x, int(table[x, 2]), int(table[x, 3])) for x in (i - 1, i) if x >= 0]
        out.append(np.concatenate([np.zeros(0, np.uint64)] + [signatures(s, x, d, k) for x, d, k in of if d]))  # equal sets are one class
    return out


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row for each set: the parity of how many of its hashes fall into each slot."""
    slots = 64 * len(SKETCH)
    odd = [np.bincount((s % np.uint64(slots)).astype(np.int64), minlength=slots) & 1 for s in sets]
    return np.packbits(np.array(odd, np.uint8).reshape(-1, slots), axis=1).view(np.int64)


def _index(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x, k) for x in b.column(1).to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            rows = indexed(sets, percent)
            with np.errstate(over="ignore"):
                one = np.array([np.add.reduce(mixed(s), dtype=np.uint64) for s in sets], np.uint64)
                two = np.array([np.bitwise_xor.reduce(mixed(s + np.uint64(1))) for s in sets], np.uint64)
            flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)), pa.array(flat.view(np.int64)))
            sketches = [pa.array(x) for x in _sketches(sets).T]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists, *sketches],
                names=["doc_id", "row_key", "n", "d1", "d2", "tokens", *SKETCH],
            )

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole cells (token, i, j), some at a time; rows come sorted by them. cell: numbers them."""
    rest: dict[str, np.ndarray] | None = None
    for b in gathered(batches, NARROW):
        own = {k: b.column(k).to_numpy(zero_copy_only=False) for k in CELLS}
        if rest:
            own = {k: np.concatenate([rest[k], own[k]]) for k in CELLS}
        if not len(own["token"]):
            continue
        new = np.concatenate([[True], np.logical_or.reduce([own[k][1:] != own[k][:-1] for k in ("token", "i", "j")])])
        cut = int(np.flatnonzero(new)[-1])
        rest = {k: v[cut:] for k, v in own.items()}
        if cut:
            yield {k: v[:cut] for k, v in own.items()} | {"cell": np.cumsum(new[:cut]) - 1}
    if rest:
        yield rest | {"cell": np.zeros(len(rest["token"]), np.int64)}


def _once(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Each pair once."""
    a, b, na, nb, lead, sure = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((b, a))
    a, b, na, nb, lead, sure = (x[order] for x in (a, b, na, nb, lead, sure))
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    cols = [a[head], b[head], na[head].astype(np.int32), nb[head].astype(np.int32), lead[head], np.maximum.reduceat(sure, head)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["a", "b", "na", "nb", "lead", "sure"])


def _ranges(left: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of left[x] with every number from low[x] to high[x] - 1, at most about SEEN_PAIRS at once."""
    count = np.maximum(high - low, 0)
    ends = np.cumsum(count)
    x = 0
    while x < len(left):
        y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + SEEN_PAIRS, side="right")))
        some = count[x:y]
        total = int(some.sum())
        if total:
            step = np.arange(total) - np.repeat(np.cumsum(some) - some, some)
            yield np.repeat(left[x:y], some), np.repeat(low[x:y], some) + step
        x = y


def between_groups(c: dict[str, np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of pairs in one cell that sizes allow, but for those within a group of MANY or more members of the cell.
    Rows are sorted by cell, then n. Members of such a group are met by others only if the sketch of one of them, its
    representative, and the group's radius around it allow a link."""
    n, cell, group = c["n"].astype(np.int64), c["cell"], c["group"]
    sketch = [c[x] for x in SKETCH if x in c]
    wide = int(n.max()) + 2
    # skip pointers: beyond the last partner of a list that is not too large
    reach = np.searchsorted(cell * wide + n, cell * wide + np.minimum(n * 100 // percent, wide - 1), side="right")
    order = np.lexsort((group, cell))
    head = np.flatnonzero(np.concatenate([[True], (cell[order][1:] != cell[order][:-1]) | (group[order][1:] != group[order][:-1])]))
    size = np.diff(np.append(head, len(n)))
    few = np.empty(len(n), bool)
    few[order] = np.repeat(size < MANY, size)
    at, all_ = np.flatnonzero(few), np.arange(len(n))
    for i, k in _ranges(all_, np.searchsorted(at, all_, side="right"), np.searchsorted(at, reach)):
        yield i, at[k]
    apart = lambda i, j: sum((np.bitwise_count((x[i] ^ x[j]).view(np.uint64)).astype(np.int64) for x in sketch), np.zeros(len(i), np.int64))
    held: list[tuple[np.ndarray, ...]] = []
    for h in np.flatnonzero(size >= MANY):
        own = order[head[h] : head[h] + size[h]]
        i = np.arange(*np.searchsorted(cell, [cell[own[0]], cell[own[0]] + 1]))
        i = i[(group[i] != group[own[0]]) & (reach[i] > own[0]) & (i < own[-1])]
        centre = own[len(own) // 2]
        # a set of n differs from a larger linked one in n (100 - percent) / percent tokens at most
        i = i[apart(i, centre) - apart(own, centre).max() <= n[i] * (100 - percent) // percent]
        held.append((i, head[h] + np.searchsorted(own, i), head[h] + np.searchsorted(own, reach[i])))
        if sum(len(x[0]) for x in held) > SEEN_PAIRS:
            for i, k in _ranges(*map(np.concatenate, zip(*held, strict=True))):
                yield i, order[k]
            held = []
    if held:
        for i, k in _ranges(*map(np.concatenate, zip(*held, strict=True))):
            yield i, order[k]


def _pairs(percent: int):
    """Pairs of different groups in a cell that sizes, known overlaps and sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _cells(batches):
            n = c["n"].astype(np.int64)
            held: list[tuple[np.ndarray, ...]] = []
            for i, j in between_groups(c, percent):
                ok = (c["group"][i] != c["group"][j]) & ((c["i"][i] == c["j"][i]) | (c["block"][i] != c["block"][j]))
                i, j = i[ok], j[ok]
                want = _both(n[i], n[j], percent)
                known = (c["lead"][i] == c["lead"][j]) & (c["lead"][i] >= 0)
                si, sj = c["shared"][i], c["shared"][j]
                most = np.minimum(si, sj) + np.minimum(n[i] - si, n[j] - sj)
                sure = known & (si + sj - c["n_lead"][i] >= want)
                apart = sum(np.bitwise_count((c[x][i] ^ c[x][j]).view(np.uint64)).astype(np.int64) for x in SKETCH)
                go = (~known | (most >= want)) & (sure | (apart <= n[i] + n[j] - 2 * want))
                i, j, sure, known = i[go], j[go], sure[go], known[go]
                swap = c["class"][i] > c["class"][j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                if len(i):
                    held.append((c["class"][i], c["class"][j], n[i], n[j], np.where(known, c["lead"][i], -1), sure))
                if sum(len(x[0]) for x in held) > HELD_PAIRS:
                    yield _once(held)
                    held = []
            if held:
                yield _once(held)

    return run


def _members(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x, k) for x in b.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], names=["class", "s"])

    return run


def _near(na, nb, apart, percent: int):
    """Whether sizes and the number of slots in which sketches differ allow a link."""
    most, least = F.greatest(na, nb), F.least(na, nb)
    return (least * 100 >= most * percent) & (apart <= na + nb - 2 * F.ceil(percent * (na + nb) / (100 + percent)))


def _apart(left: str, right: str):
    """Slots in which two sketches differ; left and right come before the names of their columns."""
    return sum(F.bit_count(F.col(f"{left}{x}").bitwiseXOR(F.col(f"{right}{x}"))) for x in SKETCH)


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(class, s) of the wanted classes, each made from the text of its first row; stored."""
    rows = classes.select("class", F.col("first.row_key").alias("row_key")).join(wanted.select("class").distinct().hint("merge"), "class", "left_semi")
    texts = docs.join(rows.hint("merge"), "row_key").select("row_key", "class", "text").dropDuplicates(["row_key"])  # rows may be repeated
    return stored(texts.select("class", "text").mapInArrow(_members(k), "class long, s array<long>"), "join-sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("class"))


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, o, lacks, more): exact overlap of the given pairs, what b lacks of a and what it has beyond a.
    The latter two only where they are small, null elsewhere."""
    left, right = sets.select(F.col("class").alias("a"), F.col("s").alias("sa")), sets.select(F.col("class").alias("b"), F.col("s").alias("sb"))
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").withColumn("both", F.array_intersect("sa", "sb"))
    o = F.size("both")
    near = 2 * o >= F.greatest("na", "nb")
    return met.select(
        "a", "b", "na", "nb", o.cast("long").alias("o"),
        F.when(near, F.array_except("sa", "both")).alias("lacks"), F.when(near, F.array_except("sb", "both")).alias("more"),
    )


def _derived(pairs: DataFrame, compared: DataFrame) -> DataFrame:
    """(a, b, na, nb, o): overlaps of pairs with a common leader, from the differences of both with it."""
    side = lambda x: compared.filter("lacks is not null").select(
        F.col("a").alias("lead"), F.col("b").alias(x), F.col("na").alias("n_lead"), F.col("lacks").alias(f"lacks_{x}"), F.col("more").alias(f"more_{x}"))
    met = pairs.filter("lead >= 0").join(side("a").hint("merge"), ["lead", "a"]).join(side("b").drop("n_lead").hint("merge"), ["lead", "b"])
    o = F.col("n_lead") - F.size("lacks_a") - F.size("lacks_b") + F.size(F.array_intersect("lacks_a", "lacks_b")) + F.size(F.array_intersect("more_a", "more_b"))
    return met.select("a", "b", "na", "nb", o.cast("long").alias("o"))


def _linked(percent: int):
    return 100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, leader, class) of lists with several classes. Rows come sorted by token and rank, so a list's first is its
    leader; one row is held back until it is known whether its list goes on, so lists of any length pass through."""
    names = ["token", "leader", "class"]
    last: tuple[int, int, int, bool] | None = None  # token, leader, class, whether it is its list's first
    for b in gathered(batches, NARROW):
        token, own = (b.column(x).to_numpy(zero_copy_only=False) for x in ("token", "rank"))
        own = own & (2**CLASS_BITS - 1)
        if last:
            token, own = np.r_[np.int64(last[0]), token], np.r_[np.int64(last[2]), own]
        if not len(token):
            continue
        other = np.r_[True, (token[1:] != token[:-1]) | (own[1:] != own[:-1])]  # rows may be repeated
        token, own = token[other], own[other]
        head = np.r_[last is None or last[3], token[1:] != token[:-1]]
        start = np.maximum.accumulate(np.where(head, np.arange(len(token)), 0))
        leader = own[start]
        if last and not last[3]:
            leader[: np.argmax(head) if head.any() else len(head)] = last[1]
        go = ~(head[:-1] & head[1:])
        if go.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][go]) for x in (token, leader, own)], names=names)
        last = int(token[-1]), int(leader[-1]), int(own[-1]), bool(head[-1])
    if last and not last[3]:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in last[:3]], names=names)


def _led_lists(classes: DataFrame, index: DataFrame) -> DataFrame:
    """(token, leader, class) of all lists with several classes. The leader has most copies, in powers of four;
    of equal ones it is the one with the least number."""
    rank = F.shiftleft((F.lit(62 - CLASS_BITS) - F.least(F.lit(62 - CLASS_BITS), F.floor(F.log2("copies") / 2))).cast("long"), CLASS_BITS).bitwiseOR(F.col("class"))
    ranks = classes.select(F.col("first.row_key").alias("row_key"), rank.alias("rank"))
    postings = index.filter("size(tokens) > 0").select("row_key", "tokens").join(ranks.hint("merge"), "row_key").select("rank", F.explode("tokens").alias("token"))
    return postings.repartition("token").sortWithinPartitions("token", "rank").mapInArrow(_led, "token long, leader long, class long")


def _several(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """(token, leader, size) of the lists that hold several groups."""
    group = F.coalesce("group", "class")
    sizes = lists.join(groups, "class", "left").groupBy("token").agg(F.min(group).alias("low"), F.max(group).alias("high"), F.count(F.lit(1)).alias("size"), F.min("leader").alias("leader"))
    return sizes.filter("low <> high").select("token", "leader", "size")


def _drawn_pairs(lists: DataFrame, facts: DataFrame, groups: DataFrame, met: DataFrame, percent: int, draw: int) -> DataFrame:
    """(a, b, na, nb): of every long list with several groups, the members of other groups with a drawn leader, where sizes and
    sketches allow a link and the pair is not in met."""
    long = _several(lists, groups).filter(F.col("size") >= LONG).select("token")
    open_ = lists.join(long.hint("merge"), "token").join(facts.hint("merge"), "class")
    lead = open_.groupBy("token").agg(F.min(F.struct(F.xxhash64("class", F.lit(draw)).alias("x"), "class", "n", "group", *SKETCH)).alias("l"))
    near = _near(F.col("n"), F.col("l.n"), _apart("", "l."), percent)
    pairs = open_.join(lead.hint("merge"), "token").filter(F.col("group") != F.col("l.group")).filter(near)
    pairs = pairs.groupBy(F.col("l.class").alias("a"), F.col("class").alias("b")).agg(F.first("l.n").alias("na"), F.first("n").alias("nb"))
    known = met.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")
    return pairs.join(known.distinct().hint("merge"), ["a", "b"], "left_anti")


def _open_cells(lists: DataFrame, facts: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of lists that hold several groups, dealt into cells. Lists of one leader, which mostly hold the same near
    copies, have the same part, so that a pair in many of them is counted before it is emitted."""
    several = _several(lists, groups)
    rows = several.groupBy("leader").agg(F.ceil(F.sum("size") / LEADER_ROWS).alias("parts"))
    several = several.join(rows, "leader").select(
        "token", F.pmod(F.xxhash64("token"), F.col("parts")).cast("int").alias("part"), F.ceil(F.col("size") * 2 / CELL).cast("int").alias("blocks")
    )
    parted = F.col("blocks") > 2  # two blocks are one cell
    block = F.when(parted, F.pmod(F.xxhash64("class"), F.col("blocks"))).otherwise(0).cast("int")
    cell = lambda y: F.struct(F.least("block", y).alias("i"), F.greatest("block", y).alias("j"))
    others = F.sequence(F.lit(0), F.when(parted, F.col("blocks") - 1).otherwise(0))
    met = lists.join(several.hint("merge"), "token").withColumn("block", block)
    return met.withColumn("cell", F.explode(F.transform(others, cell))).select("leader", "part", "token", "cell.i", "cell.j", "block", "class").join(facts.hint("merge"), "class").select("leader", "part", *CELLS)


def similar_groups(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, class_id (least document with the same set), n_links (links of its
    class that were compared or derived, copies not counted) and component_id (least document that links reach).
    keyed adds row_key (see common.row_key) and first: whether the row is the one of its component with the least
    doc_id, then the least row_key; rows equal to it in id and text are marked as well.

    Null texts and texts without words have an empty set, are linked with nothing and are first of their own component.
    Texts with fewer than k words have one shingle. Rows that repeat an id are documents of their own, as are rows
    with a null id; a null id names a component only if all its documents have none. Other columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"))
    schema = f"doc_id {dict(own.dtypes)['doc_id']}, row_key binary, n int, d1 long, d2 long, tokens array<long>, " + ", ".join(f"{x} long" for x in SKETCH)
    index = stored(own.mapInArrow(_index(k, percent), schema), "join-index")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_key"))
    classes = index.filter("n > 0").groupBy("n", "d1", "d2").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"), *(F.first(x).alias(x) for x in SKETCH))
    # numbers follow the ids, so of equal leaders the earliest document leads, which later ones are mostly copies of
    ordered = classes.repartitionByRange(F.col("first")).sortWithinPartitions("first")
    classes = stored(ordered.withColumn("class", F.monotonically_increasing_id()), "join-classes")
    lists = stored(_led_lists(classes, index), "join-lists")

    # leaders first; from here on only classes that are in some list matter
    sketches = stored(classes.select("class", "n", *SKETCH).join(lists.select("class").distinct().hint("merge"), "class"), "join-sketches")
    side = lambda x: sketches.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), *(F.col(s).alias(f"{x}{s}") for s in SKETCH)).hint("merge")
    led = lists.filter("class <> leader").select(F.col("leader").alias("a"), F.col("class").alias("b")).distinct()
    star = led.join(side("a"), "a").join(side("b"), "b").filter(_near(F.col("na"), F.col("nb"), _apart("a", "b"), percent))
    star = stored(star.select("a", "b", "na", "nb"), "join-star")
    sets = _sets(own, classes, _ends(star), k)
    compared = stored(_overlaps(star, sets), "join-compared")
    linked_in = lambda x: x.filter(_linked(percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    grouped = lambda x: component_labels(x).select(F.col("node").alias("class"), F.col("component").alias("group"))
    links = linked_in(compared)
    groups = grouped(links)
    ties = lambda: groups.select(F.col("class").alias("u"), F.col("group").alias("v"))
    for draw in range(ROUNDS):
        facts = sketches.join(groups, "class", "left").withColumn("group", F.coalesce("group", "class"))
        drawn = stored(_drawn_pairs(lists, facts, groups, compared, percent, draw), "join-drawn")
        if drawn.isEmpty():
            break
        sets = sets.union(_sets(own, classes, _ends(drawn).join(sets.select("class"), "class", "left_anti"), k))
        found = stored(_overlaps(drawn, sets), "join-compared")
        compared, new = compared.union(found), linked_in(found)
        if new.isEmpty():
            break
        links = links.union(new)
        groups = grouped(ties().union(new))

    # what is left between groups
    # of its leaders a set remembers the one that most sets were compared with, so that many pairs have one in common
    famed = compared.join(compared.groupBy("a").agg(F.count(F.lit(1)).alias("fame")), "a")
    fact = lambda of, o: famed.select(F.col(of).alias("class"), F.struct("fame", F.col("a").alias("lead"), F.col(o).cast("long").alias("shared"), F.col("na").cast("long").alias("n_lead")).alias("f"))
    best = fact("b", "o").union(fact("a", "na")).groupBy("class").agg(F.max("f").alias("f"))
    facts = sketches.join(groups, "class", "left").join(best, "class", "left").select(
        "class", F.coalesce("group", "class").alias("group"), F.coalesce("f.lead", F.lit(-1)).alias("lead"),
        F.coalesce("f.shared", F.lit(0)).alias("shared"), F.coalesce("f.n_lead", F.lit(0)).alias("n_lead"), "n", *SKETCH,
    )
    where = ("leader", "part", "i", "j")
    cells = _open_cells(lists, facts, groups).repartition(*where).sortWithinPartitions(*where, "token", "n", "class").select(*CELLS)
    across = cells.mapInArrow(_pairs(percent), PAIRS)
    found = across.groupBy("a", "b").agg(*(F.first(x).alias(x) for x in ("na", "nb", "lead")), F.max("sure").alias("sure"))
    met = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    open_pairs = stored(found.join(met.hint("merge"), ["a", "b"], "left_anti"), "join-open")
    todo = open_pairs.filter("not sure")
    derived = stored(_derived(todo, compared), "join-derived")
    rest = todo.join(derived.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "na", "nb")
    more = _sets(own, classes, _ends(rest).join(sets.select("class"), "class", "left_anti"), k)
    plain = _overlaps(rest, sets.union(more)).select(derived.columns)
    late = stored(plain.union(derived).filter(_linked(percent)).select("a", "b").union(open_pairs.filter("sure").select("a", "b")).toDF("u", "v"), "join-links")
    edges = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).union(late)

    labels = (groups if late.isEmpty() else grouped(ties().union(late))).withColumnRenamed("group", "component")
    degree = edges.select(F.explode(F.array("u", "v")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    marks = classes.select("n", "d1", "d2", "class", "first").join(labels, "class", "left").join(degree, "class", "left").withColumn("component", F.coalesce("component", "class"))
    heads = marks.groupBy("component").agg(F.min("first").alias("head"))
    marks = stored(marks.join(heads, "component").select("n", "d1", "d2", "first", "head", "n_links"), "join-marks")
    members = index.select("doc_id", "row_key", "n", "d1", "d2").join(marks, ["n", "d1", "d2"], "left")
    empty = F.col("n") == 0
    return members.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(empty, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        *(["row_key", (empty | (F.col("row_key") == F.col("head.row_key"))).alias("first")] if keyed else []),
    )


def op10_set_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
