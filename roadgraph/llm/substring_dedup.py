"""Substring dedup: remove words covered by a window of 20 words that also starts earlier, over the whole corpus.

A window is routed by its anchor: the 6 words in it with the smallest hash. Consecutive windows mostly share one,
so a document falls into pieces (an anchor and the windows around it), and equal windows of any two documents are in
pieces with the same anchor.

1. Every task cuts its documents into pieces. Pieces with equal words are folded to the earliest one; the windows
   of all others are repeats. What remains is narrow: anchor, hash of the words, place.
2. Pieces meet by anchor, sorted. Equal ones are folded again. An anchor with pieces of only one wording needs
   nothing more. Pieces of an anchor with several wordings may still share some windows.
3. Only those pieces fetch their words. Pieces of an anchor that fills more than a shard (the edge of a passage that
   very many documents share, each with other words around it) are cut again by anchors of 19 words, which are much
   rarer, and folded again.
4. Shards hold the pieces of some anchors, or, where an anchor still fills more than one, a block of its pieces. Each
   shard builds a compressed FM-index over its pieces, and all pieces of its anchors, also those of other blocks, are
   streamed through it: backward search gives matching statistics, and the interval of a 20-word match gives the
   earliest place of that window in the shard.
5. Repeats are gathered per document and taken out of its words.

Hot passages cost nothing extra: copies of a piece are folded before the shuffle and again in a stream after it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, small_batches, stored, table, text_of
from .fm_index import FMIndex
from .wordhash import grams, hashes, runs, split

WINDOW = 20
ANCHOR = 6
#: Words of one FM-index. Pieces of a single anchor beyond it are parted into blocks.
SHARD_WORDS = 400_000
PIECES = "anchor long, words long, doc_id long, tie long, start int, n int, done boolean"
FETCHED = "anchor long, words long, doc_id long, tie long, start int, n int, hot boolean, text binary"
#: Ids that are sent to every task where they are no more than this; more are joined by sorting.
FEW = 100_000
#: Narrow rows that are folded at once.
NARROW = 20_000


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value in every run of width values, the first of equal ones; by doubling."""
    place, reach = np.arange(len(g)), 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(g[b] < g[a], b, a)
        reach += step
    return place


def pieces(doc: np.ndarray, tie: np.ndarray, texts: list[str | bytes], window: int = WINDOW, anchor: int = ANCHOR) -> list[np.ndarray]:
    """Columns anchor, hash of the words, doc, tie, start, number of windows of all pieces of some documents."""
    h = [hashes(split(x) if isinstance(x, str) else x.split()) for x in texts]
    size = np.array([len(x) for x in h], np.int64)
    keep = size >= window
    if not keep.any():
        return [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64)]
    h, size, doc, tie = np.concatenate([x for x, k in zip(h, keep, strict=True) if k]), size[keep], doc[keep], tie[keep]
    base = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)[:-1]])
    g = grams(h, anchor)
    at = _least(g, window - anchor + 1)  # of the window that starts at each place
    own = np.repeat(np.arange(len(size)), size)[: len(at)]
    start = np.arange(len(at))
    inside = start + window <= (base + size)[own]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1])
    head = np.flatnonzero(new & inside)
    # a piece ends where the next begins or where the document has no more windows
    stops = np.flatnonzero(new | ~inside)
    nxt = np.searchsorted(stops, head, side="right")
    n = np.append(stops, len(at))[nxt] - head
    return [g[at[head]], runs(h, head, n + window - 1), doc[own[head]], tie[own[head]], head - base[own[head]], n]


def _once(*cols: np.ndarray) -> list[np.ndarray]:
    """Sorted rows without repeats, which come from rows that repeat a document."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in cols])
    return [x[new] for x in cols]


def _batch(cols: list[np.ndarray], done: np.ndarray) -> pa.RecordBatch:
    a, w, d, t, s, n = cols
    return pa.RecordBatch.from_arrays(
        [pa.array(a.view(np.int64)), pa.array(w.view(np.int64)), pa.array(d), pa.array(t), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(done)],
        names=["anchor", "words", "doc_id", "tie", "start", "n", "done"],
    )


def _repeats(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows that say: these windows are repeats. Runs of windows that follow each other in a document become one.
    Their anchor only spreads them over the tasks."""
    if len(doc):
        order = np.lexsort((start, tie, doc))
        doc, tie, start, n = doc[order], tie[order], start[order], n[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] != start[:-1] + n[:-1])
        at = np.flatnonzero(new)
        doc, tie, start, n = doc[at], tie[at], start[at], np.add.reduceat(n, at)
    with np.errstate(over="ignore"):
        spread = (doc * 1_000_003 + tie + start * 7_919).astype(np.uint64)
    return _batch([spread, np.zeros(len(doc), np.uint64), doc, tie, start, n], np.ones(len(doc), bool))


def _cut(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = pieces(b.column("doc_id").to_numpy(), b.column("tie").to_numpy(), b.column("text").to_pylist(), window, anchor)
            order = np.lexsort(cols[4::-1])
            a, w, d, t, s, n = _once(*(x[order] for x in cols))
            again = np.zeros(len(a), bool)
            again[1:] = (a[1:] == a[:-1]) & (w[1:] == w[:-1])
            yield _batch([x[~again] for x in (a, w, d, t, s, n)], np.zeros((~again).sum(), bool))
            yield _repeats(d[again], t[again], s[again], n[again])

    return run


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, words, place. Emits repeats (done), and the first piece of every wording of an
    anchor that has several. Holds back one row, so memory does not grow with an anchor."""
    held: tuple | None = None  # the first piece of the last wording so far, and whether it is to be emitted
    for b in gathered(batches, NARROW):
        done = b.column("done").to_numpy(zero_copy_only=False)
        cols = [b.column(k).to_numpy().astype(np.int64) for k in ("anchor", "words", "doc_id", "tie", "start", "n")]
        if done.any():
            yield _batch([x[done] for x in cols], np.ones(done.sum(), bool))
        cols = [x[~done] for x in cols]
        if not len(cols[0]):
            continue
        if held:
            cols = [np.concatenate([np.array([x], np.int64), y]) for x, y in zip(held[0], cols, strict=True)]
        a, w, d, t, s, n = _once(*cols)
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
        yield _repeats(d[~first], t[~first], s[~first], n[~first])
        cols = [x[first] for x in (a, w, d, t, s, n)]
        a = cols[0]
        with_last = np.zeros(len(a), bool)
        with_last[1:] = a[1:] == a[:-1]
        several = with_last.copy()
        several[:-1] |= with_last[1:]
        if held and held[1]:
            several[0] = True
        out = several[:-1]
        yield _batch([x[:-1][out] for x in cols], np.zeros(out.sum(), bool))
        held = (tuple(x[-1] for x in cols), bool(several[-1]))
    if held and held[1]:
        yield _batch([np.array([x], np.int64) for x in held[0]], np.zeros(1, bool))


def _fetch(window: int):
    """(doc_id, tie, text, pieces of the document) -> pieces with their words; hot ones are cut again by longer anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []  # anchor, words, doc_id, tie, start, n, hot, text
            hot: list[tuple] = []
            for doc, tie, text, own in zip(*(b.column(k).to_pylist() for k in ("doc_id", "tie", "text", "own")), strict=True):
                words = split(text)
                for p in own:
                    span = words[p["start"] : p["start"] + p["n"] + window - 1]
                    (hot if p["hot"] else rows).append((p["anchor"], 0, doc, tie, p["start"], p["n"], p["hot"], b" ".join(span)))
            place = np.arange(len(hot))
            again = [x.astype(np.int64).tolist() for x in pieces(place, place, [x[-1] for x in hot], window, max(1, window - 1))]
            for a, w, at, _, s, n in zip(*again, strict=True):
                _, _, doc, tie, start, _, _, text = hot[at]
                rows.append((a, w, doc, tie, start + s, n, True, b" ".join(text.split(b" ")[s : s + n + window - 1])))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=["anchor", "words", "doc_id", "tie", "start", "n", "hot", "text"])

    return run


class Shard:
    """FM-index over some pieces (doc, tie, start, words), which can be asked for the earliest place of any window."""

    def __init__(self, own: list[tuple], window: int):
        own = sorted(own, key=lambda p: p[:3])  # so that the order of the text is the order of places
        self.window = window
        self.ids: dict[bytes, int] = {}
        for p in own:
            for w in p[3]:
                self.ids.setdefault(w, len(self.ids) + 1)
        self.doc, self.tie, self.start = (np.array([p[k] for p in own], np.int64) for k in range(3))
        text, end, size = self._text(own)
        self.base = end - size
        self.index = FMIndex(text, window)

    def _text(self, some: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids of all pieces with a 0 after each, and where each ends."""
        get = self.ids.get
        size = np.array([len(p[3]) for p in some], np.int64)
        end = np.cumsum(size + 1) - 1
        text = np.zeros(int((size + 1).sum()), np.int64)
        inside = np.ones(len(text), bool)
        inside[end] = False
        text[inside] = np.fromiter((get(w, -1) for p in some for w in p[3]), np.int64, int(size.sum()))
        return text, end, size

    def earlier(self, some: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, tie, start) of the windows in some pieces that this shard also has at an earlier place."""
        query, end, size = self._text(some)
        length, low, _ = self.index.matching(query, end, size)
        hit = np.flatnonzero(length == self.window)
        place = self.index.earliest(low[hit])
        there = np.searchsorted(self.base, place, side="right") - 1
        here = np.searchsorted(end - size, hit, side="right") - 1
        doc, tie, start = (np.array([p[k] for p in some], np.int64)[here] for k in range(3))
        start = start + hit - (end - size)[here]
        d, t, s = self.doc[there], self.tie[there], self.start[there] + place - self.base[there]
        before = (d < doc) | (d == doc) & ((t < tie) | (t == tie) & (s < start))
        return doc[before], tie[before], start[before]


def _resolve(window: int, shard_words: int):
    """Rows of pieces sorted by anchor, block, other: those with other are not of the block, but of its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        shard: Shard | None = None
        n_words, last = 0, None

        def found(on: Shard) -> pa.RecordBatch:
            doc, tie, start = on.earlier(held)
            return _repeats(doc, tie, start, np.ones(len(doc), np.int64))

        for b in batches:
            for a, k, parted, other, d, t, s, text in zip(*(b.column(c).to_pylist() for c in ("anchor", "block", "parted", "other", "doc_id", "tie", "start", "text")), strict=True):
                new = (a, k, parted) != last
                if held and (new and (shard or parted or last[2] or n_words >= shard_words) or other and (not shard or n_words >= shard_words)):
                    shard = shard or Shard(held, window)
                    yield found(shard)
                    held, n_words = [], 0
                if new:
                    shard = None
                words = text.split(b" ")
                held.append((d, t, s, words))
                n_words += len(words) + 1
                last = (a, k, parted)
        if held:
            yield found(shard or Shard(held, window))

    return run


def _take_out(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = split(text)
                n = len(words)
                if own:
                    edge = np.zeros(n + 1, np.int64)
                    s = np.array([p["start"] for p in own], np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + np.array([p["n"] for p in own], np.int64) + window - 1, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                out[0].append(n)
                out[1].append(n - len(words))
                out[2].append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _few(df: DataFrame) -> DataFrame:
    """df, sent to every task if it is small, else joined by sorting."""
    return F.broadcast(df) if df.count() <= FEW else df.hint("merge")


def _blocks(hot: DataFrame, window: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """From the pieces of hot anchors, cut again: what is to be searched, and repeats by equal words. Their groups have no
    bound, so they are folded by aggregation, and Spark splits the join back where a group is large."""
    heads = stored(hot.groupBy("anchor", "words").agg(F.min(F.struct("doc_id", "tie", "start")).alias("p"), F.first("n").alias("n"), F.first("text").alias("text")), "repeats-hot")
    repeats = hot.drop("text", "n").join(heads.select("anchor", "words", "p", "n").hint("merge"), ["anchor", "words"]).filter(F.struct("doc_id", "tie", "start") > F.col("p"))
    sizes = heads.groupBy("anchor").agg(F.count(F.lit(1)).alias("wordings"), F.sum(F.col("n") + window).alias("size")).filter("wordings > 1")
    n = F.ceil(F.col("size") / shard_words).cast("int")
    own = heads.join(sizes.select("anchor", n.alias("blocks")), "anchor").withColumn("block", F.pmod(F.xxhash64("words"), F.col("blocks")).cast("int"))
    met = own.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    todo = met.select("anchor", F.col("at").alias("block"), (F.col("blocks") > 1).alias("parted"), (F.col("at") != F.col("block")).alias("other"), "p.*", "text")
    return todo, repeats.select("doc_id", "tie", "start", "n")


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, tie, start, n): the n windows from word start on also start earlier. docs has doc_id, tie and text, none
    of them null; rows are ordered by doc_id, then tie, and rows with both equal repeat each other."""
    if window < 1:
        raise ValueError("a window has one word at least")
    spark = docs.sparkSession
    small_batches(spark)
    cut = docs.select("doc_id", "tie", "text").mapInArrow(_cut(window, min(anchor, window)), PIECES)
    met = cut.repartition("anchor").sortWithinPartitions("anchor", "words", "doc_id", "tie", "start")
    folded = stored(met.mapInArrow(_fold, PIECES), "repeats-folded")
    left = folded.filter("not done")
    hot = stored(left.groupBy("anchor").agg(F.sum(F.col("n") + window).alias("size")).filter(F.col("size") > shard_words).select("anchor", F.lit(True).alias("hot")), "repeats-hot-anchors")
    any_hot = not hot.isEmpty()
    marked = left.join(_few(hot), "anchor", "left") if any_hot else left.withColumn("hot", F.lit(False))
    edges = marked.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("anchor", "start", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("own"))
    # by sorting at any size: at scale the documents with such pieces are too many to broadcast
    fetched = docs.join(edges.hint("merge"), ["doc_id", "tie"]).select("doc_id", "tie", "text", "own").mapInArrow(_fetch(window), FETCHED)
    fetched = stored(fetched, "repeats-fetched") if any_hot else fetched
    whole = (F.lit(0).alias("block"), F.lit(False).alias("parted"), F.lit(False).alias("other"))
    todo = fetched.filter("not hot").select("anchor", *whole, "doc_id", "tie", "start", "text")
    out = folded.filter("done").select("doc_id", "tie", "start", "n")
    if any_hot:
        more, repeats = _blocks(fetched.filter("hot"), window, shard_words)
        todo, out = todo.unionByName(more), out.union(repeats)
    sharded = todo.repartition("anchor", "block").sortWithinPartitions("anchor", "block", "parted", "other", "doc_id", "tie", "start")
    found = stored(sharded.mapInArrow(_resolve(window, shard_words), PIECES), "repeats-found")
    return out.union(found.select("doc_id", "tie", "start", "n"))


def _with_ties(own: DataFrame) -> DataFrame:
    """Adds tie: a hash of the text where an id has several texts, else 0."""
    h = F.xxhash64("text")
    several = stored(own.groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).filter("lo <> hi").select("doc_id", F.lit(True).alias("several")), "repeats-ids")
    if several.isEmpty():
        return own.withColumn("tie", F.lit(0).cast("long"))
    return own.join(_few(several), "doc_id", "left").select("doc_id", "text", F.when(F.col("several"), h).otherwise(0).alias("tie"))


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one blank).

    Earlier means a smaller doc_id, or the same document and an earlier start. A null text has no words; texts
    with fewer words than window keep all. Ids are whole numbers; a null one counts as smaller than every other. Rows
    that repeat an id, or have none, with another text are documents of their own, in the order of a hash of the text;
    rows equal in id and text are one document and answered alike. Other columns are ignored.
    """
    null_id = -(2**63)
    own = _with_ties(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(null_id)).alias("doc_id"), text_of(text_col).alias("text")))
    found = repeated_windows(own, window, **how)
    by_doc = found.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "n")).alias("own"))
    both = own.join(by_doc.hint("merge"), ["doc_id", "tie"], "left").select("doc_id", "text", "own")
    out = both.mapInArrow(_take_out(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(null_id)))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
