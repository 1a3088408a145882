"""Source divergence audit: which sources of a language differ from each other, and by which terms.

Kept terms are found by iceberg prefix refinement over byte prefixes of terms that end with a zero byte:

1. One pass over the texts makes packed rows: the distinct terms of a block of documents of one language, and which
   document holds which term how often. Texts are not read again.
2. Each level reads the packed rows and counts, for every prefix of that level's length, the documents that hold a term with it
   (a document counts once, however many of its terms share the prefix; blocks are summed by Spark). A prefix below the
   threshold is discarded, and all terms that begin with it are never looked at again. A prefix that has its zero byte is a whole
   term, so its count is exact, and it is kept or not for good; the others are extended to the next level's length.
3. Survivors go back to the blocks as a bit table of fixed size: a clear bit means discarded; where two prefixes share a bit, a
   discarded one may be extended once more and fails by its own count later. The result never depends on the table.
   Levels double in length and end when no unfinished prefix is left.

Probabilities, sums and ranks are integers. For the distance of two sources terms that only one or none of them has take
few different values, so these are counted by value: sum over all terms = terms x f(0, 0) + what one source's counts change
+ what counts of both change beyond that. Only terms that both have are joined.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, table, text_of, with_groups

#: Documents of a language in which a kept term is found at least.
LEAST = 3
TOP = 200
#: Prefix lengths in bytes of the first level; each level doubles it.
FIRST = 3
#: Bits of the table of surviving prefixes (8 MB), at any number of prefixes.
BITS = 1 << 26
#: Text and documents of a block.
BLOCK_BYTES = 16 << 20
BLOCK_ROWS = 20_000
#: A block's cells (prefix, document) are marked in a table of bytes where there are at most so many for each term of a
#: document, and else told apart by sorting.
CELLS = 8
#: Rows of prefixes that leave a worker at once.
ROWS = 100_000
#: Bytes of a text that are split at once.
SLICE = 1 << 20
SCALE = 1_000_000_000

PACKED = "lang string, terms binary, sources array<string>, of_doc binary, term binary, doc binary, n binary"
LEVEL = "lang string, source string, prefix binary, docs long, n long"
#: Lower-cases A-Z and makes every other ASCII character than a letter a blank.
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Counter:
    """How often each term [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+ of a text in UTF-8 occurs, only A-Z lower-cased; a long text slice by slice."""
    data = text.translate(_LETTERS)
    found: Counter = Counter()
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE) if at + SLICE < len(data) else len(data)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def _numbers() -> defaultdict:
    """A dictionary that numbers what it is asked for, from 0."""
    found: defaultdict = defaultdict()
    found.default_factory = found.__len__
    return found


class _Block:
    """Packed terms of some documents, by language."""

    def __init__(self):
        self.langs: dict[str, list] = {}
        self.bytes, self.rows = 0, 0

    def add(self, text: bytes, lang: str, source: str) -> None:
        number, sources, of_doc, term, doc, n = self.langs.get(lang) or self.langs.setdefault(lang, [_numbers(), _numbers(), [], [], [], []])
        found = terms_of(text)
        term.append(np.fromiter(map(number.__getitem__, found), np.uint32, len(found)))
        n.append(np.fromiter(found.values(), np.uint32, len(found)))
        doc.append(np.full(len(found), len(of_doc), np.uint32))
        of_doc.append(sources[source])
        self.bytes, self.rows = self.bytes + len(text), self.rows + 1

    def packed(self) -> pa.RecordBatch:
        rows = [
            (lang, b" ".join(number), list(sources), np.array(of_doc, np.uint32).tobytes(), *(np.concatenate(x).tobytes() for x in (term, doc, n)))
            for lang, (number, sources, of_doc, term, doc, n) in self.langs.items()
        ]
        columns = [list(x) for x in zip(*rows, strict=True)]
        kinds = [pa.string(), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "terms", "sources", "of_doc", "term", "doc", "n"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = _Block()
    for b in batches:
        for row in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            block.add(*row)
            if block.bytes >= BLOCK_BYTES or block.rows >= BLOCK_ROWS:
                yield block.packed()
                block = _Block()
    if block.rows:
        yield block.packed()


def _bit(lang: bytes, prefix: bytes, n_bits: int) -> int:
    return xxhash.xxh3_64_intdigest(lang + b"\0" + prefix) % n_bits


def _counted(before: int, length: int, table_):
    """Documents by prefix of one level. table_: a broadcast bit table of the last level's survivors, or None at the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table_.value, np.uint64) if table_ is not None else None
        for b in batches:
            for row in b.to_pylist():
                yield from _count_block(row, before, length, bits)

    return run


def _count_block(row: dict, before: int, length: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    lang = row["lang"].encode("utf-8", "surrogatepass")
    terms = [t + b"\0" for t in row["terms"].split(b" ") if t]
    group = np.full(len(terms), -1, np.int64)  # number of a term's prefix; -1: finished or discarded
    prefixes: dict[bytes, int] = {}
    met: dict[bytes, bool] = {}
    for i, t in enumerate(terms):
        if bits is not None:
            if len(t) <= before:
                continue
            head = t[:before]
            if head not in met:
                k = _bit(lang, head, 64 * len(bits))
                met[head] = bool(int(bits[k >> 6]) >> (k & 63) & 1)
            if not met[head]:
                continue
        group[i] = prefixes.setdefault(t[:length], len(prefixes))
    if not prefixes:
        return
    names = list(prefixes)
    whole = np.fromiter((p[-1] == 0 for p in names), bool, len(names))
    of_doc, term, doc, n = (np.frombuffer(row[x], np.uint32).astype(np.int64) for x in ("of_doc", "term", "doc", "n"))
    own = group[term]
    use = own >= 0
    own, doc, n = own[use], doc[use], n[use]
    done = whole[own]
    shown = pa.array(names, pa.binary())
    # unfinished prefixes: a document counts once for all its terms
    if len(names) * len(of_doc) <= CELLS * len(own):
        held = np.zeros((len(names), len(of_doc)), bool)
        held[own[~done], doc[~done]] = True
        docs = held.sum(axis=1)
    else:
        docs = np.bincount(np.unique(own[~done] * len(of_doc) + doc[~done]) // len(of_doc), minlength=len(names))
    some = np.flatnonzero(docs)
    yield _level_rows(row["lang"], pa.nulls(len(some), pa.string()), shown.take(pa.array(some)), docs[some], np.zeros(len(some), np.int64))
    # whole terms: one row for each source
    k = len(row["sources"])
    at = own[done] * k + of_doc[doc[done]]
    docs, times = np.bincount(at), np.bincount(at, n[done]) if at.size else np.zeros(0)
    some = np.flatnonzero(docs)
    for i in range(0, len(some), ROWS):
        own = some[i : i + ROWS]
        yield _level_rows(row["lang"], pa.array(row["sources"], pa.string()).take(pa.array(own % k)), shown.take(pa.array(own // k)), docs[own], times[own].astype(np.int64))


def _level_rows(lang: str, sources: pa.Array, prefixes: pa.Array, docs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(docs), np.int64))), sources, prefixes, pa.array(docs, pa.int64()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "prefix", "docs", "n"])


def _bits_of(n_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, int] = {}
        for b in batches:
            for lang, prefix in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k = _bit(lang.encode("utf-8", "surrogatepass"), prefix, n_bits)
                words[k >> 6] = words.get(k >> 6, 0) | 1 << (k & 63)
        bits = np.fromiter(words.values(), np.uint64, len(words)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.int64()), pa.array(bits)], names=["word", "bits"])

    return run


def _bit_table(survivors: DataFrame, n_bits: int) -> bytes | None:
    """The survivors' bits; None if there are none. At most n_bits / 64 rows reach the driver."""
    words = survivors.select("lang", "prefix").mapInArrow(_bits_of(n_bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    if not words.num_rows:
        return None
    bits = np.zeros(n_bits // 64, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bits.tobytes()


def kept_terms(docs: DataFrame, least: int = LEAST, first: int = FIRST, n_bits: int = BITS) -> DataFrame:
    """lang, source, term, n, lang_n, leads of every term that at least so many documents of its lang hold, for sources that have it, from
    docs(text, lang, source) without nulls. n counts it in the source, lang_n in the lang; one source leads. Every row is a document."""
    spark = docs.sparkSession
    small_batches(spark)
    packed = stored(docs.select("text", "lang", "source").mapInArrow(_pack, PACKED), "audit-packed")
    found, before, length, bits = [], 0, first, None
    while True:
        rows = packed.mapInArrow(_counted(before, length, bits), LEVEL)
        level = rows.groupBy("lang", "source", "prefix").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
        of = Window.partitionBy("lang", "prefix")  # the sources of a term, or one row of an unfinished prefix
        level = level.withColumns({"lang_docs": F.sum("docs").over(of), "lang_n": F.sum("n").over(of), "leads": F.col("source") == F.min("source").over(of)}).filter(F.col("lang_docs") >= least)
        level = stored(level.drop("docs", "lang_docs"), "audit-level")
        term = F.expr("decode(substring(prefix, 1, length(prefix) - 1), 'UTF-8')")
        found.append(level.filter("source is not null").select("lang", "source", term.alias("term"), "n", "lang_n", "leads"))
        alive = _bit_table(level.filter("source is null"), n_bits)
        if alive is None:
            return reduce(DataFrame.union, found)
        bits, before, length = spark.sparkContext.broadcast(alive), length, 2 * length


def _p(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact: decimals hold the product."""
    count, total, terms = (F.col(x) if isinstance(x, str) else x for x in (count, total, terms))
    up = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return 1 + F.call_function("div", up, F.greatest(total + terms, F.lit(1)).cast("decimal(19,0)"))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, n_bits: int = BITS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank.

    part `pair`: item is each other source of the lang, value sums f(p of the source, p of the item) over all kept terms of the
    lang, 0 without any; every rank. part `term`: item is each kept term that the source has and uses more than its lang, value f(p of
    the source, p of the lang), ranks to top. Here p = 1 + floor(10^9 (count + 1) / (total + kept terms)) and f(p, q) =
    floor((p - q)^2 / q). Ranks go by value, largest first, then item by its bytes.

    Nulls are read as ''; rows that repeat are documents of their own, ids are not used. Texts without terms still make their
    group. An empty table gives an empty result; other columns are ignored. The driver holds the bit table (n_bits / 8
    bytes); a worker holds one block's terms.
    """
    src = docs.select(text_of(text_col).alias("text"), text_of(lang_col).alias("lang"), text_of(source_col).alias("source"))
    terms = kept_terms(src, least, n_bits=n_bits)
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("leads").alias("terms"))
    groups = src.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "terms"])
    zero = _p(F.lit(0), "total", "terms")
    groups = stored(groups.withColumn("p0", zero), "audit-groups")
    n_groups = groups.count()

    used = with_groups(terms, groups, ["lang", "source"], n_groups)
    used = stored(used.select("lang", "source", "term", "p0", _p("n", "total", "terms").alias("p"), _p("lang_n", "lang_total", "terms").alias("q")), "audit-used")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term_part = used.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    term_part = term_part.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    pairs = _pairs(used, groups, n_groups)
    pair_part = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return pair_part.union(term_part)


def _pairs(used: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """lang, source, item, value for all ordered pairs of sources of a lang."""
    a = groups.select("lang", "source", "terms", F.col("p0").alias("a0"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("b0"))
    all_ = a.join(b, "lang").filter("source <> item")
    base = all_.select("lang", "source", "item", (F.col("terms") * _f(F.col("a0"), F.col("b0"))).alias("value"))

    # terms of one source, by value of p: what they change against a term that neither has, to both sides
    kinds = used.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("k"))
    others = kinds.join(groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("o0")), "lang").filter("source <> other")
    p, p0, o0, k = F.col("p"), F.col("p0"), F.col("o0"), F.col("k")
    as_source = F.struct(F.col("source").alias("source"), F.col("other").alias("item"), (k * (_f(p, o0) - _f(p0, o0))).alias("value"))
    as_item = F.struct(F.col("other").alias("source"), F.col("source").alias("item"), (k * (_f(o0, p) - _f(o0, p0))).alias("value"))
    ones = others.select("lang", F.explode(F.array(as_source, as_item)).alias("x")).select("lang", "x.*").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    # terms of both: each two sources meet once, for both directions
    x = used.select("lang", "term", "source", "p", "p0")
    y = used.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    more = lambda p, p0, q, q0: F.sum(_f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0))
    p, p0, q, q0 = (F.col(c) for c in ("p", "p0", "q", "q0"))
    met = x.join(y, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(more(p, p0, q, q0).alias("there"), more(q, q0, p, p0).alias("back"))
    sides = F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    twos = met.select("lang", F.explode(sides).alias("x")).select("lang", "x.*")
    return base.union(ones).union(twos).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
    w AS (SELECT k, lang, source, unnest(words) AS term FROM d),
    kept AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT k) >= {LEAST}),
    g AS (SELECT DISTINCT lang, source FROM d),
    n AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
    dense AS (SELECT g.lang, g.source, kept.term, coalesce(c, 0)::HUGEINT AS c FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
    own AS (SELECT lang, source, term, c, 1 + ({SCALE} * (c + 1)) // (sum(c) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM dense),
    lc AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM dense GROUP BY 1, 2),
    lp AS (SELECT lang, term, 1 + ({SCALE} * (c + 1)) // (sum(c) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM lc),
    pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM own JOIN lp USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= {TOP}"""
