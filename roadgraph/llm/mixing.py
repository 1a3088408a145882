"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then seeded selection of blocks.

1. Targets. A share of all words goes to the sources by weight; what a source gets beyond `most` times its own size is
   shared again by weight. That is one level for all sources that stay below: the largest of (rest of the words) / (rest of
   the weights) over the sources ordered by size / weight, each taken with those before it filled up.
2. Blocks. The documents of a source are dealt to shards of bounded size by a seeded hash and lie there in the order of the
   hash; each run of `block` words is a block, the last of a shard may be shorter.
3. Quotas. Blocks are seats: highest quotients target / 1, target / 3, target / 5 ... give each source its number, then
   highest quotients of the shards' block counts give each shard its own. Only the few quotients near the end of the count
   are ranked: with n parties the seats lie between those of the divisors total / (seats + n / 2) and total / (seats - n / 2).
4. Selection. A shard with quota q of m blocks takes every block q div m times and q mod m of them once more: those where a
   line of that slope with a seeded start passes a whole number. What a document gives is then the difference of one
   closed-form sum at its end and its start: no row is made for a block.

All steps are DataFrame expressions. Windows run over a shard's rows, over all sources (one row for each), and over the
shards of a source (four rows for each).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, row_key, stored, table, text_of, with_groups

WEIGHTS = (5, 2, 1)
#: Words of the mix for each word of the corpus, and times that a word may be taken at most.
SHARE = 1.5
MOST = 2
#: Words of a block at most, and blocks that the smallest target has at least (as far as it has words).
BLOCK = 1024
FINE = 1000
#: Words and rows of a shard on average.
SHARD_WORDS = 2_000_000
SHARD_ROWS = 5_000
#: Copies of one row that are numbered by one task.
CHUNK = 10_000
SEED = 42


def target_sizes(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds place (0 for the first source by code point, null last) and target to sizes(source, source_size)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("double")
    own = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(most)))
    all_ = Window.partitionBy()
    fill = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    rest = F.sum("source_size").over(all_) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    own = own.withColumn("level", rest / F.sum("weight").over(after)).withColumn("level", F.max("level").over(all_))
    return own.select(*sizes.columns, "place", F.least(F.col("most"), F.col("level") * F.col("weight")).alias("target"))


def apportion(items: DataFrame, group: list[str], item: str, weight: str, seats: str) -> DataFrame:
    """Adds quota to items: seats of each group (a column, equal in the group) by highest quotients weight / (2 k + 1), ties by
    item. Weights are positive. Only about four quotients an item are ranked (see the module's text)."""
    of = Window.partitionBy(*group)
    n, total = F.count(F.lit(1)).over(of), F.sum(weight).over(of)
    per = lambda s: F.floor(F.col(weight) * s / F.col("total_of_group") + 0.5)
    half = F.col("items_of_group") / 2
    sure = F.greatest(F.lit(0), per(F.greatest(F.lit(0.0), F.col(seats) - half)) - 1)
    own = items.withColumns({"items_of_group": n, "total_of_group": total}).withColumns({"sure": sure, "upto": per(F.col(seats) + half) + 1})
    open_ = own.withColumn("open_in_group", F.col(seats) - F.sum("sure").over(of)).withColumn("k", F.explode(F.sequence("sure", "upto")))
    best = Window.partitionBy(*group).orderBy(F.desc(F.col(weight) / (2 * F.col("k") + 1)), item, "k")
    won = open_.withColumn("rank_in_group", F.row_number().over(best)).groupBy(*items.columns, "sure").agg(F.count_if(F.col("rank_in_group") <= F.col("open_in_group")).alias("won"))
    return won.select(*items.columns, (F.col("sure") + F.col("won")).alias("quota"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with copy: 0, 1, 2 ... for equal rows. Equal rows are counted, and numbered by as many tasks as they fill."""
    n = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n_of_row"))
    once = n.filter("n_of_row = 1").select(*rows.columns, F.lit(0).cast("long").alias("copy"))
    parts = n.filter("n_of_row > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_of_row") - 1) / CHUNK))))
    parts = parts.repartition(F.xxhash64("row_key", "part"))
    last = F.least(F.col("n_of_row"), (F.col("part") + 1) * CHUNK) - 1
    return once.union(parts.select(*rows.columns, F.explode(F.sequence(F.col("part") * CHUNK, last)).alias("copy")))


def _copies(k: Column) -> Column:
    """How often the first k blocks of a shard are taken, all together."""
    extra = F.expr("quota % n_blocks")
    return k * F.expr("quota div n_blocks") + F.floor((k * extra + F.col("from_")) / F.col("n_blocks"))


def _taken(x: Column) -> Column:
    """Words that the mix takes from the first x words of a shard."""
    k = F.floor(x / F.col("block"))
    return F.col("block") * _copies(k) + (x - k * F.col("block")) * (_copies(k + 1) - _copies(k))


def mix_documents(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, and where the document lies: shard, start (in
    words of the shard), block, n_blocks, quota and from_ (see selected_blocks).

    Null text has size 0; a null source is a source of its own, the last. A source without words has target 0. Ids may be of
    any type, null, or repeated: rows with equal id, text and source are copies, which are numbered, so that each is
    taken by itself and a hot one is dealt to all shards. No document is taken more than `most` times. Reruns agree, on
    any partitioning. Ties of quotients go to the earlier source or shard. An empty table gives an empty result; other columns
    are ignored.
    """
    words = F.regexp_count(text_of(text_col), F.lit(f"[^{BLANKS}]+")).cast("long")
    narrow = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"), row_key(F.col(id_col), F.col(text_col)).alias("row_key")), "mix-rows")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    sources = target_sizes(sizes, weights, share, most)
    own_block = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy()) / FINE)))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("n_rows") / SHARD_ROWS))
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    sources = stored(sources.withColumns({"block": own_block.cast("long"), "n_shards": shards, "source_key": named}).drop("n_rows"), "mix-sources")

    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lower(F.hex("row_key")), F.col("copy").cast("string")).cast("binary"))
    rows = with_groups(_numbered(narrow).withColumn("source_key", named).drop("source"), sources, ["source_key"], sources.count())
    rows = rows.withColumn("digest", digest).withColumn("shard", F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.col("n_shards")).cast("int"))
    rows = stored(rows.select("doc_id", "source", "size", "source_size", "target", "place", "shard", "digest", "block"), "mix-dealt")

    quotas = _quotas(rows, sources, most, seed)
    at = Window.partitionBy("place", "shard").orderBy("digest")
    laid = rows.drop("block").withColumn("end", F.sum("size").over(at)).join(quotas, ["place", "shard"], "left")
    start = F.col("end") - F.col("size")
    taken = F.coalesce(_taken(F.col("end")) - _taken(start), F.lit(0))
    return laid.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "shard", start.alias("start"), "block", "n_blocks", "quota", "from_")


def _quotas(rows: DataFrame, sources: DataFrame, most: int, seed: int) -> DataFrame:
    """place, shard, block, n_blocks, quota, from_ of every shard that has words."""
    n_blocks = F.ceil(F.sum("size") / F.first("block"))
    shards = stored(rows.groupBy("place", "shard").agg(F.first("block").alias("block"), n_blocks.alias("n_blocks")).filter("n_blocks > 0"), "mix-shards")
    have = shards.groupBy("place").agg(F.sum("n_blocks").alias("blocks_of_source"))
    seats = F.round(F.sum("target").over(Window.partitionBy()) / F.col("block")).cast("long")
    wants = apportion(sources.filter("target > 0").select("place", "target", F.lit(0).alias("all"), seats.alias("seats")), ["all"], "place", "target", "seats")
    wants = have.join(wants, "place").select("place", F.least("quota", F.col("blocks_of_source") * most).alias("seats"))
    found = apportion(shards.join(wants, "place"), ["place"], "shard", "n_blocks", "seats")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("place").cast("string"), F.col("shard").cast("string")).cast("binary"))
    return found.select("place", "shard", "block", "n_blocks", "quota", F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.col("n_blocks")).alias("from_"))


def selected_blocks(mixed: DataFrame) -> DataFrame:
    """The mix itself, from what mix_documents returns: one row for each block, or part of one, of a document that is taken:
    doc_id, source, shard, block_no, first_word, n_words, times. Words are numbered from 0 in the document."""
    last = F.floor((F.col("start") + F.col("size") - 1) / F.col("block"))
    own = mixed.filter("taken > 0").withColumn("block_no", F.explode(F.sequence(F.floor(F.col("start") / F.col("block")), last)))
    begin = F.greatest(F.col("start"), F.col("block_no") * F.col("block"))
    end = F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * F.col("block"))
    times = _copies(F.col("block_no") + 1) - _copies(F.col("block_no"))
    return own.select("doc_id", "source", "shard", "block_no", (begin - F.col("start")).alias("first_word"), (end - begin).alias("n_words"), times.alias("times")).filter("times > 0")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP13_SQL = rf"""
WITH narrow AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5(CASE WHEN doc_id IS NULL THEN '-' ELSE '=' || doc_id || ' ' END || coalesce(text, '')) AS k FROM documents),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, k) - 1 AS copy FROM narrow),
    sized AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM narrow GROUP BY 1),
    placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized),
    weighed AS (SELECT *, [5.0, 2.0, 1.0][place % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM placed),
    levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
    targets AS (SELECT *, least(most, max(level) OVER () * weight) AS target FROM levels),
    sources AS (SELECT source, source_size, place, target, greatest(1, least({BLOCK}, floor(min(CASE WHEN target > 0 THEN target END) OVER () / {FINE})))::BIGINT AS block,
        greatest(1, ceil(source_size / {SHARD_WORDS}), ceil(n_rows / {SHARD_ROWS}))::BIGINT AS n_shards FROM targets),
    dealt AS (SELECT n.doc_id, n.size, s.*, md5('{SEED}:' || k || ':' || copy) AS digest FROM numbered n JOIN sources s ON n.source IS NOT DISTINCT FROM s.source),
    rws AS (SELECT *, ('0x' || digest[:8])::BIGINT % n_shards AS shard FROM dealt),
    shards AS (SELECT place, shard, any_value(block) AS block, ceil(sum(size) / any_value(block))::BIGINT AS n_blocks FROM rws GROUP BY 1, 2 HAVING sum(size) > 0),
    seats AS (SELECT place, target, round(sum(target) OVER () / block)::BIGINT AS seats FROM sources WHERE target > 0),
    q1 AS (SELECT place, count(*) AS quota FROM (SELECT place, seats, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place, k) AS nth
        FROM (SELECT place, target, seats, unnest(range(CAST(floor(target * seats / sum(target) OVER ()) + 20 AS BIGINT))) AS k FROM seats)) WHERE nth <= seats GROUP BY 1),
    wants AS (SELECT place, least(quota, 2 * blocks)::BIGINT AS seats FROM q1 JOIN (SELECT place, sum(n_blocks) AS blocks FROM shards GROUP BY 1) USING (place)),
    q2 AS (SELECT place, shard, count(*) FILTER (nth <= seats) AS quota FROM (SELECT place, shard, seats, row_number() OVER (PARTITION BY place ORDER BY n_blocks / (2 * k + 1) DESC, shard, k) AS nth
        FROM (SELECT place, shard, n_blocks, seats, unnest(range(CAST(floor(n_blocks * seats / sum(n_blocks) OVER (PARTITION BY place)) + 20 AS BIGINT))) AS k FROM shards JOIN wants USING (place))) GROUP BY 1, 2),
    shard_quota AS (SELECT place, shard, block, n_blocks, quota, ('0x' || md5('{SEED}:' || place || ':' || shard)[:8])::BIGINT % n_blocks AS f FROM shards JOIN q2 USING (place, shard)),
    laid AS (SELECT doc_id, size, source_size, target, place, shard, sum(size) OVER (PARTITION BY place, shard ORDER BY digest ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM rws),
    cut AS (SELECT l.*, q.* EXCLUDE (place, shard), e // block AS k1, (e - size) // block AS k0 FROM laid l LEFT JOIN shard_quota q USING (place, shard)),
    got AS (SELECT *, k1 * (quota // n_blocks) + (k1 * (quota % n_blocks) + f) // n_blocks AS c1, (k1 + 1) * (quota // n_blocks) + ((k1 + 1) * (quota % n_blocks) + f) // n_blocks AS d1,
        k0 * (quota // n_blocks) + (k0 * (quota % n_blocks) + f) // n_blocks AS c0, (k0 + 1) * (quota // n_blocks) + ((k0 + 1) * (quota % n_blocks) + f) // n_blocks AS d0 FROM cut)
SELECT doc_id, size, source_size, target, coalesce(block * c1 + (e - k1 * block) * (d1 - c1) - block * c0 - (e - size - k0 * block) * (d0 - c0), 0)::BIGINT AS taken FROM got"""
