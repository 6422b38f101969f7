"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over permuted blocks.

Every source is dealt into blocks by a hash of its documents, more blocks the more words it has.  A source's
target is drawn in passes: whole passes over all its blocks, then blocks until the target is reached.  The
blocks so drawn are the source's quota; a tree splits all quotas at once, halving the shards at each level by a
multivariate-hypergeometric draw, so that each shard gets an exact number of blocks of every source.  A source's
blocks are permuted by a hash of the seed, the source and the block; each shard draws its number of them from where the last
one ended, so draws are disjoint, and what a document gives is the sum over the shards' draws of its block.
Inside a shard documents are shuffled by a hash.

The block that crosses a source's target gives documents in hash order, and the document that crosses it its
first words.  Block sizes come from partial sums; the driver holds (sources x shards) quotas, in chunks of
sources, and no rows.  Windows run over sources (one row each) and over the blocks of one source.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from conjunx.llm.common import cut, pick, table

#: Blocks of a source: 2 to the power of BITS, more where a block would have more than BLOCK_WORDS words.
BITS, MOST_BITS, BLOCK_WORDS = 10, 30, 4_000_000
SHARDS = 16
WEIGHTS = (5, 2, 1)
#: Sources and blocks whose quotas are split at once on the driver.
CHUNK, CHUNK_BLOCKS = 50_000, 500_000_000
#: Words of a shard that are sorted in one task: so many that there are some ``TASKS`` tasks, but at least and at most these.
SLICE_WORDS, TASKS = (2_000_000, 50_000_000), 20_000
#: Tables of blocks and of sources are broadcast up to this number of rows, some 50 MB; larger ones are shuffled.
BROADCAST_ROWS = 200_000

_SPACE = r"[^\x20\x09-\x0D]+"
_DRAWS = "array<struct<pass:int,shard:int,part:boolean>>"


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each shard the number of blocks of each source: columns sum to ``quotas``, rows differ by few blocks."""
    draw = np.random.default_rng(seed)

    def part(have: np.ndarray, k: int) -> list[np.ndarray]:
        if k == 1:
            return [have]
        left = draw.multivariate_hypergeometric(have, int(have.sum()) * (k // 2) // k, method="marginals")
        return part(left, k // 2) + part(have - left, k - k // 2)

    return [x.tolist() for x in part(np.array(quotas, np.int64), shards)]


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target.  Sources in code point order, null last, weigh ``weights``, repeating, and
    share ``share`` of all words; a target stops at ``most`` times its source's size and the excess goes to the
    others by weight until none is above: target = min(cap, level x weight), where the level is the highest
    that ranks of sources by cap / weight allow."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(most)).alias("cap"))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    by = by.withColumn("at", level)
    highest = F.max(F.when(F.col("at") * F.col("w") <= F.col("cap"), F.col("at"))).over(every)
    return by.select("source", "source_size", F.least("cap", highest * F.col("w")).alias("target"))


def _ends(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """s, ends: after how many of a source's drawn blocks each shard's part of them ends."""
    spark = blocks.sparkSession
    quotas = blocks.groupBy("source").agg(F.sum(F.col("full") + (F.col("left") > 0).cast("long")).alias("n"))
    kind = T.StructType([T.StructField("s", T.StringType()), T.StructField("ends", T.ArrayType(T.LongType()))])
    out, have, total = None, [], 0

    def done() -> DataFrame:
        to = np.cumsum(np.array(split_quotas([r.n for r in have], shards, seed), np.int64), axis=0).T.tolist()
        df = spark.createDataFrame([(r.source, ends) for r, ends in zip(have, to, strict=True)], kind)
        return df if out is None else out.unionAll(df)

    for r in quotas.orderBy(F.col("source").asc_nulls_last()).toLocalIterator():
        if have and (len(have) == CHUNK or total + r.n > CHUNK_BLOCKS):
            out, have, total = done(), [], 0
        have.append(r)
        total += r.n
    return done() if have or out is None else out


def _sized(docs: DataFrame, doc_id: str, source: str, text: str, seed: int) -> DataFrame:
    """``docs`` with _source, _size, and _mark, a hash of id and text that deals rows to blocks and orders them."""
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(_SPACE)), F.lit(0)).cast("long")
    digest = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    mark = F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(str(seed)), digest).cast("binary"))
    return docs.withColumns({"_source": F.col(source).cast("string"), "_size": size, "_mark": mark})


def _known(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its size is within the bound."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class _Plan:
    """What the mix draws of each block: sources, blocks, and how to join them to rows of ``_sized``."""

    def __init__(self, sized: DataFrame, weights: tuple[int, ...], share: float, most: float, shards: int, seed: int):
        sources = sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("size"))
        goal = targets(sources, weights, share, most)
        bits = F.greatest(F.lit(BITS), F.least(F.lit(MOST_BITS), F.ceil(F.log2(F.greatest(F.col("source_size"), F.lit(1)) / F.lit(BLOCK_WORDS)))))
        self.sources = _known(goal.select(F.col("source").alias("_s"), "source_size", "target", bits.cast("int").alias("_bits")))
        placed = self._placed(sized.where("_size > 0"))
        blocks = placed.groupBy(F.col("_source").alias("source"), F.col("_block").alias("block"), "source_size", "target").agg(F.sum("_size").alias("block_size"))
        shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("source").isNull().cast("string"), F.col("block").cast("string")).cast("binary"))
        order = W.partitionBy("source").orderBy("rank", "block")
        blocks = (
            blocks.withColumn("rank", shuffled)
            .withColumn("upto", F.sum("block_size").over(order))
            .withColumn("filled", F.row_number().over(order))
            .withColumn("n_blocks", F.count("*").over(W.partitionBy("source")))
            .withColumn("full", F.expr("cast(floor(target) as bigint) div source_size"))
            .withColumn("left", F.floor("target") - F.col("full") * F.col("source_size") - (F.col("upto") - F.col("block_size")))
        )
        blocks = cut(blocks.select("source", "block", "block_size", "full", "left", "filled", "n_blocks"))
        ends = _ends(blocks, shards, seed)
        drawn = blocks.join(ends, F.col("source").eqNullSafe(F.col("s")))

        def draw(k, part):
            number = k * F.col("n_blocks") + F.col("filled") - 1
            return F.struct(k.cast("int").alias("pass"), F.size(F.filter("ends", lambda e: e <= number)).alias("shard"), part.alias("part"))

        passes = F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("full"), F.lit(1)) - 1), lambda k: draw(k, F.lit(False)))).otherwise(F.array().cast(_DRAWS))
        last = F.when(F.col("left") > 0, F.array(draw(F.col("full"), F.col("left") < F.col("block_size")))).otherwise(F.array().cast(_DRAWS))
        drawn = drawn.select("source", "block", F.concat(passes, last).alias("_draws"))
        self.blocks = _known(self._crossing(placed, blocks, drawn))

    @staticmethod
    def _crossing(placed: DataFrame, blocks: DataFrame, drawn: DataFrame) -> DataFrame:
        """The blocks' draws, with where a block that its source's target crosses is cut: its last row's mark, and the words that this row gives."""
        crossed = blocks.where("left > 0 and left < block_size").select(F.col("source").alias("s"), F.col("block").alias("b"), "left")
        rows = placed.join(F.broadcast(crossed) if crossed.count() <= BROADCAST_ROWS else crossed, F.col("_source").eqNullSafe(F.col("s")) & (F.col("_block") == F.col("b")))
        marks = rows.groupBy("s", "b", "left", "_mark").agg(F.sum("_size").alias("size"), F.count("*").alias("n"))
        marks = marks.withColumn("upto", F.sum("size").over(W.partitionBy("s", "b").orderBy("_mark")))
        at = marks.where("upto >= left and upto - size < left").select("s", "b", F.col("_mark").alias("_cut"), F.expr("(left - (upto - size)) div n").alias("_words"))
        same = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
        return drawn.join(at, same, "left").select(F.col("source").alias("_s"), F.col("block").alias("_b"), "_draws", "_cut", "_words")

    def _placed(self, sized: DataFrame) -> DataFrame:
        block = F.expr("shiftright(cast(conv(substring(_mark, 1, 8), 16, 10) as bigint), 32 - _bits)")
        return sized.join(self.sources, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_block", block).drop("_s", "_bits")

    def drawn(self, sized: DataFrame, seed: int) -> DataFrame:
        """``sized`` with source_size, target and draws."""
        rows = self._placed(sized).join(self.blocks, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")) & (F.col("_size") > 0), "left")
        part = F.when(F.col("_mark") < F.col("_cut"), F.col("_size")).when(F.col("_mark") == F.col("_cut"), F.col("_words")).otherwise(F.lit(0).cast("long"))
        place = lambda d: F.xxhash64(F.lit(seed), d["shard"], d["pass"], F.col("_mark"))
        draws = F.transform("_draws", lambda d: F.struct(d["pass"].alias("pass"), F.when(d["part"], part).otherwise(F.col("_size")).alias("words"), d["shard"].alias("shard"), place(d).alias("position")))
        draws = F.coalesce(F.filter(draws, lambda d: d["words"] > 0), F.array())
        return rows.withColumn("draws", draws).drop("_s", "_b", "_block", "_draws", "_cut", "_words")


def draws(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """Per document: doc_id, size, source_size, target and draws, an array of (pass, words, shard, position):
    the times the mix draws it, how many of its first words each takes, its shard and the order in that.

    Sizes count runs of characters other than space and \\x09-\\x0D; a null text has size 0 and is never drawn,
    nor is an empty one.  A null source is a source of its own.  Rows are told apart by id and text; rows equal in both
    are drawn alike, and where the target crosses them each gives as many first words.  No rows in, no rows out.
    The taken words of a source sum to floor(target), but for less than the number of rows equal to the last one
    drawn.  Reruns agree.
    """
    sized = cut(_sized(pick(docs, doc_id=doc_id, source=source, text=text), "doc_id", "source", "text", seed).drop("text", "source"))
    found = _Plan(sized, weights, share, most, shards, seed).drawn(sized, seed)
    return found.select("doc_id", F.col("_size").alias("size"), "source_size", "target", "draws")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """``docs`` as mixed: a row for each draw, with the columns of ``docs`` and mix_pass, mix_words, mix_shard and
    mix_position, dealt to tasks by shard and sorted in it by mix_position; a shard of many words is several
    tasks, one after another.  Documents that no shard draws are left out.  Every row gets its own draws,
    whatever its id (``draws`` says which); texts are shuffled once."""
    own = docs.columns
    sized = _sized(docs.toDF(*(f"c{k}" for k in range(len(own)))), *(f"c{own.index(c)}" for c in (doc_id, source, text)), seed)
    few = cut(sized.select("_source", "_size", "_mark"))
    plan = _Plan(few, weights, share, most, shards, seed)
    words = plan.sources.agg(F.sum("target")).first()[0] or 0.0
    least, most_words = SLICE_WORDS
    slices = max(1, int(np.ceil(words / shards / min(most_words, max(least, words / TASKS)))))
    out = plan.drawn(sized, seed).select(*(f"c{k}" for k in range(len(own))), F.inline("draws").alias("mix_pass", "mix_words", "mix_shard", "mix_position"))
    part = (F.col("mix_shard") * slices + F.floor((F.col("mix_position") / 2.0**64 + 0.5) * slices).cast("int")).cast("int")
    out = out.withColumn("_part", F.least(part, F.lit(shards * slices - 1))).repartitionById(shards * slices, F.col("_part")).drop("_part")
    return out.sortWithinPartitions("mix_shard", "mix_position").toDF(*own, "mix_pass", "mix_words", "mix_shard", "mix_position")


def op7_mix(spark, sf_dir: str) -> DataFrame:
    """Per document: its words, its source's words and target, the words that the mix takes of it, and how many each
    shard draws (shard:words by shard, comma-joined)."""
    rows = draws(table(spark, sf_dir, "documents"))
    each = F.transform(F.array_sort(F.transform("draws", lambda d: F.struct(d["shard"], d["pass"], d["words"]))), lambda d: F.concat_ws(":", d["shard"].cast("string"), d["words"].cast("string")))
    return rows.select("doc_id", "size", "source_size", "target", F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + d["words"]).alias("taken"), F.array_join(each, ",").alias("shards"))
