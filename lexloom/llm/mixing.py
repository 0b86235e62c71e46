"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree. DataFrame operations only.

A source's documents fall into blocks by a hash, about the square root of all rows in number (:func:`blocks_of`). A source takes whole passes over all its blocks, then
whole blocks in a permuted order, passing over those that no longer fit under its target, then single documents of the next blocks left, then of
the other documents of these and of up to ``FILL`` drawn at random those that still fit. What a source takes is thus an exact number of block units. The units of all
sources are dealt to the output shards by a binary tree: a node holds a number of units for each source, its left half gets as many as a multivariate
hypergeometric draw without replacement says (inverse of the exact distribution, fed by hashes of seed, node and source), the
right half gets the rest; shards end up with equal numbers of units. Each shard then takes its quota from the source's
permuted units, so that shards are disjoint, and its rows are shuffled by a hash within the shard.

So tables that describe a source's blocks, windows over these and windows over the documents of a block (those that the
single ones come from: as many as hold the words still wanted, mostly one) all grow with the square root of the rows. Rows meet their blocks and
single documents in shuffled joins, whatever the estimates of their sizes.

Defined results: rows with the same source and doc_id are one document; a null source is a source, last in order; a null text has
size 0; sources without words get target 0; all draws are functions of seed, source and doc_id, so reruns agree; a row's own
columns stay as they are, results have the prefix ``_lx_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FILL, CAP = 64, 3
LEAST_BLOCKS = 256
SHARDS, SEED = 8, 17

_KEY = ["_lx_src", "_lx_nul"]


def words(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def blocks_of(rows: int) -> int:
    """Blocks a source: a power of two near the square root of the number of rows."""
    return max(LEAST_BLOCKS, 1 << (max(rows, 1).bit_length() // 2))


def keyed(docs: DataFrame, seed: int = SEED, blocks: int = LEAST_BLOCKS) -> DataFrame:
    """Adds the source's key and the document's block."""
    return docs.withColumns({"_lx_src": F.coalesce(F.col("source"), F.lit("")), "_lx_nul": F.col("source").isNull()}).withColumn("_lx_block", F.pmod(F.xxhash64(F.lit(seed), "_lx_src", "doc_id"), F.lit(blocks)).cast("int"))


def targets(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3 in the order of the sources, and targets by water-filling under the cap.

    With the sources in the order of cap by weight, the level that is left for a source if all before it are capped
    falls below its own cap at the first source that isn't capped; that level holds for all from there on."""
    order = Window.orderBy(F.col("_lx_nul"), F.col("_lx_src"))
    sources = sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("cap", F.lit(float(CAP)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "_lx_nul", "_lx_src")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = sources.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") < F.col("cap"))
    rest = F.min_by("level", F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "_lx_nul", "_lx_src"))).over(everything)
    return leveled.withColumn("target", F.when(rest.isNull(), F.col("cap")).otherwise(F.least("cap", rest * F.col("weight")))).drop("level", "free")


#: One draw for source ``s`` of a fold over a node's sources, ``acc`` holding the units not yet looked at and the left half's free
#: places: the first inner fold sums the distribution's weights (relative, in logs), the second inverts it.
_LO, _HI = "greatest(0L, acc.free - (acc.rest - s.k))", "least(s.k, acc.free)"
_NEXT = "w.lw + if(x < {hi}, ln(double(s.k - x)) + ln(double(acc.free - x)) - ln(double(x + 1)) - ln(double(acc.rest - s.k - acc.free + x + 1)), 0d)".format(hi=_HI)
_SUM = f"""aggregate(sequence({_LO}, {_HI}), named_struct('lw', 0d, 'm', double('-Infinity'), 's', 0d), (w, x) -> named_struct(
  'lw', {_NEXT}, 'm', greatest(w.m, w.lw), 's', w.s * exp(w.m - greatest(w.m, w.lw)) + exp(w.lw - greatest(w.m, w.lw))), w -> named_struct('m', w.m, 's', w.s))"""
_H = f"""if({_LO} >= {_HI}, {_HI}, aggregate(array({_SUM}), 0L, (z, t) ->
  aggregate(sequence({_LO}, {_HI}), named_struct('lw', 0d, 'c', 0d, 'pick', -1L), (w, x) -> named_struct(
  'lw', {_NEXT}, 'c', w.c + exp(w.lw - t.m) / t.s, 'pick', if(w.pick < 0 and w.c + exp(w.lw - t.m) / t.s >= pmod(xxhash64(seed, node, s._lx_src, s._lx_nul), 9007199254740992L) / 9007199254740992d, x, w.pick)), w -> if(w.pick < 0, {_HI}, w.pick))))"""


def split_tree(units: DataFrame, shards: int, seed: int) -> DataFrame:
    """(_lx_src, _lx_nul, shard, quota) from (_lx_src, _lx_nul, k): level by level, every node a row with an array of its sources."""
    node = units.groupBy().agg(F.sort_array(F.collect_list(F.struct("_lx_src", "_lx_nul", F.col("k").cast("long").alias("k")))).alias("units"), F.sum("k").cast("long").alias("total"))
    node = node.where(F.col("total").isNotNull()).select(F.lit(1).cast("long").alias("node"), F.lit(0).alias("a"), F.lit(shards).alias("b"), "units", "total", F.col("total").alias("all"))
    edge = lambda c: F.floor(F.col("all") * F.col(c) / F.lit(shards))  # noqa: E731  the first unit of shard c
    levels = max(0, (shards - 1).bit_length())
    for _ in range(levels):
        # h is spelled out once as an array and read twice, so that one draw serves both halves
        half = node.withColumn("mid", F.floor((F.col("a") + F.col("b")) / 2).cast("int")).withColumn("room", (edge("mid") - edge("a")).cast("long")).withColumn("seed", F.lit(seed).cast("long"))
        half = half.withColumn("left", F.expr("aggregate(units, named_struct('rest', total, 'free', room, 'out', cast(array() as array<bigint>)), (acc, s) -> aggregate(array(" + _H + "), acc, (o, h) -> named_struct('rest', o.rest - s.k, 'free', o.free - h, 'out', concat(o.out, array(h)))), acc -> acc.out)"))
        sides = F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("a").alias("a"), F.col("mid").alias("b"), F.expr("zip_with(units, left, (u, h) -> named_struct('_lx_src', u._lx_src, '_lx_nul', u._lx_nul, 'k', h))").alias("units"), F.col("room").alias("total")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.col("mid").alias("a"), F.col("b").alias("b"), F.expr("zip_with(units, left, (u, h) -> named_struct('_lx_src', u._lx_src, '_lx_nul', u._lx_nul, 'k', u.k - h))").alias("units"), (F.col("total") - F.col("room")).alias("total")),
        ))
        whole = node.where(F.col("b") - F.col("a") <= 1)
        node = half.where(F.col("b") - F.col("a") > 1).select(sides.alias("n"), "all").select("n.*", "all").unionByName(whole.select("node", "a", "b", "units", "total", "all"))
    return node.select(F.col("a").alias("shard"), F.explode("units").alias("u")).select("u._lx_src", "u._lx_nul", "shard", F.col("u.k").alias("quota"))


class Mix:
    """What to take: ``blocks`` (_lx_block: full passes and their shards, the extra pass and its shard) and ``singles`` (documents of the last,
    partial unit), both keyed by source; ``sources`` has the targets."""

    def __init__(self, rows: DataFrame, root: str, shards: int = SHARDS, seed: int = SEED):
        """rows: doc_id, source, size."""
        self.rows, self.n_blocks = rows, blocks_of(rows.count())
        rows = keyed(rows, seed, self.n_blocks)
        block = written(rows.groupBy(*_KEY, "_lx_block").agg(F.sum("size").alias("words")), f"{root}/blocks")
        sources = block.groupBy(*_KEY).agg(F.sum("words").alias("source_size"), F.count(F.lit(1)).alias("blocks"))
        planned = targets(sources).withColumn("full", F.when(F.col("source_size") > 0, F.least(F.lit(CAP), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0)).cast("int"))
        planned = planned.withColumn("rest", F.when(F.col("full") >= CAP, F.lit(0.0)).otherwise(F.col("target") - F.col("full") * F.col("source_size")))
        self.sources = written(planned, f"{root}/sources")
        # whole blocks in a permuted order; one that doesn't fit is passed over, so that the room left is less than any block left
        rank = F.xxhash64(F.lit(seed + 1), "_lx_src", "_lx_block")
        ranked = block.join(self.sources.select(*_KEY, "rest"), _KEY).where(F.col("rest") > 0).groupBy(*_KEY, "rest").agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "_lx_block", "words"))).alias("all"))
        walk = F.expr("""aggregate(all, named_struct('room', rest, 'past', false, 'in', cast(array() as array<int>)), (a, b) -> if(b.words <= a.room and (b.words > 0 or not a.past),
          named_struct('room', a.room - b.words, 'past', a.past, 'in', concat(a.in, array(b._lx_block))), named_struct('room', a.room, 'past', true, 'in', a.in)))""")
        walked = written(ranked.select(*_KEY, walk.alias("w")).select(*_KEY, F.col("w.room").alias("left_"), F.col("w.past").alias("past"), F.col("w.in").alias("in")), f"{root}/walked")
        extra = walked.select(*_KEY, F.explode("in").alias("_lx_block")).withColumn("extra", F.lit(True))
        placed = block.join(self.sources.select(*_KEY, "full", "rest"), _KEY).join(extra, [*_KEY, "_lx_block"], "left").withColumn("extra", F.coalesce("extra", F.lit(False)))
        placed = written(placed, f"{root}/placed")
        # single documents that fit, of as many blocks left as hold the room's words, in a permuted order up to the target
        cut = walked.where(F.col("past") & (F.col("left_") > 0)).select(*_KEY, "left_")
        fits = rows.join(placed.where(~F.col("extra")).select(*_KEY, "_lx_block"), [*_KEY, "_lx_block"], "left_semi").groupBy(*_KEY, "doc_id", "_lx_block").agg(F.sum("size").alias("size")).join(cut, _KEY)
        fits = written(fits.where(F.col("size") <= F.col("left_")), f"{root}/fits")
        before = Window.partitionBy(*_KEY).orderBy(rank, "_lx_block").rowsBetween(Window.unboundedPreceding, -1)
        chosen = fits.groupBy(*_KEY, "_lx_block", "left_").agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).where(F.col("before") < F.col("left_")).select(*_KEY, "_lx_block")
        chosen = written(chosen, f"{root}/chosen")
        within = Window.partitionBy(*_KEY).orderBy(rank, "_lx_block", F.xxhash64(F.lit(seed + 2), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        near = written(fits.join(chosen, [*_KEY, "_lx_block"]).withColumn("cum", F.sum("size").over(within)), f"{root}/near")
        first = near.where(F.col("cum") <= F.col("left_")).select(*_KEY, "doc_id", "size")
        # then those of these blocks and a few of the others that still fit, larger ones first
        taken = first.groupBy(*_KEY).agg(F.sum("size").alias("taken_"))
        gap = cut.join(taken, _KEY, "left").withColumn("gap_", F.col("left_") - F.coalesce("taken_", F.lit(0))).select(*_KEY, "gap_")
        still = lambda frame: frame.join(gap, _KEY).where((F.col("size") > 0) & (F.col("size") <= F.col("gap_"))).select(*_KEY, "size", "doc_id")
        some = still(fits.join(chosen, [*_KEY, "_lx_block"], "left_anti")).withColumn("n_", F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.xxhash64(F.lit(seed + 3), "doc_id"), "doc_id"))).where(F.col("n_") <= FILL).drop("n_")
        fill = still(near.where(F.col("cum") > F.col("left_"))).unionByName(some).groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("size", "doc_id")), asc=False).alias("open")).join(gap, _KEY)
        fill = fill.select(*_KEY, F.explode(F.expr("aggregate(open, named_struct('room', gap_, 'in', slice(open, 1, 0)), (a, d) -> if(d.size <= a.room, named_struct('room', a.room - d.size, 'in', concat(a.in, array(d))), a), a -> a.in)")).alias("d"))
        singles = first.select(*_KEY, "doc_id").unionByName(fill.select(*_KEY, "d.doc_id"))
        # block units, and the shard of each
        units = placed.select(*_KEY, "_lx_block", F.explode(F.sequence(F.lit(1), F.col("full") + F.col("extra").cast("int") + F.lit(1))).alias("pass"), "full", "extra").where(F.col("pass") <= F.col("full") + F.col("extra").cast("int")).select(*_KEY, "_lx_block", "pass")
        last = cut.select(*_KEY, F.lit(-1).alias("_lx_block"), F.lit(1).alias("pass"))
        units = units.unionByName(last).withColumn("at", F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.xxhash64(F.lit(seed + 4), "_lx_block", "pass"), "_lx_block", "pass")))
        units = written(units, f"{root}/units")
        quota = split_tree(units.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("k")), shards, seed)
        upto = F.sum("quota").over(Window.partitionBy(*_KEY).orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
        shelf = written(quota.withColumn("upto", upto), f"{root}/quotas").groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("shard", "upto"))).alias("ends"))
        dealt = units.join(shelf, _KEY).select(*_KEY, "_lx_block", "pass", F.expr("filter(ends, e -> e.upto >= at)[0].shard").alias("shard"))
        self.quotas = shelf
        self.blocks = written(dealt.where(F.col("_lx_block") >= 0).groupBy(*_KEY, "_lx_block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("_lx_passes")), f"{root}/passes")
        self.singles = written(singles.join(dealt.where(F.col("_lx_block") < 0).select(*_KEY, F.col("shard").alias("_lx_single")), _KEY), f"{root}/singles")
        self.seed = seed

    def applied(self, docs: DataFrame) -> DataFrame:
        """The rows with _lx_shards (where each copy goes) and _lx_copies (how often the mix takes them) behind their own columns."""
        found = self._joined(docs)
        return found.select(*[F.col(f"`{c}`") for c in docs.columns], self._shards().alias("_lx_shards")).withColumn("_lx_copies", F.size("_lx_shards"))

    def assigned(self) -> DataFrame:
        """(source's key, document's key, _lx_shards) of every document that the mix takes."""
        found = self._joined(self.rows).select(*_DOCUMENT, self._shards().alias("_lx_shards"))
        return found.where(F.size("_lx_shards") > 0).dropDuplicates(_DOCUMENT)

    @staticmethod
    def _shards():
        none = F.expr("cast(array() as array<int>)")
        return F.concat(F.coalesce(F.expr("transform(_lx_passes, p -> p.shard)"), none), F.when(F.col("_lx_single").isNotNull(), F.array("_lx_single")).otherwise(none))

    def _joined(self, docs: DataFrame) -> DataFrame:
        singles = _named(self.singles).select(*_DOCUMENT, "_lx_single")
        return _named(keyed(docs, self.seed, self.n_blocks)).join(self.blocks.hint("merge"), [*_KEY, "_lx_block"], "left").join(singles.hint("merge"), _DOCUMENT, "left")


_DOCUMENT = [*_KEY, "_lx_none", "_lx_doc"]


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_lx_none": F.col("doc_id").isNull(), "_lx_doc": F.coalesce("doc_id", F.lit(0))})


def mixed_rows(docs: DataFrame, mix: Mix) -> DataFrame:
    """The mix itself: each row as often as it is taken, with its _lx_shard and _lx_copy; rows are dealt to partitions by a hash of shard, document and copy
    and stand in the hash's order there, so that a shard of any size is shuffled without coming together in one task. Whole rows are only
    moved to meet their assignment and to be dealt out."""
    found = _named(keyed(docs, mix.seed, mix.n_blocks)).join(mix.assigned().hint("merge"), _DOCUMENT)
    taken = found.select(*[F.col(f"`{c}`") for c in docs.columns], F.posexplode("_lx_shards").alias("_lx_copy", "_lx_shard"))
    order = F.xxhash64(F.lit(mix.seed + 5), "_lx_shard", "doc_id", "_lx_copy")
    return taken.repartition(order).sortWithinPartitions("_lx_shard", order, "doc_id")
