"""Mix sources to target weights, in blocks, over a number of output shards.

1. *Targets.* The mix takes ``share`` times all words. Sources split this by weight; a source stops at
   ``max_epochs`` times its own words and what is left over is shared again by weight (found by rounds of one
   aggregate each, until no further source is over).
2. *Draws.* A source is read in whole epochs and a part of one more. The last epoch takes documents in a hashed order up
   to the cut nearest to the target. Documents over a small share of the target come first in that order if all of
   them fit into the part, else last, so that the cut falls among small documents. Running totals are taken per (source, slice
   of the hash range), so a source with a third of all rows is many tasks.
3. *Blocks.* The drawn documents of a source, in hashed order, are cut into blocks of ``block_words`` words.
4. *Splitting tree.* The block quotas of all sources start at one node that stands for all shards. A node is halved: how many of
   each source's blocks go left is a multivariate hypergeometric draw with an exactly fixed total, made source by source from
   conditional hypergeometric draws by inverting the distribution outwards from its mode. The leaves are the shards;
   every quota is kept exactly and shard sizes differ by at most one block. The draws use hashes of (seed, node, source) as random numbers,
   so reruns agree.
5. *Dealing.* Shards take disjoint runs of a source's blocks, which are in hashed order already, and each row gets a hashed key for
   the shuffle inside its shard.

The table of sources is gathered in one row (it is a dimension: one entry per source). Everything else stays distributed.

Defined cases: a null text has no words and is never drawn (its ``copies`` is 0); a null source is the last source; repeated rows are
separate documents that share a hash, and the cut may fall among them; a single document that is larger than its source's target is taken or left, whichever is nearer; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoloom.llm.tables import stored, word_count
from cytoloom.plans.ranking import positions, running_totals

WEIGHTS = (5, 2, 1)
#: A source is cut into 2**SLICE_BITS slices of the hash range for running totals.
SLICE_BITS = 10
#: A document over 1/LARGE of what the last epoch takes of its source counts as large.
LARGE = 16


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """``sized(source, mass)`` -> ``(source, source_no, source_size, weight, target)``, one row per source."""
    sums = sized.groupBy("source").agg(F.sum("mass").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.pmod(F.col("source_no"), F.lit(len(weights)))]
    sums = stored(
        sums.withColumn("source_no", number)
        .withColumn("weight", weight)
        .withColumn("cap", (F.col("source_size") * max_epochs).cast("double")),
        "mix-sources",
    )
    level = 0.0  # words per unit of weight
    settled = 0
    while True:
        over = F.col("cap") < level * F.col("weight")
        got = sums.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("capped"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if not got["free"] or (level and got["n"] == settled):
            break
        settled = got["n"]
        level = (share * got["all"] - got["capped"]) / got["free"]
        if not level:
            break
    return sums.withColumn("target", F.least(F.col("cap"), level * F.col("weight"))).drop("cap")


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked items among ``drawn`` out of ``total`` items of which ``marked`` are marked, for a uniform ``u``.

    Weights relative to the mode come from the ratio of neighbouring probabilities. They are summed over the support, or over 12 standard
    deviations around the mode where that is narrower (all that double precision can tell from 0).
    """

    def solve(x: Column) -> Column:
        n, k, d, r = x["n"], x["k"], x["d"], x["u"]
        low = F.greatest(F.lit(0).cast("long"), d + k - n)
        high = F.least(k, d)
        mode = F.least(high, F.greatest(low, F.floor((d + 1) * (k + 1) / (n + 2)).cast("long")))
        spread = F.sqrt(d.cast("double") * k / n * (n - k) / n * (n - d) / F.greatest(n - 1, F.lit(1))) * 12 + 20
        lo = F.greatest(low, mode - spread.cast("long"))
        hi = F.least(high, mode + spread.cast("long"))

        def up(v):  # p(v) / p(v - 1)
            return (k - v + 1).cast("double") * (d - v + 1) / (v.cast("double") * (n - k - d + v))

        def start(at):
            return F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), at.alias("v"))

        one = F.lit(1).cast("long")
        none = F.array().cast("array<bigint>")
        rise = F.when(hi > mode, F.sequence(mode + 1, hi, one)).otherwise(none)
        fall = F.when(mode > lo, F.sequence(mode, lo + 1, -one)).otherwise(none)

        def add(a, ratio, v):
            w = a["w"] * ratio
            return F.struct(w.alias("w"), (a["s"] + w).alias("s"), v.alias("v"))

        above = F.aggregate(rise, start(mode), lambda a, v: add(a, up(v), v), lambda a: a["s"])
        below = F.aggregate(fall, start(mode), lambda a, v: add(a, 1 / up(v), v), lambda a: a["s"])

        def pick(sums):
            at = r * (1.0 + sums["a"] + sums["b"]) - 1.0

            def walk(steps, aim, ratio, shift):
                state = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), mode.alias("v"))
                return F.aggregate(
                    steps,
                    state,
                    lambda a, v: F.when(a["s"] >= aim, a).otherwise(add(a, ratio(v), v + shift)),
                    lambda a: a["v"],
                )

            return (
                F.when(at < 0, mode)
                .when(at < sums["a"], walk(rise, at, up, 0))
                .otherwise(walk(fall, at - sums["a"], lambda v: 1 / up(v), -1))
            )

        return F.transform(F.array(F.struct(above.alias("a"), below.alias("b"))), pick)[0]

    packed = F.struct(total.alias("n"), marked.alias("k"), drawn.alias("d"), u.alias("u"))
    return F.when((marked == 0) | (drawn == 0), F.lit(0).cast("long")).otherwise(F.transform(F.array(packed), solve)[0])


def splitting_tree(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """``quotas(source_no, blocks)`` -> ``(source_no, shard, first_block, end_block)``: disjoint runs per shard."""
    nodes = quotas.agg(
        F.sort_array(F.collect_list(F.struct("source_no", F.col("blocks").cast("long").alias("blocks")))).alias("own")
    ).select(F.lit(0).alias("first"), F.lit(n_shards).alias("end"), F.transform("own", lambda x: x["blocks"]).alias("own"))
    depth = (n_shards - 1).bit_length()
    for _ in range(depth):
        total = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x)
        middle = F.expr("first + (end - first + 1) div 2")
        nodes = nodes.withColumn("total", total).withColumn("middle", F.when(F.col("end") - F.col("first") > 1, middle))
        # The left child gets its shards' part of the total, rounded.
        goes = F.expr("(total * (middle - first) * 2 + (end - first)) div (2 * (end - first))")
        nodes = nodes.withColumn("goes", goes)

        def draw(a, k):
            u = _uniform(F.lit(seed), F.col("first"), F.col("end"), F.size(a["x"]))
            x = F.transform(
                F.array(_hypergeometric(a["n"], k, a["d"], u)),
                lambda x: F.struct(
                    (a["n"] - k).alias("n"), (a["d"] - x).alias("d"), F.concat(a["x"], F.array(x)).alias("x")
                ),
            )
            return x[0]

        zero = F.struct(
            F.col("total").alias("n"), F.col("goes").alias("d"), F.array().cast("array<bigint>").alias("x")
        )
        left = F.aggregate("own", zero, draw, lambda a: a["x"])
        nodes = nodes.withColumn("left", F.when(F.col("middle").isNotNull(), left))
        right = F.zip_with("own", "left", lambda a, b: a - b)
        halves = F.when(
            F.col("middle").isNull(), F.array(F.struct("first", "end", "own"))
        ).otherwise(
            F.array(
                F.struct(F.col("first"), F.col("middle").alias("end"), F.col("left").alias("own")),
                F.struct(F.col("middle").alias("first"), F.col("end"), right.alias("own")),
            )
        )
        nodes = stored(nodes.select(F.inline(halves)), "mix-tree")
    leaves = nodes.select(F.col("first").alias("shard"), F.posexplode("own").alias("source_no", "blocks"))
    earlier = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("blocks").over(earlier), F.lit(0))
    return leaves.select(
        "source_no", "shard", first.alias("first_block"), (first + F.col("blocks")).alias("end_block")
    ).where("end_block > first_block")


def _identity() -> Column:
    return F.xxhash64("doc_id", "text")


def plan_mix(
    docs: DataFrame,
    n_shards: int = 8,
    weights=WEIGHTS,
    share: float = 1.5,
    max_epochs: int = 2,
    block_words: int = 4096,
    seed: int = 17,
) -> DataFrame:
    """``doc_id, text_hash, source, size, rows, half, source_size, target, copies, taken, shards`` per distinct document.

    ``rows`` counts equal rows of the input. The mix takes each of them ``copies`` times; ``shards`` names the shard of each copy.
    Where the cut falls among equal rows they make two rows of the plan: ``half`` 0 has one more copy than ``half`` 1.
    """
    key = ["doc_id", "text_hash", "source", "size"]
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _identity().alias("text_hash"))
    # Repeated rows are folded; ``mass`` is what all of them weigh.
    sized = sized.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).withColumn("mass", F.col("size") * F.col("rows"))
    sized = stored(sized, "mix-sizes")
    targets = source_targets(sized, weights, share, max_epochs)
    epochs = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    targets = targets.withColumn("epochs", F.least(epochs, F.lit(max_epochs)).cast("long")).withColumn(
        "part", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    targets = stored(targets.withColumnRenamed("source", "_source"), "mix-targets")
    # Spark broadcasts the stored source tables if their files are small, else it splits hot sources.
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    large = F.col("size") * LARGE > F.col("part")
    in_large = stored(rows.where(large).groupBy("source_no").agg(F.sum("mass").alias("large_words")), "mix-large")
    rows = rows.join(in_large, "source_no", "left").withColumn("large_words", F.coalesce("large_words", F.lit(0)))
    fits = F.col("part") >= F.col("large_words")
    ahead = F.when(large, F.when(fits, 0).otherwise(2)).otherwise(1)
    # (group, hash) as one rising number: 2 bits for the group, 61 for the hash.
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "text_hash", "doc_id"), 3)
    rows = rows.withColumn("at", F.shiftleft(ahead.cast("long"), 61) + order)
    rows = running_totals(rows, ["source_no"], "at", F.shiftrightunsigned("at", 61 - SLICE_BITS), {"upto": "mass"})
    rows = stored(rows.drop("large_words", "at", "weight"), "mix-order")
    # The last epoch: whole documents while they fit, then one more that comes nearest to what is missing. ``more`` counts the equal
    # rows it takes.
    fitting = F.floor((F.col("part") - (F.col("upto") - F.col("mass"))) / F.greatest("size", F.lit(1))).cast("long")
    fitting = F.when(F.col("size") > 0, F.least(F.col("rows"), F.greatest(F.lit(0), fitting))).otherwise(0)
    rows = rows.withColumn("more", F.when(F.col("epochs") < max_epochs, fitting).otherwise(0).cast("long"))
    used = stored(rows.groupBy("source_no").agg(F.sum(F.col("size") * F.col("more")).alias("used")), "mix-used")
    gap = F.col("part") - F.col("used")
    miss = F.struct(F.abs(F.col("size") - gap).alias("miss"), "upto")
    spare = rows.where((F.col("more") < F.col("rows")) & (F.col("size") > 0)).join(used, "source_no")
    fill = spare.where((F.col("epochs") < max_epochs) & (F.abs(F.col("size") - gap) < gap))
    fill = stored(fill.groupBy("source_no").agg(F.min(miss)["upto"].alias("fill")), "mix-fill")
    # Documents without words have the running total of the one before them.
    filling = F.coalesce((F.col("upto") == F.col("fill")) & (F.col("size") > 0), F.lit(False))
    rows = rows.join(fill, "source_no", "left").withColumn("more", F.col("more") + F.when(filling, 1).otherwise(0))
    # Equal rows are split at the cut: the first ``more`` of them have one more copy.
    first = F.struct(
        F.lit(0).alias("half"), F.col("more").alias("n"), (F.col("epochs") + 1).alias("copies"),
        (F.col("upto") - F.col("mass") + F.col("size") * F.col("more")).alias("upto"),
    )
    rest = F.struct(
        F.lit(1).alias("half"), (F.col("rows") - F.col("more")).alias("n"),
        F.when(F.col("size") == 0, 0).otherwise(F.col("epochs")).alias("copies"), F.col("upto").alias("upto"),
    )
    halves = F.explode(F.filter(F.array(first, rest), lambda x: x["n"] > 0)).alias("h")
    rows = rows.select(*key, "source_no", "source_size", "target", halves).select(
        *key, "source_no", "source_size", "target", "h.half", F.col("h.n").alias("rows"), "h.upto", "h.copies"
    )
    rows = rows.withColumn("mass", F.col("size") * F.col("rows"))
    rows = stored(rows, "mix-draws")
    most = rows.groupBy("source_no").agg(
        F.max("copies").alias("most"), F.sum(F.col("mass") * F.col("copies")).alias("source_taken")
    )
    most = stored(most, "mix-quotas")
    runs = splitting_tree(
        most.select("source_no", F.expr(f"(source_taken + {block_words} - 1) div {block_words}").alias("blocks")), n_shards, seed
    )
    # Epochs follow each other. The partial one comes first and takes a prefix of the order, so all blocks but the
    # last of a source are full.
    drawn = rows.where("copies > 0").join(most, "source_no")
    drawn = drawn.withColumn("epoch", F.explode(F.sequence(F.col("most") - F.col("copies"), F.col("most") - 1)))
    partial = F.expr("source_taken - (most - 1) * source_size")
    before = F.when(F.col("epoch") == 0, 0).otherwise(partial + (F.col("epoch") - 1) * F.col("source_size"))
    # The filling document stands at the end of the partial epoch.
    within = F.when(F.col("epoch") == 0, F.greatest(F.lit(0), F.least(F.col("upto"), partial) - F.col("mass")))
    drawn = drawn.withColumn("start", before + F.coalesce(within, F.col("upto") - F.col("mass")))
    drawn = drawn.withColumn("block", F.expr(f"start div {block_words}"))
    dealt = drawn.join(runs, "source_no").where("block >= first_block and block < end_block")
    shards = dealt.groupBy("doc_id", "text_hash", "source_no", "half").agg(
        F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("_shards")
    )
    same = (
        F.col("d.doc_id").eqNullSafe(F.col("s.doc_id"))
        & (F.col("d.text_hash") == F.col("s.text_hash"))
        & (F.col("d.source_no") == F.col("s.source_no"))
        & (F.col("d.half") == F.col("s.half"))
    )
    return (
        rows.alias("d")
        .join(shards.alias("s"), same, "left")
        .select(
            "d.doc_id", "d.text_hash", "d.source", "d.size", "d.rows", "d.half", "d.source_size", "d.target", "d.copies",
            (F.col("d.size") * F.col("d.copies")).alias("taken"),
            F.coalesce(F.transform("_shards", lambda x: x["shard"]), F.array().cast("array<int>")).alias("shards"),
        )
    )


def per_document(plan: DataFrame) -> DataFrame:
    """Repeated rows of a plan written out again."""
    return plan.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("_row", "rows", "half")


def mix(docs: DataFrame, seed: int = 17, **settings) -> DataFrame:
    """The mix itself: every drawn copy as a row with all columns of ``docs``, ``mix_shard`` and ``mix_order``.

    Sort by ``mix_order`` inside each shard to shuffle it. Of rows equal in (doc_id, text, source) the plan may give some one more copy than
    the others; it does not matter which.
    """
    plan = stored(plan_mix(docs, seed=seed, **settings), "mix-plan")
    fold = ["doc_id", "text_hash", "source"]
    named = ["_id", "_hash", "_source"]
    # At the cut of a source, and at its filling document: few folds, and mostly none.
    split = plan.groupBy(*fold).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("half") == 0, F.col("rows"))).alias("_first"),
        F.max(F.when(F.col("half") == 0, F.col("shards"))).alias("_more"),
        F.max(F.when(F.col("half") == 1, F.col("shards"))).alias("_less"),
    )
    split = split.withColumn("_fold", F.monotonically_increasing_id())  # ids and sources may be null
    split = stored(split.where("n > 1").drop("n").withColumnsRenamed(dict(zip(fold, named, strict=True))), "mix-split")
    kept = [c for c in docs.columns if c not in ("mix_shard", "mix_order")]

    def same(other: DataFrame) -> Column:
        return (
            docs["doc_id"].eqNullSafe(other["_id"])
            & (F.xxhash64(docs["doc_id"], docs["text"]) == other["_hash"])
            & docs["source"].eqNullSafe(other["_source"])
        )

    whole = plan.where("copies > 0").select(*fold, "half", "shards").toDF(*named, "half", "_shards")
    cut = not split.isEmpty()
    if cut:
        gone = (
            whole["_id"].eqNullSafe(split["_id"]) & (whole["_hash"] == split["_hash"]) & whole["_source"].eqNullSafe(split["_source"])
        )
        whole = whole.join(split, gone, "left_anti")
    taken = docs.join(whole, same(whole)).select(*[docs[c] for c in kept], F.posexplode(whole["_shards"]).alias("__copy", "mix_shard"))
    if cut:
        # Equal rows are numbered per task that read them, and tasks by their counts, so no fold is sorted in one task.
        rows = docs.join(split, same(split)).select(*[docs[c] for c in kept], *[split[c] for c in split.columns])
        rows = stored(rows.withColumn("__task", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "mix-equal")
        rows = positions(rows, ["_fold"], [F.col("__at")], F.col("__task"), "__n")
        shards = F.when(F.col("__n") <= F.col("_first"), F.col("_more")).otherwise(F.col("_less"))
        taken = taken.unionByName(rows.select(*kept, F.posexplode(shards).alias("__copy", "mix_shard")))
    order = F.xxhash64(F.lit(seed + 1), "doc_id", "text", "__copy")
    return taken.select(*kept, "mix_shard", order.alias("mix_order"))
