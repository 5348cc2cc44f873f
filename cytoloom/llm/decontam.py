"""Words of documents that repeat benchmark passages, by winnowing.

A passage is a window of ``window`` consecutive words of an item (a whole item, if it is shorter). With grams of k words, a window holds
w = window - k + 1 grams; the leftmost smallest gram hash of each window is its fingerprint. The choice depends on the window's words
alone, so a window that occurs in a document and in an item has the same fingerprint in both: every shared window
is found, while only about 2 / (w + 1) of all grams are kept. Fingerprints carry the few words around them. After
the join on the hash these words are compared, the match is extended to both sides, and it counts when it spans a window.

The benchmark's fingerprints are broadcast if their measured size is within ``BROADCAST_BYTES``; beyond it, both
sides are shuffled on the hash and Spark splits skewed hashes. Documents are keyed by (doc_id, hash of the text).

Defined cases: null and empty texts have no words and are clean; items without words or without id take no part; equal item
ids count once; repeated documents get equal results; empty tables give empty results or clean documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoloom.llm.tables import let, lower_ascii, stored

# Classes are given by what they hold, and runs are possessive: the regular expression engine tests complements range by range, ten times slower.
SEPARATORS = r"[^0-9a-z\x{80}-\x{10FFFF}]++"
#: The same words before lower-casing.
RAW_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"
BROADCAST_BYTES = 16 << 20
#: More than the words of any text (a string has at most 2^31 bytes, a word and its separator two of them).
POSITIONS = 1 << 31


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _gram(window: int) -> int:
    return (window + 1) // 2


def _fingerprints(text: Column, window: int) -> Column:
    """Array of (at, hash, off, near): word position of the gram, its hash, and the words around it from at - off on."""
    k = _gram(window)
    w = window - k + 1

    def pick(ws: Column, grams: Column) -> Column:
        best = F.transform(F.sequence(F.lit(1), F.size(ws) - window + 1), lambda p: F.array_min(F.slice(grams, p, w)))
        at = F.transform(F.array_distinct(best), lambda g: g.bitwiseAND(F.lit(POSITIONS - 1)).cast("int"))

        def around(at: Column) -> Column:
            off = F.least(at, F.lit(window - k))
            return F.struct(
                at.alias("at"),
                F.xxhash64(F.slice(ws, at + 1, k)).alias("hash"),
                off.alias("off"),
                F.slice(ws, at - off + 1, off + window).alias("near"),
            )

        return F.transform(at, around)

    def body(ws: Column) -> Column:
        # Hash above, position below: one minimum finds the smallest hash and, among equals, the leftmost gram.
        grams = F.transform(
            F.sequence(F.lit(1), F.size(ws) - k + 1),
            lambda i: F.xxhash64(F.slice(ws, i, k)).bitwiseAND(F.lit(-POSITIONS)) + (i - 1),
        )
        return F.when(F.size(ws) >= window, let(grams, lambda g: pick(ws, g)))

    return let(words(text), body)


def _same_run(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of words."""
    return F.coalesce(
        F.nullif(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)), F.lit(0)) - 1,
        F.least(F.size(a), F.size(b)),
    ).cast("int")


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``(doc_id, text_hash, item_id, first_word, end_word)``: runs of document words equal to runs of an item's words.

    ``item_id`` is a string. Runs may overlap and each spans at least one window of the item.
    """
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    items = items.withColumn("n", F.least(F.size(words(F.col("text"))), F.lit(window))).where("n > 0")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # at most ``window`` values
    found = []
    for length in lengths:
        k = _gram(length)
        own = items.where(F.col("n") == length).select(
            "item_id", F.explode_outer(_fingerprints(F.col("text"), length)).alias("f")
        )
        own = own.select("item_id", F.col("f.hash").alias("hash"), F.col("f.off").alias("i_off"), F.col("f.near").alias("i_near"))
        own = stored(own.where("hash is not null").distinct(), "benchmark-prints")
        size = own.agg(F.sum(F.octet_length(F.concat_ws(" ", "i_near")) + F.octet_length("item_id") + 64)).first()[0] or 0
        own = F.broadcast(own) if size <= BROADCAST_BYTES else own.hint("merge")
        prints = docs.select(
            "doc_id", F.xxhash64("text").alias("text_hash"), F.explode_outer(_fingerprints(F.col("text"), length)).alias("f")
        ).select("doc_id", "text_hash", "f.*")
        # The words before the gram backwards, and those from the gram on.
        left = _same_run(
            F.reverse(F.slice("near", F.lit(1), F.col("off"))), F.reverse(F.slice("i_near", F.lit(1), F.col("i_off")))
        )
        right = _same_run(
            F.slice("near", F.col("off") + 1, F.lit(length)), F.slice("i_near", F.col("i_off") + 1, F.lit(length))
        )
        found.append(
            prints.where("hash is not null")
            .join(own, "hash")
            .withColumn("l", left)
            .withColumn("r", right)
            .where((F.col("r") >= k) & (F.col("l") + F.col("r") >= length))
            .select(
                "doc_id", "text_hash", "item_id", (F.col("at") - F.col("l")).alias("first_word"),
                (F.col("at") + F.col("r")).alias("end_word"),
            )
        )
    if not found:
        empty = docs.select("doc_id", F.xxhash64("text").alias("text_hash")).where(F.lit(False))
        return empty.selectExpr("doc_id", "text_hash", "'' as item_id", "0 as first_word", "0 as end_word")
    return reduce(DataFrame.unionByName, found)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``(doc_id, text_hash, n_words, n_hit, item_ids)`` for every document row; ``item_ids`` sorted as strings."""
    spans = stored(contaminated_spans(docs, benchmark, window).distinct(), "contaminated-spans")
    runs = spans.select("doc_id", "text_hash", "first_word", "end_word").distinct()
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def cover(a: Column, x: Column) -> Column:
        new = F.greatest(F.lit(0), x["end_word"] - F.greatest(x["first_word"], a["end"]))
        return F.struct((a["n"] + new).alias("n"), F.greatest(a["end"], x["end_word"]).alias("end"))

    ordered = F.sort_array(F.collect_list(F.struct("first_word", "end_word")))
    covered = runs.groupBy("doc_id", "text_hash").agg(F.aggregate(ordered, start, cover, lambda a: a["n"]).alias("n_hit"))
    names = spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    hits = covered.toDF("_id", "_hash", "n_hit").join(
        names, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))
    ).select("_id", "_hash", "n_hit", "item_ids")
    base = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.regexp_count("text", F.lit(RAW_WORD)), F.lit(0)).cast("long").alias("n_words"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return base.join(stored(hits, "contaminated-docs"), same, "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows that repeat any window of the benchmark."""
    keys = contaminated_spans(docs, benchmark, window).select("doc_id", "text_hash").distinct()
    keys = stored(keys.toDF("_id", "_hash"), "contaminated-keys")
    same = docs["doc_id"].eqNullSafe(keys["_id"]) & (F.xxhash64(docs["text"]) == keys["_hash"])
    return docs.join(keys, same, "left_anti")
