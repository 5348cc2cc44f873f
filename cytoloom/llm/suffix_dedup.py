"""Byte passages that also start in an earlier document, by suffix buckets that are refined on later offsets.

A byte of a document is removed when a string of ``length`` bytes that covers it also starts in a document with a smaller id. The suffixes
are put in order only as far as that needs:

1. *Initial q-gram buckets.* Every suffix belongs to the bucket of its first q bytes. Only suffixes are kept that hold the smallest q-gram hash of
   some window of ``length`` bytes (ties all count): each window keeps one at least, and equal windows keep them at equal
   places. So every shared string has a suffix pair in one bucket, while about one suffix in 16 is shuffled.
2. *Buckets of one document are done.* Only buckets that span two documents are refined.
3. *Refinement by bucket identifiers of later offsets.* Bytes around a kept suffix are named by doubling: the identifier of 2n bytes at a place is made
   of those of n bytes at the place and n later, each level reusing the one before, until ``length`` bytes are told apart. Identifiers are 64-bit
   hashes of content, so they agree between tasks without a global renumbering.
4. *Order.* The refined buckets are sorted by identifier with documents rising; a string counts in every document but the first.
   A task reads its buckets in order and holds the identifiers of one q-gram bucket at a time (16 bytes each).

Whole copies of an earlier document are settled first, by one small aggregate over (text hash, size), and give no suffixes; equal rows of one
document are folded to one. A document of several texts (a repeated id, or rows without an id) is told apart by the 64-bit hash of its texts.

Defined cases: null and empty texts have no bytes; texts shorter than ``length`` lose nothing; rows that repeat a doc_id are one document, so none of them
removes bytes of another; a null doc_id counts as larger than all; kept bytes need not be whole characters; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoloom.llm.tables import stored

#: Removed spans are broadcast to the texts up to this measured size; beyond it both sides are shuffled.
BROADCAST_BYTES = 24 << 20
#: A small row as a broadcast holds it.
ROW_BYTES = 96
NO_ID = 2**63 - 1

_RANDOM = np.random.default_rng(50).integers(1, 2**63, size=300, dtype=np.uint64) | np.uint64(1)
_BYTE = _RANDOM[:256]
_LEVEL = _RANDOM[256:]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _LEVEL[40]
    return x ^ (x >> np.uint64(31))


def identifiers(data: np.ndarray, length: int) -> np.ndarray:
    """Bucket identifier of the ``length`` bytes from each place on."""
    name, n, level = _BYTE[data], 1, 0
    while n < length:
        step = min(n, length - n)
        m = len(name) - step
        if m <= 0:
            return np.zeros(0, np.uint64)
        name = name[:m] * _LEVEL[level] + name[step:]
        name ^= name >> np.uint64(29)
        n, level = n + step, level + 1
    return _mixed(name)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        x = pick(x[:-n], x[n:])
        n *= 2
    rest = width - n
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def kept_suffixes(data: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the kept suffixes, their q-gram hashes, and how far before them their first and last window start."""
    w = length - q + 1
    x = identifiers(data, q)
    low = _sliding(x, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), w, np.maximum) == x)
    back = np.arange(w)
    start = at[:, None] - back
    inside = (start >= 0) & (start < len(low))
    mine = inside & (low[np.clip(start, 0, len(low) - 1)] == x[at][:, None])
    near = mine.argmax(axis=1)
    far = w - 1 - mine[:, ::-1].argmax(axis=1)
    return at, x[at], far, near


def _suffixes(length: int, q: int):
    """(doc, tag, text) -> (gram, doc, tag, at); ``at`` packs the place and the range of its windows."""

    def run(batches):
        for batch in batches:
            grams, docs, tags, ats = [], [], [], []

            def flush():
                counts = [len(g) for g in grams]
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(grams)),
                        pa.array(np.repeat(np.array(docs, np.int64), counts)),
                        pa.array(np.repeat(np.array(tags, np.int64), counts)),
                        pa.array(np.concatenate(ats)),
                    ],
                    ["gram", "doc", "tag", "at"],
                )

            held = 0
            for doc, tag, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is None or len(text) < length:
                    continue
                at, gram, far, near = kept_suffixes(np.frombuffer(text, np.uint8), length, q)
                grams.append((gram >> np.uint64(16)).astype(np.int64))
                docs.append(doc)
                tags.append(tag)
                ats.append((at << 12) | (far << 6) | near)
                held += len(at)
                if held > 400_000:
                    yield flush()
                    grams, docs, tags, ats, held = [], [], [], [], 0
            if grams:
                yield flush()

    return run


def _contexts(length: int):
    """(doc, text_hash, text, found[(gram, at)]) -> (gram, doc, text_hash, start, near): bytes of all windows of a suffix."""

    def run(batches):
        for batch in batches:
            found = batch.column(3)
            sizes = np.diff(found.offsets.to_numpy())
            gram, at = (found.flatten().field(i).to_numpy() for i in (0, 1))
            place, far, near = at >> 12, (at >> 6) & 63, at & 63
            first, end = place - far, place - near + length
            row = 0
            docs, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for r, text in enumerate(batch.column(2).to_pylist()):
                lo, row = row, row + sizes[r]
                for s in range(lo, row, 100_000):
                    e = min(row, s + 100_000)
                    cut = [text[i:j] for i, j in zip(first[s:e].tolist(), end[s:e].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(gram[s:e]),
                            pa.array(np.full(e - s, docs[r])),
                            pa.array(np.full(e - s, hashes[r])),
                            pa.array(first[s:e]),
                            pa.array(cut, pa.binary()),
                        ],
                        ["gram", "doc", "text_hash", "start", "near"],
                    )

    return run


def gathered(batches, rows: int = 8192):
    """Joins small record batches to larger ones."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _repeats(length: int):
    """Sorted (gram, doc, text_hash, start, near) -> (doc, text_hash, from, to): bytes that an earlier document has too."""

    def run(batches):
        open_gram, known, owner = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            gram, doc, start = (batch.column(i).to_numpy() for i in (0, 1, 3))
            near = batch.column(4)
            offsets = np.frombuffer(near.buffers()[1], np.int32)[near.offset : near.offset + len(near) + 1].astype(np.int64)
            data = np.frombuffer(near.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            count = np.diff(offsets) - length + 1
            row = np.repeat(np.arange(len(gram)), count)
            step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            name = identifiers(data, length)[offsets[row] + step]
            own = doc[row]
            # The open bucket's strings come first: their documents are smaller or equal.
            if open_gram is not None and gram[0] != open_gram:
                known, owner = known[:0], owner[:0]
            names, owners = np.concatenate([known, name]), np.concatenate([owner, own])
            order = np.argsort(names, kind="stable")
            names = names[order]
            head = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
            least = np.minimum.reduceat(owners[order], head)
            first = np.empty(len(names), np.int64)
            first[order] = np.repeat(least, np.diff(np.r_[head, len(names)]))
            hit = np.flatnonzero(first[len(known) :] < own)
            open_gram = gram[-1]
            tail = np.flatnonzero(gram[row] == open_gram)
            ongoing = known[:0] if len(gram) and gram[0] != open_gram else known
            names, owners = np.concatenate([ongoing, name[tail]]), np.concatenate([owner[: len(ongoing)], own[tail]])
            known, where = np.unique(names, return_index=True)  # the first of equals has the smallest document
            owner = owners[where]
            if len(hit):
                at = row[hit]
                edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                last = np.r_[edge[1:], len(at)] - 1
                at = at[edge]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).take(pa.array(at)),
                        batch.column(2).take(pa.array(at)),
                        pa.array(start[at] + step[hit[edge]]),
                        pa.array(start[at] + step[hit[last]] + length),
                    ],
                    ["doc", "text_hash", "first", "end"],
                )

    return lambda batches: run(gathered(batches))


def _bounded(df: DataFrame, size: int) -> DataFrame:
    """Broadcast if the measured size allows it, else both sides are shuffled."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df.hint("merge")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    )


def repeated_spans(docs: DataFrame, length: int = 50, q: int = 20) -> DataFrame:
    """``(doc, text_hash, spans)`` for documents that lose bytes; ``spans`` are disjoint, rising (first, end)."""
    keyed = _keyed(docs)
    # Equal rows of one document count once; documents with several texts are told apart by the whole hash of the text.
    held = stored(keyed.groupBy("doc", "text_hash", F.octet_length("text").cast("long").alias("end")).agg(F.count(F.lit(1)).alias("rows")), "suffix-texts")
    again = held.where("rows > 1").select("doc", "text_hash")
    n_again = again.count()
    if n_again:
        again = _bounded(again, ROW_BYTES * n_again)
        repeated = keyed.join(again, ["doc", "text_hash"], "left_semi").dropDuplicates(["doc", "text_hash"])
        keyed = keyed.join(again, ["doc", "text_hash"], "left_anti").unionByName(repeated)
    many = held.groupBy("doc").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b").select("doc", F.lit(True).alias("many"))
    # Whole copies of an earlier document.
    whole = held.where(F.col("end") >= length).drop("rows")
    least = whole.groupBy("text_hash", "end").agg(F.min("doc").alias("least")).toDF("_hash", "_end", "least")
    copies = whole.join(least, (F.col("text_hash") == F.col("_hash")) & (F.col("end") == F.col("_end")) & (F.col("doc") > F.col("least")))
    copies = stored(copies.select("doc", "text_hash", F.lit(0).cast("long").alias("first"), "end"), "suffix-copies")
    known = _bounded(copies.select("doc", "text_hash"), ROW_BYTES * copies.count())
    keyed = keyed.join(known, ["doc", "text_hash"], "left_anti")
    n_many = many.count()
    tag = F.when(F.col("many"), F.col("text_hash")).otherwise(0) if n_many else F.lit(0).cast("long")
    keyed = keyed.join(_bounded(many, ROW_BYTES * n_many), "doc", "left") if n_many else keyed
    keyed = keyed.select("doc", "text_hash", tag.alias("tag"), "text")
    suffixes = keyed.select("doc", "tag", "text").mapInArrow(_suffixes(length, q), "gram long, doc long, tag long, at long")
    bucket = Window.partitionBy("gram")
    shared = suffixes.withColumn("lo", F.min("doc").over(bucket)).withColumn("hi", F.max("doc").over(bucket)).where("lo < hi")
    found = shared.groupBy("doc", "tag").agg(F.collect_list(F.struct("gram", "at")).alias("found"))
    found = stored(found, "suffix-found").toDF("_doc", "_tag", "found")
    texts = keyed.join(found, (F.col("doc") == F.col("_doc")) & (F.col("tag") == F.col("_tag"))).select("doc", "text_hash", "text", "found")
    near = texts.mapInArrow(_contexts(length), "gram long, doc long, text_hash long, start long, near binary")
    spans = near.repartition("gram").sortWithinPartitions("gram", "doc").mapInArrow(
        _repeats(length), "doc long, text_hash long, first long, end long"
    )
    every = F.sort_array(F.collect_list(F.struct("first", "end")))

    def join(done, x):
        last = F.element_at(done, -1)
        grown = F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (x["first"] <= last["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(
            F.concat(done, F.array(x))
        )

    none = F.array().cast("array<struct<first:bigint,end:bigint>>")
    rows = spans.unionByName(copies).groupBy("doc", "text_hash").agg(every.alias("spans"))
    return rows.withColumn("spans", F.aggregate("spans", none, join))


def without_repeats(docs: DataFrame, length: int = 50, q: int = 20) -> DataFrame:
    """All columns of ``docs``, and ``removed`` (disjoint byte spans first, end) and ``kept`` (the other bytes)."""
    spans = stored(repeated_spans(docs, length, q), "suffix-spans").toDF("_doc", "_hash", "_spans")
    size = spans.agg(F.sum(16 * F.size("_spans") + ROW_BYTES)).first()[0] or 0
    spans = _bounded(spans, size)
    columns = [c for c in docs.columns if c not in ("removed", "kept")]
    none = F.array().cast("array<struct<first:bigint,end:bigint>>")
    id_ = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))
    marked = docs.join(spans, (id_ == spans["_doc"]) & (F.xxhash64(docs["text"]) == spans["_hash"]), "left")
    marked = marked.select(*[docs[c] for c in columns], spans["_spans"].alias("__spans"))
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))

    def rest(held):
        def add(a, x):
            piece = F.substring(held["text"], (a["at"] + 1).cast("int"), (x["first"] - a["at"]).cast("int"))
            return F.struct(x["end"].alias("at"), F.concat(a["kept"], piece).alias("kept"))

        start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("kept"))
        end = F.struct(F.octet_length(held["text"]).cast("long").alias("first"), F.lit(0).cast("long").alias("end"))
        return F.aggregate(F.array_append(held["spans"], end), start, add, lambda a: a["kept"])

    pair = F.struct(data.alias("text"), F.col("__spans").alias("spans"))
    kept = F.when(F.col("__spans").isNull(), data).otherwise(F.transform(F.array(pair), rest)[0])
    return marked.select(*columns, F.coalesce("__spans", none).alias("removed"), kept.alias("kept"))
