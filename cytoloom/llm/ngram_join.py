"""Documents whose word n-gram sets are similar, by parity sketches.

*Sets.* Words are runs without ASCII white space, A-Z lower-cased. A set holds the 64-bit hashes of the distinct n-word shingles (a shorter
text is one shingle; no words, no set). Two sets link when ``intersection * 100 >= percent * union``.

*Sketch.* Every shingle flips one bit of a sketch. A shingle that both sets have flips the same bit in both, so the Hamming distance of two
sketches is at most the size of the symmetric difference. With p = percent, sets of sizes a <= b that link have b <= 100a/p
and differ in at most d(a, b) = (100 - p)(a + b)/(100 + p) shingles.

*Size bands.* A band covers sizes from lo to 1.2 lo. A set sketches itself for its own band and, if its largest partner is in a following
one, for those bands too; the band of the larger set is where a pair meets.

*Pigeonhole.* A band's sketch is cut into chunks of 64 bits, more chunks than differences. For the chunks a shingle is a pattern of 64 bits in one chunk (its hash), which
it flips; so two chunks agree, by any practical measure, only if the same shingles fall there, and each differing shingle spoils one chunk at most. Chunks are ranked by how many shingles
they hold, most first, then by place: a chunk with few shingles says little, and is all inside a passage that many texts share more often. A set emits its
first d + 2 chunks (d: its largest possible difference in the band). Then linked sets share at least two emitted chunks: chunks that agree hold equally many
shingles, so the agreed ones (two at least) have the same order in both; before the second of them either set has the first and some of the at most d chunks that differ, so both
emit it. Where d is 0 only equal sets link, and a set emits two keys of its whole.

*Filter.* Each text also has one sketch of 1 to 2 bits per shingle, a power of two in all. Of two such sketches the longer is folded (xor of its halves) to
the length of the other; a candidate pair whose Hamming distance exceeds d(a, b), or whose sizes are too different, cannot link and is dropped
before any text is read again.

*Candidates.* The rows (chunk key, text) of a key form a bucket. Every member is first paired with the smallest member only, which is linear; pairs that share
two buckets, or one of more than 64 members, are verified, and linked texts are joined to components. Buckets inside one component are done with. In those of at most
64 members that span several, tasks compare a short sketch of 256 bits (nothing is folded, as every set has one) of members of different components; pairs that it allows
in two such buckets are verified. A linked pair that does not share two small buckets shares a large one. Large buckets that still span several components
are cut into blocks. Tasks compare the sketches of two blocks in memory and give only pairs from different components that the sketches allow: first the
three closest per bucket and pair of components, and, after joining components again, all that are left. So a large group of near copies costs about one pair per member, no
link between components is missed, and no task holds more than two blocks.

Equal texts are one vertex (a 64-bit text hash); in each task a text that was seen before emits no chunks again.

Defined cases: null, empty and wordless texts have 0 shingles and are linked with nothing; null doc_ids take part, and are ignored as smallest
id while another id is there; repeated rows share their component; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoloom.llm.tables import stored
from cytoloom.plans.components import connected_components

#: Emitted chunks that two linked sets share at least.
SHARED = 2
#: Members of a bucket whose pairs must share two such buckets; larger buckets are cut into blocks.
SMALL = 64
#: Length of the short sketch that every set has, in 64-bit words.
SHORT = 4
#: Members of a block, about.
BLOCK = 1024
#: Ids of texts to verify that are broadcast at most: about 64 bytes each in a task's hash table, 128 MB in all.
SENT_IDS = 2_000_000
#: Longest sketch, in 64-bit words, that is compared in memory; longer ones are folded.
FOLDED = 32

_MULTIPLIERS = np.random.default_rng(20240611).integers(1, 2**63, size=16, dtype=np.uint64) | np.uint64(1)
_SHIFT = np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MULTIPLIERS[14]
    x = (x ^ (x >> np.uint64(29))) * _MULTIPLIERS[15]
    return x ^ (x >> _SHIFT)


class WordHashes(dict):
    """Word -> 64-bit hash, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, n: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text."""
    words = text.lower().split() if text else []
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    if len(h) < n:
        return _mixed((h * _MULTIPLIERS[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    out = h[: len(h) - n + 1] * _MULTIPLIERS[0]
    for j in range(1, n):
        out = out + h[j : len(h) - n + 1 + j] * _MULTIPLIERS[j]
    return np.unique(_mixed(out))


@lru_cache(maxsize=1 << 16)
def _band_of(size: int) -> tuple[int, int]:
    """Number and largest size of the band of a size."""
    lo, k = 1, 0
    while True:
        following = max(lo + 1, -(-6 * lo // 5))
        if size < following:
            return k, following - 1
        lo, k = following, k + 1


def chunk_keys(items: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set: any two linked sets share ``SHARED`` of them."""
    a = len(items)
    if not a:
        return items
    largest = 100 * a // percent
    (first, _), (last, _) = _band_of(a), _band_of(largest)
    out, hi = [], 0
    for k in range(first, last + 1):
        hi = _band_of(max(a, hi + 1))[1]
        most = (100 - percent) * (a + min(hi, largest)) // (100 + percent)
        if most:
            chunks = int(1.25 * ((100 - percent) * 2 * hi // (100 + percent) + SHARED)) + 1
            # The chunk comes from the high bits, so sorted items are grouped by chunk already.
            chunk = ((items >> _SHIFT) * np.uint64(chunks)) >> _SHIFT
            start = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
            at = chunk[start].astype(np.int64)
            held, bits = np.zeros(chunks, np.int64), np.zeros(chunks, np.uint64)
            held[at], bits[at] = np.diff(np.r_[start, a]), np.bitwise_xor.reduceat(items, start)
            index = np.argsort(-held, kind="stable")[: most + SHARED]
            bits, index = bits[index], index.astype(np.uint64)
        else:
            bits, index = np.bitwise_xor.reduce(items, keepdims=True), np.arange(SHARED, dtype=np.uint64)
        out.append(_mixed(bits * _MULTIPLIERS[12] + (np.uint64(k << 40) + index) * _MULTIPLIERS[13]))
    return np.concatenate(out)


def parity_sketch(items: np.ndarray, bits: int = 0) -> np.ndarray:
    """One bit per hash value modulo ``bits``, else modulo a power of two from len(items) on: set where an odd number of items fall."""
    bits = bits or max(64, 1 << (max(1, len(items)) - 1).bit_length())
    odd = np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def hamming(a: np.ndarray, b: np.ndarray) -> int:
    """Distance of two sketches after folding the longer one."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _sketcher(n: int, percent: int):
    def run(batches):
        known, seen = WordHashes(), {}
        for batch in batches:
            sizes, lengths, keys, bits, short = [], [0], [], [], []
            for text_id, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                size = seen.get(text_id)
                if size is None:
                    items = shingle_set(text, n, known)
                    if len(seen) > 200_000:
                        seen.clear()
                    seen[text_id] = size = len(items)
                    keys.append(chunk_keys(items, percent))
                    bits.append(parity_sketch(items).tobytes() if size else None)
                    short.append(parity_sketch(items, 64 * SHORT).tobytes() if size else None)
                    lengths.append(lengths[-1] + len(keys[-1]))
                else:
                    bits.append(None)
                    short.append(None)
                    lengths.append(lengths[-1])
                sizes.append(size)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat.view(np.int64))),
                    pa.array(bits, pa.binary()),
                    pa.array(short, pa.binary()),
                ],
                ["doc_id", "text_id", "n_shingles", "keys", "sketch", "short"],
            )

    return run


def _verifier(n: int, percent: int):
    def run(batches):
        known, last, left = WordHashes(), None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = np.zeros(len(a), bool)
            for i, (text_a, text_b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if a[i] != last:
                    last, left = a[i], shingle_set(text_a, n, known)
                right = shingle_set(text_b, n, known)
                shared = len(left) + len(right) - len(np.union1d(left, right))
                keep[i] = 100 * shared >= percent * (len(left) + len(right) - shared)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _near(percent: int):
    """Drops pairs that their sizes or sketches rule out."""

    def run(batches):
        for batch in batches:
            n_a, n_b, s_a, s_b = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(n_a, n_b, strict=True)):
                if percent * max(a, b) <= 100 * min(a, b):
                    most = (100 - percent) * (a + b) // (100 + percent)
                    keep[i] = hamming(np.frombuffer(s_a[i], np.uint64), np.frombuffer(s_b[i], np.uint64)) <= most
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _units(batches):
    """Rows of each unit (columns 0 to 2, sorted), one record batch per unit; only the unit at the end of a batch is held."""
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        whole = [x for x in (held, batch) if x is not None]
        if not whole:
            return
        table = pa.Table.from_batches(whole).combine_chunks().to_batches()[0]
        key = np.stack([table.column(i).to_numpy() for i in range(3)])
        edge = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        bounds = [0, *edge.tolist(), table.num_rows]
        if batch is not None:
            held = table.slice(bounds[-2])
            bounds.pop()
        for lo, hi in itertools.pairwise(bounds):
            yield table.slice(lo, hi - lo)


def _apart(percent: int):
    """Rows (key, text_id, comp, n, short) sorted by key -> pairs of a key's texts in different components that sizes and short sketches allow."""

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rows = [batch.column(i).to_numpy() for i in range(4)]
                rows.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(-1, SHORT))
                held = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if held is None or not len(held[0]):
                continue
            key, text, comp, n, bits = held
            bounds = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
            # The key at the end of a batch may go on in the next one.
            done = len(key) if batch is None else bounds[-2]
            held = [x[done:] for x in held]
            end, one = np.repeat(bounds[1:], np.diff(bounds)), np.arange(done)
            # Each row with the row 1, 2, ... places after it, while that is in its bucket.
            for away in itertools.count(1):
                one = one[one + away < end[one]]
                if not len(one):
                    break
                a = one[comp[one] != comp[one + away]]
                b = a + away
                both = n[a] + n[b]
                fits = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= (100 - percent) * both // (100 + percent)
                fits &= percent * np.maximum(n[a], n[b]) <= 100 * np.minimum(n[a], n[b])
                a, b = text[a[fits]], text[b[fits]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _folded(sketch: bytes, words: int) -> np.ndarray:
    x = np.frombuffer(sketch, np.uint64)
    return np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) if len(x) > words else x


def _closest(found: np.ndarray, n: int | None) -> np.ndarray:
    """Of columns (a, b, component, component, distance) the ``n`` closest per pair of components; all, if n is None."""
    if n is None or not found.shape[1]:
        return found
    found = found[:, np.lexsort((found[1], found[0], found[4], found[3], found[2]))]
    head = np.flatnonzero(np.r_[True, (found[2:4, 1:] != found[2:4, :-1]).any(axis=0)])
    rank = np.arange(found.shape[1]) - np.repeat(head, np.diff(np.r_[head, found.shape[1]]))
    return found[:, rank < n]


def _crossing(percent: int, closest: int | None):
    """Units of (key, i, j, text_id, comp, n, sketch) -> pairs of different components that sizes and sketches allow."""

    def run(batches):
        for unit in _units(batches):
            text, comp, n = (unit.column(i).to_numpy() for i in (3, 4, 5))
            sketches = unit.column(6).to_pylist()
            words = min(FOLDED, *(len(x) // 8 for x in sketches))
            bits = np.stack([_folded(x, words) for x in sketches])
            out = []
            for at in range(0, len(text), 64):
                part = slice(at, at + 64)
                away = np.bitwise_count(bits[part, None, :] ^ bits[None, :, :]).sum(axis=2, dtype=np.int64)
                both = n[part, None] + n[None, :]
                fits = (comp[part, None] != comp[None, :]) & (away <= (100 - percent) * both // (100 + percent))
                fits &= percent * np.maximum(n[part, None], n[None, :]) <= 100 * np.minimum(n[part, None], n[None, :])
                row, col = np.nonzero(fits)
                one, two = comp[row + at], comp[col]
                out.append(_closest(np.stack([text[row + at], text[col], np.minimum(one, two), np.maximum(one, two), away[row, col]]), closest))
            found = _closest(np.concatenate(out, axis=1), closest)[:2]
            pairs = np.unique(np.sort(found, axis=0), axis=1)
            if pairs.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), F.col("text").cast("binary").alias("text"))


def _linked(docs: DataFrame, vertices: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` (text ids) that link; ``vertices(text_id, n_shingles, sketch)``."""
    vertices = vertices.select("text_id", "n_shingles", "sketch")
    both = pairs.join(vertices.toDF("b", "n_b", "sketch_b"), "b").join(vertices.toDF("a", "n_a", "sketch_a"), "a")
    both = both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    near = stored(both.mapInArrow(_near(percent), "a long, b long"), "join-near")
    wanted = stored(near.select(F.explode(F.array("a", "b")).alias("wanted")).distinct(), "join-wanted")
    # Few ids go to the texts; only where they are too many, all texts are shuffled to the ids.
    few = F.broadcast(wanted) if wanted.count() <= SENT_IDS else wanted.hint("merge")
    texts = _identified(docs).join(few, F.col("text_id") == F.col("wanted"), "left_semi")
    texts = stored(texts.groupBy("text_id").agg(F.first("text").alias("text")), "join-texts")
    both = near.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verifier(n, percent), "a long, b long")


def _components(links: list[DataFrame]) -> DataFrame:
    edges = reduce(DataFrame.unionByName, links).select(F.lit(0).alias("key"), F.col("a").alias("u"), F.col("b").alias("v"))
    return connected_components(edges).select(F.col("u").alias("text_id"), F.col("root").alias("comp"))


def link_documents(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, text_id, n_shingles, comp, component_id)``, one row per input row.

    ``component_id`` is the smallest doc_id that links reach. ``percent`` is the least similarity in hundredths.
    """
    sketches = stored(
        _identified(docs).mapInArrow(
            _sketcher(n, percent), "doc_id long, text_id long, n_shingles long, keys array<long>, sketch binary, short binary"
        ),
        "join-sketches",
    )
    vertices = sketches.where("sketch is not null").groupBy("text_id").agg(
        F.max("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("short").alias("short")
    )
    vertices = stored(vertices, "join-vertices")
    bucket = Window.partitionBy("key")
    members = (
        sketches.select("text_id", F.explode("keys").alias("key"))
        .repartition("key")
        .distinct()
        .withColumn("pivot", F.min("text_id").over(bucket))
        .withColumn("m", F.count(F.lit(1)).over(bucket))
        .where("m > 1")
    )
    members = stored(members, "join-buckets")
    star = members.where("text_id <> pivot").groupBy(F.col("pivot").alias("a"), F.col("text_id").alias("b"))
    star = star.agg(F.count(F.lit(1)).alias("shared"), F.max("m").alias("m")).where((F.col("shared") >= SHARED) | (F.col("m") > SMALL))
    pairs = stored(star.select("a", "b"), "join-pairs")
    links = [stored(_linked(docs, vertices, pairs, n, percent), "join-links")]
    comps = stored(_components(links), "join-components")
    def open_buckets(rows):
        """Rows of the buckets that span several components, with how many rows those have."""
        named = rows.select("key", "text_id").join(comps, "text_id", "left").withColumn("comp", F.coalesce("comp", "text_id"))
        spans = {"c0": F.min("comp").over(bucket), "c1": F.max("comp").over(bucket), "m": F.count(F.lit(1)).over(bucket)}
        return named.withColumns(spans).where("c0 < c1").select("key", "text_id", "comp", "m")

    small = open_buckets(members.where(F.col("m") <= SMALL)).join(vertices, "text_id").select("key", "text_id", "comp", "n_shingles", "short")
    apart = small.repartition("key").sortWithinPartitions("key").mapInArrow(_apart(percent), "a long, b long")
    often = apart.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= SHARED)
    more = stored(often.select("a", "b"), "join-apart")
    if not more.isEmpty():
        links.append(stored(_linked(docs, vertices, more, n, percent), "join-links"))
        comps = stored(_components(links), "join-components")
    large = members.where(F.col("m") > SMALL)
    for closest in (3, None):
        large = open_buckets(large).select("key", "text_id", "comp", F.expr(f"cast((m + {BLOCK} - 1) div {BLOCK} as int)").alias("blocks"))
        large = stored(large, "join-open")
        if large.isEmpty():
            break
        own = F.pmod(F.xxhash64("text_id"), F.col("blocks")).cast("int")
        unit = large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        unit = unit.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "text_id", "comp")
        unit = unit.join(vertices, "text_id").select("key", "i", "j", "text_id", "comp", "n_shingles", "sketch")
        crossing = unit.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_crossing(percent, closest), "a long, b long")
        more = stored(crossing.distinct(), "join-crossing")
        links.append(stored(_linked(docs, vertices, more, n, percent), "join-links"))
        comps = stored(_components(links), "join-components")
    rows = sketches.select("doc_id", "text_id", "n_shingles").join(comps, "text_id", "left")
    rows = stored(rows.withColumn("comp", F.coalesce("comp", "text_id")), "join-rows")
    least = stored(rows.where("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("least")), "join-least")
    rows = rows.join(least, "comp", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "text_id", "n_shingles", "comp", own.alias("component_id"))


def one_of_each_group(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` with only the smallest doc_id of each component; rows without any shingle all stay."""
    rows = link_documents(docs, n, percent)
    best = rows.where("n_shingles > 0").groupBy("comp").agg(F.min(F.struct("doc_id", "text_id")).alias("best"))
    kept = best.select("best.*").unionByName(rows.where("n_shingles = 0").select("doc_id", "text_id").distinct())
    kept = stored(kept.toDF("_id", "_text"), "join-kept")
    marked = docs.withColumn("__text", F.xxhash64("text")).withColumn("__id", F.col("doc_id").cast("long"))
    same = marked["__id"].eqNullSafe(kept["_id"]) & (marked["__text"] == kept["_text"])
    copy = F.row_number().over(Window.partitionBy("__id", "__text").orderBy(F.lit(0)))
    return marked.join(kept, same, "left_semi").withColumn("__copy", copy).where("__copy = 1").drop("__copy", "__text", "__id")
