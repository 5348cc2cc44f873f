"""Word bigram model with Katz backoff: Good-Turing discounts, exactly normalised backoff weights.

Tokens of a text are its words (runs without ASCII white space, A-Z lower-cased) and one end token; the context of the first is a start
mark. With r = c(u, w) in the training texts and C(u) the number of tokens that follow u:

* seen pair:      P(w | u) = d_r r / C(u), with Katz's Good-Turing discounts d_r for r <= 5,
* unseen pair:    P(w | u) = a(u) P(w), with a(u) = (1 - sum of d_r r / C(u)) / (1 - sum of P(w)), both over the words seen after u,
* unseen context: P(w | u) = P(w),
* words:          P(w) = d'_c c(w) / N; what the discounts leave over is for the one class of unknown words.

So every P(. | u) sums to 1 over the known words and the unknown class. Larger counts keep ``LARGE`` of their mass rather than all, so that no context
is left without any for unseen words; where Katz's formula gives no discount in (0, 1), as on tiny tables, r / (r + 1) is used.

*How it scales.* Word counts are one table. The ``frequent`` most common words (a fixed number, so a bounded broadcast) carry a code; all others stay
hashes and are joined. Every text gives its distinct pairs (key, w, text, n): the one large shuffle. Two codes fit into one key; only pairs with a
rare word also need ``w``. Rows are dealt by context, and the ``salted`` most common contexts are dealt by pair, so no task holds all rows of a
frequent word. Up to ``COMMON`` pairs that one training text in ``PART`` shows to be common are counted exactly by all tasks, broadcast with their counts
and settled where the text is; they take no part in that shuffle. Any choice of them gives the same result. A pair's training count is a window sum. One pass then writes six small tables, partitioned by kind, which are joined and added up:

* 0: per text and task, sums over its seen pairs (logarithms, and how many pairs have count r: the discounts enter afterwards);
* 1: per context, what a(u) needs;      * 4: seen pairs with a rare word, whose P(w) a(u) also needs;
* 2: unseen pairs of a text by context; * 3: rare words of a text;      * 5: how many pairs have count 6.

The backoff weights of frequent contexts are again a bounded broadcast, so unseen pairs are added up by text before they are shuffled.

Defined cases: a null or empty text is its end token alone; a null doc_id is not held out; repeated rows get equal scores (and count as often as they
occur in training); with nothing to learn from, every token is of the unknown class, whose probability is then 1. Hashes of words and rows have 63 and 62 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoloom.llm.ngram_join import WordHashes
from cytoloom.llm.suffix_dedup import gathered
from cytoloom.llm.tables import stored
from cytoloom.session import scratch_path

#: Counts up to this are discounted.
K = 5
#: What larger counts keep.
LARGE = 0.9999
#: Codes of frequent words stay below 2**CODE_BITS; salted contexts are dealt to SALTS places.
CODE_BITS = 20
CODE = (1 << CODE_BITS) - 1
SALTS = 1 << 12
#: Keys: two codes (up to here), a salt and the code of a context before a rare word (from here on), or a rare context (negative).
BEFORE_RARE = 1 << 61
#: Rows that are settled at a time, and texts whose sums a task holds.
GATHER, HELD = 1 << 18, 1 << 19
#: Texts whose words lie in arrays at a time.
TEXTS = 2048
#: Common pairs, and of how many training texts one is looked at to choose them.
COMMON, PART = 1 << 19, 16
#: Codes of the start mark and the end token; words have codes from 2 on, or negative hashes.
START, END = 0, 1


def _tokens(text: bytes | None, known: WordHashes) -> np.ndarray:
    words = text.lower().split() if text else []
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def word_counts(texts: DataFrame) -> DataFrame:
    """``texts(text binary, train boolean, ...)`` -> ``(word, c)``: counts of word hashes in training texts."""

    def run(batches):
        known = WordHashes()
        for batch in batches:
            found = [_tokens(t, known) for t, use in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if use]
            if found:
                word, c = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(c.astype(np.int64))], ["word", "c"])

    counted = texts.select("text", "train").mapInArrow(run, "word long, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def discounts(spectrum: dict[int, int]) -> np.ndarray:
    """d_r for r = 1..K and, at K + 1, for larger counts; ``spectrum[r]`` is how many things have count r."""
    n = [0] + [spectrum.get(r, 0) for r in range(1, K + 2)]
    d = np.array([1.0] + [r / (r + 1) for r in range(1, K + 1)] + [LARGE])
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        if n[r] and common < 1:
            value = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
            if 0 < value < 1:
                d[r] = value
    return d


class Words:
    """What every task knows of words: codes and counts of the frequent ones (by falling count, from 2 on) and the discounts."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, texts: int, spectrum: dict[int, int], large: int):
        """``large`` is the number of tokens of words with counts over K; the end token occurs once per text."""
        order = np.argsort(hashes.view(np.uint64))
        self.hashes, self.codes = hashes.view(np.uint64)[order], 2 + order
        self.counts = np.r_[texts, texts, counts].astype(np.int64)
        self.total = texts + large + sum(r * n for r, n in spectrum.items() if r <= K)
        self.vocabulary = 0
        self.d = discounts(spectrum)
        mass = sum(r * n * self.d[r] for r, n in spectrum.items() if r <= K) + large * LARGE + texts * self.d[min(texts, K + 1)]
        self.unknown = 1 - mass / self.total if self.total else 1.0

    def probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.minimum(c, K + 1)] * c / max(self.total, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.vocabulary + 1)))

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """Code of a frequent word; of others a negative number from the hash."""
        rare = -(hashes >> np.uint64(1)).astype(np.int64) - 1
        if not len(self.hashes):
            return rare
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.codes[at], rare)


def learn_words(counts: DataFrame, texts: int, frequent: int) -> Words:
    """``counts`` is the table of :func:`word_counts`; ``texts`` the number of training texts."""
    few = counts.groupBy(F.least("c", F.lit(K + 2)).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("tokens")).collect()
    top = counts.orderBy(F.desc("c"), "word").limit(frequent).toArrow()  # a fixed number of rows
    spectrum = {r["r"]: r["n"] for r in few if r["r"] <= K + 1}
    large = sum(r["tokens"] for r in few if r["r"] > K)
    words = Words(top["word"].to_numpy(), top["c"].to_numpy(), texts, spectrum, large)
    words.vocabulary = sum(r["n"] for r in few) + (1 if texts else 0)
    return words


def _sliced(batches):
    """Batches of at most ``TEXTS`` rows, so that a task's arrays stay small."""
    for batch in batches:
        for first in range(0, batch.num_rows, TEXTS):
            yield batch.slice(first, TEXTS)


def _coded(batch, known: WordHashes, words: Words):
    """Word codes of all texts of a batch in one array, and the number of words of each text."""
    hashes = [_tokens(t, known) for t in batch.column(0).to_pylist()]
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    distinct, back = np.unique(flat, return_inverse=True)
    return words.encode(distinct)[back], np.array([len(h) for h in hashes], np.int64)


def _contexts(code: np.ndarray, size: np.ndarray):
    """Row, context and word of every token, the end tokens included."""
    end = np.cumsum(size + 1)
    u, w = (np.full(len(code) + len(size), x, np.int64) for x in (START, END))
    inner = np.ones(len(w), bool)
    inner[end - 1] = False
    w[inner] = code
    inner[:] = True
    inner[end - size - 1] = False
    u[inner] = code
    return np.repeat(np.arange(len(size)), size + 1), u, w


def _place(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted ``keys`` each ``key`` lies, and whether it is there."""
    if not len(keys):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return at, keys[at] == key


def _pair_keys(shared):
    """(text) -> (key, n): pairs of frequent words, by batch."""

    def run(batches):
        known, words = WordHashes(), shared.value
        for batch in _sliced(batches):
            _, u, w = _contexts(*_coded(batch, known, words))
            both = (u >= 0) & (w >= 0)
            key, n = np.unique((u[both] << CODE_BITS) | w[both], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

    return run


def _count_common(shared, keys):
    """(text) -> (place, n): how often each common pair occurs, by task."""

    def run(batches):
        known, words = WordHashes(), shared.value
        n = np.zeros(len(keys.value), np.int64)
        for batch in _sliced(batches):
            _, u, w = _contexts(*_coded(batch, known, words))
            both = (u >= 0) & (w >= 0)
            at, there = _place(keys.value, np.sort((u[both] << CODE_BITS) | w[both]))
            n += np.bincount(at[there], minlength=len(n))
        place = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(n[place])], ["place", "n"])

    return run


def common_pairs(texts: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of common pairs and their exact counts over all training texts: at most ``COMMON``, collected."""
    learned = texts.where("train")
    shown = learned.where(F.col("number") % PART == 0).select("text").mapInArrow(_pair_keys(shared), "key long, n long")
    top = shown.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    keys = np.sort(top["key"].to_numpy().astype(np.int64))
    counts = np.zeros(len(keys), np.int64)
    if len(keys):
        counted = learned.select("text").mapInArrow(_count_common(shared, texts.sparkSession.sparkContext.broadcast(keys)), "place long, n long")
        table = counted.groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        counts[table["place"].to_numpy()] = table["n"].to_numpy()
    return keys, counts


def common_contexts(keys: np.ndarray, counts: np.ndarray, words: Words) -> pa.Table:
    """What the common pairs add to rows of kind 1."""
    u, w = keys >> CODE_BITS, keys & CODE
    levels = [(counts == r).astype(np.int64) for r in range(1, K + 1)] + [np.where(counts > K, counts, 0)]
    head = np.flatnonzero(np.r_[True, u[1:] != u[:-1]][: len(u)])
    add = lambda x: np.add.reduceat(x, head) if len(head) else x
    columns = [u[head], add(counts), add(words.probability(words.counts)[w]), *map(add, levels)]
    return pa.table(columns, names=["id", "other", "s", *[f"r{i}" for i in range(1, K + 2)]])


def _own_sums(shared, common, d: np.ndarray):
    """(text, train, number) -> per row: tokens, and of its frequent words, contexts and common pairs what needs no other text; ``d``: discounts."""

    def run(batches):
        known, words = WordHashes(), shared.value
        c = words.counts
        keys, counts = common.value
        gain = np.log10(np.maximum(counts, 1)) + np.log10(d[np.minimum(counts, K + 1)]) - np.log10(words.probability(c))[keys & CODE]
        known_c, base = (c > 0).astype(np.int64), words.base(c)
        log_p, log_c = np.log10(words.probability(c)), np.log10(np.maximum(c, 1))
        for batch in _sliced(batches):
            code, size = _coded(batch, known, words)
            row, u, w = _contexts(code, size)
            both = (u >= 0) & (w >= 0)
            at, there = _place(keys, (u[both] << CODE_BITS) | w[both])
            pairs = np.bincount(row[both][there], weights=gain[at[there]], minlength=len(size))
            doc = np.repeat(np.arange(len(size)), size)[code >= 0]
            code = code[code >= 0]

            def total(values):
                # The end token and the start mark stand in every text.
                return np.bincount(doc, weights=values[code], minlength=len(size))

            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2),
                    pa.array(size + 1),
                    pa.array((total(known_c) + known_c[END]).astype(np.int64)),
                    pa.array(total(base) + base[END]),
                    pa.array(total(log_p) + log_p[END] - total(log_c) - log_c[START] + pairs),
                ],
                ["number", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def _pairs(shared, common, salted: int):
    """(text, train, number) -> (key, w, text, n), without common pairs.

    ``w`` is 0 where the key holds it; ``text`` packs the number and the training flag.
    """

    def rows(key, w, text, n):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, w, text, n.astype(np.int32))], ["key", "w", "text", "n"])

    def run(batches):
        known, words = WordHashes(), shared.value
        for batch in _sliced(batches):
            code, size = _coded(batch, known, words)
            train, number = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            text = (number << 1) | train.astype(np.int64)
            doc, u, w = _contexts(code, size)
            both = (u >= 0) & (w >= 0)
            # A batch's row number fits above the 40 bits of a key.
            packed, n = np.unique((doc[both] << (2 * CODE_BITS)) | (u[both] << CODE_BITS) | w[both], return_counts=True)
            key = packed & ((1 << (2 * CODE_BITS)) - 1)
            far = ~_place(common.value[0], key)[1]
            key, packed, n = key[far], packed[far], n[far]
            yield rows(key, np.zeros(len(key), np.int64), text[packed >> (2 * CODE_BITS)], n)
            u, w, doc = u[~both], w[~both], doc[~both]
            order = np.lexsort((w, u, doc))
            u, w, doc = u[order], w[order], doc[order]
            first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])][: len(u)])
            n = np.diff(np.r_[first, len(u)])
            u, w, doc = u[first], w[first], doc[first]
            salt = ((w * np.int64(0x9E3779B97F4A7C1)) >> np.int64(40)) & np.int64(SALTS - 1)
            salt = np.where(u < salted, salt, 0)
            yield rows(np.where(u < 0, u, BEFORE_RARE | (salt << CODE_BITS) | u), w, text[doc], n)

    return run


def _added(ids: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct ids and their sums of each of ``values``."""
    distinct, at = np.unique(ids, return_inverse=True)
    return distinct, [np.bincount(at, weights=v, minlength=len(distinct)) for v in values]


class Sums:
    """Sums by id over many steps; ``add`` and ``rest`` give those that no longer fit, or all that are left."""

    def __init__(self):
        self.ids, self.values = np.zeros(0, np.int64), []

    def add(self, ids: np.ndarray, values: list[np.ndarray]):
        ids, values = _added(ids, values)
        if len(self.ids):
            ids, values = _added(np.r_[self.ids, ids], [np.r_[a, b] for a, b in zip(self.values, values, strict=True)])
        self.ids, self.values = ids, values
        if len(ids) > HELD:
            yield from self.rest()

    def rest(self):
        if len(self.ids):
            yield self.ids, self.values
        self.__init__()


def _settle(shared):
    """Sorted (key, w, text, n, c, c_u) -> the kinds of rows (see the module's text). ``c_u`` is asked for rare contexts only."""

    def rows(kind, id_, other, s, r):
        m = len(id_)
        zero = np.zeros(m, np.int64)
        r = [np.asarray(x, np.int64) for x in r] + [zero] * (K + 1 - len(r))
        parts = [np.full(m, kind, np.int32), id_, other, np.asarray(s, np.float64), *r]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], ["kind", "id", "other", "s", *[f"r{i}" for i in range(1, K + 2)]])

    def texts(sums):
        for ids, (s, *levels) in sums:
            yield rows(0, ids, np.zeros(len(ids), np.int64), s, levels)

    def run(batches):
        words, last, held = shared.value, (None, None), Sums()
        p_word = words.probability(words.counts)
        log_p = np.log10(p_word)
        for batch in gathered(batches, GATHER):
            key, w, text, n, c, c_u = (batch.column(i).to_numpy() for i in range(6))
            two = (key >= 0) & (key < BEFORE_RARE)
            u = np.where(two, key >> CODE_BITS, np.where(key < 0, key, key & CODE))
            w = np.where(two, key & CODE, w)
            number, coded = text >> 1, w >= 0
            c_u = np.where(u >= 0, words.counts[np.maximum(u, 0)], c_u)
            seen = c > 0
            gain = np.log10(np.maximum(c, 1)) - np.where(coded, log_p[np.maximum(w, 0)], 0)
            gain -= np.where(u < 0, np.log10(np.maximum(c_u, 1)), 0)
            level, times = np.minimum(c[seen], K + 1), n[seen]
            yield from texts(held.add(number[seen], [times * gain[seen], *[times * (level == r) for r in range(1, K + 2)]]))
            new = np.r_[(u[0], w[0]) != last, (u[1:] != u[:-1]) | (w[1:] != w[:-1])] & seen
            last = (u[-1], w[-1])
            t_u, t_w, t_c = u[new], w[new], c[new]
            if len(t_u):
                head = np.flatnonzero(np.r_[True, t_u[1:] != t_u[:-1]])
                add = lambda x: np.add.reduceat(x, head)
                p = np.where(t_w >= 0, p_word[np.maximum(t_w, 0)], 0.0)
                kinds = [add((t_c == r).astype(np.int64)) for r in range(1, K + 1)]
                yield rows(1, t_u[head], add(t_c), add(p), [*kinds, add(np.where(t_c > K, t_c, 0))])
                sixth = np.array([(t_c == K + 1).sum()])
                yield rows(5, np.zeros(1, np.int64), np.zeros(1, np.int64), sixth, [])
                rare = t_w < 0
                yield rows(4, t_u[rare], t_w[rare], np.zeros(rare.sum()), [])
            back = ~seen & (c_u > 0)
            yield rows(2, number[back], u[back], n[back], [])
            yield rows(3, number[~coded], w[~coded], n[~coded], [np.where(seen[~coded], 0, n[~coded])])
        yield from texts(held.rest())

    return run


def _backed_off(shared):
    """(text, frequent context, n) of unseen pairs -> (id, score): per text and task."""

    def texts(sums):
        for ids, (score,) in sums:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(score)], ["id", "score"])

    def run(batches):
        log_a, held = shared.value, Sums()
        for batch in gathered(batches, GATHER):
            number, u, n = (batch.column(i).to_numpy() for i in range(3))
            yield from texts(held.add(number, [n * log_a[u]]))
        yield from texts(held.rest())

    return run


def score_texts(docs: DataFrame, train, frequent: int = 1_000_000, salted: int = 1024) -> tuple[DataFrame, Words]:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_tokens, n_known, base_score, score)`` per row, and the word model.

    ``train`` is a boolean column: rows to learn from. Scores are base 10 logarithms.
    """
    if frequent + 2 > CODE:
        raise ValueError(f"frequent is at most {CODE - 2}")
    spark = docs.sparkSession
    number = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    texts = docs.select(F.col("text").cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"), number.alias("number"))
    counts = stored(word_counts(texts), "katz-words")
    words = learn_words(counts, texts.where("train").count(), frequent)
    shared = spark.sparkContext.broadcast(words)
    own = docs.select("doc_id", number.alias("number"))
    keys, key_counts = common_pairs(texts, shared)
    common = spark.sparkContext.broadcast((keys, key_counts))
    dealt = F.when(F.col("key").between(salted << CODE_BITS, BEFORE_RARE - 1), F.shiftright("key", CODE_BITS)).otherwise(F.col("key"))
    pairs = texts.mapInArrow(_pairs(shared, common, salted), "key long, w long, text long, n int").repartition(dealt).withColumn("dealt", dealt)
    use = F.when(F.col("text").bitwiseAND(F.lit(1)) == 1, F.col("n")).otherwise(0).cast("long")
    pairs = pairs.withColumn("c", F.sum(use).over(Window.partitionBy("key", "dealt", "w"))).withColumn(
        "c_u", F.sum(use).over(Window.partitionBy("key", "dealt"))
    )
    levels = ", ".join(f"r{i} long" for i in range(1, K + 2))
    path = scratch_path(spark, "katz-parts")
    pairs = pairs.sortWithinPartitions("key", "dealt", "w").select("key", "w", "text", "n", "c", "c_u")
    settled = pairs.mapInArrow(_settle(shared), f"kind int, id long, other long, s double, {levels}")
    settled.write.partitionBy("kind").parquet(path)
    parts = spark.read.schema(f"id long, other long, s double, {levels}, kind int").parquet(path)
    part = lambda kind: parts.where(F.col("kind") == kind)

    # P(w) of rare words, by their negative number.
    rare = counts.select((-F.shiftrightunsigned("word", 1) - 1).alias("w"), F.col("c").alias("c_w"))
    total, unknown = float(max(words.total, 1)), float(words.unknown)
    d_word = F.array(*[F.lit(float(x)) for x in words.d])
    p_rare = F.when(F.col("c_w").isNull(), F.lit(unknown)).otherwise(
        d_word[F.least("c_w", F.lit(K + 1)).cast("int")] * F.col("c_w") / total
    )
    add = [F.sum(f"r{i}").alias(f"r{i}") for i in range(1, K + 2)]
    near = spark.createDataFrame(common_contexts(keys, key_counts, words), f"id long, other long, s double, {levels}")
    contexts = part(1).drop("kind").unionByName(near).groupBy("id").agg(F.sum("other").alias("c_u"), F.sum("s").alias("p"), *add)
    contexts = stored(contexts, "katz-contexts")
    spectrum = contexts.agg(*add).first()
    pairs_of = {r: spectrum[f"r{r}"] or 0 for r in range(1, K + 1)}
    pairs_of[K + 1] = int(part(5).agg(F.sum("s")).first()[0] or 0) + int((key_counts == K + 1).sum())
    d = discounts(pairs_of)
    own_sums = texts.mapInArrow(_own_sums(shared, common, d), "number long, n_tokens long, n_known long, base_score double, score double")
    more = part(4).join(rare, F.col("other") == F.col("w")).groupBy("id").agg(F.sum(p_rare).alias("p_more")).withColumnRenamed("id", "u")
    kept = sum((F.col(f"r{r}") * r * float(d[r]) for r in range(1, K + 1)), F.col(f"r{K + 1}") * float(d[K + 1]))
    weight = (1 - kept / F.col("c_u")) / (1 - F.col("p") - F.coalesce("p_more", F.lit(0.0)))
    weights = contexts.join(more, F.col("id") == F.col("u"), "left").select(
        F.col("id").alias("u"), (F.log10(weight) + F.when(F.col("id") >= 0, F.log10("c_u")).otherwise(0.0)).alias("log_a")
    )
    weights = stored(weights, "katz-weights")
    logs = [float(np.log10(x)) for x in d]
    zero = F.lit(0.0)
    seen = part(0).select(
        "id", F.lit(0).cast("long").alias("known"), zero.alias("base"),
        (F.col("s") + sum((F.col(f"r{r}") * logs[r] for r in range(1, K + 2)), zero)).alias("score"),
    )
    coded = weights.where("u >= 0").toArrow()  # as many rows as words have codes, at most
    log_a = np.zeros(len(words.counts))
    log_a[coded["u"].to_numpy()] = coded["log_a"].to_numpy()
    often = part(2).where("other >= 0").select("id", "other", "s").mapInArrow(_backed_off(spark.sparkContext.broadcast(log_a)), "id long, score double")
    seldom = part(2).where("other < 0").join(weights, F.col("other") == F.col("u")).select("id", (F.col("s") * F.col("log_a")).alias("score"))
    unseen = often.unionByName(seldom).select("id", F.lit(0).cast("long").alias("known"), zero.alias("base"), "score")
    c_w = F.coalesce("c_w", F.lit(0))
    base = F.log10((c_w + 0.5) / (words.total + 0.5 * (words.vocabulary + 1)))
    odd = part(3).join(rare, F.col("other") == F.col("w"), "left").select(
        "id", F.when(c_w > 0, F.col("s").cast("long")).otherwise(0).alias("known"), (F.col("s") * base).alias("base"),
        (F.col("r1") * F.log10(p_rare)).alias("score"),
    )
    sums = seen.unionByName(unseen).unionByName(odd).groupBy("id").agg(
        F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("more")
    )
    # Repeated rows share a number: their sums are divided by how many they are.
    whole = own_sums.groupBy("number").agg(
        F.count(F.lit(1)).alias("rows"), *[F.max(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    )
    every = whole.join(sums, F.col("number") == F.col("id"), "left")
    share = lambda c: F.coalesce(F.col(c) / F.col("rows"), F.lit(0.0))
    every = every.select(
        "number", "n_tokens", (F.col("n_known") + share("known").cast("long")).alias("n_known"),
        (F.col("base_score") + share("base")).alias("base_score"), (F.col("score") + share("more")).alias("score"),
    )
    return own.join(every, "number").drop("number"), words
