"""Toxicity of whole texts by a counterfactual-regularised logistic regression, learned from labelled texts.

*Features* are words and their beginnings of 4 to 7 letters (inflected forms share those); a feature's value is its share of the text's words,
100 times, at most 1. *Which* features take part is decided over all labelled rows: a first pass counts, per class, the texts that hold a feature of each of
``BUCKETS`` hash buckets and keeps the ``WIDE`` buckets whose frequencies differ most between the classes; a second pass counts the features in those
buckets exactly and keeps the ``FEATURES`` best. A task sends two numbers per bucket, however much text it has read.

*Counterfactuals.* Every labelled sentence that names an identity group (``GROUPS``) is copied with all its identity terms moved on within their group, in
every way. Training minimises

    mean log loss + ridge |w|^2 + pairing * mean over pairs of (score of the sentence - score of its copy)^2

with scores before the logistic function, so a group's mere mention is not what decides. A group that the corpus's toxic texts happen to name more
often would be learned as a sign by itself; the penalty draws its weight to those of the other groups, and what is said keeps its own. All identity terms are features.

*Training* runs over all labelled rows, by L-BFGS on the driver over sums that tasks compute; the driver holds ``FEATURES`` numbers a step.

Defined cases: null and empty texts have no features and get the score of the intercept; labels that are null, and ids that are null, teach nothing; a doc_id with several labels or rows
teaches each combination; with labels of one class only, every score is that class; without labels every score is 0. Texts are read whole; scores depend on the text alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.llm.tables import stored

BUCKETS = 1 << 18
WIDE = 4096
FEATURES = 1024
#: A feature has to occur in so many labelled texts.
LEAST = 3
RIDGE = 1e-4
PAIRING = 1.0
BEGINNINGS = (4, 5, 6, 7)
#: Labels are broadcast up to this size (16 bytes a row, held as 64), beyond it the texts are joined by a shuffle.
BROADCAST_ROWS = 400_000
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")

#: Terms that name groups of people; those of one line replace each other.
GROUPS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("transgender", "cisgender", "nonbinary"),
    ("woman", "man"),
    ("women", "men"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("blind", "deaf", "disabled"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
)
IDENTITY = {f"^{term}$" for terms in GROUPS for term in terms}
_PLACE = {term: (g, i) for g, terms in enumerate(GROUPS) for i, term in enumerate(terms)}


def features_of(word: str) -> tuple[str, ...]:
    """A word and its beginnings; ``^`` and ``$`` mark the word's ends."""
    return (f"^{word}$", *(f"^{word[:n]}" for n in BEGINNINGS if n <= len(word)))


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def counterfactuals(sentence: str) -> list[list[str]]:
    """The sentence's words, and a copy for each way of moving its identity terms on within their groups."""
    words = WORD.findall(sentence.lower())
    named = [(k, *_PLACE[w]) for k, w in enumerate(words) if w in _PLACE]
    if not named:
        return []
    out = [words]
    for shift in range(1, max(len(GROUPS[g]) for _, g, _ in named)):
        copy = list(words)
        for k, g, i in named:
            copy[k] = GROUPS[g][(i + shift) % len(GROUPS[g])]
        if copy not in out:
            out.append(copy)
    return out


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(text, toxic)`` of the rows that have an id and a label."""
    marks = labels.where("doc_id is not null and toxic is not null").select(
        F.col("doc_id").alias("_doc"), (F.col("toxic") != 0).alias("toxic")
    )
    marks = marks.distinct()
    few = labels.count() <= BROADCAST_ROWS
    return docs.where("doc_id is not null").select("doc_id", "text").join(
        F.broadcast(marks) if few else marks.hint("merge"), F.col("doc_id") == F.col("_doc")
    ).select("text", "toxic")


class Buckets:
    """Word -> hash buckets of its features, remembered for frequent words up to a bound."""

    def __init__(self, most: int = 200_000):
        self.known: dict[str, tuple[int, ...]] = {}
        self.most = most

    def __call__(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[word] = tuple(map(bucket, features_of(word)))
        return found


def _bucket_counts(batches):
    counts, rows, look = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64), Buckets()
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows[int(toxic)] += 1
            held: set[int] = set()
            for word in set(WORD.findall((text or "").lower())):
                held.update(look(word))
            counts[int(toxic), np.fromiter(held, np.int64, len(held))] += 1
    at = np.flatnonzero(counts.any(axis=0))
    for i in range(0, len(at), 65536):
        part = at[i : i + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[0, part]), pa.array(counts[1, part])], ["at", "clean", "toxic"])
    if rows.any():
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array(rows[:1]), pa.array(rows[1:])], ["at", "clean", "toxic"])


def _difference(clean: int, toxic: int):
    """Squared score of the two-sample test that a feature is as frequent in both classes (n: texts of each class)."""
    n, share = clean + toxic, (F.col("clean") + F.col("toxic")) / (clean + toxic)
    gap = F.col("toxic") / toxic - F.col("clean") / clean
    return F.when(share < 1, gap * gap / (share * (1 - share) * n)).otherwise(0.0)


def _wide_features(chosen: np.ndarray):
    """(text, toxic) -> (toxic, n_words, features, counts) with the features in chosen buckets, and the same of sentence pairs."""
    inside = np.zeros(BUCKETS, bool)
    inside[chosen] = True

    def run(batches):
        known: dict[str, tuple[str, ...]] = {}

        def kept(word):
            found = known.get(word)
            if found is None:
                if len(known) >= 200_000:
                    known.clear()
                found = known[word] = tuple(f for f in features_of(word) if inside[bucket(f)])
            return found

        def counted(words):
            out: Counter = Counter()
            for word, n in Counter(words).items():
                for feature in kept(word):
                    out[feature] += n
            return out

        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORD.findall((text or "").lower())
                found = counted(words)
                rows.append((toxic, len(words), list(found), list(found.values()), None))
                if _PLACE.keys().isdisjoint(words):
                    continue
                for sentence in SENTENCE.findall(text):
                    copies = counterfactuals(sentence)
                    if not copies:
                        continue
                    before = counted(copies[0])
                    for copy in copies[1:]:
                        change = counted(copy)
                        change.subtract(before)
                        change = {f: n for f, n in change.items() if n}
                        rows.append((toxic, len(copy), list(change), list(change.values()), True))
            names = ["toxic", "n_words", "features", "counts", "pair"]
            types = [pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.bool_()]
            for i in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows[i : i + 4096], strict=True), types, strict=True)], names
                )

    return run


def _feature_counts(batches, most: int = 500_000):
    """(toxic, features) -> texts of each class per feature, added up in the task as far as ``most`` features go at a time."""
    held: dict[str, list[int]] = {}

    def flush():
        clean, toxic = zip(*held.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(clean), pa.array(toxic)], ["feature", "clean", "toxic"])

    for batch in batches:
        for toxic, features in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for feature in features:
                held.setdefault(feature, [0, 0])[toxic] += 1
        if len(held) >= most:
            yield flush()
            held = {}
    if held:
        yield flush()


def value(count, n_words):
    """100 times the feature's share of the words, kept within -1 and 1."""
    return np.clip(100.0 * count / np.maximum(n_words, 1), -1.0, 1.0)


def _numbered(spot: dict[str, int]):
    """Features by name -> (toxic, pair, numbers and values of the chosen features)."""

    def run(batches):
        for batch in batches:
            toxic, n_words, features, counts, pair = (c.to_pylist() for c in batch.columns)
            ats, xs = [], []
            for names, numbers, words in zip(features, counts, n_words, strict=True):
                held = [(spot[f], c) for f, c in zip(names, numbers, strict=True) if f in spot]
                ats.append([i for i, _ in held])
                xs.append(value(np.array([c for _, c in held], float), words).tolist())
            arrays = [pa.array(toxic, pa.bool_()), pa.array([bool(p) for p in pair], pa.bool_()), pa.array(ats, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["toxic", "pair", "at", "x"])

    return run


class Model:
    """Weights by feature and an intercept; ``score`` is a probability."""

    def __init__(self, weights: dict[str, float], intercept: float, constant: float | None = None):
        self.weights, self.intercept, self.constant = weights, intercept, constant
        starts = defaultdict(set)
        for feature in weights:
            if not feature.endswith("$"):
                starts[feature[1:5]].add(feature)
        self.starts, self.whole = dict(starts), {f[1:-1] for f in weights if f.endswith("$")}

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        words = WORD.findall((text or "").lower())
        found: Counter = Counter()
        for word, n in Counter(words).items():
            if word in self.whole:
                found[f"^{word}$"] += n
            if word[:4] in self.starts:
                for k in BEGINNINGS:
                    feature = f"^{word[:k]}"
                    if k <= len(word) and feature in self.weights:
                        found[feature] += n
        # Summed in the order of names: equal texts get equal scores to the last bit.
        z = self.intercept + sum(self.weights[f] * float(value(found[f], len(words))) for f in sorted(found))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def _descend(evaluate, w: np.ndarray, steps: int = 40, memory: int = 12, tolerance: float = 1e-6) -> np.ndarray:
    """L-BFGS with step halving; ``evaluate(w)`` gives loss and gradient."""
    loss, grad = evaluate(w)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(grad).max() <= tolerance:
            break
        d, a = grad.copy(), []
        for s, y, rho in reversed(pairs):
            a.append(rho * (s @ d))
            d -= a[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            d *= (s @ y) / (y @ y)
        for (s, y, rho), k in zip(pairs, reversed(a), strict=True):
            d += (k - rho * (y @ d)) * s
        size = 1.0 if pairs else 1.0 / max(1.0, float(np.abs(grad).sum()))
        while True:
            moved = w - size * d
            after, slope = evaluate(moved)
            if after <= loss - 1e-4 * size * (grad @ d) or size < 1e-6:
                break
            size /= 4
        s, y = moved - w, slope - grad
        if s @ y > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, y, 1.0 / (s @ y))]
        if loss - after < 1e-8:
            return moved if after < loss else w
        w, loss, grad = moved, after, slope
    return w


def learn(docs: DataFrame, labels: DataFrame, pairing: float = PAIRING, ridge: float = RIDGE) -> Model:
    """A model of ``labels(doc_id, toxic)`` over ``docs(doc_id, text)``."""
    rows = labelled(docs, labels)
    counts = stored(
        rows.mapInArrow(_bucket_counts, "at long, clean long, toxic long").groupBy("at").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")),
        "toxicity-buckets",
    )
    total = counts.where("at < 0").first()
    n = (total["clean"], total["toxic"]) if total else (0, 0)
    if not all(n):
        return Model({}, 0.0, 1.0 if n[1] else 0.0)
    best = counts.where(f"at >= 0 and clean + toxic >= {LEAST}").orderBy(_difference(*n).desc(), "at").limit(WIDE)
    chosen = np.array([r["at"] for r in best.select("at").collect()] + [bucket(f) for f in sorted(IDENTITY)], np.int64)
    wide = stored(
        rows.mapInArrow(_wide_features(chosen), "toxic boolean, n_words long, features array<string>, counts array<long>, pair boolean"),
        "toxicity-wide",
    )
    exact = (
        wide.where("pair is null").select("toxic", "features").mapInArrow(_feature_counts, "feature string, clean long, toxic long")
        .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(f"clean + toxic >= {LEAST}")
    )
    names = [r["feature"] for r in exact.orderBy(_difference(*n).desc(), "feature").limit(FEATURES).select("feature").collect()]
    names += sorted(IDENTITY - set(names))
    spot = {f: i for i, f in enumerate(names)}
    width = len(names) + 1
    rows = stored(wide.mapInArrow(_numbered(spot), "toxic boolean, pair boolean, at array<int>, x array<double>"), "toxicity-rows")
    n_pairs = max(1, rows.where("pair").count())

    def task_of(w):
        def run(batches):
            total = np.zeros(width + 1)  # gradient, then loss
            for batch in batches:
                if not batch.num_rows:
                    continue
                toxic, pair = (batch.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (0, 1))
                sizes = np.diff(batch.column(2).offsets.to_numpy())
                row = np.repeat(np.arange(batch.num_rows), sizes)
                at, x = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
                z = np.bincount(row, w[at] * x, batch.num_rows)
                full = z + w[-1]
                off = np.where(pair, 2 * pairing / n_pairs * z, (1.0 / (1.0 + np.exp(-np.clip(full, -500, 500))) - toxic) / sum(n))
                total[:width] += np.bincount(at, off[row] * x, width)
                total[width - 1] += off[~pair].sum()
                total[-1] += pairing / n_pairs * (z[pair] ** 2).sum() + (np.logaddexp(0.0, full) - toxic * full)[~pair].sum() / sum(n)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "part"])

        return run

    def evaluate(w):
        parts = rows.mapInArrow(task_of(w), "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()
        total = np.zeros(width + 1)
        for r in sorted(parts):
            total[r["at"]] = r["part"]
        grad = total[:width]
        grad[:-1] += 2 * ridge * w[:-1]
        return total[-1] + ridge * float(w[:-1] @ w[:-1]), grad

    start = np.zeros(width)
    start[-1] = np.log(n[1] / n[0])
    w = _descend(evaluate, start)
    return Model({f: float(x) for f, x in zip(names, w[:-1], strict=True)}, float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``toxicity`` (0 to 1)."""
    columns = [c for c in docs.columns if c != "toxicity"]

    @F.pandas_udf("double")
    def scores(text):
        import pandas as pd

        return pd.Series([model.score(t) for t in text], dtype=float)

    return docs.select(*columns, scores("text").alias("toxicity"))
