"""Language of each text and of spans inside it: scripts narrow the candidates, Viterbi labels the words.

*Words* are runs of letters, lower-cased. *Training* counts character trigrams (a blank on either side of a word) in hashed buckets per
language, over all rows that are given; the counts are added up by Spark, so the driver only sees languages x buckets numbers.
A word's score for a language is the sum of the log probabilities of its trigrams.

*Scripts.* The script of a word is that of its first letter. A language is a candidate for a word if at least one in a hundred of the letters
it was trained on have that script; where no language has it, all stay candidates and the word tells nothing.

*Viterbi.* The best sequence of word labels maximises the word scores minus ``switch`` for every change of language. All texts of a
group take a step together, so a step is a few array operations however many texts there are. Groups hold texts of like length and ``GROUP`` characters
(or one longer text), so that memory does not follow the size of a batch. Runs of equal labels are the spans; the text's language
is the one with most letters in its spans (ties: the first by name), and its score is that share of the letters.

*Recognition.* ``lang_known`` is the share of a text's letters in words whose script a learned language has; ``lang_fit`` is the mean, over the
trigrams of those words, of the log probability under their labels, less that of a uniform draw from the buckets. At 0 or less, chance explains the text as well as any language.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and no spans; so is every text if nothing was learned. Long
texts are scored whole, in pieces of bounded size. Repeated rows get equal results.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
#: Characters scored at a time.
PIECE = 1 << 20
#: Characters whose words are labelled together.
GROUP = 1 << 21
IMPOSSIBLE = -1e6

#: First code points of Unicode blocks and the script of the letters from there on.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1300, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0x10000, "Other"), (0x20000, "Han"),
)
NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Per code point: 0 for no letter, else 1 + number of its script."""
    at = np.array([p for p, _ in SCRIPTS])
    number = np.array([NAMES.index(name) for _, name in SCRIPTS], np.int8)
    out = np.zeros(0x110000, np.int8)
    code = np.flatnonzero([unicodedata.category(chr(c))[0] in "LM" for c in range(0x30000)])
    out[code] = 1 + number[np.searchsorted(at, code, side="right") - 1]
    return out


def has_letter(text: str) -> bool:
    return bool(re.search("[A-Za-z]", text)) or any(map(str.isalpha, text))


class Pieces:
    """Words of many texts: for each piece of bounded size its trigram buckets and word borders."""

    def __init__(self, texts: list[str]):
        self.texts = texts

    def __iter__(self):
        table = _letters()
        group, size, first = [], 0, 0
        for i, text in enumerate(self.texts):
            group.append(text.lower())
            size += len(text) + 1
            if size >= PIECE or i == len(self.texts) - 1:
                code = np.frombuffer("\n".join(group).encode("utf-32-le", "surrogatepass"), np.uint32)
                kind = table[np.minimum(code, 0x10FFFF)]
                x = np.where(kind > 0, code, 0).astype(np.uint32)
                before, after = np.r_[np.uint32(0), x[:-1]], np.r_[x[1:], np.uint32(0)]
                with np.errstate(over="ignore"):
                    h = before * np.uint32(0x9E3779B1) + x * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)
                    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                letter = np.flatnonzero(kind)
                bucket = (h >> np.uint32(16)).astype(np.int32)[letter]
                start = np.flatnonzero(np.r_[True, letter[1:] != letter[:-1] + 1]) if len(letter) else letter
                ends = np.cumsum([len(t) + 1 for t in group])
                text_of = first + np.searchsorted(ends, letter[start], side="right")
                yield text_of, bucket, start, kind[letter[start]] - 1, np.diff(np.r_[start, len(letter)])
                group, size, first = [], 0, i + 1


def _count(batches):
    """(lang, text) -> (lang, kind, at, n): trigram buckets (kind 0) and letters per script (kind 1)."""
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            mine = [texts[i] for i in np.flatnonzero(langs == lang) if texts[i] is not None]
            own = grams.setdefault(lang, np.zeros(BUCKETS, np.int64))
            seen = scripts.setdefault(lang, np.zeros(len(NAMES), np.int64))
            for _, bucket, _, script, letters in Pieces(mine):
                own += np.bincount(bucket, minlength=BUCKETS)
                seen += np.bincount(script, weights=letters, minlength=len(NAMES)).astype(np.int64)
    for kind, counts in ((0, grams), (1, scripts)):
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(own[at])],
                ["lang", "kind", "at", "n"],
            )


def learn(docs: DataFrame) -> dict:
    """Model from ``docs(lang, text)``: all rows with a language. Its size is languages x ``BUCKETS``."""
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInArrow(_count, "lang string, kind int, at int, n long").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n"))
    table = counts.toArrow().to_pydict()
    langs = sorted(set(table["lang"]))
    grams, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(NAMES), len(langs)))
    lang = np.searchsorted(langs, table["lang"]) if langs else np.zeros(0, int)
    kind, at, n = (np.array(table[c], np.int64) for c in ("kind", "at", "n"))
    for k, into in ((0, grams), (1, scripts)):
        into[at[kind == k], lang[kind == k]] = n[kind == k]
    logs = np.log(grams + 0.5) - np.log(grams.sum(axis=0) + 0.5 * BUCKETS)
    fits = scripts >= 0.01 * np.maximum(scripts.sum(axis=0), 1)
    return {"langs": langs, "logs": logs.astype(np.float32), "fits": fits}


def viterbi(scores: np.ndarray, text_of: np.ndarray, n_texts: int, switch: float) -> np.ndarray:
    """Best label of each word; words of a text are neighbours, in order."""
    counts = np.bincount(text_of, minlength=n_texts)
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    counts, first = counts[order], first[order]
    alive = np.searchsorted(-counts, -np.arange(counts[0] if len(counts) else 0), side="left")  # texts with more than t words
    kind = np.min_scalar_type(scores.shape[1])  # as small as the number of languages allows
    came = np.zeros(scores.shape, kind)
    best = np.zeros((len(counts), scores.shape[1]), np.float32)
    states = np.arange(scores.shape[1], dtype=kind)
    for t, k in enumerate(alive):
        at, now = first[:k] + t, best[:k]
        if t:
            top = now.argmax(axis=1)
            moved = now[np.arange(k), top][:, None] - switch
            stay = now >= moved
            came[at] = np.where(stay, states, top[:, None])
            now = np.where(stay, now, moved)
            now = now - now.max(axis=1, keepdims=True)
        best[:k] = now + scores[at]
    labels = np.zeros(len(scores), kind)
    state = best.argmax(axis=1)
    for t in range(len(alive) - 1, -1, -1):
        k = alive[t]
        at = first[:k] + t
        labels[at] = state[:k]
        state[:k] = came[at, state[:k]]
    return labels


def label_batch(texts: list[str | None], model: dict, switch: float):
    """Per text: language, score, spans as (lang, first word, end word)."""
    return [found[:3] for found in describe_batch(texts, model, switch)]


def describe_batch(texts: list[str | None], model: dict, switch: float):
    """As ``label_batch``, and the number of letters, the share of letters in known scripts, and the fit."""
    out = [("und", 0.0, [], 0, 0.0, 0.0)] * len(texts)
    some = sorted((i for i, t in enumerate(texts) if t and has_letter(t)), key=lambda i: -len(texts[i]))
    group, size = [], 0
    for n, i in enumerate(some):
        group.append(i)
        size += len(texts[i])
        if size >= GROUP or n == len(some) - 1:
            for j, found in zip(group, _describe([texts[j] for j in group], model, switch), strict=True):
                out[j] = found
            group, size = [], 0
    return out


def _describe(texts: list[str], model: dict, switch: float):
    """As ``describe_batch``, for texts with a letter, all at once."""
    langs, logs, fits = model["langs"], model["logs"], model["fits"]
    out = [("und", 0.0, [], 0, 0.0, 0.0)] * len(texts)
    of, scores, sizes, seen = [], [], [], []
    for text_of, bucket, start, script, letters in Pieces(texts):
        if not len(start):
            continue
        of.append(text_of)
        sizes.append(letters)
        if langs:
            own = np.add.reduceat(logs[bucket], start, axis=0)
            can = fits[script]
            known = can.any(axis=1)
            own = np.where(known[:, None], np.where(can, own, IMPOSSIBLE), 0)
            scores.append(own.astype(np.float32))
            seen.append(known)
    if not of:
        return out
    of, sizes = np.concatenate(of), np.concatenate(sizes)
    letters = np.bincount(of, weights=sizes, minlength=len(texts))
    if not langs:
        return [("und", 0.0, [], int(n), 0.0, 0.0) for n in letters]
    scores, seen = np.concatenate(scores), np.concatenate(seen)
    labels = viterbi(scores, of, len(texts), switch)
    share = np.bincount(of * len(langs) + labels, weights=sizes, minlength=len(texts) * len(langs)).reshape(-1, len(langs))
    known = np.bincount(of, weights=sizes * seen, minlength=len(texts))
    gain = np.bincount(of, weights=np.where(seen, scores[np.arange(len(of)), labels] + sizes * np.log(BUCKETS), 0), minlength=len(texts))
    first = np.searchsorted(of, np.arange(len(texts)))
    edge = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (labels[1:] != labels[:-1])])
    end = np.r_[edge[1:], len(of)]
    cut = np.searchsorted(of[edge], np.arange(len(texts) + 1))
    for j in range(len(texts)):
        if not letters[j]:
            continue
        top = int(share[j].argmax())
        spans = [(langs[labels[edge[s]]], int(edge[s] - first[j]), int(end[s] - first[j])) for s in range(cut[j], cut[j + 1])]
        fit = float(gain[j] / known[j]) if known[j] else 0.0
        out[j] = (langs[top], float(share[j][top] / letters[j]), spans, int(letters[j]), float(known[j] / letters[j]), fit)
    return out


MADE = "lang_pred string, lang_score double, lang_spans array<struct<lang:string,first_word:bigint,end_word:bigint>>, lang_letters bigint, lang_known double, lang_fit double"


def predict(docs: DataFrame, model: dict, switch: float = 12.0) -> DataFrame:
    """All columns of ``docs(text, ...)``, and those of ``MADE``."""
    names = [field.split()[0] for field in MADE.split(", ")]
    kept = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers
    place = kept.index("text")
    span = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))

    def run(batches):
        for batch in batches:
            found = describe_batch(batch.column(place).to_pylist(), shared.value, switch)
            made = [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([[dict(zip(("lang", "first_word", "end_word"), s, strict=True)) for s in f[2]] for f in found], span),
                pa.array([f[3] for f in found], pa.int64()),
                pa.array([f[4] for f in found], pa.float64()),
                pa.array([f[5] for f in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return docs.select(*kept).mapInArrow(run, f"{fields}, {MADE}")


def recognised(docs: DataFrame, model: dict, switch: float = 12.0, known: float = 0.5) -> DataFrame:
    """Rows of ``docs`` in a language of the model, with the columns of ``predict``.

    Rejected are null texts, texts without a letter, texts of which less than ``known`` is in a script that a learned language has, and texts
    that fit their labels no better than chance. If nothing was learned there is nothing to judge by, and every text with a letter stays.
    """
    rows = predict(docs, model, switch)
    return rows.where((F.col("lang_known") >= known) & (F.col("lang_fit") > 0) if model["langs"] else F.col("lang_letters") > 0)


def held_out(doc_id, parts: int, which: int):
    """True where crc32 of the id as text leaves ``which``; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == which, F.lit(False))
