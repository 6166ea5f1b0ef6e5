"""Language identification: scripts narrow the candidates, then Viterbi over per-word scores labels spans of mixed text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, row_batches

# Labelled documents per language on which the model is fitted, those of smallest hashed id.
TRAINING_DOCS = 1500
# Hashed letter sequences of one to four bytes of a word with its boundaries.
LONGEST_SEQUENCE = 4
BUCKETS = 1 << 18
# Characters of text labelled at once, and of words hashed and scored at once: a word has about four sequences for each of its bytes.
LABELLED_SIZE = 1_000_000
SCORED_SIZE = 50_000
# Log probability lost with every change of language between neighbouring words.
SWITCH_PENALTY = 9.0
# A language is a candidate for words of a script that holds at least this share of its training letters.
SCRIPT_SHARE = 0.01
# Score against the best language of one that is no candidate for a word, or is much less likely.
NO_CANDIDATE = -60.0
UNDETERMINED = "und"
_WORDS = re.compile(r"[^\W\d_]+")

# First code points of Unicode ranges, each with the script its letters belong to.
SCRIPT_RANGES = (
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "devanagari"),
    (0x0980, "bengali"),
    (0x0A00, "other"),
    (0x0B80, "tamil"),
    (0x0C00, "other"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "ethiopic"),
    (0x1380, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3100, "other"),
    (0x3400, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "other"),
    (0x20000, "han"),
    (0x323B0, "other"),
)
_STARTS = np.array([first for first, _ in SCRIPT_RANGES])
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_SCRIPT_OF_RANGE = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; superscripts, fractions and other numbers written as signs count only beside a letter."""
    return [word for word in _WORDS.findall(text.lower()) if word.isalpha() or any(map(str.isalpha, word))]


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of every word's first letter, as a position in ``SCRIPTS``."""
    points = np.fromiter((ord(word[0]) for word in words), np.int64, len(words))
    return _SCRIPT_OF_RANGE[np.searchsorted(_STARTS, points, "right") - 1]


def sequences_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the hashed byte sequences of every word, one word after another, and where each word's begin."""
    data = np.frombuffer(b" ".join([b"", *(word.encode() for word in words), b""]), np.uint8).astype(np.uint64)
    blank = data == 32
    number = np.cumsum(blank) - 1  # the word that a byte or its leading blank belongs to
    parts, owners = [], []
    value = np.zeros(len(data), np.uint64)
    for size in range(1, LONGEST_SEQUENCE + 1):
        last = len(data) - size + 1
        value = value[:last] * np.uint64(257) + data[size - 1 :]
        # A sequence may hold its word's blanks at the ends, but none inside.
        inside = number[np.maximum(np.arange(last) + size - 2, 0)] == number[:last]
        keep = inside & (~blank[:last] if size == 1 else True)
        owner = number[:last]
        at = np.nonzero(keep & (owner < len(words)))[0]
        parts.append(mix(value[at] + np.uint64(size << 40)) & np.uint64(BUCKETS - 1))
        owners.append(owner[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    begins = np.searchsorted(owner[order], np.arange(len(words)))
    return np.concatenate(parts)[order].astype(np.int64), begins


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities of sequences by language, and the languages that are candidates for each script."""

    languages: list[str]
    weights: np.ndarray
    candidates: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probability of every word in every language, against the best; a script that no language uses decides by that alone."""
        out = np.empty((len(words), len(self.languages)), self.weights.dtype)
        for begin, end in row_batches(words, SCORED_SIZE):
            buckets, begins = sequences_of(words[begin:end])
            np.add.reduceat(self.weights[buckets], begins, axis=0, out=out[begin:end])
        out[~self.candidates[scripts_of(words)]] = -np.inf
        out -= out.max(1, keepdims=True)
        return np.maximum(out, NO_CANDIDATE, out=out)


def viterbi(codes: list[np.ndarray], scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> list[np.ndarray]:
    """The best language of every word of every document: the sum of scores less the penalty for each switch is largest.

    All documents advance by one word at a time, longest first, so that those still running are always the leading ones.
    """
    sizes = np.array([len(c) for c in codes])
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    labels = [np.empty(size, np.int64) for size in sizes]
    if not len(order):
        return labels
    lengths = sizes[order]
    running = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # documents longer than t words
    places = np.cumsum(running) - running
    flat = np.empty(int(running.sum()), np.int64)
    for row, k in enumerate(order.tolist()):
        flat[places[: sizes[k]] + row] = codes[k]
    switched = np.zeros((len(flat), scores.shape[1]), bool)
    source = np.zeros(len(flat), np.int64)
    best = scores[flat[: running[0]]]
    finals = np.empty(len(order), np.int64)
    for t in range(1, lengths[0] + 1):
        count = running[t] if t < lengths[0] else 0
        if count < len(best):
            finals[count : len(best)] = best[count:].argmax(1)
            best = best[:count]
        if not count:
            break
        at = places[t]
        leader = best.argmax(1)
        challenge = best[np.arange(count), leader][:, None] - penalty
        jump = best < challenge
        source[at : at + count] = leader
        switched[at : at + count] = jump
        best = np.where(jump, challenge, best) + scores[flat[at : at + count]]
    path = np.empty(len(flat), np.int64)
    state = np.empty(0, np.int64)
    for t in range(lengths[0] - 1, -1, -1):
        count, at = running[t], places[t]
        state = np.concatenate([state, finals[len(state) : count]])
        path[at : at + count] = state
        if t:
            state = np.where(switched[np.arange(at, at + count), state], source[at : at + count], state)
    for row, k in enumerate(order.tolist()):
        labels[k] = path[places[: sizes[k]] + row]
    return labels


def fit(training: DataFrame) -> LanguageModel:
    """Fit on rows of (``lang``, ``text``): counts of hashed sequences, smoothed, by language.

    The rows must be a bounded sample. Only tables of ``BUCKETS`` counts per language come to the driver, as bytes.
    """

    def count(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros(BUCKETS)
        letters = np.zeros(len(SCRIPTS))
        texts = group["text"].tolist()
        for begin, end in row_batches(texts):
            found = Counter(word for text in texts[begin:end] for word in words_of(text))
            distinct, counts = list(found), np.array(list(found.values()), float)
            for first, last in row_batches(distinct, SCORED_SIZE):
                words, times = distinct[first:last], counts[first:last]
                buckets, begins = sequences_of(words)
                per_word = np.diff(np.append(begins, len(buckets)))
                sums += np.bincount(buckets, np.repeat(times, per_word), BUCKETS)
                letters += np.bincount(scripts_of(words), times * [len(w) for w in words], len(SCRIPTS))
        return pd.DataFrame({"lang": [key[0]], "sums": [sums.astype("<f4").tobytes()], "letters": [letters]})

    rows = training.groupBy("lang").applyInPandas(count, "lang string, sums binary, letters array<double>").collect()
    rows = sorted((row for row in rows if sum(row["letters"])), key=lambda row: row["lang"])
    sums = np.array([np.frombuffer(row["sums"], "<f4") for row in rows], float).reshape(len(rows), BUCKETS)
    letters = np.array([row["letters"] for row in rows]).reshape(len(rows), len(SCRIPTS))
    totals = sums.sum(1, keepdims=True)
    weights = np.log((sums + 0.5) / (totals + 0.5 * BUCKETS)).T.astype(np.float32)
    used = (letters >= SCRIPT_SHARE * letters.sum(1, keepdims=True)).T
    # A script that no language uses decides nothing: all are candidates.
    candidates = used | ~used.any(1, keepdims=True)
    return LanguageModel([row["lang"] for row in rows], weights, candidates)


def training_rows(docs: DataFrame, limit: int = TRAINING_DOCS) -> DataFrame:
    """Up to ``limit`` labelled rows of every language, those of smallest hashed id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.select("doc_id", "lang").distinct().withColumn("_place", F.row_number().over(order))
    picked = picked.where(F.col("_place") <= limit).drop("_place")
    return known.join(F.broadcast(picked), ["doc_id", "lang"]).select("lang", "text")


def predict(docs: DataFrame, model: LanguageModel, keep_text: bool = False) -> DataFrame:
    """Label every document: its columns with ``lang_pred``, ``score``, ``n_words`` and ``spans`` instead of ``text``.

    With ``keep_text`` the text stays as well, a null one as an empty one.

    ``lang_pred`` is the language that holds most letters, ties to the first by name, and ``score`` its share of the letters; spans
    are runs of words of one language (language, first word, number of words). A text that is null or has no letter is ``und``
    with score 0 and no span, and so is every text when the model knows no language. Rows are independent of each other: repeated
    rows get equal results, an empty table gives no row. Columns of these names are replaced.
    """
    names = np.array(model.languages or [UNDETERMINED], object)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for begin, end in row_batches(texts, LABELLED_SIZE):
                words = [words_of(text) if model.languages else [] for text in texts[begin:end]]
                codes, uniques = pd.factorize(np.array([w for text in words for w in text], object))
                cuts = np.cumsum([len(w) for w in words])[:-1]
                paths = viterbi(np.split(codes, cuts), model.scores(list(uniques))) if len(uniques) else [codes] * len(words)
                letters = np.split(np.array([len(w) for w in uniques], np.int64)[codes], cuts)
                rows = []
                for path, sizes in zip(paths, letters, strict=True):
                    if not len(path):
                        rows.append((UNDETERMINED, 0.0, 0, []))
                        continue
                    share = np.bincount(path, sizes, len(names))
                    top = int(share.argmax())
                    turns = np.append(0, np.nonzero(path[1:] != path[:-1])[0] + 1)
                    runs = np.diff(np.append(turns, len(path)))
                    spans = list(zip(names[path[turns]], turns.tolist(), runs.tolist(), strict=True))
                    rows.append((names[top], float(share[top] / share.sum()), len(path), spans))
                made = batch.iloc[begin:end].drop(columns=[] if keep_text else ["text"])
                for k, name in enumerate(("lang_pred", "score", "n_words", "spans")):
                    made[name] = [row[k] for row in rows]
                yield made

    added = "lang_pred string, score double, n_words int, spans array<struct<lang: string, first_word: int, n_words: int>>"
    rows = docs.drop("lang_pred", "score", "n_words", "spans").withColumn("text", F.coalesce("text", F.lit("")))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if keep_text or f.name != "text")
    return rows.mapInPandas(label, f"{kept}, {added}" if kept else added)


def held_out(identifier: str = "doc_id"):
    """Whether a document is kept from fitting: crc32 of its id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(identifier).cast("string").cast("binary")) % 4 == 2, F.lit(False))
