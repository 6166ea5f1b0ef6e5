"""Best-fit packing: token sequences of a fixed size filled with whole documents by fitted length patterns."""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_batches, stage

CAPACITY = 1024
END_OF_TEXT = 2
# Fixed value: the pattern by which byte-level vocabularies of this family cut a text before merging.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# From this length on a run of white space is left to the slower encoder.
LONG_SPACE = 50_000
_SPACES = re.compile(r"\s{64,}")
# Parts of the fitted repeat counts that are tried; the plan with the fewest sequences is taken.
FITTED_SHARES = (1.0, 0.9, 0.6, 0.3, 0.0)
# Rows that one task numbers at once.
ROWS_PER_CHUNK = 200_000

# Groups of equal sequences: the lengths in one, and how many there are.
Plan = list[tuple[tuple[int, ...], int]]


@functools.lru_cache(maxsize=2)
def load_tokenizer(path: str):
    """The encoder of a byte-level vocabulary file, one per worker, which knows the added tokens of the file."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    names: dict[str, int] = stored["model"]["vocab"]
    added = {token["content"]: token["id"] for token in stored["added_tokens"]}
    if any(token[rule] for token in stored["added_tokens"] for rule in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} has added tokens with rules on the text around them")
    # The file names bytes by characters: printable ones by themselves, the others from U+0100 on. Ids are merge ranks.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    ranks = {bytes(byte_of[c] for c in name): number for name, number in names.items()}
    return tiktoken.Encoding("byte_bpe", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens=added)


@functools.lru_cache(maxsize=4)
def load_reference(path: str, added_tokens: bool):
    """The same encoder as its own library builds it: slower, with no limit on runs of white space."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added_tokens
    return tokenizer


def encode_plain(tokenizer, path: str, text: str, added_tokens: bool = False) -> list[int]:
    """The ids of a text. A text with a very long run of white space, which the fast encoder's pattern cannot take, goes to the slow one."""
    if len(text) >= LONG_SPACE and any(run.end() - run.start() >= LONG_SPACE for run in _SPACES.finditer(text)):
        return load_reference(path, added_tokens).encode(text, add_special_tokens=False).ids
    return tokenizer.encode(text, allowed_special="all") if added_tokens else tokenizer.encode_ordinary(text)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, added_tokens: bool = False) -> DataFrame:
    """Every document as pieces of at most ``capacity`` tokens: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    A document is its token ids and a closing id. Only one longer than ``capacity`` is cut: into full pieces, after a first
    piece that holds the remainder. A null text is an empty one and gives the closing id alone. With ``added_tokens`` the names
    of the vocabulary's added tokens in a text get their ids, as ``tokenizers`` gives them; without it they are ordinary text.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load_tokenizer(vocabulary)
        for batch in batches:
            texts = batch["text"].tolist()
            ids = batch["doc_id"]
            for begin, end in row_batches(texts):
                rows: list[tuple[int, int, int, int, int]] = []
                for k in range(begin, end):
                    data = array("I", encode_plain(tokenizer, vocabulary, texts[k], added_tokens) + [END_OF_TEXT]).tobytes()
                    total = len(data) // 4
                    at, size = 0, total % capacity or min(total, capacity)
                    number = 0
                    while at < total:
                        rows.append((k, number, at, size, zlib.crc32(data[4 * at : 4 * (at + size)])))
                        at, size, number = at + size, capacity, number + 1
                made = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                made["doc_id"] = ids.iloc[made["doc_id"]].array
                yield made

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def length_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns of one to three of the given lengths, one row each, lengths in falling order, filled up with zeros.

    All pairs and triples that fill a sequence exactly, every length with the longest that fits beside it, and every length
    alone.
    """
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    single = np.stack([lengths, np.zeros_like(lengths), np.zeros_like(lengths)], 1)
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    a, b = a.ravel(), b.ravel()
    rest = capacity - a - b
    pair = (rest == 0) & (a >= b)
    triple = (rest > 0) & (a >= b) & (b >= rest)
    triple[triple] = present[rest[triple]]
    beside = np.searchsorted(lengths, capacity - lengths, "right") - 1
    close = np.stack([lengths, np.where(beside >= 0, lengths[beside], 0), np.zeros_like(lengths)], 1)
    close = close[(close[:, 1] > 0) & (close[:, 0] >= close[:, 1]) & (close.sum(1) < capacity)]
    return np.concatenate(
        [
            single,
            close,
            np.stack([a[pair], b[pair], np.zeros(pair.sum(), int)], 1),
            np.stack([a[triple], b[triple], rest[triple]], 1),
        ]
    )


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts whose patterns come closest, in least squares, to the histogram of lengths.

    Accelerated projected gradient steps on the squared error; the matrix is never built, as a pattern has three entries.
    Lengths alone carry a small price, so that they are used only where no full pattern fits.
    """
    size = len(histogram)

    def spread(x: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for k in range(patterns.shape[1]):
            out += np.bincount(patterns[:, k], x, size)
        out[0] = 0
        return out

    def gather(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[patterns].sum(1)

    # The largest eigenvalue is found by a few power steps.
    v = np.ones(len(patterns))
    top = 1.0
    for _ in range(30):
        v = gather(spread(v))
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    price = np.where(patterns[:, 1] == 0, 0.01 * max(1.0, histogram.max()), 0.0)
    x = np.zeros(len(patterns))
    y, t = x, 1.0
    for _ in range(rounds):
        step = np.maximum(0, y + (gather(histogram - spread(y)) - price) / (1.05 * top))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = step + (t - 1) / t_next * (step - x)
        x, t = step, t_next
    return x


def plan_sequences(histogram: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Groups of equal sequences that use up a histogram of lengths: (lengths in a sequence, number of such sequences).

    ``histogram[l]`` counts the pieces of length l. The size of the plan depends on ``capacity`` alone. Full-length pieces
    stand alone; repeat counts of the patterns are fitted to the other lengths and rounded to what is there; the lengths
    left over go, longest first, to the fullest sequence that still has room.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    full: Plan = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    lengths = np.nonzero(left)[0]
    if not len(lengths):
        return full
    patterns = length_patterns(lengths, capacity)
    fitted = fit_counts(patterns, left.astype(float))
    # Patterns can use up the short lengths that only long ones would have had room beside; so fewer of them are tried too.
    plans = []
    for share in FITTED_SHARES:
        plan, rest = _repeat(patterns, share * fitted, left)
        plans.append(plan + _best_fit(rest, capacity))
    return full + min(plans, key=lambda plan: sum(count for _, count in plan))


def _repeat(patterns: np.ndarray, wanted: np.ndarray, histogram: np.ndarray) -> tuple[Plan, np.ndarray]:
    """Patterns of several lengths, most frequent first, as often as rounding and what is left allow; and what is left."""
    left = histogram.copy()
    plan: Plan = []
    for k in np.argsort(-wanted, kind="stable"):
        if wanted[k] < 0.5:
            break
        used = patterns[k][patterns[k] > 0]
        if len(used) == 1:
            continue
        kinds, each = np.unique(used, return_counts=True)
        count = int(min(round(wanted[k]), (left[kinds] // each).min()))
        if count > 0:
            left[kinds] -= count * each
            plan.append((tuple(int(x) for x in used), count))
    return plan, left


def _best_fit(left: np.ndarray, capacity: int) -> Plan:
    """Lengths, longest first, each put into the fullest sequence with room; equal sequences are kept as one group."""
    room: list[list[list]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        count = int(left[length])
        space = length
        while count:
            while space <= capacity and not room[space]:
                space += 1
            if space > capacity:
                per = capacity // length
                whole, rest = divmod(count, per)
                if whole:
                    room[capacity - per * length].append([(length,) * per, whole])
                if rest:
                    room[capacity - rest * length].append([(length,) * rest, 1])
                break
            group = room[space][-1]
            fit = min(space // length, count)
            taken = min(group[1], count // fit)
            group[1] -= taken
            if not group[1]:
                room[space].pop()
            room[space - fit * length].append([group[0] + (length,) * fit, taken])
            count -= taken * fit
    return [(tuple(content), count) for groups in room for content, count in groups]


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, added_tokens: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as the plan finds.

    Adds ``sequence_id`` and ``offset`` to the rows of ``pieces``: offsets within a sequence leave no gap. Every row is a
    document of its own: repeated rows are packed repeatedly, a null id stays null, an empty table gives no row, other
    columns are not read. Only the histogram of lengths, at most ``capacity`` rows, comes to the driver, and only the plan,
    whose size depends on ``capacity`` alone, goes back. ``added_tokens`` is that of ``pieces``.
    """
    cut = stage(pieces(docs, vocabulary, capacity, added_tokens), "pieces")
    found = cut.groupBy("length").count().collect()
    histogram = np.zeros(capacity + 1, np.int64)
    for row in found:
        histogram[row["length"]] = row["count"]
    keys, starts, bases, offsets = _slots(plan_sequences(histogram, capacity), capacity)

    # A piece's rank among those of its length: its rank in its own chunk after those of the chunks before.
    chunks = int(histogram.sum()) // ROWS_PER_CHUNK + 1
    dealt = cut.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)))
    sizes = dealt.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("_rank", F.row_number().over(inside) - 1).join(sizes, ["length", "_chunk"])
    ranked = ranked.select(*cut.columns, (F.col("_rank") + F.col("_before")).cast("long").alias("_rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch.pop("_rank").to_numpy()
            length = batch["length"].to_numpy()
            slot = np.empty(len(batch), np.int64)
            for value in np.unique(length):
                here = length == value
                low, high = keys[value], keys[value + 1]
                slot[here] = low + np.searchsorted(starts[low:high], rank[here], "right") - 1
            batch["sequence_id"] = bases[slot] + rank - starts[slot]
            batch["offset"] = offsets[slot]
            yield batch

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInPandas(place, f"{kinds}, sequence_id long, offset long")


def _slots(plan: Plan, capacity: int) -> tuple[np.ndarray, ...]:
    """The plan by length: where a length's slots begin, and each slot's first rank, first sequence and offset."""
    slots: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    used = [0] * (capacity + 1)
    base = 0
    for content, count in plan:
        at = 0
        for length in content:
            slots[length].append((used[length], base, at))
            used[length] += count
            at += length
        base += count
    flat = np.array([s for group in slots for s in group], np.int64).reshape(-1, 3)
    keys = np.concatenate([[0], np.cumsum([len(group) for group in slots])])
    return keys, flat[:, 0], flat[:, 1], flat[:, 2]
