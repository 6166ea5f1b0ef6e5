"""Near-duplicate documents by a chosen-path set similarity join over word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.operators.skew import BROADCAST_ROWS
from treeledger.scratch import materialize

from .common import components, mix, row_batches, sliding_hash, stage, word_hashes

SHINGLE_WORDS = 5
# Links: 100 * intersection >= 75 * union.
SIMILARITY_PERCENT = 75
# Minwise tokens kept of every set, and independent trees. A tree misses a pair at the threshold in about half of the cases at
# the depths that occur, so that 16 trees miss one in 65,000.
TOKENS = 64
TREES = 16
# One-byte minwise tokens of the finer sketch, which only documents get that have a promising partner by the 64 tokens.
FINE_TOKENS = 256
# A node is compared exhaustively when it has up to this many documents, pairs to compare and shingles. Documents of
# its largest component are compared with the others only, so a group of copies with a few strangers is small.
SMALL_NODE = 32_768
SMALL_WORK = 16_000_000
SMALL_SHINGLES = 16_000_000
# Documents, pairs and shingles that one task compares, about.
DOCS_PER_TASK = 20_000
WORK_PER_TASK = 50_000_000
SHINGLES_PER_TASK = 8_000_000
# A node branches by one token, and one node in this many by a second one: 4/3 tokens on average, the inverse of the
# threshold, so that the expected number of nodes that a similar pair shares does not fall with the depth.
SECOND_TOKEN_EVERY = 3
# Pairs that agree in fewer minwise tokens are not compared: a pair at the threshold agrees in 48 of 64 on average, and in
# fewer than 30 about once in 10 million pairs; in 192 of the 256 finer ones, and in fewer than 157 as seldom.
LEAST_AGREEMENT = 30
LEAST_FINE_AGREEMENT = 157
# Rounds in which a document is judged with the one that agrees with it in most tokens, by each of the two sketches.
BEST_ROUNDS = 1
FINE_ROUNDS = 2
# Nodes of a document, the largest ones, with whose smallest id it is compared first.
PIVOTS = 4
# Levels of a tree between two confirmations of links.
LEVELS_PER_ROUND = 3
NO_ID = -(2**63)


def shingle_sets(texts: list[str], width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingles of every text as 64-bit hashes of ``width`` words; A-Z are lower-cased.

    A text of fewer words is one shingle, a text without words has none.
    """
    words = [text.encode().lower().split() for text in texts]
    counts = [len(w) for w in words]
    hashes = np.ascontiguousarray(word_hashes([w for text in words for w in text])[:, 0])
    shingles = sliding_hash(hashes, width)
    out, at = [], 0
    for count in counts:
        if count >= width:
            out.append(np.unique(shingles[at : at + count - width + 1]))
        elif count:
            out.append(sliding_hash(hashes[at : at + count], count) ^ np.uint64(count))
        else:
            out.append(np.empty(0, np.uint64))
        at += count
    return out


def signatures(sets: list[np.ndarray], tokens: int = TOKENS) -> np.ndarray:
    """The minwise tokens of every non-empty set: row by set, column by hash function, 32 bits each."""
    sizes = np.array([len(s) for s in sets])
    begins = np.cumsum(sizes) - sizes
    values = np.concatenate(sets)
    seeds = mix(np.arange(1, tokens + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    out = np.empty((len(sets), tokens), np.int32)
    for k in range(tokens):
        mixed = (values ^ seeds[k]) * (seeds[k] | np.uint64(1))
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        out[:, k] = (np.minimum.reduceat(mixed, begins) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _described(rows: DataFrame) -> DataFrame:
    """Of every document: the size of its set, a 128-bit hash of the set, and its minwise tokens (null for an empty set)."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for begin, end in row_batches(texts):
                sets = shingle_sets(texts[begin:end])
                full = [k for k, s in enumerate(sets) if len(s)]
                tokens: list = [None] * len(sets)
                if full:
                    for k, row in zip(full, signatures([sets[k] for k in full]), strict=True):
                        tokens[k] = row
                marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                yield pd.DataFrame(
                    {
                        "id": batch["id"].iloc[begin:end].array,
                        "n_shingles": [len(s) for s in sets],
                        "high": marks[:, 0],
                        "low": marks[:, 1],
                        "tokens": tokens,
                    }
                )

    return rows.mapInPandas(describe, "id long, n_shingles long, high long, low long, tokens array<int>")


def _wanted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents whose ids are wanted. While the ids are counted to be few, texts stay where they are scanned."""
    wanted = materialize(wanted, "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return rows.join(wanted, "id", "left_semi")


def _sets_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The full sets of the documents whose ids are wanted."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for begin, end in row_batches(texts):
                sets = [s.view(np.int64) for s in shingle_sets(texts[begin:end])]
                yield pd.DataFrame({"id": batch["id"].iloc[begin:end].array, "shingles": sets})

    found = _wanted(rows, wanted).mapInPandas(build, "id long, shingles array<long>")
    return found.dropDuplicates(["id"])


def _agreement(left: Column, right: Column) -> Column:
    """In how many minwise tokens two signatures agree."""
    same = [F.when(left[k] == right[k], 1).otherwise(0) for k in range(TOKENS)]
    return reduce(lambda x, y: x + y, same)


def _promising(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) whose sizes and minwise tokens allow the similarity, with ``agreement``."""
    left = known.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("tokens").alias("ta"))
    right = known.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.distinct().join(left, "a").join(right, "b")
    both = both.where(100 * F.least("na", "nb") >= SIMILARITY_PERCENT * F.greatest("na", "nb"))
    both = both.select("a", "b", _agreement(F.col("ta"), F.col("tb")).alias("agreement"))
    return both.where(F.col("agreement") >= LEAST_AGREEMENT)


def _confirmed(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs that are links, judged on full sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = stage(_sets_of(rows, wanted), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    judged = pairs.select("a", "b").join(left, "a").join(right, "b")
    judged = judged.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb") - common).alias("either"))
    return judged.where(100 * F.col("common") >= SIMILARITY_PERCENT * F.col("either")).select("a", "b")


def _fine_sketches(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The finer sketch of the documents whose ids are wanted: the low bytes of ``FINE_TOKENS`` minwise tokens."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for begin, end in row_batches(texts):
                sets = shingle_sets(texts[begin:end])
                full = [k for k, s in enumerate(sets) if len(s)]
                if full:
                    tokens = signatures([sets[k] for k in full], FINE_TOKENS).astype(np.uint8)
                    ids = batch["id"].iloc[begin:end].iloc[full].array
                    yield pd.DataFrame({"id": ids, "sketch": [row.tobytes() for row in tokens]})

    found = _wanted(rows, wanted).mapInPandas(build, "id long, sketch binary")
    return found.dropDuplicates(["id"])


def _nodes_in(group: pd.DataFrame) -> Iterator[tuple[int, int]]:
    """Where each node begins and ends in rows sorted by node."""
    nodes = group["node"].to_numpy()
    cuts = np.append(np.nonzero(np.append(True, nodes[1:] != nodes[:-1]))[0], len(nodes)).tolist()
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def _dealt(nodes: DataFrame) -> DataFrame:
    """Rows of small nodes with the ``task`` that compares the node."""
    sums = nodes.agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.expr("work / size")).alias("work"), F.sum("n_shingles").alias("shingles")
    ).first()
    work, shingles = int((sums["work"] or 0) // WORK_PER_TASK), int((sums["shingles"] or 0) // SHINGLES_PER_TASK)
    tasks = sums["docs"] // DOCS_PER_TASK + work + shingles + 1
    return nodes.withColumn("task", F.pmod("node", F.lit(tasks)))


def _best_partners(small: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """Of small nodes the documents with a promising partner in another component (``node``, ``id``), and the ``partner`` of most
    ``agreement``. Every two documents of different components are compared by the sketches of ``known``, and a node gives at most
    its documents. A document without such a partner has nothing more to look for in that node.
    """

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["node", "id"], kind="stable")
        sketches = group["sketch"]
        tokens = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(group), -1) if isinstance(sketches.iloc[0], bytes) else np.stack(sketches)
        ids, parts, sizes, nodes = (group[c].to_numpy() for c in ("id", "part", "n_shingles", "node"))
        score, partner = np.zeros(len(group), np.int32), np.zeros(len(group), np.int64)
        for begin, end in _nodes_in(group):
            _, part, each = np.unique(parts[begin:end], return_inverse=True, return_counts=True)
            others = begin + np.nonzero(part != each.argmax())[0]
            every = np.ascontiguousarray(tokens[begin:end].T)
            for k in range(0, len(others), 256):
                some = others[k : k + 256]
                agreement = np.zeros((len(some), end - begin), np.uint16)
                for own, row in zip(tokens[some].T, every, strict=True):
                    agreement += own[:, None] == row[None, :]
                small_size, large_size = (pick(sizes[some, None], sizes[None, begin:end]) for pick in (np.minimum, np.maximum))
                near = (agreement >= least) & (100 * small_size >= SIMILARITY_PERCENT * large_size)
                near &= parts[some, None] != parts[None, begin:end]
                agreement[~near] = 0
                # Both documents of a pair: those of the largest component are rows nowhere.
                for rows, top, first in (
                    (some, agreement.max(1), begin + agreement.argmax(1)),
                    (np.arange(begin, end), agreement.max(0), some[agreement.argmax(0)]),
                ):
                    better = top > score[rows]
                    score[rows[better]], partner[rows[better]] = top[better], ids[first[better]]
        found = score > 0
        return pd.DataFrame({"node": nodes[found], "id": ids[found], "partner": partner[found], "agreement": score[found]})

    dealt = _dealt(small).join(known, "id")
    return dealt.groupBy("task").applyInPandas(compare, "node long, id long, partner long, agreement int")


def _linked_inside(small: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) between components of small nodes, found on full sets: a spanning forest of each node's links.

    Intersections are counted through the lists of documents that hold a shingle, so every two documents of different
    components are judged; a node gives fewer links than it has documents.
    """

    def judge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["node", "id"], kind="stable")
        ids, parts, shingles = group["id"].to_numpy(), group["part"].to_numpy(), group["shingles"].tolist()
        found: list[tuple[int, int]] = []
        for begin, end in _nodes_in(group):
            sets_here = shingles[begin:end]
            sizes = np.array([len(s) for s in sets_here])
            flat, owner = np.concatenate(sets_here), np.repeat(np.arange(end - begin), sizes)
            order = np.argsort(flat, kind="stable")
            owner, (_, starts, place) = owner[order], np.unique(flat[order], return_index=True, return_inverse=True)
            which = np.empty(len(flat), np.int64)
            which[order] = place
            counts = np.diff(np.append(starts, len(flat)))
            begins = np.cumsum(sizes) - sizes
            # Components inside the node, by the place of a member.
            _, root, each = np.unique(parts[begin:end], return_inverse=True, return_counts=True)
            for doc in np.nonzero(root != each.argmax())[0]:
                own = which[begins[doc] : begins[doc] + sizes[doc]]
                first, number = starts[own], counts[own]
                ends = np.cumsum(number)
                lists = owner[np.arange(ends[-1]) + np.repeat(first - (ends - number), number)]
                common = np.bincount(lists, minlength=end - begin)
                similar = (100 * common >= SIMILARITY_PERCENT * (sizes + sizes[doc] - common)) & (root != root[doc])
                for other in np.nonzero(similar)[0]:
                    if root[other] != root[doc]:
                        root[root == root[other]] = root[doc]
                        found.append((min(ids[begin + doc], ids[begin + other]), max(ids[begin + doc], ids[begin + other])))
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    dealt = _dealt(small).select("task", "node", "id", "part").join(sets, "id")
    return dealt.groupBy("task").applyInPandas(judge, "a long, b long")


def _with_parts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The documents of nodes (``node``, ``id``, ``n_shingles``) with their component so far, where a node has several."""
    parts = components(links, "parts").select(F.col("node").alias("id"), F.col("root"))
    parted = nodes.select("node", "id", "n_shingles").join(parts, "id", "left")
    return _open(parted.select("node", "id", "n_shingles", F.coalesce("root", "id").alias("part")))


def _open(parted: DataFrame) -> DataFrame:
    """The nodes of several components, with ``size``, ``pivot`` (the smallest id), ``work`` (the pairs to compare), ``shingles``, and
    ``mark``, which nodes of the same documents have in common."""
    parted = materialize(parted, "parted")
    per_part = parted.groupBy("node", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.sum("n_shingles").alias("shingles"), F.bit_xor(F.xxhash64("id")).alias("mark")
    )
    facts = per_part.groupBy("node").agg(
        F.sum("n").alias("size"),
        F.min("least").alias("pivot"),
        F.max("n").alias("largest"),
        F.count(F.lit(1)).alias("parts"),
        F.sum("shingles").alias("shingles"),
        F.bit_xor("mark").alias("mark"),
    )
    work = (F.col("size") * (F.col("size") - F.col("largest"))).alias("work")
    facts = facts.where("parts > 1").select("node", "size", "pivot", work, "shingles", "mark")
    return materialize(parted.join(facts, "node"), "open-nodes")


def _once(nodes: DataFrame) -> DataFrame:
    """Of small nodes with the same documents, as trees often have them, one: the others would compare the same pairs."""
    marks = nodes.where("id = pivot").groupBy("size", "pivot", "mark").agg(F.min("node").alias("node")).select("node")
    return nodes.join(marks, "node", "left_semi")


def _is_small() -> Column:
    return (F.col("size") <= SMALL_NODE) & (F.col("work") <= SMALL_WORK) & (F.col("shingles") <= SMALL_SHINGLES)


def _one_each(pairs: DataFrame) -> DataFrame:
    """Of every document (``b``) the pair of most ``agreement``, each pair once."""
    best = pairs.groupBy("b").agg(F.max_by(F.col("a"), F.struct("agreement", "a")).alias("a"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_links(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Links between documents with different sets, enough of them to connect whatever similar pairs connect.

    Every tree sends all documents to nodes by one minwise token. A document is first compared with the smallest ids of its
    largest nodes. After that a node is finished once its documents are in one component, however many they are: comparing
    them further could not change the result. Small nodes are compared exhaustively across components, in three steps of
    rising cost, each of which keeps the documents with a promising partner in another component only: by minwise tokens, by
    the finer sketch, and on full sets. The first two judge one pair for each document; the last returns links only. Larger nodes
    are compared with their smallest id and branch again by chosen tokens until they are small. So no step puts out
    more rows than there are documents in nodes.
    """
    tokens = F.posexplode(F.slice("tokens", 1, TREES)).alias("tree", "token")
    first = known.select("id", "n_shingles", tokens).select(F.xxhash64("tree", "token").alias("node"), "id", "n_shingles")
    shared = first.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("pivot")).where("size > 1")
    members = stage(first.join(shared, "node").select("node", "id", "n_shingles", "size", "pivot"), "nodes")
    largest = members.where("id <> pivot").groupBy("id").agg(F.collect_set(F.struct((-F.col("size")).alias("order"), "pivot")).alias("nodes"))
    largest = largest.select("id", F.explode(F.slice(F.array_sort("nodes"), 1, PIVOTS)).alias("n"))
    near = _promising(largest.select(F.col("n.pivot").alias("a"), F.col("id").alias("b")), known)
    links = stage(_confirmed(materialize(_one_each(near), "best-pivots"), rows), "links")

    coarse = known.select("id", F.col("tokens").alias("sketch"))
    state = members
    while True:
        state = _with_parts(state, links)
        parts: list[DataFrame] = []
        small_nodes: list[DataFrame] = []
        for level in range(1, LEVELS_PER_ROUND + 1):
            small_nodes.append(state.where(_is_small()))
            state = state.where(~_is_small())
            if state.isEmpty():
                break
            lead = state.where("id = pivot").select("node", F.col("part").alias("pivot_part")).distinct()
            led = state.join(lead, "node").where("part <> pivot_part AND id <> pivot")
            parts.append(led.groupBy("id").agg(F.max_by("pivot", "size").alias("a")).select("a", F.col("id").alias("b")))
            state = _open(materialize(_branched(state, known), "nodes"))
        nodes = reduce(DataFrame.unionByName, small_nodes)
        if parts:
            near = _promising(reduce(DataFrame.union, parts).distinct(), known)
            links = _more(links, materialize(_one_each(near), "pivot-pairs"), rows)
            nodes = _with_parts(nodes, links)
        links = _compared(materialize(_once(nodes), "small-nodes"), links, rows, coarse)
        if state.isEmpty():
            return links


def _more(links: DataFrame, pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The links and those among the pairs."""
    if pairs.isEmpty():
        return links
    return stage(links.union(_confirmed(pairs, rows)).distinct(), "links")


def _compared(nodes: DataFrame, links: DataFrame, rows: DataFrame, coarse: DataFrame) -> DataFrame:
    """The links, and those between components of small nodes."""
    for number in range(BEST_ROUNDS + FINE_ROUNDS):
        if nodes.isEmpty():
            return links
        if number < BEST_ROUNDS:
            sketches, least = coarse, LEAST_AGREEMENT
        else:
            if number == BEST_ROUNDS:
                fine = stage(_fine_sketches(rows, nodes.select("id").distinct()), "sketches")
            sketches, least = fine, LEAST_FINE_AGREEMENT
        found = materialize(_best_partners(nodes, sketches, least), "partners")
        pairs = materialize(_one_each(found.select(F.col("partner").alias("a"), F.col("id").alias("b"), "agreement")), "pairs")
        links = _more(links, pairs, rows)
        nodes = _with_parts(nodes.join(found.select("node", "id"), ["node", "id"], "left_semi"), links)
    if nodes.isEmpty():
        return links
    sets = stage(_sets_of(rows, nodes.select("id").distinct()), "sets")
    return stage(links.union(_linked_inside(nodes, sets)).distinct(), "links")


def _branched(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """The documents of nodes sent to child nodes by one token that the node chooses, or by two."""

    def choice(k: int) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(k)), F.lit(TOKENS)).cast("int")

    second = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(SECOND_TOKEN_EVERY)) == 0
    chosen = F.when(second, F.array(choice(0), choice(1))).otherwise(F.array(choice(0)))
    sent = nodes.withColumn("choice", F.explode(chosen)).join(known.select("id", "tokens"), "id")
    child = F.xxhash64("node", "choice", F.col("tokens")[F.col("choice")])
    return sent.select(child.alias("node"), "id", "n_shingles", "part").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Components of documents whose shingle sets are similar: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    ``component_id`` is the smallest id that links lead to, the document's own included; ``kept`` marks that document. Documents
    with equal sets are one class from the start and take part once. A null or blank text has an empty set, is linked with
    nothing and is kept. Ids are whole numbers and name documents: rows that repeat an id are taken for repetitions of one
    document and all get its result; a null id counts as an id before all others. An empty table gives no row; other columns
    are not read.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    described = stage(_described(rows), "described")
    full = described.where("n_shingles > 0")
    classes = full.groupBy("high", "low").agg(F.min("id").alias("class"))
    # Equal sets have equal tokens, so any document of a class can give them.
    firsts = full.groupBy("high", "low").agg(
        F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens")
    )
    known = stage(firsts.select("id", "n_shingles", "tokens"), "known")
    links = similar_links(rows, known)
    roots = components(links, "components").select(F.col("node").alias("class"), "root")
    classes = classes.join(roots, "class", "left").select("high", "low", F.coalesce("root", "class").alias("part"))
    joined = described.select("id", "n_shingles", "high", "low").join(classes, ["high", "low"], "left")
    part = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("part")), F.col("id"))
    named = joined.select("id", "n_shingles", part.alias("part"))
    return named.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "n_shingles",
        F.when(F.col("part") != NO_ID, F.col("part")).alias("component_id"),
        (F.col("id") == F.col("part")).alias("kept"),
    )
