"""Commit history: reachability over parent links, and finding commits by branch name or short hash."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .skew import HOT_FLOOR, hot_keys, spread_join


# Joins of rows of a few numbers look for hot keys only beyond so many rows: up to there one task can take them all.
PLAIN_ROWS = 2_000_000
# Forests of more commits are made smaller before every commit follows its own links.
PLAIN_NODES = 200_000
# Below every position.
NOT_REACHED = -(2**62)


@dataclass(frozen=True)
class History:
    """Commits on chains of first parents, as stored tables.

    ``nodes(hash, node, chain, position, bottom, c, e)``: every commit is on one chain, whose commits are each other's first parents. Along a
    chain ``position`` rises by one from parent to child and ends at 0, so all ancestors of a commit on its own chain are those
    of lower position. ``links(chain, position, parent_chain, parent_position)``: the links that leave a chain, which are those
    of the chain's first commit and of merges. ``ups(chain, bottom, c, e, s)``: where the first parent of a chain's lowest commit,
    at ``bottom``, is: on chain ``c`` at position ``e``, ``s`` = 1 step away. Chains that end at a root are not in it. ``nodes`` says
    the same of every commit's chain.
    """

    nodes: DataFrame
    links: DataFrame
    ups: DataFrame

    @cached_property
    def lifts(self) -> tuple[DataFrame, ...]:
        """For the k-th power of 4, the chains once, twice and three times so many chains below: ``chain, bottom, c1, e1, s1, …, s3``.

        ``s`` counts the steps from the chain's lowest commit to the one at position ``e`` of that chain. Only chains that others end
        on are in it: the first chain below its own every commit knows.
        """
        ended_on = self.ups.select(F.col("c").alias("chain")).distinct()
        step, lifts = materialize(self.ups.join(ended_on, "chain", "left_semi"), "ups"), []
        while not step.isEmpty():
            most = _largest_key(step.count())
            wide = step.withColumnsRenamed({"c": "c1", "e": "e1", "s": "s1"})
            onward = step.withColumnsRenamed({"chain": "at", "bottom": "floor"})
            for k in (2, 3, 4):
                # A chain already beyond its root looks for a key of its own, so that such rows do not meet in one task.
                keyed = wide.withColumn("at", F.coalesce(f"c{k - 1}", -1 - F.col("chain")))
                joined = spread_join(keyed, onward, ["at"], ["chain"], "left", most=most)
                steps = F.col(f"s{k - 1}") + F.col(f"e{k - 1}") - F.col("floor") + F.col("s")
                wide = joined.withColumn("s", steps).withColumnsRenamed({n: f"{n}{k}" for n in "ces"}).drop("at", "floor")
            wide = materialize(wide, "lift")
            lifts.append(wide.drop("c4", "e4", "s4"))
            step = wide.where("c4 IS NOT NULL").select("chain", "bottom", *[F.col(f"{n}4").alias(n) for n in "ces"])
        return tuple(lifts)

    @cached_property
    def jumps(self) -> tuple[DataFrame, ...]:
        """For the k-th power of 4, the ancestors once, twice and three times so many first-parent steps away, until no history is
        that long: ``node, ahead1, ahead2, ahead3``, made as they are read.
        """
        longest = self.nodes.agg(F.max(-F.col("position"))).first()[0] or 0
        jumps = []
        while 4 ** len(jumps) <= longest:
            strides = F.explode(F.array(*[F.lit(k * 4 ** len(jumps)).cast("bigint") for k in (1, 2, 3)]))
            asked = self.nodes.drop("hash").withColumn("steps", strides)
            places = climb(self, asked.withColumn("left", F.col("steps")), ["node", "steps"]).drop("chain", "position")
            ends = self.nodes.select(F.col("node").alias("ahead"), F.col("chain").alias("to_chain"), F.col("position").alias("to_position"))
            found = places.join(ends, ["to_chain", "to_position"]).groupBy("node")
            each = [F.max(F.when(F.col("steps") == k * 4 ** len(jumps), F.col("ahead"))).alias(f"ahead{k}") for k in (1, 2, 3)]
            jumps.append(found.agg(*each))
        return tuple(jumps)


def _largest_key(rows: int) -> int:
    """A bound on the rows of one key, or 0 where a join of so many short rows needs none."""
    return rows if rows > PLAIN_ROWS else 0


def index_history(commit_parents: DataFrame) -> History:
    """Prepare a commit graph for any number of ``reachable``, ``ancestors`` and ``merge_bases`` calls.

    First parents make a forest. A commit is on the chain of the commit furthest above it (``_furthest_above``), so long lines are not
    broken where others fork off.
    """
    hashes = commit_parents.select(F.col("child").alias("hash")).union(commit_parents.select("parent")).distinct()
    nodes = materialize(hashes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    hot = hot_keys(commit_parents, ["parent"])
    children = commit_parents.join(nodes.withColumnRenamed("hash", "child"), "child").drop("child")
    parents = nodes.select(F.col("hash").alias("parent"), F.col("node").alias("parent_node"))
    order = F.col("ordinal") if "ordinal" in commit_parents.columns else F.col("parent_node")
    both = spread_join(children, parents, ["parent"], ["node"], hot=hot)
    links = materialize(both.select("node", F.col("parent_node").alias("parent"), order.alias("ordinal")), "links")

    first = links.where("ordinal IS NOT NULL").groupBy("node").agg(F.min_by("parent", F.struct("ordinal", "parent")).alias("first"))
    start = materialize(nodes.select("node").join(first, "node", "left"), "first-parents")
    chains = _furthest_above(start).select("node", F.col("last").alias("chain"), (-F.col("above")).alias("position"))
    own = materialize(start.join(chains, "node"), "own-chains")

    ends = own.select(F.col("node").alias("parent"), F.col("chain").alias("parent_chain"), F.col("position").alias("parent_position"))
    placed = spread_join(links.join(own, "node"), ends, ["parent"], ["node"], hot=hot_keys(links, ["parent"]))
    leaving = placed.where("chain <> parent_chain").withColumn("first", F.col("parent").eqNullSafe(F.col("first")))
    leaving = materialize(leaving.select("chain", "position", "parent_chain", "parent_position", "first"), "chain-links")
    up = [F.col("parent_chain").alias("c"), F.col("parent_position").alias("e"), F.lit(1).cast("bigint").alias("s")]
    ups = materialize(leaving.where("first").select("chain", F.col("position").alias("bottom"), *up).distinct(), "ups")
    told = spread_join(own.drop("first"), ups.drop("s"), ["chain"], ["node"], "left")
    return History(materialize(nodes.join(told, "node"), "nodes"), leaving.drop("first"), ups)


def _furthest_above(start: DataFrame) -> DataFrame:
    """The furthest commit above every commit of a forest ``node, first`` and the steps to it: ``node, above, last``.

    Of commits equally far the one of the highest number counts. A forest of more than ``PLAIN_NODES`` commits is made smaller first.
    In a round the commits that nothing is above are done and tell their parents; and of the others with a single child, those whose
    number, hashed, is above those of child and parent are taken out, their child going to their parent. That leaves about two
    thirds of any long line, so all rounds together shuffle a few times the commits, however long the history. What was taken out is
    answered by its child, in the reverse order.
    """
    one = F.lit(1).cast("bigint")
    below = start.where("first IS NOT NULL").groupBy(F.col("first").alias("node")).agg(
        F.count(F.lit(1)).alias("kids"), F.bit_xor("node").alias("kid"), F.bit_xor(one).alias("kid_steps")
    )
    # kid and kid_steps: the children's numbers and steps, put together by XOR, which are those of the child where there is one
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("kids", "kid", "kid_steps")]
    own = [F.lit(0).cast("bigint").alias("above"), F.col("node").alias("last")]
    forest = start.join(below, "node", "left").select("node", F.col("first").alias("parent"), one.alias("steps"), *own, *counts)
    forest = materialize(forest, "forest")
    out: list[tuple[DataFrame, DataFrame]] = []
    while forest.count() > PLAIN_NODES:
        smaller = materialize(_contracted(forest, len(out)), "forest")
        taken = forest.where(_taken(len(out))).select(
            F.col("node").alias("taken"), F.col("kid").alias("node"), "kid_steps", F.struct("above", "last").alias("own")
        )
        out.append((smaller.where("done").select("node", "above", "last"), taken))
        forest = smaller.where("NOT done").drop("done")
    known = _doubled(forest)
    for done, taken in reversed(out):
        through = taken.join(known, "node").select(
            F.col("taken").alias("node"), F.greatest("own", F.struct((F.col("above") + F.col("kid_steps")).alias("above"), "last")).alias("f")
        )
        known = known.unionByName(done).unionByName(materialize(through.select("node", "f.above", "f.last"), "answered"))
    return known


def _taken(turn: int) -> Column:
    """Whether a commit is taken out in a round: no two of them are parent and child."""

    def lot(name: str) -> Column:
        return F.xxhash64(F.col(name), F.lit(turn))

    higher = (lot("node") > lot("kid")) & (F.col("parent").isNull() | (lot("node") > lot("parent")))
    return (F.col("kids") == 1) & higher


def _contracted(forest: DataFrame, turn: int) -> DataFrame:
    """One round: the forest without the commits taken out, those with nothing above them marked ``done``."""
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")

    def row(key: str, here: bool = False, **values: Column) -> Column:
        plain = {"parent": none, "to": none, "steps": zero, "above": none, "last": none, "kids": zero, "kid": zero, "kid_steps": zero}
        named = [value.cast("bigint").alias(name) for name, value in (plain | values).items()]
        return F.struct(F.col(key).alias("node"), F.lit(here).alias("here"), F.lit("to" in values).alias("moved"), *named)

    taken, top = _taken(turn), F.col("kids") == 0
    rooted, further = F.col("parent").isNotNull(), F.col("above") + F.col("steps")
    itself = row("node", True, **{c: F.col(c) for c in ("parent", "steps", "above", "last", "kids", "kid", "kid_steps")})
    ended = row("parent", above=further, last=F.col("last"), kids=F.lit(-1), kid=F.col("node"), kid_steps=F.col("steps"))
    to_child = row("kid", to=F.col("parent"), steps=F.col("steps"))
    to_parent = row(
        "parent",
        above=further,
        last=F.col("last"),
        kid=F.col("node").bitwiseXOR(F.col("kid")),
        kid_steps=F.col("steps").bitwiseXOR(F.col("steps") + F.col("kid_steps")),
    )
    said = F.when(taken & rooted, F.array(to_child, to_parent)).when(taken, F.array(to_child))
    said = said.when(top & rooted, F.array(itself, ended)).otherwise(F.array(itself))
    # Nothing is combined before the shuffle: few rows have one key, and all would be sorted for it.
    rows = forest.select(F.inline(said)).repartition("node").groupBy("node")
    met = rows.agg(
        F.bool_or("here").alias("here"),
        F.bool_or("moved").alias("moved"),
        F.max("parent").alias("parent"),
        F.max("to").alias("to"),
        F.sum("steps").alias("steps"),
        F.max(F.when(F.col("above").isNotNull(), F.struct("above", "last"))).alias("f"),
        F.max(F.when(F.col("here"), F.col("kids"))).alias("had"),
        F.sum("kids").alias("kids"),
        F.bit_xor("kid").alias("kid"),
        F.bit_xor("kid_steps").alias("kid_steps"),
    )
    # A commit with nothing above it whose parent was taken out in the same round stays: its word did not arrive.
    left = met.where("here").withColumn("parent", F.when(F.col("moved"), F.col("to")).otherwise(F.col("parent")))
    done = ((F.col("had") == 0) & ~F.col("moved")).alias("done")
    return left.select("node", "parent", "steps", "f.above", "f.last", "kids", "kid", "kid_steps", done)


def _doubled(forest: DataFrame) -> DataFrame:
    """The furthest commit above every commit of a forest, in rounds: after k of them a commit knows its ancestor 4**k links away and
    the furthest commit that is less than 4**k links above it.
    """
    step = materialize(forest.select("node", F.col("parent").alias("ahead"), "steps", "above", "last"), "jump")
    most = _largest_key(step.count())
    while not step.where("ahead IS NOT NULL").isEmpty():
        wide = step.where("ahead IS NOT NULL").withColumnsRenamed({"ahead": "ahead1", "steps": "steps1"})
        for k in (2, 3, 4):
            # A row already beyond its root looks for a key of its own, so that such rows do not meet in one task.
            key = F.coalesce(f"ahead{k - 1}", -1 - F.col("node"))
            onward = step.select(F.col("node").alias("at"), F.col("ahead").alias(f"ahead{k}"), F.col("steps").alias("more"))
            wide = spread_join(wide.withColumn("at", key), onward, ["at"], ["node"], "left", most=most).drop("at")
            wide = wide.withColumn(f"steps{k}", F.col(f"steps{k - 1}") + F.col("more")).drop("more")
        wide = materialize(wide, "jump")
        passed = [
            F.struct(F.col(f"ahead{k}").alias("node"), F.struct((F.col("above") + F.col(f"steps{k}")).alias("above"), "last").alias("found"))
            for k in (1, 2, 3)
        ]
        passed = wide.select(F.explode(F.array(*passed)).alias("p")).where("p.node IS NOT NULL")
        gained = passed.groupBy("p.node").agg(F.max("p.found").alias("gained"))
        furthest = F.greatest(F.struct("above", "last"), F.col("gained"))
        onward = wide.select("node", F.col("ahead4").alias("further"), F.col("steps4").alias("steps"))
        joined = step.drop("steps").join(onward, "node", "left").join(gained, "node", "left")
        joined = joined.select("node", "further", "steps", furthest.alias("f"))
        step = materialize(joined.select("node", F.col("further").alias("ahead"), "steps", "f.above", "f.last"), "jump")
    return step.select("node", "above", "last")


def reachable(
    commit_parents: DataFrame, tips: DataFrame, index: History | None = None, until: str | None = None
) -> DataFrame:
    """All ancestors of every tip, the tip included: ``tip, hash`` for ``tips(hash)``.

    What a tip reaches of a chain is everything up to one position. So a round joins the positions that rose in the last one with the
    links that leave their chains, and keeps the highest position of each tip and chain; commits themselves are joined
    once, at the end. The number of rounds is that of chains on a path, not of commits. Each round is written out, so neither the
    plan nor the work to redo after a lost executor grows. ``until`` stops after the round that reaches that commit.
    """
    index = index_history(commit_parents) if index is None else index
    tips = tips.select("hash").distinct()
    # a tip without links is its own only ancestor
    lonely = tips.join(index.nodes, "hash", "left_anti").select(F.col("hash").alias("tip"), "hash")
    reach = reached_chains(index, tips, until)
    nodes = index.nodes.select("hash", "node", "chain", F.col("position").alias("at"))
    most, most_right = map(_largest_key, (index.nodes.count(), reach.count()))
    named = spread_join(nodes, reach, ["chain"], ["node"], spread_right=["tip"], most=most, most_right=most_right)
    return named.where("at <= position").select("tip", "hash").unionByName(lonely)


def reached_chains(index: History, tips: DataFrame, until: str | None = None) -> DataFrame:
    """Up to which position every tip reaches every chain: ``tip, chain, position``."""
    starts = tips.join(index.nodes, "hash").select(F.col("hash").alias("tip"), "chain", "position")
    goal = index.nodes.where(F.col("hash") == until).select("chain", F.col("position").alias("goal")) if until else None
    # position: how far the tip reaches; known: how far before the last round.
    fresh = F.lit(NOT_REACHED).alias("known")
    reach = materialize(starts.select("tip", "chain", "position", fresh), "reach")
    out = index.links.withColumnRenamed("position", "link_position")
    most_links = _largest_key(index.links.count())
    while rows := reach.where("position > known").count():
        if goal is not None and not reach.join(goal, "chain").where("position >= goal").isEmpty():
            break
        rising, most = reach.where("position > known"), _largest_key(rows)
        crossed = spread_join(
            rising, out, ["chain"], ["tip"], spread_right=["link_position"], most=most, most_right=most_links
        )
        crossed = crossed.where("link_position <= position AND link_position > known")
        entered = crossed.groupBy("tip", F.col("parent_chain").alias("chain")).agg(F.max("parent_position").alias("position"))
        old = reach.select("tip", "chain", "position", F.col("position").alias("known"))
        both = old.unionByName(entered.withColumn("known", F.lit(NOT_REACHED)))
        reach = materialize(both.groupBy("tip", "chain").agg(F.max("position").alias("position"), F.max("known").alias("known")), "reach")
    return reach.select("tip", "chain", "position")


def climb(index: History, asked: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Where first-parent steps lead: ``asked(chain, position, bottom, c, e, left, …)`` with ``to_chain, to_position`` instead.

    One step to the chain below needs no join; further ones take one for each digit, to base 4, of the number of chains on the way.
    No commit is at a position below a root. ``spread`` names columns that differ within a chain.
    """
    inside = F.col("position") - F.col("bottom")
    off = F.col("left") > inside
    at = asked.select(
        *[c for c in asked.columns if c not in ("chain", "position", "bottom", "c", "e", "left")],
        F.when(off, F.col("c")).otherwise(F.col("chain")).alias("to_chain"),
        F.when(off, F.col("e")).otherwise(F.col("position")).alias("to_position"),
        F.when(off, F.col("left") - inside - 1).otherwise(F.col("left")).alias("left"),
    )
    for lift in reversed(index.lifts):
        at = materialize(at, "climb")
        joined = spread_join(at, lift.withColumnRenamed("chain", "to_chain"), ["to_chain"], spread, "left")
        inside = F.col("to_position") - F.col("bottom")
        go = [F.col("left") >= inside + F.col(f"s{k}") for k in (3, 2, 1)]
        moved = {}
        for name, letter in {"to_chain": "c", "to_position": "e", "left": "s"}.items():
            ways = [F.col(f"{letter}{k}") if name != "left" else F.col("left") - inside - F.col(f"s{k}") for k in (3, 2, 1)]
            moved[name] = F.when(go[0], ways[0]).when(go[1], ways[1]).when(go[2], ways[2]).otherwise(F.col(name))
        at = joined.withColumns(moved).select(*at.columns)
    return at.withColumn("to_position", F.col("to_position") - F.col("left")).drop("left")


def ancestors(commit_parents: DataFrame, specs: DataFrame, index: History | None = None) -> DataFrame:
    """The ancestor any number of first-parent steps away: ``hash, steps, ancestor`` for ``specs(hash, steps)``.

    One join for each digit, to base 4, of the largest number of chains on the way. The ancestor is null beyond the root, for a negative
    number and for a null one; 0 steps are the commit itself.
    """
    index = index_history(commit_parents) if index is None else index
    specs = specs.select("hash", F.col("steps").cast("bigint").alias("steps"))
    count, nodes = specs.count(), index.nodes.drop("node")
    hot = hot_keys(specs, ["hash"]) if count >= HOT_FLOOR else None
    if hot is None or hot.isEmpty():
        # one shuffle by hash serves both
        at = specs.repartition("hash").distinct().join(nodes, "hash", "left")
    else:
        at = spread_join(specs.distinct(), nodes, ["hash"], ["steps"], "left", hot=hot)
    goes = (F.col("steps") >= 0) & F.col("chain").isNotNull()
    # a row that leads nowhere looks for a place of its own, so that such rows do not meet in one task
    apart = -1 - F.pmod(F.xxhash64("hash", "steps"), F.lit(2**62))
    zero = F.lit(0).cast("bigint")
    at = at.withColumns({"chain": F.when(goes, F.col("chain")).otherwise(apart), "bottom": F.when(goes, F.col("bottom")), "left": F.coalesce("steps", zero)})
    at = climb(index, at, ["hash", "steps"])
    at = materialize(at.select("hash", "steps", F.col("to_chain").alias("chain"), F.col("to_position").alias("position")), "places")
    named = index.nodes.select("chain", "position", F.col("hash").alias("ancestor"))
    found = spread_join(at, named, ["chain", "position"], ["hash", "steps"], "left", most=count)
    # A commit without links is not in the graph; it is its own ancestor of no steps.
    return found.select("hash", "steps", F.when(F.col("steps") == 0, F.col("hash")).otherwise(F.col("ancestor")).alias("ancestor"))


def merge_bases(commit_parents: DataFrame, pairs: DataFrame, index: History | None = None) -> DataFrame:
    """The best common ancestors of pairs of commits: ``a, b, base`` for ``pairs(a, b)``, one row for each base.

    A base is a common ancestor that no other common ancestor reaches. What both reach of a chain is everything up to the lower of two
    positions, so candidates are the highest common position of each chain; a candidate goes when a link that leaves a chain's common
    stretch leads to it or beyond it on its chain. A commit counts as its own ancestor.
    """
    index = index_history(commit_parents) if index is None else index
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    both = pairs.select(F.col("a").alias("hash")).union(pairs.select("b")).distinct()
    reach = materialize(reached_chains(index, both), "reach")
    of_a = pairs.join(reach.withColumnRenamed("tip", "a"), "a")
    of_b = reach.select(F.col("tip").alias("b"), "chain", F.col("position").alias("other"))
    common = of_a.join(of_b, ["b", "chain"]).select("a", "b", "chain", F.least("position", "other").alias("position"))
    common = materialize(common, "common")
    out = index.links.withColumnRenamed("position", "link_position")
    left = spread_join(common, out, ["chain"], ["a", "b"], spread_right=["link_position"]).where("link_position <= position")
    covered = left.groupBy("a", "b", F.col("parent_chain").alias("chain")).agg(F.max("parent_position").alias("covered"))
    best = common.join(covered, ["a", "b", "chain"], "left").where("covered IS NULL OR covered < position")
    named = index.nodes.select("chain", "position", F.col("hash").alias("base"))
    found = best.join(named, ["chain", "position"]).select("a", "b", "base")
    alone = pairs.where("a = b").join(index.nodes.select(F.col("hash").alias("a")), "a", "left_anti")
    return found.unionByName(alone.select("a", "b", F.col("a").alias("base")))


def commit_in_branch(commit_parents: DataFrame, tip: str, commit_hash: str) -> bool:
    """Whether a commit is the tip of a branch or one of its ancestors."""
    tips = commit_parents.sparkSession.createDataFrame([(tip,)], "hash string")
    hits = reachable(commit_parents, tips, until=commit_hash).where(F.col("hash") == commit_hash)
    return not hits.isEmpty()


def resolve_refs(refs: DataFrame, commits: DataFrame, specs: DataFrame) -> DataFrame:
    """Full hash of each ``spec``: a branch name, a full hash or a hash prefix.

    Returns ``spec, hash, status`` where status is ``ok``, ``unknown`` or ``ambiguous`` (hash NULL unless ok). A branch
    name wins over a hash. Prefixes have at least four characters, as Git asks for, and are matched by equality on their own
    length: the lengths in use, fewer than a hash has characters, decide how many prefixes of a commit take part.
    """
    specs = specs.select("spec").distinct()
    by_name = refs.select(F.col("name").alias("spec"), F.col("hash").alias("branch_hash")).distinct()
    lengths = [r[0] for r in specs.select(F.char_length("spec")).distinct().collect()]
    prefixes = [F.when(F.char_length("hash") > n, F.left("hash", F.lit(n))) for n in sorted(lengths) if n >= 4]
    candidates = commits.select("hash").distinct()
    named = F.array_distinct(F.array_compact(F.array(*prefixes, "hash")))
    candidates = candidates.select(F.explode(named).alias("spec"), "hash")
    matching = candidates.join(specs, "spec", "left_semi").groupBy("spec")
    hits = matching.agg(F.count(F.lit(1)).alias("hits"), F.min("hash").alias("commit_hash"))
    named = by_name.groupBy("spec").agg(F.count(F.lit(1)).alias("names"), F.min("branch_hash").alias("branch_hash"))
    joined = specs.join(named, "spec", "left").join(hits, "spec", "left")
    status = (
        F.when(F.col("names") == 1, "ok")
        .when(F.col("names") > 1, "ambiguous")
        .when(F.col("hits") == 1, "ok")
        .when(F.col("hits") > 1, "ambiguous")
        .otherwise("unknown")
    )
    found = F.coalesce("branch_hash", "commit_hash")
    return joined.select("spec", F.when(status == "ok", found).alias("hash"), status.alias("status"))


def of_repository(table: DataFrame, repository: str | None) -> DataFrame:
    """Rows of one repository, or the whole table."""
    return table if repository is None else table.where(F.col("repository") == repository)


def resolve_ref(refs: DataFrame, commits: DataFrame, spec: str | None = None, repository: str | None = None) -> str:
    """Full hash of one branch name or hash prefix; the tip of the current branch when none is given.

    ``repository`` names the one that is meant; without it the answer must be the same for all. A hash prefix is looked for
    where commits are scanned, and nothing is shuffled but the hits.
    """
    refs, commits = of_repository(refs, repository), of_repository(commits, repository)
    if spec is None:
        found = _some_hashes(refs.where("is_head"))
    else:
        found = _some_hashes(refs.where(F.col("name") == spec))
        if not found:
            same = F.col("hash").startswith(spec) if len(spec) >= 4 else F.col("hash") == spec
            found = _some_hashes(commits.where(same))
    if not found:
        raise ValueError(f"no branch or commit {spec or 'HEAD'!r}")
    if len(found) > 1:
        raise ValueError(f"more than one branch or commit matches {spec or 'HEAD'!r}")
    return found[0]


def _some_hashes(rows: DataFrame) -> list[str]:
    """No, one, or two of the distinct hashes, which tells whether there is exactly one."""
    return [row[0] for row in rows.select("hash").distinct().limit(2).collect()]


def branch_tip(refs: DataFrame, branch: str, repository: str | None = None) -> str:
    """Tip of a branch."""
    found = _some_hashes(of_repository(refs, repository).where(F.col("name") == branch))
    if len(found) != 1:
        raise ValueError(f"branch {branch!r} not found" if not found else f"branch {branch!r} is in several repositories")
    return found[0]


def latest_commits(commits: DataFrame) -> DataFrame:
    """Latest commit per repository and branch: ``repository, branch, hash, commit_date``."""
    order = F.struct("commit_date", "hash")
    return (
        commits.groupBy("repository", "branch")
        .agg(F.max(order).alias("latest"))
        .select("repository", "branch", "latest.hash", "latest.commit_date")
    )
