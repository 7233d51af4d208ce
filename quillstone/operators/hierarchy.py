"""Parent-child rows to full hierarchies, by tree contraction.

Forward rounds shrink the forest. *Rake* takes every leaf away. *Compress* splices inner nodes out of unary chains: a
seeded coin per node and round picks an independent set, so a chain of length n is gone after O(log n) rounds however
long it is. A forest without leaves is a set of disjoint rings: contraction stops there, and what is left is the cyclic
core. Backward rounds undo the contraction in reverse order and hand each node its parent's root, path and depth.

A forward round is one aggregation of the messages between the nodes still alive, a backward round one join with the
nodes that outlived it. The number of alive nodes falls geometrically, so the whole costs a constant number of passes
over the nodes. No tree is ever gathered in one task, and a parent of very many children is aggregated map-side. Once
at most ``FINISH`` nodes are alive, whatever trees they are of, a round costs more than they do, and one task follows
their links to the end; the result is the same for any ``FINISH``, also 0. What a round wrote is deleted as soon as the
rounds that read it are written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.lineage import cut, discard

#: Alive nodes from which on one task finishes the contraction.
FINISH = 10_000

_VIA = "array<struct<node:bigint,name:string>>"
_NODE = f"struct<parent:bigint,via:{_VIA},name:string,state:string,fate:string>"
_KID = f"struct<node:bigint,via:{_VIA}>"
_MOVE = f"struct<parent:bigint,via:{_VIA}>"


def _coin(node: Column, turn: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(turn)), F.lit(2)) == 0


def _messages(nodes: DataFrame) -> DataFrame:
    """What the nodes tell each other, by receiver ``node``.

    Kept and raked nodes keep themselves; kept ones announce themselves to their parent. A spliced node hands its only
    child over to its parent, on whose behalf it announces the child - unsurely, as the child may just have been raked.
    """
    is_kept, is_spliced = F.col("fate") == "kept", F.col("fate") == "spliced"
    none, row = F.lit(None), F.struct(*[F.col(c) for c in ("parent", "via", "name", "state", "fate")])
    via = F.concat("via", F.array(F.struct("node", "name")), F.col("kid.via"))

    def message(when: Column, to: Column, own: Column = none, kid: Column = none, sure: Column = none, move: Column = none) -> Column:
        return F.struct(
            F.when(when, to).alias("node"), own.cast(_NODE).alias("own"), kid.cast(_KID).alias("kid"), sure.cast("boolean").alias("sure"), move.cast(_MOVE).alias("move")
        )

    sent = F.array(
        message(~is_spliced, F.col("node"), own=row),
        message(is_kept, F.col("parent"), kid=F.struct("node", "via"), sure=F.lit(True)),
        message(is_spliced, F.col("parent"), kid=F.struct(F.col("kid.node"), via), sure=F.lit(False)),
        message(is_spliced, F.col("kid.node"), move=F.struct("parent", via)),
    )
    return nodes.select(F.inline(F.filter(sent, lambda m: m["node"].isNotNull())))


_SHAPE = ["node", "parent", "via", "name", "state"]


def _contract(forest: DataFrame) -> tuple[list[DataFrame], int]:
    """Rake and compress (node, parent, name, state) until nothing, only rings or at most ``FINISH`` nodes are left.

    Returns what each round wrote: the nodes alive before it with their ``fate`` - kept, raked (a leaf), spliced (out of
    a chain, to stand in the ``via`` of the edge below it) or gone (raked the round before, now with its last parent) - and
    how many outlived the last.
    """
    nodes = forest.withColumns({"via": F.array().cast(_VIA), "fate": F.lit("kept"), "kid": F.lit(None).cast(_KID)})
    rounds: list[DataFrame] = []
    quiet = 0
    while quiet < 2:
        heard = _messages(nodes).groupBy("node").agg(
            F.max("own").alias("own"), F.count("kid").alias("kids"), F.min("kid").alias("kid"), F.bool_and("sure").alias("sure"), F.max("move").alias("move")
        )
        # Messages to nodes that are gone find nobody.
        heard = heard.filter("own is not null").select(
            "node", F.coalesce("move.parent", "own.parent").alias("parent"), F.coalesce("move.via", "own.via").alias("via"),
            "own.name", "own.state", "own.fate", "kids", "kid", "sure",
        )
        turn = len(rounds)
        splice = (F.col("kids") == 1) & F.col("sure") & (F.col("parent") != F.col("node")) & _coin(F.col("node"), turn) & ~_coin(F.col("parent"), turn)
        fate = F.when(F.col("fate") == "raked", "gone").when(F.col("kids") == 0, "raked").when(splice, "spliced").otherwise("kept")
        seen = Observation()
        counts = [F.count_if(F.col("fate") == "raked").alias("leaves"), F.count_if(F.col("fate") != "gone").alias("alive")]
        rounds.append(cut(heard.select(*_SHAPE, fate.alias("fate"), F.when(fate == "spliced", F.col("kid")).alias("kid")).observe(seen, *counts)))
        nodes = rounds[-1].filter("fate <> 'gone'")
        alive = seen.get["alive"]
        if alive <= FINISH:
            break
        quiet = 0 if seen.get["leaves"] else quiet + 1
    return rounds, alive


_DONE = "node bigint, root string, path array<string>, state string, ring array<bigint>"


def _finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Root, path and state of the nodes of a whole forest, following its links; ``ring`` has the nodes that a ring node stands for."""
    rows = {r.node: r for batch in batches for r in batch.itertuples(index=False)}
    up = {n: int(r.parent) if not pd.isna(r.parent) else None for n, r in rows.items()}
    ends: dict[int, int | None] = {}  # the top of each node's chain; null on and below a ring
    rings: set[int] = set()
    for start in rows:
        walk, place, at = [], {}, start
        while at is not None and at not in ends and at not in place:
            place[at] = len(walk)
            walk.append(at)
            at = up[at]
        if at in place:
            rings.update(walk[place[at] :])
        end = walk[-1] if at is None else ends.get(at)
        ends.update(dict.fromkeys(walk, end))
    out, names = [], 0
    for n, r in rows.items():
        if (top := ends[n]) is None:
            out.append((n, None, None, "below_cycle", [n, *(v["node"] for v in r.via)] if n in rings else None))
        else:
            chain = [n]
            while up[chain[-1]] is not None:
                chain.append(up[chain[-1]])
            path = [name for c in reversed(chain) for name in (*(v["name"] for v in rows[c].via), rows[c].name)]
            out.append((n, path[0], path, rows[top].state, None))
            names += len(path)
        if names > 100_000 or len(out) == 10_000:
            yield pd.DataFrame(out, columns=["node", "root", "path", "state", "ring"])
            out, names = [], 0
    yield pd.DataFrame(out, columns=["node", "root", "path", "state", "ring"])


def _expand(rounds: list[DataFrame], alive: int) -> DataFrame:
    """Root, path and state of every node, from the nodes that outlived all rounds back to the first round.

    The nodes known after a step are those that outlived the round, so their number falls geometrically towards the
    core, and so does the work of a step.
    """
    core = rounds[-1].filter("fate <> 'gone'").select(_SHAPE)
    if alive <= FINISH:
        done = cut(core.coalesce(1).mapInPandas(_finished, _DONE))
    else:
        # A core that does not contract consists of rings: its nodes and those that were spliced out between them.
        none = F.lit(None)
        ring = F.concat(F.array("node"), F.col("via.node"))
        done = core.select("node", none.cast("string").alias("root"), none.cast("array<string>").alias("path"), F.lit("below_cycle").alias("state"), ring.alias("ring"))
    written = [done] if alive <= FINISH else []
    for turn in range(len(rounds) - 2, -1, -1):
        # Removed in a round are its spliced nodes, and the leaves that found their last parent in the round after.
        removed = rounds[turn].filter("fate = 'spliced'").select(_SHAPE).unionByName(rounds[turn + 1].filter("fate = 'gone'").select(_SHAPE))
        up = done.select(F.col("node").alias("parent"), F.col("root").alias("up_root"), F.col("path").alias("up_path"), F.col("state").alias("up_state"))
        top = F.col("parent").isNull()
        new = removed.join(up, "parent", "left").select(
            "node",
            F.when(top, F.col("name")).otherwise(F.col("up_root")).alias("root"),
            F.when(top, F.array("name")).otherwise(F.concat("up_path", F.col("via.name"), F.array("name"))).alias("path"),
            F.when(top, F.col("state")).otherwise(F.col("up_state")).alias("state"),
            F.lit(None).cast("array<bigint>").alias("ring"),
        )
        done = cut(done.unionByName(new))
        discard(rounds[turn + 1], *written)
        written = [done]
    if written:
        discard(rounds[0])
    on_ring = done.filter("ring is not null").select(F.explode("ring").alias("node"), F.lit(True).alias("on_ring")).distinct()
    return done.drop("ring").join(on_ring, "node", "left").withColumn("state", F.when(F.col("on_ring"), "cycle").otherwise(F.col("state"))).drop("on_ring")


_HELD = "node bigint, n bigint"


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """node and descendants of the nodes of a whole forest and of those spliced out of its edges; none on and below rings."""
    rows = {r.node: r for batch in batches for r in batch.itertuples(index=False)}
    up = {n: int(r.parent) if not pd.isna(r.parent) else None for n, r in rows.items()}
    waiting = dict.fromkeys(rows, 0)
    for p in up.values():
        if p is not None:
            waiting[p] += 1
    below = dict.fromkeys(rows, 0)
    ready, out = [n for n, w in waiting.items() if not w], []
    while ready:
        n = ready.pop()
        size = below[n] + int(rows[n].n)
        out.append((n, size))
        for v, own in zip(reversed(rows[n].chain[:-1]), reversed(rows[n].held[:-1]), strict=True):
            size += 1 + int(own)
            out.append((v, size))
        if (p := up[n]) is not None:
            below[p] += size + 1
            waiting[p] -= 1
            if not waiting[p]:
                ready.append(p)
    yield pd.DataFrame(out, columns=["node", "n"])


def _sizes(rounds: list[DataFrame], alive: int) -> DataFrame:
    """node and n, the number of all descendants, from the recorded contraction; what is on or below a ring has none.

    A leaf that is gone hands the size of its subtree to the node that it hangs on, and on the way to those spliced out
    between them. What a node was handed waits in ``held`` until it goes itself.
    """
    spark = rounds[0].sparkSession
    held = spark.createDataFrame([], _HELD)
    parts: list[DataFrame] = []
    size = F.sum("own").over(Window.partitionBy("end").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0))
    written: list[DataFrame] = []
    rested: list[DataFrame] = []
    for nodes in rounds[1:]:
        gone = nodes.filter("fate = 'gone'").select("parent", F.col("node").alias("end"), F.posexplode(F.concat("via.node", F.array("node"))).alias("at", "node"))
        known = gone.join(held, "node", "left").withColumn("own", F.coalesce("n", F.lit(0)) + F.lit(1))
        sized = cut(known.select("parent", "at", "node", size.alias("size")))
        rested.append(sized)
        parts.append(sized.select("node", (F.col("size") - 1).alias("n")))
        given = sized.filter("at = 0 and parent is not null").select(F.col("parent").alias("node"), F.col("size").alias("n"))
        kept = held.join(sized.select("node"), "node", "left_anti")
        held = cut(kept.unionByName(given).groupBy("node").agg(F.sum("n").alias("n")))
        discard(*written)
        written = [held]
    if alive <= FINISH:
        core = rounds[-1].filter("fate <> 'gone'").select("parent", F.col("node").alias("end"), F.posexplode(F.concat("via.node", F.array("node"))).alias("at", "node"))
        chains = core.join(held, "node", "left").groupBy("end", "parent").agg(F.sort_array(F.collect_list(F.struct("at", "node", F.coalesce("n", F.lit(0)).alias("n")))).alias("c"))
        chains = chains.select(F.col("end").alias("node"), "parent", F.col("c.node").alias("chain"), F.col("c.n").alias("held"), F.element_at("c.n", -1).alias("n"))
        parts.append(chains.coalesce(1).mapInPandas(_counted, _HELD))
    every = cut(reduce(DataFrame.unionByName, parts, spark.createDataFrame([], _HELD)))
    discard(*rested, *written)
    return every


def hierarchy(rows: DataFrame, scope: list[str], name: str = "clause", parent: str = "parent", sizes: bool = False) -> DataFrame:
    """Root, full path, depth and state of every row of ``rows`` within its ``scope``; and descendants, their number, with ``sizes``.

    (``scope``, ``name``) must be unique and ``name`` not null; ``parent`` null marks a root. Scope columns compare
    null-safe. Adds root, path (names from the root down to the row), depth (0 for a root) and state: ``ok``,
    ``broken`` (the chain of parents ends at a name without row), ``cycle`` (the row is its own ancestor) or
    ``below_cycle``. root, path and depth start at the topmost known row for ``broken``; they are null on and below a
    ring. Other columns of ``rows`` stay as they are, but for those named like the added ones, which these replace. An
    empty input gives an empty result.
    """
    nodes = cut(rows.drop("root", "path", "depth", "state").withColumn("_node", F.monotonically_increasing_id()))
    has = nodes.select(*[F.col(c).alias(f"_has_{i}") for i, c in enumerate(scope)], F.col(name).alias("_has_name"), F.col("_node").alias("_parent"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_has_{i}")) for i, c in enumerate(scope)], F.col(parent) == F.col("_has_name"))
    state = F.when(F.col(parent).isNotNull() & F.col("_parent").isNull(), "broken").otherwise("ok")
    forest = nodes.join(has, same, "left").select(
        F.col("_node").alias("node"), F.col("_parent").alias("parent"), F.col(name).alias("name"), state.alias("state")
    )
    rounds, alive = _contract(forest)
    if sizes:
        below = _sizes(rounds, alive).select(F.col("node").alias("_node"), F.col("n").alias("descendants"))
    known = _expand(rounds, alive)
    # A chain that hangs on a ring has no root.
    lost = F.col("state").isin("cycle", "below_cycle")
    known = known.select(
        F.col("node").alias("_node"),
        F.when(~lost, F.col("root")).alias("root"),
        F.when(~lost, F.col("path")).alias("path"),
        F.when(~lost, F.size("path") - 1).alias("depth"),
        "state",
    )
    whole = nodes.drop("descendants") if sizes else nodes
    whole = whole.join(known, "_node")
    if sizes:
        whole = whole.join(below, "_node", "left").withColumn("descendants", F.when(lost, F.lit(0)).otherwise(F.coalesce("descendants", F.lit(0))).cast("bigint"))
    return whole.drop("_node")


def descendants(tree: DataFrame, scope: list[str], name: str = "clause") -> DataFrame:
    """One row per ancestor and descendant of the rows that have a path: scope, ancestor, descendant, distance.

    As many rows as the paths have steps; ``hierarchy(sizes=True)`` counts descendants without making them.
    """
    size = F.size("path")
    return (
        tree.filter(F.col("depth") > 0)
        .select(*scope, F.col(name).alias("descendant"), size.alias("_n"), F.posexplode(F.slice("path", 1, size - 1)).alias("_at", "ancestor"))
        .select(*scope, "ancestor", "descendant", (F.col("_n") - 1 - F.col("_at")).alias("distance"))
    )
