"""Connected groups of linked rows, without any group meeting in one task.

Links are rows (a, b) of long ids. Each round joins every node to its smallest
neighbour, follows those pointers to their ends, and replaces both ends of every
link; links inside a group vanish. Every table is written to the shared folder,
so a lost executor costs one step. Hot nodes sit on the split side of joins and
are pre-aggregated before they meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import discard, durable

#: Other nodes of a key that is compared at once, turns in which a node meets one pivot, nodes of a block where the rest of a key is compared block by block, low bits of a key that number its slot.
PIVOTS, TURNS, BLOCK, SLOT_BITS = 4, 4, 512, 10


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links``; root is the smallest id of its group. Loops and repeated links do no harm."""
    rest = durable(links.select("a", "b").where("a <> b").distinct())
    found: DataFrame | None = None
    while not rest.isEmpty():
        both = rest.select(F.col("a").alias("id"), F.col("b").alias("other")).unionAll(rest.select(F.col("b").alias("id"), F.col("a").alias("other")))
        step = durable(both.groupBy("id").agg(F.min("other").alias("other")).select("id", F.least("id", "other").alias("root")))
        step = _flat(step)
        a, b = (step.select(F.col("id").alias(n), F.col("root").alias(f"root_{n}")) for n in ("a", "b"))
        rest = durable(rest.join(a, "a").join(b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).where("a <> b").distinct())
        if found is None:
            found = step
        else:
            over = step.select(F.col("id").alias("root"), F.col("root").alias("over"))
            found = durable(found.join(over, "root", "left").select("id", F.coalesce("over", "root").alias("root")))
    return rest.select(F.col("a").alias("id"), F.col("b").alias("root")) if found is None else found


def _flat(step: DataFrame) -> DataFrame:
    """Follow pointers to smaller ids until each is at its end; the way halves every time."""
    while True:
        up = step.select(F.col("id").alias("root"), F.col("root").alias("over"))
        moved = durable(step.join(up, "root", "left").select("id", F.coalesce("over", "root").alias("root"), (F.col("over") < F.col("root")).alias("moved")))
        step = moved.select("id", "root")
        if moved.where("moved").isEmpty():
            return step


def relabelled(rows: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """``rows`` with column ``root``: that of id ``name``, or the id itself where it has no link."""
    return rows.join(groups.select(F.col("id").alias(name), "root"), name, "left").withColumn("root", F.coalesce("root", name))


def in_blocks(rows: DataFrame, key: str, size: str, most: int, salt: str) -> DataFrame:
    """Deal the rows of large buckets to pairs of blocks (bi <= bj), so that any two rows of a bucket meet in one of them.

    ``size`` holds the rows of the bucket; each block has near ``most`` rows, and a row is written once for each block.
    """
    blocks = F.ceil(F.col(size) / F.lit(most)).cast("int")
    own = F.pmod(F.xxhash64(salt), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", other)
    return dealt.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("other", "blocks")


def link_nodes(nodes: DataFrame, keys: DataFrame, contents: Callable[[DataFrame], DataFrame], confirm: Callable, near: tuple[str, str, int], owner: tuple[str, Callable], confirm_in_blocks: bool = False) -> DataFrame:
    """(id, root) of nodes linked to another one: pairs that share a key, lie near each other and are confirmed.

    ``nodes``: node and its signatures. ``keys``: (key, node); the last ``SLOT_BITS`` bits of a key are its slot.
    ``near``: column, kind and radius of the signature that the distance (number of different components) is taken on; a kind is
    a numpy type, or "bits". ``owner``: kind of ``sig`` and a function from equal components [pair, component] to the first slot
    whose key a pair shares. ``contents`` gives (node, content) of a table of nodes, ``confirm`` decides on two contents.

    A key's nodes are never written as all pairs. A node meets one pivot a turn: of the nodes that are central in its keys, the
    one that shares most keys with others; in the further turns a pivot of another group in a key whose nodes are in several. Keys
    of ``PIVOTS`` + 1 nodes at most are compared at once. Larger keys whose nodes then still differ are compared in pairs of
    blocks, and only nodes of different groups within the radius leave a block, and only from the first key they share. So the
    links found make the same groups as all links would. With ``confirm_in_blocks`` contents travel to the blocks, and what leaves
    a block is a forest of confirmed links: fewer rows than it has nodes, however many of its nodes are near each other.
    """
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = durable(keys.join(shared, "key").select("key", "n", "node"))
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    central = members.join(degree, "node").select("key", "node", (F.col("degree") * (1 << 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))).alias("order"))
    tops = central.groupBy("key").agg(F.max(F.struct("order", "node")).alias("top")).select("key", "top.order", F.col("top.node").alias("pivot"))
    first = _one_pivot(members.select("key", "node").join(tops, "key").where("pivot <> node"), F.max)
    links = content = groups = None
    rest = members
    for turn in range(TURNS):
        if turn:
            # a key of two may not have met yet: its node met the pivot of another key
            done, rest = rest, durable(_split(rest if turn == 1 else rest.where(f"n > {PIVOTS + 1}"), groups))
            discard(done)
            if rest.isEmpty():
                break
            large = rest.where(f"n > {PIVOTS + 1}")
            order = F.xxhash64(F.lit(turn), "node")
            pivots = large.groupBy("key").agg(F.min(F.struct(order.alias("order"), F.col("node").alias("pivot"), "root")).alias("top"))
            met = large.join(pivots, "key").where("root <> top.root").select("node", "top.pivot", "top.order")
            first = _one_pivot(met, F.min)
            if turn == 1:
                small = rest.where(f"n <= {PIVOTS + 1}")
                every = small.groupBy("key").agg(F.collect_list(F.struct("node", "root")).alias("all"))
                every = every.select("key", *[F.get("all", F.lit(k))[c].alias(f"{p}{k}") for p, c in (("p", "node"), ("r", "root")) for k in range(PIVOTS + 1)])
                first = first.unionAll(_pivot_pairs(small, every, PIVOTS + 1)).distinct()
        content, links = _judge(durable(_near(first, nodes, near)), content, links, contents, confirm)
        groups = components(links)
    rest = durable(_split(rest.where(f"n > {PIVOTS + 1}"), groups).join(nodes.select("node", "sig", F.col(near[0]).alias("sketch")), "node"))
    if confirm_in_blocks:
        found = durable(_across(rest.join(contents(rest.select("node").distinct()), "node"), near, owner, confirm))
        return groups if found.isEmpty() else components(links.unionAll(found))
    last = durable(_across(rest, near, owner))
    if last.isEmpty():
        return groups
    return components(_judge(last, content, links, contents, confirm)[1])


def _one_pivot(met: DataFrame, best: Callable) -> DataFrame:
    """For each node of (node, pivot, order) its pair with the pivot whose order is ``best``, the largest or least."""
    chosen = met.groupBy("node").agg(best(F.struct("order", "pivot")).alias("best"))
    return chosen.select(F.least("node", "best.pivot").alias("a"), F.greatest("node", "best.pivot").alias("b")).distinct()


def _pivot_pairs(rows: DataFrame, pivots: DataFrame, count: int) -> DataFrame:
    """Each row's node with the pivots of its key (p0, ..., of roots r0, ...) that are in another group."""
    met = rows.join(pivots, "key")
    return reduce(DataFrame.unionAll, [met.where(f"root <> r{k}").select(F.least(f"p{k}", "node").alias("a"), F.greatest(f"p{k}", "node").alias("b")) for k in range(count)]).distinct()


def _split(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of keys whose nodes are not all in one group, with their ``root``."""
    named = relabelled(rows.select("key", "n", "node"), groups, "node")
    several = named.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    return named.join(several, "key")


def _judge(pairs: DataFrame, content: DataFrame | None, links: DataFrame | None, contents: Callable, confirm: Callable) -> tuple[DataFrame, DataFrame]:
    """Contents and links with those of further pairs."""
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    if content is None:
        content = durable(contents(wanted))
    else:
        new = durable(wanted.join(content.select("node"), "node", "left_anti"))
        content = content if new.isEmpty() else content.unionAll(durable(contents(new)))
    found = durable(_confirmed(pairs, content, confirm))
    return content, found if links is None else links.unionAll(found)


def _sides(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    a, b = (table.select(F.col("node").alias(n), F.col(column).alias(f"{column}_{n}")) for n in ("a", "b"))
    return pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", f"{column}_a", f"{column}_b")


def _parts(sigs: list[bytes], kind: str) -> np.ndarray:
    """Components of signatures, one row each; kind "bits" takes every bit as one."""
    flat = np.frombuffer(b"".join(sigs), dtype=np.uint8 if kind == "bits" else kind).reshape(len(sigs), -1)
    return np.unpackbits(flat, axis=1) if kind == "bits" else flat


def _near(pairs: DataFrame, nodes: DataFrame, near: tuple[str, str, int]) -> DataFrame:
    """Pairs within the radius."""
    column, kind, radius = near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_parts(batch.column(k).to_pylist(), kind) for k in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(axis=1) <= radius))

    return _sides(pairs, nodes, column).mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, content: DataFrame, confirm: Callable) -> DataFrame:
    """Pairs that ``confirm`` accepts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [confirm(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _sides(pairs, content, "content").mapInArrow(run, "a long, b long")


def _forest(a: list[int], b: list[int], root: list[int], content: pa.Array, confirm: Callable) -> list[int]:
    """Which of the pairs (a, b) of places to keep: confirmed ones that join two groups not yet joined by those before."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            up[x] = x = up.get(up[x], up[x])
        return x

    kept = []
    for k, (i, j) in enumerate(zip(a, b)):
        x, y = top(root[i]), top(root[j])
        if x != y and confirm(content[i].as_buffer(), content[j].as_buffer()):
            up[x] = y
            kept.append(k)
    return kept


def _across(rows: DataFrame, near: tuple[str, str, int], owner: tuple[str, Callable], confirm: Callable | None = None) -> DataFrame:
    """Pairs of different groups within the radius that share a key, each once, compared block by block.

    With ``confirm``, which takes column ``content`` of both, only as many confirmed pairs of a block as join its groups.
    """
    _, kind, radius = near
    own_kind, first_slot = owner
    columns = ["node", "root", "sketch", "sig"] + (["content"] if confirm else [])

    def run(key, table):
        """``table`` holds two blocks at most."""
        node, root, own = (table.column(n).to_numpy() for n in ("node", "root", "own"))
        sketch, sig = _parts(table.column("sketch").to_pylist(), kind), _parts(table.column("sig").to_pylist(), own_kind)
        same, slot = key[1] == key[2], key[0].as_py() & ((1 << SLOT_BITS) - 1)
        left, right = np.flatnonzero(own == key[1].as_py()), np.flatnonzero(own == key[2].as_py())
        ends = [(left[:0], left[:0])]
        for s in range(0, len(left), 32):
            part = left[s:s + 32]
            close = ((sketch[part][:, None, :] != sketch[right][None, :, :]).sum(axis=2) <= radius) & (root[part][:, None] != root[right][None, :])
            if same:
                close &= node[part][:, None] < node[right][None, :]
            i, j = np.nonzero(close)
            i, j = part[i], right[j]
            mine = first_slot(sig[i] == sig[j]) == slot
            ends.append((i[mine], j[mine]))
        i, j = map(np.concatenate, zip(*ends))
        if confirm:
            kept = _forest(i.tolist(), j.tolist(), root.tolist(), table.column("content").combine_chunks(), confirm)
            i, j = i[kept], j[kept]
        return pa.table({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])})

    dealt = in_blocks(rows, "key", "n", BLOCK, "node").select("key", "bi", "bj", "own", *columns)
    return dealt.groupBy("key", "bi", "bj").applyInArrow(run, "a long, b long")
