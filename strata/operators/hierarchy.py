"""Parent-child links to full hierarchies.

Edges say that ``child`` has the parent ``parent``. Null ends and repeated rows are dropped; a node may have several
parents. Nodes are grouped into connected components, each component is co-located in one task and walked by an
iterative depth-first traversal with node colouring. Components of more than ``max_component`` edges never meet in one
task: they are first reduced by distributed rake-and-compress rounds, and what is left of them is settled by
distributed forward and backward colouring.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.runtime import cut, fingerprint

#: Edges of a component that one task may hold: about 500 bytes each while it is walked.
MAX_COMPONENT = 500_000
#: Ancestors that a path row lists itself; a longer path goes on in the row of ``path_anchor``.
PATH_BLOCK = 256


def clean_edges(df: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, parent) as longs without nulls; repeats may stay. Other columns, whatever their names, are left out."""
    return df.select(F.col(child).cast("long").alias("child"), F.col(parent).cast("long").alias("parent")).where("child IS NOT NULL AND parent IS NOT NULL")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an edge frame (child, parent): component is the smallest node id in it.

    First each task replaces every chunk of its own edges by stars to the smallest node that the chunk connects, which changes
    no component but shortens most chains to a step or two; up to TOGETHER such stars are joined up in one task. Beyond, it alternates large-star and small-star steps, which halve the height of every tree, until nothing changes. Each step is
    a map-side combined minimum and one join, so that a node with very many links costs no single task its whole list
    (the minimum is pre-aggregated, the join side splits under adaptive skew handling).
    """
    links = cut(edges.where("child <> parent").select("child", "parent").mapInArrow(_local_stars, "u long, v long").distinct())
    last = None
    if links.count() <= TOGETHER:
        links = cut(links.select(F.col("u").alias("child"), F.col("v").alias("parent")).coalesce(1).mapInArrow(_local_stars, "u long, v long"))
        last = fingerprint(links, "u", "v")
    while (now := fingerprint(links, "u", "v")) != last:
        last = now
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    roots = edges.select(F.col("child").alias("node")).union(edges.select(F.col("parent").alias("node"))).distinct()
    return roots.join(links.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


#: Edges that a task joins up at once before the distributed rounds, and stars that are joined up in one task: about 100 bytes each.
CHUNK = TOGETHER = 2_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node connected with it) of all nodes of the edges u-v but the smallest ones. In each round every group of
    joined nodes that touches a smaller one is hooked to it, and trees are flattened, so that rounds are logarithmic."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(u):
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            break
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (flat := label[label]).tobytes() != label.tobytes():
            label = flat
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """stars over chunks of edges."""
    held: list[pa.RecordBatch] = []
    size = 0

    def done() -> pa.RecordBatch:
        ends = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) if held else np.empty(0, np.int64) for i in (0, 1)]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(*ends)], names=["u", "v"])

    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= CHUNK:
            yield done()
            size = 0
    yield done()


def walk_component(child: np.ndarray, parent: np.ndarray) -> Iterator[tuple]:
    """Rows (node, loop, root, depth, path, path_anchor, pre, post, descendants, back_edges, below) of one component's different edges.

    Loops: Tarjan's form of depth-first search from child to parents, white, grey and black nodes, iterative; loop is the
    smallest node of the strong component. Tree: each
    node hangs under its smallest parent; nodes whose chain of smallest parents enters a loop have no root, depth or
    path. The descendants of v in the tree are the nodes with pre in (pre of v, post of v] under the same root; below
    counts the other nodes from which v is reached over any of their parents. back_edges are the parents inside the same loop that
    are not greater than the node: without these edges no loop is left.
    """
    nodes, at = np.unique(np.concatenate([child, parent]), return_inverse=True)
    n, m = len(nodes), len(child)
    c, p = at[:m], at[m:]
    order = np.lexsort((p, c))
    begin = np.searchsorted(c[order], np.arange(n + 1)).tolist()
    ups = p[order].tolist()
    # depth-first search; index 0: white, colour 1: grey, 2: black
    colour, index, low, nxt, part = bytearray(n), array("q", bytes(8 * n)), array("q", bytes(8 * n)), array("q", begin[:-1]), array("q", bytes(8 * n))
    clock, parts, stack, least = 0, 0, [], array("q")
    for start in range(n):
        if colour[start]:
            continue
        clock += 1
        colour[start], index[start], low[start] = 1, clock, clock
        stack.append(start)
        grey = [start]
        while grey:
            x = grey[-1]
            if nxt[x] < begin[x + 1]:
                y = ups[nxt[x]]
                nxt[x] += 1
                if not colour[y]:
                    clock += 1
                    colour[y], index[y], low[y] = 1, clock, clock
                    stack.append(y)
                    grey.append(y)
                elif part[y] == 0 and index[y] < low[x]:
                    # y is still on the stack: grey, or black in an open strong component
                    low[x] = index[y]
                continue
            grey.pop()
            colour[x] = 2
            if grey and low[x] < low[grey[-1]]:
                low[grey[-1]] = low[x]
            if low[x] == index[x]:
                parts += 1
                small, size = x, 0
                while True:
                    y = stack.pop()
                    part[y] = parts
                    size += 1
                    small = min(small, y)
                    if y == x:
                        break
                alone = size == 1 and x not in ups[begin[x] : begin[x + 1]]
                least.append(-1 if alone else small)
    del stack, low, index, nxt
    # the tree of smallest parents
    up = [ups[begin[x]] if begin[x] < begin[x + 1] else -1 for x in range(n)]
    over = np.array(up)
    kids = np.argsort(over, kind="stable").tolist()
    first = np.searchsorted(over[kids], np.arange(n + 1)).tolist()
    root, depth, pre, post = (array("q", [-1]) * n for _ in range(4))
    for r in range(n):
        if up[r] >= 0:
            continue
        clock = 0
        todo = [r]
        while todo:
            x = todo.pop()
            if x < 0:
                post[~x] = clock - 1
                continue
            root[x], depth[x], pre[x] = r, 0 if x == r else depth[up[x]] + 1, clock
            clock += 1
            todo.append(~x)
            todo += reversed(kids[first[x] : first[x + 1]])
    del kids, first
    of = np.array(part) - 1
    below = _below(of, c, p)
    names = nodes.tolist()
    for x in range(n):
        loop = least[of[x]]
        back = [names[y] for y in ups[begin[x] : begin[x + 1]] if y <= x and part[y] == part[x]] if loop >= 0 else []
        place: tuple = (None,) * 7
        if root[x] >= 0:
            path, y = [], x
            for _ in range(depth[x] % PATH_BLOCK + 1):
                path.append(names[y])
                y = up[y]
            place = (names[root[x]], depth[x], path[::-1], names[y] if y >= 0 else None, pre[x], post[x], post[x] - pre[x])
        yield (names[x], names[loop] if loop >= 0 else None, *place, back, below[of[x]] - 1)


#: Merges whose reach is swept at once: bits held for each node.
MERGE_BITS = 4096


def _below(of: np.ndarray, child: np.ndarray, parent: np.ndarray) -> list[int]:
    """For each strong component the number of nodes that reach it, its own included, over all parents. of: the component of each node, parents
    before children.

    A strong component counts as one node of its size. A node with one parent is reached with its chain of only parents, so
    that sizes add up along it; a merge, of several parents, counts once for each node that reaches it, with all that hangs
    under it by only parents. Which merges a node is above is held in bits, a block of merges at a time.
    """
    tree = np.bincount(of).tolist()
    k = len(tree)
    links = np.unique(np.stack([of[child], of[parent]], 1)[of[child] != of[parent]], axis=0)
    begin, ups = np.searchsorted(links[:, 0], np.arange(k + 1)).tolist(), links[:, 1].tolist()
    for x in range(k - 1, -1, -1):
        if begin[x + 1] - begin[x] == 1:
            tree[ups[begin[x]]] += tree[x]
    total = list(tree)
    merges = [x for x in range(k) if begin[x + 1] - begin[x] > 1]
    for b in range(0, len(merges), MERGE_BITS):
        block = merges[b : b + MERGE_BITS]
        bit = {x: 1 << i for i, x in enumerate(block)}
        # the sizes of the block's merges by binary digits, so that set bits are summed by counting
        digits = [sum(bit[x] for x in block if tree[x] >> d & 1) for d in range(max(tree[x] for x in block).bit_length())]
        held: dict[int, int] = {}
        for x in range(block[-1], -1, -1):
            seen = held.pop(x, 0)
            if seen:
                total[x] += sum((seen & y).bit_count() << d for d, y in enumerate(digits))
            if seen := seen | bit.get(x, 0):
                for u in ups[begin[x] : begin[x + 1]]:
                    held[u] = held.get(u, 0) | seen
    return total


WALKED = "component long, node long, loop long, root long, depth int, path array<long>, path_anchor long, pre long, post long, descendants long, back_edges array<long>, below long"
_COLUMNS = [c.split()[0] for c in WALKED.split(", ")]


_TYPES = [pa.int32() if c == "depth" else pa.list_(pa.int64()) if c in ("path", "back_edges") else pa.int64() for c in _COLUMNS]
#: Rows that a walk hands out at once.
ROWS = 4_000


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by component: holds one component at a time, and hands its rows out while it makes them."""
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * len(_COLUMNS)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _TYPES)], names=_COLUMNS)

    def rows(comp: int, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for r in walk_component(*(np.concatenate(x) for x in zip(*held))):
            out.append((comp, *r))
            if len(out) >= ROWS:
                yield batch()

    now, held = None, []
    for b in batches:
        comp, c, p = (b.column(x).to_numpy(zero_copy_only=False) for x in ("component", "child", "parent"))
        for a, z in zip(edges := np.concatenate([[0], np.flatnonzero(np.diff(comp)) + 1, [len(comp)]]), edges[1:]):
            if a == z:
                continue
            if comp[a] != now and held:
                yield from rows(now, held)
                held = []
            now = int(comp[a])
            held.append((c[a:z], p[a:z]))
    if held:
        yield from rows(now, held)
    yield batch()


def _located(edges: DataFrame, max_component: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges with their component: those of components one task can hold, and the rest if there is any."""
    comps = cut(connected_components(edges))
    known = cut(edges.distinct().join(comps.withColumnRenamed("node", "child"), "child").select("component", "child", "parent"))
    big = known.groupBy("component").count().where(F.col("count") > max_component)
    if not big.limit(1).count():
        return known, None
    big = cut(big.select("component"))
    return known.join(big, "component", "left_anti"), known.join(big, "component", "left_semi")


def _colocate(known: DataFrame) -> DataFrame:
    return known.repartition("component").sortWithinPartitions("component").mapInArrow(_walk, WALKED)


def loop_nodes(edges: DataFrame, max_component: int = MAX_COMPONENT) -> DataFrame:
    """(node) of all nodes on a loop of an edge frame (child, parent), self-loops included."""
    small, large = _located(edges, max_component)
    found = _colocate(small).where("loop IS NOT NULL").select("node")
    return found if large is None else found.union(_distributed_loops(large, max_component).select("node")).distinct()


def hierarchy(edges: DataFrame, max_component: int = MAX_COMPONENT) -> DataFrame:
    """One row for each node of an edge frame (child, parent).

    Columns: node, component, loop (the smallest node of the loops it is on, null off all loops), root, depth, path (root to node; of a node deeper than 256 the part after
    path_anchor, whose own row has the part before), path_anchor, pre and post (the descendants of v are the nodes of
    the same root with v.pre < pre <= v.post), descendants (their number), back_edges (the parents inside the same loop that are not greater than the node: without these edges no loop is left),
    below (the number of other nodes that reach it over any of their parents, on loops too).
    Of several parents the smallest makes root, depth, path, pre, post and descendants; below and loop follow all.
    Nodes whose chain of smallest parents enters a loop have null root, depth, path, pre, post and descendants. For components beyond
    max_component all columns are the same, from distributed pointer doubling, path blocks and joins. full_paths gives whole paths,
    ``descendants_of`` lists the descendants of given nodes.
    """
    small, large = _located(edges, max_component)
    walked = _colocate(small)
    return walked if large is None else walked.unionByName(_distributed_tree(large, max_component).select(*_COLUMNS))


def _distributed_loops(edges: DataFrame, max_component: int) -> DataFrame:
    """(node, loop) of the loop nodes of components too large for one task.

    Rake: drop nodes without a parent or without a child, which are on no loop. Compress: a node with one parent and one
    child becomes an edge from its child to its parent, and is on a loop exactly if that edge is. The rounds end when what
    remains fits a task, or nothing shrinks; then colours (the largest id that reaches a node) are spread and each
    colour's root is searched backwards, the standard distributed way to strong components. Unfolding the rounds in reverse
    labels the compressed nodes whose two ends have one label.
    """
    edges = cut(edges.select("child", "parent"))
    selfs = [cut(edges.where("child = parent").select(F.col("child").alias("node")))]
    rounds: list[DataFrame] = []
    edges = cut(edges.where("child <> parent"))
    size = edges.count()
    while size > max_component:
        ups, downs = edges.groupBy("child").agg(F.count(F.lit(1)).alias("up"), F.min("parent").alias("p")), edges.groupBy("parent").agg(F.count(F.lit(1)).alias("down"), F.min("child").alias("c"))
        inner = cut(ups.join(downs, ups.child == downs.parent).select(ups.child.alias("node"), "up", "down", "p", "c"))
        live = cut(edges.join(inner.select(F.col("node").alias("child")), "child", "left_semi").join(inner.select(F.col("node").alias("parent")), "parent", "left_semi"))
        # of neighbouring chain nodes only local maxima of a hash go, so that what goes is never adjacent
        line = inner.where("up = 1 AND down = 1").withColumn("h", F.xxhash64("node"))
        near = line.select(F.col("node").alias("o"), F.col("h").alias("oh"))
        gone = line.join(near.select(F.col("o").alias("p"), F.col("oh").alias("ph")), "p", "left").join(near.select(F.col("o").alias("c"), F.col("oh").alias("ch")), "c", "left")
        gone = cut(gone.where("(ph IS NULL OR h > ph) AND (ch IS NULL OR h > ch)").select("node", "c", "p"))
        rest = live.join(gone.select(F.col("node").alias("child")), "child", "left_anti").join(gone.select(F.col("node").alias("parent")), "parent", "left_anti")
        both = cut(rest.select("child", "parent").union(gone.select(F.col("c").alias("child"), F.col("p").alias("parent"))).distinct())
        rounds.append(gone)
        selfs.append(both.where("child = parent").select(F.col("child").alias("node")))
        edges = cut(both.where("child <> parent"))
        now = edges.count()
        if now == size:
            break
        size = now
    if 0 < size <= max_component:
        labels = _colocate(edges.withColumn("component", F.lit(0).cast("long"))).where("loop IS NOT NULL").select("node", "loop")
    else:
        labels = _strong(edges)
    labels = _label_selfs(labels, selfs.pop())
    while rounds:
        gone = rounds.pop()
        ends = gone.join(labels.select(F.col("node").alias("c"), F.col("loop").alias("lc")), "c").join(labels.select(F.col("node").alias("p"), F.col("loop").alias("lp")), "p").where("lc = lp")
        labels = _label_selfs(labels.union(ends.select("node", F.col("lc").alias("loop"))), selfs.pop())
    # the smallest node of each loop names it, as in a walk
    least = labels.groupBy("loop").agg(F.min("node").alias("least"))
    return labels.join(least, "loop").select("node", F.col("least").alias("loop"))


def _label_selfs(labels: DataFrame, selfs: DataFrame) -> DataFrame:
    """Nodes that lead to themselves are loops of their own where they are on no other."""
    labels = cut(labels)
    return cut(labels.union(selfs.distinct().join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("loop"))))


def _strong(edges: DataFrame) -> DataFrame:
    """(node, loop): strong components of more than one node, by forward colouring and backward search in rounds."""
    left = edges.select("child", "parent").where("child <> parent").distinct()
    out = None
    left = cut(left)
    while True:
        # trim what has no parent or no child until that changes nothing
        n = left.count()
        while n:
            up = left.select(F.col("child").alias("k")).distinct().intersect(left.select(F.col("parent").alias("k")).distinct())
            up = cut(up)
            left = cut(left.join(up.withColumnRenamed("k", "child"), "child", "left_semi").join(up.withColumnRenamed("k", "parent"), "parent", "left_semi"))
            if (m := left.count()) == n:
                break
            n = m
        if not n:
            break
        colour = cut(left.select(F.col("child").alias("node")).distinct().withColumn("colour", F.col("node")))
        last = None
        while (now := fingerprint(colour, "node", "colour")) != last:
            last = now
            sent = left.join(colour.withColumnRenamed("node", "child"), "child").select(F.col("parent").alias("node"), "colour")
            colour = cut(colour.union(sent).groupBy("node").agg(F.max("colour").alias("colour")))
        same = left.join(colour.select(F.col("node").alias("child"), F.col("colour").alias("a")), "child").join(colour.select(F.col("node").alias("parent"), F.col("colour").alias("b")), "parent").where("a = b").select("child", "parent", F.col("a").alias("colour"))
        same = cut(same)
        reach = cut(colour.where("node = colour").select("node", "colour"))
        last = -1
        while (now := reach.count()) != last:
            last = now
            more = same.join(reach.withColumnRenamed("node", "parent"), ["parent", "colour"]).select(F.col("child").alias("node"), "colour")
            reach = cut(reach.union(more).distinct())
        sizes = reach.groupBy("colour").count().where("count > 1").select("colour")
        part = cut(reach.join(sizes, "colour").select("node", F.col("colour").alias("loop")))
        out = part if out is None else out.union(part)
        done = cut(reach.select("node"))
        left = cut(left.join(done.withColumnRenamed("node", "child"), "child", "left_anti").join(done.withColumnRenamed("node", "parent"), "parent", "left_anti"))
    return out if out is not None else edges.select(F.col("child").alias("node"), F.col("child").alias("loop")).limit(0)


def _distributed_tree(edges: DataFrame, max_component: int) -> DataFrame:
    """Root, depth, path and number of descendants in components too large for one task, by pointer doubling on the smallest parents."""
    tree = edges.groupBy("component", F.col("child").alias("node")).agg(F.min("parent").alias("up"))
    nodes = edges.select("component", F.col("child").alias("node")).union(edges.select("component", F.col("parent").alias("node"))).distinct()
    base = cut(nodes.join(tree, ["component", "node"], "left"))
    placed = _placed(base)
    lists = _path_blocks(placed)
    below = _descendant_counts(lists.where("depth IS NOT NULL").select("node", "path", "path_anchor", F.lit(1).alias("w")))
    loops = _fresh(_distributed_loops(edges, max_component))
    order = _preorder(placed, lists, below)
    ends = loops.select(F.col("node").alias("child"), F.col("loop").alias("a")), loops.select(F.col("node").alias("parent"), F.col("loop").alias("b"))
    back = edges.join(ends[0], "child").join(ends[1], "parent").where("a = b AND parent <= child").groupBy(F.col("child").alias("node")).agg(F.collect_set("parent").alias("back_edges"))
    out = placed.join(lists.select("node", "path", "path_anchor"), "node", "left").join(loops, "node", "left").join(back, "node", "left").join(below, "node", "left").join(order, "node", "left").join(_reaching(edges, loops), "node", "left")
    return out.select(
        "component", "node", "loop", "root", "depth", F.when(F.col("depth").isNotNull(), F.col("path")).alias("path"), F.when(F.col("depth").isNotNull(), F.col("path_anchor")).alias("path_anchor"),
        "pre", (F.col("pre") + F.coalesce("descendants", F.lit(0))).alias("post"), F.when(F.col("depth").isNotNull(), F.coalesce("descendants", F.lit(0))).cast("long").alias("descendants"), F.array_sort(F.coalesce("back_edges", F.array().cast("array<long>"))).alias("back_edges"), "below",
    )


def _fresh(df: DataFrame) -> DataFrame:
    """cut, with the optimizer's size estimate forgotten: estimates of joins of a frame with itself multiply in each round, until planning is all that happens."""
    spark, kept = df.sparkSession, cut(df)
    return DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), spark)


def _placed(base: DataFrame) -> DataFrame:
    """base (node, up, ...) with root and depth, by pointer doubling along up; null where that enters a loop."""
    # jump: the node 2**k above or the root; steps: how far that is
    jump = _fresh(base.select("node", F.col("up").alias("above"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("steps")))
    bound = base.count()
    k = 1
    while k < bound and jump.where("above IS NOT NULL").limit(1).count():
        nxt = jump.select(F.col("node").alias("above"), F.col("above").alias("to2"), F.col("steps").alias("s2"))
        prev = fingerprint(jump, "node", "above", "steps")
        jump = _fresh(jump.join(nxt, "above", "left").select("node", F.when(F.col("s2") == 0, F.col("above")).otherwise(F.col("to2")).alias("above"), (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps")))
        if fingerprint(jump, "node", "above", "steps") == prev:
            break
        k *= 2
    roots = base.where("up IS NULL").select(F.col("node").alias("root"))
    placed = jump.join(roots, jump.above == roots.root, "left").select("node", F.when(jump.steps == 0, F.col("node")).otherwise(F.col("root")).alias("root"), F.when((jump.steps == 0) | F.col("root").isNotNull(), F.col("steps")).cast("int").alias("depth"))
    return _fresh(base.join(placed, "node"))


def _path_blocks(placed: DataFrame) -> DataFrame:
    """(node, path, path_anchor, depth, next) of a frame (node, up, depth)."""
    # path blocks: lists of ancestors up to the last depth that PATH_BLOCK divides, doubled
    stop = F.col("depth") % PATH_BLOCK == 0
    lists = _fresh(placed.select("node", F.array("node").alias("path"), F.when(~stop, F.col("up")).alias("next"), F.when(stop, F.col("up")).alias("path_anchor"), "depth"))
    span = 1
    while span < PATH_BLOCK and lists.where("next IS NOT NULL AND depth IS NOT NULL").limit(1).count():
        other = lists.select(F.col("node").alias("next"), F.col("path").alias("p2"), F.col("next").alias("n2"), F.col("path_anchor").alias("a2"))
        lists = _fresh(lists.where("depth IS NOT NULL").join(other, "next", "left").select("node", F.concat(F.coalesce("p2", F.array().cast("array<long>")), "path").alias("path"), F.col("n2").alias("next"), F.coalesce("path_anchor", "a2").alias("path_anchor"), "depth"))
        span *= 2
    return lists


def _reaching(edges: DataFrame, loops: DataFrame) -> DataFrame:
    """(node, below): the number of other nodes that reach each node, as _below counts it, by joins.

    Pairs are made of nodes and the merges under them only, so that trees and chains make none; merges that are above
    merges are joined up by doubling.
    """
    loops = _fresh(loops)
    edges = _fresh(edges.select("child", "parent"))
    ends = edges.select(F.col("child").alias("node")).union(edges.select(F.col("parent").alias("node"))).distinct()
    part = _fresh(ends.join(loops, "node", "left").select("node", F.coalesce("loop", "node").alias("part")))
    links = edges.join(part.toDF("child", "c"), "child").join(part.toDF("parent", "p"), "parent").where("c <> p").select(F.col("c").alias("child"), F.col("p").alias("parent"))
    links = _fresh(links.distinct())
    ups = links.groupBy("child").agg(F.count(F.lit(1)).alias("k"), F.min("parent").alias("p"))
    base = part.groupBy(F.col("part").alias("node")).agg(F.count(F.lit(1)).alias("w")).join(ups.withColumnRenamed("child", "node"), "node", "left")
    placed = _placed(_fresh(base.select("node", "w", "k", F.expr("CASE WHEN k = 1 THEN p END").alias("up"))))
    lists = _fresh(_path_blocks(placed).select("node", "path", "path_anchor").join(placed.select("node", "w"), "node"))
    tree = placed.join(_descendant_counts(lists), "node", "left").select("node", "root", "k", (F.col("w") + F.coalesce("descendants", F.lit(0))).alias("n"))
    tree = _fresh(tree)
    merges = tree.where("k > 1").select(F.col("node").alias("m"), "n")
    ports = _fresh(links.join(merges.select(F.col("m").alias("child")), "child", "left_semi").select(F.col("child").alias("m"), F.col("parent").alias("node")))
    # all nodes between a merge's parents and the heads of their chains, a block of path a round
    over, front = None, ports
    while front.limit(1).count():
        step = front.join(lists, "node")
        named = step.select(F.explode("path").alias("node"), "m")
        over = named if over is None else over.union(named)
        over = _fresh(over.distinct())
        front = _fresh(step.where("path_anchor IS NOT NULL").select("m", F.col("path_anchor").alias("node")).distinct())
    if over is not None:
        # merges under merges
        close = _fresh(over.join(merges.select(F.col("m").alias("node")), "node", "left_semi"))
        size, last = close.count(), -1
        while size != last:
            last = size
            close = _fresh(close.union(close.join(close.toDF("m", "m2"), "m").select("node", F.col("m2").alias("m"))).distinct())
            size = close.count()
        over = over.union(over.join(close.toDF("m", "m2"), "m").select("node", F.col("m2").alias("m"))).distinct()
        more = over.join(merges, "m").groupBy("node").agg(F.sum("n").alias("more"))
        tree = tree.join(more, "node", "left").select("node", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    return part.join(tree.select(F.col("node").alias("part"), "n"), "part").select("node", (F.col("n") - 1).alias("below"))


def _descendant_counts(lists: DataFrame) -> DataFrame:
    """(node, descendants) of nodes that have any, from path blocks (node, path, path_anchor, w); a node counts w.

    A node's descendants are the rows that name it in their own block, and all rows that hang, over any number of blocks,
    under an anchor whose block names it. Chains of anchors are doubled in lists; they are a 256th of the depth.
    """
    own = lists.select("node", "w", F.explode("path").alias("v")).where("node <> v").groupBy("v").agg(F.sum("w").alias("n"))
    hung = lists.where("path_anchor IS NOT NULL").groupBy(F.col("path_anchor").alias("node")).agg(F.sum("w").alias("n"))
    anchors = _fresh(hung.join(lists, "node").select("node", "n", "path", "path_anchor"))
    chains = _fresh(anchors.select("node", "n", F.array("node").alias("chain"), F.col("path_anchor").alias("next")))
    while chains.where("next IS NOT NULL").limit(1).count():
        above = chains.select(F.col("node").alias("next"), F.col("chain").alias("c2"), F.col("next").alias("n2"))
        chains = _fresh(chains.join(above, "next", "left").select("node", "n", F.concat("chain", F.coalesce("c2", F.array().cast("array<long>"))).alias("chain"), F.col("n2").alias("next")))
    total = chains.select(F.explode("chain").alias("node"), "n").groupBy("node").agg(F.sum("n").alias("n"))
    over = anchors.select("node", F.explode("path").alias("v")).join(total, "node").groupBy("v").agg(F.sum("n").alias("n"))
    return own.union(over).groupBy(F.col("v").alias("node")).agg(F.sum("n").alias("descendants"))


def _preorder(placed: DataFrame, lists: DataFrame, below: DataFrame) -> DataFrame:
    """(node, pre): the place of each placed node in a depth-first walk of its tree that takes children by their ids.

    A node comes one after its parent and all that hangs under its smaller siblings; these steps add up along its path.
    Siblings are summed in ranges, so that no parent's children meet in one task.
    """
    size = placed.where("depth > 0").select("node", "up").join(below, "node", "left").select("node", "up", (1 + F.coalesce("descendants", F.lit(0))).alias("n"))
    size = _fresh(size.repartitionByRange("up", "node").withColumn("chunk", F.spark_partition_id()))
    chunks = size.groupBy("up", "chunk").agg(F.sum("n").alias("whole"))
    ahead = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy("node" if c == "n" else "chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = chunks.select("up", "chunk", ahead("whole", "up").alias("earlier"))
    step = size.withColumn("here", ahead("n", "up", "chunk")).join(chunks, ["up", "chunk"]).select(F.col("node").alias("v"), (1 + F.col("here") + F.col("earlier")).alias("step"))
    named = lists.where("depth IS NOT NULL").select("node", "path_anchor", F.explode("path").alias("v")).join(step, "v", "left")
    own = _fresh(named.groupBy("node", "path_anchor").agg(F.coalesce(F.sum("step"), F.lit(0)).alias("pre")))
    chain = _fresh(own.join(own.select(F.col("path_anchor").alias("node")).where("node IS NOT NULL").distinct(), "node", "left_semi").withColumnRenamed("path_anchor", "next"))
    while chain.where("next IS NOT NULL").limit(1).count():
        above = chain.select(F.col("node").alias("next"), F.col("pre").alias("p2"), F.col("next").alias("n2"))
        chain = _fresh(chain.join(above, "next", "left").select("node", (F.col("pre") + F.coalesce("p2", F.lit(0))).alias("pre"), F.col("n2").alias("next")))
    top = chain.select(F.col("node").alias("path_anchor"), F.col("pre").alias("p2"))
    return own.join(top, "path_anchor", "left").select("node", (F.col("pre") + F.coalesce("p2", F.lit(0))).alias("pre"))


def full_paths(rows: DataFrame) -> DataFrame:
    """rows of hierarchy with path from the root on, however deep the node is, and without path_anchor. What comes out has as many ids as the depths of all nodes together."""
    anchors = rows.where("path_anchor IS NOT NULL").select(F.col("path_anchor").alias("node")).distinct()
    chain = _fresh(rows.join(anchors, "node", "left_semi").select("node", "path", F.col("path_anchor").alias("next")))
    while chain.where("next IS NOT NULL").limit(1).count():
        above = chain.select(F.col("node").alias("next"), F.col("path").alias("p2"), F.col("next").alias("n2"))
        chain = _fresh(chain.join(above, "next", "left").select("node", F.concat(F.coalesce("p2", F.array().cast("array<long>")), "path").alias("path"), F.col("n2").alias("next")))
    top = chain.select(F.col("node").alias("path_anchor"), F.col("path").alias("p2"))
    return rows.join(top, "path_anchor", "left").withColumn("path", F.concat(F.coalesce("p2", F.array().cast("array<long>")), "path")).drop("p2", "path_anchor")


def all_descendants(edges: DataFrame) -> DataFrame:
    """(node, below_node) for every node and each other node below it, over all parents, on loops too. What comes out has as many rows as all nodes together have descendants.

    Ways of 1, 2, 4, ... links are doubled, and those of fewer links lengthened by them, so that rounds are logarithmic in
    the depth; the rounds end when there is no longer way or it brings nothing new.
    """
    longer = _fresh(edges.select(F.col("parent").alias("node"), F.col("child").alias("below_node")).distinct())
    seen, size, last = longer, longer.count(), -1
    while size != last:
        on = longer.select(F.col("node").alias("mid"), F.col("below_node").alias("end"))
        longer = _fresh(longer.join(on, F.col("below_node") == F.col("mid")).select("node", F.col("end").alias("below_node")).distinct())
        if not longer.limit(1).count():
            break
        on = longer.select(F.col("node").alias("mid"), F.col("below_node").alias("end"))
        more = seen.join(on, F.col("below_node") == F.col("mid")).select("node", F.col("end").alias("below_node"))
        seen = _fresh(seen.union(longer).union(more).distinct())
        size, last = seen.count(), size
    return seen.where("node <> below_node")


#: Edges of whole components that are climbed together.
CLIMBED = 50_000
#: Rows that a climb hands out at once.
CLIMB_ROWS = 50_000


def climb(child: np.ndarray, unnamed: np.ndarray, parent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (node, above, lvl) of whole components: for each edge a node climbs over, on each of its ways, the end and the number of edges before.

    A way ends before a node it holds already; equal edges make ways of their own. Where unnamed, child is null: such an edge begins
    ways, but leads none on.
    """
    nodes, at = np.unique(np.concatenate([child[~unnamed], parent]), return_inverse=True)
    n, p = len(nodes), at[len(at) - len(parent) :]
    c = np.empty(len(parent), np.int64)
    c[~unnamed], c[unnamed] = at[: len(at) - len(parent)], n + np.arange(unnamed.sum())
    names = np.concatenate([nodes, np.zeros(unnamed.sum(), np.int64)])
    order = np.argsort(c, kind="stable")
    begin, ups = np.searchsorted(c[order], np.arange(len(names) + 1)).tolist(), p[order].tolist()
    out = node, above, lvl = array("q"), array("q"), array("q")

    def batch() -> pa.RecordBatch:
        x, y, z = (np.array(a) for a in out)
        for a in out:
            del a[:]
        return pa.RecordBatch.from_arrays([pa.array(names[x], pa.int64(), mask=x >= n), pa.array(nodes[y], pa.int64()), pa.array(z, pa.int64())], names=["node", "above", "lvl"])

    on = bytearray(len(names))
    for start in np.unique(c).tolist():
        way, nxt = [start], [begin[start]]
        on[start] = 1
        while way:
            i, x = nxt[-1], way[-1]
            if i == begin[x + 1]:
                on[x] = 0
                way.pop()
                nxt.pop()
                continue
            nxt[-1] += 1
            y = ups[i]
            node.append(start)
            above.append(y)
            lvl.append(len(way) - 1)
            if len(node) >= CLIMB_ROWS:
                yield batch()
            if begin[y] < begin[y + 1] and not on[y]:
                on[y] = 1
                way.append(y)
                nxt.append(begin[y])
    yield batch()


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by component: holds whole components of CLIMBED edges, or one larger one."""
    held: list[pa.RecordBatch] = []

    def rows() -> Iterator[pa.RecordBatch]:
        if t := pa.Table.from_batches(held) if held else None:
            yield from climb(t["child"].combine_chunks().fill_null(0).to_numpy(), t["child"].is_null().to_numpy(), t["parent"].to_numpy())
        held.clear()

    for b in batches:
        if not b.num_rows:
            continue
        comp = b.column("component").to_numpy()
        # the last component of b may go on in the next batch
        k = int(np.searchsorted(comp, comp[-1]))
        if sum(x.num_rows for x in held) + k >= CLIMBED and (k or held[-1].column("component")[-1].as_py() != comp[-1]):
            held.append(b.slice(0, k))
            yield from rows()
            b = b.slice(k)
        held.append(b)
    yield from rows()


def climbed(edges: DataFrame, max_component: int = MAX_COMPONENT) -> DataFrame:
    """(node, above, lvl) of edges (child, parent): each node with the end of each edge on all its ways up, and the number of edges before it.

    What a recursive query over the edges with UNION ALL gives: edges that occur several times count so, a way ends before a node it
    holds already, an edge whose child is null begins ways too; edges without a parent have no row. What comes out has as many rows as the ways of all nodes have edges.
    Components are co-located and climbed in a task; those above max_component by doubling: ways of up to 2k edges are ways of k followed by others.
    """
    edges = cut(edges.select("child", "parent").where("parent IS NOT NULL"))
    comps = connected_components(edges.where("child IS NOT NULL")).toDF("parent", "component")
    known = cut(edges.join(comps, "parent", "left").select(F.coalesce("component", "parent").alias("component"), "child", "parent"))
    big = cut(known.groupBy("component").count().where(F.col("count") > max_component).select("component"))
    large = big.count() > 0
    small = known.join(big, "component", "left_anti") if large else known
    # rows are many more than edges, and so the number of tasks doesn't follow the size of the edges
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = small.repartition(parts, "component").sortWithinPartitions("component").mapInArrow(_climb, "node long, above long, lvl long")
    return out.union(_climbed_by_doubling(_fresh(known.join(big, "component", "left_semi").select("child", "parent")), max_component)) if large else out


def _climbed_by_doubling(edges: DataFrame, max_component: int) -> DataFrame:
    """climbed of components too large for one task. Ways hold the nodes they meet on loops only, by which they end."""
    loops = _distributed_loops(edges.where("child IS NOT NULL").distinct(), max_component).select(F.col("node").alias("child"), F.lit(True).alias("looped"))
    met = F.when(F.col("looped"), F.array("child")).otherwise(F.array().cast("array<long>"))
    longest = _fresh(edges.join(loops, "child", "left").select(F.col("child").alias("node"), F.col("parent").alias("above"), F.lit(0).cast("long").alias("lvl"), met.alias("met")))
    parts, links = [longest], 1
    while longest.limit(1).count():
        on = reduce(DataFrame.union, parts).toDF("mid", "end", "lvl2", "met2")
        longer = longest.join(on, F.col("above") == F.col("mid")).where(~F.arrays_overlap("met", "met2"))
        longer = _fresh(longer.select("node", F.col("end").alias("above"), (F.col("lvl") + F.col("lvl2") + 1).alias("lvl"), F.concat("met", "met2").alias("met")))
        parts.append(longer)
        links *= 2
        longest = longer.where(F.col("lvl") == links - 1)
    return reduce(DataFrame.union, parts).select("node", "above", "lvl")


def descendants_of(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node) for every node below each of starts (node), over all parents, by frontier joins; loops end a branch."""
    seen = cut(starts.select(F.col("node").alias("start"), "node").distinct())
    front = seen
    while front.limit(1).count():
        step = edges.join(front, edges.parent == front.node).select("start", F.col("child").alias("node")).distinct()
        front = cut(step.join(seen, ["start", "node"], "left_anti"))
        seen = cut(seen.union(front))
    return seen.where("start <> node")
