"""Near-duplicate vectors by a robust-pruned flat graph on overlapping cluster shards.

Equal vectors of a label become one node with a weight. A sample of nodes gives the shards' centres,
none within range of another, so that a dense group has few of them. Each node is at home in the shard
of its nearest centre and a member of those of the next nearest, so shards overlap. A flat graph is
built in each shard (nearest neighbours, robustly pruned), and the adjacency lists of a node's shards
are united. Every node asks in each shard that may be the home of a node in range: a search from the
medoids, greedily, and once within range expanding through all that is in range. What it finds is
verified by cosine in double precision and counted only where the found node is at home, so shards
give sums and a spanning forest, never pairs.

Dense groups: nodes within half the range's angle of one point are all in range of each other, so such
a cell needs no search inside: its pairs are counted by its weight, and only nodes outside ask there.
Members of a shard and those who ask are cut into parts of at most about PARTS * SHARD, and each group
of rows has one part of both, so no group grows with the data.
"""

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import join_hot, materialize
from helixframe.llm.components import components

#: Nodes at home in a shard, about: large shards are few, so that a node visits few. Drawn nodes, from which centres and cells come, are at most MOST_CENTRES.
SHARD, MOST_CENTRES, VISITS = 6000, 8192, 3
#: Members of a group, or nodes that ask in it, in shards: larger shards are cut.
PARTS = 4
#: Nodes drawn for SHARD nodes, and how many of them must lie together for a cell of their own.
DRAWN, CELL_DRAWN = 4, 8
NEAREST, DEGREE, ALPHA = 48, 16, 1.2
ENTRY_WIDTH, MEDOIDS = 24, 32
#: Nodes this much below the threshold are still expanded.
MARGIN = 0.06


def clean(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec, label, v, good): v in doubles; good if it can link."""
    rows = vectors.select(F.col(id_col).alias("vec"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    nonzero = F.exists("v", lambda x: x != 0)
    return rows.withColumn("good", F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(nonzero, F.lit(False)))


def unit(block: np.ndarray) -> np.ndarray:
    block = block / np.abs(block).max(axis=1, keepdims=True)
    return block / np.sqrt((block * block).sum(axis=1, keepdims=True))


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Angles:
    """Cosines of the range's angle and of its multiples."""

    def __init__(self, threshold: float):
        self.angle = math.acos(min(1.0, max(-1.0, threshold)))
        self.tangent = math.tan(self.angle) if threshold > 0 else math.inf
        self.half, self.wider, self.double = (math.cos(min(math.pi, k * self.angle)) for k in (0.5, 1.5, 2.0))


def thinned(points: np.ndarray, apart: float, most: int) -> list[int]:
    """Places of at most so many points, taken in order, that have a cosine under `apart` to all taken before."""
    taken: list[int] = []
    free = np.ones(len(points), dtype=bool)
    for i in range(len(points)):
        if free[i] and len(taken) < most:
            taken.append(i)
            free &= points @ points[i] < apart
    return taken


def centres_of(nodes: DataFrame, angles: Angles, threshold: float) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """By label and length, the centres of shards and those of cells, from about DRAWN nodes of each SHARD with the smallest hashes; at most MOST_CENTRES in all.

    The mean of the drawn nodes in range of one of them makes a cell if CELL_DRAWN of them are within
    half the range's angle of it, the fullest first. Of the drawn nodes outside all cells, one for SHARD nodes is a centre.
    """
    counts = nodes.groupBy("label", F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    scale = F.least(F.lit(1.0), F.lit(MOST_CENTRES / (2 * DRAWN)) * SHARD / F.sum("n").over(Window.partitionBy(F.lit(1))))
    parts = materialize(counts.withColumn("scale", scale).select("label", "size", "n", (DRAWN * F.ceil(F.col("n") / SHARD) * F.col("scale") / F.col("n")).alias("part")))
    chance = F.pmod(F.xxhash64("label", "v", F.lit("centre")), F.lit(1 << 40)) / float(1 << 40)
    drawn = join_hot(nodes.withColumn("size", F.size("v")), parts, ["label", "size"], "n", ["node"]).where(chance < F.col("part"))
    rows = drawn.orderBy(chance, "node").limit(MOST_CENTRES).select("label", "v", "n").collect()
    out: dict = {}
    for r in rows:
        out.setdefault((r["label"], len(r["v"])), []).append(r)
    for key, own in out.items():
        points = unit(np.array([r["v"] for r in own]))
        middles = np.concatenate([unit((points[i : i + 512] @ points.T >= threshold) @ points) for i in range(0, len(points), 512)])
        together = np.concatenate([(middles[i : i + 512] @ points.T >= angles.half).sum(axis=1) for i in range(0, len(points), 512)])
        full = np.argsort(-together, kind="stable")[: np.count_nonzero(together >= CELL_DRAWN)]
        cells = middles[full][thinned(middles[full], angles.half, len(full))]
        outside = points[(points @ cells.T < angles.half).all(axis=1)] if len(cells) else points
        centres = outside[thinned(outside, threshold, math.ceil(own[0]["n"] / SHARD))]
        out[key] = (centres if len(centres) else points[:1], cells)
    return out


def visits_among(centres: int, least: int) -> int:
    """Shards that a node visits at most. Their share falls but their number grows with the centres: in 64 dimensions, links at 0.93 have their home among so many for 95 % or more of 10 to 4000 centres."""
    return max(least, math.ceil(centres**0.42))


def assign(nodes: DataFrame, centres: dict, visits: int, angles: Angles) -> DataFrame:
    """(shard, node, weight, v, home, member, asks, cell) of each node's shards. Labels without a centre are one shard.

    A node in a cell is at home in the cell's shard and asks elsewhere only. Others are at home with
    their nearest centre and members of the nearest `visits`. A node asks in the shards of the nearest
    centres and of all within twice the range's angle; but not where, by the distance of the centres,
    no node in range can be at home; and in cells with a centre within 1.5 times the angle.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(centres)
    kind = "shard string, node long, weight long, v array<double>, home boolean, member boolean, asks boolean, cell string"

    def run(batches):
        for batch in batches:
            labels, sizes = batch.column(2).to_pylist(), [len(v) for v in batch.column(3)]
            groups: dict = {}
            for i, key in enumerate(zip(labels, sizes, strict=True)):
                groups.setdefault(key, []).append(i)
            at, shards, flags, in_cell = [], [], [], []

            def add(i: int, shard: str, home: bool, member: bool, asks: bool, cell: str | None) -> None:
                at.append(i)
                shards.append(shard)
                flags.append((home, member, asks))
                in_cell.append(cell)

            for (label, size), rows in groups.items():
                name = f"{label}/{size}/"
                if (label, size) not in shared.value:
                    for i in rows:
                        add(i, name, True, True, True, None)
                    continue
                middle, cells = shared.value[label, size]
                v = unit(matrix(batch.column(3).take(pa.array(rows))))
                close, apart = v @ middle.T, np.sqrt(np.maximum(0, 2 - 2 * middle @ middle.T))
                order = np.argsort(-close, axis=1, kind="stable")
                to_cells = v @ cells.T if len(cells) else np.full((len(rows), 1), -2.0)
                cell_of = to_cells.argmax(axis=1)
                inside = to_cells.max(axis=1) >= angles.half + 1e-9
                many = visits_among(len(middle), visits)
                for r, i in enumerate(rows):
                    own = f"{name}cell {cell_of[r]}" if inside[r] else None
                    if own:
                        add(i, own, True, True, False, own)
                    for c in np.flatnonzero(to_cells[r] >= angles.wider - 1e-9).tolist() if len(cells) else []:
                        if not (inside[r] and c == cell_of[r]):
                            add(i, f"{name}cell {c}", False, False, True, own)
                    best = order[r, 0]
                    reach = np.count_nonzero(close[r] >= angles.double - 1e-9)
                    for k, c in enumerate(order[r, : max(many, reach)].tolist()):
                        if close[r, best] - close[r, c] <= angles.tangent * apart[best, c] + 1e-9:
                            add(i, name + str(c), not own and k == 0, not own and k < visits, True, own)
            take, flags = pa.array(at, pa.int64()), np.array(flags, dtype=bool).reshape(-1, 3)
            columns = [pa.array(shards, pa.string()), *[batch.column(k).take(take) for k in (0, 1, 3)], *[pa.array(c) for c in flags.T], pa.array(in_cell, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "node", "weight", "v", "home", "member", "asks", "cell"])

    return nodes.select("node", "weight", "label", "v").mapInArrow(run, kind)


def parted(assigned: DataFrame) -> DataFrame:
    """Adds the part of the shard's members and of those who ask, and their numbers, to rows of shards where some ask."""
    parts = lambda flag: F.ceil(F.count_if(flag) / (PARTS * SHARD)).cast("int")
    sizes = materialize(assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), parts("member").alias("m_parts"), parts("asks").alias("a_parts")).where("m_parts > 0 and a_parts > 0"))
    rows = join_hot(assigned, sizes, ["shard"], "rows", ["node"])
    part = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    return rows.withColumn("m_part", part("m_parts", "m")).withColumn("a_part", part("a_parts", "a"))


def groups_of(rows: DataFrame) -> DataFrame:
    """(shard, m, a, node, weight, v, home, near, member, asks): each part of members with each part of those who ask; a node that is both in a group is one row."""
    columns = ["node", "weight", "v", "home", "near"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.where("member").withColumn("a", every("a_parts")).select("shard", F.col("m_part").alias("m"), "a", *columns, F.lit(True).alias("member"), (F.col("asks") & (F.col("a") == F.col("a_part"))).alias("asks"))
    asking = rows.where("asks").withColumn("m", every("m_parts")).where(~(F.col("member") & (F.col("m") == F.col("m_part"))))
    asking = asking.select("shard", "m", F.col("a_part").alias("a"), *columns, F.lit(False).alias("member"), F.lit(True).alias("asks"))
    return members.unionByName(asking)


def robust_prune(v: np.ndarray, near: np.ndarray, i: int) -> list[int]:
    """Of i's nearest nodes, those that no kept one is nearer to by a factor."""
    left, kept = near.tolist(), []
    to_i = dict(zip(left, (1 - v[near] @ v[i]).tolist(), strict=True))
    while left and len(kept) < DEGREE:
        best = left.pop(0)
        kept.append(best)
        if left:
            far = 1 - v[left] @ v[best]
            left = [j for j, d in zip(left, far.tolist(), strict=True) if ALPHA * d > to_i[j]]
    return kept


def build(table: pa.Table) -> pa.Table:
    """(node, near): the pruned neighbours of each node of a part."""
    table = table.sort_by("node")
    nodes, v = table["node"].to_numpy(), unit(matrix(table["v"]))
    near_to = []
    for start in range(0, len(v), 512):
        close = v[start : start + 512] @ v.T
        close[np.arange(len(close)), np.arange(start, start + len(close))] = -2
        k = min(NEAREST, len(v) - 1)
        top = np.argpartition(-close, k - 1, axis=1)[:, :k] if k else np.zeros((len(close), 0), dtype=int)
        order = np.argsort(-np.take_along_axis(close, top, axis=1), axis=1, kind="stable")
        top = np.take_along_axis(top, order, axis=1)
        near_to += [nodes[robust_prune(v, top[i], start + i)].tolist() for i in range(len(close))]
    return pa.table({"node": pa.array(nodes), "near": pa.array(near_to, pa.list_(pa.int64()))})


def places_of(near, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists of nodes, the owner and the place among nodes of each that is there."""
    near = near.combine_chunks()
    lengths = np.array([len(x or ()) for x in near.to_pylist()], dtype=int) if near.null_count else np.diff(near.offsets.to_numpy())
    values = near.flatten().to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(nodes, values), len(nodes) - 1)
    here = nodes[at] == values  # others belong to other shards of the node
    return np.repeat(np.arange(len(near)), lengths)[here], at[here]


def both_ways(owner: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours both ways, as starts and places: those of node i are places[starts[i] : starts[i + 1]]."""
    pairs = np.unique(np.concatenate([owner * n + place, place * n + owner]))
    return np.searchsorted(pairs, np.arange(n + 1) * n), pairs % n


def medoids_of(v: np.ndarray) -> np.ndarray:
    """Medoids of MEDOIDS groups about evenly dealt nodes."""
    seeds = np.unique(np.linspace(0, len(v) - 1, min(MEDOIDS, len(v))).astype(int))
    group = (v @ v[seeds].T).argmax(axis=1)
    return np.unique([rows[(v[rows] @ v[rows].mean(axis=0)).argmax()] for rows in (np.flatnonzero(group == g) for g in np.unique(group))])


def in_range(v: np.ndarray, starts: np.ndarray, places: np.ndarray, entries: np.ndarray, point: np.ndarray, threshold: float, seen: np.ndarray) -> np.ndarray:
    """Nodes within range of a point that the search from the entries reaches; seen is scratch space, all False before and after."""
    seen[entries] = True
    touched = [entries]
    heap = [(-c, i) for c, i in zip((v[entries] @ point).tolist(), entries.tolist(), strict=True)]
    heapq.heapify(heap)
    best = [-c for c, _ in heap]
    heapq.heapify(best)
    while heap:  # greedy, while the nearest unexpanded node is among the ENTRY_WIDTH nearest
        cosine, i = heapq.heappop(heap)
        if -cosine >= threshold - MARGIN or len(best) >= ENTRY_WIDTH and -cosine < best[0]:
            break
        new = places[starts[i] : starts[i + 1]]
        new = new[~seen[new]]
        if len(new):
            seen[new] = True
            touched.append(new)
            for c, j in zip((v[new] @ point).tolist(), new.tolist(), strict=True):
                if len(best) < ENTRY_WIDTH or c > best[0]:
                    heapq.heappush(heap, (-c, j))
                    heapq.heappush(best, c)
                    if len(best) > ENTRY_WIDTH:
                        heapq.heappop(best)
    near = np.concatenate(touched)
    cosines = v[near] @ point
    found, wave = [near[cosines >= threshold]], near[cosines >= threshold - MARGIN]
    many = len(found[0])
    while len(wave):  # range-expanding
        if many > max(256, len(v) // 8):  # a dense part: what is left of it is verified at once
            found = [np.flatnonzero(v @ point >= threshold)]
            break
        new = np.concatenate([places[starts[i] : starts[i + 1]] for i in wave.tolist()])
        new = np.unique(new[~seen[new]])
        seen[new] = True
        touched.append(new)
        cosines = v[new] @ point
        found.append(new[cosines >= threshold])
        many += len(found[-1])
        wave = new[cosines >= threshold - MARGIN]
    for x in touched:
        seen[x] = False
    return np.concatenate(found)


def search(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """(node, n, other): what each asking node finds at home here, by weight, and links of a spanning forest (n 0)."""
        members, asking = table.filter(table["member"]).sort_by("node"), table.filter(table["asks"])
        nodes, v = members["node"].to_numpy(), unit(matrix(members["v"])) if len(members) else np.zeros((0, 1))
        out: list[tuple[int, int, int | None]] = []
        if len(nodes) and len(asking):
            weight, home = members["weight"].to_numpy(), members["home"].to_numpy(zero_copy_only=False)
            starts, places = both_ways(*places_of(members["near"], nodes), len(nodes))
            ids, points = asking["node"].to_numpy(), unit(matrix(asking["v"]))
            own = np.minimum(np.searchsorted(nodes, ids), len(nodes) - 1)
            own = np.where(nodes[own] == ids, own, -1)
            owner, known = places_of(asking["near"], nodes)
            known = np.split(known, np.searchsorted(owner, np.arange(1, len(ids))))
            medoids = medoids_of(v)
            close = points @ v[medoids].T
            nearest = medoids[np.argsort(-close, axis=1, kind="stable")[:, :3]]
            seen = np.zeros(len(nodes), dtype=bool)
            root: dict[int, int] = {}

            def top(i: int) -> int:
                while root.setdefault(i, i) != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for q in range(len(ids)):
                entries = np.unique(np.concatenate([nearest[q], known[q], own[q : q + 1] if own[q] >= 0 else own[:0]]))
                found = in_range(v, starts, places, entries, points[q], threshold, seen)
                found = found[home[found] & (found != own[q])]
                if len(found):
                    me = int(ids[q])
                    out.append((me, int(weight[found].sum()), None))
                    for other in nodes[found].tolist():
                        a, b = top(other), top(me)
                        if a != b:
                            root[a] = b
                            out.append((me, 0, other))
        return pa.table({"node": pa.array([x for x, _, _ in out], pa.int64()), "n": pa.array([n for _, n, _ in out], pa.int64()), "other": pa.array([x for _, _, x in out], pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, visits: int = VISITS) -> DataFrame:
    """One row per row of vectors: vec, n_links, component, kept.

    Vectors link when their labels are equal and not null and their cosine is at least threshold.
    n_links counts the other rows linked directly, equal ones included; component is the least id
    reachable, kept marks it. Null and zero vectors and those with null or non-finite components link
    with nothing; so do vectors of unequal length. Rows that share an id are vectors of their own, which
    its component then names alike. A null id links like others and names a component (null) only where
    it has no other id. An empty table gives an empty one; other columns of vectors are not read.
    The search is approximate; audit() measures its recall.
    """
    angles = Angles(threshold)
    rows = clean(vectors, id_col, vector_col, label_col)
    nodes = rows.where("good").groupBy("label", "v").agg(F.min("vec").alias("least"), F.count(F.lit(1)).alias("weight"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    assigned = materialize(assign(nodes, centres_of(nodes, angles, threshold), visits, angles))
    placed = materialize(parted(assigned))
    lists = placed.where("member").select("shard", "m_part", "node", "v").groupBy("shard", "m_part").applyInArrow(build, "node long, near array<long>")
    graph = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # as many lists as a node has parts
    searched = groups_of(placed.join(graph, "node", "left")).groupBy("shard", "m", "a").applyInArrow(search(threshold), "node long, n long, other long")
    searched = materialize(searched)

    cells = assigned.where("home and cell is not null").select("cell", "node", "weight")
    of_cell = cells.groupBy("cell").agg(F.sum("weight").alias("all"), F.min("node").alias("hub"))  # as few as cells
    in_cell = cells.join(F.broadcast(of_cell), "cell").select("node", (F.col("all") - F.col("weight")).alias("n"), F.col("hub").alias("other"))
    searched = searched.unionByName(in_cell)
    links = searched.groupBy("node").agg(F.sum("n").alias("n"))
    known = components(searched.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))

    named = nodes.select("node", "least").join(known, "node")
    least = materialize(named.groupBy("component").agg(F.min("least").alias("name"), F.count(F.lit(1)).alias("size")))
    named = join_hot(named.select("node", "component"), least, ["component"], "size", ["node"]).select("node", "name")
    found = nodes.join(links, "node", "left").join(named, "node", "left")
    found = materialize(found.select("label", "v", "weight", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("name", "least").alias("name")))
    good = join_hot(rows.where("good").select("vec", "label", "v"), found, ["label", "v"], "weight", ["vec"], few=None)
    good = good.select("vec", (F.col("weight") - 1 + F.col("n")).alias("n_links"), F.coalesce("name", "vec").alias("component"))
    alone = rows.where("not good").select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component"))
    return good.unionByName(alone).withColumn("kept", F.col("vec").eqNullSafe(F.col("component")))


def audit(vectors: DataFrame, linked: DataFrame, queries: int = 200, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> float:
    """Recall: links found of links there are, for about so many rows chosen by hash, against all rows. Ids must differ."""
    rows = clean(vectors, id_col, vector_col, label_col).where("good").select("vec", "label", "v")
    chosen = rows.orderBy(F.xxhash64("vec", F.lit("audit"))).limit(queries).collect()
    points = {}
    for r in chosen:
        points.setdefault((r["label"], len(r["v"])), []).append((r["vec"], r["v"]))
    shared = vectors.sparkSession.sparkContext.broadcast(points)

    def count(batches):
        for batch in batches:
            groups: dict = {}
            for vec, label, v in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                groups.setdefault((label, len(v)), []).append((vec, v))
            ids, counts = [], []
            for key, here in groups.items():
                asked = shared.value.get(key, [])
                if asked:
                    hit = unit(np.array([p for _, p in asked])) @ unit(np.array([v for _, v in here])).T >= threshold
                    hit &= np.array([i for i, _ in asked])[:, None] != np.array([i for i, _ in here])
                    ids += [i for i, _ in asked]
                    counts += hit.sum(axis=1).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], names=["vec", "n"])

    there = rows.mapInArrow(count, "vec long, n long").groupBy("vec").agg(F.sum("n").alias("there"))
    both = there.join(linked.select("vec", "n_links"), "vec").agg(F.sum(F.least("n_links", "there")), F.sum("there")).first()
    return 1.0 if not both[1] else both[0] / both[1]
