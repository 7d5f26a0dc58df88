"""Embedding near-duplicates by an epsilon grid order join inside labels.

Vectors are projected on leading principal directions, put in the lexicographic order of their grid cells of side epsilon,
and cut into blocks of consecutive vectors. Pairs of blocks whose boxes lie more than epsilon apart are skipped; the others
are joined recursively: an interval is halved until it is small, and pairs of intervals that are provably distant are left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.llm.common import components, shuffle_parts, spanning, stage

#: Leading directions of the grid and of the boxes; vectors that the directions are fitted on (a bounded hashed sample:
#: any orthonormal directions give the same links, good ones skip more).
DIRECTIONS, FIT_ON = 8, 20_000
LEAF = 256


def directions(vectors: np.ndarray, k: int) -> np.ndarray:
    """Columns: at most k leading principal directions, orthonormal."""
    if not len(vectors):
        return np.zeros((0, 0))
    _, vecs = np.linalg.eigh(np.cov(vectors.T, bias=True).reshape(vectors.shape[1], -1))
    return vecs[:, ::-1][:, :k]


class Links:
    """Links of a pair of blocks: how many each vector has, and edges that connect what is linked (a spanning forest)."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n, self.root = ids, np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def add(self, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> None:
        np.add.at(self.n, a, weight[b])
        np.add.at(self.n, b, weight[a])
        # of links to the same vector in this batch one star is enough to connect them
        for i, j in {(int(x), int(y)) for x, y in zip(*spanning(a, b), strict=True)}:
            x, y = self.find(i), self.find(j)
            if x != y:
                self.root[max(x, y)] = min(x, y)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        top = np.asarray([self.find(i) for i in range(len(self.root))])
        moved = top != np.arange(len(top))
        return self.ids[moved], self.ids[top[moved]]


def ego_join(unit: np.ndarray, grid: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, epsilon: float, cosine: float, links: Links, weight: np.ndarray) -> None:
    """Recursive join of two sequence intervals (row numbers in grid order) of unit vectors with their leading coordinates."""
    if not len(left) or not len(right):
        return
    low = np.maximum(grid[left].min(axis=0), grid[right].min(axis=0))
    high = np.minimum(grid[left].max(axis=0), grid[right].max(axis=0))
    gap = np.maximum(low - high, 0)
    if float(gap @ gap) > epsilon * epsilon:
        return
    if len(left) <= LEAF and len(right) <= LEAF:
        a, b = np.nonzero(unit[left] @ unit[right].T >= cosine)
        a, b = left[a], right[b]
        if same:
            a, b = a[a < b], b[a < b]
        if len(a):
            links.add(a, b, weight)
        return
    l, r = len(left) // 2, len(right) // 2
    if same:
        ego_join(unit, grid, left[:l], left[:l], True, epsilon, cosine, links, weight)
        ego_join(unit, grid, left[l:], left[l:], True, epsilon, cosine, links, weight)
        ego_join(unit, grid, left[:l], left[l:], False, epsilon, cosine, links, weight)
        return
    for x in (left[:l], left[l:]) if len(left) > LEAF else (left,):
        for y in (right[:r], right[r:]) if len(right) > LEAF else (right,):
            ego_join(unit, grid, x, y, False, epsilon, cosine, links, weight)


#: Leading directions whose cells are keys of the join of blocks, at most.
KEYS = 4


def _close_blocks(boxes: DataFrame, k: int, epsilon: float) -> DataFrame:
    """(x, y), x <= y: blocks of one label whose boxes(label, block, lo0.., hi0..) are at most epsilon apart.

    Blocks follow the grid order, so the more there are, the fewer cells of the leading directions one covers: with ten times
    the blocks, one direction more becomes a key. A block meets those that cover a cell of its own or a neighbouring one in
    each of these directions, and a pair meets once, in the first cell that both cover.
    """
    depth = F.least(F.floor(F.log10("n")), F.lit(min(k, KEYS)))
    many = boxes.groupBy("label").agg(F.count("*").alias("n"))
    boxes = boxes.join(many, "label").withColumn("depth", depth)
    cell = lambda x: F.floor(F.col(x) / epsilon).cast("long")
    none = F.lit(0).cast("long")

    def covered(side: str, more: int) -> DataFrame:
        out = boxes
        for i in range(min(k, KEYS)):
            low, high = F.when(F.col("depth") > i, cell(f"lo{i}") - more).otherwise(none), F.when(F.col("depth") > i, cell(f"hi{i}") + more).otherwise(none)
            out = out.withColumn(f"from{i}", low).withColumn(f"c{i}", F.explode(F.sequence(low, high)))
        names = [c for c in out.columns if c not in ("label", "n", "depth") and not (c[0] == "c" and c[1:].isdigit())]
        return out.select("label", *[f"c{i}" for i in range(min(k, KEYS))], *[F.col(c).alias(f"{side}_{c}") for c in names])

    keys = ["label", *[f"c{i}" for i in range(min(k, KEYS))]]
    both = covered("a", 1).join(covered("b", 0), keys).where("a_block <= b_block")
    for i in range(min(k, KEYS)):
        both = both.where(F.col(f"c{i}") == F.greatest(f"a_from{i}", f"b_from{i}"))
    apart = F.lit(0.0)
    for i in range(k):
        gap = F.greatest(F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}"), F.lit(0.0))
        apart = apart + gap * gap
    return both.where(apart <= epsilon * epsilon).select(F.col("a_block").alias("x"), F.col("b_block").alias("y"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: rows of one label link when their cosine is at least `cosine`.

    Equal vectors of a label form a class that is joined once, with its size as weight; links of all
    its members are counted, and no pair of copies is made. Pairs of blocks give counts and a spanning forest, not pairs.
    Vectors that are null, empty, zero, or that hold null or non-finite components link with nothing, as do rows with a null
    label or id; such a row is its own component, and component_id is null for a null id. Vectors of different lengths do not
    link with each other; those of one length do, whichever it is. Repeated ids link with each other as other rows do. An empty table gives none.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.where("vec_id is not null and label is not null").where(sound)
    classes = good.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    # ids may repeat, so classes have numbers of their own, fixed as they are written
    classes = stage(classes.withColumn("rep", F.monotonically_increasing_id()), "ego-classes")
    n = classes.count()
    sample = classes.where(F.pmod(F.xxhash64("id", "label"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, FIT_ON / max(n, 1)))).select("v").limit(2 * FIT_ON).toPandas().v
    dims = sample.map(len).mode()
    axes = directions(np.asarray([_unit(np.asarray(x)) for x in sample if len(x) == dims[0]]), DIRECTIONS) if len(sample) else np.zeros((0, 0))
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * cosine))) * (1 + 1e-9) + 1e-12
    fitted = spark.sparkContext.broadcast(axes)

    def place(frames):
        for pdf in frames:
            axes = fitted.value
            at = [(_unit(np.asarray(v)) @ axes).tolist() if len(v) == len(axes) else [0.0] * axes.shape[1] for v in pdf.v]
            yield pdf.assign(at=at, cell=[[int(np.floor(x / epsilon)) for x in p] for p in at])

    placed = classes.select("label", "v", "rep", "copies").mapInPandas(place, "label string, v array<double>, rep long, copies long, at array<double>, cell array<int>")
    parts = max(1, min(shuffle_parts(spark), -(-n // block)))
    ordered = placed.repartitionByRange(parts, "label", "cell", "rep").sortWithinPartitions("label", "cell", "rep")

    def cut(frames):
        from pyspark import TaskContext

        task, made, now, held = TaskContext.get().partitionId() << 32, 0, None, 0
        for pdf in frames:
            ids = []
            for label in pdf.label:
                if label != now or held >= block:
                    now, held, made = label, 0, made + 1
                held += 1
                ids.append(task + made)
            yield pdf.drop(columns=["cell"]).assign(block=ids)

    blocks = stage(ordered.mapInPandas(cut, "label string, v array<double>, rep long, copies long, at array<double>, block long"), "ego-blocks")
    k = axes.shape[1] if axes.size else 0
    boxes = blocks.groupBy("label", "block").agg(F.count("*").alias("rows"), *[F.min(F.col("at")[i]).alias(f"lo{i}") for i in range(k)], *[F.max(F.col("at")[i]).alias(f"hi{i}") for i in range(k)])
    close = _close_blocks(boxes, k, epsilon)
    close = stage(close, "ego-pairs")
    sides = close.select("x", "y", F.col("x").alias("block")).unionByName(close.where("x <> y").select("x", "y", F.col("y").alias("block")))
    dealt = blocks.drop("label").join(sides, "block")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out_links, edges = [], []
        for _, pdf in pdf.groupby(pdf.v.map(len)):
            pdf = pdf.sort_values(["block", "rep"]).reset_index(drop=True)
            order = np.lexsort(np.floor(np.stack(pdf["at"].to_numpy()) / epsilon).T[::-1]) if len(pdf["at"].iloc[0]) else np.arange(len(pdf))
            pdf = pdf.iloc[order].reset_index(drop=True)
            unit, grid = np.stack([_unit(np.asarray(v)) for v in pdf.v]), np.stack(pdf["at"].to_numpy())
            if not grid.size:
                grid = np.zeros((len(pdf), 1))
            found, weight = Links(pdf.rep.to_numpy()), pdf.copies.to_numpy()
            first = np.flatnonzero((pdf.block == pdf.x).to_numpy())
            if (pdf.x == pdf.y).all():
                ego_join(unit, grid, first, first, True, epsilon, cosine, found, weight)
            else:
                ego_join(unit, grid, first, np.flatnonzero((pdf.block != pdf.x).to_numpy()), False, epsilon, cosine, found, weight)
            out_links.append(pd.DataFrame({"rep": found.ids, "n": found.n, "to": None}))
            u, v = found.edges()
            edges.append(pd.DataFrame({"rep": u, "n": 0, "to": v}))
        out = pd.concat([*out_links, *edges], ignore_index=True)
        return out[(out.n > 0) | out.to.notna()].astype({"to": "Int64"})

    found = stage(dealt.groupBy("x", "y").applyInPandas(join, "rep long, n long, to long"), "ego-links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts_of = components(found.where("to is not null").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    own = parts_of.withColumnRenamed("node", "rep")
    lowest = own.join(classes.select("rep", "id"), "rep").groupBy("component").agg(F.min("id").alias("lowest"))
    per_class = classes.join(counts, "rep", "left").join(own.join(lowest, "component").select("rep", "lowest"), "rep", "left")
    per_class = per_class.select("label", "v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("lowest", "id").alias("component_id"))
    linked = good.join(per_class, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("vec_id").isNull() | F.col("label").isNull() | ~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _unit(v: np.ndarray) -> np.ndarray:
    scale = np.abs(v).max()
    v = v / scale
    return v / np.sqrt(v @ v)
