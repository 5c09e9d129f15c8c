"""Embedding near-duplicates by a forest of random-projection trees with spill overlap."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import bounded_sample, cut, ship
from leafmill.llm.components import connected_components


#: Random directions tried at a node; the one with the fewest sample rows near its split point is taken.
PICKS = 4
#: Leaf codes from here on stand for leaves that cannot be split any more.
CLOSED = 1 << 62

#: ``nodes[node] = (threshold, pick)``; nodes are numbered as in a heap from 1.
Nodes = dict[int, tuple[float, int]]


@dataclass
class Forest:
    """Split points of each tree: ``splits[label][tree]``.

    Directions are not stored: those of a node are drawn anew from its number, its pick and its tree's number.
    """

    splits: dict[str, list[Nodes]]
    trees: int
    width: float
    seed: int

    def spill(self, size: int) -> float:
        """Distance from a split point within which vectors of ``size`` numbers go both ways."""
        return self.width / size**0.5


@lru_cache(maxsize=100_000)
def direction(seed: int, tree: int, node: int, pick: int, size: int) -> np.ndarray:
    v = np.random.default_rng((seed, tree, node, pick, size)).normal(size=size)
    return v / np.linalg.norm(v)


def unit(vectors: list) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows that can link, as unit vectors in double precision, and which rows these are.

    Left out: null vectors, zero vectors, those with null or non-finite components, empty ones.
    """
    rows, keep = [], []
    for i, v in enumerate(vectors):
        if v is None or not len(v):
            continue
        try:
            x = np.asarray(v, dtype=np.float64)
        except (TypeError, ValueError):
            continue
        top = np.abs(x).max()
        if np.isfinite(top) and top > 0:
            x = x / top  # very large and very small vectors keep a finite norm
            rows.append(x / np.sqrt(x @ x))
            keep.append(i)
    return rows, np.array(keep, dtype=np.int64)


def grow(x: np.ndarray, forest: Forest, tree: int, root: int, stop: float, least: int) -> list[tuple[int, float, int]]:
    """``(node, threshold, pick)`` of the splits below ``root``, at medians of projections of the sample rows ``x``.

    A node is split while it has ``least`` rows and more than ``stop``.
    """
    out = []
    size = x.shape[1]
    spill = forest.spill(size)
    todo = [(root, np.arange(len(x)))]
    while todo:
        node, own = todo.pop()
        if len(own) < max(least, 2) or len(own) <= stop or node >= 1 << 46:
            continue
        tried = []
        for pick in range(PICKS):
            at = x[own] @ direction(forest.seed, tree, node, pick, size)
            middle = float(np.median(at))
            tried.append((int((np.abs(at - middle) < spill).sum()), pick, middle, at))
        _, pick, middle, at = min(tried, key=lambda t: t[:2])
        left, right = own[at < middle + spill], own[at >= middle - spill]
        if max(len(left), len(right)) > 0.9 * len(own):
            continue  # one crowd: the leaf stays together and is compared block by block
        out.append((node, middle, pick))
        todo += [(2 * node, left), (2 * node + 1, right)]
    return out


def walk(x: np.ndarray, forest: Forest, tree: int, root: int, nodes: Nodes) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves below ``root`` with the rows of ``x`` that come to them."""
    spill = forest.spill(x.shape[1])
    todo = [(root, np.arange(len(x)))]
    while todo:
        node, own = todo.pop()
        if node not in nodes:
            yield node, own
            continue
        middle, pick = nodes[node]
        at = x[own] @ direction(forest.seed, tree, node, pick, x.shape[1])
        left, right = own[at < middle + spill], own[at >= middle - spill]
        todo += [(n, some) for n, some in ((2 * node, left), (2 * node + 1, right)) if len(some)]


def fit_forest(sample: DataFrame, share: float, trees: int, leaf_rows: int, least: int, width: float, seed: int) -> Forest:
    """The upper levels of all trees, from a bounded sample, ``share`` of all rows.

    A node is split while it stands for more than ``leaf_rows`` rows and has ``least`` rows
    of the sample, so the forest that reaches the driver is bounded as the sample is.
    """
    plain = Forest({}, trees, width, seed)

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rows, _ = unit(list(part["embedding"]))
        by_size: dict[int, list] = {}
        for r in rows:
            by_size.setdefault(len(r), []).append(r)
        x = np.array(max(by_size.values(), key=len)) if by_size else np.zeros((0, 1))
        found = grow(x, plain, int(key[1]), 1, leaf_rows * share, least)
        return pd.DataFrame([(key[0], key[1], *f) for f in found], columns=["label", "tree", "node", "threshold", "pick"])

    copies = sample.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    found = copies.groupBy("label", "tree").applyInPandas(fit, "label string, tree int, node long, threshold double, pick int").collect()
    splits: dict[str, list[Nodes]] = {}
    for r in found:
        splits.setdefault(r["label"], [{} for _ in range(trees)])[r["tree"]][r["node"]] = (r["threshold"], r["pick"])
    return Forest(splits, trees, width, seed)


def leaves(forest: Forest, label: str, x: np.ndarray) -> list[list[int]]:
    """Leaf codes of each row of ``x``, of all trees, ascending. A label without splits has one leaf a tree."""
    out: list[list[int]] = [[] for _ in range(len(x))]
    trees = forest.splits.get(label)
    for t in range(forest.trees):
        for node, own in walk(x, forest, t, 1, trees[t] if trees else {}):
            for i in own:
                out[i].append((t << 48) | node)
    for codes in out:
        codes.sort()
    return out


def narrow_leaves(routed: DataFrame, forest: Forest, leaf_rows: int, least: int, leaf_sample: int) -> DataFrame:
    """``routed`` with ``codes`` of leaves that hold at most ``2 * leaf_rows`` rows, crowds apart.

    Leaves that are still wider get split points from about ``leaf_sample`` of their own rows, in
    tasks of their own, and their rows go on from there, at most about ``leaf_sample`` a task;
    again until no leaf is left that splits. Every round divides leaves by ``leaf_sample / least``
    or down to ``leaf_rows``, so rounds grow with the logarithm of the table. Nothing but the question whether a wide leaf is left
    reaches the driver. The input comes back as it is if no leaf is wide.
    """
    row, key = ["label", "size", "digest"], ["label", "size", "leaf"]
    plain = Forest({}, forest.trees, forest.width, forest.seed)
    vectors = routed.select(*row, "vector")
    slim = routed.select(*row, F.explode("codes").alias("leaf"))
    node_of = (1 << 48) - 1

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(v) for v in part["vector"]])
        rows, leaf = int(part["rows"].iloc[0]), int(key[2])
        found = grow(x, plain, leaf >> 48, leaf & node_of, leaf_rows * min(1.0, len(x) / rows), least)
        return pd.DataFrame([(*key, *f) for f in found], columns=["label", "size", "leaf", "node", "threshold", "pick"])

    def step(key: tuple, part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        leaf = int(key[2])
        nodes = {int(n): (float(t), int(p)) for n, t, p in zip(found["node"], found["threshold"], found["pick"], strict=True)}
        if part.empty:
            return part[["label", "size", "digest", "leaf"]]
        if not nodes:
            return part[["label", "size", "digest"]].assign(leaf=leaf | CLOSED)
        x = np.stack([np.frombuffer(v) for v in part["vector"]])
        moved = [part.iloc[own][["label", "size", "digest"]].assign(leaf=(leaf >> 48 << 48) | n) for n, own in walk(x, plain, leaf >> 48, leaf & node_of, nodes)]
        return pd.concat(moved)

    narrowed = False
    while True:
        wide = slim.where(F.col("leaf") < CLOSED).groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 2 * leaf_rows)
        wide = cut(wide.withColumn("tiles", F.ceil(F.col("rows") / leaf_sample).cast("int")))
        if wide.isEmpty():
            break
        narrowed = True
        inside = slim.join(wide, key)
        scale = 1 << 30
        picked = inside.where(F.pmod(F.xxhash64(F.lit(forest.seed), "digest"), F.lit(scale)) < F.lit(scale * leaf_sample) / F.col("rows"))
        schema = "label string, size int, leaf long, node long, threshold double, pick int"
        found = cut(picked.join(vectors, row).groupBy(*key).applyInPandas(fit, schema))
        dealt = inside.withColumn("tile", F.pmod(F.xxhash64("digest"), F.col("tiles")).cast("int")).join(vectors, row).select(*key, "tile", "digest", "vector")
        plans = found.join(wide, key).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(*key, "tile", "node", "threshold", "pick")
        moved = dealt.groupBy(*key, "tile").cogroup(plans.groupBy(*key, "tile")).applyInPandas(step, "label string, size int, digest string, leaf long")
        slim = cut(slim.join(wide, key, "left_anti").select(*row, "leaf").union(moved.select(*row, "leaf")))
    if not narrowed:
        return routed
    codes = slim.groupBy(*row).agg(F.sort_array(F.collect_list("leaf")).alias("codes"))  # a row's own leaves
    return cut(routed.drop("codes").join(codes, row))


def _forest_edges(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all rows that ``linked`` joins: one less than rows for each class."""
    n = len(linked)
    seen = np.zeros(n, dtype=bool)
    out = []
    for i in range(n):
        if seen[i]:
            continue
        seen[i] = True
        front = [i]
        while front:
            j = front.pop()
            new = np.flatnonzero(linked[j] & ~seen)
            seen[new] = True
            out.extend((j, int(k)) for k in new)
            front.extend(int(k) for k in new)
    return out


def label_key(vectors: DataFrame, label: str) -> Column:
    """Text that is equal for equal labels of whatever type (zero has one sign)."""
    kind = vectors.schema[label].dataType.typeName()
    return (F.col(label) + F.lit(0.0) if kind in ("float", "double") else F.col(label)).cast("string")


def link_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = 0.93,
    trees: int = 5,
    leaf_rows: int = 600,
    spill: float = 0.53,
    sample_rows: int = 40_000,
    leaf_sample: int = 8192,
    block_rows: int = 1024,
    seed: int = 1,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``vectors``.

    Rows link if their labels are equal and not null and their cosine, in double precision, is
    ``threshold`` or more; labels may be of any type and are compared as they are. Equal vectors of a label are one class with a count, found by an
    aggregate. The upper levels of the trees are fitted on about ``sample_rows`` rows picked by
    a hash; every row then walks all trees of its label and lands, with spill, in one leaf or
    more of each. Leaves that hold more than ``2 * leaf_rows`` rows are split further on
    samples of their own rows (``narrow_leaves``), so leaves do not grow with the table. A row
    spills if it is nearer to a split point than ``spill`` times the standard deviation of the
    distance that a random direction shows between two vectors at ``threshold``.
    Rows of one leaf are compared: a leaf of more than ``block_rows`` rows is cut into blocks
    and every two blocks meet in a task of their own, so no task holds more than two blocks
    and no pair of a leaf is missed. A pair counts in the first leaf that it shares, so each
    counts once; a task returns link counts and a spanning forest of its links, never its pairs.

    A pair is missed only if no tree has a leaf with both. Vectors that are null, zero, empty
    or hold null or non-finite components link with nothing, nor do rows with a null label or
    id; vectors of different lengths never link. Repeated ids count as separate vectors.
    """
    spark = ship(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), label_key(vectors, label).alias("label"))

    @F.pandas_udf("boolean")
    def sound(part: pd.Series) -> pd.Series:
        _, keep = unit(list(part))
        out = np.zeros(len(part), dtype=bool)
        out[keep] = True
        return pd.Series(out)

    usable = rows.where("vec_id is not null and label is not null").where(sound("embedding"))
    classes = usable.withColumn("digest", F.sha2(F.to_binary(F.to_json("embedding"), F.lit("utf-8")), 256))
    classes = cut(classes.groupBy("label", "digest").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")))

    total = classes.count()
    sample = bounded_sample(classes, F.col("digest"), sample_rows, seed).select("label", "embedding")
    width = spill * max(0.0, 2 - 2 * threshold) ** 0.5
    forest = fit_forest(sample, min(1.0, sample_rows / max(total, 1)), trees, leaf_rows, 32, width, seed)
    shipped = spark.sparkContext.broadcast(forest)

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for (own_label, size), group in part.groupby([part["label"], part["embedding"].map(len)]):
                x, _ = unit(list(group["embedding"]))
                for i in range(0, len(group), 2048):
                    some = group.iloc[i : i + 2048]
                    codes = leaves(shipped.value, own_label, np.array(x[i : i + 2048]))
                    yield pd.DataFrame({
                        "label": own_label, "size": int(size), "digest": some["digest"].to_numpy(), "id": some["id"].to_numpy(), "n": some["n"].to_numpy(),
                        "codes": codes, "vector": [v.tobytes() for v in x[i : i + 2048]],
                    })

    routed = classes.mapInPandas(route, "label string, size int, digest string, id long, n long, codes array<long>, vector binary")
    routed = narrow_leaves(cut(routed), forest, leaf_rows, 32, leaf_sample)
    listed = routed.select("*", F.explode("codes").alias("leaf"))
    sizes = listed.groupBy("label", "size", "leaf").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("int"))
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    placed = listed.join(sizes.drop("rows"), ["label", "size", "leaf"]).withColumn("own", own)
    # block i meets block j in tile (min, max); a row goes to the tiles of its block
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(F.col("own"), other).alias("a"), F.greatest(F.col("own"), other).alias("b"))
    )
    dealt = placed.withColumn("tile", F.explode(tiles)).select("label", "size", "leaf", "tile.a", "tile.b", "own", "digest", "id", "n", "codes", "vector")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        leaf, a, b = int(part["leaf"].iloc[0]), part["a"].iloc[0], part["b"].iloc[0]
        x = np.stack([np.frombuffer(v) for v in part["vector"]])
        n = part["n"].to_numpy()
        digests, ids = part["digest"].to_numpy(), part["id"].to_numpy()
        block = part["own"].to_numpy()
        linked = x @ x.T >= threshold
        if a != b:
            linked &= block[:, None] != block[None, :]
        np.fill_diagonal(linked, False)
        # pairs that share an earlier leaf count there
        known: dict[int, int] = {}
        at = [(i, known.setdefault(int(c), len(known))) for i, codes in enumerate(part["codes"]) for c in codes if c < leaf]
        if at:
            member = np.zeros((len(x), len(known)), dtype=np.float32)
            member[tuple(np.array(at).T)] = 1.0
            linked &= (member @ member.T) == 0
        links = linked @ n
        out = [(digests[i], int(ids[i]), int(links[i]), None) for i in np.flatnonzero(links)]
        out += [(digests[i], int(ids[i]), 0, digests[j]) for i, j in _forest_edges(linked)]
        return pd.DataFrame(out, columns=["digest", "id", "links", "other"])

    found = dealt.groupBy("label", "size", "leaf", "a", "b").applyInPandas(
        lambda key, part: compare(part).assign(label=key[0]), "label string, digest string, id long, links long, other string"
    )
    found = cut(found)
    key = F.concat_ws(":", F.col("label").cast("string"), "digest")
    roots = connected_components(
        found.where("other is not null").select(key.alias("a"), F.concat_ws(":", F.col("label").cast("string"), "other").alias("b")), "a", "b"
    )
    links = found.groupBy("label", "digest").agg(F.sum("links").alias("links"))
    named = classes.select("label", "digest", "id", "n", key.alias("node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    known = named.join(lowest, "root").join(links, ["label", "digest"], "left")
    known = known.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    known = cut(known)
    digest = F.sha2(F.to_binary(F.to_json("embedding"), F.lit("utf-8")), 256)
    slim = rows.select("vec_id", "label", F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull(), digest).alias("digest"))
    full = slim.join(known, ["label", "digest"], "left")
    component = F.coalesce("component_id", "vec_id")
    return full.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
