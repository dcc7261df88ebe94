"""The nearest points of another cloud within a radius, exactly, without a row for each pair that is near.

Space is halved along each axis, pair by pair, until a box holds few points. A point is held against the fixed ones of its own box; only
the other boxes that its ball still touches are visited then, and the ball is no wider than the radius and what the boxes' counts allow.
So the work follows the points, not the pairs within the radius, and a task holds a box.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.recovery import cut

AXES = ("x", "y", "z")
CELL = ("no", "level", "cx", "cy", "cz")
# Points of a box, halvings at most, visitors of a box in a task (in boxes), distances in memory at a time, slack of box distances.
BOX, DEEPEST, VISITORS, AT_ONCE, SLACK = 2000, 48, 8, 2_000_000, 1e-9


def best(a: np.ndarray, b: np.ndarray, k: int, limit: float, root: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions in a and b and distances (squared ones unless root) of the k nearest of b within the limit, the earlier of b among equals, in order; in pieces."""
    step = max(1, AT_ONCE // max(1, len(b)))
    for at in range(0, len(a) if len(b) else 0, step):
        some = a[at : at + step]
        d = np.zeros((len(some), len(b)))
        for c in range(a.shape[1]):
            off = some[:, c, None] - b[None, :, c]
            off *= off
            d += off
        if root:
            np.sqrt(d, out=d)
        most = np.partition(d, k - 1, axis=1)[:, k - 1] if len(b) > k else np.full(len(some), np.inf)
        i, j = np.nonzero(d <= np.minimum(most, limit)[:, None])
        v = d[i, j]
        order = np.lexsort((j, v, i))
        i, j, v = i[order], j[order], v[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield i[kept] + at, j[kept], v[kept]


def _lists(n: int, i: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The values of each of n rows, as arrays; i, ascending, tells the row."""
    ends = np.searchsorted(i, np.arange(n + 1))
    out = [np.empty(n, object) for _ in values]
    for v, o in zip(values, out, strict=True):
        for r in range(n):
            o[r] = v[ends[r] : ends[r + 1]]
    return out


def _found(a: np.ndarray, fixed: pd.DataFrame, k: int, limit: float, root: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """d, fid and row of the k nearest of each of a, and the distance to the last of them (infinite with fewer than k)."""
    fixed = fixed.sort_values(["fid", "row"])
    pieces = list(best(a, fixed[list(AXES)].to_numpy(float), k, limit, root))
    i, j, v = (np.concatenate(p) for p in zip(*pieces, strict=True)) if pieces else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    far = np.full(len(a), np.inf)
    last = np.arange(len(i)) - np.searchsorted(i, i) == k - 1
    far[i[last]] = v[last] if root else np.sqrt(v[last])
    return _lists(len(a), i, v, fixed["fid"].to_numpy(np.int64)[j], fixed["row"].to_numpy(np.int64)[j]), far


def _cells(level) -> list:
    """The cell of each axis at a level; halving is exact, so a cell lies in one of the level before."""
    return [F.floor(F.col(c) * F.pow(F.lit(2.0), level)).alias(f"c{c}") for c in ("qx", "qy", "qz")]


def _boxes(points: DataFrame) -> DataFrame:
    """points (no, qx, qy, qz) with the level and cell (cx, cy, cz) of their box."""
    active, out, flags = points, points, []
    for level in range(DEEPEST):
        at = [c.alias(f"_{k}{level}") for k, c in zip("xyz", _cells(F.lit(float(level))), strict=True)]
        names = ["no", *[f"_{k}{level}" for k in "xyz"]]
        heavy = cut(active.groupBy("no", *at).agg(F.count("*").alias("_n")).where(F.col("_n") > BOX).select(*names))
        if heavy.isEmpty():
            break
        active = active.select("*", *at).join(F.broadcast(heavy), names, "left_semi").select(points.columns)
        flags.append(f"_h{level}")
        out = out.select("*", *at).join(F.broadcast(heavy.withColumn(flags[-1], F.lit(1))), names, "left").drop(*names[1:])
    level = reduce(lambda x, y: x + y, [F.coalesce(c, F.lit(0)) for c in flags], F.lit(0))
    out = out.withColumn("level", level).drop(*flags)
    return out.select("*", *[c.alias(f"c{k}") for k, c in zip("xyz", _cells(F.col("level")), strict=True)])


def nearest(moving: DataFrame, fixed: DataFrame, radius: float, k: int = 1, root: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of each place of moving points (pair, x, y, z) the k nearest fixed ones of the pair (pair, fid, x, y, z and more) within the radius.

    Gives pair, x, y, z and near, an array of d (squared distance; the distance if root), fid and row in order of d and fid, for places that
    have any; and the fixed rows with their row. Points with a null or infinite coordinate are near nothing.
    """
    known = reduce(lambda p, q: p & q, [F.abs(c) < float("inf") for c in AXES])
    names = cut(moving.select("pair").distinct().join(fixed.select("pair").distinct(), "pair").withColumn("no", F.monotonically_increasing_id()))
    first_of = Window.partitionBy("pair", *AXES).orderBy("fid")
    rows = fixed.where(known & F.col("fid").isNotNull()).withColumn("_n", F.row_number().over(first_of)).where(F.col("_n") <= k).drop("_n")
    rows = cut(rows.join(names, "pair").withColumn("row", F.monotonically_increasing_id()))
    places = cut(moving.where(known).select("pair", *AXES).distinct().join(names, "pair").drop("pair"))

    size, n = 16.0 * radius, int(moving.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None).cast("long")
    both = rows.select("no", *AXES, F.col("fid").cast("long").alias("fid"), "row").unionByName(places.select("no", *AXES, none.alias("fid"), none.alias("row")))
    boxed = _boxes(both.select("*", *[(F.col(c) / size).alias(f"q{c}") for c in AXES])).drop("qx", "qy", "qz")
    leaves = cut(boxed.groupBy(*CELL).agg(F.count("row").alias("n")).withColumn("leaf", F.monotonically_increasing_id()))
    boxed = cut(boxed.join(F.broadcast(leaves.drop("n")), list(CELL)).drop(*CELL[1:]))
    t = leaves.toPandas().sort_values("no", kind="stable")
    pair_of, leaf_of, count_of = t["no"].to_numpy(), t["leaf"].to_numpy(), t["n"].to_numpy()
    edge = size * 0.5 ** t["level"].to_numpy(float)
    low = t[["cx", "cy", "cz"]].to_numpy(float) * edge[:, None]
    high = low + edge[:, None]
    limit = radius if root else radius * radius
    kind = "no long, x double, y double, z double, d array<double>, fid array<long>, row array<long>"

    def own(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        """Each place against its own box, and the boxes to visit (at) within reach."""
        m = g[g["row"].isna()]
        a = m[list(AXES)].to_numpy(float)
        (d, fid, row), reach = _found(a, g[g["row"].notna()], k, limit, root)
        s = slice(*np.searchsorted(pair_of, [g["no"].iloc[0], g["no"].iloc[0] + 1]))
        lo, hi, ids, counts = low[s], high[s], leaf_of[s], count_of[s]
        me = int(np.flatnonzero(ids == key[0])[0])
        far = np.sqrt((np.maximum(hi[me] - lo, hi - lo[me]) ** 2).sum(axis=1))
        order = np.argsort(far)
        enough = int(np.searchsorted(np.cumsum(counts[order]), k))
        reach = np.minimum(reach, min(radius, far[order[enough]] if enough < len(order) else np.inf)) * (1 + SLACK) + SLACK * edge[s][me]
        gap = np.sqrt((np.maximum(0, np.maximum(lo - hi[me], lo[me] - hi)) ** 2).sum(axis=1))
        near = np.flatnonzero((gap <= reach.max(initial=0.0)) & (counts > 0) & (ids != key[0]))
        at = [np.empty(0, object)]
        step = max(1, AT_ONCE // max(1, len(near)))
        for b in range(0, len(a), step):
            p = a[b : b + step, None, :]
            i, j = np.nonzero((np.maximum(0, np.maximum(lo[near] - p, p - hi[near])) ** 2).sum(axis=2) <= reach[b : b + step, None] ** 2)
            at += _lists(p.shape[0], i, ids[near][j])
        return pd.DataFrame({"no": m["no"], **{c: m[c] for c in AXES}, "d": d, "fid": fid, "row": row, "reach": reach, "at": np.concatenate(at)})

    def visit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        m = g[g["row"].isna()]
        (d, fid, row), _ = _found(m[list(AXES)].to_numpy(float), g[g["row"].notna()], k, limit, root)
        return pd.DataFrame({"no": m["no"], **{c: m[c] for c in AXES}, "d": d, "fid": fid, "row": row})

    first = cut(boxed.repartition(n, "leaf").groupBy("leaf").applyInPandas(own, f"{kind}, reach double, at array<long>"))
    visits = first.select("no", *AXES, F.explode("at").alias("leaf"))
    parts = cut(visits.groupBy("leaf").agg(F.ceil(F.count("*") / (VISITORS * BOX)).alias("parts")))
    guests = visits.join(F.broadcast(parts), "leaf").select("leaf", F.pmod(F.xxhash64(*AXES), "parts").alias("part"), "no", *AXES, none.alias("fid"), none.alias("row"))
    hosts = boxed.where("row is not null").join(F.broadcast(parts), "leaf").select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "no", *AXES, "fid", "row")
    second = guests.unionByName(hosts).repartition(n, "leaf", "part").groupBy("leaf", "part").applyInPandas(visit, kind)
    zipped = F.arrays_zip("d", "fid", "row").alias("near")
    visited = first.where(F.size("at") > 0).select("no", *AXES, zipped).unionByName(second.select("no", *AXES, zipped).where(F.size("near") > 0))
    merged = visited.groupBy("no", *AXES).agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    found = first.where(F.size("at") == 0).select("no", *AXES, zipped).unionByName(merged).where(F.size("near") > 0)
    return found.join(names, "no").select("pair", *AXES, "near"), rows.drop("no")
