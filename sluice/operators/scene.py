"""What placed scans show of a site: walls, poles, kerbs and step edges, as cells. Points are scan, x, y and z or h (height over ground)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .grid import cells


def structures(points: DataFrame, cell: float = 0.15, heights: tuple[float, float] = (0.2, 8.0), least: int = 4, foot: float = 1.0, top: float = 1.8, wall_span: float = 2.0, pole_cells: int = 45) -> DataFrame:
    """Tall cells (scan, cx, cy) with the structure of touching cells they belong to (bx, by: its least cell; cells, span) and its kind.

    A cell is tall with `least` points between the heights, from under `foot` to over `top`. A structure as long as
    wall_span is a wall, a shorter one of pole_cells at most a pole, any other null.
    """
    h = F.col("h")
    tall = cells(points.where((h > heights[0]) & (h < heights[1])), cell).groupBy("scan", "cx", "cy").agg(F.count("*").alias("_n"), F.min("h").alias("_low"), F.max("h").alias("_high"))
    tall = tall.where((F.col("_n") >= least) & (F.col("_low") < foot) & (F.col("_high") > top)).select(F.struct("scan", "cx", "cy").alias("node"))
    ends = F.array(*[F.struct("node.scan", (F.col("node.cx") + i).alias("cx"), (F.col("node.cy") + j).alias("cy")) for i, j in ((0, 0), (1, 0), (0, 1), (1, 1), (1, -1))])
    edges = tall.select(F.col("node").alias("src"), F.explode(ends).alias("dst")).join(tall.select(F.col("node").alias("dst")), "dst").select("src", "dst")
    own = graph.blocks(edges)
    wide = lambda c: (F.max(f"node.{c}") - F.min(f"node.{c}")) * cell
    each = own.groupBy("block").agg(F.count("*").alias("cells"), F.hypot(wide("cx"), wide("cy")).alias("span"))
    kind = F.when(F.col("span") >= wall_span, "wall").when(F.col("cells") <= pole_cells, "pole")
    return own.join(each, "block").select("node.scan", "node.cx", "node.cy", F.col("block.cx").alias("bx"), F.col("block.cy").alias("by"), "cells", "span", kind.alias("kind"))


def poles(structures: DataFrame, cell: float = 0.15) -> DataFrame:
    """Centres of poles."""
    middle = lambda c: ((F.avg(c) + 0.5) * cell).alias(c[1])
    return structures.where("kind = 'pole'").groupBy("scan", "bx", "by").agg(middle("cx"), middle("cy")).select("scan", "x", "y")


def kerbs(points: DataFrame, cell: float = 0.1, ground: float = 0.5, step: tuple[float, float] = (0.06, 0.4)) -> DataFrame:
    """Cells where the lowest ground steps by more than step[0] and less than step[1] towards the next cells in x and y."""
    low = cells(points.where(F.abs("h") < ground), cell).groupBy("scan", "cx", "cy").agg(F.min("h").alias("h"))
    east = low.select("scan", (F.col("cx") - 1).alias("cx"), "cy", F.col("h").alias("_e"))
    north = low.select("scan", "cx", (F.col("cy") - 1).alias("cy"), F.col("h").alias("_n"))
    rise = F.hypot(F.coalesce(F.col("_e") - F.col("h"), F.lit(0.0)), F.coalesce(F.col("_n") - F.col("h"), F.lit(0.0)))
    met = low.join(east, ["scan", "cx", "cy"], "left").join(north, ["scan", "cx", "cy"], "left").withColumn("step", rise)
    return met.where((F.col("step") > step[0]) & (F.col("step") < step[1])).select("scan", "cx", "cy", "step")


def step_edges(points: DataFrame, cell: float = 0.05, slope: tuple[float, float] = (0.35, 4.0), window: int = 1, inner: int = 3) -> DataFrame:
    """scan, cx, cy and slope of cells where the ground steps: Sobel over each cell's median of the lowest points around it.

    window: cells on each side of the median's square, 1 or 2 (gaps don't count). inner: a cell counts when all cells up
    to so many steps by sides from it have a median.
    """

    def around(rows: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
        sent = F.array(*[F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j")) for i, j in offsets])
        out = rows.withColumn("_s", F.explode(sent))
        return out.withColumns({"cx": F.col("cx") + F.col("_s.i"), "cy": F.col("cy") + F.col("_s.j"), "i": -F.col("_s.i"), "j": -F.col("_s.j")})

    low = cells(points, cell).groupBy("scan", "cx", "cy").agg(F.min("z").alias("z"))
    square = [(i, j) for i in range(-window, window + 1) for j in range(-window, window + 1)]
    smooth = around(low, square).groupBy("scan", "cx", "cy").agg(F.median("z").alias("z"))
    reach = max(inner, 1)
    diamond = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if abs(i) + abs(j) <= inner or max(abs(i), abs(j)) <= 1]
    inside = F.abs("i") + F.abs("j") <= inner
    weight = lambda a, b: F.when((F.abs("i") <= 1) & (F.abs("j") <= 1), F.col(a) * F.when(F.col(b) == 0, 2).otherwise(1)).otherwise(0)
    out = around(smooth, diamond).groupBy("scan", "cx", "cy").agg(F.count_if(inside).alias("_n"), F.count_if((F.abs("i") <= 1) & (F.abs("j") <= 1)).alias("_k"), *[F.sum(weight(a, b) * F.col("z")).alias(f"_{a}") for a, b in (("i", "j"), ("j", "i"))])
    out = out.where((F.col("_n") == 2 * inner * (inner + 1) + 1) & (F.col("_k") == 9)).withColumn("slope", F.hypot("_i", "_j") / (8 * cell))
    return out.where((F.col("slope") > slope[0]) & (F.col("slope") < slope[1])).select("scan", "cx", "cy", "slope")


def ransac_lines(p: np.ndarray, n: int = 4, reach: float = 0.06, draws: int = 3000, least: int = 150, angles: tuple[float, float] = (70.0, 110.0), shortest: float = 1.0, seed: int = 0) -> list[tuple[float, float, float, int, float, float]]:
    """Lines that most points lie on, one after the other, each refitted by its main axis: angle, centre, points, span along it. The same on every run."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < n and len(p) >= max(2, least):
        i = rng.integers(0, len(p), (draws, 2))
        d = p[i[:, 1]] - p[i[:, 0]]
        length = np.hypot(*d.T)
        angle = np.degrees(np.arctan2(d[:, 1], d[:, 0])) % 180
        best = np.zeros(len(p), bool)
        for k in np.flatnonzero((length >= shortest) & (angle > angles[0]) & (angle < angles[1])):
            on = np.abs((p - p[i[k, 0]]) @ (np.array([-d[k, 1], d[k, 0]]) / length[k])) < reach
            if on.sum() > best.sum():
                best = on
        if best.sum() < least:
            break
        own = p[best]
        centre = own.mean(axis=0)
        axis = np.linalg.svd(own - centre, full_matrices=False)[2][0]
        along = (own - centre) @ axis
        out.append((float(np.degrees(np.arctan2(axis[1], axis[0])) % 180), *map(float, centre), int(best.sum()), float(along.min()), float(along.max())))
        p = p[~best]
    return out


def edge_lines(edges: DataFrame, cell: float = 0.05, **rules) -> DataFrame:
    """Lines along a scan's step edges. Edges are a line's worth of a scan's cells, so a scan is one task."""
    kind = edges.schema["scan"].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cx", "cy"])
        found = ransac_lines((rows[["cx", "cy"]].to_numpy(float) + 0.5) * cell, **rules)
        return pd.DataFrame([(key[0], k, *line) for k, line in enumerate(found)], columns=["scan", "line", "angle", "x", "y", "points", "low", "high"])

    return edges.groupBy("scan").applyInPandas(run, f"scan {kind}, line int, angle double, x double, y double, points long, low double, high double")


def windowed(points: DataFrame, centre: tuple[float, float], direction: float, along: tuple[float, float], across: tuple[float, float]) -> DataFrame:
    """Points whose place along and across a direction (degrees; across to its right) from a centre lies within both windows.

    Quarter turns are exact, so a point on a window's border stays out.
    """
    quarter = {0: (1.0, 0.0), 90: (0.0, 1.0), 180: (-1.0, 0.0), 270: (0.0, -1.0)}
    u, v = quarter.get(direction % 360, (math.cos(math.radians(direction)), math.sin(math.radians(direction))))
    dx, dy = F.col("x") - centre[0], F.col("y") - centre[1]
    a, b = dx * u + dy * v, dx * v - dy * u
    return points.where((a > along[0]) & (a < along[1]) & (b > across[0]) & (b < across[1]))
