"""Squarified treemap layout: sizes to rectangles, level by level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VISIBLE = 4.0  # square pixels that a rectangle of its own must have


def place(sizes: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Rectangles (x, y, w, h) that tile one, in proportion to sizes in descending order: rows are filled as long as their worst aspect ratio gets no worse."""
    total, out, at = sum(sizes), [], 0
    areas = [s * w * h / total for s in sizes]
    while at < len(areas):
        side, row, worst, end = min(w, h), 0.0, float("inf"), at
        while end < len(areas):
            grown = row + areas[end]
            ratio = max(side * side * areas[at] / grown**2, grown**2 / (side * side * areas[end])) if side and areas[end] else float("inf")
            if ratio > worst:
                break
            row, worst, end = grown, ratio, end + 1
        depth, along = row / side if side else 0.0, 0.0
        for a in areas[at:end]:
            length = a / depth if depth else 0.0
            out.append((x, y + along, depth, length) if w >= h else (x + along, y, length, depth))
            along += length
        x, y, w, h = (x + depth, y, w - depth, h) if w >= h else (x, y + depth, w, h - depth)
        at = end
    return out


def _laid(key: str) -> Callable:
    """Lays out the children of one rectangle, the largest first; the folded one comes where its size puts it."""

    def lay(pdf):
        pdf = pdf.sort_values(["size", "folded", key], ascending=[False, True, True])
        boxes = place(pdf["size"].astype(float).tolist(), *pdf.iloc[0][["x", "y", "w", "h"]].astype(float))
        return pdf.assign(**dict(zip(("x", "y", "w", "h"), map(list, zip(*boxes, strict=True)), strict=True)))

    return lay


def nested(df: DataFrame, keys: list[str], size: str = "size", width: float = 1000.0, height: float = 1000.0, visible: float = VISIBLE) -> DataFrame:
    """(keys, depth, folded, items, size, x, y, w, h): a treemap of df's rows, nested by `keys`; the last is usually a row's own id.

    Each level's sums are joined to the rectangles of the level above, and every rectangle lays out its
    children by itself. Children that would get less than `visible` area share one folded rectangle of
    their parent (key null), so areas always tile their parent, and one group has at most its
    area over `visible` rows and one more, whatever the data. Sizes of 0, negative or null take no room. Equal sizes go by key.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    own, out, parents = ["items", "size", "x", "y", "w", "h"], None, None
    rows = df.select(*keys, F.col(size).cast("long").alias("size")).where("size > 0")
    for depth in range(1, len(keys) + 1):
        above, key = keys[: depth - 1], keys[depth - 1]
        level = rows.groupBy(*keys[:depth]).agg(F.count("*").alias("items"), F.sum("size").alias("size"))
        if parents is None:
            whole = F.broadcast(rows.agg(F.sum("size").alias("_size")))  # one row
            level = level.crossJoin(whole).withColumns({"x": F.lit(0.0), "y": F.lit(0.0), "w": F.lit(float(width)), "h": F.lit(float(height))})
        else:
            cond = F.lit(True)
            for k in above:
                cond = cond & F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}"))
            level = level.alias("c").join(parents.withColumnRenamed("size", "_size").alias("p"), cond).select("c.*", "_size", "x", "y", "w", "h")
        small = F.col("size") / F.col("_size") * F.col("w") * F.col("h") < visible
        marked = level.withColumn("folded", small).withColumn(key, F.when(~small, F.col(key)))
        marked = marked.groupBy(*keys[:depth], "folded").agg(F.sum("items").alias("items"), F.sum("size").alias("size"), *[F.first(c).alias(c) for c in ("x", "y", "w", "h")])

        schema = ", ".join(f"`{k}` {types[k]}" for k in keys[:depth]) + ", folded boolean, items long, size long, x double, y double, w double, h double"
        laid = marked.select(*keys[:depth], "folded", *own).groupBy(*above).applyInPandas(_laid(key), schema)
        shown = laid.select(*keys[:depth], *[F.lit(None).cast(types[k]).alias(k) for k in keys[depth:]], F.lit(depth).alias("depth"), "folded", *own)
        out = shown if out is None else out.unionByName(shown)
        parents = laid.where("NOT folded").drop("folded", "items")
    return out
