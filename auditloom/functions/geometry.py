"""Boxes, points and grids. A box is an array of four doubles: x1, y1, x2, y2."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_box(b: Column, width: float | None = None, height: float | None = None) -> Column:
    """Four finite numbers with x1 < x2 and y1 < y2, inside the frame if one is given; null boxes are not valid."""
    ok = (F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull() & ~F.isnan(v)) & (b[2] > b[0]) & (b[3] > b[1])
    if width is not None:
        ok = ok & (b[0] >= 0) & (b[1] >= 0) & (b[2] <= width) & (b[3] <= height)
    return F.coalesce(ok, F.lit(False))


def area(b: Column) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0.0 where a box is not valid."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return F.when(valid_box(a) & valid_box(b), w * h / (area(a) + area(b) - w * h)).otherwise(0.0)


def centre_inside(a: Column, b: Column) -> Column:
    """The centre of ``a`` lies in ``b``, edges included."""
    x, y = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2
    return F.coalesce(valid_box(a) & valid_box(b) & x.between(b[0], b[2]) & y.between(b[1], b[3]), F.lit(False))


def scaled(b: Column, sx: Column | float, sy: Column | float) -> Column:
    """The box in another frame, for instance from thousandths to pixels."""
    sx, sy = (F.lit(float(s)) if isinstance(s, (int, float)) else s for s in (sx, sy))
    return F.array(b[0] * sx, b[1] * sy, b[2] * sx, b[3] * sy)


def expanded(b: Column, fraction: float, width: float, height: float) -> Column:
    """The box grown on each side by a fraction of its size, kept in the frame."""
    dx, dy = (b[2] - b[0]) * fraction, (b[3] - b[1]) * fraction
    return F.array(F.greatest(F.lit(0.0), F.floor(b[0] - dx).cast("double")), F.greatest(F.lit(0.0), F.floor(b[1] - dy).cast("double")), F.least(F.lit(float(width)), F.ceil(b[2] + dx).cast("double")), F.least(F.lit(float(height)), F.ceil(b[3] + dy).cast("double")))


def touches(a: Column, b: Column) -> Column:
    """The boxes share inner points; touching edges do not count."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def grid_cells(b: Column, columns: int, rows: int, width: float, height: float) -> Column:
    """Row-major numbers of the cells whose centre lies in the box (right and lower edges out).

    If no centre does, the one cell that overlaps it most, the first of equals.
    """
    cw, ch = width / columns, height / rows
    cells = F.sequence(F.lit(0), F.lit(columns * rows - 1))
    x = lambda i: ((i % columns) + 0.5) * cw
    y = lambda i: (F.floor(i / columns) + 0.5) * ch
    inside = F.filter(cells, lambda i: (x(i) >= b[0]) & (x(i) < b[2]) & (y(i) >= b[1]) & (y(i) < b[3]))
    overlap = lambda i: F.greatest(F.lit(0.0), F.least(x(i) + cw / 2, b[2]) - F.greatest(x(i) - cw / 2, b[0])) * F.greatest(F.lit(0.0), F.least(y(i) + ch / 2, b[3]) - F.greatest(y(i) - ch / 2, b[1]))
    best = F.array_max(F.transform(cells, lambda i: F.struct(overlap(i).alias("o"), (-i).alias("i"))))
    return F.when(F.size(inside) > 0, inside).otherwise(F.array(-best["i"]))


def mask_stats(masks: DataFrame, key: str, threshold: int = 0) -> DataFrame:
    """Per mask (bytes of height x width values): ratio of values above the threshold and the largest component's box.

    Components have eight neighbours; of equal ones the first in reading order
    counts. An empty mask has ratio 0 and a null box; a size that does not match the
    bytes gives nulls.
    """
    kind = masks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for data, w, h in zip(pdf["mask"], pdf["width"], pdf["height"]):
                if data is None or pd.isna(w) or pd.isna(h) or len(data) != int(w) * int(h):
                    out.append((None, None))
                    continue
                on = np.frombuffer(bytes(data), np.uint8).reshape(int(h), int(w)) > threshold
                out.append((float(on.mean()) if on.size else 0.0, largest_component_box(on)))
            yield pd.DataFrame({key: pdf[key], "mask_ratio": [o[0] for o in out], "box": [o[1] for o in out]})

    return masks.select(key, "mask", "width", "height").mapInPandas(run, f"{key} {kind}, mask_ratio double, box array<int>")


def largest_component_box(on: np.ndarray) -> list[int] | None:
    """x1, y1, x2, y2 (exclusive) of the largest component with eight neighbours."""
    if not on.any():
        return None
    label = np.where(on, np.arange(1, on.size + 1).reshape(on.shape), 0)
    while True:
        wide = np.pad(label, 1)
        best = label.copy()
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                best = np.maximum(best, wide[dy : dy + on.shape[0], dx : dx + on.shape[1]])
        best = np.where(on, best, 0)
        if (best == label).all():
            break
        label = best
    values, first, counts = np.unique(label[on], return_index=True, return_counts=True)
    pick = values[sorted(range(len(values)), key=lambda k: (-counts[k], first[k]))[0]]
    ys, xs = np.nonzero(label == pick)
    return [int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1]
