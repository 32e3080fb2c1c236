"""Pixel kernels that numpy alone can express: rotation, line projections, components, ink."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame


def rotate(image: np.ndarray, degrees: int) -> np.ndarray:
    """Counterclockwise by a multiple of 90 degrees."""
    return np.rot90(image, degrees // 90 % 4)


def line_centers(ink: np.ndarray, axis: int, share: float = 0.5, gap: int = 2) -> list[int]:
    """Centers of runs of rows (axis 0) or columns (axis 1) that are dark over at least ``share`` of their length."""
    dark = np.flatnonzero(ink.mean(1 - axis) >= share)
    if not len(dark):
        return []
    return [round(float(run.mean())) for run in np.split(dark, np.flatnonzero(np.diff(dark) > gap) + 1)]


def components(ink: np.ndarray) -> np.ndarray:
    """Labels (0 outside) of the 8-connected parts of a boolean image: least index spreads until nothing moves."""
    label = np.where(ink, np.arange(1, ink.size + 1).reshape(ink.shape), 0)
    far = ink.size + 1
    while True:
        held = np.pad(np.where(ink, label, far), 1, constant_values=far)
        least = np.min([held[1 + i : 1 + i + ink.shape[0], 1 + j : 1 + j + ink.shape[1]] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        new = np.where(ink, least, 0)
        if (new == label).all():
            break
        label = new
    ids = np.unique(label[label > 0])
    return np.searchsorted(ids, label) + (label > 0) if len(ids) else label


def detect_lines(pages: DataFrame, threshold: int = 128) -> DataFrame:
    """(path, row_lines, column_lines) of page images (path, height, width, channels, data)."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for path, h, w, c, data in zip(f["path"], f["height"], f["width"], f["channels"], f["data"]):
                ink = np.frombuffer(data, np.uint8).reshape(h, w, c).mean(2) < threshold
                rows.append((path, line_centers(ink, 0), line_centers(ink, 1)))
            yield pd.DataFrame(rows, columns=["path", "row_lines", "column_lines"])

    return pages.select("path", "height", "width", "channels", "data").mapInPandas(run, "path string, row_lines array<int>, column_lines array<int>")
