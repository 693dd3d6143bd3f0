"""Charts from small tables as SVG text, and montages as PNG."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from ..functions.kernels import resize
from ..functions.png import encode_png
from . import drawings


def bars(title: str, rows: Sequence[tuple]) -> str:
    return drawings.bars(title, rows).svg()


def histogram_panels(title: str, panels: Sequence[tuple[str, Sequence[tuple]]]) -> str:
    return drawings.histogram_panels(title, panels).svg()


def boxes(title: str, rows: Sequence[tuple]) -> str:
    return drawings.boxes(title, rows).svg()


def scatter(title: str, rows: Sequence[tuple]) -> str:
    return drawings.scatter(title, rows).svg()


def heat_map(title: str, names: Sequence[str], r: dict[tuple[str, str], float | None]) -> str:
    return drawings.heat_map(title, names, r).svg()


def montage(images: Sequence[np.ndarray | None], tile: int = 180, columns: int = 5) -> bytes | None:
    """A PNG grid of the images that could be read, each fitted into a tile; nothing without any."""
    shown = [x for x in images if x is not None]
    if not shown:
        return None
    rows = -(-len(shown) // columns)
    canvas = np.full((rows * tile, min(columns, len(shown)) * tile if rows == 1 else columns * tile, 3), 255, np.uint8)
    for i, x in enumerate(shown):
        scale = tile / max(x.shape[:2])
        small = resize(x, max(1, round(x.shape[1] * scale)), max(1, round(x.shape[0] * scale)))
        top, left = (i // columns) * tile + (tile - small.shape[0]) // 2, (i % columns) * tile + (tile - small.shape[1]) // 2
        canvas[top : top + small.shape[0], left : left + small.shape[1]] = small
    return encode_png(canvas)
