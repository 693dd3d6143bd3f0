"""Charts from small tables as lists of shapes, which are written as SVG or drawn as PNG."""

from __future__ import annotations

import html
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from ..functions.png import encode_png
from .letters import bitmap

WIDE, HIGH, EDGE = 640, 360, 50
PALETTE = ("#4c78a8", "#f58518", "#54a24b", "#e45756", "#72b7b2", "#b279a2", "#ff9da6", "#9d755d", "#bab0ac", "#eeca3b")


@dataclass(frozen=True)
class Box:
    x: float
    y: float
    wide: float
    high: float
    fill: str
    tip: str = ""

    def svg(self) -> str:
        return f'<rect x="{self.x:.1f}" y="{self.y:.1f}" width="{self.wide:.1f}" height="{self.high:.1f}" fill="{self.fill}"' + _tip(self.tip, "rect")

    def draw(self, canvas: np.ndarray, scale: int) -> None:
        """At least one pixel across and down."""
        x, y = max(round(self.x * scale), 0), max(round(self.y * scale), 0)
        canvas[y : max(round((self.y + self.high) * scale), y + 1), x : max(round((self.x + self.wide) * scale), x + 1)] = _rgb(self.fill)


@dataclass(frozen=True)
class Line:
    x: float
    y: float
    to_x: float
    to_y: float
    colour: str

    def svg(self) -> str:
        return f'<line x1="{self.x:.1f}" x2="{self.to_x:.1f}" y1="{self.y:.1f}" y2="{self.to_y:.1f}" stroke="{self.colour}"/>'

    def draw(self, canvas: np.ndarray, scale: int) -> None:
        t = np.linspace(0, 1, int(max(abs(self.to_x - self.x), abs(self.to_y - self.y)) * scale) + 2)
        x, y = (np.rint((a + (b - a) * t) * scale).astype(int) for a, b in ((self.x, self.to_x), (self.y, self.to_y)))
        for i in range(scale):
            for j in range(scale):
                _put(canvas, x + i - scale // 2, y + j - scale // 2, self.colour)


@dataclass(frozen=True)
class Dot:
    x: float
    y: float
    radius: float
    fill: str
    tip: str = ""
    opacity: float = 1.0

    def svg(self) -> str:
        return f'<circle cx="{self.x:.1f}" cy="{self.y:.1f}" r="{self.radius:g}" fill="{self.fill}" fill-opacity="{self.opacity:g}"' + _tip(self.tip, "circle")

    def draw(self, canvas: np.ndarray, scale: int) -> None:
        r = self.radius * scale
        x, y = self.x * scale, self.y * scale
        rows, columns = np.mgrid[math.floor(y - r) : math.ceil(y + r) + 1, math.floor(x - r) : math.ceil(x + r) + 1]
        inside = (rows - y) ** 2 + (columns - x) ** 2 <= r * r
        _put(canvas, columns[inside], rows[inside], self.fill, self.opacity)


@dataclass(frozen=True)
class Text:
    x: float
    y: float
    text: str
    anchor: str = "start"
    size: int = 11
    turn: int = 0

    def svg(self) -> str:
        at = f'x="{self.x:.1f}" y="{self.y:.1f}" text-anchor="{self.anchor}" font-size="{self.size}"'
        turned = f' transform="rotate({self.turn} {self.x:.1f} {self.y:.1f})"' if self.turn else ""
        return f"<text {at}{turned}>{html.escape(self.text)}</text>"

    def draw(self, canvas: np.ndarray, scale: int) -> None:
        """Letters stand on y; capitals are seven tenths of the size high. Turned about (x, y), as in SVG."""
        dots = bitmap(self.text)
        each = self.size * scale * 0.1
        high, wide = dots.shape
        left = {"start": 0.0, "middle": -wide / 2, "end": -float(wide)}[self.anchor]
        c, s = math.cos(math.radians(self.turn)), math.sin(math.radians(self.turn))
        corners = np.array([(left + a, b - high) for a in (0, wide) for b in (0, high)]) * each
        ends = np.column_stack((corners @ (c, -s) + self.x * scale, corners @ (s, c) + self.y * scale))
        lo, hi = np.floor(ends.min(0)).astype(int), np.ceil(ends.max(0)).astype(int)
        rows, columns = np.mgrid[lo[1] : hi[1] + 1, lo[0] : hi[0] + 1]
        dx, dy = columns + 0.5 - self.x * scale, rows + 0.5 - self.y * scale
        i = np.floor((dy * c - dx * s) / each + high).astype(int)
        j = np.floor((dx * c + dy * s) / each - left).astype(int)
        inside = (i >= 0) & (i < high) & (j >= 0) & (j < wide)
        inside[inside] = dots[i[inside], j[inside]]
        _put(canvas, columns[inside], rows[inside], "#000000")


def _tip(tip: str, kind: str) -> str:
    return f"><title>{html.escape(tip)}</title></{kind}>" if tip else "/>"


def _rgb(colour: str) -> np.ndarray:
    """Of #rrggbb or #rgb."""
    digits = colour[1:] if len(colour) == 7 else "".join(c + c for c in colour[1:])
    return np.array([int(digits[i : i + 2], 16) for i in (0, 2, 4)], np.float64)


def _put(canvas: np.ndarray, x: np.ndarray, y: np.ndarray, colour: str, opacity: float = 1.0) -> None:
    seen = (x >= 0) & (x < canvas.shape[1]) & (y >= 0) & (y < canvas.shape[0])
    x, y = x[seen], y[seen]
    canvas[y, x] = np.rint(canvas[y, x] * (1 - opacity) + _rgb(colour) * opacity)


@dataclass(frozen=True)
class Drawing:
    title: str
    shapes: tuple
    wide: int = WIDE
    high: int = HIGH

    def _all(self) -> tuple:
        return (Text(self.wide / 2, 22, self.title, "middle", 15), *self.shapes)

    def svg(self) -> str:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{self.wide}" height="{self.high}" font-family="sans-serif">{"".join(s.svg() for s in self._all())}</svg>\n'

    def pixels(self, scale: int = 2) -> np.ndarray:
        canvas = np.full((self.high * scale, self.wide * scale, 3), 255, np.uint8)
        for s in self._all():
            s.draw(canvas, scale)
        return canvas

    def png(self, scale: int = 2) -> bytes:
        return encode_png(self.pixels(scale))


def _scale(lo: float, hi: float, a: float, b: float):
    span = (hi - lo) or 1.0
    return lambda x: a + (x - lo) / span * (b - a)


def bars(title: str, rows: Sequence[tuple]) -> Drawing:
    """rows: (name, number)."""
    y = _scale(0, max([n for _, n in rows], default=1), HIGH - 45, 40)
    step = (WIDE - EDGE - 15) / max(len(rows), 1)
    shapes: list = [Box(EDGE + i * step + 1, y(n), max(step - 2, 1), HIGH - 45 - y(n), PALETTE[0], f"{name}: {n}") for i, (name, n) in enumerate(rows)]
    if len(rows) <= 30:
        shapes += [Text(EDGE + (i + 0.5) * step, HIGH - 28, str(name), "end", turn=-30) for i, (name, _) in enumerate(rows)]
    longest = max([len(str(name)) for name, _ in rows], default=0) if len(rows) <= 30 else 0
    return Drawing(title, tuple(shapes), WIDE, HIGH + max(0, min(longest, 60) * 4 - 28))


def histogram_panels(title: str, panels: Sequence[tuple[str, Sequence[tuple]]]) -> Drawing:
    """panels: name and rows (lo, hi, n), side by side."""
    shapes: list = []
    each = (WIDE - 15) / max(len(panels), 1)
    for k, (name, rows) in enumerate(panels):
        if not rows:
            continue
        left, right = k * each + EDGE * 0.6, (k + 1) * each
        x = _scale(rows[0][0], rows[-1][1], left, right)
        y = _scale(0, max(n for *_, n in rows) or 1, HIGH - 45, 55)
        shapes += [Box(x(lo), y(n), max(x(hi) - x(lo) - 0.5, 0.5), HIGH - 45 - y(n), PALETTE[k % 10]) for lo, hi, n in rows if n]
        shapes += [Text(left, HIGH - 25, f"{rows[0][0]:.4g}"), Text(right, HIGH - 25, f"{rows[-1][1]:.4g}", "end"), Text((left + right) / 2, 45, name, "middle")]
    return Drawing(title, tuple(shapes))


def boxes(title: str, rows: Sequence[tuple]) -> Drawing:
    """rows: (name, q1, median, q3, low, high)."""
    lo, hi = min([r[4] for r in rows], default=0), max([r[5] for r in rows], default=1)
    y, step = _scale(lo, hi, HIGH - 45, 40), (WIDE - EDGE - 15) / max(len(rows), 1)
    shapes: list = []
    for i, (name, q1, median, q3, low, high) in enumerate(rows):
        x, w = EDGE + (i + 0.5) * step, step * 0.3
        shapes += [Line(x, y(low), x, y(high), "#444"), Box(x - w, y(q3), 2 * w, max(y(q1) - y(q3), 0.5), PALETTE[i % 10])]
        shapes += [Line(x - w, y(median), x + w, y(median), "#000"), Text(x, HIGH - 28, str(name), "middle")]
    return Drawing(title, (*shapes, Text(4, y(lo), f"{lo:.4g}"), Text(4, y(hi), f"{hi:.4g}")))


def _ramp(t: float) -> str:
    stops = ((68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37))
    at = min(max(t, 0.0), 1.0) * 4
    i = min(int(at), 3)
    return "#" + "".join(f"{round(a + (b - a) * (at - i)):02x}" for a, b in zip(stops[i], stops[i + 1], strict=True))


def scatter(title: str, rows: Sequence[tuple]) -> Drawing:
    """rows: (x, y, colour value), or with a fourth, the rows of a bin; numbers give a colour scale, anything else a legend."""
    rows = [r for r in rows if None not in r]
    if not rows:
        return Drawing(title, ())
    x, y = _scale(min(r[0] for r in rows), max(r[0] for r in rows), EDGE, WIDE - 150), _scale(min(r[1] for r in rows), max(r[1] for r in rows), HIGH - 40, 40)
    legend: list
    if all(isinstance(r[2], (int, float)) and not isinstance(r[2], bool) for r in rows):
        lo, hi = min(r[2] for r in rows), max(r[2] for r in rows)
        colour = lambda v: _ramp((v - lo) / ((hi - lo) or 1))
        legend = [Box(WIDE - 120, 40 + i * 12, 14, 12, _ramp(1 - i / 19)) for i in range(20)] + [Text(WIDE - 100, 50, f"{hi:.4g}"), Text(WIDE - 100, 278, f"{lo:.4g}")]
    else:
        places = {n: i for i, n in enumerate(sorted({str(r[2]) for r in rows}))}
        colour = lambda v: PALETTE[places[str(v)] % 10]
        legend = [s for n, i in list(places.items())[:20] for s in (Dot(WIDE - 130, 46 + i * 14, 4, PALETTE[i % 10]), Text(WIDE - 120, 50 + i * 14, n))]
    return Drawing(title, (*(Dot(x(a), y(b), 3, colour(v), f"{n[0]} rows" if n else "", 0.8) for a, b, v, *n in rows), *legend))


def heat_map(title: str, names: Sequence[str], r: dict[tuple[str, str], float | None]) -> Drawing:
    cell, left, top = 38, 150, 40
    shapes: list = []
    for i, a in enumerate(names):
        shapes.append(Text(left - 6, top + (i + 0.6) * cell, a, "end"))
        for j, b in enumerate(names):
            v = r.get((a, b))
            shade = None if v is None else (255 if v > 0 else round(255 + 180 * v), round(255 - 180 * abs(v)), 255 if v < 0 else round(255 - 180 * v))
            shapes.append(Box(left + j * cell, top + i * cell, cell, cell, "#eee" if shade is None else "#" + "".join(f"{c:02x}" for c in shade), f"{a} / {b}: {v}"))
    return Drawing(title, tuple(shapes), left + cell * len(names) + 20, top + cell * len(names) + 20)
