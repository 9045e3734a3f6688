"""Charts of entities as PNG images: five views drawn by a small rasteriser, an image a row.

Bars, lines and shares are drawn in numpy; labels are left to whoever needs text in
pictures. The same entity, view and style always give the same bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from prismark.operators.allocation import seed_number
from prismark.shipping import ship_package

#: Names of styles with background and series colours; a style is picked by a hash of the chart.
STYLES = {
    "clean": ((255, 255, 255), [(31, 119, 180), (255, 127, 14), (44, 160, 44), (214, 39, 40)]),
    "muted": ((245, 245, 240), [(76, 114, 176), (221, 132, 82), (85, 168, 104), (196, 78, 82)]),
    "dark": ((34, 34, 40), [(102, 194, 165), (252, 141, 98), (141, 160, 203), (231, 138, 195)]),
}
HEIGHT, DPI = 360, 100
WIDTHS = (480, 540, 600)


class Style(NamedTuple):
    style: str
    show_data_labels: bool
    width_px: int
    height_px: int
    dpi: int


def style_of(chart_id: str, seed: int) -> Style:
    """The chart's style: preset, whether values are marked, and width, each from a seed of its own."""
    pick = lambda what, n: seed_number(f"chart-style:{what}:{chart_id}", seed) % n
    return Style(list(STYLES)[pick("preset", len(STYLES))], bool(pick("labels", 2)), WIDTHS[pick("width", len(WIDTHS))], HEIGHT, DPI)


class Canvas:
    """RGB pixels with a frame into which panels are drawn."""

    def __init__(self, style: Style):
        self.style, (ground, self.colours) = style, STYLES[style.style]
        self.pixels = np.full((style.height_px, style.width_px, 3), ground, np.uint8)

    def panel(self, row: int = 0, column: int = 0, rows: int = 1, columns: int = 1) -> tuple[int, int, int, int]:
        h, w = self.style.height_px // rows, self.style.width_px // columns
        return row * h + 12, (row + 1) * h - 12, column * w + 16, (column + 1) * w - 16

    def fill(self, top: float, bottom: float, left: float, right: float, colour) -> None:
        y0, y1, x0, x1 = (int(round(v)) for v in (min(top, bottom), max(top, bottom), left, right))
        self.pixels[max(0, y0) : max(y0 + 1, y1), max(0, x0) : max(x0 + 1, x1)] = colour

    def bars(self, at, groups: list[list[float]], first: int = 0) -> None:
        """Grouped bars over a zero line; `groups` holds a list of values for each series."""
        top, bottom, left, right = at
        values = np.nan_to_num(np.array(groups, float))
        low, high = min(0.0, values.min()), max(0.0, values.max())
        y = lambda v: bottom - (v - low) / max(high - low, 1e-9) * (bottom - top)
        slot = (right - left) / values.shape[1]
        for s, series in enumerate(values):
            for i, v in enumerate(series):
                x = left + i * slot + slot * (0.1 + 0.8 * s / len(values))
                self.fill(y(v), y(0), x, x + slot * 0.8 / len(values) - 1, self.colours[(first + s) % 4])
                if self.style.show_data_labels:
                    self.fill(y(v) - 2, y(v), x, x + slot * 0.8 / len(values) - 1, (128, 128, 128))
        self.fill(y(0) - 0.5, y(0) + 0.5, left, right, (128, 128, 128))

    def line(self, at, values: list[float], colour: int) -> None:
        top, bottom, left, right = at
        v = np.nan_to_num(np.array(values, float))
        low, high = v.min(), max(v.max(), v.min() + 1e-9)
        x = np.linspace(left + 8, right - 8, len(v))
        fine = np.arange(int(x[0]), int(x[-1]) + 1)
        y = np.interp(fine, x, bottom - (v - low) / (high - low) * (bottom - top))
        for a, b in zip(fine, np.round(y).astype(int)):
            self.pixels[max(0, b - 1) : b + 2, a] = self.colours[colour % 4]

    def pie(self, at, shares: list[float]) -> None:
        top, bottom, left, right = at
        radius = min(bottom - top, right - left) / 2
        yy, xx = np.mgrid[0 : self.style.height_px, 0 : self.style.width_px]
        dy, dx = yy - (top + bottom) / 2, xx - (left + right) / 2
        turn = (np.arctan2(dx, -dy) / (2 * np.pi)) % 1
        ends = np.cumsum(np.maximum(shares, 0)) / max(sum(max(s, 0) for s in shares), 1e-9)
        piece = np.searchsorted(ends, turn.ravel(), side="right").reshape(turn.shape)
        inside = dy**2 + dx**2 <= radius**2
        self.pixels[inside] = np.array(self.colours, np.uint8)[np.minimum(piece[inside], len(shares) - 1) % 4]

    def png(self) -> bytes:
        h, w, _ = self.pixels.shape
        rows = np.zeros((h, 1 + 3 * w), np.uint8)
        rows[:, 1:] = self.pixels.reshape(h, 3 * w)
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def _growth(values) -> list[float]:
    return [0.0, *((b / a - 1) * 100 if a else 0.0 for a, b in zip(values[:-1], values[1:]))]


def financial(c: Canvas, e: dict) -> None:
    """Revenue, cost and profit as bars, the margin as a line."""
    c.bars(c.panel(), [e["revenue"], e["cost"], e["profit"]])
    c.line(c.panel(), e["margin"], 3)


def operations(c: Canvas, e: dict) -> None:
    """Users with revenue per user, and conversion with the cost of winning a user."""
    for row, (bars, line) in enumerate((("users", "arpu"), ("cac", "conversion"))):
        c.bars(c.panel(row, 0, 2), [e[bars]], row)
        c.line(c.panel(row, 0, 2), e[line], row + 2)


def growth(c: Canvas, e: dict) -> None:
    """Yearly growth of revenue and users, and the margin."""
    c.bars(c.panel(), [_growth(e["revenue"]), _growth(e["users"])])
    c.line(c.panel(), e["margin"], 3)


def composition(c: Canvas, e: dict) -> None:
    """Shares of products, by size and in order."""
    shares = list(dict(e["product_mix_pct"]).values())
    c.pie(c.panel(0, 0, 1, 2), sorted(shares, reverse=True))
    c.pie(c.panel(0, 1, 1, 2), shares)


def dashboard(c: Canvas, e: dict) -> None:
    """Four panels: revenue, users, margin, shares."""
    c.bars(c.panel(0, 0, 2, 2), [e["revenue"]])
    c.bars(c.panel(0, 1, 2, 2), [e["users"]], 1)
    c.line(c.panel(1, 0, 2, 2), e["margin"], 2)
    c.pie(c.panel(1, 1, 2, 2), list(dict(e["product_mix_pct"]).values()))


#: View to renderer; a caller may add entries.
RENDERERS = {"financial": financial, "operations": operations, "growth": growth, "composition": composition, "dashboard": dashboard}


def rendered(charts: DataFrame, seed: int, renderers: dict = RENDERERS) -> DataFrame:
    """chart_id, content (PNG), chart_style of `charts`: an entity's columns (see facts.synthetic_entities) with view_type and chart_id."""
    ship_package(charts.sparkSession)

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                style = style_of(row["chart_id"], seed)
                canvas = Canvas(style)
                renderers[row["view_type"]](canvas, row)
                out.append((row["chart_id"], canvas.png(), style._asdict()))
            yield pd.DataFrame(out, columns=["chart_id", "content", "chart_style"])

    return charts.mapInPandas(draw, "chart_id string, content binary, chart_style struct<style:string,show_data_labels:boolean,width_px:int,height_px:int,dpi:int>")
