"""Alignment logs as drawings: the metric by iteration, one curve for each resolution, as SVG."""

from __future__ import annotations

from pathlib import Path

COLOURS = ("#1f6fb2", "#c8553d", "#4a8f4f", "#8a5aa8", "#b58900", "#2a9d8f")


def curve(points: list[tuple[float, float]], x: tuple[float, float], y: tuple[float, float], size: tuple[int, int], margin: int) -> str:
    """Points of a polyline within the frame; x, y: the ranges that fill it."""
    w, h = (n - 2 * margin for n in size)
    at = lambda v, ends, n: (v - ends[0]) / (ends[1] - ends[0] or 1) * n
    return " ".join(f"{margin + at(a, x, w):.2f},{size[1] - margin - at(b, y, h):.2f}" for a, b in points)


def plot(series: dict[int, list[tuple[int, float]]], title: str, size: tuple[int, int] = (640, 360), margin: int = 48) -> str:
    """An SVG of (iteration, metric) by resolution."""
    values = [p for s in series.values() for p in s]
    x, y = ((min(p[k] for p in values), max(p[k] for p in values)) for k in (0, 1))
    lines = [f'<polyline fill="none" stroke="{COLOURS[k % len(COLOURS)]}" stroke-width="1.5" points="{curve(s, x, y, size, margin)}"/>' for k, (_, s) in enumerate(sorted(series.items()))]
    keys = [f'<text x="{size[0] - margin + 4}" y="{margin + 14 * k}" fill="{COLOURS[k % len(COLOURS)]}">R{r}</text>' for k, r in enumerate(sorted(series))]
    frame = f'<rect x="{margin}" y="{margin}" width="{size[0] - 2 * margin}" height="{size[1] - 2 * margin}" fill="none" stroke="#999"/>'
    ends = [f'<text x="{margin}" y="{size[1] - margin + 14}">{x[0]}</text>', f'<text x="{size[0] - margin}" y="{size[1] - margin + 14}" text-anchor="end">{x[1]}</text>', f'<text x="4" y="{size[1] - margin}">{y[0]:.4g}</text>', f'<text x="4" y="{margin}">{y[1]:.4g}</text>']
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size[0]}" height="{size[1]}" font-family="sans-serif" font-size="11"><rect width="100%" height="100%" fill="white"/><text x="{margin}" y="20" font-size="13">{title}</text>{frame}{"".join([*lines, *keys, *ends])}</svg>'


def write_plots(log: list[tuple[int, int, int, float]], path: str) -> list[str]:
    """<path>_<stage>.svg for each stage of a log of (stage, resolution, iteration, metric)."""
    out = []
    for stage in sorted({r[0] for r in log}):
        series: dict[int, list[tuple[int, float]]] = {}
        for s, resolution, iteration, metric in log:
            if s == stage:
                series.setdefault(resolution, []).append((iteration, metric))
        Path(f"{path}_{stage}.svg").write_text(plot(series, f"stage {stage}"))
        out.append(f"{path}_{stage}.svg")
    return out
