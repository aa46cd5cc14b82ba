"""Charts and censuses out of JSON text, strictly: what has another shape than expected is drift, with a reason."""

from __future__ import annotations

import json
import re

INT_MAX = 2_147_483_647


class Drift(Exception):
    """A page that isn't as it used to be."""


def inline_object(html: str, marker: str) -> dict | None:
    """The JSON object written after a marker, to the brace that closes it; null where there is no marker."""
    at = html.find(marker)
    if at < 0:
        return None
    start = html.find("{", at + len(marker))
    if start < 0:
        raise Drift(f"{marker}: no object follows")
    depth = 0
    for m in re.finditer("[{}]", html[start:]):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return strict_object(html[start : start + m.end()], marker)
    raise Drift(f"{marker}: the object never closes")


def strict_object(text: str, what: str) -> dict:
    def bad(constant: str):
        raise ValueError(constant)

    try:
        got = json.loads(text, parse_constant=bad)
    except ValueError:
        raise Drift(f"{what}: not valid JSON") from None
    if not isinstance(got, dict):
        raise Drift(f"{what}: not an object")
    return got


def _whole(x, most: int) -> bool:
    return type(x) is int and -most - 1 <= x <= most


def read_chart(chart: dict | None, series: dict[str, str]) -> list[tuple[str, int, int]]:
    """``(tier, epoch milliseconds, cents)`` of each point. Further elements of a point are ignored."""
    if chart is None:
        raise Drift("no chart")
    if strange := sorted(set(chart) - set(series)):
        raise Drift(f"unknown series: {','.join(strange)}")
    out = []
    for name, points in chart.items():
        if not isinstance(points, list):
            raise Drift(f"series {name}: not a list")
        for p in points:
            if not isinstance(p, list) or len(p) < 2 or not _whole(p[0], (1 << 63) - 1) or not _whole(p[1], INT_MAX):
                raise Drift(f"series {name}: a point is not two whole numbers")
            # A day must be a date of four-digit years.
            if not -62_135_596_800_000 <= p[0] < 253_402_300_800_000:
                raise Drift(f"series {name}: a point has no day")
            out.append((series[name], p[0], p[1]))
    return out


def read_census(census: dict | None, graders: tuple[str, ...] | list[str]) -> dict[str, list[int]] | None:
    """Counts by grader; an empty list for a grader that isn't there, null where there is no census."""
    if census is None:
        return None
    if strange := sorted(set(census) - set(graders)):
        raise Drift(f"unknown graders: {','.join(strange)}")
    for grader, counts in census.items():
        if not isinstance(counts, list) or not all(_whole(n, INT_MAX) for n in counts):
            raise Drift(f"grader {grader}: not a list of whole numbers")
    return {g: census.get(g, []) for g in graders}
