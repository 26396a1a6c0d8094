"""A feed for the tests: a temperature every 100 seconds, rain every 200; each answer reaches beyond what was asked."""

import json
import tempfile
from pathlib import Path

STATE = Path(tempfile.gettempdir()) / "stationlake-feed-state.json"


def fetch(start: int, end: int) -> list[tuple[int, str, float]]:
    times = range(start // 100 * 100 - 100, end + 200, 100)
    return [(t, "temp", t / 10) for t in times] + [(t, "rain", 1.0) for t in times if t % 200 == 0]


def failing(start: int, end: int) -> list[tuple[int, str, float]]:
    if start == 300:
        raise OSError("no answer")
    return fetch(start, end)


def places(asked, start, end):
    """Two hours of each place; a batch with ``bad`` in it fails, ``none`` has nothing."""
    if any(p[0] == "bad" for p in asked):
        raise OSError("no answer")
    return [[(t, f"asked:{len(asked)}:{start}:{end}", lat + t) for t in (0, 3600, 7200)] if name != "none" else None for name, lat, _ in asked]


def _state() -> dict:
    """What the tests let the feed know, in a file, as workers have an environment of their own."""
    return json.loads(STATE.read_text())


def now() -> int:
    return _state()["now"]


def late(start: int, end: int) -> list[tuple[int, str, float]]:
    """A value every 300 seconds that is 0 until it has settled, 600 seconds on; nothing from the future."""
    state = _state()
    with open(state["log"], "a") as f:
        f.write(f"{start}\n")
    return [(t, "temp", float(t) if t + 600 <= state["now"] else 0.0) for t in range(start, end, 300) if t <= state["now"]]
