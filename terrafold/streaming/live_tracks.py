"""Site tracks over a stream of epochs, one state a region cell.

Sites arrive as rows (site_id, date, cx, cy, area). A cell's live tracks are its state: place,
filtered area and velocity, and when they were last seen. Within a micro-batch a cell's sites are
taken by date and site_id, each to the nearest live track within reach. A track that is not seen
for timeout_ms of event time is closed and forgotten. Sites never match across cells; where that
matters, the batch form in operators.tracks is the reference.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracks import OBSERVATION_NOISE, PROCESS_NOISE

OUTPUT = "cell string, track_id string, site_id long, date timestamp, area_smoothed double, event string"
STATE = "tracks array<struct<id:int,cx:double,cy:double,x:double,v:double,a:double,b:double,d:double,seen:bigint>>, next int"


def _advance(t: dict, area: float) -> None:
    level, p00 = t["x"] + t["v"], t["a"] + 2 * t["b"] + t["d"] + PROCESS_NOISE
    p01, p11 = t["b"] + t["d"], t["d"] + PROCESS_NOISE
    k0, k1, gap = p00 / (p00 + OBSERVATION_NOISE), p01 / (p00 + OBSERVATION_NOISE), area - level
    t.update(x=level + k0 * gap, v=t["v"] + k1 * gap, a=(1 - k0) * p00, b=(1 - k0) * p01, d=p11 - k1 * p01)


def live_tracks(sites: DataFrame, cell_m: float = 5000.0, reach_m: float = 150.0, watermark: str = "60 days", timeout_ms: int = 180 * 86_400_000) -> DataFrame:
    """A streaming frame of (cell, track_id, site_id, date, area_smoothed, event): new and seen
    rows as sites come, closed ones when a track's time is out."""
    names = ("id", "cx", "cy", "x", "v", "a", "b", "d", "seen")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (cell,) = key
        old = state.get if state.exists else ([], 1)
        tracks, number = [dict(zip(names, t)) for t in old[0]], old[1]
        name = lambda t: f"{cell}_{t['id']:04d}"
        rows: list[tuple] = []
        now = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            new = pd.concat(list(frames)).sort_values(["date", "site_id"])
            used: set = set()
            for s in new.itertuples():
                ms = int(s.date.timestamp() * 1000)
                free = [t for t in tracks if (t["id"], ms) not in used and (t["cx"] - s.cx) ** 2 + (t["cy"] - s.cy) ** 2 <= reach_m**2]
                best = min(free, key=lambda t: ((t["cx"] - s.cx) ** 2 + (t["cy"] - s.cy) ** 2, t["id"]), default=None)
                event = "seen"
                if best is None:
                    best = dict(id=number, cx=s.cx, cy=s.cy, x=float(s.area), v=0.0, a=1.0, b=0.0, d=1.0, seen=ms)
                    number, event = number + 1, "new"
                    tracks.append(best)
                else:
                    _advance(best, float(s.area))
                    best.update(cx=s.cx, cy=s.cy, seen=max(best["seen"], ms))
                used.add((best["id"], ms))
                rows.append((cell, name(best), s.site_id, s.date, best["x"], event))
        closed = [t for t in tracks if t["seen"] + timeout_ms <= now]
        rows += [(cell, name(t), None, pd.Timestamp(t["seen"], unit="ms"), t["x"], "closed") for t in closed]
        tracks = [t for t in tracks if t["seen"] + timeout_ms > now]
        if tracks:
            state.update(([tuple(t[n] for n in names) for t in tracks], number))
            state.setTimeoutTimestamp(max(now + 1, min(t["seen"] for t in tracks) + timeout_ms))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=["cell", "track_id", "site_id", "date", "area_smoothed", "event"])

    keyed = sites.withWatermark("date", watermark).withColumn("cell", F.concat_ws("_", F.floor(F.col("cx") / cell_m).cast("string"), F.floor(F.col("cy") / cell_m).cast("string")))
    keyed = keyed.select("cell", "site_id", "date", "cx", "cy", "area")
    return keyed.groupBy("cell").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
