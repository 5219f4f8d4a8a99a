"""Speeds of road links from a vehicle's map-matched traces, in batch and as a stream.

A vehicle's events are links, in the order driven, and traces on them: (time in ms, fraction
of the link behind it). Between two traces on different links, time is shared in proportion
to free-flow times; a link's quality is the share of its way that traces cover.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

OUT = "vehicle_id bigint, link_id bigint, link_entered_ts bigint, quality float, velocity float"


class TraceError(ValueError):
    pass


@dataclass
class Link:
    link_id: int
    length: int  # mm
    speed_limit: int  # km/h

    @property
    def free_flow(self) -> float:
        return self.length * 3.6 / self.speed_limit


@dataclass
class Estimator:
    """The state of one vehicle: the link with the last trace, when it was entered (None until
    known), that trace, and the links since."""

    link: Link | None = None
    entered: int | None = None
    quality: float = 0.0
    ts: int | None = None
    fraction: float = 0.0
    since: list[Link] = field(default_factory=list)

    def on_link(self, link: Link) -> None:
        if self.link is None:
            self.link = link
        elif self.ts is None:
            raise TraceError("no trace on the first link")
        else:
            self.since.append(link)

    def on_trace(self, ts: int, link_id: int, fraction: float) -> list[tuple[int, int, float, float]]:
        fraction = float(np.float32(fraction))
        if self.link is None:
            raise TraceError("trace before the first link")
        current = self.since[-1] if self.since else self.link
        if current.link_id != link_id:
            raise TraceError(f"trace on {link_id}, vehicle on {current.link_id}")
        if self.since:
            return self._advance(ts, fraction)
        if self.ts is None:
            self.ts, self.fraction = ts, fraction
        elif self.entered is None:
            covered = fraction - self.fraction
            self.entered = self.ts - int((ts - self.ts) * self.fraction / covered)
            self.quality, self.ts, self.fraction = covered, ts, fraction
        else:
            self.quality += float(np.float32(fraction) - np.float32(self.fraction))
            self.ts, self.fraction = ts, fraction
        return []

    def _advance(self, ts: int, fraction: float) -> list[tuple[int, int, float, float]]:
        *between, last = self.since
        rest = 1.0 - self.fraction
        after = int(rest * self.link.length)
        before = int(fraction * last.length)
        total = after + sum(x.length for x in between) + before
        free = self.link.free_flow * rest + sum(x.free_flow for x in between) + last.free_flow * fraction
        factor = free / (ts - self.ts)
        pace = self.link.speed_limit * factor
        spent = int(after * 3.6 / pace)
        share = after / total * rest
        if self.entered is None:
            entered, velocity, quality = self.ts - int((self.link.length - after) * 3.6 / pace), pace, share
        else:
            entered, velocity, quality = self.entered, self.link.length / (self.ts - self.entered + spent) * 3.6, share + self.quality
        out = [(self.link.link_id, entered, quality, velocity)]
        clock = self.ts + spent
        for x in between:
            out.append((x.link_id, clock, x.length / total, x.speed_limit * factor))
            clock += int(x.length * 3.6 / (x.speed_limit * factor))
        self.entered = ts - int(before * 3.6 / (last.speed_limit * factor))
        self.quality = before / total * fraction
        self.link, self.ts, self.fraction, self.since = last, ts, fraction, []
        return out

    def finish(self) -> list[tuple[int, int, float, float]]:
        if self.link is None or self.entered is None or self.since:
            raise TraceError("the events end before the last link has an entry and a trace")
        return [(self.link.link_id, self.entered, self.quality, self.fraction * self.link.length / (self.ts - self.entered) * 3.6)]


def estimate(links: list[tuple[int, int, int]], traces: list[tuple[int, int, float]]) -> list[tuple[int, int, float, float]]:
    """Both lists in driving order; links (id, mm, km/h), traces (ms, link id, fraction)."""
    if not links or not traces:
        raise TraceError("no links or no traces")
    e, out, k = Estimator(), [], 0
    for link in links:
        e.on_link(Link(*link))
        while k < len(traces) and traces[k][1] == link[0]:
            out += e.on_trace(*traces[k])
            k += 1
    if k < len(traces):
        raise TraceError("trace on a link that isn't driven")
    return out + e.finish()


def link_speeds(events: DataFrame) -> DataFrame:
    """Batch form. ``events``: vehicle_id, seq, kind ('link' or 'trace'), link_id, length,
    speed_limit, ts, fraction. A vehicle whose events contradict each other gives no rows.

    A group is one vehicle's trip, read once in the order of ``seq``.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        e, out = Estimator(), []
        try:
            for r in rows.sort_values("seq").itertuples():
                if r.kind == "link":
                    e.on_link(Link(int(r.link_id), int(r.length), int(r.speed_limit)))
                else:
                    out += e.on_trace(int(r.ts), int(r.link_id), float(r.fraction))
            out += e.finish()
        except TraceError:
            out = []
        return pd.DataFrame([(key[0], *x) for x in out], columns=["vehicle_id", "link_id", "link_entered_ts", "quality", "velocity"])

    return events.groupBy("vehicle_id").applyInPandas(run, OUT)


STATE = "state string"


def _dump(e: Estimator) -> str:
    import json

    return json.dumps(asdict(e))


def _load(text: str) -> Estimator:
    import json

    d = json.loads(text)
    d["link"] = d["link"] and Link(**d["link"])
    d["since"] = [Link(**x) for x in d["since"]]
    return Estimator(**d)


def link_speeds_stream(events: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """Streaming form: state per vehicle between micro-batches, flushed after ``idle_ms`` without
    events. Events of a vehicle must not arrive out of order across batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["vehicle_id", "link_id", "link_entered_ts", "quality", "velocity"]
        e = _load(state.get[0]) if state.exists else Estimator()
        out: list[tuple] = []
        try:
            if state.hasTimedOut:
                out = e.finish()
                state.remove()
            else:
                for r in pd.concat(list(batches)).sort_values("seq").itertuples():
                    if r.kind == "link":
                        e.on_link(Link(int(r.link_id), int(r.length), int(r.speed_limit)))
                    else:
                        out += e.on_trace(int(r.ts), int(r.link_id), float(r.fraction))
                state.update((_dump(e),))
                state.setTimeoutDuration(idle_ms)
        except TraceError:
            if state.exists:
                state.remove()
        yield pd.DataFrame([(key[0], *x) for x in out], columns=columns)

    return events.groupBy("vehicle_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
