"""Boundary-driven grouping of an ordered stream of observations, in batch and as a stateful stream.

An observation may begin a new group when its fingerprint is far from the one of the best observation of the open
group. It is held back until the next one: if that is close to it, both open a group; if not, the one held back is a
group of its own, and the next one opens another. The state is the open group and at most one held observation.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The thresholds of the boundary.
CHANGE, SAME, GEOMETRY = 0.22, 0.16, 0.64
OUT = "run string, group_order int, first_order bigint, last_order bigint, source_count bigint, reference_order bigint, reference_quality double"


def distance(a: str, b: str) -> float:
    """Share of differing bits of two hex strings of equal length, else 1."""
    return (int(a, 16) ^ int(b, 16)).bit_count() / (4 * len(a)) if len(a) == len(b) and a else 1.0


class Grouper:
    """The state machine of one run. ``feed`` takes (order, fingerprint, quality, geometry) and returns the groups
    that it closes; ``state`` is a plain tuple, from which ``Grouper(state)`` goes on."""

    def __init__(self, state: tuple | None = None):
        self.number, self.group, self.held = state or (0, None, None)

    @property
    def state(self) -> tuple:
        return self.number, self.group, self.held

    def _open(self, *observations) -> None:
        self.group = None
        for o in observations:
            self._add(o)

    def _add(self, o) -> None:
        if self.group is None:
            self.group = (o[0], o[0], 1, o)
            return
        first, _, n, best = self.group
        self.group = (first, o[0], n + 1, o if (-o[2], o[0]) < (-best[2], best[0]) else best)

    def _close(self) -> tuple:
        first, last, n, best = self.group
        self.number += 1
        return self.number - 1, first, last, n, best[0], best[2]

    def feed(self, o) -> list[tuple]:
        if self.group is None:
            self._open(o)
            return []
        if self.held is not None:
            held, self.held = self.held, None
            done = [self._close()]
            if distance(held[1], o[1]) <= SAME:
                self._open(held, o)
            else:
                self._open(held)
                done.append(self._close())
                self._open(o)
            return done
        best = self.group[3]
        if min(best[3], o[3]) >= GEOMETRY and distance(best[1], o[1]) >= CHANGE:
            self.held = o
        else:
            self._add(o)
        return []

    def finish(self) -> list[tuple]:
        if self.group is None:
            return []
        done = [self._close()]
        if self.held is not None:
            self._open(self.held)
            done.append(self._close())
        self.group = self.held = None
        return done


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in OUT.split(", ")])


def group_observations(df: DataFrame) -> DataFrame:
    """Groups of every run of ``(run, order, fingerprint, quality, geometry)``, in the order of ``order``.

    A run is sequential by nature, so it is one task's; but it is streamed through it, sorted by the shuffle, and
    never held. Null fingerprints differ from every other; null qualities and geometries are 0.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, grouper, out = None, None, []
        for batch in batches:
            for r, order, print_, quality, geometry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if grouper is None or r != name:
                    if grouper is not None:
                        out += [(name, *g) for g in grouper.finish()]
                    name, grouper = r, Grouper()
                out += [(name, *g) for g in grouper.feed((order, print_ or "", quality or 0.0, geometry or 0.0))]
            if len(out) > 5000:
                yield rows_of(out)
                out = []
        if grouper is not None:
            out += [(name, *g) for g in grouper.finish()]
        yield rows_of(out)

    src = df.selectExpr("cast(run as string) run", "cast(`order` as bigint) `order`", "fingerprint", "cast(quality as double) quality", "cast(geometry as double) geometry")
    return src.repartition("run").sortWithinPartitions("run", "order").mapInArrow(run, OUT)


def group_stream(stream: DataFrame) -> DataFrame:
    """The same on a stream: state by run, closed groups are appended. The last group of a run stays open, as more
    may come. Observations of a run must arrive in order (within a micro-batch any order does)."""
    import pickle

    import pandas as pd

    def step(key, frames, state):
        rows = pd.concat(list(frames)).sort_values("order")
        grouper = Grouper(pickle.loads(state.get[0]) if state.exists else None)
        out = [(key[0], *g) for o in rows.itertuples(index=False) for g in grouper.feed((int(o.order), o.fingerprint or "", float(o.quality), float(o.geometry)))]
        state.update((pickle.dumps(grouper.state),))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])

    src = stream.selectExpr("cast(run as string) run", "cast(`order` as bigint) `order`", "fingerprint", "cast(quality as double) quality", "cast(geometry as double) geometry")
    return src.groupBy("run").applyInPandasWithState(step, OUT, "state binary", "append", "NoTimeout")
