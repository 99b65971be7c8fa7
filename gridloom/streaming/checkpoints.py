"""Grouping that keeps its state in files of the shared folder and goes on from there, and late merges of groups."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.runtime import put_in_place, qualified
from gridloom.streaming.grouping import CHANGE, GEOMETRY, OUT, SAME, Grouper, distance, rows_of

EVERY = 32
NEAR = 0.10  # fixed value: up to this distance a fingerprint is that of an open group
SELECTOR = hashlib.sha256(json.dumps([CHANGE, SAME, GEOMETRY]).encode()).hexdigest()


class CheckpointInvalid(ValueError):
    """A stored state does not fit its input or the thresholds."""


def check_state(state: dict, groups: list) -> None:
    """Raise :class:`CheckpointInvalid` unless the state can be what a run of this grouping left behind."""
    group, held = state.get("group"), state.get("held")
    seen = [o for o in (([group[3]] if group else []) + ([held] if held else []))]
    if (
        state.get("schema") != 1
        or state.get("selector") != SELECTOR
        or not isinstance(state.get("processed"), int)
        or state["processed"] < 1
        or state.get("finalized") != len(groups)
        or [g[0] for g in groups] != list(range(len(groups)))
        or group is None
        or any(o[0] > state["next"] for o in seen)
    ):
        raise CheckpointInvalid(f"the state of run {state.get('run')!r} is inconsistent")


class _Store:
    """States of runs, a file for every ``EVERY`` observations, with the groups closed since the file before."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.selector = fs.FileSelector

    def place(self, run: str) -> str:
        return f"{self.root}/{hashlib.sha256(run.encode()).hexdigest()}"

    def load(self, run: str) -> tuple[dict | None, list]:
        files = sorted(f.path for f in self.fs.get_file_info(self.selector(self.place(run), allow_not_found=True)) if f.path.endswith(".json"))
        state, groups = None, []
        for name in files:
            with self.fs.open_input_stream(name) as f:
                state = json.loads(f.read())
            groups += [tuple(g) for g in state.pop("closed")]
        if state is not None:
            check_state(state, groups)
        return state, groups

    def save(self, run: str, state: dict, closed: list) -> None:
        folder = self.place(run)
        self.fs.create_dir(folder, recursive=True)
        name = f"{folder}/{state['processed']:012d}.json"
        with self.fs.open_output_stream(name + ".part") as f:
            f.write(json.dumps({**state, "closed": closed}).encode())
        put_in_place(self.fs, name + ".part", name)


def group_with_checkpoints(df: DataFrame, folder: str, stop_after: int | None = None) -> DataFrame:
    """The groups of :func:`gridloom.streaming.grouping.group_observations`, with the state of every run kept in ``folder``.

    A run goes on from its last stored state: what was processed before is passed over, and must end with the observation
    that the state names. States that do not fit are errors, as are observations that changed. ``stop_after`` ends every
    run after so many observations, as an interruption would; what was not stored by then is lost and done again.
    """
    folder = qualified(df.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name, out = _Store(folder), None, []
        grouper, groups, closed, n, skip, after = None, [], [], 0, 0, None

        def end() -> None:
            nonlocal groups, closed
            if grouper is not None and stop_after is None:
                if n < skip:
                    raise CheckpointInvalid(f"run {name!r} has fewer observations than were processed")
                out.extend((name, *g) for g in [*groups, *closed, *grouper.finish()])

        for batch in batches:
            for r, order, print_, quality, geometry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if grouper is None or r != name:
                    end()
                    name, n, closed = r, 0, []
                    state, groups = store.load(r)
                    skip, after = (state["processed"], state["next"]) if state else (0, None)
                    back = lambda g: None if g is None else (g[0], g[1], g[2], tuple(g[3]))
                    grouper = Grouper((state["finalized"], back(state["group"]), None if state["held"] is None else tuple(state["held"])) if state else None)
                n += 1
                if n <= skip:
                    if n == skip and order != after:
                        raise CheckpointInvalid(f"run {name!r} was changed before its state")
                    continue
                if stop_after is not None and n > stop_after:
                    continue
                closed += grouper.feed((order, print_ or "", quality or 0.0, geometry or 0.0))
                if n % EVERY == 0:
                    number, group, held = grouper.state
                    store.save(name, {"schema": 1, "selector": SELECTOR, "run": name, "next": order, "processed": n, "finalized": number, "group": group, "held": held}, closed)
                    groups, closed = [*groups, *closed], []
            if len(out) > 5000:
                yield rows_of(out)
                out.clear()
        end()
        yield rows_of(out)

    src = df.selectExpr("cast(run as string) run", "cast(`order` as bigint) `order`", "fingerprint", "cast(quality as double) quality", "cast(geometry as double) geometry")
    return src.repartition("run").sortWithinPartitions("run", "order").mapInArrow(run, OUT)


MERGED = "run string, group_order int, status string, duplicate_of int, closed_by int"


def late_merge(groups: DataFrame) -> DataFrame:
    """``(run, group_order, status, duplicate_of, closed_by)`` of ``groups(run, group_order, range_start, range_end,
    fingerprint, resolved)``.

    In the order of its run, a resolved group of a range that is done already is a duplicate of the group that has it. A
    resolved one otherwise closes an open group before it: that of the same range, else the first whose fingerprint is
    within ``NEAR``; the open group then has the range, and the resolved one is its duplicate. Without such a group it has
    the range itself (``selected``). Groups that are not resolved are ``open`` until one closes them (``closed``). A run is
    one task's, as it is sequential; only its open groups and its ranges are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, result = None, {}
        done: dict[tuple, int] = {}
        by_range: dict[tuple, int] = {}
        prints: dict[int, str] = {}

        def out() -> pa.RecordBatch:
            rows = [(name, k, *v) for k, v in result.items()]
            types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in MERGED.split(", ")])

        for batch in batches:
            for r, order, start, stop, print_, resolved in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != name:
                    yield out()
                    name, result = r, {}
                    done, by_range, prints = {}, {}, {}
                key = None if start is None or stop is None else (start, stop)
                if not resolved or key is None:
                    result[order] = ("open", None, None)
                    if key is not None:
                        by_range.setdefault(key, order)
                    prints[order] = print_ or ""
                    continue
                if key in done:
                    result[order] = ("duplicate", done[key], None)
                    continue
                earlier = by_range.get(key)
                if earlier is None:
                    earlier = min((k for k, p in prints.items() if distance(print_ or "", p) <= NEAR), default=None)
                if earlier is None:
                    result[order], done[key] = ("selected", None, None), order
                    continue
                result[order], result[earlier], done[key] = ("duplicate", earlier, None), ("closed", None, order), earlier
                by_range = {k: v for k, v in by_range.items() if v != earlier}
                prints.pop(earlier, None)
        yield out()

    src = groups.selectExpr("cast(run as string) run", "cast(group_order as int) group_order", "cast(range_start as bigint) a", "cast(range_end as bigint) b", "fingerprint", "coalesce(resolved, false) resolved")
    return src.repartition("run").sortWithinPartitions("run", "group_order").mapInArrow(run, MERGED)
