"""State machines per key: slots whose first content wins, captures with a fallback source, and late labels.

Each is a ``transformWithState`` over one feed, with state in the state store and timers of event time. What a key
remembers is one JSON text, so that a key costs one read and one write for each batch. Times are milliseconds.

Rows that carry no ``clock`` are never late for Spark: the watermark neither waits for them nor drops them."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

HOUR = 3_600_000


def _fields(feed: DataFrame, names: list[str]) -> StructType:
    return StructType([feed.schema[n] for n in names])


class _Machine(StatefulProcessor):
    """Keeps one JSON text for each key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("kept", "text string")

    def recall(self) -> dict:
        found = self.kept.get()
        return json.loads(found[0]) if found else {}

    def keep(self, state: dict) -> None:
        self.kept.update((json.dumps(state, sort_keys=True),))

    def alarm(self, state: dict, at: int | None) -> None:
        """The key's only timer: at ``at``, or none."""
        if state.get("alarm") != at:
            if state.get("alarm") is not None:
                self.handle.deleteTimer(state["alarm"])
            if at is not None:
                self.handle.registerTimer(at)
            state["alarm"] = at

    def close(self) -> None:
        pass


class Slots(_Machine):
    """The first content of a slot is accepted; the same again is nothing, another is a collision."""

    def __init__(self, names: list[str], slot: list[str]):
        self.names, self.slot = names, slot

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, out = self.recall(), []
        for r in sorted(rows, key=lambda r: (r["_at"], r["_hash"])):
            name = json.dumps([str(r[c]) for c in self.slot])
            known = name in state
            first = state.setdefault(name, r["_hash"])
            if not known or first != r["_hash"]:
                out.append(Row(**{c: r[c] for c in self.names}, outcome="collision" if known else "accepted", accepted_hash=first))
        self.keep(state)
        return iter(out)


def slots(feed: DataFrame, keys: list[str], slot: list[str], payload: str, clock: str) -> DataFrame:
    """Rows of the feed with ``outcome`` (accepted or collision) and the hash that the slot holds. A slot is named
    by ``keys`` and ``slot``. Identical replays give no row, however late they come: state is kept for as long as the
    stream's checkpoint. Rows of one batch that meet in a slot go by clock, then by hash."""
    names = [c for c in feed.columns]
    d = feed.select(*names, F.sha2(F.col(payload).cast("string"), 256).alias("_hash"), F.expr(f"unix_micros(`{clock}`)").alias("_at"))
    kinds = _fields(feed, names).add("outcome", "string").add("accepted_hash", "string")
    return d.groupBy(*keys).transformWithState(Slots(names, slot), kinds, "Append", "None")


class Captures(_Machine):
    """An event's schedule, two source slots, and its status over time.

    Rows wait until the watermark has passed them, so that they take effect in the order of their clocks, and of their
    kind at one instant, whatever order they come in. The start of an event takes effect before rows of that instant, other deadlines
    after them."""

    ORDER = {"schedule": 1, "first": 2, "second": 3}

    def __init__(self, keys: list[str], wait: int):
        self.keys, self.wait = keys, wait

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self.recall()
        todo = state.setdefault("todo", [])
        todo += [[r["at"], self.ORDER[r["kind"]], r["kind"], r["value"], r["scheduled"], r["start"]] for r in rows if r["kind"] in self.ORDER]
        todo.sort(key=lambda x: (x[0], x[1], str(x[3:])))
        self._wake(state)
        self.keep(state)
        return iter(())

    def _deadline(self, state: dict) -> tuple[int, int] | None:
        """The next deadline and its order among what happens at that instant."""
        return min(map(tuple, state.get("deadlines", [])), default=None)

    def _wake(self, state: dict) -> None:
        times = [x[0] for x in state["todo"][:1]] + [x[0] for x in [self._deadline(state)] if x]
        self.alarm(state, min(times, default=None))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, out = self.recall(), []
        now = timerValues.getCurrentWatermarkInMs()
        state["alarm"] = None  # it has gone off
        while True:
            row, deadline = (state["todo"] or [None])[0], self._deadline(state)
            if row is not None and row[0] > now:
                row = None
            if deadline is not None and deadline[0] > now:
                deadline = None
            if row is None and deadline is None:
                break
            if deadline is not None and (row is None or deadline < (row[0], row[1])):
                state["deadlines"].remove(list(deadline))
                change = self._passed(state, *deadline)
                at = deadline[0]
            else:
                state["todo"].pop(0)
                change, at = self._arrived(state, *row), row[0]
            if change:
                state["status"] = change
                out.append(Row(**{c: key[i] for i, c in enumerate(self.keys)}, at=at, status=change, value=state.get("first") or state.get("second_used")))
        self._wake(state)
        self.keep(state)
        return iter(out)

    def _arrived(self, s: dict, at: int, order: int, kind: str, value: str | None, scheduled: int, start: int) -> str | None:
        if s.get("over"):
            return None
        if kind == "schedule":
            if "start" not in s:
                s.update(start=start, scheduled=scheduled, deadlines=[[start, 0], [scheduled, 8], [scheduled + self.wait, 9]])
                return None if "first" in s else "waiting_for_qualifying"
            if start != s["start"] and not s.get("review"):
                s["review"] = True
                return "schedule_changed_review_required"
            return None
        if value is None or s.get("review") or "first" in s:
            return None
        if kind == "first":
            s["first"] = value
            return "captured"
        s["second"] = value
        return self._provisional(s) if "scheduled" in s and at >= s["scheduled"] + self.wait else None

    def _provisional(self, s: dict) -> str | None:
        if "first" in s or "second" not in s or s.get("second_used") == s["second"] or s.get("review"):
            return None
        s["second_used"] = s["second"]
        return "provisional"

    def _passed(self, s: dict, at: int, order: int) -> str | None:
        if order == 0:
            s["over"] = True
            return "closed" if "first" in s else "missed"
        if s.get("over") or s.get("review") or "first" in s:
            return None
        return "waiting_for_qualifying_results" if order == 8 else self._provisional(s)


def captures(feed: DataFrame, keys: list[str], clock: str, delay: str, wait_hours: int = 2) -> DataFrame:
    """Status changes (keys, at, status, value) of every event.

    ``feed`` has kind (schedule, first or second), value, scheduled, start and the clock of each row. The first schedule
    fixes the start; another start later asks for a review, during which nothing is captured. The first source captures
    an event before its start. The second one stands in, provisionally, while the first is empty and ``wait_hours`` have
    passed since the scheduled session. At the start the event is closed, or missed if the first source is still empty. Sources
    that come before the schedule count. Rows later than ``delay`` are dropped by Spark, which counts them."""
    ms = lambda c: F.expr(f"unix_millis(`{c}`)").alias(c)
    d = feed.withWatermark(clock, delay).select(*keys, "kind", F.col("value").cast("string").alias("value"), ms("scheduled"), ms("start"), F.expr(f"unix_millis(`{clock}`)").alias("at"), clock if clock != "at" else F.col(clock).alias("_clock"))
    kinds = _fields(feed, keys).add("at", "long").add("status", "string").add("value", "string")
    out = d.groupBy(*keys).transformWithState(Captures(keys, wait_hours * HOUR), kinds, "Append", "EventTime")
    return out.withColumn("at", F.timestamp_millis("at"))


class Labels(_Machine):
    """Frozen versions and labels of an event, whichever comes first, and retries while there is no label."""

    def __init__(self, keys: list[str], retry: int):
        self.keys, self.retry = keys, retry

    def due(self, start: int, until: int) -> int:
        """Retries due by a time: the waits double from one to the next."""
        n = 0
        while start + self.retry * (2 ** (n + 1) - 1) <= until:
            n += 1
        return n

    def _row(self, key, start: int, what: str, at: int, version=None, value=None, attempts=None) -> Row:
        return Row(**{c: key[i] for i, c in enumerate(self.keys)}, start=start, what=what, version=version, value=value, at=at, attempts=attempts)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s = self.recall()
        frozen, labels, out = s.setdefault("frozen", []), s.setdefault("labels", []), []
        for r in sorted(rows, key=lambda r: (r["at"], str(r["version"]), str(r["value"]))):
            if r["kind"] == "frozen" and r["version"] not in frozen:
                frozen.append(r["version"])
                s["start"] = r["start"]
                out.append(self._row(key, s["start"], "frozen", r["at"], r["version"], r["value"]))
                out += [self._row(key, s["start"], "attached", at, r["version"], value, self.due(s["start"], at)) for at, value in labels]
            elif r["kind"] == "label" and [r["at"], r["value"]] not in labels:
                labels.append([r["at"], r["value"]])
                out += [self._row(key, s["start"], "attached", r["at"], v, r["value"], self.due(s["start"], r["at"])) for v in frozen]
        if labels or not frozen:
            self.alarm(s, None)
        elif s.get("alarm") is None:
            s["attempts"] = 0
            self.alarm(s, s["start"] + self.retry)
        self.keep(s)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = self.recall()
        at, now, out = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs(), []
        s["alarm"] = None
        while not s["labels"] and at <= now:  # the watermark may have passed several retries at once
            s["attempts"] += 1
            out.append(self._row(key, s["start"], "retry", at, attempts=s["attempts"]))
            at += self.retry * 2 ** s["attempts"]
        if not s["labels"]:
            self.alarm(s, at)
        self.keep(s)
        return iter(out)


def late_labels(frozen: DataFrame, labels: DataFrame, keys: list[str], version: str, start: str, clock: str, value: str, label_at: str, delay: str, retry_hours: int = 6, roster: str | None = None) -> DataFrame:
    """Every frozen version, once (what = frozen, with its clock and, as value, its ``roster``), every label attached to
    every frozen version of its event (what = attached, with the label's clock and the retries due by then), and a row for
    each retry of an event that has started without a label (what = retry). All rows have the event's start.

    Labels are held until a frozen version comes, and frozen versions until a label does, for as long as the stream's
    checkpoint; no label is too late, as only frozen rows move the watermark. Replays attach nothing twice. A later
    version of a label is attached as well."""
    a = frozen.select(*keys, F.lit("frozen").alias("kind"), F.col(version).cast("long").alias("version"), (F.col(roster) if roster else F.lit(None)).cast("string").alias("value"), F.expr(f"unix_millis(`{start}`)").alias("start"), F.expr(f"unix_millis(`{clock}`)").alias("at"), F.col(clock).alias("_clock"))
    b = labels.select(*keys, F.lit("label").alias("kind"), F.lit(None).cast("long").alias("version"), F.col(value).cast("string").alias("value"), F.lit(None).cast("long").alias("start"), F.expr(f"unix_millis(`{label_at}`)").alias("at"), F.lit(None).cast("timestamp").alias("_clock"))
    d = a.unionByName(b).withWatermark("_clock", delay)
    kinds = _fields(frozen, keys).add("start", "long").add("what", "string").add("version", "long").add("value", "string").add("at", "long").add("attempts", "long")
    out = d.groupBy(*keys).transformWithState(Labels(keys, retry_hours * HOUR), kinds, "Append", "EventTime")
    return out.withColumns({"start": F.timestamp_millis("start"), "at": F.timestamp_millis("at")})


def labelled(rows: DataFrame, keys: list[str], within: str) -> DataFrame:
    """A row for each event with a frozen version, from what ``late_labels`` has written: the roster of its latest
    version, whether a label has come, however late, whether one came within a time of the start, and the first one with its
    clock. An event without a label stays, with nulls."""
    label = F.col("what") == "attached"
    on_time = label & (F.col("at") <= F.col("start") + F.expr(f"INTERVAL {within}"))
    out = rows.groupBy(*keys).agg(
        F.max_by("value", F.when(F.col("what") == "frozen", F.col("version"))).alias("roster"),
        F.max(F.when(label, 1)).alias("labelled"),
        F.max(F.when(on_time, 1)).alias("on_time"),
        F.min(F.when(label, F.struct("at", "value"))).alias("first"),
    )
    return out.select(*keys, "roster", "labelled", "on_time", F.col("first.value").alias("label"), F.col("first.at").alias("label_at"))
