"""Stateful processors, for streams that built-in operators cannot express.

State is per key and bounded by timers: what a timer or a match has answered
is cleared.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR_MS = 3_600_000


def _ms(t) -> int:
    return int(t.timestamp() * 1000)


class LongRides(StatefulProcessor):
    """Emits a START whose END has not come within the limit of its event time.

    A START waits for its END until the watermark passes the limit. An END that comes in time for the engine,
    but after the limit by its own time, gives the alert at once, so the result does not depend on how the
    stream is cut into batches. An END that comes first waits as long for its START.
    """

    OUTPUT = "ride_id long, started timestamp"

    def __init__(self, limit_ms: int = 2 * HOUR_MS):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "is_start boolean, event_time timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            if not self.held.exists():
                self.held.update((row.is_start, row.event_time))
                self.handle.registerTimer(_ms(row.event_time) + self.limit_ms)
                continue
            was_start, at = self.held.get()
            if was_start == row.is_start:
                continue
            started, ended = (at, row.event_time) if was_start else (row.event_time, at)
            self.held.clear()
            self.handle.deleteTimer(_ms(at) + self.limit_ms)
            if _ms(ended) > _ms(started) + self.limit_ms:
                yield Row(ride_id=key[0], started=started)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            is_start, started = self.held.get()
            self.held.clear()
            if is_start:
                yield Row(ride_id=key[0], started=started)

    def close(self) -> None:
        pass


class PairOnce(StatefulProcessor):
    """Pairs a key's ride with its fare, whichever comes first, and clears both.

    Rows have ``side`` 'ride' or 'fare', event_time and tip. With ``expires``, what is unmatched when the
    watermark passes its own time goes out as 'unmatched_ride' or 'unmatched_fare'; without, it waits.
    """

    OUTPUT = "ride_id long, kind string, event_time timestamp, tip double"

    def __init__(self, expires: bool = False):
        self.expires = expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ride = handle.getValueState("saved_ride", "event_time timestamp")
        self.fare = handle.getValueState("saved_fare", "event_time timestamp, tip double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            own, other = (self.ride, self.fare) if row.side == "ride" else (self.fare, self.ride)
            if other.exists():
                held = other.get()
                other.clear()
                if self.expires:
                    self.handle.deleteTimer(_ms(held[0]))
                ride_time, tip = (row.event_time, held[1]) if row.side == "ride" else (held[0], row.tip)
                yield Row(ride_id=key[0], kind="matched", event_time=ride_time, tip=tip)
            else:
                if self.expires:
                    if own.exists():
                        self.handle.deleteTimer(_ms(own.get()[0]))
                    self.handle.registerTimer(_ms(row.event_time))
                own.update((row.event_time,) if row.side == "ride" else (row.event_time, row.tip))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.fare.exists():
            at, tip = self.fare.get()
            self.fare.clear()
            yield Row(ride_id=key[0], kind="unmatched_fare", event_time=at, tip=tip)
        if self.ride.exists():
            (at,) = self.ride.get()
            self.ride.clear()
            yield Row(ride_id=key[0], kind="unmatched_ride", event_time=at, tip=None)

    def close(self) -> None:
        pass


class AsOf(StatefulProcessor):
    """Joins a trade, once the watermark has passed it, to the customer record of the latest time up to its own.

    Rows have ``side`` 'trade' or 'customer', event_time and info. One record is kept per key and time, the
    last; customer records older than the one in force are dropped.
    """

    OUTPUT = "customer_id long, event_time timestamp, trade string, customer string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trades = handle.getMapState("trades", "at long", "event_time timestamp, info string")
        self.customers = handle.getMapState("customers", "at long", "info string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            at = _ms(row.event_time)
            if row.side == "customer":
                self.customers.updateValue((at,), (row.info,))
            else:
                self.trades.updateValue((at,), (row.event_time, row.info))
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if not self.trades.containsKey((due,)):
            return
        event_time, trade = self.trades.getValue((due,))
        self.trades.removeKey((due,))
        known = sorted(k[0] for k in self.customers.keys() if k[0] <= due)
        for old in known[:-1]:
            self.customers.removeKey((old,))
        info = self.customers.getValue((known[-1],))[0] if known else None
        yield Row(customer_id=key[0], event_time=event_time, trade=trade, customer=info)

    def close(self) -> None:
        pass


class AsOfUpdates(AsOf):
    """As AsOf, but a trade is also answered when it comes, from the records known by then; the later answer goes out if it differs."""

    OUTPUT = "customer_id long, event_time timestamp, trade string, customer string, is_final boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.answers = handle.getMapState("answers", "at long", "customer string")

    def _known(self, at: int) -> str | None:
        times = [k[0] for k in self.customers.keys() if k[0] <= at]
        return self.customers.getValue((max(times),))[0] if times else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            for _ in super().handleInputRows(key, [row], timerValues):
                pass
            if row.side != "customer":
                at = _ms(row.event_time)
                known = self._known(at)
                self.answers.updateValue((at,), (known,))
                yield Row(customer_id=key[0], event_time=row.event_time, trade=row.info, customer=known, is_final=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        for row in super().handleExpiredTimer(key, timerValues, expiredTimerInfo):
            first = self.answers.getValue((due,))[0] if self.answers.containsKey((due,)) else None
            self.answers.removeKey((due,))
            if row.customer != first:
                yield Row(customer_id=key[0], event_time=row.event_time, trade=row.trade, customer=row.customer, is_final=True)


class LookUp(StatefulProcessor):
    """Joins a trade when it arrives to the customer record seen last; needs no time."""

    OUTPUT = AsOf.OUTPUT

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "info string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            if row.side == "customer":
                self.last.update((row.info,))
            else:
                yield Row(customer_id=key[0], event_time=row.event_time, trade=row.info, customer=self.last.get()[0] if self.last.exists() else None)

    def close(self) -> None:
        pass


class TimeSort(StatefulProcessor):
    """Emits each key's events in order of time, once the watermark has passed them; those of one time as they came."""

    OUTPUT = "car_id string, event_time timestamp, speed double, throttle double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "events array<struct<event_time:timestamp,speed:double,throttle:double>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            self._keep(row)
            self.handle.registerTimer(_ms(row.event_time))
        return iter(())

    def _keep(self, row) -> None:
        at = (_ms(row.event_time),)
        held = self.waiting.getValue(at)[0] if self.waiting.containsKey(at) else []
        self.waiting.updateValue(at, ([*map(tuple, held), (row.event_time, row.speed, row.throttle)],))

    def _take(self, limit: int) -> list[tuple]:
        """The events up to this time, in order, which are forgotten."""
        out = []
        for at in sorted(k[0] for k in self.waiting.keys() if k[0] <= limit):
            out += map(tuple, self.waiting.getValue((at,))[0])
            self.waiting.removeKey((at,))
        return sorted(out, key=lambda r: r[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for r in self._take(expiredTimerInfo.getExpiryTimeInMs()):
            yield Row(car_id=key[0], event_time=r[0], speed=r[1], throttle=r[2])

    def close(self) -> None:
        pass


class StoppedSegments(TimeSort):
    """Once the watermark passes a stop, sums up the events before it and forgets them and the stop."""

    OUTPUT = "car_id string, start_time timestamp, length int, max_speed int, erraticness double"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            self._keep(row)
            if row.speed == 0:
                self.handle.registerTimer(_ms(row.event_time))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        part: list[tuple] = []
        # the last event up to a stop's time may come after the stop within its millisecond, and begin the next segment
        for r in self._take(expiredTimerInfo.getExpiryTimeInMs()):
            if r[1] != 0:
                part.append(r)
                continue
            if part:
                mean = sum(p[2] for p in part) / len(part)
                spread = (sum((p[2] - mean) ** 2 for p in part) / len(part)) ** 0.5
                yield Row(car_id=key[0], start_time=part[0][0], length=len(part), max_speed=int(max(p[1] for p in part)), erraticness=spread)
            part = []
        for event_time, speed, throttle in part:
            self._keep(Row(event_time=event_time, speed=speed, throttle=throttle))


class TravelTime(StatefulProcessor):
    """A regression without intercept per cell and direction: ENDs refine it, STARTs are answered from it."""

    OUTPUT = "ride_id long, minutes int"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getMapState("sums", "bucket int", "n long, xx double, xy double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            n, xx, xy = self.sums.getValue((row.bucket,)) if self.sums.containsKey((row.bucket,)) else (0, 0.0, 0.0)
            if row.is_start:
                yield Row(ride_id=row.ride_id, minutes=int(xy / xx * row.km) if n >= 2 and xx else -1)
            else:
                self.sums.updateValue((row.bucket,), (n + 1, xx + row.km * row.km, xy + row.km * row.minutes))

    def close(self) -> None:
        pass


class RuleMatches(StatefulProcessor):
    """Waiting items of each rule per colour; an item of the second shape completes those that wait, then may wait itself."""

    OUTPUT = "rule string, colour long, opened_by long, closed_by long"

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "rule string", "seqs array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: r.seq):
            for rule, first, second in self.rules:
                held = list(self.waiting.getValue((rule,))[0]) if self.waiting.containsKey((rule,)) else []
                if row.shape == second and held:
                    for seq in held:
                        yield Row(rule=rule, colour=key[0], opened_by=seq, closed_by=row.seq)
                    held = []
                    self.waiting.removeKey((rule,))
                if row.shape == first:
                    self.waiting.updateValue((rule,), (held + [row.seq],))

    def close(self) -> None:
        pass
