"""Keyed state of the scoring stream: what a card paid in the last week, its profile, and the ids seen.

A card's payments lie in a map by hour. Beside it one value of bounded size holds each hour's count and sum (an
hour is dropped when the longest window has passed it, so 169 at most) and the last values of the profile. A
micro-batch reads and writes that value, the hours it adds to, and those that a window begins or ends in; how much
else the card paid in its week does not matter. Whole hours in between come from the counts and sums.

A stream's cards are dealt to a fixed number of groups by a hash (:class:`CardsState`), and so are the ids of rows without
a card: what a micro-batch costs for each key of the operator is paid for a group, not for a card. The entries in the
state are still each card's own. Requests to the state go out together (see :func:`_in_turn`), and an hour that is
past its window when it comes is not written.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from cardwatch.operators.profile import REMEMBER
from cardwatch.operators.velocity import HOUR, USER_WINDOWS

# profile column -> (output column, values remembered)
PROFILE = {
    "addr1": ("seen_addr1", REMEMBER["addresses"]),
    "addr2": ("seen_addr2", REMEMBER["addresses"]),
    "DeviceInfo": ("seen_devices", REMEMBER["devices"]),
    "P_emaildomain": ("seen_emails", REMEMBER["emails"]),
    "card6": ("seen_card_types", REMEMBER["card_types"]),
}

#: Of one card, bounded: hours with their counts and sums, profile values, the newest event in milliseconds.
CARD_SCHEMA = (
    "hours array<bigint>, counts array<bigint>, sums array<double>, addr1 array<bigint>, "
    "addr2 array<bigint>, DeviceInfo array<string>, P_emaildomain array<string>, card6 array<string>, "
    "recent array<double>, newest bigint"
)
#: Of one hour: payments by time, and the ids that came in it.
HOUR_SCHEMA = "times array<bigint>, amounts array<double>, ids array<string>"

STATE_COLUMNS = (
    "txn_count_1h bigint, txn_count_6h bigint, txn_count_24h bigint, txn_count_7d bigint, "
    "amt_sum_1h double, amt_sum_24h double, amt_mean_24h double, seen_addr1 array<bigint>, "
    "seen_addr2 array<bigint>, seen_devices array<string>, seen_emails array<string>, "
    "seen_card_types array<string>, seen_amount_n bigint, seen_amount_mean double, "
    "seen_amount_std double"
)

#: What becomes of a row that reaches the state; refused ones were marked before (see REFUSE).
DECIDED, DUPLICATE, LATE, REFUSED = "decided", "duplicate", "late", "refused"
#: Column names of the card, the group, the fate and the mark of rows to refuse; groups of rows without a card begin with LONE.
KEY, GROUP, FATE, REFUSE, LONE = "_card", "_group", "_fate", "_refuse", "id:"
#: Groups that cards, and rows without a card, are dealt to; fixed for the life of a checkpoint.
GROUPS = 1024
#: Milliseconds of the hours by which ids without a card are kept, and of the days by which cards fall due.
HOUR_MS, DAY_MS = HOUR * 1000, 24 * HOUR * 1000
#: Rows of a group that are worked on at once, but for a card that has more.
ROWS_AT_ONCE = 8192

#: Requests that are sent before their answers are read.
_TOGETHER = 128


def _plain(values: np.ndarray, whole: bool) -> list:
    """Python values with None for missing ones."""
    kind = int if whole else (lambda v: v)
    return [None if v is None or v != v else kind(v) for v in values.tolist()]


def _in_turn(state, one: Callable, name: str, keys: list, values: Iterable | None = None) -> list:
    """What a map state answers to many requests of one kind.

    The state lies behind a socket, and its client waits for each answer before the next request; here the requests
    go out together. Requests or answers are small, so neither side waits for the other to read. ``one`` is the
    client's own call, for a state without such a connection.
    """
    values = [None] * len(keys) if values is None else list(values)
    api = getattr(getattr(state, "_mapStateClient", None), "_stateful_processor_api_client", None)
    if len(keys) < 2 or not all(hasattr(api, f) for f in ("_receive_proto_message", "_deserialize_from_bytes", "sockfile")):
        return [one(k) if v is None else one(k, v) for k, v in zip(keys, values, strict=True)]
    import pyspark.sql.streaming.proto.StateMessage_pb2 as wire

    kind, field = {"get": (wire.GetValue, "getValue"), "has": (wire.ContainsKey, "containsKey"),
                   "put": (wire.UpdateValue, "updateValue"), "drop": (wire.RemoveKey, "removeKey")}[name]
    out = []

    def dumps(row: tuple) -> bytes:  # plain values: the client's own pickler took 1.9 microseconds for one, this 0.3
        return pickle.dumps(row, pickle.HIGHEST_PROTOCOL)

    for a in range(0, len(keys), _TOGETHER):
        some = keys[a:a + _TOGETHER]
        for k, v in zip(some, values[a:a + _TOGETHER], strict=True):
            call = kind(userKey=dumps(k)) if v is None else kind(userKey=dumps(k), value=dumps(v))
            message = wire.StateRequest(stateVariableRequest=wire.StateVariableRequest(
                mapStateCall=wire.MapStateCall(stateName=state._stateName, **{field: call}))).SerializeToString()
            api.sockfile.write(b"\0\0\0\0" + len(message).to_bytes(4, "big") + message)
        api.sockfile.flush()
        answers = [api._receive_proto_message() for _ in some]
        for status, error, value in answers:
            if status != 0 and not (status == 2 and name == "has"):
                raise RuntimeError(f"card state, {name}: {error}")
            out.append(status == 0 if name == "has" else api._deserialize_from_bytes(value) if value else None)
    return out


def _get(state, keys: list) -> list:
    return _in_turn(state, state.getValue, "get", keys)


def _has(state, keys: list) -> list[bool]:
    return _in_turn(state, state.containsKey, "has", keys)


def _put(state, keys: list, values: Iterable) -> None:
    _in_turn(state, state.updateValue, "put", keys, values)


def _drop(state, keys: list) -> None:
    _in_turn(state, state.removeKey, "drop", keys)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of equal neighbours."""
    at = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return zip(values[at[:-1]].tolist(), at[:-1], at[1:])


class _Done(NamedTuple):
    """Of one card: columns made, hours to drop with their ids, (id, hour) and (hour, value) to write, the card's value."""

    made: dict
    past: list
    ids: list
    hours: list
    value: tuple


class CardState(StatefulProcessor):
    """Every row sees what was recorded before it, then is recorded; late and repeated rows are told apart.

    A row is late if its event time is not after the watermark; a duplicate if its id came before, on the same
    card and within the longest window. Neither is recorded, nor are rows marked in REFUSE. A key without cards (see
    LONE) has no history, only the ids of many rows, by hours of their event time. A card's state goes when the
    watermark has passed its newest event by ``ttl_ms``, an id without a card when it has passed its hour by that.
    Here a key is a card.
    """

    def __init__(self, received: list[str], columns: StructType, time: str, row_id: str, unit: int, ttl_ms: int):
        self.received, self.columns = received, columns
        self.time, self.row_id, self.unit, self.ttl_ms = time, row_id, unit, ttl_ms
        self.hour = HOUR * unit
        self.widths = {w: h * HOUR * unit for w, h in USER_WINDOWS.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.card = handle.getValueState("card", CARD_SCHEMA)
        self.hours = handle.getMapState("hours", "hour bigint", HOUR_SCHEMA)
        self.ids = handle.getMapState("ids", "id string", "hour bigint")

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Take over :func:`card_history`: a row for the card, and one for each of its hours."""
        hours, cards = [], {}
        for row in initialState.set_axis([*HISTORY, *range(initialState.shape[1] - len(HISTORY))], axis=1).itertuples(index=False):
            if row.hour is None or row.hour != row.hour:
                cards[row.key] = tuple(
                    _listed(getattr(row, n), "bigint" in kind) for n, kind in (c.split() for c in CARD_SCHEMA.split(", ")))
            else:
                hours.append((row.key, int(row.hour), (_listed(row.times, True), _listed(row.amounts), _listed(row.ids))))
        _put(self.hours, [self._key(card, h) for card, h, _ in hours], [v for _, _, v in hours])
        ids = [(self._key(card, i), (h,)) for card, h, v in hours for i in v[2]]
        _put(self.ids, [i for i, _ in ids], [h for _, h in ids])
        self._save(cards)
        self._watch({card: int(value[9]) for card, value in cards.items()}, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        if str(key[0]).startswith(LONE):
            self._forget(watermark)
        else:
            self._expire(key, watermark, expiredTimerInfo)
        yield from ()

    def _expire(self, key, watermark: int, info) -> None:
        stored = self.card.get()
        end = stored[9] + self.ttl_ms if stored else 0
        if end > watermark:
            self.handle.registerTimer(end)
        else:
            self.card.clear()
            self.hours.clear()
            self.ids.clear()

    # how the entries of a card are named and kept
    def _key(self, card: str, part) -> tuple:
        return (part,)

    def _stored(self, cards: list[str]) -> list:
        return [self.card.get() for _ in cards]

    def _save(self, values: dict[str, tuple]) -> None:
        for value in values.values():
            self.card.update(value)

    def _clear(self, card: str) -> None:
        self.card.clear()

    def _over(self, stored: tuple, watermark: int) -> bool:
        """Whether the watermark has passed a card that its timer has not removed yet."""
        return False

    def _watch(self, new: dict[str, int], watermark: int) -> None:
        """See to it that new cards go; ``new`` has their newest events."""
        for newest in new.values():
            self.handle.registerTimer(max(newest + self.ttl_ms, watermark + 1))

    def _cards(self, key, batch: dict) -> Iterator[list[tuple[str, int, int]]]:
        """(card, begin, end) of the rows of each card, in parts to be worked on at once."""
        yield [(str(key[0]), 0, len(batch["_event_ms"]))]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        frame = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        lone = str(key[0]).startswith(LONE)
        # Spark hands computed columns over by number
        batch = dict(zip(self.received, (_values(column) for _, column in frame.items()), strict=True))
        batch = self._sorted(batch, lone)
        watermark = timerValues.getCurrentWatermarkInMs()
        for cards in [[("", 0, len(frame))]] if lone else self._cards(key, batch):
            begin, end = cards[0][1], cards[-1][2]
            part = batch if end - begin == len(frame) else {c: v[begin:end] for c, v in batch.items()}
            yield self._handle([(card, a - begin, b - begin) for card, a, b in cards], part, lone, watermark)

    def _sorted(self, batch: dict, lone: bool) -> dict:
        """By card, time, then id; missing ones last."""
        by = [batch[c] for c in ([KEY] if KEY in batch and not lone else []) + [self.time, self.row_id]]
        lines = [v.tolist() for v in by]
        if by[-2].dtype.kind == "i" and not any(v is None or v != v for v in lines[-1]):
            line = list(zip(*lines, strict=True))
            order = np.array(sorted(range(len(line)), key=line.__getitem__))
        else:
            order = pd.DataFrame(dict(enumerate(by))).sort_values(list(range(len(by))), kind="stable").index.to_numpy()
        return {c: v[order] for c, v in batch.items()}

    def _handle(self, cards: list, batch: dict, lone: bool, watermark: int) -> pd.DataFrame:
        event_ms = _whole(batch["_event_ms"])
        ids = [None if i is None or i != i else str(i) for i in batch[self.row_id].tolist()]
        fate = np.array([DECIDED] * len(ids), dtype=object)
        if watermark > 0:
            fate[event_ms <= watermark] = LATE
        if REFUSE in batch:
            fate[batch[REFUSE].astype(bool)] = REFUSED
        names = [card for card, _, _ in cards]
        stored = dict(zip(names, self._stored(names), strict=True))
        # a card without a value has no ids either; (card, id) of open rows, by place
        line, asked = {}, {}
        for card, a, b in cards:
            known = stored[card] and not (not lone and self._over(stored[card], watermark))
            for k in (np.flatnonzero(fate[a:b] == DECIDED) + a).tolist():
                if ids[k] is not None:
                    line[k] = (card, ids[k])
                    if known:
                        asked[line[k]] = None
        seen = {i for i, there in zip(asked, _has(self.ids, [self._key(*i) for i in asked]), strict=True) if there}
        for k, i in line.items():
            if i in seen:
                fate[k] = DUPLICATE
            seen.add(i)
        good, made = np.flatnonzero(fate == DECIDED), {}
        if len(good) and lone:
            self._remember([ids[k] for k in good.tolist()], event_ms[good], watermark, stored[""])
        elif len(good):
            made = self._record_all(cards, batch, ids, event_ms, good, watermark, stored)
        return self._typed(batch, fate, good, made)

    def _record_all(self, cards: list, batch: dict, ids: list, event_ms: np.ndarray, good: np.ndarray,
                    watermark: int, stored: dict) -> dict:
        """Each card's rows by :meth:`_record`, with the state of all read and written together."""
        columns = {c: batch[c] for c in (self.time, "TransactionAmt", *PROFILE)}
        steps = {}
        for card, a, b in cards:
            at = good[np.searchsorted(good, a):np.searchsorted(good, b)]
            if len(at):
                steps[card] = self._record({c: v[at] for c, v in columns.items()}, [ids[k] for k in at.tolist()],
                                           event_ms[at], watermark, stored[card])
        asked = [(card, hour) for card, step in steps.items() for hour in next(step)]
        found: dict[str, dict] = {card: {} for card in steps}
        for (card, hour), value in zip(asked, _get(self.hours, [self._key(*k) for k in asked]), strict=True):
            found[card][hour] = value
        done = {card: step.send(found[card]) for card, step in steps.items()}
        _drop(self.ids, [self._key(card, i) for card, d in done.items() for _, own in d.past for i in own])
        _drop(self.hours, [self._key(card, h) for card, d in done.items() for h, _ in d.past])
        new = [(self._key(card, i), (h,)) for card, d in done.items() for i, h in d.ids]
        _put(self.ids, [i for i, _ in new], [h for _, h in new])
        changed = [(self._key(card, h), v) for card, d in done.items() for h, v in d.hours]
        _put(self.hours, [h for h, _ in changed], [v for _, v in changed])
        self._save({card: d.value for card, d in done.items()})
        self._watch({card: d.value[9] for card, d in done.items() if not stored[card]}, watermark)
        parts = [d.made for d in done.values()]
        return {c: list(chain.from_iterable(p[c] for p in parts)) if isinstance(v, list) else np.concatenate([p[c] for p in parts])
                for c, v in parts[0].items()}

    def _end(self, hour: int) -> int:
        """When the watermark has passed all ids without a card of an hour of event time."""
        return (hour + 1) * HOUR_MS - 1 + self.ttl_ms

    def _remember(self, ids: list, event_ms: np.ndarray, watermark: int, stored: tuple | None) -> None:
        """Keep ids that have no card."""
        by_hour: dict[int, list] = {}
        for i, hour in zip(ids, (event_ms // HOUR_MS).tolist(), strict=True):
            if i is not None:
                by_hour.setdefault(hour, []).append(i)
        if not by_hour:
            return
        known = dict(zip(stored[0], stored[1], strict=True)) if stored else {}
        again = [h for h in by_hour if h in known]
        before = dict(zip(again, (list(v[2]) for v in _get(self.hours, [self._key("", h) for h in again])), strict=True))
        line = list(by_hour)
        _put(self.hours, [self._key("", h) for h in line], [([], [], before.get(h, []) + by_hour[h]) for h in line])
        _put(self.ids, [self._key("", i) for h in line for i in by_hour[h]], [(h,) for h in line for _ in by_hour[h]])
        for h in line:
            known[h] = known.get(h, 0) + len(by_hour[h])
        newest = max(int(event_ms.max()), *([stored[9]] if stored else []), watermark)
        hours = sorted(known)
        self._save({"": (hours, [known[h] for h in hours], [], [], [], [], [], [], [], newest)})
        if not stored or hours[0] < stored[0][0]:
            self.handle.registerTimer(max(self._end(hours[0]), watermark + 1))

    def _forget(self, watermark: int) -> None:
        """Drop the hours of ids without a card that the watermark has passed by ``ttl_ms``."""
        (stored,) = self._stored([""])
        if not stored:
            return
        past = [h for h in stored[0] if self._end(h) <= watermark]
        for value in _get(self.hours, [self._key("", h) for h in past]):
            _drop(self.ids, [self._key("", i) for i in value[2]])
        _drop(self.hours, [self._key("", h) for h in past])
        left = [(h, n) for h, n in zip(stored[0], stored[1], strict=True) if self._end(h) > watermark]
        if left:
            self._save({"": ([h for h, _ in left], [n for _, n in left], *stored[2:])})
            self.handle.registerTimer(self._end(left[0][0]))
        else:
            self._clear("")

    def _record(self, batch: dict, ids: list, event_ms: np.ndarray, watermark: int, stored: tuple | None):
        """Yields the hours of the card to read; takes them and yields what was made and what to write (:class:`_Done`)."""
        over = stored is not None and self._over(stored, watermark)
        gone = list(stored[0]) if over else []
        if not stored or over:
            stored = ([], [], [], [], [], [], [], [], [], None)
        now, amounts = _whole(batch[self.time]), batch["TransactionAmt"].astype(float)
        paid = ~np.isnan(amounts)
        runs = list(_runs(now // self.hour))
        totals = dict(zip(stored[0], zip(stored[1], stored[2], strict=True), strict=True))
        # an hour goes when no window can reach it any more
        newest = max([*totals, *(h for h, _, _ in runs)])
        floor = (max(int(now.max()), newest * self.hour) - max(self.widths.values())) // self.hour
        # of the hours known, those that get rows, that a window begins in, or that go
        cut = {h for h, _, _ in runs}.union(*(((now - w) // self.hour).tolist() for w in self.widths.values())) if totals else set()
        asked = [h for h in totals if h in cut or h < floor]
        found = yield [*asked, *gone]
        held = {h: (np.asarray(v[0], np.int64), np.asarray(v[1], float), list(v[2])) for h, v in found.items() if v and not over}
        past = [(h, list(found[h][2]) if found[h] else []) for h in [*(h for h in asked if h < floor), *gone]]
        new_ids, changed = [], []
        for hour, a, b in runs:
            here = paid[a:b]
            times, values = now[a:b][here], amounts[a:b][here]
            own = [i for i in ids[a:b] if i is not None]
            before = held.get(hour)
            if before:
                times, values = np.concatenate([before[0], times]), np.concatenate([before[1], values])
                order = np.argsort(times, kind="stable")
                times, values = times[order], values[order]
            held[hour] = (times, values, before[2] + own if before else own)
            totals[hour] = (len(times), float(np.cumsum(values)[-1]) if len(values) else 0.0)
            if hour >= floor:
                changed.append((hour, (times.tolist(), values.tolist(), held[hour][2])))
                new_ids += [(i, hour) for i in own]
        made = self._velocity(now, held, totals)
        memory, profile = self._profile(batch, stored)
        line = sorted(h for h in totals if h >= floor)
        last = max([int(event_ms.max()), *([stored[9]] if stored[9] is not None else [])])
        value = (line, [totals[h][0] for h in line], [totals[h][1] for h in line], *memory, last)
        yield _Done(made | profile, past, new_ids, changed, value)

    def _velocity(self, now: np.ndarray, held: dict, totals: dict) -> dict:
        hours = sorted(totals)
        line = np.array(hours, np.int64)
        counts = np.concatenate([[0], np.cumsum([totals[h][0] for h in hours])]).astype(np.int64)
        sums = np.concatenate([[0.0], np.cumsum([totals[h][1] for h in hours])])
        # the payments of the hours that were read, in time order
        read = [(h, *held[h][:2]) for h in hours if h in held]
        at_read = np.array([h for h, _, _ in read], np.int64)
        begins = np.concatenate([[0], np.cumsum([len(v) for _, v, _ in read])]).astype(np.int64)
        times = np.concatenate([v for _, v, _ in read])
        part = np.concatenate([[0.0], np.cumsum(np.concatenate([v for _, _, v in read]))])

        def before(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Payments before each time: whole hours, and part of the hour that the time cuts."""
            hour = at // self.hour
            place = np.searchsorted(line, hour, "left")
            begin, end = begins[np.searchsorted(at_read, hour, "left")], np.searchsorted(times, at, "left")
            return counts[place] + (end - begin), sums[place] + (part[end] - part[begin])

        end_n, end_s = before(now)
        made: dict[str, object] = {}
        for w, width in self.widths.items():
            n, s = before(now - width)
            made[f"txn_count_{w}"] = end_n - n
            if w in ("1h", "24h"):
                made[f"amt_sum_{w}"] = np.where(end_n > n, end_s - s, 0.0)
        n = made["txn_count_24h"]
        made["amt_mean_24h"] = np.where(n > 0, made["amt_sum_24h"] / np.maximum(n, 1), 0.0)
        return made

    def _profile(self, batch: dict, stored: tuple) -> tuple[list, dict]:
        memory, made = [], {}
        for i, (c, (out, depth)) in enumerate(PROFILE.items()):
            past = list(stored[3 + i])
            line = past + _plain(batch[c], c.startswith("addr"))
            seen = [line[max(0, at - depth):at] for at in range(len(past), len(line))]
            made[out] = [[v for v in values if v is not None] for values in seen] if None in line else seen
            memory.append(line[-depth:])
        depth = REMEMBER["amounts"]
        past = list(stored[8])
        line = past + _plain(batch["TransactionAmt"], False)
        parts = [_trailing(line[max(0, a - depth):a + _ROWS], min(a, depth), depth)
                 for a in range(len(past), len(line), _ROWS)]
        for name, values in zip(("seen_amount_n", "seen_amount_mean", "seen_amount_std"), zip(*parts, strict=True), strict=True):
            made[name] = np.concatenate(values)
        return [*memory, line[-depth:]], made

    def _typed(self, batch: dict, fate: np.ndarray, good: np.ndarray, made: dict) -> pd.DataFrame:
        """The rows with state columns and fate; every column has the type of its field."""
        out, n = {}, len(fate)
        for field in self.columns:
            c, kind = field.name, field.dataType.typeName()
            if c == FATE:
                out[c] = fate
            elif c in batch:
                out[c] = _cast(batch[c], kind)
            elif c in made and len(good) == n:
                out[c] = _objects(made[c]) if kind == "array" else made[c]
            elif kind == "array":
                lists = [[] for _ in range(n)]
                for k, v in zip(good.tolist(), made.get(c, ()), strict=False):
                    lists[k] = v
                out[c] = _objects(lists)
            else:  # of rows that were not recorded
                undefined = c in ("seen_amount_mean", "seen_amount_std")
                out[c] = np.full(n, np.nan if undefined else 0, np.int64 if kind == "long" else float)
                if c in made:
                    out[c][good] = made[c]
        return pd.DataFrame(out)


class CardsState(CardState):
    """:class:`CardState` for groups of cards; rows come with the card in KEY.

    Cards fall due by days: a card's state may stay for a day after its time, but is not used any more.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cards = handle.getMapState("cards", "card string", CARD_SCHEMA)
        self.hours = handle.getMapState("hours", "card string, hour bigint", HOUR_SCHEMA)
        self.ids = handle.getMapState("ids", "card string, id string", "hour bigint")
        self.due = handle.getMapState("due", "day bigint", "cards array<string>")

    def _key(self, card: str, part) -> tuple:
        return (card, part)

    def _stored(self, cards: list[str]) -> list:
        return _get(self.cards, [(card,) for card in cards])

    def _save(self, values: dict[str, tuple]) -> None:
        _put(self.cards, [(card,) for card in values], values.values())

    def _clear(self, card: str) -> None:
        self.cards.removeKey((card,))

    def _over(self, stored: tuple, watermark: int) -> bool:
        return stored[9] + self.ttl_ms <= watermark

    def _watch(self, new: dict[str, int], watermark: int) -> None:
        days: dict[int, list] = {}
        for card, newest in new.items():
            days.setdefault(max(newest + self.ttl_ms, watermark) // DAY_MS + 1, []).append(card)
        before = _get(self.due, [(day,) for day in days])
        _put(self.due, [(day,) for day in days],
             [([*(old[0] if old else []), *cards],) for old, cards in zip(before, days.values(), strict=True)])
        for day, old in zip(days, before, strict=True):
            if not old:
                self.handle.registerTimer(day * DAY_MS)

    def _expire(self, key, watermark: int, info) -> None:
        day = info.getExpiryTimeInMs() // DAY_MS
        due = self.due.getValue((day,))
        if not due:
            return
        self.due.removeKey((day,))
        cards = list(due[0])
        stored = {card: value for card, value in zip(cards, self._stored(cards), strict=True) if value}
        past = {card: value for card, value in stored.items() if self._over(value, watermark)}
        hours = [self._key(card, h) for card, value in past.items() for h in value[0]]
        _drop(self.ids, [self._key(card, i) for (card, _), v in zip(hours, _get(self.hours, hours), strict=True) if v for i in v[2]])
        _drop(self.hours, hours)
        _drop(self.cards, [(card,) for card in past])
        self._watch({card: value[9] for card, value in stored.items() if card not in past}, watermark)

    def _cards(self, key, batch: dict) -> Iterator[list[tuple[str, int, int]]]:
        part: list[tuple[str, int, int]] = []
        for card, a, b in _runs(batch[KEY]):
            part.append((card, a, b))
            if b - part[0][1] >= ROWS_AT_ONCE:
                yield part
                part = []
        if part:
            yield part


#: Rows whose amounts are looked back from at once, which bounds the table of what they see.
_ROWS = 4096


def _trailing(line: list, first: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and deviation of up to ``depth`` values before each from place ``first`` on; None is no value."""
    padded = np.concatenate([np.full(depth, np.nan), np.array(line, float)])
    seen = np.lib.stride_tricks.sliding_window_view(padded, depth)[first:len(line)]
    there = ~np.isnan(seen)
    n = there.sum(axis=1)
    some = np.maximum(n, 1)
    mean = np.where(there, seen, 0.0).sum(axis=1) / some
    gap = np.where(there, seen - mean[:, None], 0.0)
    deviation = np.sqrt((gap * gap).sum(axis=1) / some)
    return n.astype(np.int64), np.where(n > 0, mean, np.nan), np.where(n > 0, deviation, np.nan)


def _values(column: pd.Series):
    """The values of a column: plain arrays for numbers and objects."""
    return column.to_numpy() if column.dtype.kind in "ifbO" else column.array


def _whole(values: np.ndarray) -> np.ndarray:
    """Whole numbers; a missing one is the smallest there is."""
    if values.dtype == np.int64:
        return values
    numbers = pd.to_numeric(pd.Series(values)).to_numpy(float)
    return np.where(np.isnan(numbers), np.iinfo(np.int64).min, numbers).astype(np.int64)


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    for k, v in enumerate(values):
        out[k] = v
    return out


def _cast(values, kind: str):
    if kind in ("long", "integer", "short", "byte"):
        if values.dtype.kind == "i":
            return values
        if values.dtype.kind != "f":
            return pd.to_numeric(pd.Series(values)).astype("Int64")
        missing = np.isnan(values)
        return pd.arrays.IntegerArray(np.where(missing, 0, values).astype(np.int64), missing)
    if kind in ("double", "float") and values.dtype.kind != "f":
        return pd.to_numeric(pd.Series(values)).astype("float64")
    return values


#: Columns of :func:`card_history`.
HISTORY = ["key", "hour", *(c.split()[0] for c in CARD_SCHEMA.split(", ")), "times", "amounts", "ids"]


def _listed(value, whole: bool = False):
    """A state value as plain Python: lists for arrays, None inside for missing entries.

    Whole numbers with gaps arrive as floats.
    """
    if isinstance(value, (np.ndarray, list)):
        plain = [None if v is None or v != v else (v.item() if hasattr(v, "item") else v) for v in value]
        return [None if v is None else int(v) for v in plain] if whole else plain
    return None if value is None or value != value else int(value)


def card_history(
    df: DataFrame, card: str = "card1", time: str = "t_us", row_id: str = "TransactionID", unit: int = 1_000_000,
    event_time: str = "event_time",
) -> DataFrame:
    """The state that a stream would hold after the rows of ``df``: one row for each card, one for each of its hours.

    A stream started with it goes on where the table ends. Rows without a card are left out. An hour's payments
    are one group, as they are one value of the state.
    """
    hour = F.floor(F.col(time) / (HOUR * unit)).cast("long")
    rows = df.where(F.col(card).isNotNull()).select(
        F.col(card).cast("string").alias(KEY), hour.alias("hour"), F.col(time).alias("_t"),
        F.col(row_id).alias("_id"), F.col("TransactionAmt").cast("double").alias("_amount"),
        *[F.col(c).cast("bigint" if c.startswith("addr") else "string").alias(c) for c in PROFILE],
        F.unix_millis(event_time).alias("_ms"))
    last = rows.groupBy(KEY).agg(F.max("_t").alias("_last"), F.max("_ms").alias("newest"))
    floor = F.floor((F.col("_last") - max(USER_WINDOWS.values()) * HOUR * unit) / (HOUR * unit))
    paid = F.col("_amount").isNotNull()
    line = F.sort_array(F.collect_list(F.when(paid, F.struct("_t", "_amount"))))
    hours = rows.join(last, KEY).where(F.col("hour") >= floor).groupBy(KEY, "hour").agg(
        line.alias("_line"), F.collect_list(F.col("_id").cast("string")).alias("ids")).select(
        KEY, "hour", F.col("_line._t").alias("times"), F.col("_line._amount").alias("amounts"), "ids")
    sums = hours.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct(
        "hour", F.size("times").cast("long").alias("n"),
        F.aggregate("amounts", F.lit(0.0), lambda a, b: a + b).alias("s")))).alias("_sums"))
    newest = Window.partitionBy(KEY).orderBy(F.desc("_t"), F.desc("_id"))
    recent = rows.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= REMEMBER["amounts"])
    kept = recent.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("_back")).alias("_at"), *PROFILE, F.col("_amount").alias("recent")))).alias("_rows"))

    def tail(name: str, depth: int):
        values = F.col("_rows").getField(name)
        return F.slice(values, F.greatest(F.size(values) - depth + 1, F.lit(1)), depth).alias(name)

    cards = kept.join(sums, KEY).join(last, KEY).select(
        KEY, F.lit(None).cast("long").alias("hour"), F.col("_sums.hour").alias("hours"),
        F.col("_sums.n").alias("counts"), F.col("_sums.s").alias("sums"),
        *[tail(c, depth) for c, (_, depth) in PROFILE.items()], tail("recent", REMEMBER["amounts"]), "newest")
    return cards.unionByName(hours, allowMissingColumns=True)
