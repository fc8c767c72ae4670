"""Books over a stream of events: keyed state by instrument, holding its live orders and price levels.

Rows of a micro-batch are applied in ord; a row that comes in a later batch than rows beyond it is applied when it arrives, as a merge
passes late records through, and the updates of the levels that it touches are marked late. A stream merged first (sources.StreamMerge) has such rows only beyond its delay.
The state is two maps; a batch reads each order and level that it touches once, and writes those that it changes once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Map:
    """A map state as it is during one batch; write() puts back what changed."""

    def __init__(self, state):
        self.state, self.seen, self.changed, self.cleared = state, {}, set(), False

    def get(self, key):
        if key not in self.seen:
            known = not self.cleared and self.state.containsKey(key)
            self.seen[key] = tuple(self.state.getValue(key)) if known else None
        return self.seen[key]

    def put(self, key, value) -> None:
        self.seen[key] = value
        self.changed.add(key)

    def keys(self) -> list:
        stored = [] if self.cleared else [tuple(k) for k in self.state.keys()]
        return [k for k in {*stored, *self.seen} if self.get(k) is not None]

    def clear(self) -> None:
        self.seen, self.changed, self.cleared = {}, set(), True

    def write(self) -> None:
        if self.cleared:
            self.state.clear()
        for k in self.changed:
            if self.seen[k] is not None:
                self.state.updateValue(k, self.seen[k])
            elif not self.cleared and self.state.containsKey(k):
                self.state.removeKey(k)


class BookProcessor(StatefulProcessor):
    def __init__(self, ord_type: str, expire_ms: int | None):
        self.ord_type, self.expire_ms = ord_type, expire_ms

    def init(self, handle):
        self.orders = handle.getMapState("orders", "order_id long", "side int, price long, size long", self.expire_ms)
        self.levels = handle.getMapState("levels", "side int, price long", "qty long")
        self.last = handle.getValueState("last", f"ord {self.ord_type}")

    @staticmethod
    def _apply(orders: _Map, levels: _Map, action, order, side, price, size) -> list:
        """Apply one event; the levels that it touches."""
        known = orders.get((order,))
        touched = []

        def change(side, price, size, adds):
            has = levels.get((side, price))
            if adds or has is not None:
                left = (has[0] if has else 0) + size
                levels.put((side, price), (left,) if adds or left > 0 else None)
                touched.append((side, price))

        if action == "R":
            touched = levels.keys()
            levels.clear()
            orders.clear()
        elif action == "C" and known is not None:
            if known[2] > size:
                change(known[0], known[1], size - known[2], False)
            orders.put((order,), (known[0], known[1], size) if size else None)
        elif action == "M" and known is not None:
            change(known[0], known[1], -known[2], False)
            now = (side or known[0], known[1] if price is None else price, size)
            change(*now, True)
            orders.put((order,), now)
        elif action in ("A", "M") and side != 0 and price is not None:
            change(side, price, size, True)
            orders.put((order,), (side, price, size))
        return touched

    def handleInputRows(self, key, rows, timers):
        batch = pd.concat(list(rows)).sort_values("ord", kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        orders, levels = _Map(self.orders), _Map(self.levels)
        touched: dict = {}
        for r in batch.itertuples(index=False):
            late = bool(r.late) or (last is not None and r.ord < last)
            price = None if pd.isna(r.price) else int(r.price)
            for k in self._apply(orders, levels, r.action, int(r.order_id), int(r.side), price, int(r.size)):
                touched[k] = touched.get(k, False) or late
        out = []
        top = batch["ord"].iloc[-1] if last is None else max(batch["ord"].iloc[-1], last)
        top = top if isinstance(top, str) else int(top)
        for (side, price), late in sorted(touched.items()):
            has = levels.get((side, price))
            out.append((int(key[0]), int(side), int(price), int(has[0]) if has else 0, has is not None, top, late))
        orders.write()
        levels.write()
        self.last.update((top,))
        yield pd.DataFrame(out, columns=["instrument_id", "side", "price", "qty", "exists", "ord", "late"])

    def close(self):
        pass


def stream_books(events: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """Level updates (instrument_id, side, price, qty, exists, ord, late) of a streaming DataFrame with instrument_id (or a routed book under that name), ord, order_id, action, side, price, size, and late if it has it.

    Events without an instrument_id are left out. The last update of a (instrument_id, side, price) tells its level; exists is false once it is gone. ord is a number or a text that sorts. Needs STATE_STORE as the
    session's state store provider. expire_ms: forget a live order of which nothing came for so long, by the clock; its volume stays in its level.
    """
    ord_type = dict(events.dtypes)["ord"]
    late = "late" if "late" in events.columns else "false late"
    cols = events.where("instrument_id is not null").selectExpr("instrument_id", "ord", "cast(order_id as long) order_id", "action", "cast(side as int) side", "price", "size", late)
    out = f"instrument_id long, side int, price long, qty long, exists boolean, ord {ord_type}, late boolean"
    return cols.groupBy("instrument_id").transformWithStateInPandas(
        statefulProcessor=BookProcessor(ord_type, expire_ms), outputStructType=out, outputMode="Append", timeMode="ProcessingTime" if expire_ms else "None"
    )
