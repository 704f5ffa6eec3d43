"""Memory tiers as keyed state of a stream: short-term promotion, three tiers, and triggers by count or time.

Each operator takes units in the order in which they come for their key and keeps a bounded state; units of one key are
handled one after the other, as the semantics ask, and keys are spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Tokens at which short-term memory is promoted, and segments that one promotion takes.
STM_TOKENS, STM_BATCH = 2048, 10
#: Units of the sensory tier and of the short-term tier, the share of it that is promoted, and units that stay for good.
SENSORY, SHORT, SHARE, LONG = 50, 200, 0.3, 10_000
#: Events, or seconds since the last time, at which events are consolidated.
EVENTS, SECONDS = 10, 60.0


def _stateful(stream: DataFrame, out: str, state: str, start: tuple, columns: list[str], step: Callable) -> DataFrame:
    """step(state, *columns) gives the new state and the rows it emits; both are tuples."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(kept.get) if kept.exists else start
        made = []
        for part in parts:
            for values in zip(*[part[c].tolist() for c in columns], strict=True):
                now, rows = step(now, *values)
                made += [(key[0], *r) for r in rows]
        kept.update(now)
        yield pd.DataFrame(made, columns=[c.split()[0] for c in out.split(", ")])

    return stream.groupBy("key").applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def short_term(segments: DataFrame, limit: int = STM_TOKENS, batch: int = STM_BATCH) -> DataFrame:
    """key, segments, tokens of each promotion of segments (key, tokens): at the limit the first `batch` segments go, the rest stays."""

    def step(now: tuple, tokens: int) -> tuple:
        held = [*now[0], int(tokens)]
        if sum(held) < limit:
            return (held,), []
        return (held[batch:],), [(len(held[:batch]), sum(held[:batch]))]

    return _stateful(segments, "key string, segments long, tokens long", "held array<long>", ([],), ["tokens"], step)


def tiers(units: DataFrame, sensory: int = SENSORY, short: int = SHORT, share: float = SHARE, long: int = LONG) -> DataFrame:
    """key, moved, units, kept of units (key, id): flushes from sensory to short-term, and promotions to long-term with what is kept there."""

    def step(now: tuple, _: int) -> tuple:
        a, b, c = now
        a, rows = a + 1, []
        if a >= sensory:
            rows.append(("short", a, a + b))
            a, b = 0, a + b
        if b >= short:
            n = math.ceil(b * share)
            b, c = b - n, min(long, c + n)
            rows.append(("long", n, c))
        return (a, b, c), rows

    return _stateful(units, "key string, moved string, units long, kept long", "a long, b long, c long", (0, 0, 0), ["id"], step)


def triggered(events: DataFrame, most: int = EVENTS, seconds: float = SECONDS) -> DataFrame:
    """key, events, at of each consolidation of events (key, seconds): by their number, or by the time since the last one (or the first event)."""

    def step(now: tuple, at: float) -> tuple:
        n, last = now
        last = at if last < 0 else last
        n += 1
        if n >= most or at - last >= seconds:
            return (0, at), [(n, at)]
        return (n, last), []

    return _stateful(events, "key string, events long, at double", "n long, last double", (0, -1.0), ["seconds"], step)
