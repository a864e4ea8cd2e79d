"""State rules of the time-driven checks, in whole microseconds.

A rule's state is a time and a small counter. ``step`` takes one event from a known state.
``advance`` does the same for all entry states at once: pieces of the entry time, each of
which maps to a fixed time, or to the entry time plus a shift.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NEVER = -(1 << 61)
FOREVER = 1 << 61
State = tuple[int, int]
START: State = (NEVER, 0)


@dataclass
class Pieces:
    """Entry (time in [lo, hi], counter) -> time (``val``, plus the entry time if ``moves``) and counter."""

    lo: np.ndarray
    hi: np.ndarray
    entry_count: np.ndarray
    moves: np.ndarray
    val: np.ndarray
    count: np.ndarray

    @classmethod
    def identity(cls, counts: int) -> Pieces:
        n = np.arange(counts, dtype=np.int64)
        full = lambda v: np.full(counts, v, dtype=np.int64)
        return cls(full(NEVER), full(FOREVER), n, np.ones(counts, dtype=bool), full(0), n.copy())

    @classmethod
    def fixed(cls, state: State, counts: int) -> Pieces:
        p = cls.identity(counts)
        p.moves[:] = False
        p.val[:], p.count[:] = state
        return p

    def columns(self) -> dict[str, list]:
        return {k: getattr(self, k).tolist() for k in ("lo", "hi", "entry_count", "moves", "val", "count")}

    @classmethod
    def from_columns(cls, row) -> Pieces:
        ints = {k: np.asarray(row[k], dtype=np.int64) for k in ("lo", "hi", "entry_count", "val", "count")}
        return cls(moves=np.asarray(row["moves"], dtype=bool), **ints)

    def apply(self, state: State) -> State:
        at = np.flatnonzero((self.entry_count == state[1]) & (self.lo <= state[0]) & (state[0] <= self.hi))[0]
        return int(self.val[at] + (state[0] if self.moves[at] else 0)), int(self.count[at])

    def split(self, limit: int) -> None:
        """Cut moving pieces so that each lies wholly at or below ``limit`` or wholly above it."""
        edge = limit - self.val
        cut = self.moves & (self.lo <= edge) & (edge < self.hi)
        if not cut.any():
            return
        i = np.flatnonzero(cut)
        upper = {k: getattr(self, k)[i].copy() for k in ("lo", "hi", "entry_count", "moves", "val", "count")}
        upper["lo"] = edge[i] + 1
        self.hi[i] = edge[i]
        for k, tail in upper.items():
            setattr(self, k, np.insert(getattr(self, k), i + 1, tail))

    def at_most(self, limit: int) -> np.ndarray:
        return np.where(self.moves, self.hi + self.val, self.val) <= limit

    def merge(self) -> None:
        if len(self.lo) < 2:
            return
        same = (
            (self.entry_count[1:] == self.entry_count[:-1])
            & (self.moves[1:] == self.moves[:-1])
            & (self.val[1:] == self.val[:-1])
            & (self.count[1:] == self.count[:-1])
        )
        if not same.any():
            return
        first = np.concatenate(([True], ~same))
        last = np.concatenate((~same, [True]))
        hi = self.hi[last]
        for k in ("lo", "entry_count", "moves", "val", "count"):
            setattr(self, k, getattr(self, k)[first])
        self.hi = hi


@dataclass(frozen=True)
class TokenBucket:
    """Admit an event while the client has a token; tokens return steadily.

    The time is when the bucket would be full again. A refused event costs nothing.
    """

    capacity: int = 60
    token_us: int = 1_000_000  # time one token takes to return
    counts: int = 1

    def step(self, state: State, t: int, flag: bool) -> tuple[State, int]:
        full_at = max(state[0], t)
        allowed = full_at - t <= (self.capacity - 1) * self.token_us
        # A bucket already full stays described by the past time until it is used.
        return ((full_at + self.token_us, 0) if allowed else state), int(allowed)

    def advance(self, p: Pieces, t: int, flag: bool) -> None:
        p.split(t)
        full = p.at_most(t)
        p.moves &= ~full
        p.val[full] = t
        limit = t + (self.capacity - 1) * self.token_us
        p.split(limit)
        p.val[p.at_most(limit)] += self.token_us
        p.merge()


@dataclass(frozen=True)
class RepeatWindow:
    """Serve repeats of a key from memory until the first one's time is up (no extension on use)."""

    ttl_us: int = 300_000_000
    counts: int = 1

    def step(self, state: State, t: int, flag: bool) -> tuple[State, int]:
        if t < state[0]:
            return state, 0
        return (t + self.ttl_us, 0), 1

    def advance(self, p: Pieces, t: int, flag: bool) -> None:
        p.split(t)
        over = p.at_most(t)
        p.moves &= ~over
        p.val[over] = t + self.ttl_us
        p.merge()


@dataclass(frozen=True)
class CircuitBreaker:
    """Refuse calls for a while once failures follow each other; ``flag`` is the call's success.

    Refused calls count for nothing. Only a success resets the counter, so a failure right
    after the pause opens the circuit again. Codes: 0 refused, 1 succeeded, 2 failed, 3
    failed and opened the circuit.
    """

    threshold: int = 3
    cooldown_us: int = 30_000_000

    @property
    def counts(self) -> int:
        return self.threshold + 1

    def step(self, state: State, t: int, flag: bool) -> tuple[State, int]:
        until, failures = state
        if t < until:
            return state, 0
        if flag:
            return (NEVER, 0), 1
        failures = min(self.threshold, failures + 1)
        if failures == self.threshold:
            return (t + self.cooldown_us, failures), 3
        return (NEVER, failures), 2

    def advance(self, p: Pieces, t: int, flag: bool) -> None:
        p.split(t)
        taken = p.at_most(t)
        p.moves &= ~taken
        p.val[taken] = NEVER
        if flag:
            p.count[taken] = 0
        else:
            p.count[taken] = np.minimum(self.threshold, p.count[taken] + 1)
            opened = taken & (p.count == self.threshold)
            p.val[opened] = t + self.cooldown_us
        p.merge()
