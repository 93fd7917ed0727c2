"""Progress events: a bus of callbacks without replay."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass


#: Seconds that a listener usually stays.
LISTEN_SECONDS = 120.0


@dataclass(frozen=True)
class Event:
    run_id: int
    step: str
    status: str
    message: str
    progress: int
    target: str | None = None
    error: str | None = None


class EventBus:
    """Hands each event to every listener; one that raises, or whose time is over, is removed."""

    def __init__(self, clock: Callable[[], float] = time.monotonic) -> None:
        self._clock = clock
        self._listeners: dict[Callable[[Event], None], float] = {}

    def register(self, listener: Callable[[Event], None], seconds: float | None = None, connected: Callable[[], None] | None = None) -> Callable[[], None]:
        """Adds a listener, for so many seconds (LISTEN_SECONDS is usual) or for good, and calls ``connected`` first;
        the returned function removes it."""
        if connected:
            connected()
        self._listeners[listener] = float("inf") if seconds is None else self._clock() + seconds
        return lambda: self.unregister(listener)

    def unregister(self, listener: Callable[[Event], None]) -> None:
        self._listeners.pop(listener, None)

    def publish(self, event: Event) -> None:
        for listener, until in list(self._listeners.items()):
            if self._clock() >= until:
                self.unregister(listener)
                continue
            try:
                listener(event)
            except Exception:  # a dead listener doesn't stop the run
                self.unregister(listener)
