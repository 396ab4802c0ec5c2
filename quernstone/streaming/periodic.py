"""A cycle of runs: each begins an interval after the last has ended, and a failure ends none but its own."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable


def run_all(targets: Iterable, run: Callable[[object], object]) -> list[tuple[object, object, str | None]]:
    """(target, result, error) of each target in turn; a failed one has an error and leaves the others alone."""
    out = []
    for target in targets:
        try:
            out.append((target, run(target), None))
        except Exception as e:  # noqa: BLE001 whatever a run raises is its own
            out.append((target, None, f"{type(e).__name__}: {e}"))
    return out


class Periodic:
    """Runs ``cycle`` after ``delay`` seconds and then ``interval`` seconds after each run, until it is stopped.

    One cycle runs at a time; ``stop`` waits for it.  ``once`` runs a cycle now, or
    says that one is running.
    """

    def __init__(self, cycle: Callable[[], object], interval: float, delay: float = 0.0):
        self.cycle, self.interval, self.delay = cycle, interval, delay
        self.errors: list[str] = []
        self.runs = 0
        self._ended, self._busy = threading.Event(), threading.Lock()
        self._thread: threading.Thread | None = None

    def once(self) -> bool:
        if not self._busy.acquire(blocking=False):
            return False
        try:
            self.cycle()
        except Exception as e:  # noqa: BLE001 the next cycle tries again
            self.errors.append(f"{type(e).__name__}: {e}")
        finally:
            self.runs += 1
            self._busy.release()
        return True

    def _loop(self) -> None:
        wait = self.delay
        while not self._ended.wait(wait):
            self.once()
            wait = self.interval

    def start(self) -> None:
        if self._thread is None:
            self._ended.clear()
            self._thread = threading.Thread(target=self._loop, daemon=True)
            self._thread.start()

    def stop(self) -> None:
        self._ended.set()
        if self._thread is not None:
            self._thread.join()
            self._thread = None

    def reconfigure(self, interval: float) -> None:
        """Stops and, for a positive interval, starts again with it."""
        self.stop()
        self.interval = interval
        if interval > 0:
            self.start()
