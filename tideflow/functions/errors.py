"""Per-row error policies and backoff, as values; and how they wrap a Python function."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


def fixed_backoff(seconds: float) -> Callable[[int], float]:
    return lambda attempt: seconds


def exponential_backoff(initial: float, most: float) -> Callable[[int], float]:
    return lambda attempt: min(initial * 2**attempt, most)


@dataclass(frozen=True)
class OnError:
    """fail: the job fails; drop: the row goes; substitute: `value` stands in. Before that up to `retries` more tries, for errors that `retry_if` accepts."""

    action: str = "fail"
    value: Any = None
    retries: int = 0
    retry_if: Callable[[BaseException], bool] = field(default=lambda e: True)
    backoff: Callable[[int], float] = field(default=lambda attempt: 0.0)

    def __post_init__(self) -> None:
        if self.action not in ("fail", "drop", "substitute"):
            raise ValueError(f"no such action: {self.action}")

    def run(self, fn: Callable[[Any], Any], item: Any, timeout: float | None = None) -> tuple[bool, Any]:
        """Whether a result is there, and the result. timeout: seconds that each try may take; one that takes longer has failed with TimeoutError."""
        attempt = 0
        while True:
            try:
                return True, within_seconds(fn, item, timeout)
            except Exception as error:
                if attempt < self.retries and self.retry_if(error):
                    time.sleep(self.backoff(attempt))
                    attempt += 1
                    continue
                if self.action == "fail":
                    raise
                return (True, self.value) if self.action == "substitute" else (False, None)


HALT, DROP = OnError(), OnError("drop")


def within_seconds(fn: Callable[[Any], Any], item: Any, seconds: float | None) -> Any:
    """fn(item), or TimeoutError if it takes longer. The call is left behind in its own thread, so it should not hold locks."""
    if seconds is None:
        return fn(item)
    done: queue.SimpleQueue = queue.SimpleQueue()

    def call() -> None:
        try:
            done.put((True, fn(item)))
        except BaseException as error:  # handed to the caller
            done.put((False, error))

    threading.Thread(target=call, daemon=True).start()
    try:
        good, got = done.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"took longer than {seconds} s") from None
    if not good:
        raise got
    return got


@dataclass(frozen=True)
class Supervision:
    """How often a failing step is taken up again: the row it failed on is lost, up to `restarts` times in a task (within `window` seconds, if given), after a backoff. skip_panics: errors of these types do not count and lose their row only."""

    restarts: int = 0
    window: float | None = None
    backoff: Callable[[int], float] = field(default=lambda attempt: 0.0)
    only: tuple[type[BaseException], ...] = (Exception,)
    skip: tuple[type[BaseException], ...] = ()

    def supervised(self, fn: Callable[[Any], Any]) -> Callable[[Any], tuple[bool, Any]]:
        """A function that tells whether there is a result, and gives it; made once in each task, as it counts restarts."""
        used, since = 0, time.monotonic()

        def call(item: Any) -> tuple[bool, Any]:
            nonlocal used, since
            try:
                return True, fn(item)
            except self.skip:
                return False, None
            except self.only:
                if self.window is not None and time.monotonic() - since > self.window:
                    used, since = 0, time.monotonic()
                if used >= self.restarts:
                    raise
                time.sleep(self.backoff(used))
                used += 1
                return False, None

        return call


_run_default = HALT


def set_error_strategy(strategy: OnError) -> OnError:
    """The policy of operators that name none; returns the one before."""
    global _run_default
    before, _run_default = _run_default, strategy
    return before


def error_strategy(named: OnError | None) -> OnError:
    """The operator's own policy, else that of the run, else to fail."""
    return named if named is not None else _run_default


def substitute(value: Any) -> OnError:
    return OnError("substitute", value)


def retry(n: int, then: OnError = HALT, backoff: Callable[[int], float] = lambda attempt: 0.0, retry_if: Callable[[BaseException], bool] = lambda e: True) -> OnError:
    return OnError(then.action, then.value, n, retry_if, backoff)


@dataclass(frozen=True)
class RetryStrategy:
    """Attempts of a whole run; -1 for ever."""

    attempts: int = 1
    backoff: Callable[[int], float] = field(default=lambda attempt: 0.0)
    retryable: Callable[[BaseException], bool] = field(default=lambda e: True)
    on_retry: Callable[[int, BaseException], None] = field(default=lambda attempt, e: None)
