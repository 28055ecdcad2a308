"""Readers and other text models as interfaces: whatever answers a prompt, made patient, taught by examples, read as JSON."""

from __future__ import annotations

import inspect
import json
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

#: Calls of a task that are under way at a time.
WINDOW = 8


def retrying(call: Callable, attempts: int = 10, first: float = 0.75, most: float = 45.0, sleep: Callable[[float], None] | None = None) -> Callable:
    """``call``, tried again after a failure, with pauses that double up to ``most`` seconds; the last failure is raised."""

    def run(*args, **how):
        for k in range(attempts):
            try:
                return call(*args, **how)
            except Exception:  # any failure of a remote model may pass
                if k + 1 == attempts:
                    raise
                (sleep or time.sleep)(min(most, first * 2**k))

    return run


class Rate:
    """At most so many starts a second, shared by all threads of a task; None lets everything start."""

    def __init__(self, a_second: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.pause, self.clock, self.sleep = 1.0 / a_second if a_second else 0.0, clock, sleep
        self.next, self.lock = 0.0, threading.Lock()

    def wait(self) -> None:
        if self.pause:
            with self.lock:
                now = self.clock()
                start = max(now, self.next)
                self.next = start + self.pause
            self.sleep(start - now)


def in_order(call: Callable, items: Iterable, window: int = WINDOW, rate: float | None = None) -> Iterator[tuple[object, Exception | None]]:
    """(result, None) or (None, exception) of each item, in the order of the items, with up to ``window`` calls under way and at most
    ``rate`` starts a second. A call that fails leaves the others alone. With a window of 1 there are no threads."""
    shared = Rate(rate)

    def one(item) -> tuple[object, Exception | None]:
        shared.wait()
        try:
            return call(item), None
        except Exception as e:  # told to the caller, who knows what it means
            return None, e

    if window <= 1:
        yield from map(one, items)
        return
    with ThreadPoolExecutor(window) as pool:
        under_way: deque[Future] = deque()
        try:
            for item in items:
                if len(under_way) >= window:
                    yield under_way.popleft().result()
                under_way.append(pool.submit(one, item))
            while under_way:
                yield under_way.popleft().result()
        finally:
            for f in under_way:
                f.cancel()


def ask(client: Callable, prompt: str, **settings) -> str:
    """The client's answer. Settings (tokens, temperature, ...) go to those clients that take them by name."""
    takes = inspect.signature(client).parameters
    if not any(p.kind is p.VAR_KEYWORD for p in takes.values()):
        settings = {k: v for k, v in settings.items() if k in takes}
    return client(prompt, **settings)


def named(clients: dict[str, Callable[[], Callable]], name: str, aliases: dict[str, str] | None = None) -> Callable:
    """The client of a name or of what it is an alias for; ValueError for an unknown one."""
    real = (aliases or {}).get(name, name)
    if real not in clients:
        raise ValueError(f"no client {name}; there are {', '.join(sorted(clients))}")
    return clients[real]()


def with_examples(client: Callable, examples: list[tuple[str, str]]) -> Callable:
    """A client that sees questions with their answers before each prompt."""
    shown = "".join(f"{asked}\n{said}\n\n" for asked, said in examples)
    return lambda prompt, **settings: ask(client, shown + prompt, **settings)


def json_trials(client: Callable, prompt: str, trials: int = 3, **settings) -> object:
    """The first answer that is JSON, of up to so many; ValueError if none is."""
    for _ in range(trials):
        try:
            return json.loads(ask(client, prompt, **settings))
        except ValueError:
            continue
    raise ValueError(f"no JSON in {trials} answers")
