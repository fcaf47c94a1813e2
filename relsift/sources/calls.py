"""Calls to outside services from within a task: several at once, in order, no faster than allowed."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor


def in_order(call: Callable, items: Iterable, at_once: int) -> Iterator:
    """call(item) of each item, in the order of the items; at most so many are under way or done ahead of the next one to give."""
    with ThreadPoolExecutor(max(at_once, 1)) as pool:
        under_way: deque = deque()
        for item in items:
            under_way.append(pool.submit(call, item))
            if len(under_way) >= at_once:
                yield under_way.popleft().result()
        while under_way:
            yield under_way.popleft().result()


class Pace:
    """At most so many calls a second from all threads of a task; 0: as many as come."""

    def __init__(self, a_second: float, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.clock, self.sleep = (1 / a_second if a_second > 0 else 0.0), clock, sleep
        self.free, self.lock = 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            at = max(now, self.free)
            self.free = at + self.gap
        if at > now:
            self.sleep(at - now)
