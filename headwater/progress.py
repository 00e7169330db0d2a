"""Progress lines on a stream: phases, rates and remaining time, at most one line a second for each label."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from typing import TextIO


def shown_duration(seconds: float) -> str:
    whole = int(seconds)
    hours, rest = divmod(whole, 3600)
    return f"{hours}:{rest // 60:02d}:{rest % 60:02d}" if hours else f"{rest // 60:02d}:{rest % 60:02d}"


class Progress:
    def __init__(self, out: TextIO | None = None, clock: Callable[[], float] = time.monotonic, every: float = 1.0):
        self.out, self.clock, self.every = out or sys.stderr, clock, every
        self.began, self.phase_name, self.phase_began = clock(), "", clock()
        self.last: dict[str, float] = {}
        self.first: dict[str, float] = {}

    def _say(self, text: str) -> None:
        print(f"[{shown_duration(self.clock() - self.began)}] {text}", file=self.out, flush=True)

    def phase(self, name: str) -> None:
        self.phase_name, self.phase_began = name, self.clock()
        self._say(f"== {name}")

    def start(self, what: str) -> None:
        self.first[what] = self.clock()
        self._say(f"{what} ...")

    def done(self, what: str, detail: str = "") -> None:
        took = self.clock() - self.first.pop(what, self.phase_began)
        self._say(f"{what} done in {shown_duration(took)}" + (f": {detail}" if detail else ""))

    def tick(self, what: str, n: int, total: int | None = None) -> None:
        now = self.clock()
        begun = self.first.setdefault(what, now)
        if n != total and now - self.last.get(what, -1e9) < self.every:
            return
        self.last[what] = now
        rate = n / (now - begun) if now > begun else 0.0
        left = f", {shown_duration((total - n) / rate)} left" if total and rate and n < total else ""
        self._say(f"{what}: {n}" + (f"/{total}" if total else "") + (f" ({rate:.1f}/s{left})" if rate else ""))

    def note(self, text: str) -> None:
        self._say(text)

    def close(self) -> None:
        self._say("finished")


class Silent(Progress):
    """The same calls, saying nothing."""

    def _say(self, text: str) -> None:
        pass
