"""What a user sees of long work: one line that is drawn anew."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import TextIO

from pyspark import SparkContext

from tallyframe.functions.sizes import bytes_text

# The bar's and the label's widths, and the bytes after which the line is drawn anew.
WIDTH, LABEL, STEP = 28, 11, 8 << 20


@dataclass
class Progress:
    """Drawn at the start, after every 8 MiB or 1% of the files (each file up to 100), and at the end."""

    out: TextIO
    label: str
    total_bytes: int
    total_files: int
    show_speed: bool = False
    clock: Callable[[], int] = time.monotonic_ns
    done_bytes: int = 0
    done_files: int = 0
    _drawn: tuple[int, int] = (0, 0)
    _began: int | None = None
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def start(self) -> None:
        self._began = self.clock()
        self._draw()

    def reach(self, done_bytes: int, done_files: int) -> None:
        """So much is done in all."""
        with self._lock:
            self.done_bytes, self.done_files = max(done_bytes, self.done_bytes), max(done_files, self.done_files)
            at_end = self.total_files and self._drawn[1] < self.total_files <= self.done_files
            if self._began is not None and (at_end or self.total_bytes and self.done_bytes - self._drawn[0] >= STEP or self.done_files - self._drawn[1] >= max(1, self.total_files // 100)):
                self._draw()

    def finish(self) -> None:
        unfinished = (self.done_bytes, self.done_files) != (self.total_bytes, self.total_files)
        self.done_bytes, self.done_files = self.total_bytes or self.done_bytes, self.total_files or self.done_files
        if unfinished or self._began is None:
            self._draw()
        self.out.write("\n")
        self.out.flush()

    def percent(self) -> int:
        for done, total in ((self.done_bytes, self.total_bytes), (self.done_files, self.total_files)):
            if total > 0:
                return min(done, total) * 100 // total
        return 100

    def speed(self) -> int:
        """Bytes a second."""
        if not self.done_bytes or self._began is None:
            return 0
        return self.done_bytes * 10**9 // max(1, self.clock() - self._began)

    def line(self) -> str:
        percent, files = self.percent(), f"files {min(self.done_files, self.total_files)}/{self.total_files}"
        size = f"{bytes_text(min(self.done_bytes, self.total_bytes))}/{bytes_text(self.total_bytes)}  " if self.total_bytes else ""
        speed = f"  {bytes_text(self.speed())}/s" if size and self.show_speed else ""
        return f"{self.label}: ".ljust(LABEL) + f"[{'#' * (percent * WIDTH // 100):-<{WIDTH}}] {percent:3d}%  {size}{files}{speed}"

    def _draw(self) -> None:
        self._drawn = self.done_bytes, self.done_files
        self.out.write(f"\r{self.line()}        ")
        self.out.flush()


@contextmanager
def followed(context: SparkContext, progress: Progress, every: float = 0.5) -> Iterator[tuple]:
    """Accumulators of bytes and files for tasks to add to; the line follows them, task by task."""
    moved, files, done = context.accumulator(0), context.accumulator(0), threading.Event()

    def follow() -> None:
        while not done.wait(every):
            progress.reach(moved.value, files.value)

    progress.start()
    thread = threading.Thread(target=follow, daemon=True)
    thread.start()
    try:
        yield moved, files
    finally:
        done.set()
        thread.join()
        progress.reach(moved.value, files.value)
    progress.finish()
