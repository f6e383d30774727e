"""Work in a process beside this one, which is replaced from time to time.

Python keeps every identifier that it has ever parsed (interned names are immortal), so a worker that
lives as long as its executor would grow with all sources it has seen. A forked process has the parsers
already; it ends, and its names with it, once it has seen a stated amount of text.
"""

from __future__ import annotations

import marshal
import os
from collections.abc import Callable

#: Kinds whose parsers leave something behind in their process for each text.
LEAVES = frozenset({"python"})
#: Characters after which a process is replaced.
MOST = 8 << 20
#: Of ``marshal``: later formats mark interned texts, which the reader would then keep as well.
FORMAT = 2


class Ended(RuntimeError):
    """The other process ended before its answer, which is no fault of the text."""


class Apart:
    """``work(*lists)`` in another process: lists of plain values there and back (``marshal``)."""

    def __init__(self, work: Callable, most: int = MOST):
        self.work, self.most, self.seen, self.pid, self.owner = work, most, 0, None, None

    def __call__(self, size: int, *given):
        if not hasattr(os, "fork"):
            return self.work(*given)
        if self.pid is None or self.owner != os.getpid() or self.seen >= self.most:
            self._start()
        self.seen += size
        try:
            marshal.dump(given, self.ask, FORMAT)
            self.ask.flush()
            done, value = marshal.load(self.answer)
        except (EOFError, OSError, ValueError) as e:
            self.close()
            raise Ended("the process beside the worker ended before its answer") from e
        if not done:
            raise RuntimeError(value)
        return value

    def _start(self) -> None:
        self.close()
        (read, ask), (answer, write) = os.pipe(), os.pipe()
        pid = os.fork()
        if not pid:
            try:
                os.close(ask)
                os.close(answer)
                self._serve(os.fdopen(read, "rb"), os.fdopen(write, "wb"))
            finally:
                os._exit(0)
        os.close(read)
        os.close(write)
        self.ask, self.answer = os.fdopen(ask, "wb"), os.fdopen(answer, "rb")
        self.pid, self.owner, self.seen = pid, os.getpid(), 0

    def _serve(self, read, write) -> None:
        while True:
            given = marshal.load(read)  # ends with EOFError when the worker is gone
            try:
                out = (True, self.work(*given))
            except Exception as e:
                out = (False, f"{type(e).__name__}: {e}")
            marshal.dump(out, write, FORMAT)
            write.flush()

    def close(self) -> None:
        """Ends the other process."""
        if self.pid is not None and self.owner == os.getpid():
            for f in (self.ask, self.answer):
                try:
                    f.close()
                except OSError:
                    pass
            os.waitpid(self.pid, 0)
        self.pid = None
