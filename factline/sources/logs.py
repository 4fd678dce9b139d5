"""The driver's own output, kept in a file."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager, redirect_stderr, redirect_stdout
from typing import TextIO


class _Both:
    def __init__(self, *to: TextIO):
        self.to = to

    def write(self, text: str) -> int:
        for t in self.to:
            t.write(text)
        return len(text)

    def flush(self) -> None:
        for t in self.to:
            t.flush()


@contextmanager
def logged(path: str, echo: bool = False) -> Iterator[None]:
    """What the driver prints goes to the end of a file on the driver, and with echo to the screen too."""
    with open(path, "a", encoding="utf-8") as log:
        out, err = (_Both(sys.stdout, log), _Both(sys.stderr, log)) if echo else (log, log)
        with redirect_stdout(out), redirect_stderr(err):
            yield
