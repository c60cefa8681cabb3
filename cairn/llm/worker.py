"""What a Python worker remembers between tasks: one object at a time, so that stages do not add up their memory."""

from __future__ import annotations

import ctypes
import gc
import sys
from contextlib import contextmanager

_held: tuple[object, object] | None = None


def keep(key, make):
    """The object remembered for key; made anew, and any other one dropped, if key is not the last one asked for."""
    global _held
    if _held is None or _held[0] != key:
        had, _held = _held is not None and _held[1] is not None, None
        if had:
            give_back()
        _held = (key, make())
    return _held[1]


def forget() -> None:
    """Drops what an earlier stage remembered; for stages that remember nothing."""
    keep("", lambda: None)


def give_back() -> None:
    """Collects garbage and returns free memory to the system."""
    gc.collect()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


@contextmanager
def no_collection():
    """No search for garbage meanwhile: making very many objects that stay would start it over and over."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Recent:
    """A dict that forgets: when its newer part is full, the older part goes. What is asked for moves to the newer part."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most // 2, {}, {}

    def missing(self, keys) -> list:
        """Keys, each once, that neither part has; all others are in the newer part from now on."""
        new, old, out = self.new, self.old, []
        for k in dict.fromkeys(k for k in keys if k not in new):
            found = old.get(k)
            if found is None:
                out.append(k)
            else:
                new[k] = found
        return out

    def age(self) -> None:
        """Drops the older part if the newer one is full; between batches, so that none loses what it found."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
