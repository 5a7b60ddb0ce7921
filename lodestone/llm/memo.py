"""What Python workers remember between tasks: one operator's at a time."""

from __future__ import annotations

from collections.abc import Callable

_clear: dict[str, Callable[[], object]] = {}
_last = ""


def register(name: str, clear: Callable[[], object]) -> None:
    _clear[name] = clear


def use(name: str) -> None:
    """Called when an operator begins a task: what others remember is let go."""
    global _last
    if name != _last:
        for other, clear in _clear.items():
            if other != name:
                clear()
        _last = name
