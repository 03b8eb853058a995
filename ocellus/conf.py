"""Options of the library, by dotted name."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

#: The options and their defaults.
DEFAULTS = {
    "cache_uri": "file:///tmp/ocellus-cache",
    "block_size": 32 * 1024 * 1024,
    "image.default_format": "PNG",
    "http.agent": "ocellus",
    "viz.color": "red",
    "predict.batch_size": 4,
}
_values: dict[str, object] = dict(DEFAULTS)


def get_option(name: str) -> object:
    if name not in _values:
        raise KeyError(f"no option {name!r}; there are {', '.join(sorted(_values))}")
    return _values[name]


def set_option(name: str, value: object) -> None:
    get_option(name)
    _values[name] = value


def reset_option(name: str) -> None:
    get_option(name)
    _values[name] = DEFAULTS[name]


@contextmanager
def option_context(**options: object) -> Iterator[None]:
    """Sets options for a block; ``__`` in a keyword stands for a dot."""
    before = dict(_values)
    try:
        for name, value in options.items():
            set_option(name.replace("__", "."), value)
        yield
    finally:
        _values.clear()
        _values.update(before)
