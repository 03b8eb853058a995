"""Videos and their segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import TypeVar

V = TypeVar("V")


@dataclass(frozen=True)
class Segment:
    """Frames from ``start_fno`` to before ``end_fno``; a negative end is the video's end."""

    start_fno: int
    end_fno: int

    def __post_init__(self) -> None:
        if self.start_fno < 0:
            raise ValueError("a segment begins at frame 0 or later")
        if 0 <= self.end_fno < self.start_fno:
            raise ValueError("a segment ends where it begins or later")


@dataclass(frozen=True)
class VideoStream:
    uri: str


@dataclass(frozen=True)
class YouTubeVideo:
    vid: str

    @property
    def uri(self) -> str:
        return f"https://www.youtube.com/watch?v={self.vid}"

    @staticmethod
    def pick(streams: Iterable[tuple[int, V]], quality: str = "worst") -> V:
        """The stream of the lowest or highest resolution among (resolution, stream)."""
        if quality not in ("worst", "best"):
            raise ValueError("quality is worst or best")
        return (min if quality == "worst" else max)(streams, key=lambda s: s[0])[1]


def sample(frames: Iterable[V], start: int = 0, rate: int = 1, most: int = -1) -> Iterator[V]:
    """One of every ``rate`` frames from ``start`` on, at most ``most`` of them unless negative."""
    if most == 0:
        return
    given = 0
    for number, frame in enumerate(frames):
        if number < start or (number - start) % rate:
            continue
        yield frame
        given += 1
        if given == most:
            return
