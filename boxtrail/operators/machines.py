"""The time rule and the plate reading one sample at a time: state for streams, and a restatement for tests."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from boxtrail.operators.tracking import overlap
from boxtrail.settings import DEFAULT, Settings


def still(a: tuple, b: tuple, s: Settings) -> bool:
    """The stillness test of two boxes, written out in numbers: a stream asks it for every sample."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = a, b
    w, h = (ax2 if ax2 < bx2 else bx2) - (ax1 if ax1 > bx1 else bx1), (ay2 if ay2 < by2 else by2) - (ay1 if ay1 > by1 else by1)
    if w <= 0 or h <= 0:
        return s.still_iou <= 0 and _near(a, b, s)
    shared, aw, ah, bw, bh = w * h, ax2 - ax1, ay2 - ay1, bx2 - bx1, by2 - by1  # boxes that share an area have sides
    return shared / (aw * ah + bw * bh - shared) >= s.still_iou and _near(a, b, s)


def _near(a: tuple, b: tuple, s: Settings) -> bool:
    """Whether a box stayed in its place and of its size."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = a, b
    height = max(1e-6, ay2 - ay1)
    if math.hypot((bx1 + bx2 - ax1 - ax2) / 2, (by1 + by2 - ay1 - ay2) / 2) / height > s.still_motion:
        return False
    was = max(1e-6, ax2 - ax1) * height
    return abs(max(1e-6, bx2 - bx1) * max(1e-6, by2 - by1) - was) / was <= s.still_size


@dataclass
class PersonState:
    """What a track carries from sample to sample."""

    box: tuple
    frame: int
    run_start: int
    second: int
    hits: int = 0
    streak: int = 0
    last_good: int = -2
    confirmed: int = -1

    def see(self, box: tuple, hit: bool, frame: int, fps: float, s: Settings) -> None:
        moved = not still(self.box, tuple(box), s)
        if moved:  # before the open second is closed, so it wipes the second just finished
            self.run_start, self.hits, self.streak, self.last_good = frame, 0, 0, -2
        second = math.floor(frame / fps + 1e-9)
        if second != self.second:
            if self.hits >= s.hits_per_second:
                self.streak = self.streak + 1 if self.last_good == self.second - 1 else 1
                self.last_good = self.second
                if self.streak >= s.seconds_required and self.confirmed < 0:
                    self.confirmed = frame
            else:
                self.streak, self.last_good = 0, -2
            self.second, self.hits = second, 0
        if hit and not moved and frame - self.run_start >= s.still_seconds * fps:
            self.hits += 1
        self.box, self.frame = tuple(box), frame


@dataclass
class IncidentState:
    """All tracks of a clip, and since when it is active."""

    fps: float = 8.0
    tracks: dict[int, PersonState] = field(default_factory=dict)
    since: int = -1
    until: int = -1

    def frame(self, frame: int, rows: list[tuple[int, tuple, bool]], s: Settings = DEFAULT) -> list[tuple[str, int]]:
        """Events up to a sampled frame with its (track, box, hit) rows. One that confirms again in the frame that ends an interval goes on with it."""
        out = self.settle(frame - 1)
        self.tracks = {k: t for k, t in self.tracks.items() if frame - t.frame <= s.max_missed * self.fps}
        for track, box, hit in rows:
            t = self.tracks.get(track)
            if t is None:
                self.tracks[track] = t = PersonState(tuple(box), frame, frame, math.floor(frame / self.fps + 1e-9))
            else:
                t.see(box, hit, frame, self.fps, s)
            if t.confirmed >= 0:
                if self.since < 0:
                    self.since = frame
                    out.append(("enter", frame))
                self.until = max(self.until, frame + int(s.max_missed * self.fps) + 1)
        return out + self.settle(frame)

    def settle(self, frame: int) -> list[tuple[str, int]]:
        """An exit that a frame at or past the end of all confirmed tracks brings."""
        if self.since >= 0 and frame >= self.until:
            out = [("exit", self.until)]
            self.since = self.until = -1
            return out
        return []

    def end(self, total_frames: int) -> list[tuple[str, int]]:
        """What the end of the clip brings: an exit before it, or an interval that stays open."""
        if self.since < 0:
            return []
        done = ("exit", self.until) if self.until < total_frames else ("open", total_frames - 1)
        self.since = self.until = -1
        return [done]


@dataclass
class PlateState:
    """Text, lock and cadence of one vehicle."""

    text: str = ""
    confidence: float = 0.0
    locked: bool = False
    place: tuple | None = None
    last: int | None = None

    def near(self, box: tuple) -> bool:
        if self.place is None:
            return False
        a, b = self.place, box
        if overlap(a, b) >= 0.15:
            return True
        most = 0.75 * max(8.0, a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1])
        return all(abs((a[k] + a[k + 2]) - (b[k] + b[k + 2])) / 2 <= most for k in (0, 1))

    def see(self, frame: int, said: str, dashed: bool, score: float, box: tuple, s: Settings = DEFAULT) -> str:
        """skip, keep or read."""
        if self.last is not None and frame - self.last < (s.plate_lock_stride if self.locked else s.plate_stride):
            return "skip"
        self.last = frame
        if self.locked and self.text and self.confidence >= s.lock_confidence and self.near(box):
            self.place = box
            return "keep"
        if said and score >= s.text_confidence and score >= self.confidence:
            self.text, self.confidence = said, float(score)
            self.locked = self.locked or (self.confidence >= s.lock_confidence and dashed)
        self.place = box
        return "read"
