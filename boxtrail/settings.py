"""Limits of all operators. Fixed values; they must equal the defaults that results are compared with."""

from dataclasses import dataclass

PERSON = ("person",)
VEHICLES = ("car", "truck", "bus", "motorcycle", "motorbike", "vehicle")
MOTORCYCLES = ("motorcycle", "motorbike")
CLIP_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v")


@dataclass(frozen=True)
class Settings:
    fps_min: float = 5.0
    fps_max: float = 60.0
    target_rate: float = 4.0
    scene_confidence: float = 0.4
    plate_confidence: float = 0.25
    text_confidence: float = 0.5
    lock_confidence: float = 0.90
    plate_stride: int = 5
    plate_lock_stride: int = 20
    crop_margin: float = 0.12
    min_side: int = 12
    min_sharpness: float = 30.0
    every_nth: int = 2
    batch: int = 8
    visibility: float = 0.45
    wrist_limit: float = 0.09
    seconds_required: int = 10
    hits_per_second: int = 3
    person_iou: float = 0.35
    vehicle_iou: float = 0.3
    max_missed: float = 3.0
    still_seconds: float = 1.0
    still_iou: float = 0.65
    still_motion: float = 0.08
    still_size: float = 0.20
    bike_x: float = 0.15
    bike_y: float = 0.10
    bike_lower: float = 0.60
    bike_overlap: float = 0.10


DEFAULT = Settings()
