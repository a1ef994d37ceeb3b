"""Posture expressions on an array of 17 keypoints struct(x, y, c) in COCO order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 1-based places of the joints.
WRIST = {"L": 10, "R": 11}
HIP = {"L": 12, "R": 13}
KNEE = {"L": 14, "R": 15}


def joint(kp: Column, at: int) -> Column:
    return F.element_at(kp, at)


def seen(kp: Column, at: int, least: float) -> Column:
    return joint(kp, at)["c"] >= least


def side_standing(kp: Column, side: str, least: float) -> Column:
    hip, knee = HIP[side], KNEE[side]
    return seen(kp, hip, least) & seen(kp, knee, least) & (joint(kp, hip)["y"] < joint(kp, knee)["y"])


def standing_sides(kp: Column, least: float) -> Column:
    return F.concat_ws(",", *[F.when(side_standing(kp, s, least), F.lit(s)) for s in "LR"])


def wrist_groin(kp: Column, least: float) -> Column:
    """Smallest vertical way of a visible wrist to the middle of the hips, or to its own hip if one is visible; 1e9 if none."""
    y = lambda at: joint(kp, at)["y"]
    left, right = seen(kp, HIP["L"], least), seen(kp, HIP["R"], least)
    middle = (y(HIP["L"]) + y(HIP["R"])) * 0.5
    far = F.lit(1e9)
    both = F.least(*[F.when(seen(kp, WRIST[s], least), F.abs(y(WRIST[s]) - middle)).otherwise(far) for s in "LR"], far)
    own = lambda s: F.when(seen(kp, WRIST[s], least), F.abs(y(WRIST[s]) - y(HIP[s])))
    return (
        F.when(left & right, both)
        .when(left & seen(kp, WRIST["L"], least), own("L"))
        .when(right & seen(kp, WRIST["R"], least), own("R"))
        .otherwise(far)
    )


def posture_cue(kp: Column, least: float, limit: float) -> Column:
    standing = side_standing(kp, "L", least) | side_standing(kp, "R", least)
    return F.coalesce(standing & (wrist_groin(kp, least) < limit), F.lit(False))


def hip_hand_px(kp: Column, side: str, least: float) -> Column:
    """Pixels between hip and wrist of one side; null unless both are visible."""
    hip, wrist = joint(kp, HIP[side]), joint(kp, WRIST[side])
    return F.when(seen(kp, HIP[side], least) & seen(kp, WRIST[side], least), F.hypot(wrist["x"] - hip["x"], wrist["y"] - hip["y"]))


def keypoints_to_frame(kp: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    w, h = F.greatest(F.lit(1.0), x2 - x1), F.greatest(F.lit(1.0), y2 - y1)
    return F.transform(kp, lambda p: F.struct((x1 + p["x"] * w).alias("x"), (y1 + p["y"] * h).alias("y"), p["c"].alias("c")))
