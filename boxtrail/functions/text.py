"""Text and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a truth column, class names that stand for none.
YES = ("1", "true", "yes", "y", "peeing", "positive", "pos")
NO = ("0", "false", "no", "n", "negative", "neg", "none")
NO_CLASS = ("", "0", "_background", "background", "__background__", "bg", "n/a", "na")


def plate_text(raw: Column) -> Column:
    """Runs of other characters than ASCII letters and digits as one dash, none at the ends; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), "[^0-9A-Za-z]+", "-"), "^-|-$", "")


def inner_dash(text: Column) -> Column:
    t = F.trim(text)
    return (F.length(t) >= 3) & F.contains(F.substring(t, F.lit(2), F.length(t) - 2), F.lit("-"))


def _fixed(x: Column, digits: int) -> Column:
    """For formatting: a value halfway between two texts goes to the even one."""
    return F.bround(x, digits)


def plate_label(text: Column, confidence: Column, now: Column, plate: Column, least: float) -> Column:
    return (
        F.when(text != "", F.format_string("%s %.2f", text, _fixed(confidence, 2)))
        .when(now >= least, F.format_string("%.2f", _fixed(now, 2)))
        .otherwise(F.format_string("LP %.2f", _fixed(plate, 2)))
    )


def clock_text(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0.0))
    m = F.floor(s / 60).cast("int")
    return F.when(m == 0, F.format_string("%.2fs", _fixed(s % 60, 2))).otherwise(F.format_string("%dm %.2fs", m, _fixed(s % 60, 2)))


def video_time(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0.0))
    h, m = F.floor(s / 3600).cast("int"), F.floor((s % 3600) / 60).cast("int")
    return F.when(h > 0, F.format_string("%d:%02d:%06.3f", h, m, _fixed(s % 60, 3))).otherwise(F.format_string("%d:%06.3f", m, _fixed(s % 60, 3)))


def parse_bool(raw: Column) -> Column:
    word = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return (
        F.when(word.isin(*YES), F.lit(True))
        .when(word.isin(*NO), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("expected yes or no, got "), word)).cast("boolean"))
    )


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(base_name(name), r"(?<=.)\.[^.]*$", "")


def clip_tag(name: Column) -> Column:
    return F.regexp_extract(F.upper(stem(name)), "^(FN|FP|TP)", 1)


def outcome(truth: Column, predicted: Column) -> Column:
    return F.when(truth & predicted, "TP").when(truth, "FN").when(predicted, "FP").otherwise("TN")


#: The sentence of an evaluation row by result and tag (empty: any other tag); {} is what a clip should give.
NOTES = (
    ("TP", "FN", "Prod miss ({}); model detected — fixed"),
    ("TP", "TP", "Prod hit ({}); model detected — OK"),
    ("TP", "", "{}; model detected — OK"),
    ("FN", "FN", "Prod miss/hit ({}); model missed — still wrong"),
    ("FN", "TP", "Prod miss/hit ({}); model missed — still wrong"),
    ("FN", "", "{}; model missed"),
    ("FP", "", "{}; model fired — false alarm"),
    ("TN", "", "{}; model silent — OK"),
)
SHOULD = {True: "should detect peeing", False: "should NOT detect peeing"}


def outcome_note(result: Column, tag: Column, truth: Column) -> Column:
    """A plain sentence for an evaluation row, looked up by result and tag."""
    known = F.create_map(*[F.lit(x) for r, t, said in NOTES for x in (f"{r}/{t}", said)])
    said = F.coalesce(F.try_element_at(known, F.concat_ws("/", result, tag)), F.try_element_at(known, F.concat(result, F.lit("/"))))
    return F.replace(said, F.lit("{}"), F.when(truth, SHOULD[True]).otherwise(SHOULD[False]))


def near(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return F.abs(a - b) <= eps


def boxes_json(boxes: Column) -> Column:
    """A list of [x1, y1, x2, y2] as JSON text."""
    return F.to_json(F.transform(boxes, lambda b: F.array(b["x1"], b["y1"], b["x2"], b["y2"])))


def display_status(confirmed: Column, good_seconds: Column, ready: Column) -> Column:
    return (
        F.when(confirmed, "CONFIRMED")
        .when((good_seconds > 0) & ready, F.concat(F.lit("suspect "), good_seconds.cast("string"), F.lit("s")))
        .otherwise("person")
    )


def head_label(class_label: Column, name: Column, default: Column | str) -> Column:
    """A mapped class, else the class name unless it stands for none, else the head's default."""
    given = F.trim(F.coalesce(name, F.lit("")))
    return F.coalesce(class_label, F.when(~F.lower(given).isin(*NO_CLASS), given), F.lit(default) if isinstance(default, str) else default)


def litter_class(label: Column) -> Column:
    return F.when(F.contains(F.lower(label), F.lit("cigarette")), 1).otherwise(0)


def output_path(path: Column, root: str, out_root: str, suffix: str) -> Column:
    """<out_root>/<relative folder>/<stem><suffix><extension>."""
    inner = F.regexp_replace(path, "^" + root.rstrip("/") + "/", "")
    return F.concat(F.lit(out_root.rstrip("/") + "/"), F.regexp_replace(inner, r"(\.[^./]*)$", suffix + "$1"))
