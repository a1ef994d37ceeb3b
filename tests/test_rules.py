"""Unit cases, sequential restatements on random clips, and sources and sinks."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxtrail.functions import geometry as g
from boxtrail.functions import pose
from boxtrail.functions import text as t
from boxtrail.operators import components, evaluation, incidents, machines, plates, runs, sampling, scoring, tracking
from boxtrail.plans import catalog
from boxtrail.settings import DEFAULT, Settings
from boxtrail.sources import clips as src
from boxtrail.sources.fixtures import RATES

SF = "/root/testdata/sf0.001"


def box_rows(spark, rows, columns="a_x1 double, a_y1 double, a_x2 double, a_y2 double, b_x1 double, b_y1 double, b_x2 double, b_y2 double"):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], columns)


def test_rider_cases(spark):
    bike = (40, 300, 200, 400)
    persons = {"rider": (50, 150, 180, 350), "far": (400, 100, 480, 360), "beside": (210, 50, 280, 380), "above": (60, 50, 170, 220)}
    p = spark.createDataFrame([(1, 0, k, n, *map(float, b)) for k, (n, b) in enumerate(persons.items())], "video_id long, frame_idx long, ord int, name string, x1 double, y1 double, x2 double, y2 double")
    m = spark.createDataFrame([(1, 0, *map(float, bike))], "video_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double")
    assert {r.name for r in sampling.rider_exclusion(p, m).collect()} == {"far", "beside", "above"}
    assert sampling.rider_exclusion(p, m.limit(0)).count() == 4


def test_still_pair(spark):
    rows = [(100, 100, 200, 300, 101, 101, 199, 299), (100, 100, 200, 300, 150, 100, 250, 300)]
    df = box_rows(spark, rows)
    assert [r[0] for r in df.select(g.is_still(g.box("a_"), g.box("b_"), 0.65, 0.035, 0.12)).collect()] == [True, False]


def keypoints(**at):
    names = {"lw": 9, "rw": 10, "lh": 11, "rh": 12, "lk": 13, "rk": 14}
    kp = [(0.5, 0.5, 0.0)] * 17
    for n, y in at.items():
        kp[names[n]] = (0.5, y, 0.9)
    return kp


def test_pose_cases(spark):
    cases = [
        (keypoints(lh=0.5, lk=0.8), "L", 1e9),
        (keypoints(rh=0.5, rk=0.8), "R", 1e9),
        (keypoints(lh=0.5), "", 1e9),
        (keypoints(lh=0.8, lk=0.5), "", 1e9),
        (keypoints(lh=0.5, lw=0.52), "", 0.02),
        (keypoints(lh=0.5, rw=0.5), "", 1e9),
        (keypoints(lw=0.5, rw=0.5), "", 1e9),
        (keypoints(lh=0.4, rh=0.6, lw=0.9, rw=0.53, lk=0.9, rk=0.9), "L,R", 0.03),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, kp array<struct<x:double,y:double,c:double>>")
    kp = F.col("kp")
    got = df.orderBy("k").select(pose.standing_sides(kp, 0.45), pose.wrist_groin(kp, 0.45), pose.posture_cue(kp, 0.45, 0.09)).collect()
    for (_, sides, dist), r in zip(cases, got, strict=True):
        assert r[0] == sides and r[1] == pytest.approx(dist) and r[2] == (sides != "" and dist < 0.09)


def random_clip(rng, video):
    rows = []
    fps, stride = RATES[video % len(RATES)]
    long = int(3 * fps) // stride * stride  # the last sample at which a track still lives
    for track in range(rng.randrange(1, 4)):
        x, y, frame = rng.uniform(0, 800), rng.uniform(0, 400), rng.randrange(0, 60) * stride
        for _ in range(rng.randrange(1, 200)):
            if rng.random() < 0.03:
                x += rng.uniform(-80, 80)
            if rng.random() < 0.02:
                frame += rng.choice([stride, 2 * stride, long - stride, long, long + stride])
            rows.append((video, track, frame, fps, x, y, x + 60, y + 150, rng.random() < 0.9))
            frame += stride
    return rows


@pytest.mark.parametrize("s", [DEFAULT, Settings(seconds_required=2), Settings(seconds_required=3, hits_per_second=2, still_seconds=0.5)])
def test_time_rule_restated(spark, s):
    """The set form against one pass over the samples."""
    rng = random.Random(11)
    clips = {v: random_clip(rng, v) for v in range(60)}
    total = {v: max(r[2] for r in rows) + 1 + rng.randrange(40) for v, rows in clips.items()}
    df = spark.createDataFrame([r for rows in clips.values() for r in rows], "video_id long, track_id long, frame_idx long, fps double, x1 double, y1 double, x2 double, y2 double, hit boolean")
    info = spark.createDataFrame([(v, RATES[v % 5][0], n) for v, n in total.items()], "video_id long, fps double, total_frames long")
    got = {}
    # tracks end after 3 s unseen; a later sample of the number is another track
    df = df.withColumn("gap", F.expr("coalesce(frame_idx - lag(frame_idx) over (partition by video_id, track_id order by frame_idx) > 3 * fps, false)"))
    df = df.withColumn("track_id", F.expr("track_id * 1000 + sum(cast(gap as int)) over (partition by video_id, track_id order by frame_idx)")).drop("gap")
    for r in incidents.incident_intervals(incidents.time_rule(df, s)[2], info).collect():
        got.setdefault(r.video_id, []).append((r.start_frame, r.end_frame, r.open_interval))
    found = 0
    for v, rows in clips.items():
        state, events = machines.IncidentState(RATES[v % 5][0]), []
        for frame in sorted({r[2] for r in rows}):
            events += state.frame(frame, [(r[1], r[4:8], r[8]) for r in rows if r[2] == frame], s)
        events += state.end(total[v])
        want, start = [], None
        for kind, frame in events:
            if kind == "enter":
                start = frame
            else:
                want.append((start, frame, kind == "open"))
        assert sorted(got.get(v, [])) == want, v
        found += len(want)
    assert found > 5


def test_touching_intervals(spark):
    """A track that is confirmed in the very frame in which another's time ends: one interval, in sets and frame by frame."""
    s, box = Settings(seconds_required=2), (0.0, 0.0, 60.0, 150.0)
    first = [(1, 1, f, 5.0, *box, True) for f in range(0, 25)]  # ends with frame 24 + 16
    second = [(1, 2, f, 5.0, 300.0, 0.0, 360.0, 150.0, f < 41) for f in range(25, 60)]
    df = spark.createDataFrame(first + second, "video_id long, track_id long, frame_idx long, fps double, x1 double, y1 double, x2 double, y2 double, hit boolean")
    info = spark.createDataFrame([(1, 5.0, 100)], "video_id long, fps double, total_frames long")
    ranges = incidents.time_rule(df, s)[2].orderBy("track_id").collect()
    assert [r.expiry_frame for r in ranges][:1] == [40] and ranges[1].confirm_frame == 40
    assert [(r.start_frame, r.end_frame) for r in incidents.incident_intervals(incidents.time_rule(df, s)[2], info).collect()] == [(15, 75)]
    state, events = machines.IncidentState(5.0), []
    for f in range(60):
        events += state.frame(f, [(r[1], r[4:8], r[8]) for r in first + second if r[2] == f], s)
    assert events + state.end(100) == [("enter", 15), ("exit", 75)]


def shared(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h) if w > 0 and h > 0 else 0.0


def one_pass(rows, vehicles, most=24):
    """Association without segments, restated box by box: tracks are [number, box, frame], oldest first."""
    tracks, number, out = [], 0, {}
    for frame in sorted({r[1] for r in rows}):
        now = [r for r in rows if r[1] == frame]
        now.sort(key=(lambda r: r[2]) if vehicles else (lambda r: (-r[3], r[2])))
        if not vehicles:
            tracks = [t for t in tracks if frame - t[2] <= most]
        used, seen = set(), set()
        for r in now:
            best = None
            for t in tracks:
                o = shared(t[1], r[4:8])
                if t[0] not in used and o > 0 and (best is None or o > best[0]):
                    best = o, t
            if best and best[0] >= (0.3 if vehicles else 0.35):
                t = best[1]
                used.add(t[0])
                t[1:] = [r[4:8], frame]
            else:
                tracks.append(t := [number, r[4:8], frame])
                number += 1
            seen.add(t[0])
            out[r[0], frame, r[2]] = t[0]
        if vehicles:
            tracks = [t for t in tracks if t[0] in seen]
    return out


@pytest.mark.parametrize("vehicles", [False, True])
def test_association_segments(spark, vehicles):
    rng = random.Random(7)
    rows = []
    for v in range(40):
        fps, stride = RATES[v % 5]
        for at in range(100):
            frame = at * stride
            if rng.random() < 0.25 or 30 < at < 30 + 6 * (v // 5):
                continue
            for k in range(rng.randrange(1, 5)):
                x, y = rng.randrange(6) * 40 + rng.uniform(-9, 9), rng.randrange(3) * 60 + rng.uniform(-9, 9)
                rows.append((v, frame, k, round(rng.random(), 1), x, y, x + 70, y + 90, fps, stride))
    df = spark.createDataFrame(rows, "video_id long, frame_idx long, ord int, confidence double, x1 double, y1 double, x2 double, y2 double, fps double, stride int")
    got = tracking.associate_vehicles(df) if vehicles else tracking.associate_persons(df)
    pairs, back = {}, {}
    seq = {}
    for v in range(40):
        own = [r for r in rows if r[0] == v]
        if vehicles:  # an empty sample clears the tracks
            cut, part = [], []
            frames = sorted({r[1] for r in own})
            for a, b in zip(frames, [*frames[1:], None], strict=True):
                part.append(a)
                if b is None or b - a > RATES[v % 5][1]:
                    cut.append(part)
                    part = []
            for n, part in enumerate(cut):
                seq.update({k: (v, n, i) for k, i in one_pass([r for r in own if r[1] in part], True).items()})
        else:
            seq.update({k: (v, i) for k, i in one_pass(own, False, 3 * RATES[v % 5][0]).items()})
    for r in got.collect():
        a, b = (r.video_id, r.segment, r.track_id), seq[r.video_id, r.frame_idx, r.ord]
        assert pairs.setdefault(a, b) == b and back.setdefault(b, a) == a
    assert len(pairs) > 100


def test_components(spark):
    rng = random.Random(4)
    for n, m in ((30, 20), (60, 80), (200, 199)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m != 199 else [(k, k + 1) for k in range(m)]
        first = list(range(n))
        for _ in range(n):
            for a, b in edges:
                first[a] = first[b] = min(first[a], first[b])
        got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {k: first[k] for a, b in edges if a != b for k in (a, b)}


@pytest.mark.parametrize("vehicles", [False, True])
def test_long_segments_by_components(spark, monkeypatch, vehicles):
    """A camera that is never quiet, walked by components: the tracks of one pass, in many parts."""
    monkeypatch.setattr(tracking, "LONG", 150)
    monkeypatch.setattr(tracking, "BUCKET", 100)
    rng, rows = random.Random(5), []
    for v in range(5):
        fps, stride = RATES[v]
        for at in range(150):
            for k, (x, y) in enumerate(rng.sample([(x * 90, y * 100) for x in range(6) for y in range(4)], 7)):
                x, y = x + rng.uniform(-30, 30), y + rng.uniform(-30, 30)
                rows.append((v, at * stride, k, round(rng.random(), 1), x, y, x + 70, y + 90, fps, stride))
    df = spark.createDataFrame(rows, "video_id long, frame_idx long, ord int, confidence double, x1 double, y1 double, x2 double, y2 double, fps double, stride int")
    got = (tracking.associate_vehicles(df) if vehicles else tracking.associate_persons(df)).collect()
    assert len(got) == len(rows)
    pairs, back = {}, {}
    for v in range(5):
        own = one_pass([r for r in rows if r[0] == v], vehicles, 3 * RATES[v][0])
        for r in got:
            if r.video_id == v:
                a, b = (v, r.segment, r.track_id), (v, own[v, r.frame_idx, r.ord])
                assert pairs.setdefault(a, b) == b and back.setdefault(b, a) == a
    least = DEFAULT.vehicle_iou if vehicles else DEFAULT.person_iou
    most = F.col("stride").cast("double") if vehicles else F.col("fps") * 3
    parts = tracking._parts(df.filter("video_id = 4").withColumns({"segment": F.lit(0).cast("long"), "most": most}), least)
    assert parts.select(*tracking.PART).distinct().count() > 10
    assert parts.select((F.col("frame_idx") - F.col("part_frame")).alias("d")).agg(F.max("d")).first()[0] > 100 or vehicles  # over buckets


def test_stream_tracks_equal_batch(spark):
    """Tracks of the stream are those of the batch up to their numbers; riders are not excluded in the stream's input."""
    from boxtrail.plans import streams
    from boxtrail.plans.registry import Tables

    d = Tables(spark, SF)
    batch = {(r.video_id, r.frame_idx, r.ord): (r.video_id, r.segment, r.track_id) for r in tracking.associate_persons(streams.persons(d)).collect()}
    seen, back = {}, {}
    rows = catalog.queries()["stream_tracks"](spark, SF).collect()
    assert len(rows) == len(batch)
    for r in rows:
        a, b = batch[r.video_id, r.frame_idx, r.ord], (r.video_id, r.track_id)
        assert seen.setdefault(a, b) == b and back.setdefault(b, a) == a


def test_windows_of_many_files_come_whole(spark, tmp_path):
    """A window of several files is one trigger, so none of its rows is late; windows with less rows have empty files."""
    from boxtrail.streaming import detections as st

    rows = [(v, f, 4.0) for v in range(40) for f in range(128)] + [(-1, 4000, 4.0)]
    df = spark.createDataFrame(rows, "video_id long, frame_idx long, fps double").repartition(8)
    path = f"file://{tmp_path}/windows"
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        files = st.write_windows(df, path, 16, 500) or 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = st.run_to_end(st.session_gaps(st.stream_rows(spark, path, df.schema, files=files))).collect()
    assert sorted(map(tuple, got)) == [(v, 0, 127, 128) for v in range(40)]
    assert files == 6 and len(spark.read.schema(df.schema).parquet(path).inputFiles()) == 3 * files


def test_stream_plates_equal_batch(spark):
    key = ["video_id", "track_id", "frame_idx", "action"]
    one = catalog.queries()["stream_plates"](spark, SF).select(*key)
    other = catalog.queries()["plate_cadence"](spark, SF).select(*key)
    assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


SAMPLES = "video_id long, track_id long, frame_idx long, fps double, x1 double, y1 double, x2 double, y2 double, hit boolean, label string"


def test_exit_without_a_following_row(spark):
    """A camera that goes quiet gets its exit from the timer, once other cameras of other rates move the watermark on; a row past frame 511 counts."""
    from boxtrail.streaming import detections as st

    rows = [(1, 7, f, 8.0, 0.0, 0.0, 60.0, 150.0, True, "person") for f in range(0, 240, 2)] + [(2, 1, f, 25.0, 9.0, 9.0, 69.0, 159.0, False, "person") for f in range(0, 2800, 6)]
    df = spark.createDataFrame(rows, SAMPLES)
    path = src.scratch(spark, "quiet")
    st.write_windows(df, path, 16)
    assert spark.read.parquet(path).count() == len(rows)
    got = st.run_to_end(st.stream_alerts(st.stream_rows(spark, path, df.schema))).collect()
    assert sorted((r.video_id, r.event, r.frame_idx) for r in got) == [(1, "enter", 88), (1, "exit", 238 + 25)]


def test_sweep_walks_boxes_once(spark):
    """Boxes are associated once for all grid points and for the ends of tracks."""
    plan = catalog.queries()["sweep_job_tracked"](spark, SF)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("MapInArrow") == 1


def test_state_partitions_grow_with_rows(spark):
    """A replay has state for its rows, not for the session's number of partitions, which stays as it was; commits write changes."""
    from boxtrail.streaming import detections as st

    assert st.state_partitions(spark, 10) == 4 and st.state_partitions(spark, 50 * st.STATE_ROWS + 1) == 51
    df = spark.createDataFrame([(v, f, 4.0) for v in range(9) for f in range(64)], "video_id long, frame_idx long, fps double")
    path, log = src.scratch(spark, "few"), src.scratch(spark, "few-log")
    st.write_windows(df, path, 16)
    st.run_to_end(st.session_gaps(st.stream_rows(spark, path, df.schema)), path=log, partitions=3)
    assert len([k for k in os.listdir(f"{log.removeprefix('file:').replace('///', '/')}/log/state/0") if k.isdigit()]) == 3
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled") == "true"


def test_state_by_track_and_restart(spark):
    """A batch that touches one track writes that one's entry, and a restart from the checkpoint goes on as if there had been none."""
    from boxtrail.streaming import detections as st

    person = lambda k, f: (1, f, 8.0, k, "person", 0.9 - k / 100, 200.0 * k, 0.0, 200.0 * k + 60, 150.0)
    parts = [[person(k, f) for f in range(0, 16, 2) for k in range(20)], [person(3, f) for f in range(16, 24, 2)], [person(k, 24) for k in range(4, 20)]]
    columns = "video_id long, frame_idx long, fps double, ord int, label string, confidence double, x1 double, y1 double, x2 double, y2 double"
    path, log = src.scratch(spark, "parts"), src.scratch(spark, "log")
    updated = []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.STATE_STORE)
    for k, part in enumerate(parts):  # a query of its own for each, on one checkpoint
        spark.createDataFrame(part, columns).coalesce(1).write.mode("append").parquet(path)
        stream = st.stream_tracks(st.stream_rows(spark, path, spark.createDataFrame(part, columns).schema))
        q = stream.writeStream.format("parquet").option("path", f"{log}/out").option("checkpointLocation", f"{log}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        updated.append(sum(o["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"] for o in p["stateOperators"]))
    got = {(r.frame_idx, r.ord): r.track_id for r in spark.read.parquet(f"{log}/out").collect()}
    assert got == {(f, k): k for part in parts for _, f, _, k, *_ in part}  # each keeps its track through both restarts
    assert updated[0] >= 20 and updated[2] >= 16 and updated[1] <= 4, updated


def test_long_clip(spark):
    """Range joins, edges and carried values over many spans and buckets of frames."""
    from boxtrail.operators import spread

    n = 40_000
    frames = spark.range(n).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame_idx"))
    ranges = spark.createDataFrame([(1, 0, 10, 2000), (1, 1, 1500, 30_000), (1, 2, 30_001, 30_010), (2, 0, 0, 99)], "video_id long, track_id long, confirm_frame long, expiry_frame long")
    active = incidents.frame_active(frames, ranges)
    assert active.count() == n and active.filter("active").count() == 30_000 - 10 + 9
    plan = active._jdf.queryExecution().toString()
    assert "_span" in plan.split("== Physical Plan ==")[1]
    found = [(r.frame_idx, r.enter) for r in incidents.edges(active).filter("enter or exit").orderBy("frame_idx").collect()]
    assert found == [(10, True), (30_000, False), (30_001, True), (30_010, False)]
    marks = frames.filter("frame_idx % 2 = 0")
    rows = spread.previous_frame(spread.running_sum(spread.carried(marks, F.when(F.col("frame_idx") % 20_000 == 6, F.col("frame_idx")), "held"), F.lit(1), "k"), "before")
    for r in rows.collect():
        assert r.k == r.frame_idx // 2 + 1 and r.before == (r.frame_idx - 2 if r.frame_idx else None)
        assert r.held == (None if r.frame_idx < 6 else 6 if r.frame_idx < 20_006 else 20_006)


def test_pose_and_unions(spark):
    p = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 2), (1, 2, 0, 1)], "video_id long, frame_idx long, ord int, rank int")
    lists = spark.createDataFrame([(1, 0, [True, None]), (1, 2, [True, True])], "video_id long, frame_idx long, hits array<boolean>")
    direct = spark.createDataFrame([(1, 0, 0, False), (1, 0, 1, False), (1, 2, 0, None)], "video_id long, frame_idx long, ord int, hit boolean")
    got = {(r.frame_idx, r.ord): r.pose for r in sampling.pose_join(p, lists, direct).collect()}
    assert got == {(0, 0): True, (0, 1): False, (2, 0): None}
    f = spark.createDataFrame([(1, 0, [[0.0, 0.0, 1.0, 1.0]], None, [[1.0, 1.0, 2.0, 2.0]], [0.5]), (1, 2, None, None, [[1.0, 1.0, 2.0, 2.0]], [0.7])], "video_id long, frame_idx long, person_boxes array<array<double>>, person_scores array<double>, bike_boxes array<array<double>>, bike_scores array<double>")
    assert sorted((r.frame_idx, r.ord, r.label, r.confidence) for r in sampling.union_person_bike(f).collect()) == [(0, 0, "person", 1.0), (0, 1, "motorcycle", 0.5), (2, 0, "motorcycle", 0.7)]


def test_scratch_needs_a_shared_folder():
    class Far:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://far:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        src.scratch(Far(), "x")


def test_plate_states(spark):
    b = (0.0, 0.0, 40.0, 14.0)
    far = (500.0, 500.0, 540.0, 514.0)
    p = machines.PlateState()
    steps = [(0, "AB", False, 0.95, b, "read"), (2, "AB-1", True, 0.99, b, "skip"), (6, "AB-1", True, 0.95, b, "read"), (12, "X-2", True, 0.99, b, "skip"), (26, "X-2", True, 0.99, b, "keep"), (46, "", False, 0.99, far, "read")]
    assert [p.see(*s[:5]) for s in steps] == [s[5] for s in steps]
    assert (p.text, p.confidence, p.locked) == ("AB-1", 0.95, True)


def test_text_cases(spark):
    df = spark.createDataFrame([(" a  b//1 ", 45.125, 3725.5), (None, -1.0, 59.9995), ("--", 192.5, 60.0)], "raw string, s double, v double")
    got = df.select(t.plate_text(F.col("raw")), t.clock_text(F.col("s")), t.video_time(F.col("v"))).collect()
    assert [r[0] for r in got] == ["a-b-1", "", ""]
    assert [r[1] for r in got] == [f"{45.125:.2f}s", "0.00s", "3m 12.50s"] and got[0][2] == "1:02:05.500"
    bad = spark.createDataFrame([("perhaps",)], "w string")
    with pytest.raises(Exception, match="expected yes or no"):
        bad.select(t.parse_bool(F.col("w"))).collect()


def test_clip_sources(spark, tmp_path):
    for name in ("b/FN1.mp4", "a.MOV", "TPx.avi", "fp2.mp4", "notes.txt", "c.webm"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = src.ordered_clips(src.scan_clips(spark, f"file://{tmp_path}"))
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["TPx.avi", "a.MOV", "FN1.mp4", "c.webm", "fp2.mp4"]
    assert {r.path.rsplit("/", 1)[1] for r in src.eval_clips(found).collect()} == {"FN1.mp4", "TPx.avi"}


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("File,Expected_Peeing\nx/a.mp4,yes\n,no\nb.mp4,NO\ny/a.mp4, neg\n")
    assert {r.video: r.truth for r in src.read_manifest(spark, f"file://{path}").collect()} == {"a.mp4": False, "b.mp4": False}
    with pytest.raises(ValueError):
        evaluation.parse_manifest(spark.createDataFrame([(1,)], "x int"))
    clips = spark.createDataFrame([("TP1.mp4",), ("fn2.mp4",), ("a.mp4",)], "video string")
    known = src.read_manifest(spark, f"file://{path}")
    assert {r.video: r.truth for r in evaluation.truth_join(clips, known).collect()} == {"TP1.mp4": True, "fn2.mp4": True, "a.mp4": False}
    with pytest.raises(Exception, match="no truth"):
        evaluation.truth_join(spark.createDataFrame([("zz.mp4",)], "video string"), known).collect()


def test_manifest_of_several_files(spark, tmp_path):
    """Lines count in the order of files and blocks, whatever their sizes."""
    (tmp_path / "m").mkdir()
    (tmp_path / "m/part-0.csv").write_text("video,label\na.mp4,yes\nb.mp4,no\n")
    (tmp_path / "m/part-1.csv").write_text("video,label\na.mp4,no\n" + "".join(f"c{k}.mp4,yes\n" for k in range(20_000)) + "b.mp4,yes\n")
    for size in ("64m", "16k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = {r.video: r.truth for r in src.read_manifest(spark, f"file://{tmp_path}/m").filter("video in ('a.mp4', 'b.mp4')").collect()}
        assert got == {"a.mp4": False, "b.mp4": True}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_clip_matrix_and_tags(spark):
    """Two clips of one name stay apart; a grid point that a clip lacks is null; a tag's lines come sorted."""
    grid = [(0.05, "TP"), (0.08, "FN")]
    rows = [("x/TPa.mp4", "TPa.mp4", t, 3, r, "TP") for t, r in grid] + [("y/TPa.mp4", "TPa.mp4", 0.05, 3, "FN", "TP"), ("x/FPb.mp4", "FPb.mp4", 0.08, 5, "TN", "FP")]
    df = spark.createDataFrame(rows, "path string, video string, threshold double, seconds int, result string, clip_tag string")
    got = {(r.path, r.seconds): (r.t0_05, r.t0_08, r.correct) for r in evaluation.clip_matrix(df, [0.05, 0.08]).collect()}
    assert got == {("x/TPa.mp4", 3): ("TP", "FN", 1), ("y/TPa.mp4", 3): ("FN", None, 0), ("x/FPb.mp4", 5): (None, "TN", 1)}
    said = [tuple(r) for r in evaluation.by_tag(df).collect()]
    assert said == sorted(said) and len(said) == 4
    assert said[0] == (0.05, 3, "TP", "TPa.mp4", "x/TPa.mp4", "TPa.mp4: TP") and said[1][-1] == "TPa.mp4: FN"
    assert evaluation.clip_matrix(df.limit(0), [0.05]).count() == 0


def test_repeated_run(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    rows = spark.createDataFrame([(k, k / 3) for k in range(9)], "clip int, sec double")
    src.append_csv(rows.filter("clip < 5"), path, "one")
    failing = rows.withColumn("sec", F.when(F.col("clip") == 8, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("sec")))
    with pytest.raises(Exception, match="lost"):
        src.append_csv(failing, path, "one")
    src.append_csv(rows, path, "one")
    src.append_csv(rows.filter("clip = 3"), path, "two")
    got = sorted((r.run, r.clip) for r in src.read_runs(spark, path, rows.schema).collect())
    assert got == [("one", k) for k in range(9)] + [("two", 3)]


def test_models_with_lists(spark):
    rows = spark.range(40).select(F.col("id").alias("video_id"))
    ok = scoring.detect_batches(rows, lambda: lambda pdf: [[(float(v), "x")] * (v % 3) for v in pdf["video_id"]], "score double, text string")
    assert sorted((r.video_id, r.ord, r.score) for r in ok.collect()) == [(v, k, float(v)) for v in range(40) for k in range(v % 3)]
    assert scoring.detect_batches(rows, lambda: lambda pdf: [[] for _ in pdf["video_id"]], "score double").count() == 0
    with pytest.raises(Exception, match="lists for"):
        scoring.detect_batches(rows, lambda: lambda pdf: [[]], "score double").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    frames = spark.createDataFrame([(v, k * 2, 8.0, 2, "img") for v in range(3) for k in range(50)], "video_id long, frame_idx long, fps double, stride int, image string")
    seen = lambda items: [[("person", float(len(items)), (i[2], 0.0, 1.0, 1.0))] for i in items]
    got = scoring.callback_boxes(frames, seen, batched=True).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.video_id, r.frame_idx, r.confidence, r.x1) for r in got) == [(v, k * 2, 8.0 if k < 48 else 2.0, k / 4) for v in range(3) for k in range(50)]


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    rows = spark.createDataFrame([(1, 0.1)], "a int, b double")
    src.append_csv(rows, path)
    src.append_csv(rows, path)
    assert [tuple(r) for r in spark.read.csv(path, header=True).collect()] == [("1", "0.100000")] * 2
    src.overwrite_csv(rows, path)
    assert spark.read.csv(path, header=True).count() == 1
    for kind in ("json", "csv", "parquet"):
        det = spark.createDataFrame([(1, 2, 0, "person", 0.5, 1.0, 2.0, 3.0, 4.0)], src.DETECTIONS)
        det.write.option("header", True).format(kind).save(f"{path}-{kind}")
        assert src.read_detections(spark, f"{path}-{kind}", kind).collect() == det.collect()


def test_box_of_wrong_size_fails(spark):
    df = spark.createDataFrame([(1, 0, [[1.0, 2.0, 3.0]], None)], "video_id long, frame_idx long, boxes array<array<double>>, scores array<double>")
    with pytest.raises(Exception, match="4 numbers"):
        sampling.explode_arrays(df).collect()


def test_sharpness(spark):
    rng = np.random.default_rng(0)
    flat, noisy = np.full(16 * 16, 9.0), rng.uniform(0, 255, 16 * 16)
    df = spark.createDataFrame([(1, 16, 16, flat.tolist()), (2, 16, 16, noisy.tolist()), (3, 8, 32, noisy.tolist())], "k int, width int, height int, gray array<double>")
    assert [r.k for r in scoring.sharp_crops(df).collect()] == [2]
    assert {r.k for r in scoring.sharp_crops(df, least=0).collect()} == {1, 2}
    assert scoring.laplacian_variance(np.array([[0.0, 0, 0], [0, 1, 0], [0, 0, 0]])) == pytest.approx(np.array([[0, 2, 0], [2, -4, 2], [0, 2, 0]]).var())


def test_fixed_and_bad_clips(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 10), (2, "b", None, 10), (3, "c", 70.0, 10), (4, "d", 25.0, 10)], "video_id long, path string, fps double, total_frames long")
    meta = {r.video_id: r for r in runs.clip_metadata(df).collect()}
    assert not meta[1].valid and not meta[2].valid and meta[3].unusual_fps and not meta[4].unusual_fps
    assert {r.video_id: r.success for r in runs.error_rows(runs.clip_metadata(df)).collect()} == {1: False, 2: False, 3: True, 4: True}


def test_sweep_equals_single_runs(spark):
    """Every grid point alone gives what the sweep gives."""
    from boxtrail.plans import jobs
    from boxtrail.plans.registry import Tables

    d = Tables(spark, SF)
    swept = {(r.video_id, r.threshold, r.seconds): r.events for r in jobs.sweep_events(d).collect()}
    for threshold, seconds in ((0.11, 3), (0.20, 5)):
        rows = jobs.posed(jobs.given_samples(d), jobs.pose_rows(d)).withColumn("hit", F.coalesce(F.col("distance") < threshold, F.lit(False)))
        ranges = incidents.time_rule(rows, Settings(seconds_required=seconds))[2]
        alone = {r.video_id: r["count"] for r in incidents.incident_intervals(ranges, d["clips"]).groupBy("video_id").count().collect()}
        assert {v: n for (v, x, s), n in swept.items() if (x, s) == (threshold, seconds) and n} == alone


def test_best_of_crop(spark):
    df = spark.createDataFrame([(1, 0, "0.9", " A "), (1, 1, "0.9", "B"), (1, 2, "x", "C"), (1, 3, "1.0", " "), (2, 0, None, "D")], "crop int, ord int, score string, text string")
    assert [tuple(r) for r in plates.best_text(df, ["crop"]).collect()] == [(1, "B", 0.9)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_are_made_where_they_lie(spark, monkeypatch):
    """Actors are dealt out by video; their rows, many more, go through tracks, frames and joins by frame without another exchange."""
    import re

    from boxtrail.plans import timerule
    from boxtrail.plans.registry import Tables
    from boxtrail.sources import fixtures

    monkeypatch.setattr(fixtures, "PER_PARTITION", 200)
    d = Tables(spark, SF)
    rows = d["detections"].select("video_id", "frame_idx", "ord", "pose_hit").join(d["detections"].select("video_id", "frame_idx", "ord", "label"), ["video_id", "frame_idx", "ord"])
    for plan in (timerule.per_second(d), sampling.gate(d["detections"], d["detections"], ("person",), 0.4), rows):
        dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan._jdf.queryExecution().executedPlan().toString())
        assert dealt and all(re.match(r"video_id#\d+L?, \d+$", x) for x in dealt), dealt


@pytest.mark.parametrize("name", ["litter_class", "clock_text", "frame_join", "output_path", "sweep_grid", "carry_forward", "gated_hits"])
def test_only_actors_are_exchanged(spark, monkeypatch, name):
    """Nothing is written first, and no exchange but that of the actors: what is shuffled grows with the orders, not with their rows."""
    import re

    from boxtrail.plans import catalog
    from boxtrail.sources import fixtures

    monkeypatch.setattr(fixtures, "PER_PARTITION", 200)
    got = catalog.queries()[name](spark, SF)
    assert {f.rsplit("/", 1)[-1] for f in got.inputFiles()} == {"orders.parquet"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"(?<!Broadcast)Exchange (\w+)(?:\((\w+))?", plan)
    assert dealt and all(x == ("hashpartitioning", "video_id") for x in dealt), dealt
    assert all(re.match(r"Exchange hashpartitioning\(video_id#\d+L?, \d+\)", x) for x in re.findall(r"Exchange hashpartitioning\([^)]*\)", plan))


def test_overlap_pairs_across_buckets_and_crowds(spark, monkeypatch):
    """Pairs equal a plain double loop, over the edge of a bucket and where a sample is compared in pieces; a sample that is missing has no pairs."""
    edge = tracking.BUCKET
    box = lambda v, f, k: (float(k * 13 % 40), float(k * 7 % 30 + v), float(k * 13 % 40 + 30), float(k * 7 % 30 + v + 40))
    frames = [0, 2, 3, 4, 8, edge - 2, edge - 1, edge, edge + 2]
    rows = [(v, f, k, 2, *box(v, f, k + f)) for v in (0, 1) for f in frames for k in range(5)]
    df = spark.createDataFrame(rows, "video_id long, frame_idx long, ord int, stride int, x1 double, y1 double, x2 double, y2 double")
    want = {(b[0], b[1], a[2], b[2]): tracking.overlap(a[4:], b[4:]) for a in rows for b in rows if a[0] == b[0] and b[1] == a[1] + 2}
    want = pytest.approx({k: x for k, x in want.items() if x >= 0.35})
    got = {(r.video_id, r.frame_idx, r.prev_ord, r.ord): r.iou for r in tracking.overlap_pairs(df, 0.35).collect()}
    assert got == want and {k[1] for k in got} == {2, 4, edge, edge + 2}
    monkeypatch.setattr(tracking, "PAIRS", 8)
    near = [(*r, b, r[1] // edge) for b in (0, 1) for r in rows if b in (r[1] // edge, (r[1] + 2) // edge)]
    columns = ["video_id", "frame_idx", "ord", "stride", "x1", "y1", "x2", "y2", "bucket", "own"]
    table = pa.Table.from_pydict({c: list(x) for c, x in zip(columns, zip(*sorted(near, key=lambda r: (r[0], r[8], *r[1:3])), strict=True), strict=True)})
    pieces = [tuple(r.values()) for b in tracking._paired(0.35)(iter(table.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    assert {r[:4]: r[4] for r in pieces} == want and len(pieces) == len(got)


def test_sample_state_and_marked_frames_pass_samples_once(spark, tmp_path):
    """Each reads its samples once: no join with another pass over them, and one sort by track serves all windows."""
    rows = [(0, 0, f, 8.0, 0.0, 0.0, 60.0, 140.0, True) for f in range(0, 200, 2)]
    schema = "video_id long, track_id long, frame_idx long, fps double, x1 double, y1 double, x2 double, y2 double, hit boolean"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/s")
    samples, clips = spark.read.parquet(f"{tmp_path}/s"), spark.createDataFrame([(0, 210)], "video_id long, total_frames long")
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    state, marked = incidents.sample_state(samples), incidents.marked_frames(samples, clips)
    assert plan(state).count("FileScan parquet") == plan(marked).count("FileScan parquet") == 1
    assert state._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert state.filter("confirmed").agg({"frame_idx": "min"}).first()[0] == 88  # still from second 1 on, ten good seconds
    assert marked.count() == 210 - 88


@pytest.mark.parametrize("kind", ["TrackPersons", "Alerts", "Plates", "VehiclePlates"])
def test_stream_steps_make_no_table_for_each_frame(kind, monkeypatch):
    """A batch of many frames takes its columns out once: no grouping and no row objects, which cost milliseconds a frame."""
    import pandas as pd

    from boxtrail.streaming import detections as st

    for slow in ("groupby", "itertuples", "iterrows"):
        monkeypatch.setattr(pd.DataFrame, slow, lambda *a, **k: pytest.fail("a table for each frame"))
    n = 40
    pdf = pd.DataFrame({"frame_idx": np.repeat(np.arange(n) * 2, 2), "ord": [0, 1] * n, "track_id": [0, 1] * n, "fps": 8.0, "stride": 2, "label": "person", "hit": True, "confidence": 0.9, "norm": "AB-1", "dashed": True, "score": 0.95, "plate_confidence": 0.9})
    for k, c in enumerate(("x1", "y1", "x2", "y2")):
        pdf[c] = pdf["ord"] * 300.0 + (k > 1) * 100
        pdf[f"g_{c}"] = pdf[c]
    made = getattr(st, kind)()
    made.live, made.now = {}, None
    out = made.step((1,), pdf)
    assert len(out) == {"Alerts": 0}.get(kind, 2 * n) and len(made.live) == 2
    if kind == "TrackPersons":
        assert out["track_id"].tolist() == [0, 1] * n
    assert list(st.frames_of(pdf.iloc[:0])) == [] and list(st.frames_of(pdf))[-1] == (2 * n - 2, 2 * n - 2, 2 * n)


@pytest.mark.parametrize("name", ["litter_job", "annotation_rows", "annotation_job", "event_log", "incident_job_tracked"])
def test_made_rows_are_not_broadcast(spark, name):
    """Rows made by a generator, which the planner takes for as small as their actors, reach no driver, however small the tables look."""
    lines = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for at, line in enumerate(lines):
        if "- BroadcastExchange" in line:
            for below in lines[at + 1 :]:
                if depth(below) <= depth(line) or "Join" in below or "HashAggregate" in below:
                    break
                assert "explode(sequence(0" not in below, "\n".join(lines[at : at + 6])


def test_model_without_results_in_a_batch(spark):
    """A batch all of whose inputs have empty lists keeps its column types: a column of text stays one that Arrow takes."""
    from boxtrail.operators.scoring import detect_batches

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = spark.createDataFrame([(k,) for k in range(6)], "n long").coalesce(1)
        seen = detect_batches(rows, lambda: lambda pdf: [[("a", 0.5)] * (n // 4) for n in pdf["n"]], "text string, score double").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(tuple, seen)) == [(4, 0, "a", 0.5), (5, 0, "a", 0.5)]


def test_sweep_grid_is_whole(spark):
    """Every threshold of the reference's range and every duration it names, for each clip."""
    rows = catalog.queries()["sweep_grid"](spark, SF).filter("video_id = 0").collect()
    assert {r.threshold for r in rows} == {round(0.05 + 0.01 * k, 2) for k in range(16)} and {5, 6, 7, 8, 9, 10} < {r.seconds for r in rows}
    assert len(rows) == 16 * len({r.seconds for r in rows})


@pytest.mark.parametrize("batched", [False, True])
def test_callbacks_get_arrow_columns(spark, batched):
    """Images and boxes go in and out as columns, no table for a window; a frame's boxes keep their order, none give no row."""
    see = lambda image: [(x["label"], x["sure"], (1.0, 2, 3, float(k))) for k, x in enumerate(image)]
    callback = (lambda items: [see(image) for _, image, _ in items]) if batched else (lambda frame, image, ts: see(image))
    rows = [(v, k * 2, 8.0, 2, [("person", 0.5), ("car", 0.25)][: k % 3]) for v in range(2) for k in range(20)]
    frames = spark.createDataFrame(rows, "video_id long, frame_idx long, fps double, stride int, image array<struct<label string, sure double>>")
    got = scoring.callback_boxes(frames, callback, batched)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    want = [(v, f, r, s, k, *x, 1.0, 2.0, 3.0, float(k)) for v, f, r, s, image in rows for k, x in enumerate(image)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert scoring.callback_boxes(frames.filter("size(image) = 0"), callback, batched).count() == 0
    short = (lambda items: [[("person", 1.0, (1.0, 2.0))] for _ in items]) if batched else (lambda *item: [("person", 1.0, (1.0, 2.0))])
    with pytest.raises(Exception, match="4 numbers"):
        scoring.callback_boxes(frames, short, batched).collect()
    if batched:
        with pytest.raises(Exception, match="lists for"):
            scoring.callback_boxes(frames, lambda items: [], batched).collect()


def test_packs_hold_the_rows_of_a_frame(spark):
    """A frame's rows reach a processor as one row, in order, nulls too; a late frame is dropped as its rows would be."""
    import pandas as pd

    from boxtrail.streaming import detections as st

    t = pa.array([2000, 1000, 2000, 1000, 1000], pa.timestamp("us", "UTC"))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 1, 2, 1]), pa.array([4, 2, 4, 2, 2]), pa.array(["a", None, "b", "c", "d"]), pa.array([0.5, None, 1.5, 2.5, 3.5]), t], ["video_id", "frame_idx", "norm", "score", "event_time"])
    (got,) = st._packs(iter([batch, batch.slice(0, 0)]))
    assert got.column("video_id").to_pylist() == [1, 1, 2] and got.column("norm").to_pylist() == [[None, "d"], ["a", "b"], ["c"]]
    rows = st.unpacked(got.to_pandas())
    assert rows["frame_idx"].tolist() == [2, 2, 4, 4, 2] and rows["norm"].tolist() == [None, "d", "a", "b", "c"] and rows["video_id"].tolist() == [1, 1, 1, 1, 2]
    assert pd.isna(rows["score"][0]) and rows["score"].tolist()[1:] == [3.5, 0.5, 1.5, 2.5] and len(rows["event_time"].unique()) == 2
    columns = "video_id long, frame_idx long, fps double, ord int, label string, confidence double, x1 double, y1 double, x2 double, y2 double"
    row = lambda v, f: (v, f, 4.0, 0, "person", 0.9, 0.0, 0.0, 60.0, 150.0)
    path = src.scratch(spark, "late")
    for part in ([row(1, 400)], [row(1, 404)], [row(1, 408), row(2, 0)]):
        spark.createDataFrame(part, columns).coalesce(1).write.mode("append").parquet(path)
    out = st.run_to_end(st.stream_tracks(st.stream_rows(spark, path, spark.createDataFrame([row(0, 0)], columns).schema))).collect()
    assert sorted((r.video_id, r.frame_idx, r.track_id) for r in out) == [(1, 400, 0), (1, 404, 0), (1, 408, 0)]


def test_state_of_gone_tracks_takes_one_call():
    """Where most tracks are gone their entries are cleared at once and those that stay are written again."""
    from boxtrail.streaming import detections as st

    class Calls:
        def __init__(self, entries):
            self.entries, self.calls = dict(entries), []

        def exists(self):
            return bool(self.entries)

        def iterator(self):
            return iter([((k,), v) for k, v in self.entries.items()])

        def clear(self):
            self.calls.append("clear")
            self.entries.clear()

        def removeKey(self, k):  # noqa: N802
            self.calls.append("remove")
            del self.entries[k[0]]

        def updateValue(self, k, v):  # noqa: N802
            self.calls.append("update")
            self.entries[k[0]] = v

    from types import SimpleNamespace

    def state(entries):
        by = st.TrackPersons()
        by.tracks, by.clip = Calls(entries), SimpleNamespace(exists=lambda: False, clear=lambda: None)
        by.handle = SimpleNamespace(listTimers=lambda: iter(()), registerTimer=lambda x: None)
        return by

    by = state({})
    by._read()
    by.live, by.now = {k: (0.0, 0.0, 1.0, 1.0, k) for k in range(20)}, None
    by.due = lambda: None
    by._write()
    assert by.tracks.calls == ["update"] * 20
    for stay, calls in ((2, ["clear", "update", "update"]), (18, ["remove", "remove"])):
        one = state(by.tracks.entries)
        one.due = lambda: None
        one._read()
        assert one.live == {k: (0.0, 0.0, 1.0, 1.0, k) for k in range(20)}
        one.live = {k: one.live[k] for k in range(stay)}
        one._write()
        assert one.tracks.calls == calls and set(one.tracks.entries) == set(range(stay))
