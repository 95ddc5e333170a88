"""Skeleton templates and animations: one row for each frame, its joints as [x, y, z] in a map by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Height of a body in metres and the torso's share of it.
HEIGHT, TORSO = 1.75, 0.29
#: How much of a scale an arm takes over, and where in the template the release is.
STRENGTH, RELEASE = 0.15, 0.47


def plus(a: Column, b: Column, times: Column | float = 1.0) -> Column:
    """a + times * b of arrays."""
    return F.zip_with(a, b, lambda x, y: x + times * y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def skeleton_template(df: DataFrame, segment: list[str], frame: str, joint: str, hips: tuple[str, str] = ("left_hip", "right_hip"), shoulders: tuple[str, str] = ("left_shoulder", "right_shoulder")) -> DataFrame:
    """(frame, joint, x, y, z, n): the median place of each joint in each frame of segments of one length, given by rows
    (…, frame, joint, x, y, z). Places are taken from the middle of the hips, upwards is z, and a segment is scaled
    so that the median height of its shoulders over the hips is the torso of a body of HEIGHT. n counts segments."""
    at, axes = Window.partitionBy(*segment, frame), ("x", "y", "z")
    middle = lambda names, a: F.avg(F.when(F.col(joint).isin(*names), F.col(a))).over(at)
    rows = df.select(*segment, frame, joint, *axes, *[middle(hips, a).alias(f"__r{a}") for a in axes], *[middle(shoulders, a).alias(f"__s{a}") for a in axes])
    torso = F.sqrt(sum((F.pow(F.col(f"__s{a}") - F.col(f"__r{a}"), 2) for a in axes), F.lit(0.0)))
    frames = rows.groupBy(*segment, frame).agg(F.first(torso).alias("__t"))
    sizes = frames.groupBy(*segment).agg((F.lit(HEIGHT * TORSO) / F.greatest(F.percentile("__t", 0.5), F.lit(1e-6))).alias("__scale"))
    rows = rows.join(sizes.select(*[F.col(c).alias(f"__by_{c}") for c in segment], "__scale"), [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in segment])
    d = {a: (F.col(a) - F.col(f"__r{a}")) * F.col("__scale") for a in axes}
    placed = rows.select(frame, joint, d["x"].alias("x"), (-d["z"]).alias("y"), (-d["y"]).alias("z"))
    return placed.groupBy(frame, joint).agg(*[F.percentile(a, 0.5).alias(a) for a in axes], F.count("x").alias("n"))


def framed(template: DataFrame, frame: str, joint: str) -> DataFrame:
    """(frame, joints): a row for each frame of a template."""
    places = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(joint).alias("joint"), F.array("x", "y", "z").alias("at")))))
    return template.groupBy(F.col(frame).cast("long").alias("frame")).agg(places.alias("joints"))


def fused_frames(windows: DataFrame, template: DataFrame, by: list[str], frames: int, joints: list[str], rate: float = 50.0) -> DataFrame:
    """(…, frame, time_s, joints, hips) of every frame of every window (…, n, release, s1, s2, s3): the template (frame, joints)
    of ``frames`` frames at the window's own pace, its release where the window's is, and its arms longer or shorter
    by the window's scales of the upper arm, the forearm and the left arm. Frames meet the template by number; nothing
    gathers a window."""
    src = int(frames * RELEASE)
    t, n, rel = F.col("frame"), F.col("n"), F.col("release")
    before = t / F.greatest(rel, F.lit(1)) * src
    after = src + (t - rel) / F.greatest(n - 1 - rel, F.lit(1)) * (frames - 1 - src)
    rows = windows.where("n > 0").withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.withColumn("__at", F.when(t <= rel, before).otherwise(after)).withColumn("__i", F.greatest(F.lit(0), F.least(F.floor("__at"), F.lit(frames - 2))).cast("long"))
    a = template.select(F.col("frame").alias("__fa"), F.col("joints").alias("__a"))
    b = template.select((F.col("frame") - 1).alias("__fb"), F.col("joints").alias("__b"))
    rows = rows.join(a, F.col("__i") == F.col("__fa")).join(b, F.col("__i") == F.col("__fb"))
    part = F.col("__at") - F.col("__i")
    place = {j: plus(F.col("__a")[j], minus(F.col("__b")[j], F.col("__a")[j]), part) for j in joints}
    rows = rows.select(*by, "frame", *[F.col(s) for s in ("s1", "s2", "s3")], *[p.alias(f"__j_{j}") for j, p in place.items()])
    j = lambda name: F.col(f"__j_{name}")
    grown = lambda s: 1 + STRENGTH * (F.col(s) - 1)
    moved = {}
    for side, elbow, wrist in (("right", "s1", "s2"), ("left", "s3", "s3")):
        moved[f"{side}_elbow"] = plus(j(f"{side}_shoulder"), minus(j(f"{side}_elbow"), j(f"{side}_shoulder")), grown(elbow))
        moved[f"{side}_wrist"] = plus(moved[f"{side}_elbow"], minus(j(f"{side}_wrist"), j(f"{side}_elbow")), grown(wrist))
    rounded = lambda c: F.transform(c, lambda x: F.round(x, 6))
    out = F.struct(*[rounded(moved.get(name, j(name))).alias(name) for name in joints])
    hips = rounded(F.zip_with(j("left_hip"), j("right_hip"), lambda x, y: (x + y) / 2))
    return rows.select(*by, "frame", (F.col("frame") / rate).alias("time_s"), out.alias("joints"), hips.alias("hips"))


def animations(frames: DataFrame, by: list[str], extra: list[str]) -> DataFrame:
    """(…, n_frames, document) with the frames of each window in order as one JSON text; a window is short."""
    each = F.array_sort(F.collect_list(F.struct("frame", "time_s", *extra, "joints", "hips")))
    return frames.groupBy(*by).agg(F.count(F.lit(1)).alias("n_frames"), each.alias("__f")).select(*by, "n_frames", F.to_json(F.struct(*by, "n_frames", F.col("__f").alias("frames"))).alias("document"))
