"""Cases as Parquet tables, and flow fields from raw signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rheolake.functions import axes, signal
from rheolake.operators import voxel

DEFAULTS = {"spacing": [1.0, 1.0, 1.0], "venc": [150.0, 150.0, 150.0], "rr": 1000.0, "spatial_order": ["FH", "AP", "LR"], "venc_order": ["FH", "AP", "LR"]}


def discover(spark: SparkSession, inputs: list[str], suffixes: tuple[str, ...] = ("h5", "hdf5")) -> DataFrame:
    """Distinct sorted paths of case files below the inputs, by suffix in any case.  Contents are not read."""
    pattern = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    return reader.load(inputs).select("path").distinct().orderBy("path")


def case_header(meta: DataFrame) -> DataFrame:
    """meta with the defaults of what is missing; one venc stands for all three."""
    filled = meta
    for name, value in DEFAULTS.items():
        default = F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
        filled = filled.withColumn(name, F.coalesce(name, default) if name in meta.columns else default)
    return filled.withColumn("venc", F.when(F.size("venc") == 1, F.array_repeat(F.get("venc", F.lit(0)), 3)).otherwise(F.col("venc")))


def mask_at_times(seg: DataFrame, times: DataFrame) -> DataFrame:
    """seg(case_id, i, j, k, t, label) at all times(case_id, times): a case with one time step holds at each of them."""
    single = seg.groupBy("case_id").agg((F.count_distinct("t") == 1).alias("single"))
    rows = seg.join(single, "case_id").join(times, "case_id")
    at = F.when(F.col("single"), F.sequence(F.lit(0), F.col("times") - 1)).otherwise(F.array("t"))
    return rows.withColumn("t", F.explode(at)).select("case_id", "i", "j", "k", "t", "label")


def flow_from_signal(raw: DataFrame, meta: DataFrame, seg: DataFrame, pad: int = 2) -> DataFrame:
    """Velocities, spreads and turbulent energy from raw_signal(ch 0: reference, 1 to 3: encodings) around the mask.

    The raw table is cut to the mask's padded box before anything else; the box is one row per case.
    """
    head = case_header(meta)
    box = voxel.mask_bbox(seg.where("label != 0"), head, pad)
    near = voxel.crop(raw, box)
    pick = lambda ch, c: F.max(F.when(F.col("ch") == ch, F.col(c))).alias(f"{c}{ch}")
    wide = near.groupBy("case_id", "i", "j", "k", "t").agg(*[pick(ch, c) for ch in range(4) for c in ("re", "im")])
    size = [(F.col(f"hi_{c}") - F.col(f"lo_{c}") + 1) for c in "ijk"]
    rows = wide.join(box.select("case_id", F.array(*size).alias("cut_dims")), "case_id").join(head.select("case_id", "venc", "spatial_order", "venc_order"), "case_id")
    ref = signal.magnitude(F.col("re0"), F.col("im0"))
    for ch in (1, 2, 3):
        phase = signal.phase_difference(F.col(f"re{ch}"), F.col(f"im{ch}"), F.col("re0"), F.col("im0"))
        venc = F.get("venc", F.lit(ch - 1))
        sigma = signal.intravoxel_sigma(ref, signal.magnitude(F.col(f"re{ch}"), F.col(f"im{ch}")), venc)
        rows = rows.withColumns({f"u{ch}": signal.velocity(phase, venc), f"g{ch}": sigma})
    turned = rows.select(
        "case_id", *[axes.oriented_index(F.col("spatial_order"), F.col("cut_dims"), ("i", "j", "k"), t).alias(c) for t, c in zip(axes.TARGET, "ijk", strict=True)], "t", ref.alias("mag"),
        *[axes.oriented_component(F.col("venc_order"), ("u1", "u2", "u3"), t).alias(f"v{c}") for t, c in zip(axes.TARGET, "xyz", strict=True)],
        *[axes.oriented_component(F.col("venc_order"), ("g1", "g2", "g3"), t, signed=False).alias(f"s{c}") for t, c in zip(axes.TARGET, "xyz", strict=True)],
    )
    most = turned.groupBy("case_id").agg(F.max("mag").alias("most"))
    out = turned.join(most, "case_id").withColumn("mag", F.when(F.col("most") > 0, F.col("mag") / F.col("most")).otherwise(0.0)).drop("most")
    return out.withColumn("tke", signal.kinetic_energy(F.col("sx"), F.col("sy"), F.col("sz")))


def oriented_case(raw: DataFrame, seg: DataFrame, meta: DataFrame, pad: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """seg, flow and meta of raw tables, all cut to the mask's padded box and turned to the target axes; masks of one time
    hold at all times of their signal.  Spacing follows its axis, and dims are those of the turned box."""
    head = case_header(meta)
    box = voxel.mask_bbox(seg.where("label != 0"), head, pad)
    cut_dims = F.array(*[(F.col(f"hi_{c}") - F.col(f"lo_{c}") + 1) for c in "ijk"]).alias("cut_dims")
    frame = box.select("case_id", cut_dims).join(head.select("case_id", "spatial_order", "spacing", *[c for c in ("origin", "venc", "rr") if c in head.columns]), "case_id")
    turned = [axes.oriented_index(F.col("spatial_order"), F.col("cut_dims"), ("i", "j", "k"), t).alias(c) for t, c in zip(axes.TARGET, "ijk", strict=True)]
    times = raw.groupBy("case_id").agg((F.max("t") + 1).alias("times"))
    near = voxel.crop(mask_at_times(seg, times), box).join(frame.select("case_id", "cut_dims", "spatial_order"), "case_id")
    masks = near.select("case_id", *turned, "t", "label")
    by_axis = lambda name: F.array(*[_of_axis(F.col("spatial_order"), F.col(name), t) for t in axes.TARGET]).alias(name if name == "spacing" else "dims")
    others = [c for c in ("origin", "venc", "rr") if c in frame.columns]
    return masks, flow_from_signal(raw, meta, seg, pad), frame.select("case_id", by_axis("cut_dims"), by_axis("spacing"), *others)


def _of_axis(order, values, target: str):
    """The value of the source axis that becomes a target axis."""
    out = F.lit(None)
    for n in range(3):
        out = F.when(axes.axis_of(order[n]) == target, values[n]).otherwise(out)
    return out


def case_status(seg: DataFrame, flow: DataFrame, meta: DataFrame) -> DataFrame:
    """case_id, status, error: one row per case that any table has.

    error: a table lacks the case, its dims are not three positive numbers, a voxel lies outside of them, or the mask has
    times that the flow has not (a mask of one time holds at all of them).  skipped: mask or flow is empty.  One bad case
    leaves the others alone.
    """
    dims = meta.groupBy("case_id").agg(F.first("dims").alias("dims"))
    box = [F.min(F.least(*"ijk")).alias("low"), *[F.max(c).alias(f"top_{c}") for c in "ijk"]]

    def side(df: DataFrame, name: str) -> DataFrame:
        found = df.groupBy("case_id").agg(*box, F.collect_set("t").alias("times"))
        return found.select("case_id", F.struct("low", "top_i", "top_j", "top_k", "times").alias(name))

    masked = seg.groupBy("case_id").agg(F.count_if(F.col("label") > 0).alias("voxels"))
    rows = dims.join(side(seg, "seg"), "case_id", "full").join(side(flow, "flow"), "case_id", "full").join(masked, "case_id", "left")
    outside = lambda n: (F.col(f"{n}.low") < 0) | (F.col(f"{n}.top_i") >= F.col("dims")[0]) | (F.col(f"{n}.top_j") >= F.col("dims")[1]) | (F.col(f"{n}.top_k") >= F.col("dims")[2])
    bad_dims = (F.size("dims") != 3) | F.exists("dims", lambda x: x.isNull() | (x <= 0))
    other_times = (F.size("seg.times") > 1) & (F.size(F.array_except("seg.times", "flow.times")) > 0)
    error = (
        F.when(F.col("dims").isNull(), "no meta").when(F.coalesce(bad_dims, F.lit(True)), "dims are not three positive numbers")
        .when(outside("seg"), "a mask voxel lies outside the dims").when(outside("flow"), "a flow voxel lies outside the dims")
        .when(other_times, "the mask has times that the flow has not")
    )
    skipped = F.when(F.coalesce("voxels", F.lit(0)) == 0, "empty mask").when(F.col("flow").isNull(), "empty flow")
    status = F.when(error.isNotNull(), "error").when(skipped.isNotNull(), "skipped").otherwise("ok")
    return rows.select("case_id", status.alias("status"), F.coalesce(error, skipped).alias("error"))
