"""Masks and fields of one large case, cut into bricks: no task holds a whole mask.

A brick is a cube of ``side`` voxels; a task works on one with the voxels around it that can matter (its halo), and keeps
what lies in the brick itself.  What passes between bricks passes in rounds: labels through a graph of borders, thinning
by exchanging the halo's voxels after every few faces, lines by handing over the points that leave.  Results equal those
of the kernels on the whole case, for every side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rheolake.operators.batches import beside, map_groups
from rheolake.operators.kernels import ALL_STEPS, LINE_ROWS, fields, laid_out, lattice_links, merge_labels, peel
from rheolake.operators.rounds import component_of
from rheolake.operators.voxel import FACES, offsets
from rheolake.storage import discard, materialize

SIDE = 128
BRICK = ["bi", "bj", "bk"]
#: Voxels around a brick that can change what one face of thinning does in it: eight classes, and the border before them.
FACE_HALO = 9


def brick_of(side: int) -> list:
    return [F.floor(F.col(c) / side).cast("int").alias(b) for c, b in zip("ijk", BRICK, strict=True)]


def in_bricks(rows: DataFrame, side: int, halo: int) -> DataFrame:
    """rows(i, j, k, ...) once for each brick in or around which they lie; of those between lo_ and hi_, where rows have them."""
    for c, b in zip("ijk", BRICK, strict=True):
        first, last = F.col(c) - halo, F.col(c) + halo
        if f"lo_{c}" in rows.columns:
            first, last = F.greatest(first, F.col(f"lo_{c}")), F.least(last, F.col(f"hi_{c}"))
        rows = rows.withColumn(b, F.explode(F.sequence(F.floor(first / side).cast("int"), F.floor(last / side).cast("int"))))
    return rows


def kinds_of(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema}


# ------------------------------------------------------------------------------------------------------------ components


def connected_components(mask: DataFrame, connectivity: int = 6, side: int = SIDE) -> DataFrame:
    """mask(case_id, i, j, k, voxel): adds component, the smallest voxel number that is reached by 6 or 26 neighbours."""
    steps = FACES if connectivity == 6 else ALL_STEPS
    kinds = kinds_of(mask)

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        ijk = pdf[["i", "j", "k"]].to_numpy(np.int64)
        # bricks are laid out apart along the first axis, so that one pass links the voxels of many
        counts = np.diff(np.r_[starts, len(pdf)])
        lo = np.minimum.reduceat(ijk, starts)
        far = np.maximum.reduceat(ijk, starts)[:, 0] - lo[:, 0] + 2
        place = ijk - np.repeat(lo, counts, axis=0)
        place[:, 0] += np.repeat(np.cumsum(far) - far, counts)
        label = merge_labels(len(pdf), *lattice_links(place, steps))
        number = pdf["voxel"].to_numpy()
        least = np.full(len(pdf), np.iinfo(number.dtype).max, number.dtype)
        np.minimum.at(least, label, number)
        return pdf.assign(local=least[label])[["case_id", "i", "j", "k", "voxel", "local"]]

    schema = f"case_id {kinds['case_id']}, i int, j int, k int, voxel {kinds['voxel']}, local {kinds['voxel']}"
    rows = mask.select("case_id", *[F.col(c).cast("int").alias(c) for c in "ijk"], "voxel", *brick_of(side))
    local = materialize(map_groups(rows, ["case_id", *BRICK], run, schema), "local")
    # voxels whose neighbours may lie in another brick
    rim = local.where(" OR ".join(f"pmod({c}, {side}) IN (0, {side - 1})" for c in "ijk"))
    ahead = rim.select("case_id", F.col("local").alias("a"), "i", "j", "k", F.explode(offsets([s for s in steps if s > (0, 0, 0)])).alias("s"))
    ahead = ahead.select("case_id", "a", *[(F.col(c) + F.col(f"s.d{c}")).cast("int").alias(c) for c in "ijk"])
    pairs = ahead.join(rim.select("case_id", "i", "j", "k", F.col("local").alias("b")), ["case_id", "i", "j", "k"]).where("a != b")
    roots = component_of(pairs.select("case_id", "a", "b")).select("case_id", F.col("node").alias("local"), "root")
    found = local.join(roots, ["case_id", "local"], "left")
    return found.select("case_id", "i", "j", "k", "voxel", F.coalesce("root", "local").alias("component"))


# -------------------------------------------------------------------------------------------------------------- thinning


def skeletonize(components: DataFrame, side: int = SIDE, faces_a_round: int = 1) -> DataFrame:
    """components(case_id, i, j, k, component): the skeleton's voxels, by rounds.

    In a round each brick peels some faces of its components within the halo that these need, and keeps its own voxels.
    The rounds end when six faces in a row took nothing.
    """
    kinds = kinds_of(components)
    halo = FACE_HALO * faces_a_round
    own = components.select("case_id", "i", "j", "k", "component").distinct()
    corner = own.groupBy("case_id", "component").agg(*[F.min(c).alias(f"lo_{c}") for c in "ijk"], *[F.max(c).alias(f"hi_{c}") for c in "ijk"])
    state = materialize(own.join(corner, ["case_id", "component"]), "thinned")
    left, idle, face = state.count(), 0, 0
    schema = f"case_id {kinds['case_id']}, component {kinds['component']}, i int, j int, k int, lo_i int, lo_j int, lo_k int, hi_i int, hi_j int, hi_k int"
    while left and idle < 6:
        faces = [(face + n) % 6 for n in range(faces_a_round)]

        def run(pdf: pd.DataFrame, starts: np.ndarray, faces: list[int] = faces) -> pd.DataFrame:
            ijk, low = pdf[["i", "j", "k"]].to_numpy(np.int64), pdf[["lo_i", "lo_j", "lo_k"]].to_numpy(np.int64)
            inside = (ijk // side == pdf[BRICK].to_numpy(np.int64)).all(1)
            kept = inside.copy()
            counts = np.diff(np.r_[starts, len(pdf)])
            # places count from the component's corner, whatever the brick
            odd = (np.minimum.reduceat(ijk, starts) - low[starts]) % 2 @ np.array([4, 2, 1])
            for rows, cell, shape, sets in laid_out(ijk, starts):
                flat = np.zeros(int(np.prod(shape)), bool)
                flat[cell] = True
                order = np.argsort(cell)
                kinds_, cells = np.repeat(odd[sets], counts[sets])[order], cell[order]
                for one in faces:
                    cells = peel(flat, shape, cells, one, kinds_)
                    kinds_ = np.repeat(odd[sets], counts[sets])[order][flat[cell[order]]]
                kept[rows] &= flat[cell]
            return pdf[kept].drop(columns=BRICK)

        spread = in_bricks(state, side, halo)
        now = materialize(map_groups(spread, ["case_id", "component", *BRICK], run, schema), "thinned")
        discard(state)
        state, before, left = now, left, now.count()
        idle = idle + faces_a_round if left == before else 0
        face = (face + faces_a_round) % 6
    return state.select("case_id", "i", "j", "k", "component")


# ----------------------------------------------------------------------------------------------------------- streamlines


def streamlines(
    flow: DataFrame, seeds: DataFrame, spacing=(1.0, 1.0, 1.0), step: float = 0.5, max_steps: int = 2000, least_speed: float = 0.01, side: int = SIDE
) -> DataFrame:
    """kernels.streamlines by bricks: a point goes on in its brick until it leaves, and is handed to the next in a round.

    A step reaches half a voxel at most, so one voxel of halo is enough.  Only bricks that hold points are read in a round.
    """
    cell_size = np.array(spacing, float)
    size = step * cell_size.min()
    kinds = kinds_of(flow) | {"line_id": dict(seeds.dtypes)["line_id"]}
    key = ["case_id", "t", *BRICK]
    field = materialize(in_bricks(flow.select("case_id", "t", "i", "j", "k", "vx", "vy", "vz"), side, 1), "field")
    at_times = seeds if "t" in seeds.columns else seeds.join(flow.select("case_id", "t").distinct(), "case_id")
    place = [F.floor(F.floor(F.col(c)) / side).cast("int").alias(b) for c, b in zip("xyz", BRICK, strict=True)]
    points = at_times.select("case_id", "t", "line_id", F.lit(0).alias("seq"), *[F.col(c).cast("double").alias(c) for c in "xyz"], *place)
    live = materialize(points, "points")
    schema = f"case_id {kinds['case_id']}, t {kinds['t']}, line_id {kinds['line_id']}, seq int, x double, y double, z double, speed double, bi int, bj int, bk int, going boolean"
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        parts = []
        places, bricks = pdf[["x", "y", "z"]].to_numpy(float), pdf[BRICK].to_numpy(np.int64)
        seqs = pdf["seq"].to_numpy(np.int64)

        def note(row, seq, p, speed, going):
            brick = np.floor(p).astype(np.int64) // side
            named = pdf[["case_id", "t", "line_id"]].iloc[row].reset_index(drop=True)
            parts.append(named.assign(seq=seq, speed=speed, going=going, **{c: p[:, n] for n, c in enumerate("xyz")}, **{b: brick[:, n] for n, b in enumerate(BRICK)})[columns])

        for along, rows, group in fields(pdf, starts, cell_size, size):
            seq, p = seqs[rows], places[rows]
            fresh = seq == 0
            speed = along.speed(p[fresh], group[fresh])
            good = speed >= least_speed
            seed, seed_group = rows[fresh][good], group[fresh][good]
            note(seed, np.zeros(len(seed), np.int64), places[seed], speed[good], False)
            # a seed goes both ways; a point that came from another brick goes on its way
            row, own = np.r_[rows[~fresh], seed, seed], np.r_[group[~fresh], seed_group, seed_group]
            way = np.r_[np.sign(seq[~fresh]), np.ones(len(seed), np.int64), -np.ones(len(seed), np.int64)]
            done = np.r_[np.abs(seq[~fresh]), np.zeros(2 * len(seed), np.int64)]
            p = places[row]
            on = done < max_steps
            row, own, way, done, p = row[on], own[on], way[on], done[on], p[on]
            while len(p):
                p = along.ahead(p, way[:, None], own)
                done = done + 1
                speed = along.speed(p, own)
                on = speed >= least_speed
                row, own, way, done, p, speed = row[on], own[on], way[on], done[on], p[on], speed[on]
                leaves = (np.floor(p).astype(np.int64) // side != bricks[row]).any(1) & (done < max_steps)
                note(row, way * done, p, speed, leaves)
                on = ~leaves & (done < max_steps)
                row, own, way, done, p = row[on], own[on], way[on], done[on], p[on]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=columns)

    found = None
    while not live.isEmpty():
        asked = field.join(live.select(key).distinct(), key, "left_semi")
        part = materialize(map_groups(beside(asked, live), key, run, schema, LINE_ROWS), "lines")
        rows = part.drop("going", *BRICK)
        found = rows if found is None else found.unionByName(rows)
        before, live = live, materialize(part.where("going").drop("going", "speed"), "points")
        discard(before)
    if found is None:
        return flow.sparkSession.createDataFrame([], ", ".join(schema.split(", ")[:8]))
    return found
