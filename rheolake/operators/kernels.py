"""Iterative steps that have no relational form: NumPy on one case (or case and time) at a time, grouped by Spark.

Only voxels of a mask, points of a path or edges of a graph travel, so a group is as large as one case's mask at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rheolake.operators.batches import beside, map_groups
from rheolake.operators.guard import apply_groups
from rheolake.operators.voxel import FACES

ALL_STEPS = tuple(s for s in product((-1, 0, 1), repeat=3) if any(s))


def merge_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of n nodes reaches over edges (a, b): hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while not np.array_equal(up := label[label], label):
            label = up


def lattice_links(ijk: np.ndarray, steps) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ijk that are one of the steps apart."""
    lo = ijk.min(0) - 1
    size = ijk.max(0) - lo + 2
    number = lambda p: ((p[:, 0] - lo[0]) * size[1] + p[:, 1] - lo[1]) * size[2] + p[:, 2] - lo[2]
    own = number(ijk)
    order = np.argsort(own)
    a, b = [], []
    for s in steps:
        other = number(ijk + np.array(s))
        at = np.searchsorted(own[order], other)
        hit = (at < len(own)) & (own[order[np.minimum(at, len(own) - 1)]] == other)
        a.append(np.flatnonzero(hit))
        b.append(order[at[hit]])
    return np.concatenate(a), np.concatenate(b)


def group_links(ijk: np.ndarray, starts: np.ndarray, steps) -> tuple[np.ndarray, np.ndarray]:
    """As lattice_links, of groups of rows that begin at starts; rows of different groups are never linked."""
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(ijk)]))
    lo, hi = np.minimum.reduceat(ijk, starts, axis=0), np.maximum.reduceat(ijk, starts, axis=0)
    span = hi - lo + 3
    if float(span[:, 0].sum()) * float(span[:, 1].max()) * float(span[:, 2].max()) < 2.0**62:
        moved = ijk - lo[group]
        moved[:, 0] += np.r_[0, np.cumsum(span[:-1, 0])][group]  # side by side, apart
        return lattice_links(moved, steps)
    ends = np.r_[starts[1:], len(ijk)]
    parts = [[x + n for x in lattice_links(ijk[n:m], steps)] for n, m in zip(starts, ends, strict=True)]
    return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])


def connected_components(mask: DataFrame, connectivity: int = 6) -> DataFrame:
    """mask(case_id, i, j, k, voxel): adds component, the smallest voxel number that is reached by 6 or 26 neighbours.

    A task has whole cases, many small ones at a time.
    """
    steps = FACES if connectivity == 6 else ALL_STEPS
    kind = mask.schema["voxel"].dataType.simpleString()

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(pdf)]))
        pdf = pdf.iloc[np.lexsort((pdf["voxel"].to_numpy(), group))].reset_index(drop=True)
        label = merge_labels(len(pdf), *group_links(pdf[["i", "j", "k"]].to_numpy(np.int64), starts, steps))
        return pdf.assign(component=pdf["voxel"].to_numpy()[label])

    schema = f"case_id {mask.schema['case_id'].dataType.simpleString()}, i int, j int, k int, voxel {kind}, component {kind}"
    return map_groups(mask.select("case_id", "i", "j", "k", "voxel"), ["case_id"], run, schema)


def gaussian_mask(components: DataFrame, sigma: float = 0.5, threshold: float = 0.5) -> DataFrame:
    """Each component smoothed inside its own box (mirrored borders, cut at four sigma), then cut above the threshold."""
    radius = int(4 * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    taps /= taps.sum()

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        ijk, case = pdf[["i", "j", "k"]].to_numpy(np.int64), pdf["case_id"].to_numpy()
        counts = np.diff(np.r_[starts, len(pdf)])
        lo = np.minimum.reduceat(ijk, starts)
        sizes, kind = np.unique(np.maximum.reduceat(ijk, starts) - lo + 1, axis=0, return_inverse=True)
        alike, ends = np.argsort(kind.ravel(), kind="stable"), np.cumsum(np.bincount(kind.ravel(), minlength=len(sizes)))
        found = []
        for size, first, last in zip(sizes, np.r_[0, ends[:-1]], ends, strict=True):  # boxes of a size, side by side
            many = max(1, BOX_CELLS // int(size.prod()))
            for at in range(first, last, many):
                own = alike[at : min(at + many, last)]
                number = np.repeat(np.arange(len(own)), counts[own])
                rows = np.arange(len(number)) + np.repeat(starts[own] - np.cumsum(counts[own]) + counts[own], counts[own])
                box = np.zeros((len(own), *size))
                box[(number, *(ijk[rows] - lo[own][number]).T)] = 1
                for axis in (1, 2, 3):
                    padded = np.pad(box, [(radius, radius) if a == axis else (0, 0) for a in range(4)], mode="symmetric")
                    box = sum(w * np.take(padded, np.arange(n, n + box.shape[axis]), axis) for n, w in enumerate(taps))
                kept = np.argwhere(box > threshold)
                group = own[kept[:, 0]]
                place = (kept[:, 1:] + lo[group]).astype(np.int32)
                found.append(pd.DataFrame({"case_id": case[starts[group]]} | {c: place[:, n] for n, c in enumerate("ijk")}))
        return pd.concat(found, ignore_index=True)

    schema = f"case_id {components.schema['case_id'].dataType.simpleString()}, i int, j int, k int"
    return map_groups(components.select("case_id", "component", "i", "j", "k"), ["case_id", "component"], run, schema)


# ------------------------------------------------------------------------------------------------------------- thinning

_PLACES = {s: n for n, s in enumerate(product((-1, 0, 1), repeat=3))}
_CENTRE = 13
_NEAR26 = {a: [b for s, b in _PLACES.items() if b != _CENTRE and b != a and max(abs(x - y) for x, y in zip(s, t, strict=True)) == 1] for t, a in _PLACES.items() if a != _CENTRE}
_IN18 = {n for s, n in _PLACES.items() if 0 < sum(map(abs, s)) <= 2}
_NEAR6 = {a: [b for s, b in _PLACES.items() if b in _IN18 and sum(abs(x - y) for x, y in zip(s, t, strict=True)) == 1] for t, a in _PLACES.items() if a in _IN18}
_FACE_PLACES = [_PLACES[s] for s in FACES]


def _pieces(members: set[int], near: dict[int, list[int]], roots) -> int:
    """Connected pieces of members that hold one of the roots."""
    left, count = set(members), 0
    for r in roots:
        if r in left:
            count += 1
            agenda = [r]
            left.discard(r)
            while agenda:
                for b in near[agenda.pop()]:
                    if b in left:
                        left.discard(b)
                        agenda.append(b)
    return count


def is_simple(around: np.ndarray) -> bool:
    """Whether removing the centre of a 3x3x3 block changes no component, tunnel or hole (26 inside, 6 outside)."""
    flat = around.ravel()
    inside = {n for n in range(27) if flat[n] and n != _CENTRE}
    if _pieces(inside, _NEAR26, sorted(inside)) != 1:
        return False
    return _pieces(_IN18 - inside, _NEAR6, _FACE_PLACES) == 1


_BITS = 1 << np.arange(27, dtype=np.int64)


def _spread_tables(near: dict[int, list[int]]) -> list[np.ndarray]:
    """For each third of a block's 27 bits: the bits near any of those set."""
    one = np.array([sum(1 << b for b in near.get(a, ())) for a in range(27)], np.int64)
    return [np.array([np.bitwise_or.reduce(one[k : k + 9][(v >> np.arange(9) & 1) > 0], initial=0) for v in range(512)], np.int64) for k in (0, 9, 18)]


_SPREAD26, _SPREAD6 = _spread_tables(_NEAR26), _spread_tables(_NEAR6)
_ROUND18, _ROUND6 = (sum(1 << n for n in x) for x in (_IN18, _FACE_PLACES))


def _flood(seed: np.ndarray, within: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    while True:
        more = (seed | tables[0][seed & 511] | tables[1][seed >> 9 & 511] | tables[2][seed >> 18]) & within
        if np.array_equal(more, seed):
            return seed
        seed = more


def may_go(codes: np.ndarray) -> np.ndarray:
    """Whether the centres of 3x3x3 blocks, read as 27 bits, are simple and no ends of lines: is_simple for many at once."""
    inside = codes & ~(1 << _CENTRE)
    whole = _flood(inside & -inside, inside, _SPREAD26) == inside
    outside = ~codes & _ROUND18
    faces = outside & _ROUND6
    open_ = (faces > 0) & (faces & ~_flood(faces & -faces, outside, _SPREAD6) == 0)
    return whole & open_ & (np.bitwise_count(inside) > 1)


def peel(flat: np.ndarray, shape: tuple[int, int, int], cells: np.ndarray, face: int, odd: np.ndarray | None = None) -> np.ndarray:
    """One face's border loses what may go; the cells that are left.  flat: a box with an empty rim; cells: its filled places.

    The border is taken in eight classes of even and odd places: voxels of a class do not touch each other, so they go all
    at once and no line is eaten from its end.  odd: 4, 2, 1 for each axis along which a cell's place counts as one more.
    """
    _, sy, sz = shape
    around = np.array([(i * sy + j) * sz + k for i, j, k in _PLACES])
    is_border = ~flat[cells + around[_FACE_PLACES[face]]]
    border = cells[is_border]
    kind = 4 * (border // (sy * sz) % 2) + 2 * (border // sz % sy % 2) + border % sz % 2
    if odd is not None:
        kind ^= odd[is_border]
    for own in range(8):
        here = border[kind == own]
        if len(here):
            flat[here[may_go(flat[here[:, None] + around] @ _BITS)]] = False
    return cells[flat[cells]]


#: Most cells of a box in which groups are thinned together.
BOX_CELLS = 4_000_000


def laid_out(ijk: np.ndarray, starts: np.ndarray):
    """Boxes with many sets of voxels, one after the other along the first axis, an empty layer around each; a set is the
    rows from one start to the next.  Yields the rows of a box, their cells, the box's shape, and its sets' numbers.

    A set takes an even number of layers, so that a cell's places are even or odd as they are in the set's own box.
    """
    counts = np.diff(np.r_[starts, len(ijk)])
    lo, hi = np.minimum.reduceat(ijk, starts), np.maximum.reduceat(ijk, starts)
    size = hi - lo + 3
    length = size[:, 0] + size[:, 0] % 2
    first = 0
    while first < len(starts):
        last, wide, far = first + 1, size[first, 1:].copy(), length[first]
        while last < len(starts):
            grown = np.maximum(wide, size[last, 1:])
            if (far + length[last]) * grown.prod() > BOX_CELLS:
                break
            wide, far, last = grown, far + length[last], last + 1
        sets = np.arange(first, last)
        rows = slice(starts[first], starts[first] + counts[sets].sum())
        place = ijk[rows] - np.repeat(lo[sets] - 1, counts[sets], axis=0)
        place[:, 0] += np.repeat(np.cumsum(length[sets]) - length[sets], counts[sets])
        yield rows, (place[:, 0] * wide[0] + place[:, 1]) * wide[1] + place[:, 2], (int(far), int(wide[0]), int(wide[1])), sets
        first = last


def thin_many(ijk: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which voxels of many sets are in their skeletons (see laid_out)."""
    kept = np.zeros(len(ijk), bool)
    for rows, cell, shape, _ in laid_out(ijk, starts):
        flat = np.zeros(int(np.prod(shape)), bool)
        flat[cell] = True
        cells, before = np.sort(cell), -1
        while len(cells) != before:
            before = len(cells)
            for face in range(6):
                cells = peel(flat, shape, cells, face)
        kept[rows] = flat[cell]
    return kept


def thin(ijk: np.ndarray) -> np.ndarray:
    """The one-voxel-wide skeleton of a set of voxels: simple border voxels go, side by side, ends of lines stay."""
    ijk = np.unique(ijk, axis=0)
    return ijk[thin_many(ijk, np.zeros(1, np.int64))]


def skeletonize(components: DataFrame) -> DataFrame:
    """components(case_id, i, j, k, component): the skeleton's voxels."""

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        return pdf[thin_many(pdf[["i", "j", "k"]].to_numpy(np.int64), starts)]

    types = {f.name: f.dataType.simpleString() for f in components.schema}
    schema = f"case_id {types['case_id']}, i int, j int, k int, component {types['component']}"
    return map_groups(components.select("case_id", "i", "j", "k", "component").distinct(), ["case_id", "component"], run, schema)


# ---------------------------------------------------------------------------------------------------------------- paths


def savgol(values: np.ndarray, window: int, order: int) -> np.ndarray:
    """Least-squares polynomial smoothing; the ends take the fit of the first and last window, end points stay."""
    n = len(values)
    window += window % 2 == 0
    window = min(window, n if n % 2 else n - 1)
    if n <= order or window <= order:
        return values
    half = window // 2
    powers = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    fit = np.linalg.pinv(powers)
    out = values.copy()
    spans = np.lib.stride_tricks.sliding_window_view(values, window, axis=0)
    out[half : n - half] = spans @ fit[0]
    for rows, at in ((slice(0, half), slice(0, window)), (slice(n - half, n), slice(n - window, n))):
        places = np.arange(-half, 0) if rows.start == 0 else np.arange(1, half + 1)
        out[rows] = np.vander(places, order + 1, increasing=True) @ (fit @ values[at])
    out[0], out[-1] = values[0], values[-1]
    return out


def smooth_paths(points: DataFrame, window: int = 15, order: int = 3) -> DataFrame:
    """path_points(case_id, path_id, seq, x, y, z) smoothed path by path."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", ignore_index=True)
        pdf[["x", "y", "z"]] = savgol(pdf[["x", "y", "z"]].to_numpy(float), window, order)
        return pdf

    rows = points.select("case_id", "path_id", "seq", "x", "y", "z")
    return apply_groups(rows, ["case_id", "path_id"], run, rows.schema)


def prune_triangles(edges: DataFrame) -> DataFrame:
    """edges(case_id, src, dst, in_triangle): without those of triangles that connectivity can spare.

    Deleting such edges in ascending order, unless one is a bridge by then, leaves what joining them in descending order
    to the other edges would add.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"], ignore_index=True)
        nodes, flat = np.unique(pdf[["src", "dst"]].to_numpy(), return_inverse=True)
        ends = flat.reshape(-1, 2)
        triangle = pdf["in_triangle"].to_numpy()
        root = merge_labels(len(nodes), ends[~triangle, 0], ends[~triangle, 1]).tolist()

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        keep = ~triangle
        for e in np.flatnonzero(triangle)[::-1]:
            a, b = find(int(ends[e, 0])), find(int(ends[e, 1]))
            if a != b:
                root[a] = b
                keep[e] = True
        return pdf[keep][["case_id", "src", "dst"]]

    types = {f.name: f.dataType.simpleString() for f in edges.schema}
    return apply_groups(edges, ["case_id"], run, f"case_id {types['case_id']}, src {types['src']}, dst {types['dst']}")


def trace_paths(edges: DataFrame) -> DataFrame:
    """Chains between key nodes (degree 1, or 3 and more) as path_nodes(case_id, path_id, seq, node_id).

    Rings without a key node and nodes without edges give no path.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for a, b in sorted(zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True)):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        keys = {n for n, x in near.items() if len(x) != 2}
        seen: set[tuple[int, int]] = set()
        rows = []
        for start in sorted(keys):
            for step in sorted(near[start]):
                if (start, step) in seen:
                    continue
                chain, here = [start], step
                seen |= {(start, step), (step, start)}
                while here not in keys:
                    behind = chain[-1]
                    chain.append(here)
                    a, b = near[here]
                    ahead = b if a == behind else a
                    seen |= {(here, ahead), (ahead, here)}
                    here = ahead
                chain.append(here)
                rows.append(chain)
        case = pdf["case_id"].iloc[0]
        flat = [(case, p, s, n) for p, chain in enumerate(rows) for s, n in enumerate(chain)]
        return pd.DataFrame(flat, columns=["case_id", "path_id", "seq", "node_id"])

    types = {f.name: f.dataType.simpleString() for f in edges.schema}
    return apply_groups(edges, ["case_id"], run, f"case_id {types['case_id']}, path_id int, seq int, node_id {types['src']}")


# --------------------------------------------------------------------------------------------------- planes and surfaces


def nearest_region(cut: DataFrame) -> DataFrame:
    """cut(case_id, plane_index, i, j, k, area, cx, cy, cz, ...): of each plane only the connected region nearest its centre.

    Regions are 26-connected sets of cut voxels; nearest first, then the larger area, then the first voxel.  With polygons
    (px, py, pz) a region is as near as the nearest of their centroids; without, as the middle of its voxels, by area.
    """
    by_polygon = "px" in cut.columns

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(pdf)]))
        ijk = pdf[["i", "j", "k"]].to_numpy(np.int64)
        order = np.lexsort((ijk[:, 2], ijk[:, 1], ijk[:, 0], group))
        pdf, ijk = pdf.iloc[order].reset_index(drop=True), ijk[order]
        label = merge_labels(len(pdf), *group_links(ijk, starts, ALL_STEPS))
        area, centre = pdf["area"].to_numpy(), pdf[["cx", "cy", "cz"]].to_numpy()
        weight = np.bincount(label, area, len(pdf))
        if by_polygon:  # nine decimals: what is as near, or as large, but for rounding is a tie
            weight = weight.round(9)
            distance = np.full(len(pdf), np.inf)
            np.minimum.at(distance, label, np.linalg.norm(pdf[["px", "py", "pz"]].to_numpy() - centre, axis=1).round(9))
        else:
            middle = np.stack([np.bincount(label, area * (ijk[:, n] + 0.5), len(pdf)) for n in range(3)], 1) / np.maximum(weight, 1e-300)[:, None]
            distance = np.linalg.norm(middle - centre, axis=1)
        regions = np.unique(label)
        ranked = regions[np.lexsort((regions, -weight[regions], distance[regions], group[regions]))]
        best = ranked[np.unique(group[ranked], return_index=True)[1]]  # the first of each group
        return pdf[np.isin(label, best)]

    return map_groups(cut, ["case_id", "plane_index"], run, cut.schema)


def smooth_surface(vertices: DataFrame, edges: DataFrame, rounds: int = 200, relaxation: float = 0.01) -> DataFrame:
    """vertices(case_id, vid, x, y, z) moved towards the mean of their neighbours over edges(case_id, src, dst)."""

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(pdf)]))
        is_edge = pdf["_second"].to_numpy(bool)
        ids, number = np.unique(pdf[["vid", "dst"]].to_numpy(), return_inverse=True)
        number = group[:, None] * len(ids) + number.reshape(-1, 2)  # a case's own numbers
        rows = np.flatnonzero(~is_edge)
        rows = rows[np.argsort(number[rows, 0], kind="stable")]
        own, ends = number[rows, 0], np.unique(number[is_edge], axis=0)
        a, b = (np.searchsorted(own, e, "right") - 1 for e in ends.T)
        if len(ends) and (not len(own) or (own[a] != ends[:, 0]).any() or (own[b] != ends[:, 1]).any()):
            raise ValueError("an edge ends where no vertex is")
        a, b = np.r_[a, b], np.r_[b, a]
        count = np.bincount(a, minlength=len(rows))
        out = pdf[["case_id", "vid", "x", "y", "z"]].iloc[rows].reset_index(drop=True)
        p = out[["x", "y", "z"]].to_numpy(float)
        free = count > 0
        for _ in range(rounds):
            mean = np.stack([np.bincount(a, p[b, n], len(p)) for n in range(3)], 1)[free] / count[free, None]
            p[free] += relaxation * (mean - p[free])
        out[["x", "y", "z"]] = p
        return out

    rows = vertices.select("case_id", "vid", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    return map_groups(beside(rows, edges.select("case_id", F.col("src").alias("vid"), "dst")), ["case_id"], run, rows.schema)


class Field:
    """Velocities (m/s) of voxels, zero elsewhere, and fourth-order steps of equal length along them; of many groups of voxels,
    the rows from one start to the next, whose number each point names."""

    def __init__(self, ijk: np.ndarray, cm_per_s: np.ndarray, cell_size: np.ndarray, step: float, starts: np.ndarray):
        self.lo, self.cell_size, self.step = np.minimum.reduceat(ijk, starts), cell_size, step
        self.size = np.maximum.reduceat(ijk, starts) - self.lo + 1
        cells = self.size.prod(1)
        self.first = np.cumsum(cells) - cells
        self.box = np.zeros((cells.sum(), 3))
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(ijk)]))
        self.box[self.number(ijk - self.lo[group], group)] = cm_per_s

    def number(self, cell: np.ndarray, group: np.ndarray) -> np.ndarray:
        return self.first[group] + (cell[:, 0] * self.size[group, 1] + cell[:, 1]) * self.size[group, 2] + cell[:, 2]

    def at(self, p: np.ndarray, group: np.ndarray) -> np.ndarray:
        cell = np.floor(p).astype(np.int64) - self.lo[group]
        inside = ((cell >= 0) & (cell < self.size[group])).all(1)
        out = np.zeros((len(p), 3))
        out[inside] = self.box[self.number(cell[inside], group[inside])] / 100.0
        return out

    def speed(self, p: np.ndarray, group: np.ndarray) -> np.ndarray:
        return np.linalg.norm(self.at(p, group), axis=1)

    def unit(self, p: np.ndarray, way: np.ndarray | float, group: np.ndarray) -> np.ndarray:
        v = self.at(p, group)
        return way * v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12) / self.cell_size

    def ahead(self, p: np.ndarray, way: np.ndarray | float, group: np.ndarray) -> np.ndarray:
        step = self.step
        k1 = self.unit(p, way, group)
        k2 = self.unit(p + step / 2 * k1, way, group)
        k3 = self.unit(p + step / 2 * k2, way, group)
        k4 = self.unit(p + step * k3, way, group)
        return p + step / 6 * (k1 + 2 * k2 + 2 * k3 + k4)


#: Rows after which lines are followed: a row may begin a long one.
LINE_ROWS = 20_000


def fields(pdf: pd.DataFrame, starts: np.ndarray, cell_size: np.ndarray, step: float) -> Iterator[tuple[Field, np.ndarray, np.ndarray]]:
    """The fields of groups of voxels and points (see beside) that have both, BOX_CELLS cells at a time, with the rows of
    their points and the points' groups in the field."""
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(pdf)]))
    is_point = pdf["_second"].to_numpy(bool)
    both = np.intersect1d(group[~is_point], group[is_point])
    if not len(both):
        return
    of = np.full(len(starts), -1)
    of[both] = np.arange(len(both))
    voxels, points = (np.flatnonzero(kind & (of[group] >= 0)) for kind in (~is_point, is_point))
    ijk, speeds = pdf[["i", "j", "k"]].to_numpy(np.int64)[voxels], pdf[["vx", "vy", "vz"]].to_numpy(float)[voxels]
    begin, ask = (np.searchsorted(of[group[rows]], np.arange(len(both) + 1)) for rows in (voxels, points))
    cells = (np.maximum.reduceat(ijk, begin[:-1]) - np.minimum.reduceat(ijk, begin[:-1]) + 1).prod(1)
    first = 0
    while first < len(both):
        last, held = first + 1, cells[first]
        while last < len(both) and held + cells[last] <= BOX_CELLS:
            held, last = held + cells[last], last + 1
        own, asked = slice(begin[first], begin[last]), points[ask[first] : ask[last]]
        yield Field(ijk[own], speeds[own], cell_size, step, begin[first:last] - begin[first]), asked, of[group[asked]] - first
        first = last


def streamlines(flow: DataFrame, seeds: DataFrame, spacing=(1.0, 1.0, 1.0), step: float = 0.5, max_steps: int = 2000, least_speed: float = 0.01) -> DataFrame:
    """Lines of the flow(case_id, t, i, j, k, vx, vy, vz in cm/s) through seeds(case_id [, t], line_id, x, y, z), in voxel units.

    Fourth-order steps of equal length in space (``step`` times the least spacing), both ways from the seed (seq counts from
    it, negative upstream), until the flow is slower than least_speed (m/s, like speed), the line leaves the mask, or the
    steps run out.  A case and time is in one task, which follows many small ones at a time.
    """
    cell_size = np.array(spacing, float)
    step = step * cell_size.min()

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        columns = ["case_id", "t", "line_id", "seq", "x", "y", "z", "speed"]
        places, parts = pdf[["x", "y", "z"]].to_numpy(float), []
        for along, rows, group in fields(pdf, starts, cell_size, step):
            speed = along.speed(places[rows], group)
            good = speed >= least_speed
            rows, group = rows[good], group[good]
            parts.append((rows, np.zeros(len(rows), int), places[rows], speed[good]))
            for way in (1.0, -1.0):
                p, row, own = places[rows], rows, group
                for n in range(1, max_steps + 1):
                    p = along.ahead(p, way, own)
                    s = along.speed(p, own)
                    on = s >= least_speed
                    p, row, own = p[on], row[on], own[on]
                    if not len(p):
                        break
                    parts.append((row, np.full(len(p), int(way) * n), p, s[on]))
        if not parts:
            return pd.DataFrame(columns=columns)
        row, seq, p, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((seq, row))
        named = pdf[["case_id", "t", "line_id"]].iloc[row[order]].reset_index(drop=True)
        return named.assign(seq=seq[order], x=p[order, 0], y=p[order, 1], z=p[order, 2], speed=s[order])[columns]

    kinds = {f.name: f.dataType.simpleString() for f in flow.schema}
    at_times = seeds if "t" in seeds.columns else seeds.join(flow.select("case_id", "t").distinct(), "case_id")
    every = at_times.select("case_id", "t", "line_id", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    schema = f"case_id {kinds['case_id']}, t {kinds['t']}, line_id {dict(seeds.dtypes)['line_id']}, seq int, x double, y double, z double, speed double"
    return map_groups(beside(flow.select("case_id", "t", "i", "j", "k", "vx", "vy", "vz"), every), ["case_id", "t"], run, schema, LINE_ROWS)
