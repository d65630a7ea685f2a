"""Canonical tables, one row per voxel, point or value.  A case is a partition of each."""

CASE_META = "case_id string, dims array<int>, spacing array<double>, origin array<double>, venc array<double>, rr double, spatial_order array<string>, venc_order array<string>"
RAW_SIGNAL = "case_id string, i int, j int, k int, t int, ch int, re double, im double"
SEG = "case_id string, i int, j int, k int, t int, label smallint"
FLOW = "case_id string, i int, j int, k int, t int, mag float, vx float, vy float, vz float, sx float, sy float, sz float, tke float"
NODES = "case_id string, node_id int, x double, y double, z double"
EDGES = "case_id string, src int, dst int"
PATH_POINTS = "case_id string, path_id int, seq int, x double, y double, z double"
PLANES = "case_id string, plane_index int, cx double, cy double, cz double, nx double, ny double, nz double, label int, path_id int, distance double"
