"""Schemas of the tables that operators take and give."""

from __future__ import annotations

CELLS = "cell_id long, x int, y int, z int, level int, value double"
BRICKS = "brick_id long, lx int, ly int, lz int, sx int, sy int, sz int, level int, scalars array<double>"
REGIONS = "region_id long, lx double, ly double, lz double, hx double, hy double, hz double, brick_ids array<long>"
GRIDLETS = "gridlet_id long, level int, lx int, ly int, lz int, dx int, dy int, dz int, scalars array<double>"
VERTICES = "vertex_id long, x double, y double, z double, value double"
ELEMENTS = "elem_id long, kind string, vertex_ids array<long>"
CUBES = "level int, lx double, ly double, lz double, scalar_ids array<long>"
TRIANGLES = "mesh_id long, tri_id long, v1 array<double>, v2 array<double>, v3 array<double>"
DOMAINS = "domain_id long, lx double, ly double, lz double, hx double, hy double, hz double, majorant double"
TRANSFER = "i int, r double, g double, b double, a double"
RAYS = "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, tmin double, tmax double"
