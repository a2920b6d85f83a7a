"""Volumes derived from the driver's tables, in SQL that Spark and DuckDB read alike.

{name} stands for a table. The driver's tables hold no volumes, so cells come from line items, bricks and
elements from parts, points from orders, rays from customers, and pixels from events.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Added to doubles before they are rounded to six decimals, on both sides.
NUDGE = 1.23e-8

RELATIONS = {
    "cells": """
SELECT CAST(((lev * 64 + z) * 64 + y) * 64 + x AS BIGINT) AS cell_id, x, y, z, lev AS level, v AS value FROM (
  SELECT CAST(floor(qx / power(2e0, lev)) * power(2e0, lev) AS INT) AS x, CAST(floor(qy / power(2e0, lev)) * power(2e0, lev) AS INT) AS y,
    CAST(floor(qz / power(2e0, lev)) * power(2e0, lev) AS INT) AS z, lev, max(v) AS v
  FROM (SELECT CAST(floor(l_quantity) AS INT) AS qx, CAST(floor(l_extendedprice / 1700e0) AS INT) AS qy, CAST(floor(l_discount * 400e0 + 0.5e0) AS INT) AS qz,
      CAST(l_linenumber % 3 AS INT) AS lev, CAST(l_tax AS DOUBLE) AS v FROM {lineitem}) q GROUP BY 1, 2, 3, 4) g""",
    "strict": """
SELECT c.cell_id, c.x, c.y, c.z, c.level, c.value FROM {cells} c LEFT JOIN (
  SELECT DISTINCT l.level AS plev, CAST(floor(c.x / power(2e0, l.level)) * power(2e0, l.level) AS INT) AS px, CAST(floor(c.y / power(2e0, l.level)) * power(2e0, l.level) AS INT) AS py,
    CAST(floor(c.z / power(2e0, l.level)) * power(2e0, l.level) AS INT) AS pz
  FROM {cells} c JOIN (SELECT DISTINCT level FROM {cells}) l ON c.level < l.level) p
  ON c.level = p.plev AND c.x = p.px AND c.y = p.py AND c.z = p.pz WHERE p.plev IS NULL""",
    "patch": """
SELECT CAST(((lev * 64 + z) * 64 + y) * 64 + x AS BIGINT) AS cell_id, x, y, z, lev AS level, v AS value FROM (
  SELECT CASE WHEN lev = 1 THEN qx - qx % 2 ELSE qx END AS x, CASE WHEN lev = 1 THEN qy - qy % 2 ELSE qy END AS y, CASE WHEN lev = 1 THEN qz - qz % 2 ELSE qz END AS z, lev, max(v) AS v
  FROM (SELECT qx, qy, qz, v, CASE WHEN (qx - qx % 2 + (qy - qy % 2) * 2 + (qz - qz % 2)) % 6 = 0 THEN 1 ELSE 0 END AS lev
    FROM (SELECT CAST(floor(l_quantity / 4e0) AS INT) AS qx, CAST(floor(l_extendedprice / 8500e0) AS INT) AS qy, CAST(floor(l_discount * 100e0 + 0.5e0) AS INT) AS qz, CAST(l_tax AS DOUBLE) AS v FROM {lineitem}) r) q
  GROUP BY 1, 2, 3, 4) g""",
    "points": """
SELECT o_orderkey AS pid, CAST(o_orderkey * 37 % 5100 AS DOUBLE) / 100e0 + 0.005e0 AS px, CAST(o_orderkey * 101 % 6200 AS DOUBLE) / 100e0 + 0.005e0 AS py,
  CAST(o_orderkey * 211 % 4200 AS DOUBLE) / 100e0 + 0.005e0 AS pz FROM {orders}""",
    "bricks": """
SELECT p_partkey AS brick_id, CAST(k.x - k.x % w AS INT) AS lx, CAST(k.y - k.y % w AS INT) AS ly, CAST(k.z - k.z % w AS INT) AS lz, sx, sy, sz, level
FROM (SELECT p_partkey, p_partkey * 37 % 97 AS x, p_partkey * 53 % 101 AS y, p_partkey * 71 % 103 AS z, CAST(1 + p_size % 3 AS INT) AS sx, CAST(1 + p_size % 4 AS INT) AS sy,
  CAST(1 + p_size % 2 AS INT) AS sz, CAST(p_partkey % 2 AS INT) AS level, 1 + p_partkey % 2 AS w FROM {part}) k""",
    "brick_points": """
SELECT o_orderkey AS pid, CAST(o_orderkey * 37 % 9700 AS DOUBLE) / 100e0 + 0.005e0 AS px, CAST(o_orderkey * 101 % 10100 AS DOUBLE) / 100e0 + 0.005e0 AS py,
  CAST(o_orderkey * 211 % 10300 AS DOUBLE) / 100e0 + 0.005e0 AS pz FROM {orders}""",
    "vertices": """
SELECT p_partkey * 8 + c AS vertex_id, bx + (c % 2) * w AS x, b_y + ((c // 2) % 2) * w AS y, bz + (c // 4) * w AS z, CAST((p_partkey * 13 + c * 29) % 100 AS DOUBLE) / 100e0 AS value
FROM (SELECT p_partkey, CAST(p_partkey * 37 % 97 AS DOUBLE) AS bx, CAST(p_partkey * 53 % 101 AS DOUBLE) AS b_y, CAST(p_partkey * 71 % 103 AS DOUBLE) AS bz, 2e0 + p_size % 5 AS w FROM {part}) b
CROSS JOIN (SELECT CAST(l_linenumber AS BIGINT) AS c FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) v(l_linenumber)) c""",
    "rays": """
SELECT c_custkey AS ray_id, -1e0 AS ox, (c_custkey * 37) % 64 + 0.37e0 AS oy, (c_custkey * 53) % 64 + 0.61e0 AS oz, 1e0 AS dx,
  ((c_custkey % 21) - 10) / 17.3e0 + 0.013e0 AS dy, ((c_custkey % 13) - 6) / 11.9e0 + 0.017e0 AS dz, 0e0 AS tmin, 1e20 AS tmax FROM {customer}""",
    "triangles": """
SELECT CAST(s_suppkey AS BIGINT) AS tri_id, 20e0 + s_suppkey % 40 AS ax, CAST(s_suppkey * 17 % 64 AS DOUBLE) AS ay, CAST(s_suppkey * 29 % 64 AS DOUBLE) AS az,
  22e0 + s_suppkey % 40 AS bx, CAST(s_suppkey * 17 % 64 AS DOUBLE) + 12e0 AS b_y, CAST(s_suppkey * 29 % 64 AS DOUBLE) + 1e0 AS bz,
  21e0 + s_suppkey % 40 AS cx, CAST(s_suppkey * 17 % 64 AS DOUBLE) + 2e0 AS cy, CAST(s_suppkey * 29 % 64 AS DOUBLE) + 13e0 AS cz FROM {supplier}""",
    "vectors": """
SELECT vec_id, CAST(embedding[{zero}] AS DOUBLE) AS x, CAST(embedding[{one}] AS DOUBLE) AS y, CAST(embedding[{two}] AS DOUBLE) AS z, CAST(embedding[{three}] AS DOUBLE) AS w FROM {embeddings}""",
    "frames": """
SELECT user_id AS pixel, CAST(extract(hour FROM ts) AS INT) AS frame, event_id, value FROM {events}""",
}

_SPARK = {"zero": "0", "one": "1", "two": "2", "three": "3"}
_DUCK = {"zero": "1", "one": "2", "two": "3", "three": "4"}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation, or one of the driver's tables, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = RELATIONS[name].replace("//", "DIV")
    needed = {n for n in re.findall(r"\{(\w+)\}", sql)} - _SPARK.keys()
    for k, v in _SPARK.items():
        sql = sql.replace("{" + k + "}", v)
    return spark.sql(sql, **{n: relation(spark, sf_dir, n) for n in needed})


def in_sql(name: str) -> str:
    """The same relation as a DuckDB subquery."""
    if name in TABLES:
        return name
    sql = RELATIONS[name]
    for k, v in _DUCK.items():
        sql = sql.replace("{" + k + "}", v)
    return "(" + re.sub(r"\{(\w+)\}", lambda m: in_sql(m[1]), sql) + ")"


def _nudged(sql: str) -> str:
    """round(x, 6) as round(x + NUDGE, 6)."""
    out, starts = "", []
    depth = 0
    for i, c in enumerate(sql):
        if c == "(":
            depth += 1
            if sql[:i].endswith("round"):
                starts.append(depth)
        if starts and depth == starts[-1] and sql.startswith(", 6)", i):
            out += f" + {NUDGE!r}"
            starts.pop()
        if c == ")":
            if starts and depth == starts[-1]:
                starts.pop()
            depth -= 1
        out += c
    return out


def oracle(sql: str) -> str:
    """DuckDB SQL with {name} standing for derived relations and tables, each of them computed once."""
    names: list[str] = []
    sql = _nudged(sql)

    def collect(text: str) -> None:
        for n in re.findall(r"\{(\w+)\}", text):
            if n in RELATIONS and n not in names:
                collect(RELATIONS[n])
                if n not in names:
                    names.append(n)

    collect(sql)
    parts = []
    for n in names:
        body = RELATIONS[n]
        for k, v in _DUCK.items():
            body = body.replace("{" + k + "}", v)
        parts.append(f"{n} AS MATERIALIZED ({re.sub(r'[{](\w+)[}]', r'\1', body)})")
    body = re.sub(r"\{(\w+)\}", r"\1", sql).strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[len("WITH RECURSIVE") :]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body
