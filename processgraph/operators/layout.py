"""Coordinates of orbits, cones, pages and chapters as Column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

R1, R2 = 0.3, 0.1
GOLDEN = 1.618


def around(x: Column, y: Column, radius: float, n: Column, most: Column) -> tuple[Column, Column]:
    """Place n of most on a circle; inner and outer orbits are turned against each other."""
    turn = {R1: -math.pi / 6, R2: math.pi / 6}.get(radius, 0.0)
    angle = F.lit(turn) + 2 * math.pi * n / F.greatest(most, F.lit(1))
    return x + radius * F.cos(angle), y + radius * F.sin(angle)


def orbit_coordinates(orbit: DataFrame) -> DataFrame:
    """Adds x, y to an orbit (stindex, place, radius): satellites of radius 1 lie around the origin, those of 2 around the one before them."""
    order = Window.orderBy("stindex", "place")
    own = orbit.withColumn("i1", F.sum((F.col("radius") == 1).cast("int")).over(order) - 1).withColumn("i2", F.sum((F.col("radius") == 2).cast("int")).over(order) - 1)
    every = Window.partitionBy(F.lit(1))
    own = own.withColumn("n1", F.sum((F.col("radius") == 1).cast("int")).over(every)).withColumn("n2", F.sum((F.col("radius") == 2).cast("int")).over(every))
    ax, ay = around(F.lit(0.0), F.lit(0.0), R1, F.col("i1"), F.col("n1"))
    bx, by = around(ax, ay, R2, F.col("i2"), F.col("n2"))
    pick = lambda a, b: F.when(F.col("radius") == 1, a).when((F.col("radius") == 2) & (F.col("i1") >= 0), b).otherwise(0.0)
    return own.withColumn("x", pick(ax, bx)).withColumn("y", pick(ay, by)).drop("i1", "i2", "n1", "n2")


def grid(placed: DataFrame, nth: int = 1, lanes: int = 1) -> DataFrame:
    """Adds x, z to (node, depth, slot): depth from 1 runs along z, slots from 1 share the lane evenly."""
    width = 2.0 / max(lanes, 1)
    n = F.count("*").over(Window.partitionBy("depth"))
    deepest = F.broadcast(placed.agg(F.max("depth").alias("__most")))
    x = (nth - 1) * width - 1.0 + width / (n + 1) * F.col("slot")
    return placed.withColumn("x", x).crossJoin(deepest).withColumn("z", -1.0 + 2.0 / F.col("__most") * (F.col("depth") - 1)).drop("__most")


def cone_coordinates(paths: DataFrame, nth: int = 1, lanes: int = 1) -> DataFrame:
    """(node, depth, slot, x, z): each node at the least depth that reaches it, in the order of the paths."""
    at = paths.select("pos", "key", F.posexplode("links.dst").alias("i", "node"))
    first = at.groupBy("node").agg(F.min(F.struct("i", "pos", "key")).alias("f")).select("node", (F.col("f.i") + 1).alias("depth"), F.col("f.pos").alias("pos"), F.col("f.key").alias("key"))
    slot = F.row_number().over(Window.partitionBy("depth").orderBy("pos", "key"))
    return grid(first.withColumn("slot", slot).select("node", "depth", "slot"), nth, lanes)


def story_coordinates(axis: DataFrame, nth: int = 1, lanes: int = 1, limit: int = 100) -> DataFrame:
    """(node, depth, slot, x, z) along an axis (step, node); a node met before keeps its first place."""
    own = axis.where(F.col("step") <= limit).groupBy("node").agg(F.min("step").alias("depth")).withColumn("slot", F.lit(1))
    return grid(own, nth, lanes)


def page_coordinates(lines: DataFrame) -> DataFrame:
    """(node, x, y, z) of page lines (chapter, line, path): leaders on the z axis, the others on circles around them."""
    at = lines.select("chapter", "line", F.posexplode("path.dst").alias("i", "node"), F.element_at("path", 1)["dst"].alias("leader"))
    first = at.groupBy("node").agg(F.min(F.struct("chapter", "line", "i", "leader")).alias("f")).select("node", "f.*")
    order = Window.orderBy("chapter", "line")
    lead = first.where("i = 0").withColumn("k", F.row_number().over(order) - 1)
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    lead = lead.withColumn("z", -1.0 + F.col("k") * 2.0 / n).select(F.col("node").alias("leader"), "z")
    ring = Window.partitionBy("leader")
    sat = first.where("i > 0").withColumn("j", F.row_number().over(ring.orderBy("chapter", "line", "i")) - 1).withColumn("m", F.count("*").over(ring)).join(lead, "leader")
    radius, angle = 0.5 + 0.2 * F.col("z"), 2 * math.pi * F.col("j") / F.col("m")
    return lead.select(F.col("leader").alias("node"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "z").unionByName(sat.select("node", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"), "z"))


def sphere(rho: Column | float, lat: Column, lon: Column) -> Column:
    r = F.lit(rho) if isinstance(rho, float) else rho
    return F.struct((-r * F.sin(lon)).alias("x"), (r * F.sin(lat)).alias("y"), (r * F.cos(lon) * F.cos(lat)).alias("z"))


def chapter_angles(n: Column, total: Column) -> tuple[Column, Column]:
    """Latitude and longitude of chapter n on a golden spiral."""
    lat = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2.0 * n / (2.0 * total + 1))))
    lon = 2 * math.pi * n / GOLDEN
    lon = F.when(lon < -math.pi, lon + 2 * math.pi).when(lon > math.pi, lon - 2 * math.pi).otherwise(lon)
    return lat, lon


def chapter_coordinates(n: Column, total: Column) -> Column:
    return sphere(0.75, *chapter_angles(n, total))


def _near(lat: Column, lon: Column, n: Column, total: Column, rho: Column | float, spread: float) -> Column:
    dlon, dlat = spread * F.sin(2 * math.pi * n / total), spread * F.cos(2 * math.pi * n / total)
    return F.when(total == 1, sphere(rho, lat, lon)).otherwise(sphere(rho, lat + dlat, lon + dlon))


def context_coordinates(lat: Column, lon: Column, n: Column, total: Column) -> Column:
    """Around a chapter's place."""
    return _near(lat, lon, n, total, 0.85, math.pi / 8)


def fragment_coordinates(lat: Column, lon: Column, n: Column, total: Column) -> Column:
    """Around a context's place, at two distances in turn."""
    return _near(lat, lon, n, total, F.lit(0.3) + (n % 2) * 0.1, math.pi / 12)
