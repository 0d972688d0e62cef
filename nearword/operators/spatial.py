"""Joins of objects of interest with scored features by place.

:func:`distance_join` gives pairs, where they are many in blocks of bounded size. :func:`best_neighbour`
gives each object the best score in its neighbourhood without forming all pairs: features are summed up in a
quadtree of cells (bounding box, largest score), and objects descend it a few cells at a time, dropping cells
that cannot hold their answer, also those that could only equal what another is sure to hold. The tree is as
deep as its fullest cell needs. So rows stay in proportion to the objects, however dense or skewed the
features are, and however many of them have the same score.

Objects are rows (id, lat, lon), features rows (id, lat, lon, theta). Rows with a null place are in no
neighbourhood. Repeated features weigh once, repeated objects are answered row by row as one id.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearword.functions import formulas
from nearword.functions.formulas import INFLUENCE, NEAREST, RANGE
from nearword.plans.scratch import cut

#: Features that a lowest cell holds on average over the bounding box, and that it holds at most, unless it is of the deepest level.
LEAF, FULLEST, DEEPEST = 8, 256, 24
#: Levels that a descent takes at a time.
STEP = 2
#: Levels with 4**8 = 65,536 cells at most are broadcast, so no cell near the root is a key that all objects share.
BROADCAST_LEVEL = 8
_SLACK = 1 + 1e-12
#: A distance join of more pairs of neighbouring cells than MANY_PAIRS is done in blocks of about BLOCK objects by BLOCK features.
MANY_PAIRS, BLOCK, MOST_TASKS = 1 << 28, 4096, 10_000
#: Its cells are then a FINE-th of the radius wide: fewer pairs of neighbouring cells are too far apart.
FINE = 3
#: So many cells of more than a block are broadcast at most.
BROADCAST_CELLS = 131_072


def distance_join(objects: DataFrame, features: DataFrame, radius: float) -> DataFrame:
    """(object_id, feature_id, distance) of the pairs within ``radius``, boundary included.

    Cells slightly wider than the radius: a pair's cells are neighbours, so features go to nine cells, objects
    to one, and an equi-join on the cell with the exact condition gives every pair once. The work is in the
    pairs, not in the bytes that Spark deals tasks by, so where they are many, full cells are cut into blocks
    and the tasks are as many as the pairs need. Then too, pairs come in an order that Parquet stores in fewer bytes.
    """
    if radius < 0:
        raise ValueError("a negative radius")
    o = objects.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.col("id").alias("object_id"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    f = features.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.col("id").alias("feature_id"), F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"))
    dist = formulas.distance(F.col("o_lat"), F.col("o_lon"), F.col("f_lat"), F.col("f_lon"))
    if radius == 0:
        met = o.join(f, (o["o_lat"] == f["f_lat"]) & (o["o_lon"] == f["f_lon"]))
        return met.select("object_id", "feature_id", dist.alias("distance"))
    left, right = _by_cell(o, "o", radius), _by_cell(f, "f", radius)
    pairs = _pairs(_numbers(left), _around(_numbers(right), _steps(1)), ["cx", "cy"]).agg(F.sum("pairs")).first()[0] or 0
    # features are streamed and a key's objects held: these are of one cell, the features of those around it
    met = _around(right, _steps(1)).join(left, ["cx", "cy"]) if pairs <= MANY_PAIRS else reduce(DataFrame.union, _parts(o, f, radius))
    return met.withColumn("distance", dist).where(F.col("distance") <= radius).select("object_id", "feature_id", "distance")


def _parts(o: DataFrame, f: DataFrame, radius: float) -> list[DataFrame]:
    """The pairs of neighbouring cells a third as wide, in four parts by whether the cells are two or more apart in lat and in lon.

    Where places lie on a grid, a part has fewer different distances than all pairs, so that dictionaries of
    Parquet can hold a file's. A writer keeps its dictionary only if values of its first page repeat:
    pairs of one and the same cell, which have the fewest, come first, and a part has those of every fourth cell.
    """
    left, own = (cut(_by_cell(df, side, radius / FINE), f"join-{side}") for df, side in ((o, "o"), (f, "f")))
    n_left, n_own = (cut(_numbers(df), "join-cells") for df in (left, own))
    met, keys = [], ["apart", "cx", "cy"]
    for part in range(4):
        mine = F.col("apart") | (F.pmod(F.xxhash64("cx", "cy"), F.lit(4)) == part)
        steps = [(dx, dy) for dx, dy in _steps(FINE) if (dx, dy) == (0, 0) or (abs(dx) > 1) + 2 * (abs(dy) > 1) == part]
        objects, n_objects = (df.withColumn("apart", F.explode(F.array(F.lit(False), F.lit(True)))).where(mine) for df in (left, n_left))
        features, n_features = (_around(df, steps).withColumn("apart", (F.col("dx") != 0) | (F.col("dy") != 0)).drop("dx", "dy").where(mine) for df in (own, n_own))
        cells = cut(_pairs(n_objects, n_features, keys), "join-cells")
        full = (F.col("n_objects") > BLOCK) | (F.col("n_features") > BLOCK)
        pairs, n_full = cells.agg(F.sum("pairs"), F.count_if(full)).first()
        if not pairs:
            continue
        blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int").alias(n)
        counts = cells.where(full).select(*keys, blocks("n_objects"), blocks("n_features"))
        counts = F.broadcast(counts) if n_full <= BROADCAST_CELLS else counts
        objects, features = (_in_blocks(df, counts, keys, *names) for df, names in ((objects, ("o", "n_objects", "n_features")), (features, ("f", "n_features", "n_objects"))))
        by, tasks = ["place", *keys, "bo", "bf"], min(MOST_TASKS, math.ceil(pairs / BLOCK**2))
        # what is not apart comes first when sorted; of a key's columns, Spark compares the first alone mostly
        place = F.when(F.col("apart"), F.lit(1 << 62)).otherwise(F.lit(0)) + F.shiftrightunsigned(F.xxhash64("cx", "cy", "bo", "bf"), 2)
        objects, features = (df.withColumn("place", place) for df in (objects, features))
        met.append(features.repartition(tasks, *by).join(objects.repartition(tasks, *by).hint("merge"), by))
    return met


def _by_cell(df: DataFrame, side: str, radius: float) -> DataFrame:
    """Rows with their cell (cx, cy), slightly wider than ``radius``."""
    return df.withColumns({c: F.floor(F.col(f"{side}_{x}") / (radius * (1 + 1e-9))) for c, x in (("cx", "lat"), ("cy", "lon"))})


def _steps(reach: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)]


def _around(df: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """Rows once for each cell that one of ``steps`` (dx, dy) leads to from theirs."""
    step = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps]))
    return df.select("*", step.alias("step")).select("*", "step.dx", "step.dy").drop("step").withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")})


def _numbers(df: DataFrame) -> DataFrame:
    """How many rows a cell has, as n."""
    return df.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))


def _pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of objects, features and pairs by key, of the keys that both have."""
    n_objects, n_features = (df.groupBy(*keys).agg(F.sum("n").alias(name)) for df, name in ((left, "n_objects"), (right, "n_features")))
    return n_objects.join(n_features, keys).withColumn("pairs", F.col("n_objects").cast("double") * F.col("n_features"))


def _in_blocks(df: DataFrame, counts: DataFrame, keys: list[str], side: str, own: str, other: str) -> DataFrame:
    """Rows with ``bo`` and ``bf``: each in one of its cell's blocks of its ``side``, o or f, and in all of the other side's."""
    facing = "bf" if side == "o" else "bo"
    row = F.xxhash64(*[c for c in df.columns if c.startswith(("object", "feature", f"{side}_"))])
    met = df.join(counts, keys, "left").withColumn(f"b{side}", F.pmod(row, F.coalesce(own, F.lit(1))).cast("int"))
    return met.withColumn(facing, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("n_objects", "n_features")


def nearest_with_ties(objects: DataFrame, features: DataFrame) -> DataFrame:
    """(object_id, feature_id, distance): each object's nearest features, all of them where equally near."""
    found = _closest(objects, features.withColumn("theta", F.lit(0.0)))
    near = Window.partitionBy("object_id")
    return found.withColumn("least", F.min("distance").over(near)).where("distance = least").select("object_id", "feature_id", "distance").distinct()


def _cell(name: str, level: int, deepest: int) -> Column:
    return F.shiftright(name, deepest - level)


class Quadtree:
    """Features with their cells, and the cells of every STEP-th level with bounding box and largest theta."""

    def __init__(self, features: DataFrame):
        own = features.where("lat IS NOT NULL AND lon IS NOT NULL")
        own = own.groupBy("lat", "lon").agg(F.max("theta").alias("theta")) if "id" not in features.columns else own
        own = cut(own, "scored-features")  # every level and the last join start from these rows
        bounds = own.agg(F.count(F.lit(1)).alias("n"), F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).first()
        self.n = bounds[0]
        self.levels, self.side = 0, 0.0
        if not self.n:
            return
        lo_lat, lo_lon, hi_lat, hi_lon = (float(x) for x in bounds[1:])
        side = self.side = max(hi_lat - lo_lat, hi_lon - lo_lon)
        while side and 4**self.levels * LEAF < self.n and self.levels < DEEPEST:
            self.levels += STEP

        def at_level(level: int) -> DataFrame:
            cells = 1 << level
            index = lambda c, lo: F.least(F.floor((F.col(c) - lo) / (side or 1.0) * cells), F.lit(cells - 1)).cast("long")
            return own.withColumn("ix", index("lat", lo_lat)).withColumn("iy", index("lon", lo_lon))

        while side and self.levels < DEEPEST:
            fullest = at_level(self.levels).groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
            if fullest <= FULLEST:
                break
            self.levels += STEP
        self.features = at_level(self.levels)

    def level(self, level: int) -> DataFrame:
        """(px, py: the cell STEP levels above; cx, cy; box; top) of the cells of a level that have features."""
        up = level - STEP
        at = {n: _cell(c, k, self.levels) for n, c, k in (("px", "ix", up), ("py", "iy", up), ("cx", "ix", level), ("cy", "iy", level))}
        cells = self.features.groupBy(*[c.alias(n) for n, c in at.items()]).agg(
            F.min("lat").alias("b0"), F.min("lon").alias("b1"), F.max("lat").alias("b2"), F.max("lon").alias("b3"), F.max("theta").alias("top")
        )
        return F.broadcast(cells) if level <= BROADCAST_LEVEL else cells

    def candidates(self, boxes: DataFrame, rule: str, radius: float) -> DataFrame:
        """(key, ix, iy): for each box (key, a0, a1, a2, a3) the lowest cells that may hold the answer of a point in it."""
        return self.descend(self.root(boxes), rule, radius, 0, self.levels).select("key", F.col("px").alias("ix"), F.col("py").alias("iy"))

    def root(self, boxes: DataFrame) -> DataFrame:
        """The boxes in the cell of level 0."""
        return boxes.withColumn("px", F.lit(0).cast("long")).withColumn("py", F.lit(0).cast("long"))

    def descend(self, live: DataFrame, rule: str, radius: float, start: int, end: int) -> DataFrame:
        """The cells (px, py) of level ``end`` that may hold the answer of a point in a box, below those of level ``start``.

        A cell's bounds hold for every point of the box, so what is dropped is beaten for all of them, or
        equalled by what one cell is sure to hold, which stays.
        """
        a, b = tuple(F.col(f"a{i}") for i in range(4)), tuple(F.col(f"b{i}") for i in range(4))
        low, high = formulas.rect_min_distance(a, b), formulas.rect_max_distance(a, b)
        own = Window.partitionBy("key")
        for level in range(start + STEP, end + 1, STEP):
            met = live.join(self.level(level), ["px", "py"])
            if rule == NEAREST:
                kept = met.withColumn("low", low).withColumn("bound", F.min(high).over(own)).where("low <= bound")
            elif rule == RANGE:
                sure = F.when(high <= radius, F.col("top"))  # the whole cell is in range, so its best feature is
                met = met.withColumn("low", low).where(F.col("low") <= radius).withColumn("sure", sure)
                best = own.orderBy(F.desc_nulls_last("sure"), "cx", "cy")
                ranked = met.withColumn("bound", F.max("sure").over(own)).withColumn("rank", F.row_number().over(best))
                kept = ranked.where("bound IS NULL OR top > bound OR rank = 1")
            else:
                best = F.col("top") * formulas.decay(high, radius)
                kept = met.withColumn("bound", F.max(best).over(own)).where(F.col("top") * formulas.decay(low, radius) * _SLACK >= F.col("bound"))
            live = kept.select("key", "a0", "a1", "a2", "a3", F.col("cx").alias("px"), F.col("cy").alias("py"))
        return live


def _boxes(objects: DataFrame, key: str = "id") -> DataFrame:
    return objects.select(F.col(key).alias("key"), F.col("lat").alias("a0"), F.col("lon").alias("a1"), F.col("lat").alias("a2"), F.col("lon").alias("a3"))


def _score(rule: str, radius: float) -> Column:
    """Aggregate over an object's candidates (theta, distance)."""
    if rule == RANGE:
        return F.max("theta")
    if rule == INFLUENCE:
        return F.max(F.col("theta") * formulas.decay(F.col("distance"), radius))
    return -F.min(F.struct("distance", (-F.col("theta")).alias("less")))["less"]


def _closest(objects: DataFrame, features: DataFrame) -> DataFrame:
    tree = Quadtree(features)
    placed = objects.where("lat IS NOT NULL AND lon IS NOT NULL").select("id", "lat", "lon")
    if not tree.n:
        return placed.limit(0).select(F.col("id").alias("object_id"), F.col("id").alias("feature_id"), F.lit(0.0).alias("distance"))
    cells = tree.candidates(_boxes(placed.distinct().withColumn("id", F.struct("id", "lat", "lon"))), NEAREST, 0.0)
    met = cells.join(tree.features.select("ix", "iy", F.col("id").alias("feature_id"), F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon")), ["ix", "iy"])
    dist = formulas.distance(F.col("key.lat"), F.col("key.lon"), F.col("f_lat"), F.col("f_lon"))
    return met.select(F.col("key.id").alias("object_id"), "feature_id", dist.alias("distance"))


def reached(tree: Quadtree, placed: DataFrame, rule: str, radius: float, grouped: bool) -> DataFrame:
    """(id, o_lat, o_lon, ix, iy): the lowest cells that each object of ``placed`` (id, lat, lon) has to look into."""
    points = _boxes(placed.withColumn("id", F.struct("id", "lat", "lon")))
    live, start = tree.root(points), 0
    if grouped:
        span = placed.agg(F.count(F.lit(1)), F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).first()
        side = max(float(span[3] or 0) - float(span[1] or 0), float(span[4] or 0) - float(span[2] or 0)) / max(1.0, (span[0] / 64) ** 0.5)
        while start + STEP <= tree.levels and tree.side >= side * (1 << start + STEP):
            start += STEP
        group = F.struct(F.floor(F.col("a0") / (side or 1.0)).alias("gx"), F.floor(F.col("a1") / (side or 1.0)).alias("gy"))
        members = points.withColumn("group", group)
        boxes = members.groupBy(F.col("group").alias("key")).agg(F.min("a0").alias("a0"), F.min("a1").alias("a1"), F.max("a2").alias("a2"), F.max("a3").alias("a3"))
        found = tree.descend(tree.root(boxes), rule, radius, 0, start).select(F.col("key").alias("group"), "px", "py")
        live = members.join(found, "group").drop("group")
    found = tree.descend(live, rule, radius, start, tree.levels)
    return found.select(F.col("key.id").alias("id"), F.col("key.lat").alias("o_lat"), F.col("key.lon").alias("o_lon"), F.col("px").alias("ix"), F.col("py").alias("iy"))


def best_neighbour(objects: DataFrame, features: DataFrame, rule: str, radius: float, grouped: bool = False) -> DataFrame:
    """(id, score): the best score in each object's neighbourhood; objects without any are left out.

    range: the largest theta within ``radius``. nn: the theta of the nearest feature, the largest of equally
    near ones. influence: the largest theta * 2 ** (-distance / radius).
    ``grouped``: objects descend in groups by cell with their bounding box, as long as the tree's cells are no
    smaller than a group, then each for itself; the result is the same.
    """
    rule = formulas.neighbourhood(rule)
    if rule == INFLUENCE and radius <= 0 or radius < 0:
        raise ValueError("the radius must be positive")
    tree = Quadtree(features.select("lat", "lon", "theta"))
    placed = objects.where("lat IS NOT NULL AND lon IS NOT NULL").select("id", "lat", "lon").distinct()
    if not tree.n:
        return placed.limit(0).select("id", F.lit(0.0).alias("score"))
    cells = reached(tree, placed, rule, radius, grouped)
    met = cells.join(tree.features.select("ix", "iy", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"), "theta"), ["ix", "iy"])
    met = met.withColumn("distance", formulas.distance(F.col("o_lat"), F.col("o_lon"), F.col("f_lat"), F.col("f_lon")))
    if rule == RANGE:
        met = met.where(F.col("distance") <= radius)
    return met.groupBy("id").agg(_score(rule, radius).alias("score"))
