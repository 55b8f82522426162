"""Nearest neighbours inside groups, by tiles and then by cells that widen until the last of them is certain."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import durable, stored

ROUNDS = 64
POINTS = 1 << 15  # points of one task; each keeps some k + 4 sqrt(k) + 5 others


def _placed(points: DataFrame, by: str, k: int) -> DataFrame:
    """``points`` with their cell (_cx, _cy) and _w, the width of a cell: about k + 1 points of the group are in one. _cells is how many cells the group is wide.

    For the first round: _tx and _ty, the tile of a point, _reach2, the square of how far it looks, and _lx to _hx and _ly to _hy, the tiles that may look as far as to it. Where the group is evenly filled
    some k + 4 sqrt(k) + 5 others are within a point's reach, which is longer near the group's edges. Tiles are four of these radii wide at least. _whole: the group is one tile of so few points that all are looked at.
    """
    ends = points.groupBy(by).agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), (F.max("x") - F.min("x")).alias("_dx"), (F.max("y") - F.min("y")).alias("_dy"), F.count("*").alias("_all"))
    share, longer = (k + 1) / F.col("_all"), F.greatest("_dx", "_dy")
    width = F.greatest(F.sqrt(F.col("_dx") * F.col("_dy") * share), longer * share, longer * 1e-6)  # thin groups are cut along their length
    many = k + 4 * math.sqrt(k) + 5
    radius = F.greatest(F.sqrt(F.col("_dx") * F.col("_dy") * many / (math.pi * F.col("_all"))), longer * many / (2 * F.col("_all")), longer * 1e-6)
    sized = ends.withColumn("_w", F.when(longer > 0, width).otherwise(1.0)).withColumn("_cells", F.floor(longer / F.col("_w")) + 1).withColumn("_r", F.when(longer > 0, radius).otherwise(1.0))
    for c in ("x", "y"):
        sized = sized.withColumn(f"_n{c}", F.greatest(F.lit(1), F.floor(F.col(f"_d{c}") / (4 * F.col("_r"))))).withColumn(f"_t{c}", F.when(F.col(f"_d{c}") > 0, F.col(f"_d{c}") / F.col(f"_n{c}")).otherwise(1.0))
    sized = sized.withColumn("_whole", (F.col("_nx") * F.col("_ny") == 1) & (F.col("_all") <= 2 * many))
    cell = lambda c: F.floor((F.col(c) - F.col(f"_{c}0")) / F.col("_w")).alias(f"_c{c}")
    tile = lambda c, d: F.greatest(F.lit(0), F.least(F.col(f"_n{c}") - 1, F.floor((F.col(c) - F.col(f"_{c}0") + d) / F.col(f"_t{c}")))).cast("int")
    far = 1.5 * F.col("_r")
    # the part of a line through a point's reach that is inside the group
    inside = lambda c: F.least(F.lit(1.0), 0.5 + 0.5 * F.least(F.col(c) - F.col(f"_{c}0"), F.col(f"_{c}0") + F.col(f"_d{c}") - F.col(c)) / F.col("_r"))
    reach2 = F.col("_r") * F.col("_r") * F.least(F.lit(2.25), 1 / (inside("x") * inside("y"))) * (1 - 1e-8)  # tiles are cut in floating point
    tiles = [x for c in ("x", "y") for x in (tile(c, F.lit(0.0)).alias(f"_t{c}"), tile(c, -far).alias(f"_l{c}"), tile(c, far).alias(f"_h{c}"))]
    return points.join(sized.hint("merge"), by).select(*points.columns, "_w", "_cells", cell("x"), cell("y"), *tiles, reach2.alias("_reach2"), "_whole")


def _met(left: DataFrame, placed: DataFrame, by: str, ident: str, carried: list[str], level: int, parts: int = 1) -> DataFrame:
    """Each point of ``left`` with the others that it looks at, and _sure: no other of the group was left out.

    First, at level 0, when all points ask, these are the others within its reach. The others are copied to the tiles that may look as far as to them, so that all that a point meets is in one place, that of
    its tile (_ax, _ay), and pairs are not shuffled; a point that meets none has one row with nulls. Later few points ask, and they are copied: to the 3 x 3 cells around theirs, cells being 2**level of the
    smallest wide, where they meet the others nearer than a cell's width. Both sides are dealt over ``parts`` tasks.
    """
    around = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    at = lambda c: F.shiftright(F.col(c).cast("long"), level)
    if level:
        place = left.withColumn("_ox", F.explode(around)).withColumn("_oy", F.explode(around)).withColumn("_ax", at("_cx") + F.col("_ox")).withColumn("_ay", at("_cy") + F.col("_oy"))
        reach2, sure = F.pow(F.col("_w") * 2.0**level, F.lit(2)) * (1 - 1e-9), F.col("_cells") <= 2**level  # cells are cut in floating point
        spread = placed.withColumn("_bcx", at("_cx")).withColumn("_bcy", at("_cy"))
    else:
        place, reach2, sure = left.withColumn("_ax", F.col("_tx")).withColumn("_ay", F.col("_ty")), F.col("_reach2"), F.col("_whole")
        spread = placed.withColumn("_bcx", F.explode(F.sequence("_lx", "_hx"))).withColumn("_bcy", F.explode(F.sequence("_ly", "_hy")))
    own = place.select(by, ident, "x", "y", "_w", "_cells", "_ax", "_ay", reach2.alias("_within2"), sure.alias("_sure"), *carried)
    other = spread.select(F.col(by).alias("_by"), F.col(ident).alias(f"near_{ident}"), F.col("x").alias("_bx"), F.col("y").alias("_by_y"), "_bcx", "_bcy", *(F.col(c).alias(f"near_{c}") for c in carried))
    same = (F.col(by) == F.col("_by")) & (F.col("_ax") == F.col("_bcx")) & (F.col("_ay") == F.col("_bcy"))
    dx, dy = F.col("x") - F.col("_bx"), F.col("y") - F.col("_by_y")
    gap = dx * dx + dy * dy  # POWER would be most of the time of a pair
    seen = (F.col(ident) != F.col(f"near_{ident}")) & (F.col("_sure") | (gap < F.col("_within2")))
    dealt = own.repartition(parts, by, "_ax", "_ay")
    if not level:  # pairs come out point after point, so their sort finds them nearly in order and tells most of them apart by one number
        dealt = dealt.sortWithinPartitions(by, "_ax", "_ay").withColumn("_row", F.monotonically_increasing_id())
    met = dealt.join(other.repartition(parts, "_by", "_bcx", "_bcy").hint("merge"), same & seen, "inner" if level else "left")
    return met.select(by, ident, "_ax", "_ay", "_w", "_cells", "_sure", *([] if level else ["_row"]), *carried, f"near_{ident}", gap.alias("distance2"), *(f"near_{c}" for c in carried))


def ranked(met: DataFrame, keys: list[str], ident: str, k: int) -> DataFrame:
    """The ``k`` nearest of what each point met, with their rank; ties to the smaller ident."""
    first = ["_row"] if "_row" in met.columns else []
    order = Window.partitionBy(*first, *keys).orderBy("distance2", f"near_{ident}")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def folded_nearest(points: DataFrame, by: str, ident: str, k: int, carried: list[str], fold: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """by, ident and what ``fold`` makes of a point's ``k`` nearest others (x, y) of the same group.

    ``fold(met, keys)`` gets what points met (see ``_met``), points being told apart by ``keys``, and gives a row for each point: by, ident, _n, the number of others it met, up to ``k`` at least, _sure, and what is
    asked for; if it groups by all ``keys``, nothing is shuffled. One row for each point is all that is written. All tables grow with the points, and a compressed file looks small, so none is broadcast.

    A point is done when ``k`` others are within its reach, for nothing nearer can be outside, or when it met the whole group; the others meet again in cells that
    double. So an evenly filled group compares a fixed number of points for each, whatever its size. Points without a place, and null groups or idents, take no part.
    """
    placed = stored(_placed(points.select(by, ident, "x", "y", *carried).dropna(subset=[by, ident, "x", "y"]), by, k), lean=True)
    settled = (F.col("_n") >= k) | F.col("_sure")
    found, left = None, None
    for level in range(ROUNDS):
        parts = max(1, -(-placed.count() // POINTS))
        met, keys = _met(placed if left is None else left, placed, by, ident, carried, level, parts), [by, ident] if level else [by, "_ax", "_ay", ident]
        rows = stored(fold(met, keys), lean=True)
        done = rows.where(settled).drop("_n", "_sure")
        found = done if found is None else found.unionByName(done)
        if level:
            left = durable(left.join(done.select(by, ident).hint("merge"), [by, ident], "left_anti"))
        else:  # few are left, so only their groups go on
            asked = durable(rows.where(~settled).select(by, ident))
            if asked.isEmpty():
                return found
            placed = stored(placed.join(asked.select(by).distinct().hint("merge"), by, "left_semi"), lean=True)
            left = durable(placed.join(asked.hint("merge"), [by, ident], "left_semi"))
        if left.isEmpty():
            return found
    raise RuntimeError(f"neighbours did not settle in {ROUNDS} rounds")


def k_nearest(points: DataFrame, by: str, ident: str, k: int, carried: list[str] | None = None) -> DataFrame:
    """by, ident, near_<ident>, distance2, rank and near_<carried>: the ``k`` nearest other points of the same group (see ``folded_nearest``), ties to the smaller ident; fewer where the group has fewer."""
    carried = carried or []
    columns = [f"near_{ident}", "distance2", "rank", *(f"near_{c}" for c in carried)]

    def fold(met, keys):
        rows = ranked(met, keys, ident, k).groupBy(*keys).agg(F.count(f"near_{ident}").alias("_n"), F.max("_sure").alias("_sure"), F.collect_list(F.struct(*columns)).alias("_near"))
        return rows.select(by, ident, "_n", "_sure", "_near")

    return folded_nearest(points, by, ident, k, carried, fold).select(by, ident, F.inline("_near")).where(F.col(f"near_{ident}").isNotNull())
