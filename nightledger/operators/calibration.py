"""Calibration frames for lights: rule profiles, fallbacks, groups of frames, flats by date, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import durable, stored
from .selection import joined_by

# The rules of each profile as (mode, tolerance, weight); parameters without a rule are ignored.
PROFILES = {
    "dark": {"instrument": ("exact", 0, 0), "binning": ("exact", 0, 0), "gain": ("exact", 0, 0), "offset": ("warning", 0, 0.10), "exposure": ("exact", 0.01, 0), "temperature": ("warning", 2.0, 0.30)},
    "flat": {"instrument": ("exact", 0, 0), "binning": ("exact", 0, 0), "gain": ("warning", 0, 0.20), "focal_length": ("warning", 0, 0.10), "filter": ("exact", 0, 0)},
    "bias": {"instrument": ("exact", 0, 0), "binning": ("exact", 0, 0), "gain": ("exact", 0, 0), "offset": ("exact", 0, 0), "temperature": ("warning", 5.0, 0.15)},
    "darkflat": {"instrument": ("exact", 0, 0), "binning": ("exact", 0, 0), "gain": ("warning", 0, 0.20), "exposure": ("warning", 0, 0.10), "temperature": ("warning", 3.0, 0.20)},
}
# The profiles that are tried where one finds nothing.
FALLBACKS = {"dark": ("darkflat", "bias"), "flat": (), "bias": (), "darkflat": ("bias",)}
# The difference at which a parameter's likeness is zero.
SPANS = {"temperature": 10.0, "gain": 200.0, "offset": 100.0, "focal_length": 500.0, "exposure": 600.0}
TEXTS = ("instrument", "filter")


def _same(name: str, tolerance: float) -> Column:
    a, b = F.col(name), F.col(f"_{name}")
    return a.eqNullSafe(b) if not tolerance else a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


FINEST = 4  # cell sizes of a warning parameter: its span, and a sixteenth, 256th and 4,096th of it
PAIRS = 1 << 22  # pairs of distinct settings up to which all are scored at once; of more, only those that can be among the best are


def _warning_rules(rules: dict) -> list[tuple[str, float, float]]:
    return [(n, tolerance, weight) for n, (mode, tolerance, weight) in rules.items() if mode == "warning"]


def _score(cost: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), 1 - cost), 4)


def _all_scored(asked: DataFrame, held: DataFrame, met: DataFrame, rules: dict) -> DataFrame:
    """Every pair of settings of keys that met."""
    pairs = asked.join(met, "_asked").join(held, "_held")
    cost, warned, matched = F.lit(0.0), F.lit(0), []
    for name, (mode, tolerance, weight) in rules.items():
        same = _same(name, tolerance) if mode == "warning" else F.lit(True)
        matched += [F.lit(name), same]
        if mode == "warning":
            gap = F.abs(F.coalesce(F.col(name), F.lit(0.0)) - F.coalesce(F.col(f"_{name}"), F.lit(0.0)))
            cost = cost + F.when(same, 0.0).otherwise(weight * F.least(gap / SPANS[name], F.lit(1.0)))
            warned = warned + F.when(same, 0).otherwise(1)
    return pairs.select("setting", "_paths", _score(cost).alias("score"), warned.alias("n_warnings"), F.create_map(*matched).alias("matched"))


def _cells(held: DataFrame, names: list[str], k: int) -> list[DataFrame]:
    """Masters' settings by cells of the warning parameters, from the widest to the settings themselves: _held, for each parameter whether it is null, its cell,
    the cell of the next wider size and its least and largest value; how many masters (k at most count) and the k smallest paths."""
    parts = held.select("_held", "_paths", *(F.col(f"_{n}").isNull().alias(f"z_{n}") for n in names), *(F.coalesce(F.col(f"_{n}"), F.lit(0.0)).alias(f"v_{n}") for n in names))
    parts = parts.select("*", *(F.floor(F.col(f"v_{n}") / SPANS[n] * 16 ** (FINEST - 1)).alias(f"c_{n}") for n in names))
    nulls = [f"z_{n}" for n in names]
    leaves = parts.select("_held", *nulls, *(x for n in names for x in (F.col(f"c_{n}"), F.col(f"c_{n}").alias(f"up_{n}"), F.col(f"v_{n}").alias(f"lo_{n}"), F.col(f"v_{n}").alias(f"hi_{n}"))), F.least(F.size("_paths"), F.lit(k)).alias("n"), "_paths")
    cell = ["_held", *nulls, *(f"c_{n}" for n in names)]
    ends = [x for n in names for x in (F.min(f"lo_{n}").alias(f"lo_{n}"), F.max(f"hi_{n}").alias(f"hi_{n}"))]
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("path"))
    first = leaves.select(*cell, F.explode("_paths").alias("path")).withColumn("_r", place).where(F.col("_r") <= k).groupBy(*cell).agg(F.array_sort(F.collect_list("path")).alias("_paths"))  # k at most
    finest = leaves.groupBy(*cell).agg(*ends, F.least(F.sum("n"), F.lit(k)).alias("n"))
    same = [finest[c].eqNullSafe(first[c]) for c in cell]
    tables = [leaves, durable(finest.join(first, same).select(*(finest[c] for c in finest.columns), "_paths").select("*", *(F.shiftright(f"c_{n}", 4).alias(f"up_{n}") for n in names)))]
    for _ in range(FINEST - 1):
        below = tables[-1]
        wider = below.groupBy("_held", *nulls, *(F.col(f"up_{n}").alias(f"c_{n}") for n in names)).agg(*ends, F.least(F.sum("n"), F.lit(k)).alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("_paths"))), 1, k).alias("_paths"))  # of 16 cells a parameter at most
        tables.append(durable(wider.select("*", *(F.shiftright(f"c_{n}", 4).alias(f"up_{n}") for n in names))))
    return tables[::-1]


def _best_scored(asked: DataFrame, held: DataFrame, met: DataFrame, rules: dict, k: int, frontiers: list | None = None) -> DataFrame:
    """As ``_all_scored``, but of masters that cannot be among the ``k`` best of a setting only some.

    Settings meet cells, from the widest. A cell bounds the cost and the warnings of its masters from both sides. A cell goes when ``k`` masters are sure to be
    better than its best; it stays as it is when its bounds agree, for then its k smallest paths stand for it; any other is taken apart into the next smaller ones, the last being settings.
    """
    warn = _warning_rules(rules)
    names = [n for n, _, _ in warn]
    nulls = [f"z_{n}" for n in names]
    tables = _cells(held, names, k)
    lights = asked.select("setting", "_asked", *(F.col(n).isNull().alias(f"no_{n}") for n in names), *(F.coalesce(F.col(n), F.lit(0.0)).alias(f"a_{n}") for n in names))
    own = ["setting", *(f"no_{n}" for n in names), *(f"a_{n}" for n in names)]
    kept = [*own, "_held", *nulls, *(f"c_{n}" for n in names), "n", "_paths", "score", "worst", "n_warnings", "most", "flags", "settled"]

    def bounded(rows: DataFrame) -> DataFrame:
        cost, dear, warned, most, flags = F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0), []
        for name, tolerance, weight in warn:
            a, lo, hi, none, other = (F.col(f"{c}_{name}") for c in ("a", "lo", "hi", "no", "z"))
            near, far = F.greatest(F.lit(0.0), lo - a, a - hi), F.greatest(F.abs(a - lo), F.abs(a - hi))
            same = lambda gap: (none & other) | (~none & ~other & (gap <= tolerance))  # noqa: B023, E731
            price = lambda gap: F.when(same(gap), 0.0).otherwise(weight * F.least(gap / SPANS[name], F.lit(1.0)))  # noqa: B023, E731
            cost, dear = cost + price(near), dear + price(far)
            warned, most = warned + F.when(same(near), 0).otherwise(1), most + F.when(same(far), 0).otherwise(1)
            flags += [F.lit(name), same(near)]
        out = rows.select("*", _score(cost).alias("score"), _score(dear).alias("worst"), warned.alias("n_warnings"), most.alias("most"), F.create_map(*flags).alias("flags"))
        return out.withColumn("settled", (F.col("score") == F.col("worst")) & (F.col("n_warnings") == F.col("most"))).select(*kept)

    frontier = bounded(lights.join(met, "_asked").join(tables[0], "_held"))
    for level, table in enumerate(tables):
        if level:
            waiting = frontier.where("not settled").select(*own, "_held", *nulls, *(F.col(f"c_{n}").alias(f"up_{n}") for n in names))
            frontier = frontier.where("settled").unionByName(bounded(waiting.join(table, ["_held", *nulls, *(f"up_{n}" for n in names)])))
        by = Window.partitionBy("setting")
        sure = F.sum("n").over(by.orderBy(F.desc("worst"), "most", "_held", *nulls, *(f"c_{n}" for n in names)).rowsBetween(Window.unboundedPreceding, 0))
        counted = frontier.withColumn("_sure", sure).withColumn("_least", F.max(F.when(F.col("_sure") >= k, F.struct("worst", -F.col("most")))).over(by))
        frontier = durable(counted.where(F.col("_least").isNull() | (F.struct(F.col("score").alias("worst"), -F.col("n_warnings")) >= F.col("_least"))).drop("_sure", "_least"))
        if frontiers is not None:
            frontiers.append(counted)
    exact = [x for n, (mode, _, _) in rules.items() if mode != "warning" for x in (F.lit(n), F.lit(True))]
    return frontier.select("setting", "_paths", "score", "n_warnings", F.map_concat(F.create_map(*exact), "flags").alias("matched") if exact else F.col("flags").alias("matched"))


def match_profile(lights: DataFrame, masters: DataFrame, profile: str, k: int = 5, pairs: int = PAIRS, frontiers: list | None = None) -> DataFrame:
    """light, master, score, n_warnings, matched (map of parameter to whether it agrees), rank: the k best masters of each light.

    Both tables have path and the profile's parameters, null where unknown. A parameter of an exact rule must agree (null with null only); one of a
    warning rule costs its weight by how far the values are apart, an unknown number counting as 0, and never excludes. Best score first, then
    fewer warnings, then the smaller path.

    Equal settings are matched once: distinct settings of lights and of masters meet on the exact rules' keys, at most ``k`` masters of
    a setting go on, and the lights are joined to the outcome. Up to ``pairs`` pairs of settings are all scored; beyond, cells of masters that cannot be among
    the best are left out before they are taken apart (``_best_scored``), with the same result.
    """
    rules = PROFILES[profile]
    names, sharp = list(rules), [n for n, (mode, _, _) in rules.items() if mode == "exact"]
    tidy = lambda df: df.select("path", *(F.lower(F.trim(F.col(n))).alias(n) if n in TEXTS else F.col(n).cast("double").alias(n) for n in names))
    own, theirs = tidy(lights), tidy(masters)
    asked = own.select(*names).distinct().withColumn("setting", F.xxhash64(*names)).withColumn("_asked", F.xxhash64(*sharp))
    one = Window.partitionBy(*names).orderBy("path")
    held = theirs.withColumn("_place", F.row_number().over(one)).where(F.col("_place") <= k)
    held = held.groupBy(*names).agg(F.array_sort(F.collect_list("path")).alias("_paths"))  # k at most
    held = held.select(*(F.col(n).alias(f"_{n}") for n in names), "_paths").withColumn("_held", F.xxhash64(*(f"_{n}" for n in sharp)))
    own_keys = asked.groupBy("_asked", *sharp).agg(F.count("*").alias("_n"))
    their_keys = held.groupBy("_held", *(f"_{n}" for n in sharp)).agg(F.count("*").alias("_m"))
    keys, filters = [], []
    for name in sharp:
        tolerance = rules[name][1]
        if tolerance:
            own_keys = own_keys.withColumn(f"{name}_cell", F.floor(F.col(name) / tolerance))
            cell = F.floor(F.col(f"_{name}") / tolerance)
            around = F.when(cell.isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(cell - 1, cell, cell + 1))
            their_keys = their_keys.withColumn(f"_{name}_cell", F.explode(around))
            keys.append(F.col(f"{name}_cell").eqNullSafe(F.col(f"_{name}_cell")))
            filters.append(_same(name, tolerance))
        else:
            keys.append(F.col(name).eqNullSafe(F.col(f"_{name}")))
    met = own_keys.join(their_keys, keys)
    for f in filters:
        met = met.where(f)
    met = met.select("_asked", "_held", "_n", "_m")
    many = met.agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 0  # one number
    met = met.select("_asked", "_held")
    scored = _all_scored(asked, held, met, rules) if many <= pairs or not _warning_rules(rules) else _best_scored(asked, held, met, rules, k, frontiers)
    best = Window.partitionBy("setting").orderBy(F.desc("score"), "n_warnings", F.col("_paths")[0])
    few = scored.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k).withColumn("master", F.explode("_paths"))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("setting").orderBy(F.desc("score"), "n_warnings", "master"))).where(F.col("rank") <= k)
    found = own.select(F.col("path").alias("light"), F.xxhash64(*names).alias("setting")).join(ranked, "setting")
    return found.select("light", "master", "score", "n_warnings", "matched", "rank")


def match_with_fallback(lights: DataFrame, pools: dict[str, DataFrame], kind: str, k: int = 5) -> DataFrame:
    """``match_profile`` of ``kind``, and for lights without any the first profile of its chain that finds one; ``profile_used`` names it."""
    found, left = None, lights
    for name in (kind, *FALLBACKS[kind]):
        if name not in pools:
            continue
        hits = stored(match_profile(left, pools[name], name, k).withColumn("profile_used", F.lit(name)))  # read by the next levels too
        left = left.join(hits.select(F.col("light").alias("path")).distinct(), "path", "left_anti")
        found = hits if found is None else found.unionByName(hits)
    return found


def coverage(lights: DataFrame, pools: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(for each kind: covered, missing, avg_score, min_score, warnings_count; how many lights have all, some and no kind)."""
    best = None
    for kind in pools:
        own = match_with_fallback(lights, pools, kind, 1).select("light", F.lit(kind).alias("kind"), "score", "n_warnings")
        best = own if best is None else best.unionByName(own)
    total = lights.agg(F.count("*").alias("total"))  # one row
    kinds = lights.sparkSession.createDataFrame([(k,) for k in pools], "kind string")
    per = kinds.join(best.groupBy("kind").agg(F.count("*").alias("covered"), F.avg("score").alias("a"), F.min("score").alias("m"), F.sum("n_warnings").alias("w")), "kind", "left").join(F.broadcast(total))
    zero = lambda c, t="double": F.coalesce(F.col(c), F.lit(0)).cast(t)
    per = per.select("kind", zero("covered", "long").alias("covered"), (F.col("total") - zero("covered", "long")).alias("missing"), F.round(zero("a"), 4).alias("avg_score"), zero("m").alias("min_score"), zero("w", "long").alias("warnings_count"))
    counts = lights.select(F.col("path").alias("light")).join(best.groupBy("light").agg(F.count("*").alias("n")), "light", "left")
    state = F.when(F.col("n") == len(pools), "full").when(F.col("n") > 0, "partial").otherwise("none")
    return per, counts.groupBy(state.alias("coverage")).agg(F.count("*").alias("lights"))


def _light_groups(frames: DataFrame) -> DataFrame:
    """For each target and filter of the lights: mean temperature, and exposure and camera of the earliest light (date, then path)."""
    first = F.min_by(F.struct("exposure", "camera"), F.struct("date_obs", "path"))
    groups = frames.where("image_type = 'LIGHT'").groupBy("target", "filter").agg(first.alias("one"), F.avg("temperature").alias("mean"))
    return groups.select("target", "filter", "mean", F.col("one.exposure").alias("exposure"), F.col("one.camera").alias("camera"))


def _darks_met(groups: DataFrame, frames: DataFrame) -> DataFrame:
    """Groups with the temperatures and numbers (n) of the darks of their camera and exposure (within 0.01 s); unknown cameras are alike."""
    darks = frames.where("image_type = 'DARK'").groupBy(F.col("camera").alias("dark_camera"), F.col("exposure").alias("dark_exposure"), "temperature").agg(F.count("*").alias("n"))
    darks = darks.withColumn("dark_cell", F.explode(F.array(*(F.floor(F.col("dark_exposure") / 0.01) + d for d in (-1, 0, 1)))))
    own = groups.withColumn("cell", F.floor(F.col("exposure") / 0.01))
    return own.join(darks, F.col("camera").eqNullSafe(F.col("dark_camera")) & (F.col("cell") == F.col("dark_cell"))).where("abs(exposure - dark_exposure) < 0.01")


def _with_flats_and_biases(groups: DataFrame, frames: DataFrame) -> DataFrame:
    flats = frames.where("image_type = 'FLAT'").groupBy("filter", "camera").agg(F.count("*").alias("n_flats"))
    biases = frames.where("image_type = 'BIAS'").groupBy("camera").agg(F.count("*").alias("n_biases"))
    return joined_by(joined_by(groups, flats, ["filter", "camera"]), biases, ["camera"])


def match_groups(frames: DataFrame, tolerance: float = 2.0, near: float = 0.5) -> DataFrame:
    """For each target and filter of the lights: how many darks, flats and biases fit, and the darks' temperature difference.

    The earliest light (date, then path) gives exposure and camera. Of the darks of that camera and exposure (within 0.01 s) the temperature nearest
    to the lights' mean counts, the lower of two, and all darks within ``near`` of it, if it is within ``tolerance``. Flats have the
    filter and camera, biases the camera; an unknown target, filter or camera is like an unknown one. Counts are made before the join, so no pairs of frames are.
    """
    keys = ["target", "filter"]
    groups = _light_groups(frames)
    met = _darks_met(groups, frames)
    best = met.groupBy(*keys).agg(F.min_by("temperature", F.struct(F.abs(F.col("temperature") - F.col("mean")), "temperature")).alias("best"))
    near_ones = joined_by(met, best, keys).where(F.abs(F.col("best") - F.col("mean")) <= tolerance).where(F.abs(F.col("temperature") - F.col("best")) <= near)
    counts = near_ones.groupBy(*keys).agg(F.sum("n").alias("n_darks"), F.first(F.abs(F.col("best") - F.col("mean"))).alias("dark_temp_delta"))
    out = _with_flats_and_biases(joined_by(groups, counts, keys), frames)
    return out.select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_darks", "n_flats", "n_biases")), "dark_temp_delta")


def candidates(frames: DataFrame) -> DataFrame:
    """For each target and filter of the lights: n_dark_candidates (camera and exposure of the earliest light), dark_gap (degrees from the lights' mean to the nearest of them), n_flats and n_biases."""
    keys = ["target", "filter"]
    groups = _light_groups(frames)
    met = _darks_met(groups, frames).groupBy(*keys).agg(F.sum("n").alias("n_dark_candidates"), F.min(F.abs(F.col("temperature") - F.col("mean"))).alias("dark_gap"))
    out = _with_flats_and_biases(joined_by(groups, met, keys), frames)
    return out.select(*keys, "dark_gap", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_dark_candidates", "n_flats", "n_biases")))


FLAT_KEYS = ("telescope", "camera", "filter", "binning")


def flat_groups(flats: DataFrame) -> DataFrame:
    """Flats by night (noon rule), telescope, camera, filter, binning and rotation: count, files and the first temperature (by path). Unknown names are 'Unknown'."""
    named = flats.withColumns({c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("Unknown")) for c in ("telescope", "camera", "filter")})
    night = F.to_date(F.col("date_obs").cast("timestamp") - F.expr("INTERVAL 12 HOURS"))
    return named.withColumn("night", night).groupBy("night", *FLAT_KEYS, "rotation").agg(F.count("*").alias("n_files"), F.array_sort(F.collect_set("path")).alias("files"), F.min_by("temperature", "path").alias("temperature"))


def match_flats(lights: DataFrame, groups: DataFrame, days: int = 30) -> DataFrame:
    """(setting of lights, flat group, days, rank): every flat group of the setting within ``days``, nearest first.

    A setting is night, telescope, camera, filter and binning; a null or blank telescope, camera or filter of the light fits any, binning must agree, and
    where a night is unknown the group is taken, last. Settings are matched once, whatever the number of their lights; each subset of
    unknown names is a join on the names that are left and on cells of ``days`` days.
    """
    night = F.to_date(F.col("date_obs").cast("timestamp") - F.expr("INTERVAL 12 HOURS"))
    named = lights.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in FLAT_KEYS[:3]}).withColumn("night", night)
    settings = named.groupBy("night", *FLAT_KEYS).agg(F.count("*").alias("n_lights"))
    other = groups.select(*(F.col(c).alias(f"flat_{c}") for c in ("night", *FLAT_KEYS, "rotation")), F.col("n_files"))
    day = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / days)
    dated = other.where("flat_night is not null").withColumn("cell", F.explode(F.array(*(day("flat_night") + d for d in (-1, 0, 1)))))
    undated = other.where("flat_night is null")
    parts = []
    for known in range(8):
        has = [c for k, c in enumerate(FLAT_KEYS[:3]) if known >> k & 1]
        own = settings
        for c in FLAT_KEYS[:3]:
            own = own.where(F.col(c).isNotNull() if c in has else F.col(c).isNull())
        on = [F.col("binning") == F.col("flat_binning"), *(F.col(c) == F.col(f"flat_{c}") for c in has)]
        gap = F.abs(F.datediff("night", "flat_night"))
        parts.append(own.where("night is not null").withColumn("own_cell", day("night")).join(dated, [*on, F.col("own_cell") == F.col("cell")]).where(gap <= days).withColumn("days", gap).drop("own_cell", "cell"))
        parts.append(own.where("night is not null").join(undated, on).withColumn("days", F.lit(None).cast("int")))
        parts.append(own.where("night is null").join(other, on).withColumn("days", F.lit(None).cast("int")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("night", *FLAT_KEYS).orderBy(F.asc_nulls_last("days"), F.asc_nulls_last("flat_night"), *(f"flat_{c}" for c in FLAT_KEYS), "flat_rotation")
    return found.withColumn("rank", F.row_number().over(order))


def flat_statistics(groups: DataFrame, masters: DataFrame) -> DataFrame:
    """One row: files, groups, masters created and pending, nights, setups and filters. ``masters`` has the keys of groups with a master."""
    keys = ["night", *FLAT_KEYS, "rotation"]
    other = masters.select(*(F.col(k).alias(f"_{k}") for k in keys), F.lit(True).alias("made")).distinct()
    joined = groups.join(other, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    made = F.count("made")
    return joined.agg(F.sum("n_files").alias("total_flat_files"), F.count("*").alias("total_groups"), made.alias("masters_created"), (F.count("*") - made).alias("masters_pending"), F.countDistinct("night").alias("nights_covered"), F.countDistinct("telescope", "camera").alias("setups"), F.countDistinct("filter").alias("filters"))


def pending_flats(groups: DataFrame, masters: DataFrame) -> DataFrame:
    """The groups without a master; ``masters`` has the keys of groups with one. Null keys are alike."""
    keys = ["night", *FLAT_KEYS, "rotation"]
    other = masters.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    return groups.join(other, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")


def flats_by(groups: DataFrame, masters: DataFrame, by: list[str]) -> DataFrame:
    """For each value of ``by`` (night, or telescope and camera): n_groups, n_files, filters (sorted), first and last night, masters_created and masters_pending."""
    left = pending_flats(groups, masters).groupBy(*by).agg(F.count("*").alias("masters_pending"))
    all_of = groups.groupBy(*by).agg(F.count("*").alias("n_groups"), F.sum("n_files").alias("n_files"), F.array_sort(F.collect_set("filter")).alias("filters"), F.min("night").alias("first_night"), F.max("night").alias("last_night"))  # a set of filter names
    pending = F.coalesce("masters_pending", F.lit(0)).cast("long")
    return joined_by(all_of, left, by).withColumn("masters_created", F.col("n_groups") - pending).withColumn("masters_pending", pending)


def flat_coverage(groups: DataFrame, required: DataFrame, least: int = 20) -> DataFrame:
    """night, filter, n_files and status (complete from ``least`` files, insufficient, missing) for every night of the flats and each required filter."""
    have = groups.groupBy("night", "filter").agg(F.sum("n_files").alias("n"))
    grid = groups.select("night").distinct().join(F.broadcast(required.select("filter").distinct()))  # a row for each night and required filter is the result
    n = F.coalesce("n", F.lit(0))
    return grid.join(have, ["night", "filter"], "left").select("night", "filter", n.alias("n_files"), F.when(n >= least, "complete").when(n > 0, "insufficient").otherwise("missing").alias("status"))
