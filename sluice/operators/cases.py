"""Closure cases against the normal runs: the case is a column, so one plan compares any number of cases with the base.

Tables by run: trips (case, hour, seed, trip, seconds, metres), routes (case, hour, seed, trip, edges), flows (case, hour,
seed, edge, entered, seconds), jams (case, hour, seed, edge, begin, jam_m) and health (case, hour, seed, loaded, discarded,
teleports; a row for each run). The case of the normal runs is `base`. sections: section, edge, lanes; legs: leg, role,
edge, lanes. A trip or a route without its partner in the other runs is left out; a run without jams has queues of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from . import sections as blocks

BASE = "base"
RUN = ["hour", "seed"]
#: The case that holds the differences between one normal run and the next seed's.
NOISE = "noise"


def base_users(routes: DataFrame, closed: list) -> DataFrame:
    """hour, seed and trip of normal routes that touch a closed edge."""
    return routes.where((F.col("case") == BASE) & F.arrays_overlap("edges", F.array(*[F.lit(c) for c in closed]))).select(*RUN, "trip").distinct()


def compared(trips: DataFrame, users: DataFrame) -> DataFrame:
    """case, hour, seed, trip, used (the closed block, in the normal run), extra_s and extra_m of each case's trips; as case `noise` those of the next normal seed."""
    marked = users.select(*RUN, "trip", F.lit(True).alias("used"))
    base = trips.where(F.col("case") == BASE).join(marked, [*RUN, "trip"], "left").select(*RUN, "trip", F.coalesce("used", F.lit(False)).alias("used"), F.col("seconds").alias("_s"), F.col("metres").alias("_m"))
    seeds = base.select("seed").distinct()
    after = seeds.withColumn("_next", F.lead("seed").over(Window.orderBy("seed")))  # a row per seed
    last = base.join(after.where("_next is not null"), "seed")
    other = base.select(F.col("seed").alias("_next"), "hour", "trip", F.col("_s").alias("seconds"), F.col("_m").alias("metres"))
    noise = last.join(other, ["_next", "hour", "trip"]).withColumn("case", F.lit(NOISE))
    real = trips.where(F.col("case") != BASE).join(base, [*RUN, "trip"])
    extra = [(F.col("seconds") - F.col("_s")).alias("extra_s"), (F.col("metres") - F.col("_m")).alias("extra_m")]
    shape = ["case", *RUN, "trip", "used", *extra]
    return real.select(*shape).unionByName(noise.select(*shape))


def run_rows(pairs: DataFrame) -> DataFrame:
    """Per case, hour and seed: matched trips and block users, and both groups' delay in vehicle-hours."""
    used = F.when(F.col("used"), F.col("extra_s"))
    hours = lambda x: F.coalesce(F.sum(x), F.lit(0.0)) / 3600
    return pairs.groupBy("case", *RUN).agg(F.count("*").alias("matched"), F.count(used).alias("users"), hours(F.col("extra_s")).alias("delay_all"), hours(used).alias("delay_users"))


def spread(value: str, places: int = 0) -> Column:
    """low, typical (median) and high of a row per seed. An aggregate."""
    at = lambda f: F.bround(f(value), places)
    return F.struct(at(F.min).alias("low"), at(F.median).alias("typical"), at(F.max).alias("high"))


def delays(pairs: DataFrame) -> DataFrame:
    """Per case the delay over seeds of all traffic and of block users, each with the noise floor and whether it stays within it."""
    seeds = run_rows(pairs).groupBy("case", "seed").agg(F.sum("delay_all").alias("delay_all"), F.sum("delay_users").alias("delay_users"))
    floor = lambda x: F.coalesce(F.max(F.abs(F.bround(x, 1))), F.lit(0.0))
    floors = seeds.where(F.col("case") == NOISE).agg(floor("delay_all").alias("a"), floor("delay_users").alias("u"))
    out = seeds.where(F.col("case") != NOISE).groupBy("case").agg(spread("delay_all", 1).alias("all_traffic"), spread("delay_users", 1).alias("diverted"))
    out = out.withColumns({"all_traffic_floor": floors.select("a").scalar(), "diverted_floor": floors.select("u").scalar()})
    within = lambda x: (F.col(f"{x}.low") <= 0) | (F.abs(F.col(f"{x}.typical")) <= F.col(f"{x}_floor"))
    return out.withColumns({f"{x}_is_noise": within(x) for x in ("all_traffic", "diverted")})


def per_trip(pairs: DataFrame) -> DataFrame:
    """Per case the extra seconds of a block user's trip: quartiles, median, mean, the means of seeds; and the extra metres."""
    mine = pairs.where(F.col("used") & (F.col("case") != NOISE))
    whole = lambda x: F.bround(x.cast("double"))
    s = stats.placed(mine, ["case"], F.col("extra_s")).groupBy("case").agg(whole(stats.index_quantile(0.25)).alias("lower_quartile"), whole(stats.quantile(0.5)).alias("median"), whole(stats.index_quantile(0.75)).alias("upper_quartile"), whole(stats.mean()).alias("mean"), F.max("size").alias("trips_compared"))
    means = mine.groupBy("case", "seed").agg(F.avg("extra_s").alias("m")).groupBy("case").agg(spread("m").alias("mean_across_seeds"))
    metres = blocks.extra_distance(mine.withColumn("difference", F.col("extra_m")), ["case"]).select("case", F.struct("low", "typical", "high").alias("extra_metres"))
    return s.join(means, "case").join(metres, "case")


def in_cases(base: DataFrame, cases: list[str]) -> DataFrame:
    """Rows of the normal runs once for each case."""
    return base.withColumn("case", F.explode(F.array(*[F.lit(c) for c in cases])))


def section_gains(routes: DataFrame, users: DataFrame, sections: DataFrame, cases: list[str], n_seeds: int) -> DataFrame:
    """case, section and gain: block users a seed who drive on it in that case more than in the normal runs."""
    mine = routes.join(users, [*RUN, "trip"], "left_semi")
    n = blocks.section_users(mine, sections.select("edge", "section").distinct(), ["case", *RUN], "trip").groupBy("case", "section").agg(F.sum("n").alias("n"))
    base = in_cases(n.where(F.col("case") == BASE), cases).withColumn("n", -F.col("n"))
    return n.where(F.col("case").isin(*cases)).unionByName(base).groupBy("case", "section").agg((F.sum("n") / n_seeds).alias("gain"))


def fullest(flows: DataFrame, parts: DataFrame, part: str, cases: list[str], lane_capacity: float = 800.0) -> DataFrame:
    """case, part and of its edges the one whose lanes are fullest in that case: lanes, normal, with_closure (means over runs), peak, share of capacity.

    parts: the column that `part` names, edge, lanes. An edge without a run counts 0; of equal ones the smallest edge.
    """
    mean = flows.groupBy("case", "edge").agg(F.avg("entered").alias("with_closure"), F.max("entered").alias("peak"))
    normal = mean.where(F.col("case") == BASE).select("edge", F.col("with_closure").alias("normal"))
    e = in_cases(parts.select(part, "edge", "lanes").distinct(), cases).join(mean, ["case", "edge"], "left").join(normal, "edge", "left").fillna(0.0, ["with_closure", "peak", "normal"])
    e = e.withColumn("share", F.col("peak") / (F.col("lanes") * lane_capacity))
    top = F.min(F.struct((-F.col("share")).alias("_"), "edge", "lanes", "normal", "with_closure", "peak", "share")).alias("f")
    return e.groupBy("case", part).agg(top).select("case", part, "f.edge", "f.lanes", "f.normal", "f.with_closure", "f.peak", "f.share")


def streets(gains: DataFrame, full: DataFrame, least: Column, closed_sections: DataFrame, most: int = 8, most_relieved: int = 5) -> DataFrame:
    """Per case the `most` sections that gain the most block users and the `most_relieved` that lose the most (top-k reports), from `least` on.

    The closed block's own sections are no relief. Columns: case, kind (taking or relieved), place, section, drivers and,
    of those that gain, the fullest point with its verdict.
    """
    up = gains.where(F.col("gain") >= least).withColumns({"kind": F.lit("taking"), "drivers": F.col("gain")})
    down = gains.where(-F.col("gain") >= least).join(closed_sections.select("section").distinct(), "section", "left_anti").withColumns({"kind": F.lit("relieved"), "drivers": -F.col("gain")})
    place = F.row_number().over(Window.partitionBy("case", "kind").orderBy(F.desc("drivers"), "section"))
    shape = ["case", "kind", "section", "drivers"]
    top = up.select(*shape).unionByName(down.select(*shape)).withColumn("place", place).where(F.col("place") <= F.when(F.col("kind") == "taking", most).otherwise(most_relieved))
    verdict = F.when(F.col("share").isNotNull(), blocks.load_verdict(F.col("share")))
    return top.join(full.withColumn("kind", F.lit("taking")), ["case", "kind", "section"], "left").withColumn("verdict", verdict)


def leg_runs(legs: DataFrame, jams: DataFrame, flows: DataFrame, health: DataFrame) -> DataFrame:
    """A row for each run and leg: the longest queue (its edges' jams in an interval added up) and the seconds to drive it."""
    on = legs.select("leg", "edge").distinct()
    key = ["case", *RUN, "leg"]
    q = jams.groupBy("case", *RUN, "edge", "begin").agg(F.max("jam_m").alias("jam_m")).join(on, "edge").groupBy(*key, "begin").agg(F.sum("jam_m").alias("jam_m")).groupBy(*key).agg(F.max("jam_m").alias("queue_m"))
    s = flows.join(on, "edge").groupBy(*key).agg(F.sum("seconds").alias("seconds"))
    names = on.agg(F.sort_array(F.collect_set("leg")).alias("l")).scalar()  # a site's legs
    dense = health.select("case", *RUN).distinct().withColumn("leg", F.explode(names))
    return dense.join(q, key, "left").join(s, key, "left").fillna(0.0, ["queue_m", "seconds"])


def leg_cases(legs: DataFrame, by_run: DataFrame, full: DataFrame, cases: list[str]) -> DataFrame:
    """Per case and leg: queues typical and worst of normal and closure runs, seconds, and whether the queue grows by more than normal runs differ.

    It grows when its typical length rises by 5 m or more and by more than the typical difference between a normal run and the
    next seed's in the same hour. A group is one case's runs of a leg.
    """
    base = by_run.where(F.col("case") == BASE)
    agg = lambda df, name: [F.median("queue_m").alias(f"{name}_typical"), F.max("queue_m").alias(f"{name}_worst"), F.avg("seconds").alias(f"{name}_seconds")]
    apart = F.abs(F.col("queue_m") - F.lag("queue_m").over(Window.partitionBy("leg", "hour").orderBy("seed")))
    noise = base.withColumn("apart", apart).groupBy("leg").agg(F.coalesce(F.median("apart"), F.lit(0.0)).alias("noise"))
    normal = base.groupBy("leg").agg(*agg(base, "normal")).join(noise, "leg")
    q = stats.placed(by_run.where(F.col("case").isin(*cases)), ["case", "leg"], F.col("queue_m")).groupBy("case", "leg").agg(stats.index_quantile(0.25).alias("queue_low"))
    mine = by_run.where(F.col("case").isin(*cases)).groupBy("case", "leg").agg(*agg(by_run, "closure")).join(q, ["case", "leg"]).join(normal, "leg")
    growth = F.col("closure_typical") - F.col("normal_typical")
    roles = legs.groupBy("leg").agg(F.min("role").alias("role"))
    return mine.withColumn("grows", (growth > F.col("noise")) & (growth >= 5)).join(full, ["case", "leg"]).join(roles, "leg")


def records(delay: DataFrame, trip: DataFrame, street: DataFrame, leg: DataFrame, health: DataFrame) -> DataFrame:
    """One nested record per case: delay, extra distance, streets that take or lose drivers, legs, the longest queue, health."""
    taken = F.struct("place", "section", F.bround("drivers").alias("drivers"), "edge", "lanes", F.bround("normal").alias("normal"), F.bround("with_closure").alias("with_closure"), F.bround("peak").alias("peak"), F.bround("share", 2).alias("share"), "verdict")
    lost = F.struct("place", "section", F.bround("drivers").alias("drivers"))
    kind = lambda k, x: F.array_sort(F.collect_list(F.when(F.col("kind") == k, x)))
    st = street.groupBy("case").agg(kind("taking", taken).alias("streets_taking"), kind("relieved", lost).alias("streets_relieved"))
    whole = lambda *names: [F.bround(n).alias(n) for n in names]
    one = F.struct("leg", "role", "edge", "lanes", *whole("normal", "with_closure", "peak"), F.bround("share", 2).alias("share"), F.struct(*whole("normal_typical", "normal_worst", "closure_typical", "closure_worst", "noise"), "grows").alias("queue"), F.struct(*whole("normal_seconds", "closure_seconds")).alias("seconds"))
    grown = F.when(F.col("grows"), F.struct("leg", F.bround("queue_low").alias("low"), F.bround("closure_typical").alias("typical"), F.bround("closure_worst").alias("high")))
    lg = leg.groupBy("case").agg(F.array_sort(F.collect_list(one)).alias("legs"), F.min_by(grown, F.when(F.col("grows"), F.struct(-F.col("closure_typical"), "leg"))).alias("max_queue"))
    hl = health.groupBy("case").agg(F.struct(F.bround(F.max(F.try_divide("discarded", "loaded")), 4).alias("max_dropped_share"), F.max("teleports").alias("max_teleports")).alias("health"))
    d = delay.select("case", F.struct(*[c for c in delay.columns if c != "case"]).alias("delay"))
    t = trip.select("case", F.struct(*[c for c in trip.columns if c not in ("case", "extra_metres")]).alias("extra_seconds"), "extra_metres")
    none = lambda c: F.coalesce(c, F.array().cast(dict(st.dtypes)[c]))
    out = d.join(t, "case", "left").join(st, "case", "left").join(lg, "case", "left").join(hl, "case", "left")
    return out.withColumns({c: none(c) for c in ("streets_taking", "streets_relieved")})


def block_levels(queued: DataFrame, cases: list[str], start: int, stop: int, window: int = 120) -> DataFrame:
    """case, block, second, queue and level (0 to 3) of each second in [start, stop): the trailing mean of queued cars against the block's normal average.

    queued: case, block, second, cars (one row where cars queue). The average is the base case's over [start, stop), seconds
    without a row counting 0; blocks are those of any case. Cars before start - window count for nothing.
    """
    near = queued.where(F.col("second").between(start - window, stop - 1))
    grid = in_cases(near.select("block").distinct(), [BASE, *cases])
    grid = grid.withColumn("second", F.explode(F.sequence(F.lit(start - window), F.lit(stop - 1)).cast(f"array<{dict(queued.dtypes)['second']}>")))
    dense = grid.join(near, ["case", "block", "second"], "left").fillna(0.0, ["cars"])
    back = Window.partitionBy("case", "block").orderBy("second").rowsBetween(-(window - 1), 0)
    inside = F.col("second") >= start
    normal = near.where((F.col("case") == BASE) & inside).groupBy("block").agg((F.sum("cars") / (stop - start)).alias("normal"))
    q = dense.withColumn("queue", F.avg("cars").over(back)).where(inside).join(normal, "block", "left").fillna(0.0, ["normal"])
    extra = F.col("queue") - F.col("normal")
    bands = [((extra >= 2) & (extra >= share * F.col("normal"))).cast("int") for share in (0.2, 0.5, 1.0)]
    return q.select("case", "block", "second", "queue", "normal", (bands[0] + bands[1] + bands[2]).alias("level"))
