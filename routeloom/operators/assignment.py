"""Traffic assignment: route choice, relative gap, density, and the outer loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions import chance, roads
from routeloom.functions.ttf import let


def smoothed_costs(costs: Column, previous: Column, choice: Column, beta: float) -> Column:
    """Costs of the routes not chosen, mixed with those of the step before where there are any."""
    old = lambda i: F.try_element_at(previous, i + 1)
    return F.transform(costs, lambda c, i: F.when((i != choice) & old(i).isNotNull(), c * beta + old(i) * (1 - beta)).otherwise(c))


def gawron(costs: Column, probs: Column, a: float = 0.5) -> Column:
    """Probabilities after Gawron's pairwise updates (1998, equations 4.2 to 4.3).

    Pairs (i, j), i < j, are visited in order, and each shifts probability between its two
    routes, so that later pairs see earlier shifts: a fold over the pairs that carries the
    array. A negative cost starts with probability 0.
    """
    huge = F.lit(1.7976931348623157e308)
    clip = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))

    def update(c: Column, p0: Column) -> Column:
        n = F.size(c)
        none = F.array().cast("array<struct<i:int,j:int>>")
        later = lambda i: F.when(i < n - 1, F.transform(F.sequence(i + 1, n - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))).otherwise(none)
        pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), later))
        start = F.zip_with(c, p0, lambda x, p: F.when(x < 0, 0.0).otherwise(p))

        # Each step is bound once: nested uses of a column expression would multiply.
        def shift(p: Column, pair: Column) -> Column:
            known = F.struct(pair["i"].alias("i"), pair["j"].alias("j"), c[pair["i"]].alias("ci"), c[pair["j"]].alias("cj"), p[pair["i"]].alias("pi"), p[pair["j"]].alias("pj"))
            return let(known, lambda k: let((k["cj"] - k["ci"]) / (k["cj"] + k["ci"]), lambda x: let(1 - x * x, lambda d: let(F.when(d == 0, huge).otherwise(F.exp(a * x / d)), lambda g: _moved(p, k, g)))))

        def _moved(p: Column, k: Column, g: Column) -> Column:
            new = let(k["pi"] * g + k["pj"], lambda w: F.when(w == 0, huge).otherwise(k["pi"] * (k["pi"] + k["pj"]) * g / w))

            def both(v: Column) -> Column:
                lost, dearer = F.isnan(v) | v.isNull(), k["cj"] > k["ci"]
                to_i = F.when(lost, F.when(dearer, 1.0).otherwise(0.0)).otherwise(clip(v))
                to_j = F.when(lost, F.when(dearer, 0.0).otherwise(1.0)).otherwise(clip(k["pi"] + k["pj"] - v))
                return F.struct(to_i.alias("a"), to_j.alias("b"))

            return let(let(new, both), lambda s: F.transform(p, lambda v, m: F.when(m == k["i"], s["a"]).when(m == k["j"], s["b"]).otherwise(v)))

        return F.when(n <= 1, start).otherwise(F.aggregate(pairs, start, shift))

    return let(F.struct(costs.alias("c"), probs.alias("p")), lambda s: update(s["c"], s["p"]))


def c_logit(costs: Column, paths: Column, beta: float = -1.0, gamma: float = 1.0, theta: float = -1.0) -> Column:
    """C-logit probabilities with Lohse's automatic theta and beta where they are negative.

    The overlap of two paths is the number of the first one's edges that the second has,
    times the mean of both paths' mean edge times; of equal paths the smaller cost.
    """
    return let(F.struct(costs.alias("c"), paths.alias("p")), lambda s: _c_logit(s["c"], s["p"], beta, gamma, theta))


def _c_logit(costs: Column, paths: Column, beta: float, gamma: float, theta: float) -> Column:
    n = F.size(costs)
    mean = F.aggregate(costs, F.lit(0.0), lambda s, c: s + c / 3600) / n
    least = F.array_min(costs) / 3600
    auto_theta = let(
        F.struct(mean.alias("m"), least.alias("l"), costs.alias("c")),
        lambda s: let(
            F.sqrt(F.aggregate(s["c"], F.lit(0.0), lambda v, c: v + F.pow(c / 3600 - s["m"], F.lit(2))) / F.size(s["c"])) / s["m"],
            lambda cv: F.when(cv > 0, F.pi() / (F.sqrt(F.lit(6.0)) * cv * (s["l"] + 1.1)) / 3600).otherwise(1 / 3600),
        ),
    )
    t = auto_theta if theta < 0 else F.lit(theta)
    b = least if beta < 0 else F.lit(beta)

    def overlap(pi: Column, pj: Column, ci: Column, cj: Column) -> Column:
        common = F.size(F.filter(pi, lambda e: F.array_contains(pj, e)))
        return F.when(pi == pj, F.least(ci, cj)).otherwise(common * (ci / F.size(pi) + cj / F.size(pj)) / 2)

    places = F.sequence(F.lit(0), n - 1)
    shared = lambda i: F.aggregate(places, F.lit(0.0), lambda s, j: s + F.pow(overlap(paths[i], paths[j], costs[i], costs[j]) / F.sqrt(costs[i] * costs[j]), F.lit(gamma)))
    utility = F.transform(places, lambda i: costs[i] + F.when(b > 0, b * F.log(shared(i))).otherwise(0.0))
    probs = let(F.struct(utility.alias("u"), t.alias("t")), lambda s: F.transform(s["u"], lambda ui: 1 / F.aggregate(s["u"], F.lit(0.0), lambda z, uj: z + F.exp(s["t"] * (ui - uj)))))
    return F.when(n == 0, F.array().cast("array<double>")).when(n == 1, F.array(F.lit(1.0))).otherwise(probs)


def prune(alternatives: DataFrame, most: int) -> DataFrame:
    """Keeps each query's ``most`` likeliest routes and makes their probabilities sum to 1.

    Of equally likely routes the first are dropped. Rows keep their alt_ix, so that a choice
    recorded by it stays right.
    """
    q = Window.partitionBy("query_id")
    place = F.row_number().over(q.orderBy("prob", "alt_ix"))
    kept = alternatives.withColumn("_drop", F.count(F.lit(1)).over(q) - most).withColumn("_k", place).where(F.col("_k") > F.col("_drop"))
    total = F.sum("prob").over(q)
    return kept.withColumn("prob", F.when((F.col("_drop") > 0) & (total > 0), F.col("prob") / total).otherwise(F.col("prob"))).drop("_k", "_drop")


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) from a hash: the same for the same row, however it is partitioned."""
    return chance.uniform(*columns, seed)


def choose(alternatives: DataFrame, seed: int) -> DataFrame:
    """One route per query, drawn by its probability: query_id, alt_ix."""
    w = Window.partitionBy("query_id").orderBy("alt_ix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a = alternatives.withColumns({"_upto": F.sum("prob").over(w), "_all": F.sum("prob").over(Window.partitionBy("query_id")), "_u": uniform(seed, "query_id")})
    return a.where(F.col("_upto") > F.col("_u") * F.col("_all")).groupBy("query_id").agg(F.min("alt_ix").alias("alt_ix"))


def kept_routes(queries: DataFrame, share: float, seed: int) -> DataFrame:
    """A flag for each query whether it keeps its route, true for a share of them."""
    return queries.withColumn("keeps", uniform(seed, "query_id") < share)


def samples(queries: DataFrame, shares: list[float], seed: int) -> DataFrame:
    """Disjoint samples that cover all queries: column ``sample``, by ranges of a random rank.

    Sizes are rounded shares of the number of queries; the last takes the rest.
    """
    from routeloom.operators.network import dense_ids

    n = queries.count()
    cuts, upto, total = [], 0, sum(shares)
    for s in shares[:-1]:
        upto = min(n, upto + int(n * s / total + 0.5))
        cuts.append(upto)
    ranked = dense_ids(queries.withColumn("_u", chance.drawn("query_id", seed)), ["_u", "query_id"], "_rank")
    sample = F.lit(len(shares) - 1)
    for k in reversed(range(len(cuts))):
        sample = F.when(F.col("_rank") < cuts[k], k).otherwise(sample)
    return ranked.withColumn("sample", sample).drop("_u", "_rank")


def merge_new_paths(alternatives: DataFrame, found: DataFrame) -> DataFrame:
    """Alternatives (query_id, alt_ix, path, cost, prob) with each query's newest path.

    A known path takes the new cost; an unknown one is appended with probability 1/n, and the
    others are scaled by (n-1)/n. A negative cost counts as infinite.
    """
    new = found.select("query_id", F.col("path").alias("n_path"), F.col("cost").alias("n_cost"))
    q = Window.partitionBy("query_id")
    j = alternatives.join(new, "query_id", "left").withColumn("_same", F.coalesce(F.col("path") == F.col("n_path"), F.lit(False)))
    j = j.withColumns({"_known": F.max("_same").over(q), "_n": F.count(F.lit(1)).over(q)})
    grows = ~F.col("_known") & F.col("n_path").isNotNull()
    cost = F.when(F.col("_same"), F.col("n_cost")).when(F.col("cost") < 0, F.lit(float("inf"))).otherwise(F.col("cost"))
    prob = F.when(grows, F.col("prob") * F.col("_n") / (F.col("_n") + 1)).otherwise(F.col("prob"))
    old = j.select("query_id", "alt_ix", "path", cost.alias("cost"), prob.alias("prob"))
    added = j.where(grows).groupBy("query_id").agg(F.max("alt_ix").alias("m"), F.first("n_path").alias("path"), F.first("n_cost").alias("cost"), F.max("_n").alias("n"))
    added = added.select("query_id", (F.col("m") + 1).cast(alternatives.schema["alt_ix"].dataType).alias("alt_ix"), "path", "cost", (1 / (F.col("n") + 1)).alias("prob"))
    fresh = new.join(alternatives, "query_id", "left_anti").select("query_id", F.lit(0).cast(alternatives.schema["alt_ix"].dataType).alias("alt_ix"), F.col("n_path").alias("path"), F.col("n_cost").alias("cost"), F.lit(1.0).alias("prob"))
    return old.unionByName(added).unionByName(fresh)


def relative_gap(trips: DataFrame, simulated: str = "simulated", best: str = "best") -> DataFrame:
    """Excess over the best travel times, in their share; differences under a second are none."""
    d = F.col(simulated) - F.col(best)
    excess = F.when(F.abs(d) < 1, 0.0).when(d < 0, 0.0).otherwise(d)
    return trips.agg((F.sum(excess) / F.sum(best)).alias("gap"), F.sum(simulated).alias("experienced"), F.count(F.lit(1)).alias("trips"))


def frozen_density(traversals: DataFrame, interval: int) -> DataFrame:
    """Vehicle seconds by edge and interval from signed traversals (edge_id, enter, exit, sign).

    The batch form of following paths: every traversal uses the same travel times, so that
    the sum is an ordinary aggregation. ``follow_paths`` is the exact, sequential one.
    """
    from routeloom.operators.measurements import overlaps

    return overlaps(traversals, interval).groupBy("edge_id", "begin_s").agg(F.sum(F.col("sign") * F.col("seconds")).alias("vehicle_seconds"))


def speeds_by_density(measured: DataFrame, interval: int, jam: float = 60.0) -> DataFrame:
    """Density, modelled speed and travel time of measurements with length, lanes, free_flow."""
    density = roads.lane_density(F.col("sampled"), F.col("overlap_tt"), F.lit(interval), F.col("length"), F.col("lanes"))
    m = measured.withColumn("density", F.least(density, F.lit(jam)))
    m = m.withColumn("speed", roads.modified_lee(F.col("density"), F.col("free_flow"), F.lit(jam), F.lit(2.0), F.lit(1.0), F.lit(0.5)))
    return m.withColumn("estimated", roads.estimated_travel_time(F.col("length"), F.col("speed")))


def assign(trips: DataFrame, route: Callable[[DataFrame, DataFrame], DataFrame], cost: Callable[[DataFrame, DataFrame], DataFrame], weights: DataFrame, rounds: int, most: int = 5, seed: int = 1, a: float = 0.5) -> tuple[DataFrame, list[float]]:
    """The outer loop: route, merge alternatives, choose by Gawron, update weights, measure the gap.

    ``route(trips, weights)`` gives query_id, path, cost; ``cost(chosen, weights)`` the next
    weights from chosen paths. Every round's alternatives are a written table; only the gap,
    one number, reaches the driver.
    """
    from routeloom.operators.tables import written

    alternatives, gaps = None, []
    for k in range(rounds):
        found = written(route(trips, weights), "found")
        if alternatives is None:
            merged = found.select("query_id", F.lit(0).alias("alt_ix"), "path", "cost", F.lit(1.0).alias("prob"))
        else:
            merged = merge_new_paths(alternatives, found)
        g = merged.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("alt_ix", "path", "cost", "prob"))).alias("r"))
        probs = gawron(F.transform("r", lambda x: x["cost"]), F.transform("r", lambda x: x["prob"]), a)
        each = g.select("query_id", F.explode(F.zip_with("r", probs, lambda x, p: F.struct(x["alt_ix"].alias("alt_ix"), x["path"].alias("path"), x["cost"].alias("cost"), p.alias("prob")))).alias("x")).select("query_id", "x.*")
        alternatives = written(prune(each, most), "alternatives")
        chosen = written(alternatives.join(choose(alternatives, seed + k), ["query_id", "alt_ix"]), "chosen")
        gap = relative_gap(chosen.select("query_id", F.col("cost").alias("simulated")).join(found.select("query_id", F.col("cost").alias("best")), "query_id")).first()["gap"]
        gaps.append(float(gap or 0.0))
        weights = written(cost(chosen, weights), "weights")
    return alternatives, gaps


def chosen_routes(alternatives: DataFrame, most: int, seed: int, a: float = 0.5, keeps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Alternatives with probabilities shifted by Gawron and pruned, and the route chosen of each query.

    ``keeps`` (query_id, alt_ix) are queries that keep their route, whatever is drawn.
    """
    from routeloom.operators.tables import written

    g = alternatives.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("alt_ix", "path", "cost", "prob"))).alias("r"))
    probs = gawron(F.transform("r", lambda x: x["cost"]), F.transform("r", lambda x: x["prob"]), a)
    each = g.select("query_id", F.explode(F.zip_with("r", probs, lambda x, p: F.struct(x["alt_ix"].alias("alt_ix"), x["path"].alias("path"), x["cost"].alias("cost"), p.alias("prob")))).alias("x")).select("query_id", "x.*")
    kept = written(prune(each, most), "alternatives")
    drawn = choose(kept, seed)
    if keeps is not None:
        held = keeps.select("query_id", F.col("alt_ix").alias("held")).join(kept.select("query_id", F.col("alt_ix").alias("held")), ["query_id", "held"], "left_semi")
        drawn = drawn.join(held, "query_id", "left").select("query_id", F.coalesce("held", "alt_ix").alias("alt_ix"))
    return kept, written(kept.join(drawn, ["query_id", "alt_ix"]), "chosen")


def two_stage_step(trips: DataFrame, weights: DataFrame, before: tuple[DataFrame, DataFrame] | None, route: Callable[[DataFrame, DataFrame], DataFrame], adjust: Callable[[DataFrame, DataFrame | None, DataFrame], DataFrame], along: Callable[[DataFrame, DataFrame], DataFrame], most: int = 5, seed: int = 1) -> tuple[DataFrame, DataFrame, float]:
    """One iteration of two-stage assignment: alternatives, chosen routes and the relative gap.

    Shortest routes on the simulated ``weights`` join the alternatives of ``before`` (alternatives,
    chosen) and are chosen from for a first time. ``adjust(weights, old, new)`` gives the weights
    that follow when vehicles leave their old routes for the chosen ones; routes that are shortest
    then, with their costs on the simulated weights (``along(found, weights)``), join too, and the
    final choice is made. ``route(trips, weights)`` gives query_id, path, cost.
    """
    from routeloom.operators.tables import written

    def merged(old: DataFrame | None, found: DataFrame) -> DataFrame:
        if old is None:
            return found.select("query_id", F.lit(0).alias("alt_ix"), "path", "cost", F.lit(1.0).alias("prob"))
        return written(merge_new_paths(old, found), "merged")

    shortest = written(route(trips, weights), "shortest")
    first = merged(before[0] if before else None, shortest)
    _, preferred = chosen_routes(first, most, seed)
    after = written(adjust(weights, before[1] if before else None, preferred), "adjusted")
    second = written(along(route(trips, after).select("query_id", "path"), weights), "second")
    alternatives, chosen = chosen_routes(merged(first, second), most, seed + 1)
    gap = relative_gap(chosen.select("query_id", F.col("cost").alias("simulated")).join(shortest.select("query_id", F.col("cost").alias("best")), "query_id")).first()["gap"]
    return alternatives, chosen, float(gap or 0.0)


def two_stage(trips: DataFrame, weights: DataFrame, rounds: int, route: Callable, adjust: Callable, along: Callable, most: int = 5, seed: int = 1) -> tuple[DataFrame, DataFrame, list[float]]:
    """Iterations of ``two_stage_step``, each on the weights that the last one's choice leaves; with
    the gap of every iteration."""
    from routeloom.operators.tables import written

    before, gaps, now = None, [], weights
    for k in range(rounds):
        alternatives, chosen, gap = two_stage_step(trips, now, before, route, adjust, along, most, seed + 2 * k)
        now = written(adjust(now, before[1] if before else None, chosen), "weights")
        before = (alternatives, chosen)
        gaps.append(gap)
    return before[0], before[1], gaps


def iteration_gaps(routes: DataFrame, best: DataFrame) -> DataFrame:
    """The relative gap of every iteration from the routes driven (iteration, query_id, cost) and the
    best costs on that iteration's weights; one job over all of them."""
    d = routes.join(best.select("iteration", "query_id", F.col("cost").alias("best")), ["iteration", "query_id"]).withColumn("d", F.col("cost") - F.col("best"))
    excess = F.when((F.abs("d") < 1) | (F.col("d") < 0), 0.0).otherwise(F.col("d"))
    return d.groupBy("iteration").agg((F.sum(excess) / F.sum("best")).alias("gap"), F.count(F.lit(1)).alias("trips"))
