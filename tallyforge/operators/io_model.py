"""Input-output economics on DataFrames: coefficients, inverses, shocks, cascades and allocation.

A model is long: (model_id, i, j, a). Sums, shares and shocks are joins and aggregates; only
the n x n solve, whose matrices are as small as the number of sectors, runs as one numpy
call for each model in a grouped map.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEGLIGIBLE, MOST_ROUNDS = 1e-9, 100
UPSTREAM, DOWNSTREAM = 0.35, 0.55


def coefficients(z: DataFrame, output: DataFrame) -> DataFrame:
    """a_ij = z_ij / x_j; columns without output have none."""
    return z.join(F.broadcast(output), "j").where("x <> 0").select("model_id", "i", "j", (F.col("z") / F.col("x")).alias("a"))


def outputs(z: DataFrame, value_added: DataFrame) -> DataFrame:
    """x_j: what a sector buys from all plus its value added."""
    bought = z.groupBy("j").agg(F.sum("z").alias("bought"))
    return bought.join(value_added, "j", "full_outer").select("j", (F.coalesce("bought", F.lit(0.0)) + F.coalesce("labor", F.lit(0.0)) + F.coalesce("capital", F.lit(0.0))).alias("x"))


def final_demand(z: DataFrame, output: DataFrame) -> DataFrame:
    """d_i = x_i less what sectors buy from i; it may be negative."""
    sold = z.groupBy("i").agg(F.sum("z").alias("sold"))
    return output.select(F.col("j").alias("i"), "x").join(sold, "i", "left").select("i", "x", (F.col("x") - F.coalesce("sold", F.lit(0.0))).alias("d"))


def allocation(a: DataFrame, output: DataFrame) -> DataFrame:
    """The supply-side matrix b_ij = a_ij x_j / x_i; rows without output are skipped."""
    seller, buyer = output.select(F.col("j").alias("i"), F.col("x").alias("xi")), output.select("j", F.col("x").alias("xj"))
    found = a.join(F.broadcast(seller), "i").join(F.broadcast(buyer), "j").where("xi <> 0")
    return found.select("model_id", "i", "j", (F.col("a") * F.col("xj") / F.col("xi")).alias("a"))


def dense(rows: pd.DataFrame) -> tuple[list[int], np.ndarray]:
    names = sorted(set(rows["i"]) | set(rows["j"]))
    place = {x: k for k, x in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    np.add.at(out, (rows["i"].map(place).to_numpy(), rows["j"].map(place).to_numpy()), rows["a"].to_numpy())
    return names, out


def inverse(a: DataFrame) -> DataFrame:
    """(I - A)^-1 of each model, long: (model_id, i, j, l)."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names, m = dense(rows)
        found = np.linalg.solve(np.eye(len(names)) - m, np.eye(len(names)))
        at = np.indices(found.shape).reshape(2, -1)
        return pd.DataFrame({"model_id": rows["model_id"].iloc[0], "i": np.array(names)[at[0]], "j": np.array(names)[at[1]], "l": found.ravel()})

    return a.groupBy("model_id").applyInPandas(solve, "model_id string, i int, j int, l double")


def diagnostics(a: DataFrame) -> DataFrame:
    """Condition number of I - A in the 2-norm and spectral radius of A."""

    def measure(rows: pd.DataFrame) -> pd.DataFrame:
        names, m = dense(rows)
        return pd.DataFrame({"model_id": [rows["model_id"].iloc[0]], "sectors": [len(names)], "condition": [np.linalg.cond(np.eye(len(names)) - m)], "radius": [np.abs(np.linalg.eigvals(m)).max()]})

    return a.groupBy("model_id").applyInPandas(measure, "model_id string, sectors int, condition double, radius double")


def respond(inv: DataFrame, shock: DataFrame, transposed: bool = False) -> DataFrame:
    """(i, v): inverse times shock (k, s), or its transpose times it."""
    row, column = ("j", "i") if transposed else ("i", "j")
    return inv.join(F.broadcast(shock), inv[column] == shock["k"]).groupBy(F.col(row).alias("i")).agg(F.sum(F.col("l") * F.col("s")).alias("v"))


def ranked(response: DataFrame) -> DataFrame:
    """Responses that aren't negligible, with their rank by size."""
    from pyspark.sql import Window

    found = response.where(F.abs("v") > NEGLIGIBLE)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("v").desc(), "i")))  # one row for each sector


def cascade(a: DataFrame, origin: int, magnitude: float, transposed: bool = False) -> DataFrame:
    """(model_id, round, i, v): round 0 is the shock, each next A (or A') times the last, for all sectors.

    Ends with the first round in which all are negligible, which is recorded, or after
    MOST_ROUNDS. Rounds depend on each other and are as small as the number of sectors, so
    each model's are one grouped map, like its inverse.
    """

    def trace(rows: pd.DataFrame) -> pd.DataFrame:
        names, m = dense(rows)
        m = m.T if transposed else m
        now = np.array([magnitude if x == origin else 0.0 for x in names])
        rounds = [now]
        while len(rounds) <= MOST_ROUNDS and (len(rounds) == 1 or np.abs(now).max() >= NEGLIGIBLE):
            rounds.append(now := m @ now)
        out = pd.DataFrame({"round": np.repeat(np.arange(len(rounds)), len(names)), "i": names * len(rounds), "v": np.concatenate(rounds)})
        return out.assign(model_id=rows["model_id"].iloc[0])[["model_id", "round", "i", "v"]]

    return a.groupBy("model_id").applyInPandas(trace, "model_id string, round int, i int, v double")


def traced(rounds: DataFrame) -> DataFrame:
    """(model_id, i, total, depth, converged): what a cascade adds up to, its rounds after the shock, and whether it died out."""
    ends = rounds.groupBy("model_id", "round").agg(F.max(F.abs("v")).alias("most")).groupBy("model_id").agg(F.max("round").alias("depth"), F.min_by("most", -F.col("round")).alias("rest"))
    sums = rounds.groupBy("model_id", "i").agg(F.sum("v").alias("total"))
    return sums.join(ends, "model_id").select("model_id", "i", "total", "depth", (F.col("rest") < NEGLIGIBLE).alias("converged"))


def power_radius(a: DataFrame, rounds: int = 200) -> DataFrame:
    """(model_id, radius): the spectral radius by power iteration from a vector of ones, for coefficients that aren't negative."""

    def iterate(rows: pd.DataFrame) -> pd.DataFrame:
        names, m = dense(rows)
        v, size = np.ones(len(names)), 0.0
        for _ in range(rounds):
            w = m @ v
            size = np.abs(w).max()
            if size == 0:
                break
            v = w / size
        return pd.DataFrame({"model_id": [rows["model_id"].iloc[0]], "radius": [size]})

    return a.groupBy("model_id").applyInPandas(iterate, "model_id string, radius double")


def multipliers(inv: DataFrame) -> DataFrame:
    return inv.groupBy(F.col("j").alias("i")).agg(F.sum("l").alias("multiplier"))


def row_centrality(inv: DataFrame) -> DataFrame:
    """Row sums over their mean; all zero if the mean is."""
    from pyspark.sql import Window

    sums = inv.groupBy("i").agg(F.sum("l").alias("s"))
    return sums.select("i", F.coalesce(F.try_divide("s", F.avg("s").over(Window.partitionBy())), F.lit(0.0)).alias("centrality"))


def profiles(demand: DataFrame) -> DataFrame:
    """Share of final demand in output, orientation, and the shock kind that suits it."""
    share = F.when(F.col("x") == 0, 0.0).otherwise(F.col("d") / F.col("x"))
    kind = F.when(F.col("share") < UPSTREAM, "Upstream").when(F.col("share") > DOWNSTREAM, "Downstream").otherwise("Mixed")
    return demand.withColumn("share", share).select("i", "share", kind.alias("orientation"), F.when(F.col("share") < UPSTREAM, "Supply").otherwise("Demand").alias("shock"))


def allocate(members: DataFrame, deltas: DataFrame, price: bool = False) -> DataFrame:
    """A sector's change over its companies: (sector, id, industry, weight, value).

    Weights are shares of positive revenue; if a sector has none, all members are equal. A
    price change is worth revenue times the change. Members without a sector have no part.
    Totals are summed apart and joined back, so that a large sector is never gathered.
    """
    known, earns = members.where("sector is not null"), F.col("revenue_total") > 0
    sums = known.groupBy("sector").agg(F.sum(F.when(earns, F.col("revenue_total"))).alias("total"), F.count("*").alias("n"))
    found = known.join(F.broadcast(sums.join(deltas.where(F.abs("v") > NEGLIGIBLE), "sector")), "sector")  # one row for each sector
    weight = F.when(F.col("total") > 0, F.when(earns, F.col("revenue_total") / F.col("total")).otherwise(0.0)).otherwise(1.0 / F.col("n"))
    value = F.coalesce("revenue_total", F.lit(0.0)) * F.col("v") if price else weight * F.col("v")
    return found.select("sector", "id", F.coalesce("industry", F.lit("Unclassified")).alias("industry"), weight.alias("weight"), value.alias("value"))


def extremes(members: DataFrame) -> DataFrame:
    """(sector, companies, most_weight, least_weight, most_revenue, least_revenue): all that the largest change of a company needs, in one pass.

    Weights are those of allocate(): shares of positive revenue, all equal where a sector has none.
    """
    earns, revenue = F.col("revenue_total") > 0, F.coalesce("revenue_total", F.lit(0.0))
    positive = F.when(earns, F.col("revenue_total"))
    sums = members.where("sector is not null").groupBy("sector").agg(
        F.count("*").alias("companies"), F.count(positive).alias("earning"), F.sum(positive).alias("total"), F.max(positive).alias("most"), F.min(positive).alias("least"), F.max(revenue).alias("most_revenue"), F.min(revenue).alias("least_revenue")
    )
    some, equal = F.col("total") > 0, 1.0 / F.col("companies")
    most = F.when(some, F.col("most") / F.col("total")).otherwise(equal)
    least = F.when(some & (F.col("earning") < F.col("companies")), 0.0).when(some, F.col("least") / F.col("total")).otherwise(equal)
    return sums.select("sector", "companies", most.alias("most_weight"), least.alias("least_weight"), "most_revenue", "least_revenue")
