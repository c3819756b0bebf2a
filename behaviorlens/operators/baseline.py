"""Baselines: cohorts for users without history, and deviations from each user's own moving average."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from behaviorlens import config as C
from behaviorlens.config import BaselineConfig
from behaviorlens.operators.daily import long_form


def median_user_std(features: DataFrame) -> DataFrame:
    """(feature, median_std): median over users of the sample deviation over days; null or 0 becomes 1."""
    by_user = long_form(features, ["user"]).groupBy("user", "feature").agg(F.stddev_samp("x").alias("s"))
    return by_user.groupBy("feature").agg(F.coalesce(F.nullif(F.median("s"), F.lit(0.0)), F.lit(1.0)).alias("median_std"))


def cohort_statistics(features: DataFrame, ldap: DataFrame, min_cohort: int = 5) -> DataFrame:
    """(level, cohort, feature, users, mean, var) for roles, departments and everybody, in one grouping.

    Means and population variances are over all days of the members; a user counts with one
    directory row. Roles and departments with too few users with data are left out.
    """
    rows = features.join(one_row_per_user(ldap), features.user == F.col("user_id"), "left").select("user", "role", "department", *C.FEATURES)
    rows = long_form(rows, ["user", "role", "department"])
    stats = rows.groupingSets([["feature", "role"], ["feature", "department"], ["feature"]], "feature", "role", "department").agg(
        F.grouping("role").alias("gr"), F.grouping("department").alias("gd"), F.countDistinct("user").alias("users"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")
    )
    level = F.when(F.col("gr") == 0, "role").when(F.col("gd") == 0, "department").otherwise("global")
    out = stats.select(level.alias("level"), F.coalesce("role", "department", F.when((F.col("gr") == 1) & (F.col("gd") == 1), "all")).alias("cohort"), "feature", "users", "mean", "var")
    return out.where(F.col("cohort").isNotNull() & ((F.col("level") == "global") | (F.col("users") >= min_cohort)))


def one_row_per_user(ldap: DataFrame) -> DataFrame:
    """The last directory row of each user, by role and department where nothing else orders them."""
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("role"), F.desc("department")))
    return ldap.withColumn("_n", last).where("_n = 1").drop("_n")


def assign_cohorts(features: DataFrame, ldap: DataFrame, min_cohort: int = 5) -> DataFrame:
    """(user, level, cohort): a user's role if it has enough users with data, else the department, else everybody."""
    users = features.select("user").distinct()
    people = users.join(one_row_per_user(ldap), users.user == F.col("user_id"), "left").select("user", "role", "department")
    sized = lambda c: people.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias(f"n_{c}"))
    both = people.join(sized("role"), "role", "left").join(sized("department"), "department", "left")
    by_role, by_dept = F.coalesce(F.col("n_role") >= min_cohort, F.lit(False)), F.coalesce(F.col("n_department") >= min_cohort, F.lit(False))
    return both.select(
        "user", F.when(by_role, "role").when(by_dept, "department").otherwise("global").alias("level"), F.when(by_role, F.col("role")).when(by_dept, F.col("department")).otherwise("all").alias("cohort")
    )


def _fold(config: BaselineConfig) -> Column:
    """The moving average over `days`, an array of (day, x) by day, from `m0`, `v0` after `start` days.

    A day is scored against the state before it. The variance moves with the mean that the day has
    already moved.
    """
    a = F.lit(config.alpha)

    def step(s: Column, r: Column) -> Column:
        before = s["i"] < F.col("start")
        m = (1 - a) * s["m"] + a * r["x"]
        v = (1 - a) * s["v"] + a * (r["x"] - m) * (r["x"] - m)
        z = (r["x"] - s["m"]) / F.greatest(F.sqrt(s["v"] + config.epsilon), F.col("floor"))
        kept = F.struct(s["m"].alias("m"), s["v"].alias("v"), F.lit(0.0).alias("z"), (s["i"] + 1).alias("i"))
        moved = F.struct(m.alias("m"), v.alias("v"), z.alias("z"), (s["i"] + 1).alias("i"))
        return F.when(before, kept).otherwise(moved)

    def stretch(state: Column, days: Column) -> Column:
        """The state after some days, and z of each of them."""
        start = F.struct(state.alias("s"), F.array().cast("array<struct<day: date, z: double>>").alias("out"))
        return F.aggregate(days, start, lambda acc, r: let(step(acc["s"], r), lambda s: F.struct(s.alias("s"), F.concat(acc["out"], F.array(F.struct(r["day"].alias("day"), s["z"].alias("z")))).alias("out"))))

    # Appending copies an array, so the days go in stretches as long as the root of their number, each with its own array.
    first = F.struct(F.col("m0").alias("m"), F.col("v0").alias("v"), F.lit(0.0).alias("z"), F.lit(0).alias("i"))
    length = F.greatest(F.ceil(F.sqrt(F.size("days"))), F.lit(1)).cast("int")
    stretches = let(length, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size("days") - 1) / n).cast("int")), lambda k: F.slice("days", k * n + 1, n)))
    return F.aggregate(
        stretches,
        F.struct(first.alias("s"), F.array().cast("array<array<struct<day: date, z: double>>>").alias("parts")),
        lambda acc, days: let(stretch(acc["s"], days), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["parts"], F.array(r["out"])).alias("parts"))),
        lambda acc: F.flatten(acc["parts"]),
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def deviations(features: DataFrame, cohorts: DataFrame | None = None, floors: DataFrame | None = None, config: BaselineConfig = BaselineConfig()) -> DataFrame:
    """(user, day, feature, z) of every feature against the user's own moving average.

    `cohorts` has (user, feature, mean, var): such users start from their prior on the first day.
    Others start after `min_history` days from these days' mean and population variance, and have
    z 0 until then; with fewer days all are 0. Deviations are floored by `floors` (feature,
    median_std) times `floor_ratio`, or by 0.1 without them.
    """
    # One row for a user's day is shuffled; the features are taken apart after it.
    values = F.array(*[F.col(n).cast("double") for n in C.FEATURES])
    users = features.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("day", values.alias("x")))).alias("days"))
    history = users.select("user", "days", F.posexplode(F.array(*map(F.lit, C.FEATURES))).alias("_i", "feature"))
    history = history.select("user", "feature", F.transform("days", lambda d: F.struct(d["day"].alias("day"), F.get(d["x"], F.col("_i")).alias("x"))).alias("days"))
    if cohorts is None:
        history = history.withColumns({"pm": F.lit(None).cast("double"), "pv": F.lit(None).cast("double")})
    else:
        history = history.join(cohorts.select("user", "feature", F.col("mean").alias("pm"), F.col("var").alias("pv")), ["user", "feature"], "left")
    if floors is None:
        history = history.withColumn("floor", F.lit(config.floor_ratio))
    else:
        history = history.join(F.broadcast(floors.select("feature", (F.col("median_std") * config.floor_ratio).alias("floor"))), "feature")
    n = config.min_history
    head = F.transform(F.slice("days", 1, n), lambda d: d["x"])
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    enough = F.size("days") >= n
    history = history.withColumn("hm", F.when(enough, total(head) / n))
    spread = F.aggregate(head, F.lit(0.0), lambda a, x: a + (x - F.col("hm")) * (x - F.col("hm")))
    history = history.withColumns(
        {
            "m0": F.coalesce("pm", "hm", F.lit(0.0)),
            "v0": F.coalesce("pv", F.when(enough, spread / n), F.lit(0.0)),
            "start": F.when(F.col("pm").isNotNull(), 0).when(enough, n).otherwise(F.size("days")),
        }
    )
    return history.select("user", "feature", F.explode(_fold(config)).alias("d")).select("user", "d.day", "feature", "d.z")


def wide_deviations(z: DataFrame) -> DataFrame:
    """user, day and one column of z-scores per feature."""
    return z.groupBy("user", "day").pivot("feature", list(C.FEATURES)).agg(F.first("z"))


def daily_magnitude(z: DataFrame) -> DataFrame:
    """(user, day, mean_abs_z, max_abs_z) over all features."""
    return z.groupBy("user", "day").agg(F.avg(F.abs("z")).alias("mean_abs_z"), F.max(F.abs("z")).alias("max_abs_z"))


def validate(z: DataFrame, insiders: DataFrame, threshold: float = 2.0) -> DataFrame:
    """For each insider with days in the attack: mean |z| in it and before it, their ratio, the gate."""
    magnitude = z.join(insiders, z.user == insiders.user_id)
    inside = F.col("day").between(F.to_date("attack_start"), F.to_date("attack_end"))
    before = F.col("day") < F.to_date("attack_start")
    out = magnitude.groupBy("user").agg(
        F.avg(F.when(inside, F.abs("z"))).alias("attack"), F.avg(F.when(before, F.abs("z"))).alias("pre"), F.max(F.when(inside, F.abs("z"))).alias("max_attack")
    )
    return out.where("attack is not null").select("user", "attack", "pre", "max_attack", (F.col("attack") / F.nullif(F.col("pre"), F.lit(0.0))).alias("lift"), (F.col("attack") > threshold).alias("passed"))
