"""Problem 3: missing values filled from similar records by predictive mean matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.operators.ranges import range_extremes

# The known sources of a capture time, best last (their place is the code the predictor works on).
TIME_SOURCES = ["file_mtime", "file_created", "filename", "sibling", "exif"]


class Field:
    """A field to fill: ``name`` and ``code``, its observed value as a long (null where missing), and back to text."""

    def __init__(self, name: str, levels: list[str] | None = None):
        self.name, self.levels = name, levels

    def code(self) -> Column:
        if self.levels is None:
            v = F.expr(f"try_cast(`{self.name}` as bigint)")
            return F.when(v > 0, v)
        return reduce(lambda c, kv: c.when(F.col(self.name) == kv[1], F.lit(kv[0]).cast("long")), enumerate(self.levels), F.when(F.lit(False), F.lit(0).cast("long")))

    def text(self, code: Column) -> Column:
        if self.levels is None:
            return code.cast("string")
        return F.element_at(F.array(*map(F.lit, self.levels)), (code + 1).cast("int"))


CATALOGUE_FIELDS = [Field("width"), Field("height"), Field("taken_at_source", TIME_SOURCES)]


#: Predictions are rounded to this many decimals, so that they are the same however sums are ordered.
DECIMALS = 3


def fill_missing(rows: DataFrame, *, key: str, group: str, model: str, time: str, fields: list[Field] = CATALOGUE_FIELDS, window_ms: int = 30 * 60 * 1000, agreed_only: bool = False) -> DataFrame:
    """(key, field_name, fill_text, donor_id, level, prediction, distance) for each missing cell that can be filled.

    Predictive mean matching. A predictor is fitted for each group, model and field: for numbers a line over time, for
    fields with levels the level seen most. Each missing cell gets its prediction; among its donors the observed value nearest
    to the prediction is copied, never the prediction itself, with the id of a record that has it. Donors are searched at
    three levels, the first that has any holds. ``window``: the group's and model's records within ``window_ms``; it is called
    ``window_mixed`` if they hold several values. ``group``: all records of group and model. ``model``: all records of the
    model in any group, by a prediction fitted there, where the group has no observed value. Ties go to the smaller value, then id.
    Cells of records without group, model or time are left alone; repeated rows count once per cell; an empty table
    gives none. Only the named columns are read.
    """
    r = rows.select(F.col(key).alias("__id"), F.col(group).alias("__g"), F.col(model).alias("__m"), F.col(time).cast("long").alias("__t"), *[f.code().alias(f.name) for f in fields])
    r = r.where("__g is not null and __m is not null and __t is not null")
    each = lambda c: F.explode(F.array_compact(F.array(*[c(f.name) for f in fields])))
    at = ["__id", "__g", "__m", "__t"]
    obs = r.select(*at, each(lambda n: F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("field"), F.col(n).alias("v")))).alias("c")).select(*at, "c.*")
    cells = r.select(*at, each(lambda n: F.when(F.col(n).isNull(), F.lit(n))).alias("field")).distinct()
    on = ["__g", "__m", "field"]
    predicted = cells.join(_fit(obs, on, fields), on, "left").withColumn("p", _prediction(fields)).select(*at, "field", "p", "least", "most")
    found = _in_window(obs, predicted, on, window_ms, least_ids=not agreed_only)
    c = found.where("best is not null" + (" and low = high" if agreed_only else "")).withColumn("level", F.when(F.col("low") == F.col("high"), "window").otherwise("window_mixed"))
    if not agreed_only:
        rest = found.where("best is null")
        c = c.unionByName(_in_group(obs, rest.where("p is not null"), on)).unionByName(_in_model(obs, rest.where("p is null"), fields))
    text = reduce(lambda e, f: e.when(F.col("field") == f.name, f.text(F.col("best.v"))), fields, F.when(F.lit(False), F.lit("")))
    return c.select(F.col("__id").alias(key), F.col("field").alias("field_name"), text.alias("fill_text"), F.col("best.donor").alias("donor_id"), "level", F.col("p").alias("prediction"), F.col("best.d").alias("distance"))


def agreed_fills(rows: DataFrame, **kw) -> DataFrame:
    """Only the fills at window level, where all donors agree; the donor is the first or last record of a block of the window."""
    return fill_missing(rows, **kw, agreed_only=True)


def _fit(obs: DataFrame, on: list[str], fields: list[Field]) -> DataFrame:
    """The predictor of each group: mean, slope and centre of a line over time, the most frequent level, and the ends of the observed values."""
    t, v = F.col("__t").cast("double"), F.col("v").cast("double")
    levelled = F.col("field").isin([f.name for f in fields if f.levels is not None])
    return obs.groupBy(*on).agg(
        F.avg("v").alias("mean"), F.coalesce(F.regr_slope(v, t), F.lit(0.0)).alias("slope"), F.avg(t).alias("t0"),
        F.mode(F.when(levelled, F.col("v")), True).alias("mode"), F.min("v").alias("least"), F.max("v").alias("most"),
    )


def _prediction(fields: list[Field], over_time: bool = True) -> Column:
    levelled = F.col("field").isin([f.name for f in fields if f.levels is not None])
    line = F.col("mean") + F.col("slope") * (F.col("__t") - F.col("t0")) if over_time else F.col("mean")
    return F.when(levelled, F.col("mode").cast("double")).otherwise(F.round(line, DECIMALS))


def _in_window(obs: DataFrame, cells: DataFrame, on: list[str], window_ms: int, least_ids: bool) -> DataFrame:
    """``cells`` with the nearest donor of their window, and the least and greatest value there; null where the window has none.

    Blocks are as wide as the window reaches, so it holds the cell's own block, an end of the one before and a start of the one
    after: the last and first record of each distinct value of a block tell whether it is in. So a cell meets the distinct
    values of three blocks, not their rows. The donor is such a record, or with ``least_ids`` the one of least id in the window.
    """
    block = lambda c: F.floor(c / F.lit(window_ms))
    end = lambda agg: agg("__t") if least_ids else agg(F.struct("__t", "__id"))
    at = lambda c: F.col(c) if least_ids else F.col(f"{c}.__t")
    spans = obs.groupBy(*[F.col(c).alias(f"s_{c}") for c in on], block(F.col("__t")).alias("s_b"), "v").agg(end(F.min).alias("since"), end(F.max).alias("until"))
    q = cells.withColumn("b", F.explode(F.sequence(block(F.col("__t")) - 1, block(F.col("__t")) + 1)))
    here = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"s_{c}") for c in [*on, "b"]])
    near = q.join(spans, here & (at("until") >= F.col("__t") - window_ms) & (at("since") <= F.col("__t") + window_ms), "left")
    donor = [] if least_ids else [F.when(F.col("b") < block(F.col("__t")), F.col("until.__id")).otherwise(F.col("since.__id")).alias("donor")]
    nearest = F.min(F.when(F.col("v").isNotNull(), F.struct(F.abs(F.col("v") - F.col("p")).alias("d"), "v", *donor)))
    found = near.groupBy("__id", "__t", *on, "p", "least", "most").agg(nearest.alias("best"), F.min("v").alias("low"), F.max("v").alias("high"))
    if not least_ids:
        return found
    found = found.select("*", "best.d", "best.v").drop("best")
    won = found.where("v is not null").select(*on, "v", "__t").distinct()
    points = obs.join(won.select(*on, "v").distinct(), [*on, "v"], "left_semi").groupBy(*on, "v", "__t").agg(F.min("__id").alias("donor"))
    ids = range_extremes(points, won, group=[*on, "v"], at="__t", lo=F.col("__t") - window_ms, hi=F.col("__t") + window_ms, block=block, least=["donor"], most=[])
    return found.join(ids, [*on, "v", "__t"], "left").withColumn("best", F.when(F.col("v").isNotNull(), F.struct("d", "v", F.col("least_donor").alias("donor")))).drop("d", "v", "least_donor")


_COLUMNS = ["__id", "__t", "__g", "__m", "field", "p", "least", "most", "best", "low", "high", "level"]


def _in_group(obs: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
    """``cells`` with the value of their group nearest the prediction.

    The values next to the prediction from below and above, matched as-of. Values are whole numbers, so predictions
    that round up to one half are as near to the same value, and those beyond the group's ends are nearest to an end: a window partition
    holds a group's distinct values and at most twice the numbers between its ends, however many cells there are.
    """
    half = F.greatest(F.least(F.ceil(F.col("p") * 2), F.col("most") * 2), F.col("least") * 2).cast("long")
    cells = cells.withColumn("half", half)
    own = F.struct("v", "donor")
    values = obs.groupBy(*on, "v").agg(F.min("__id").alias("donor"))
    x = values.select(*on, (F.col("v") * 2).alias("half"), own.alias("own"), F.lit(0).alias("probe"))
    q = cells.select(*on, "half").distinct().select(*on, "half", F.lit(None).cast(x.schema["own"].dataType).alias("own"), F.lit(1).alias("probe"))
    last = lambda order: F.last("own", ignorenulls=True).over(Window.partitionBy(*on).orderBy(order, "probe").rowsBetween(Window.unboundedPreceding, 0))
    # The explicit partitioning keeps the window from trusting that the union's inputs are partitioned alike.
    u = x.unionByName(q).repartition(*on).withColumns({"below": last(F.col("half").asc()), "above": last(F.col("half").desc())}).where("probe = 1")
    lower = F.col("above").isNull() | (F.abs(F.col("below.v") * 2 - F.col("half")) <= F.abs(F.col("above.v") * 2 - F.col("half")))
    near = u.select(*on, "half", F.when(lower, F.col("below")).otherwise(F.col("above")).alias("n"))
    best = F.struct(F.abs(F.col("n.v") - F.col("p")).alias("d"), F.col("n.v").alias("v"), F.col("n.donor").alias("donor"))
    return cells.join(near, [*on, "half"]).withColumns({"best": best, "level": F.lit("group")}).select(*_COLUMNS)


def _in_model(obs: DataFrame, cells: DataFrame, fields: list[Field]) -> DataFrame:
    """``cells`` with the value of their model nearest what the model's records predict: the same for all cells of a model and field."""
    on = ["__m", "field"]
    fit = _fit(obs, on, fields).select(*on, "mean", "mode").withColumn("p", _prediction(fields, over_time=False))
    values = obs.groupBy(*on, "v").agg(F.min("__id").alias("donor"))
    best = values.join(fit, on).groupBy(*on, "p").agg(F.min(F.struct(F.abs(F.col("v") - F.col("p")).alias("d"), "v", "donor")).alias("best"))
    return cells.drop("p", "best").join(best, on).withColumn("level", F.lit("model")).select(*_COLUMNS)
