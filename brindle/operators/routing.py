"""Dataflow control as DataFrame plans: projection into records, fan-out over
collections, conditional routing, merges of results and error routing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]
NO_CASE = "no case matched and there is no default"


def call(df: DataFrame, arguments: dict[str, Column], keep: list[str] = ()) -> DataFrame:
    """A step: project named arguments, each with the given expression."""
    return df.select(*keep, *[c.alias(name) for name, c in arguments.items()])


def record(**fields: Column) -> Column:
    """Instantiate a schema."""
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def foreach(df: DataFrame, values: str, variable: str, position: str = "position") -> DataFrame:
    """One row per element of an array, or per key of a map, with its position.

    Empty and null collections give no rows, so what follows them is done at
    once. A variable of the same name as a column shadows it.
    """
    kind = dict(df.dtypes)[values]
    items = F.array_sort(F.map_keys(values)) if kind.startswith("map") else F.col(values)
    kept = [c for c in df.columns if c not in (variable, position)]
    return df.select(*kept, F.posexplode(items).alias(position, variable))


def route(df: DataFrame, cases: list[tuple[Column, Step | dict[str, Column]]], default: Step | dict[str, Column] | None = None) -> DataFrame:
    """``when`` routing: a row goes to every case that holds, to the default if
    none does; with no default, a row without a case raises. A null condition
    does not hold.

    Steps that are projections (name -> Column) are all computed in one scan; a
    field that one lacks is null there. Steps that are functions on a DataFrame
    scan the input once per branch, by filters that reach the source, and
    results are merged by name.
    """
    held = [F.coalesce(condition, F.lit(False)) for condition, _ in cases]
    none = ~F.greatest(F.lit(False), *held)
    steps = [step for _, step in cases]
    if all(isinstance(step, dict) for step in [*steps, *([] if default is None else [default])]):
        names = list(dict.fromkeys(n for step in [*steps, default or {}] for n in step))
        project = lambda step: F.struct(*[step.get(n, F.lit(None)).alias(n) for n in names])
        last = project(default) if default is not None else F.raise_error(F.lit(NO_CASE))
        return df.select(F.inline(F.array_compact(F.array(*[F.when(h, project(step)) for h, step in zip(held, steps, strict=True)], F.when(none, last)))))
    branches = [_applied(step, df.filter(h)) for h, step in zip(held, steps, strict=True)]
    rest = df.filter(none)
    if default is not None:
        branches.append(_applied(default, rest))
    else:
        branches.append(_applied(steps[0], rest.filter(F.raise_error(F.lit(NO_CASE)).isNull())))
    return merge(*branches)


def _applied(step: Step | dict[str, Column], df: DataFrame) -> DataFrame:
    return call(df, step) if isinstance(step, dict) else step(df)


def merge(*parts: DataFrame) -> DataFrame:
    """Yields of several blocks as one table; fields that one lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def last_writer(df: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """Yields of a fan-out into one record: per field the value of the last
    writer that set it. Partial aggregation, no sort."""
    return df.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def attempt(df: DataFrame, outputs: dict[str, Column], checks: list[tuple[Column, str, str]]) -> DataFrame:
    """Compute outputs and carry errors as columns, not exceptions.

    ``checks`` are (condition, error type, message): the first that holds makes
    the row an error row with null outputs.
    """
    kind, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for condition, error_type, text in reversed(checks):
        bad = F.coalesce(condition, F.lit(False))
        kind, message = F.when(bad, error_type).otherwise(kind), F.when(bad, text).otherwise(message)
    out = df.withColumns({"error_type": kind, "error": message})
    return out.withColumns({name: F.when(F.col("error_type").isNull(), c) for name, c in outputs.items()})


def catch(df: DataFrame, handler: Step | dict[str, Column], when: Column | None = None) -> DataFrame:
    """Send error rows through a handler. With ``when``, error rows that do not
    match it complete without the handler: the error is swallowed. A handler
    that is a projection (name -> Column) needs one scan."""
    if isinstance(handler, dict):
        failed = F.col("error_type").isNotNull()
        match = failed & (F.lit(True) if when is None else F.coalesce(when, F.lit(False)))
        before = lambda c: F.col(c) if c in df.columns else F.lit(None)
        swallowed = {c: F.when(~failed | match, F.col(c)) for c in ("error_type", "error") if c not in handler}
        return df.withColumns({**swallowed, **{c: F.when(match, e).otherwise(before(c)) for c, e in handler.items()}})
    fine = df.filter("error_type is null")
    failed = df.filter("error_type is not null")
    if when is None:
        return merge(fine, handler(failed))
    match = F.coalesce(when, F.lit(False))
    return merge(fine, handler(failed.filter(match)), failed.filter(~match).withColumns({"error_type": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}))


def block_outcome(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A block fails, after all its steps ended, with its first error."""
    failed = F.col("error_type").isNotNull()
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(failed).alias("failed"), F.min_by(F.col("error"), F.when(failed, F.col(order))).alias("error")
    )


def outcome(state: Column, outputs: Column, error: Column) -> Column:
    """A run's result: outputs when complete, else its error or that it did not complete."""
    done = state == "complete"
    return F.struct(done.alias("success"), F.when(done, outputs).alias("outputs"), F.when(~done, F.coalesce(error, F.lit("did not complete"))).alias("error"))


def option(default: Column, site: Column) -> Column:
    """A mixin option: the call site replaces the signature's value."""
    return F.coalesce(site, default)


def timeout_ms(hours: Column, minutes: Column, seconds: Column) -> Column:
    """Additive units of a timeout; null units count as zero."""
    unit = lambda c, n: F.coalesce(c, F.lit(0)) * n
    return (unit(hours, 3_600_000) + unit(minutes, 60_000) + unit(seconds, 1000)).cast("long")


def ready(steps: DataFrame, done: DataFrame, step: str = "step_id", needs: str = "needs") -> DataFrame:
    """Steps whose needs are all done and that are not done themselves."""
    open_needs = steps.select(step, F.explode(needs).alias("_need")).join(done.select(F.col(step).alias("_need")), "_need", "left_anti")
    return steps.join(done.select(step), step, "left_anti").join(open_needs.select(step).distinct(), step, "left_anti")


def resolve_names(names: DataFrame, catalog: DataFrame, key: Column) -> DataFrame:
    """Candidates of each normalised name, how many there are and whether the
    name is ambiguous; repeated paths count once."""
    found = names.withColumn("_key", key).join(catalog.dropDuplicates(["_key", "path"]), "_key", "left")
    n = F.count("path").over(Window.partitionBy("_key"))
    return found.withColumn("candidates", n).withColumn("ambiguous", n > 1).drop("_key")
