"""Options that change while runs go on.

Updates are an append-only table: run, seq, option, value (text), from_iteration. Runs go in chunks of iterations, and
an update is looked at when the first chunk begins that starts at its iteration or later: it is taken if the option may be set during
a run and the value is of its type, else refused with the reason; of several of one option that meet at a chunk, the
last by iteration and seq holds, and the others are overtaken. Each has one row of audit, with the chunk where it met
the run. All of it is joins and windows by run; the catalogue of options (some seventy rows) is the one side that is sent to all.

Cases: an update beyond the last chunk waits (no chunk, not taken); a null value is refused; a null from_iteration counts as 0;
rows without run or option are refused as unknown; equal rows are each looked at, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .options import catalogue

AUDIT = ["run", "seq", "option", "value", "from_iteration", "at", "taken", "reason"]
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_LIST = rf"\s*\[\s*{_NUMBER}(?:\s*,\s*{_NUMBER})*\s*\]\s*"


def _fits(kind: Column, choices: Column, value: Column) -> Column:
    """Whether a text is a value of an option's type; options of numbers may name special values, written with `!` in their choices."""
    number, text = value.rlike(rf"^\s*{_NUMBER}\s*$"), F.trim(value)
    special = F.array_contains(choices, F.concat(text, F.lit("!")))
    whole = number & (value.try_cast("double") == F.floor(value.try_cast("double")))
    by = {"choice": F.array_contains(choices, text), "int": whole | special, "real": number | special, "bool": F.lower(text).isin("true", "false", "0", "1"), "map": number | value.rlike(rf"^\s*\({_LIST},{_LIST}\)\s*$")}
    fits = F.when(F.lit(False), F.lit(False))
    for k, c in by.items():
        fits = fits.when(kind == k, c)
    return F.coalesce(fits.otherwise(value.isNotNull()), F.lit(False))


def audited(updates: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each of updates(run, seq, option, value, from_iteration), given chunks(run, start): at (the chunk's first iteration), taken, reason."""
    asked = updates.select("run", "seq", "option", "value", F.coalesce("from_iteration", F.lit(0)).cast("long").alias("from_iteration"))
    both = asked.withColumns({"place": F.col("from_iteration"), "start": F.lit(None).cast("long")}).unionByName(chunks.select("run", F.col("start").cast("long").alias("place"), F.col("start").cast("long").alias("start")), allowMissingColumns=True)
    coming = Window.partitionBy("run").orderBy("place", F.col("start").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    met = both.withColumn("at", F.first("start", ignorenulls=True).over(coming)).where("start IS NULL").drop("place", "start")
    known = catalogue(updates.sparkSession).where("NOT deprecated").select(F.col("path").alias("option"), "type", "choices", "during_run")
    met = met.join(F.broadcast(known), "option", "left")
    named = F.concat_ws(", ", F.transform("choices", lambda c: F.rtrim(c, F.lit("!"))))
    wrong = (
        F.when(F.col("type").isNull() | F.col("run").isNull(), F.lit("no such option")).when(~F.col("during_run"), F.lit("can't be set during a run"))
        .when(~_fits(F.col("type"), F.col("choices"), F.col("value")), F.when(F.col("type") == "choice", F.concat(F.lit("is one of "), named)).otherwise(F.concat(F.lit("is of type "), "type")))
    )
    met = met.withColumn("wrong", wrong)
    same = Window.partitionBy("run", "option", "at", F.col("wrong").isNull()).orderBy(F.desc("from_iteration"), F.desc("seq"))
    met = met.withColumn("last", F.row_number().over(same) == 1)
    reason = F.coalesce("wrong", F.when(F.col("at").isNull(), F.lit("no chunk yet")).when(~F.col("last"), F.lit("overtaken")), F.lit(""))
    return met.withColumn("reason", reason).withColumn("taken", F.col("reason") == "").select(*AUDIT)


def in_force(audit: DataFrame, chunks: DataFrame) -> DataFrame:
    """run, start, option, value: for each chunk the options that updates have set by then (as of its start)."""
    taken = audit.where("taken").select("run", "option", "value", "at")
    options = taken.select("run", "option").distinct()
    grid = chunks.select("run", F.col("start").cast("long").alias("start")).join(options, "run")  # the options that a run changes, once a chunk
    both = taken.select("run", "option", F.col("at").alias("place"), "value", F.lit(None).cast("long").alias("start")).unionByName(grid.select("run", "option", F.col("start").alias("place"), F.lit(None).cast("string").alias("value"), "start"))
    before = Window.partitionBy("run", "option").orderBy("place", F.col("start").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("value", F.last("value", ignorenulls=True).over(before))
    return found.where("start IS NOT NULL AND value IS NOT NULL").select("run", "start", "option", "value")
