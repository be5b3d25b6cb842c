"""Windows over a stream that keep late rows: counts of what came in time, and a table of what did not.

Spark's own windowed aggregates drop rows behind the watermark.  Here each batch is parted first:
the watermark is the largest event time of the batches before, less the allowed delay; a row
is late if its window had ended by then.  Rows in time are counted per window and batch, partially, late rows go to a
table of their own with the watermark that they missed.  Both are written through the ledger, so a
batch counts once; a window's count is the sum of its partial counts, and it is closed when the
watermark has passed its end.

:func:`meeting` joins two streams the same way: what may still be met lies in tables of the ledger
and not in the memory of executors, as the state of Spark's own stream-stream join does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.streaming.ledger import Ledger

REACHED = "batch bigint, left_us bigint, right_us bigint"
PARTIAL = "start timestamp_ntz, end timestamp_ntz, n bigint, total double"
SEEN = "batch bigint, largest timestamp_ntz"


def parted(ledger: Ledger, at: str, size: str, delay: str, value: Column, keep: list[str]) -> Callable[[DataFrame, int], dict[str, DataFrame]]:
    """A step for the ledger: tables ``partial``, ``late`` (columns ``keep`` and the watermark) and ``seen``."""

    def step(batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        before = ledger.table("seen", SEEN).filter(F.col("batch") < batch_id).agg(F.max("largest").alias("m")).select((F.col("m") - F.expr(f"interval {delay}")).alias("w")).first()["w"]
        mark = F.lit(before).cast("timestamp_ntz")
        windowed = batch.withColumns({"_w": F.window(at, size), "_mark": mark}).filter(F.col(at).isNotNull())
        late = F.coalesce(F.col("_w.end") <= F.col("_mark"), F.lit(False))
        partial = windowed.filter(~late).groupBy("_w").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        return {
            "partial": partial.select("_w.start", "_w.end", "n", "total"),
            "late": windowed.filter(late).select(*keep, F.col("_mark").alias("watermark")),
            "seen": batch.agg(F.lit(batch_id).cast("bigint").alias("batch"), F.max(at).alias("largest")),
        }

    return step


def counts(ledger: Ledger, delay: str) -> DataFrame:
    """(start, end, n, total, closed) of every window so far."""
    mark = F.broadcast(ledger.table("seen", SEEN).agg((F.max("largest") - F.expr(f"interval {delay}")).alias("mark")))  # one row
    sums = ledger.table("partial", PARTIAL).groupBy("start", "end").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return sums.crossJoin(mark).select("start", "end", "n", "total", (F.col("end") <= F.col("mark")).alias("closed"))


def joined(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, within: str, delay: str) -> DataFrame:
    """Rows of two streams with one key, the right one's at most so long after the left one's.

    Both sides have a watermark and the condition bounds how far apart they lie, so state goes when neither
    side can meet it any more.  Columns of the right side come as ``r_`` and their name.

    Rows meet by key and by slice of time as long as the bound: the left one's slices are those that its span
    touches, so a row is held against a key's rows of those slices and not against all that state has of the key.
    """
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    size = F.expr(f"greatest(1L, unix_seconds(timestamp_seconds(0) + interval {within}))")
    slice_of = lambda at: F.floor(F.unix_seconds(at) / size)
    a = left.withWatermark(left_at, delay).withColumn("_slice", F.explode(F.sequence(slice_of(F.col(left_at)), slice_of(F.col(left_at) + F.expr(f"interval {within}")))))
    b = right.withWatermark(f"r_{right_at}", delay).withColumn("_r_slice", slice_of(F.col(f"r_{right_at}")))
    span = (F.col(f"r_{right_at}") >= F.col(left_at)) & (F.col(f"r_{right_at}") <= F.col(left_at) + F.expr(f"interval {within}"))
    return a.join(b, (F.col(key) == F.col(f"r_{key}")) & (F.col("_slice") == F.col("_r_slice")) & span).drop("_slice", "_r_slice")


def both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two streams as one, with a column for either side's rows: what :func:`meeting` takes."""
    l, r = F.struct(*left.columns).alias("l"), F.struct(*right.columns).alias("r")
    none = lambda df: F.lit(None).cast(df.schema)
    return left.select(l, none(right).alias("r")).unionByName(right.select(none(left).alias("l"), r))


def meeting(ledger: Ledger, key: str, at: str, within: str, delay: str) -> Callable[[DataFrame, int], dict[str, DataFrame]]:
    """A step for the ledger over :func:`both`: table ``met``, rows of one key whose right side is at most so long after the left one.

    The columns of ``met`` are the left side's and the right side's as ``r_`` and their name.  The watermark is
    the lesser of what both sides had reached in earlier batches, less the delay; rows behind it are dropped.
    A batch is joined with itself and with the tables ``left`` and ``right`` of the batch before, which hold what the
    watermark lets be met yet, so memory is that of a batch join, whatever the number of rows held.  Rows
    meet by key and by slice of time as long as the bound.
    """
    micros = lambda span: F.expr(f"unix_micros(timestamp_seconds(0) + interval {span})")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))

    def reached(rows: DataFrame) -> int | None:
        m = rows.agg((F.when(F.count("left_us") * F.count("right_us") > 0, F.least(F.max("left_us"), F.max("right_us"))) - micros(delay)).alias("m"))
        return m.first()["m"]

    def step(batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        earlier = ledger.table("reached", REACHED).filter(F.col("batch") < batch_id)
        largest = batch.agg(F.max(us(f"l.{at}")), F.max(us(f"r.{at}"))).first()
        now = ledger.spark.range(1).select(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(("batch", "left_us", "right_us"), (batch_id, *largest), strict=True)])
        before, after = reached(earlier), reached(earlier.unionByName(now))

        def side(name: str, column: str, longest: Column) -> tuple[DataFrame, DataFrame]:
            schema = batch.schema[column].dataType
            new = batch.filter(F.col(column).isNotNull()).select(f"{column}.*").filter(F.col(at).isNotNull() & F.col(key).isNotNull())
            new = new if before is None else new.filter(us(at) >= before)
            rows = new.withColumn("_new", F.lit(True)).unionByName(ledger.last(name, schema, batch_id).withColumn("_new", F.lit(False)))
            held = rows.drop("_new")
            return rows, held if after is None else held.filter(us(at) + longest >= after)

        (left, held), (right, r_held) = side("left", "l", micros(within)), side("right", "r", F.lit(0))
        right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
        size = F.greatest(F.lit(1), micros(within))
        slice_of = lambda t: F.floor(t / size)
        a = left.withColumn("_slice", F.explode(F.sequence(slice_of(us(at)), slice_of(us(at) + micros(within)))))
        b = right.withColumn("_r_slice", slice_of(us(f"r_{at}")))
        span = (us(f"r_{at}") >= us(at)) & (us(f"r_{at}") <= us(at) + micros(within)) & (F.col("_new") | F.col("r__new"))
        met = a.join(b, (F.col(key) == F.col(f"r_{key}")) & (F.col("_slice") == F.col("_r_slice")) & span).drop("_slice", "_r_slice", "_new", "r__new")
        return {"met": met, "left": held, "right": r_held, "reached": now}

    return step
