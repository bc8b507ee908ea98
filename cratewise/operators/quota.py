"""Request and token budgets per minute: auditing a request table, and planning batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewise.operators.sequence import running_totals
from cratewise.session import materialize

# The minute, and the two budgets for it.
WINDOW_MICROS = 60_000_000
MAX_REQUESTS = 600
MAX_TOKENS = 300_000
SLICE_MICROS = 10 * WINDOW_MICROS


def rolling_usage(
    requests: DataFrame,
    user: str,
    ts: str,
    tokens: Column,
    max_requests: int = MAX_REQUESTS,
    max_tokens: int = MAX_TOKENS,
    slice_micros: int = SLICE_MICROS,
) -> DataFrame:
    """Per request: how many requests and tokens its user had in the minute up to it, and whether
    that is over budget. An entry exactly one minute old has expired.

    A user's requests are cut into time slices, each with the last minute before it as context, so
    a user with a large part of all requests is spread over many window partitions.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    own = F.floor(at / slice_micros)
    timed = requests.withColumns({"_at": at, "_tokens": tokens, "_own": own})
    next_needs_it = F.col("_at") >= (F.col("_own") + 1) * slice_micros - (WINDOW_MICROS - 1)
    slices = F.when(next_needs_it, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))
    spread = timed.withColumn("_slice", F.explode(slices))
    minute = Window.partitionBy(user, "_slice").orderBy("_at").rangeBetween(-(WINDOW_MICROS - 1), 0)
    used = spread.withColumns(
        {"requests_in_minute": F.count(F.lit(1)).over(minute), "tokens_in_minute": F.sum("_tokens").over(minute)}
    )
    over = (F.col("requests_in_minute") > max_requests) | (F.col("tokens_in_minute") > max_tokens)
    return (
        used.where(F.col("_slice") == F.col("_own"))
        .drop("_at", "_tokens", "_own", "_slice")
        .withColumn("over_budget", over)
    )


def banded_usage(
    requests: DataFrame,
    user: str,
    ts: str,
    tokens: Column,
    max_requests: int = MAX_REQUESTS,
    max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """What ``rolling_usage`` says, without a partition by user or by time slice.

    Requests are summed by user and instant; beside every instant stands the one a minute before it, as a question. One range
    partitioning by user and time gives both their running totals, carried from range to range, and a minute's use is
    the difference of two of them. So a user with all requests, or a single minute with all of them, spreads over all tasks.

    Missing tokens count as none; requests without a time are left out, as they lie in no minute.
    """
    timed = requests.withColumns({"_at": F.unix_micros(F.col(ts).cast("timestamp")), "_tokens": F.coalesce(tokens, F.lit(0))})
    timed = materialize(timed.where(F.col("_at").isNotNull()), "timed").df
    summed = timed.groupBy(user, "_at").agg(F.count(F.lit(1)).alias("_more"), F.sum("_tokens").alias("_used"))
    instants = materialize(summed, "instants").df
    asks = instants.select(user, (F.col("_at") - WINDOW_MICROS).alias("_at"), (F.col("_more") * 0).alias("_more"), (F.col("_used") * 0).alias("_used"))
    # at one time requests come before questions: what is exactly a minute old has expired
    line = instants.withColumn("_asks", F.lit(0)).unionByName(asks.withColumn("_asks", F.lit(1)))
    totals = running_totals(line, [user, "_at", "_asks"], {"_requests": F.col("_more"), "_sum": F.col("_used")})
    sign = 1 - 2 * F.col("_asks")
    minutes = totals.groupBy(user, (F.col("_at") + F.col("_asks") * WINDOW_MICROS).alias("_at")).agg(
        F.sum(sign * F.col("_requests")).alias("requests_in_minute"), F.sum(sign * F.col("_sum")).alias("tokens_in_minute")
    )
    asked = minutes.withColumnsRenamed({user: "_user", "_at": "_when"})
    over = (F.col("requests_in_minute") > max_requests) | (F.col("tokens_in_minute") > max_tokens)
    return (
        timed.join(asked, (F.col("_at") == F.col("_when")) & F.col(user).eqNullSafe(F.col("_user")))
        .drop("_at", "_tokens", "_user", "_when")
        .withColumn("over_budget", over)
    )


def batch_slots(
    texts: DataFrame,
    order: list[str],
    tokens: Column,
    max_requests: int = MAX_REQUESTS,
    max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """Minute slots for texts in a given order: ``slot`` grows with the shares of both budgets used so far.

    The shares of one slot add up to less than one, so a slot stays within both budgets up
    to the share of its first text.
    """
    totals = running_totals(texts, order, {"cum_requests": F.lit(1).cast("bigint"), "cum_tokens": tokens})
    # In whole numbers, so the slot does not depend on rounding.
    share = F.col("cum_requests") * max_tokens + F.col("cum_tokens") * max_requests
    whole = F.lit(max_requests * max_tokens)
    return totals.withColumn("slot", ((share - F.pmod(share, whole)) / whole).cast("bigint"))


def exact_slots(
    texts: DataFrame,
    order: list[str],
    tokens: Column,
    max_requests: int = MAX_REQUESTS,
    max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """Minute slots as one reader would fill them: a slot takes texts in order until the next one would exceed a budget.

    A text above the token budget has a slot of its own. Where the slot that begins at a text ends is known from running totals
    alone. Each range of texts then is a function from the first beginning in it to the first behind it, which is needed for its
    first ``max_requests`` texts only, as no slot is longer; functions are joined by doubling, so the ranges that a cluster
    reads in parallel break where the sequential rule does.
    """
    counted = materialize(texts.withColumn("_tokens", F.coalesce(tokens, F.lit(0)).cast("bigint")), "counted").df
    placed = running_totals(counted, order, {"nth": F.lit(1).cast("bigint"), "used": F.col("_tokens")})
    rows = materialize(placed.withColumn("at", F.col("nth") - 1), "placed").df
    # the first text that does not fit with the one at ``at``: a count of running totals, both sides in one order
    own = rows.select(F.col("used").alias("value"), F.lit(0).alias("asks"), "at")
    asks = rows.select((F.col("used") - F.col("_tokens") + max_tokens).alias("value"), F.lit(1).alias("asks"), "at")
    merged = running_totals(own.unionByName(asks), ["value", "asks", "at"], {"fits": 1 - F.col("asks")}).where("asks = 1")
    ends = F.greatest(F.least(F.col("fits"), F.col("at") + max_requests), F.col("at") + 1).cast("bigint")
    jumps = merged.select("at", ends.alias("next")).repartitionByRange("at").withColumn("part", F.spark_partition_id())
    jumps = materialize(jumps, "jumps").df
    bounds = [(r["low"], r["high"]) for r in jumps.groupBy("part").agg(F.min("at").alias("low"), F.max("at").alias("high")).orderBy("low").collect()]
    spark = texts.sparkSession
    ranges = spark.createDataFrame([(i, low, high + 1) for i, (low, high) in enumerate(bounds)], "range int, low bigint, stop bigint")
    inside = materialize(jumps.join(F.broadcast(ranges), F.col("at").between(F.col("low"), F.col("stop") - 1)).select("range", "low", "stop", "at", "next"), "ranges").df

    def leave(table: pa.Table) -> pa.Table:
        """From each of the first texts of a range: the first slot behind it, and the slots begun in it."""
        by = table.sort_by("at")
        low, stop, jump = by["low"][0].as_py(), by["stop"][0].as_py(), by["next"].to_numpy()
        to, slots = jump.copy(), np.ones(len(jump), np.int64)
        for i in range(len(jump) - 1, -1, -1):
            if jump[i] < stop:
                to[i], slots[i] = to[jump[i] - low], slots[jump[i] - low] + 1
        n = min(len(jump), max_requests + 1)
        return pa.table({"range": by["range"].slice(0, n), "entry": by["at"].slice(0, n), "to": to[:n], "slots": slots[:n]})

    shape = "range int, entry bigint, to bigint, slots bigint"
    steps = [materialize(inside.groupBy("range").applyInArrow(leave, shape), "steps").df]
    while 2 ** len(steps) < len(bounds):  # over twice as many ranges each time; a slot may pass a short range by
        far = steps[-1].select((F.col("range") - 2 ** (len(steps) - 1)).alias("range"), F.col("entry").alias("to"), F.col("to").alias("then"), F.col("slots").alias("more"))
        both = steps[-1].join(far, ["range", "to"], "left")
        steps.append(materialize(both.select("range", "entry", F.coalesce("then", "to").alias("to"), (F.col("slots") + F.coalesce("more", F.lit(0))).alias("slots")), "steps").df)
    entries = spark.createDataFrame([(0, 0, 0)] if bounds else [], "range int, entry bigint, before bigint")
    for k in reversed(range(len(steps))):
        ahead = entries.join(steps[k], ["range", "entry"], "left").select(
            (F.col("range") + 2**k).cast("int").alias("range"), F.coalesce("to", "entry").alias("entry"), (F.col("before") + F.coalesce("slots", F.lit(0))).alias("before")
        )
        entries = materialize(entries.unionByName(ahead.where(F.col("range") < len(bounds))), "entries").df
    entered = inside.join(F.broadcast(entries), "range")  # a row per range

    def number(table: pa.Table) -> pa.Table:
        """The slot of every text of a range, given the first beginning in it and the slots before."""
        by = table.sort_by("at")
        low, at, jump = by["low"][0].as_py(), by["at"].to_numpy(), by["next"].to_numpy()
        begins, place = [], by["entry"][0].as_py()
        while place - low < len(jump):
            begins.append(place)
            place = int(jump[place - low])
        slot = by["before"][0].as_py() + np.searchsorted(np.array(begins, np.int64), at, side="right") - 1
        return pa.table({"at": at, "slot": slot.astype(np.int64)})

    slots = entered.groupBy("range").applyInArrow(number, "at bigint, slot bigint")
    return rows.join(slots, "at").select(*texts.columns, "slot")
