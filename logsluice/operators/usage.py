"""Call budgets and usage accounting. Money is whole nano-dollars so that sums are exact."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .scale import ROWS_PER_BLOCK, running_rank, running_total, with_block

RESERVED_OUTPUT_TOKENS = 16384


@dataclass(frozen=True)
class Prices:
    """Price of one token in nano-dollars ($1 per million tokens is 1000)."""

    input_nano_usd: int
    output_nano_usd: int


def reservation(request_bytes: Column, prices: Prices) -> Column:
    """Cost set aside before a call: a token per request byte and the largest reply."""
    return (
        request_bytes * prices.input_nano_usd + RESERVED_OUTPUT_TOKENS * prices.output_nano_usd
    ).cast("bigint")


def admit_budget(calls: DataFrame, prices: Prices, max_cost_nano_usd: int, max_calls: int,
                 order: str = "seq") -> DataFrame:
    """Add ``reserved_nano_usd`` (cumulative) and ``admitted``.

    Reservations are never refunded and never negative, so the first refusal is where the
    running total crosses the budget and everything after it is refused too.
    """
    d = with_block(calls, order, ROWS_PER_BLOCK)
    d = running_total(d, [], [order], reservation(F.col("request_bytes"), prices), "reserved_nano_usd")
    d = running_rank(d, [], [order], "_attempt")
    return d.withColumn(
        "admitted",
        (F.col("reserved_nano_usd") <= max_cost_nano_usd) & (F.col("_attempt") <= max_calls),
    ).drop("_attempt", "_block")


def usage_rollup(calls: DataFrame, prices: Prices) -> DataFrame:
    """Usage per kind of call. A finished call without token counts makes the cost incomplete,
    and so does one that cost more than was reserved for it."""
    done = F.col("finished")
    metered = done & F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    cost = (
        F.col("input_tokens") * prices.input_nano_usd + F.col("output_tokens") * prices.output_nano_usd
    )
    over = metered & (cost > reservation(F.col("request_bytes"), prices))

    def total(value):
        return F.coalesce(F.sum(F.when(metered, value)), F.lit(0)).cast("bigint")

    return calls.groupBy("kind").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(done).alias("finished"),
        F.count_if(metered).alias("metered"),
        F.count_if(done & ~metered).alias("unmetered"),
        total(F.col("input_tokens")).alias("input_tokens"),
        total(F.col("output_tokens")).alias("output_tokens"),
        total(cost).alias("cost_nano_usd"),
        F.max(F.coalesce(over, F.lit(False))).alias("underestimated"),
        F.bool_and(~done | (metered & ~over)).alias("cost_complete"),
    )


def usage_totals(rollup: DataFrame) -> DataFrame:
    """Requests and cost over all kinds of call."""
    return rollup.agg(
        F.sum("attempts").alias("total_api_requests"),
        (F.sum("cost_nano_usd") / 1e9).alias("total_estimated_cost_usd"),
    )
