"""What every change job returns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hortus.functions import codes
from hortus.functions.checks import one_per_time, with_outcome
from hortus.operators.totals import after
from hortus.session import written

Tables = Mapping[str, DataFrame]


@dataclass
class JobResult:
    """``tables``: the changed tables only (the rest are unchanged).

    ``outcomes``: one row per request with ``esito`` (accepted / noop /
    rejected), ``code`` and ``reason``; ``rejects`` is its rejected part.
    ``extra``: further outputs of a job (new keys, running stock).
    ``changes``: for the kept totals (``operators.totals``), signed sums of what the
    job added and took away.
    ``years``: for tables kept by year, the years (``anno``) in which rows differ
    now; a changed table without an entry may differ in all.
    """

    tables: dict[str, DataFrame]
    outcomes: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)
    years: dict[str, DataFrame] = field(default_factory=dict)
    changes: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def rejects(self) -> DataFrame:
        return self.outcomes.filter(F.col("esito") == codes.REJECTED)

    @property
    def accepted(self) -> DataFrame:
        return self.outcomes.filter(F.col("esito") == codes.ACCEPTED)

    def changed(self, tables: Tables) -> dict[str, DataFrame]:
        """The changed tables and, where ``tables`` has kept totals, the changed totals."""
        return {**self.tables, **after(tables, self.changes)}

    def merged(self, tables: Tables) -> dict[str, DataFrame]:
        """The full set of tables after the job."""
        return {**tables, **self.changed(tables)}


def years_of(df: DataFrame, date: str) -> DataFrame:
    return df.select(F.year(date).alias("anno")).distinct()


def years_of_orders(orders: DataFrame, touched: DataFrame) -> DataFrame:
    """Years of the orders named in column ``ordine`` of ``touched``."""
    return years_of(orders.join(touched.select(F.col("ordine").alias("id")).distinct(), "id", "left_semi"), "data")


def unsequenced(requests: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The requests that have a place of their own in the batch's order, and the refused others (None without any).

    (ts, seq) is the order of a batch.  A request without it is ``INVALID``; of
    requests that share it all but one are ``DUPLICATE`` (``one_per_time``)."""
    untimed = F.col("ts").isNull() | F.col("seq").isNull()
    # Written, so that the joins with the times are planned by their size.
    times = written(requests.groupBy("ts", "seq").agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) | untimed)
                    .select("ts", "seq"))
    if times.isEmpty():
        return requests, None
    # Telling them apart reads the batch several times, so it is computed once.
    marked = one_per_time(written(requests), "_repeated", times.filter(~untimed))
    code = F.when(untimed, F.lit(codes.INVALID)).when(F.col("_repeated"), F.lit(codes.DUPLICATE))
    return (marked.filter(~untimed & ~F.col("_repeated")).drop("_repeated"),
            with_outcome(marked.filter(untimed | F.col("_repeated")), code).drop("_repeated"))


def with_refused(result: JobResult, refused: DataFrame | None) -> JobResult:
    """``result`` with the outcomes of the requests that ``unsequenced`` refused."""
    if refused is not None:
        shown = [c for c in result.outcomes.columns if c in refused.columns]
        result.outcomes = result.outcomes.unionByName(refused.select(*shown), allowMissingColumns=True)
    return result


def in_sequence(job: Callable[..., JobResult]) -> Callable[..., JobResult]:
    """A job whose requests without a place of their own in the order are refused first of all."""
    @wraps(job)
    def run(tables: Tables, requests: DataFrame, *args, **kwargs) -> JobResult:
        fit, refused = unsequenced(requests)
        return with_refused(job(tables, fit, *args, **kwargs), refused)
    return run
