"""Posting orders, and what a log of posting attempts amounts to."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import PostParams

# Statuses worth another try, and hosts that are never posted to.
RETRYABLE = (408, 429, 500, 502, 503, 504)
TEST_HOSTS = ("test-api.com", "alert-api.com")

REPORT_TYPE = (
    "note_id string, idempotency_key string, outcome string, attempts int, "
    "last_status int, backoff_s double, error string"
)
REPORT_COLUMNS = tuple(column.split()[0] for column in REPORT_TYPE.split(", "))
IN_FLIGHT = 8
ROWS_AT_ONCE = 1024

# (payload, idempotency key, attempt from 0) to an HTTP status, or None if no answer came
Transport = Callable[[str, str, int], "int | None"]


def is_retryable(status: Column) -> Column:
    """A missing status, no answer or a timeout, counts as retryable."""
    return status.isNull() | status.isin(*RETRYABLE)


def is_delivered(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def posting_skipped(base_url: Column, enabled: Column) -> Column:
    """True where posting is off or the address is a test host."""
    skipped = ~enabled
    for host in TEST_HOSTS:
        skipped = skipped | base_url.contains(host)
    return skipped


def planned_delays(retries: Column) -> Column:
    """Seconds to wait after each failed attempt but the last: 1, 2, 4, ..."""
    return F.when(
        retries > 0,
        F.transform(F.sequence(F.lit(0), retries - 1), lambda n: F.pow(F.lit(2.0), n)),
    ).otherwise(F.array().cast("array<double>"))


def reduce_attempts(
    attempts: DataFrame, key: str = "order_id", params: PostParams = PostParams()
) -> DataFrame:
    """A log of ``(order_id, attempt from 0, status)`` to one outcome per order.

    The first attempt that is not retryable decides: ``delivered`` or
    ``permanent_failure``. Without one it is ``exhausted`` once all tries are used, and
    ``pending`` before. The whole log counts, also attempts beyond ``retries``. One aggregate with fixed-size buffers: it combines map-side, so
    neither a hot order nor a long log moves more than a row per task and order."""
    final = ~is_retryable(F.col("status"))
    reduced = attempts.groupBy(key).agg(
        F.min(F.when(final, F.col("attempt"))).alias("_final"),
        F.max("attempt").alias("_last"),
        F.min_by("status", F.when(final, F.col("attempt"))).alias("_status"),
        F.max_by("status", "attempt").alias("_last_status"),
    )
    used = F.coalesce(F.col("_final"), F.col("_last"))
    status = F.when(F.col("_final").isNull(), F.col("_last_status")).otherwise(F.col("_status"))
    return reduced.select(
        key,
        F.when(F.col("_final").isNull() & (F.col("_last") < params.retries), "pending")
        .when(F.col("_final").isNull(), "exhausted")
        .when(is_delivered(F.col("_status")), "delivered")
        .otherwise("permanent_failure")
        .alias("outcome"),
        (used + 1).cast("int").alias("attempts"),
        status.cast("int").alias("last_status"),
        (F.pow(F.lit(2.0), used) - 1).alias("backoff_s"),
    )


def undelivered(orders: DataFrame, report: DataFrame) -> DataFrame:
    """Orders whose key the report does not show as settled: a re-run posts only these. A
    failure that came from an error in the transport, not from an answer, settles nothing."""
    settled = report.filter(F.col("outcome").isin("delivered", "permanent_failure"))
    if "error" in report.columns:
        settled = settled.filter(F.col("error").isNull())
    return orders.join(settled.select("idempotency_key"), "idempotency_key", "left_anti")


def post_rows(
    rows: Iterable[tuple[str, str, str]],
    transport: Transport,
    params: PostParams = PostParams(),
    wait: Callable[[float], None] | None = None,
    in_flight: int = IN_FLIGHT,
) -> Iterator[tuple]:
    """Post ``(note_id, idempotency_key, payload)`` rows, several at a time, and give a report row for
    each, in order; a part of the rows is held at once. Runs in a task."""
    import time
    from concurrent.futures import ThreadPoolExecutor
    from itertools import islice

    rows, pause, retries = iter(rows), wait or time.sleep, params.retries
    if not params.enabled or any(host in params.base_url for host in TEST_HOSTS):
        yield from ((note_id, key, "skipped", 0, None, 0.0, None) for note_id, key, _ in rows)
        return

    def post(row):
        note_id, key, payload = row
        waited, error = 0.0, None
        for attempt in range(retries + 1):
            try:
                status, error = transport(payload, key, attempt), None
            except OSError as failure:  # timeouts and lost connections: no answer
                status, error = None, repr(failure)
            except Exception as failure:  # an error of the transport: retrying cannot help
                return note_id, key, "permanent_failure", attempt + 1, None, waited, repr(failure)
            if status is not None and status not in RETRYABLE:
                outcome = "delivered" if 200 <= status < 300 else "permanent_failure"
                return note_id, key, outcome, attempt + 1, status, waited, None
            if attempt < retries:
                pause(2.0**attempt)
                waited += 2.0**attempt
        return note_id, key, "exhausted", retries + 1, status, waited, error

    with ThreadPoolExecutor(in_flight) as pool:
        while part := list(islice(rows, ROWS_AT_ONCE)):
            yield from pool.map(post, part)


def post_orders(
    orders: DataFrame,
    transport: Transport,
    params: PostParams = PostParams(),
    wait: Callable[[float], None] | None = None,
    in_flight: int = IN_FLIGHT,
) -> DataFrame:
    """Post ``(note_id, idempotency_key, payload)`` rows and return the delivery report.

    Runs where the rows are, with no shuffle: each task posts its own batches, several
    orders at a time, retrying after 1, 2, 4, ... seconds. A failure becomes a report row
    and never fails the job. The key goes with every post because Spark may run a task
    again; write the report once with ``materialize`` and read it from there, or post
    through the sink of ``sinks.orders_api``, which keeps a report of its own."""

    def post_batches(batches):
        import pandas as pd

        for batch in batches:
            rows = zip(batch["note_id"], batch["idempotency_key"], batch["payload"])
            report = pd.DataFrame(list(post_rows(rows, transport, params, wait, in_flight)), columns=list(REPORT_COLUMNS))
            report["last_status"] = report["last_status"].astype("Int32")
            yield report

    return orders.select("note_id", "idempotency_key", "payload").mapInPandas(post_batches, REPORT_TYPE)


def http_transport(params: PostParams = PostParams()) -> Transport:
    """A transport that POSTs JSON with the standard library."""
    url = params.base_url.rstrip("/") + "/" + params.endpoint.lstrip("/")
    timeout = params.timeout_s

    def send(payload: str, key: str, attempt: int):
        import http.client
        import urllib.error
        import urllib.request

        request = urllib.request.Request(
            url,
            data=payload.encode("utf-8"),
            headers={"Content-Type": "application/json", "Idempotency-Key": key},
            method="POST",
        )
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.status
        except urllib.error.HTTPError as error:
            return error.code
        except (OSError, http.client.HTTPException):
            return None

    return send
