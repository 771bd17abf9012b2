"""Model responses: replayed from a table, or asked for while the job runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# one request as a dict (stage, system, prompt, model, max_tokens, temperature) to the
# response text; raising or returning None means there is none
Completion = Callable[[dict], "str | None"]

REQUEST_COLUMNS = ("stage", "system", "prompt", "model", "max_tokens", "temperature")


def response_column(stage: str, rank: int | None = None) -> str:
    """The last response of a stage, or that of the ``rank``-th attempt (from 1)."""
    return f"resp_{stage}" if rank is None else f"resp_{stage}_{rank}"


def duration_column(stage: str) -> str:
    return f"ms_{stage}"


def error_column(stage: str) -> str:
    return f"err_{stage}"


def first_attempts(counted: Column, n: int, name: str) -> list[Column]:
    """Aggregates that hold the ``n`` attempts from the least on, wherever their numbers start.

    Numbers that follow one another differ modulo ``n``, so the least number of each class is
    among the first ``n``, if one of its class is: buffers of a fixed size do, however many
    attempts there are."""
    out = []
    for part in range(n):
        attempt = F.when(counted & (F.pmod("attempt", F.lit(n)) == part), F.col("attempt"))
        out += [F.min(attempt).alias(f"_at_{name}_{part}"), F.min_by("response", attempt).alias(f"_by_{name}_{part}")]
    return out


def ranked_attempts(n: int, name: str) -> list[Column]:
    """The responses of the 1st, 2nd, ... ``n``-th attempt from ``first_attempts``; null where an
    attempt is missing or had no answer."""
    numbers = [F.col(f"_at_{name}_{part}") for part in range(n)]
    least = F.least(*numbers) if n > 1 else numbers[0]
    return [
        F.coalesce(*[F.when(numbers[part] == least + rank, F.col(f"_by_{name}_{part}")) for part in range(n)])
        for rank in range(n)
    ]


def attach_responses(
    notes: DataFrame,
    responses: DataFrame,
    stages: tuple[str, ...],
    ranked: dict[str, int] | None = None,
    key: str = "note_id",
) -> DataFrame:
    """Add ``resp_<stage>``, the last attempt's answer, for every stage from ``(note_id, stage,
    attempt, response)``; for the stages in ``ranked`` instead ``resp_<stage>_1`` to ``_n``, the
    first ``n`` attempts, counted from the note's least one. From a log with ``duration_ms``
    or ``error`` also ``ms_<stage>``, the time of all attempts, and ``err_<stage>``, the last
    attempt's error.

    All stages come from one aggregate, so each table is shuffled once and on the same
    key, whatever the number of stages; the aggregate's output is already placed and
    sorted for the join. Attempts combine map-side, so one note with very many attempts
    makes no large task. Notes without a response stay."""
    ranked = ranked or {}
    made, shown = [], []
    for stage in stages:
        here = F.col("stage") == stage
        attempt = F.when(here, F.col("attempt"))
        if stage in ranked:
            made += first_attempts(here, ranked[stage], stage)
            texts = ranked_attempts(ranked[stage], stage)
            shown += [text.alias(response_column(stage, i)) for i, text in enumerate(texts, 1)]
        else:
            made.append(F.max_by("response", attempt).alias(response_column(stage)))
            shown.append(response_column(stage))
        if "duration_ms" in responses.columns:
            made.append(F.sum(F.when(here, F.col("duration_ms"))).alias(duration_column(stage)))
            shown.append(duration_column(stage))
        if "error" in responses.columns:
            made.append(F.max_by("error", attempt).alias(error_column(stage)))
            shown.append(error_column(stage))
    wide = responses.filter(F.col("stage").isin(*stages)).groupBy(key).agg(*made)
    return notes.join(wide.select(key, *shown), key, "left")


def complete(
    requests: DataFrame,
    completion: Completion,
    out: str,
    in_flight: int = 8,
    error: str | None = None,
    duration: str | None = None,
) -> DataFrame:
    """Ask ``completion`` for every row of ``requests`` and add the answer as ``out``; under
    ``error``, if named, the exception that left a row without one, and under ``duration`` the
    milliseconds that it took, measured where it was asked.

    A narrow step: rows stay where they are, each task keeps several requests in flight.
    Answers cannot be had twice, so write the result with ``materialize`` before it is
    used more than once."""
    named = [(out, T.StringType()), (error, T.StringType()), (duration, T.LongType())]
    schema = T.StructType(
        [f for f in requests.schema.fields if f.name not in REQUEST_COLUMNS[1:]]
        + [T.StructField(name, kind) for name, kind in named if name]
    )
    names, columns = schema.names, list(REQUEST_COLUMNS)

    def ask_batches(batches):
        import time
        from concurrent.futures import ThreadPoolExecutor

        def ask(request):
            start = time.perf_counter()
            try:
                told = completion(request), None
            except Exception as e:  # a request that fails has no response; fallbacks take over
                told = None, f"{type(e).__name__}: {e}"
            return *told, round(1000 * (time.perf_counter() - start))

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                told = list(pool.map(ask, batch[columns].to_dict("records")))
                for i, (name, _) in enumerate(named):
                    if name:
                        batch[name] = [answer[i] for answer in told]
                yield batch[names]

    return requests.mapInPandas(ask_batches, schema)
