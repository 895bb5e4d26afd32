"""Steps that call a caller-supplied function: services, text models, locations."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chartloom.functions.geo import wkt_point
from chartloom.functions.names import named
from chartloom.operators.records import only

ServiceCall = Callable[[pd.DataFrame], pd.DataFrame]

# Whole numbers and flags stay what they are beside a null.
_NULLABLE = {
    pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(),
    pa.bool_(): pd.BooleanDtype(),
}


def enrich(
    df: DataFrame,
    make_client: Callable[[], ServiceCall],
    request_cols: Sequence[str],
    response_schema: str,
    batch_size: int = 100,
    retries: int = 2,
    in_flight: int = 1,
    per_second: float | None = None,
    backoff: float = 0.0,
    breaker: int | None = None,
    pause: float = 30.0,
    request_key: str | None = None,
) -> DataFrame:
    """Add the answer's columns and ``error`` (null when the call went well).

    ``make_client`` runs once per task and returns the call, which takes a frame
    of ``request_cols`` (whole numbers in pandas' nullable types) and returns one row
    per request in the same order.  A failing batch is retried, then sent record by
    record, so that one bad record fails alone; an answer that doesn't fit
    ``response_schema`` is a failure like any other.  Only ``request_cols`` travel to
    Python: all other columns stay where they are.

    A task keeps up to ``in_flight`` calls under way, in threads, and gives the answers in
    the order of the rows.  It begins at most ``per_second`` calls a second (the cluster as
    many times that as it runs tasks) and waits ``backoff`` seconds before the first retry,
    twice as long before each other.  After ``breaker`` failed calls in a row it calls no
    more for ``pause`` seconds: rows that come meanwhile fail with an error that says so.
    Then one call decides.  ``request_key`` names a column that the call gets besides: a hash
    of the request, the same whenever it is sent, by which a service can tell a repeat.

    The result is one frame on purpose: splitting it in two would send every
    record twice.  Write or checkpoint it, then take it apart with
    ``plans.transform.split_failed``.
    """
    answer = T.StructType.fromDDL(response_schema)
    clash = set(answer.names) & set(df.columns)
    if clash:
        raise ValueError(f"answer columns are in the input already: {sorted(clash)}")
    fields = [*answer.fields, T.StructField("error", T.StringType())]
    shape = to_arrow_type(T.StructType(fields))
    columns = list(request_cols)

    sent = [named(c).alias(f"r{i}") for i, c in enumerate(columns)]
    if request_key is not None:
        sent.append(F.sha2(F.to_json(F.struct(*sent), {"ignoreNullFields": "false"}), 256).alias("key"))
        columns.append(request_key)

    @F.arrow_udf(T.StructType(fields))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gate = _Gate(make_client(), per_second, breaker, pause)

        def answer(piece: pd.DataFrame) -> pa.Array:
            return _answered(gate, piece, shape, retries, backoff)

        with ThreadPoolExecutor(max_workers=in_flight) as pool:
            for requests in batches:
                rows = pa.RecordBatch.from_struct_array(requests).to_pandas(types_mapper=_NULLABLE.get)
                rows.columns = columns
                pieces: list[pa.Array] = []
                waiting: deque[Future[pa.Array]] = deque()
                for i in range(0, len(rows), batch_size):
                    if len(waiting) == in_flight:
                        pieces.append(waiting.popleft().result())
                    waiting.append(pool.submit(answer, rows.iloc[i : i + batch_size].reset_index(drop=True)))
                pieces += [call.result() for call in waiting]
                yield pa.concat_arrays(pieces) if pieces else pa.array([], shape)

    request = F.struct(*sent)
    # Marked so that a later filter doesn't send every record twice.
    called = df.select(*only(df, [c for c in df.columns if c != "error"]), run.asNondeterministic()(request).alias("_answer"))
    return called.select(*only(called, called.columns[:-1]), *[F.col("_answer")[f.name].alias(f.name) for f in fields])


class _Closed(Exception):
    """A call that was not made."""


class _Gate:
    """A service's call, with a limit on how often it is begun and a breaker; one for all threads of a task."""

    def __init__(self, call: ServiceCall, per_second: float | None, breaker: int | None, pause: float) -> None:
        self.call, self.gap, self.breaker, self.pause = call, 1 / per_second if per_second else 0.0, breaker, pause
        self.lock, self.next_at, self.failed, self.closed_until = threading.Lock(), 0.0, 0, 0.0

    def __call__(self, piece: pd.DataFrame) -> pd.DataFrame:
        with self.lock:
            now = time.monotonic()
            if self.breaker is not None and self.failed >= self.breaker:
                if now < self.closed_until:
                    raise _Closed(f"not called: {self.failed} calls in a row had failed")
                self.closed_until = now + self.pause  # this call is the one that decides
            self.next_at = max(now, self.next_at) + self.gap
            wait = self.next_at - self.gap - now
        if wait > 0:
            time.sleep(wait)
        try:
            answer = self.call(piece)
        except Exception:
            with self.lock:
                self.failed += 1
                if self.breaker is not None and self.failed == self.breaker:
                    self.closed_until = time.monotonic() + self.pause
            raise
        with self.lock:
            self.failed = 0
        return answer


def _answered(call: ServiceCall, piece: pd.DataFrame, shape: pa.StructType, retries: int, backoff: float = 0.0) -> pa.Array:
    failure, answers = "", list(shape)[:-1]
    for n in range(retries + 1):
        if n and backoff:
            time.sleep(backoff * 2 ** (n - 1))
        try:
            answer = call(piece)
            if len(answer) != len(piece):
                raise ValueError(f"{len(answer)} answers to {len(piece)} requests")
            got = [pa.Array.from_pandas(answer[f.name], type=f.type) for f in answers]
            got = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in got]
            return pa.StructArray.from_arrays([*got, pa.nulls(len(piece), pa.string())], fields=list(shape))
        except _Closed as exc:
            failure = str(exc)
            return pa.array([dict.fromkeys(f.name for f in answers) | {"error": failure}] * len(piece), shape)
        except Exception as exc:  # the service may raise anything; it becomes a failed row
            failure = f"{type(exc).__name__}: {exc}"
    if len(piece) == 1:
        return pa.array([dict.fromkeys(f.name for f in answers) | {"error": failure}], shape)
    return pa.concat_arrays([_answered(call, piece.iloc[i : i + 1].reset_index(drop=True), shape, 0) for i in range(len(piece))])


def apply_text_model(df: DataFrame, col: str, make_model: Callable[[], Callable[[pd.Series], pd.Series]], char_limit: int = 512) -> DataFrame:
    """Run a text model over a column; long text goes slice by slice.  Adds ``error``.

    Text over ``char_limit`` characters is cut into slices of that size (the last
    one shorter), the model runs on each and the answers are joined again.  Slicing
    and joining are native and stay on the row: no shuffle.  Null text stays null.
    A batch that the model fails on is sent text by text; a text it fails on then
    becomes null, and ``error`` says why.  A frame without the column is unchanged.
    """
    if col not in df.columns:
        return df
    text = named(col)
    n = F.greatest(F.ceil(F.length(text) / char_limit).cast("int"), F.lit(1))
    slices = F.transform(F.sequence(F.lit(0), n - 1), lambda i: text.substr(i * char_limit + 1, F.lit(char_limit)))
    schema = T.StructType([T.StructField("parts", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            try:
                parts, errors = _modelled(model, batch), pd.Series([None] * len(batch), dtype=object)
            except Exception:  # one of the texts; each is sent alone
                singles = [_modelled_alone(model, batch.iloc[i : i + 1].reset_index(drop=True)) for i in range(len(batch))]
                parts, errors = pd.Series([p for p, _ in singles], dtype=object), pd.Series([e for _, e in singles], dtype=object)
            yield pd.DataFrame({"parts": parts.reset_index(drop=True), "error": errors})

    # A later filter on the text must not make the model run twice.
    answers = run.asNondeterministic()(F.when(text.isNotNull(), slices))
    done = df.select(*only(df, [c for c in df.columns if c != "error"]), answers.alias("_answer"))
    joined = F.array_join(F.col("_answer")["parts"], "")
    return done.select(*[(joined if c == col else named(c)).alias(c) for c in done.columns[:-1]], F.col("_answer")["error"].alias("error"))


def _modelled(model: Callable[[pd.Series], pd.Series], batch: pd.Series) -> pd.Series:
    flat = batch.explode()
    present = flat.notna()
    done = flat.astype(object)
    if present.any():
        answers = list(model(flat[present].reset_index(drop=True)))
        if len(answers) != int(present.sum()):
            raise ValueError(f"{len(answers)} answers to {int(present.sum())} texts")
        done[present] = [None if a is None else str(a) for a in answers]
    joined = done.groupby(level=0, sort=True).agg(list)
    return joined.where(batch.notna(), None)


def _modelled_alone(model: Callable[[pd.Series], pd.Series], one: pd.Series) -> tuple[list[str] | None, str | None]:
    try:
        return _modelled(model, one).iloc[0], None
    except Exception as exc:  # a model may raise anything; it becomes a failed row
        return None, f"{type(exc).__name__}: {exc}"


def assign_location(df: DataFrame, id_col: str, boxes: Sequence[tuple[str, float, float, float, float]], seed: int = 0) -> DataFrame:
    """Add a made-up place per subject: ``area`` and ``gen_location`` (WKT point).

    ``boxes`` are ``(name, lat_min, lat_max, lon_min, lon_max)``.  Area and position
    are fractions of a hash of the id and the seed: the same on every run and retry.
    """
    if not boxes:
        raise ValueError("no boxes given")

    def fraction(salt: str) -> Column:
        digest = F.md5(F.concat(named(id_col).cast("string"), F.lit(f"/{salt}/{seed}")))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)

    box = F.array(*[
        F.struct(F.lit(n).alias("area"), F.lit(a).alias("lat0"), F.lit(b).alias("lat1"), F.lit(c).alias("lon0"), F.lit(d).alias("lon1"))
        for n, a, b, c, d in boxes
    ])
    chosen = F.get(box, F.floor(fraction("area") * len(boxes)).cast("int"))
    placed = df.withColumn("_box", chosen)
    at = F.col("_box")
    lat = F.round(at["lat0"] + fraction("lat") * (at["lat1"] - at["lat0"]), 6)
    lon = F.round(at["lon0"] + fraction("lon") * (at["lon1"] - at["lon0"]), 6)
    return placed.select(*only(df, df.columns), at["area"].alias("area"), wkt_point(lon, lat).alias("gen_location"))
