"""Python functions and models over Arrow batches.

Loaded scripts and model sessions live as long as a worker and are shared by its tasks.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import CompileError


@lru_cache(maxsize=64)
def script_function(folder: str, script: str, function: str) -> Callable:
    """A function of a Python script."""
    path = f"{folder}/{script}" if script.endswith(".py") else f"{folder}/{script}.py"
    spec = importlib.util.spec_from_file_location(f"script_{abs(hash(path))}", path)
    if spec is None or spec.loader is None:
        raise CompileError(f"no script {path}")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return getattr(module, function)


def inline_python(df: DataFrame, function: Callable, args: list[str], outputs: str, on_error: str = "drop") -> DataFrame:
    """Call ``function`` with the values of ``args``; its results fill the fields of ``outputs`` (a DDL).

    A row on which it raises, or gives another number of values, is dropped (``null``: kept with nulls).
    """
    fields = T._parse_datatype_string(outputs)
    kind = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("out", fields)])

    @F.pandas_udf(kind)
    def call(frame):
        import pandas as pd

        rows, good = [], []
        for values in zip(*[frame[c] for c in frame.columns], strict=True):
            try:
                got = function(*[None if v is pd.NA else v for v in values])
                got = list(got) if len(fields) > 1 or isinstance(got, (list, tuple)) and len(fields) == len(got) else [got]
                if len(got) != len(fields):
                    raise ValueError("another number of values")
                rows.append(dict(zip(fields.names, got, strict=True)))
                good.append(True)
            except Exception:
                rows.append(dict.fromkeys(fields.names))
                good.append(False)
        return pd.DataFrame({"ok": good, "out": rows})

    called = df.withColumn("_call", call(F.struct(*args)))
    if on_error == "drop":
        called = called.filter("_call.ok")
    return called.withColumns({n: F.col(f"_call.out.`{n}`") for n in fields.names}).drop("_call")


def coded(function: Callable, encode: Callable | None = None, decode: Callable | None = None) -> Callable:
    """``function`` behind its own codec: ``encode`` makes its arguments of the fields' values, ``decode``
    the output fields' values of what it returns."""

    def call(*values):
        args = values if encode is None else encode(*values)
        got = function(*(args if isinstance(args, (list, tuple)) else (args,)))
        return got if decode is None else decode(got)

    return call


def remote_python(df: DataFrame, worker: Callable, schema: str | T.StructType, encode: Callable | None = None, decode: Callable | None = None, shutdown: Callable | None = None) -> DataFrame:
    """A worker over pandas batches in Spark's own Python processes; a failed task is run again by Spark.

    With a codec the worker takes and gives single values: ``encode(row)`` makes its argument, ``decode(row,
    value)`` the output row, and a row that either rejects is dropped.  ``shutdown()`` runs when a task's
    rows are through.
    """
    if encode is None and decode is None and shutdown is None:
        return df.mapInPandas(worker, schema)
    names = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).names

    def run(frames):
        import pandas as pd

        def rows():
            for frame in frames:
                out = []
                for row in frame.to_dict("records"):
                    try:
                        value = worker(row if encode is None else encode(row))
                        made = value if decode is None else decode(row, value)
                        out.append([made[n] for n in names])
                    except Exception:
                        continue
                yield pd.DataFrame(out, columns=names)

        try:
            yield from worker(frames) if encode is None and decode is None else rows()
        finally:
            if shutdown is not None:
                shutdown()

    return df.mapInPandas(run, schema)


@lru_cache(maxsize=8)
def _session(path: str, data: bytes | None):
    import onnxruntime

    quiet = onnxruntime.SessionOptions()
    quiet.intra_op_num_threads = 1
    return onnxruntime.InferenceSession(data if data is not None else path, quiet, providers=["CPUExecutionProvider"])


def onnx_inference(df: DataFrame, model: str | bytes, inputs: list[str], outputs: list[str], batch: int = 256) -> DataFrame:
    """``df`` with each output of an ONNX model as a float array.

    Inputs are float arrays of one length each.  If a call fails the outputs of all its rows are null,
    as they are for rows with a null input.
    """
    path, data = (model, None) if isinstance(model, str) else ("", model)
    kind = T.StructType([T.StructField(o, T.ArrayType(T.FloatType())) for o in outputs])

    @F.pandas_udf(kind)
    def infer(frame):
        import pandas as pd

        out = {o: [None] * len(frame) for o in outputs}
        rows = np.flatnonzero(frame.notna().all(axis=1).to_numpy())
        session = _session(path, data)
        names = [i.name for i in session.get_inputs()]
        for at in range(0, len(rows), batch):
            own = rows[at : at + batch]
            try:
                feed = {n: np.stack([np.asarray(v, np.float32) for v in frame.iloc[own, k]]) for k, n in enumerate(names)}
                got = session.run(None, feed)
            except Exception:
                continue
            for o, values in zip(outputs, got, strict=False):
                for r, v in zip(own, np.asarray(values, np.float32).reshape(len(own), -1), strict=True):
                    out[o][r] = v.tolist()
        return pd.DataFrame(out)

    called = df.withColumn("_model", infer(F.struct(*[F.col(f"`{c}`") for c in inputs])))
    return called.withColumns({o: F.col(f"_model.`{o}`") for o in outputs}).drop("_model")


def model_function(name: str, function: Callable, inputs: list[str], kind: str) -> Column:
    """A function of numpy arrays as a Column, called on whole Arrow batches."""

    @F.pandas_udf(kind)
    def run(frame):
        import pandas as pd

        return pd.Series(list(function(*[np.stack(frame[c].to_numpy()) if frame[c].dtype == object else frame[c].to_numpy() for c in frame.columns])))

    return run(F.struct(*inputs)).alias(name)


def hash_embedding(text: Column, dim: int = 768) -> Column:
    """A deterministic stand-in for a sentence embedder: signed counts of hashed words, of length 1.

    A null text gives null and a text without words zeros.
    """
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(2 * dim)))
    zeros = F.array_repeat(F.lit(0.0), dim)
    added = F.aggregate(slots, zeros, lambda acc, s: F.transform(acc, lambda v, i: F.when(i == F.pmod(s, F.lit(dim)), v + F.when(s < dim, 1.0).otherwise(-1.0)).otherwise(v)))
    norm = F.sqrt(F.aggregate(added, F.lit(0.0), lambda a, v: a + v * v))
    return F.when(text.isNotNull(), F.transform(added, lambda v: F.when(norm > 0, v / F.when(norm > 0, norm)).otherwise(0.0)))


# --- a linear model in ONNX's format, for tests and examples -----------------------------------


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _message(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def linear_onnx(weights: np.ndarray, bias: np.ndarray) -> bytes:
    """An ONNX model y = x W + b for [batch, n] floats."""
    n, m = weights.shape

    def tensor(name: str, a: np.ndarray) -> bytes:
        return b"".join(_number(1, d) for d in a.shape) + _number(2, 1) + _message(8, name.encode()) + _message(9, np.ascontiguousarray(a, "<f4").tobytes())

    def value(name: str, width: int) -> bytes:
        shape = _message(1, _message(2, b"batch")) + _message(1, _number(1, width))
        return _message(1, name.encode()) + _message(2, _message(1, _number(1, 1) + _message(2, shape)))

    def node(kind: str, a: str, b: str, out: str) -> bytes:
        return _message(1, a.encode()) + _message(1, b.encode()) + _message(2, out.encode()) + _message(4, kind.encode())

    graph = _message(1, node("MatMul", "x", "w", "xw")) + _message(1, node("Add", "xw", "b", "y")) + _message(2, b"linear") + _message(5, tensor("w", weights)) + _message(5, tensor("b", bias)) + _message(11, value("x", n)) + _message(12, value("y", m))
    return _number(1, 8) + _message(7, graph) + _message(8, _message(1, b"") + _number(2, 13))
