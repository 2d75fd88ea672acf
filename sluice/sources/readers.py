"""Sources: JSON, CSV, arrays, images, lists, replays; and shapes of arrival."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sluice.errors import CompileError
from sluice.operators.relational import positions

QUESTIONS = "title string, question string, answer boolean, passage string"
PATIENTS = "patient_id bigint, patient_name string, age bigint, minutes_since_last_checkup double"


def json_lines(spark: SparkSession, path: str, schema: str = QUESTIONS, order: list[str] | None = None, skip: int = 0, take: int | None = None, index: str = "question_index") -> DataFrame:
    """JSON lines; with ``order`` they are numbered and a range of numbers is read."""
    df = spark.read.schema(schema).json(path)
    if order is None:
        if skip or take is not None:
            raise CompileError("a range of lines needs an order")
        return df
    numbered = positions(df, order, index)
    kept = numbered.filter(F.col(index) >= skip)
    return kept if take is None else kept.filter(F.col(index) < skip + take)


def csv(spark: SparkSession, path: str, schema: str = PATIENTS) -> DataFrame:
    """CSV with a header, read by position into the schema."""
    return spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def patients(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path).select(F.col("patient_id").cast("int"), "patient_name", F.col("age").cast("int"), "minutes_since_last_checkup")


def from_list(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


# --- arrays ----------------------------------------------------------------------------------


class _Rows(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class NpySource(DataSource):
    """Rows of a .npy array: ``position`` and the flattened rest as ``values`` with its ``dims``.

    Options: ``path``, a local one or a URI of any file system that Arrow opens (file, hdfs, s3, gs ...);
    ``rows`` a partition (default 1024).  A partition reads the bytes of its own rows only.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "position bigint, values array<double>, dims array<bigint>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _NpyReader(self.options)


class _NpyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.step = options["path"], int(options.get("rows", 1024))

    def partitions(self) -> list[InputPartition]:
        with _opened(self.path) as f:
            n = _npy_header(f)[0][0]
        return [_Rows(a, min(n, a + self.step)) for a in range(0, n, self.step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with _opened(self.path) as f:
            shape, kind, start = _npy_header(f)
            size = kind.itemsize * int(np.prod(shape[1:]))
            f.seek(start + partition.first * size)
            data = np.frombuffer(f.read((partition.last - partition.first) * size), kind).reshape(-1, *shape[1:])
        dims = [int(d) for d in shape[1:]]
        for i, row in enumerate(data, partition.first):
            yield i, row.astype(np.float64).ravel().tolist(), dims


def _opened(path: str):
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(where)


def _npy_header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and first byte of an array's data."""
    version = np.lib.format.read_magic(f)
    header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, kind = header(f)
    if not shape or kind.hasobject or (by_column and len(shape) > 1):
        raise CompileError(f"an array of rows of numbers is needed, not {kind} of shape {shape}")
    return shape, kind, f.tell()


def npy(spark: SparkSession, path: str, rows: int = 1024) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("path", path).option("rows", str(rows)).load()


def sequences(spark: SparkSession, path: str, labels_path: str, per_sequence: int, patients: int = 50) -> DataFrame:
    """Signals [sequence, place, samples, channels] with labels [sequence, place], as one row each."""
    signal, label = npy(spark, path), npy(spark, labels_path)
    dims = F.slice("dims", -2, 2)
    size = F.get(dims, F.lit(0)) * F.get(dims, F.lit(1))
    both = signal.join(label.select("position", F.col("values").alias("_labels")), "position")
    places = F.sequence(F.lit(0), F.lit(per_sequence - 1))
    each = both.select("position", "_labels", "values", dims.alias("sequence_dims"), size.alias("_n"), F.explode(places).alias("_i"))
    return each.select(
        F.pmod("position", F.lit(patients)).cast("int").alias("patient_id"),
        (F.col("position").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(20,0)") + F.col("_i")).cast("decimal(38,0)").alias("sequence_id"),
        F.slice("values", (F.col("_i") * F.col("_n") + 1).cast("int"), F.col("_n").cast("int")).cast("array<float>").alias("sequence"),
        "sequence_dims",
        F.get("_labels", F.col("_i")).cast("int").alias("label"),
    )


# --- images ----------------------------------------------------------------------------------


def images(spark: SparkSession, folder: str, index: DataFrame | None = None, pattern: str = "*") -> DataFrame:
    """Image files with their pixels, shape and sizes; an index (img_id, img_path, ...) picks and names them.

    Paths of the index are relative to the folder, or end in a path below it; they are met by equality on
    whole parts of the path, before any file's contents are joined or decoded.
    """
    from sluice.functions.images import decode

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)

    @F.pandas_udf("struct<shape:array<bigint>,data:binary>")
    def pixels(content):
        import pandas as pd

        out = []
        for data in content:
            try:
                image = decode(bytes(data))
                out.append({"shape": list(image.shape), "data": image.tobytes()})
            except (ValueError, IndexError):
                out.append({"shape": None, "data": None})
        return pd.DataFrame(out)

    df = files.select(F.col("path").alias("img_path"), "content")
    if index is not None:
        parts = lambda c: F.regexp_replace(c, "^(\\./|/)+", "")
        wanted = index.select(*[F.col(f"`{c}`") for c in index.columns if c != "img_path"], parts(F.col("img_path")).alias("_name")).withColumn("_parts", F.size(F.split("_name", "/")))
        # The last parts of a file's path, as many as the names of the index have.
        own = F.split("img_path", "/")
        depths = [r["_parts"] for r in wanted.select("_parts").distinct().collect()]
        tails = F.array(*[F.array_join(F.slice(own, -d, d), "/") for d in depths]) if depths else F.array().cast("array<string>")
        paths = df.select("img_path").withColumn("_name", F.explode(F.array_distinct(F.filter(F.when(F.size(own) >= max(depths, default=0), tails), lambda t: t != ""))))
        named = paths.join(wanted.drop("_parts"), "_name").drop("_name")
        df = df.join(named, "img_path")
    df = df.withColumn("image", pixels("content")).drop("content").withColumn("shape", F.col("image.shape"))
    h, w = F.get("shape", F.lit(0)), F.get("shape", F.lit(1))
    return df.withColumns({"image_shape": F.col("shape"), "original_width": w.cast("int"), "original_height": h.cast("int"), "original_width_float": w.cast("double"), "original_height_float": h.cast("double"), "original_area_float": (w * h).cast("double"), "original_hw_ratio_float": h / F.when(w != 0, w)})


def class_counts(metadata: DataFrame, image_id: str, counts: str, ids: dict[str, int]) -> DataFrame:
    """A column ``expected_count_<id>`` for each class of a map of counts; absent classes count 0."""
    return metadata.withColumns({f"expected_count_{n}": F.coalesce(F.col(counts)[name], F.lit(0)).cast("int") for name, n in ids.items()})


# --- arrivals, capture and replay ------------------------------------------------------------


def fixed_arrivals(df: DataFrame, position: str, interval_us: int, name: str = "arrival_us") -> DataFrame:
    return df.withColumn(name, F.col(position) * interval_us)


def wave_interval(position: Column, lower: int, upper: int, increment: int, hold: int) -> Column:
    """A triangle wave from ``lower`` to ``upper`` and back, a step after every ``hold`` items."""
    steps = max(1, -(-(upper - lower) // increment))
    phase = F.pmod(F.floor(position / hold), F.lit(2 * steps))
    rising = F.when(phase <= steps, phase).otherwise(2 * steps - phase)
    return F.least(F.lit(lower) + rising * increment, F.lit(upper))


def wave_arrivals(df: DataFrame, position: str, lower: int, upper: int, increment: int, hold: int, name: str = "arrival_us") -> DataFrame:
    """Arrival times as the sum of the wave's intervals so far, in closed form: no running window."""
    steps = max(1, -(-(upper - lower) // increment))
    heights = [min(lower + min(p, 2 * steps - p) * increment, upper) for p in range(2 * steps)]
    before = [sum(heights[:p]) * hold for p in range(2 * steps)]
    period = sum(heights) * hold
    i = F.col(position)
    phase = F.pmod(F.floor(i / hold), F.lit(2 * steps))
    table = lambda values: F.get(F.array(*[F.lit(v).cast("long") for v in values]), phase)
    cycles = F.floor(i / (2 * steps * hold))
    return df.withColumn(name, (cycles * period + table(before) + F.pmod(i, F.lit(hold)) * table(heights)).cast("long"))


def random_arrivals(df: DataFrame, position: str, mean_us: float, seed: int = 0, name: str = "arrival_us") -> DataFrame:
    """Exponential intervals that the position and the seed decide, each from its slot's beginning."""
    u = (F.pmod(F.xxhash64(F.col(position), F.lit(seed)), F.lit(1 << 30)) + 1) / float(1 << 30)
    return df.withColumn(name, (F.col(position) * mean_us - F.log(u) * mean_us).cast("long"))


def capture(df: DataFrame, path: str, order: list[str], n: int = 25) -> None:
    """The first ``n`` rows in an order, for looking at."""
    df.orderBy(*order).limit(n).write.mode("overwrite").parquet(path)


def replay(spark: SparkSession, path: str, relative_ns: str, start_ns: int = 0, cycles: int = 1, adjust_ns: int | Sequence[int] = 0, order: list[str] | None = None) -> DataFrame:
    """Captured rows with creation times from ``start_ns`` on; further cycles follow the first.

    ``adjust_ns`` shifts creation times: one number, or a sequence that rows take in their order (``relative_ns``,
    then ``order``) around and around through all cycles.  The first pass takes no adjustment below 0; later ones do.
    """
    df = spark.read.parquet(path)
    first = df.agg(F.max(relative_ns).alias("span"), F.count("*").alias("n")).first()
    span, n = first["span"] or 0, first["n"]
    shift = F.lit(adjust_ns) if isinstance(adjust_ns, int) else None
    if shift is None:
        if not len(adjust_ns):
            raise CompileError("a sequence of adjustments must not be empty")
        df = positions(df, [relative_ns, *(order or [])], "_position")
    repeated = df.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))))
    if shift is None:
        at = F.pmod(F.col("cycle").cast("long") * n + F.col("_position"), F.lit(len(adjust_ns))).cast("int")
        shift = F.get(F.array(*[F.lit(int(a)).cast("long") for a in adjust_ns]), at)
    shift = F.when(F.col("cycle") == 0, F.greatest(shift, F.lit(0))).otherwise(shift)
    created = F.lit(start_ns).cast("long") + F.col("cycle") * (span + 1) + F.col(relative_ns) + shift
    return repeated.withColumn("created_ns", created).drop("_position")


def event_log(df: DataFrame, location: str, id_col: str, time_ns: str, start_ns: int, aux: list[str] | None = None) -> DataFrame:
    """Rows of an event log: where, which, when, and further fields as text."""
    extra = F.create_map(*[x for a in aux or [] for x in (F.lit(a), F.col(a).cast("string"))]) if aux else F.create_map().cast("map<string,string>")
    return df.select(F.lit(location).alias("location"), F.col(id_col).alias("tuple_id"), F.col(time_ns).cast("decimal(38,0)").alias("unix_time_ns"), (F.col(time_ns) - start_ns).cast("decimal(38,0)").alias("relative_time_ns"), extra.alias("aux"))
