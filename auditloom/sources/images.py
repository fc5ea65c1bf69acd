"""Tables of images: files with their content, or rows of Spark's image source, and what their pixels tell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import pixels

#: What can be told of an image: type in a table, and how.
TOLD = {
    "dhash": ("long", pixels.dhash),
    "dhash_first_high": ("long", lambda image: pixels.dhash(image, first_high=True)),
    "hsv": ("array<double>", lambda image: pixels.hsv_histogram(image).tolist()),
}


def _type(name: str) -> pa.DataType:
    return pa.int64() if TOLD[name][0] == "long" else pa.list_(pa.float64())


def examined(files: DataFrame, told: list[str] | None = None, key: str = "path", content: str = "content") -> DataFrame:
    """(key, width, height, kind, reason, told...) of files with their content.

    Every PNG file is decoded in full: the check is that its pixels can be read. reason is null
    then, else one of `empty file`, `truncated file`, `not a PNG file: <kind>`, `checksum differs`, `no
    header`, `damaged pixels`, `unsupported form` and `too large`, and what the pixels would tell is
    null. A null content is an empty file. Files stay in the tasks that read them, one at a time.
    Spark's file sources give no row for a file without bytes: such files of a tree are found by
    missing_rows() against a list of its names.
    """
    told = told or []
    schema = pa.schema([("key", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("kind", pa.string()), ("reason", pa.string()), *[(n, _type(n)) for n in told]])

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = data.as_py() or b""
                try:
                    image, reason = pixels.read_png(content), None
                    row = [image.shape[1], image.shape[0], "png", None, *[TOLD[n][1](image) for n in told]]
                except pixels.BadImage as e:
                    row = [None, None, pixels.kind_of(content), str(e), *[None] * len(told)]
                yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip([name, *row], schema)], schema=schema)

    ddl = "key string, width int, height int, kind string, reason string" + "".join(f", {n} {TOLD[n][0]}" for n in told)
    out = files.select(F.col(key).cast("string").alias("key"), F.col(content).cast("binary")).mapInArrow(run, ddl)
    return out.withColumnRenamed("key", key)


def decoded(spark: SparkSession, root: str, told: list[str]) -> DataFrame:
    """(path, width, height, told...) of all images below a folder that Spark's image source decodes,
    JPEG, PNG, BMP and GIF; those that it can't decode have no width and nothing told."""
    images = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(root)
    schema = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), *[(n, _type(n)) for n in told]])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                image = pixels.from_bgr(row["data"], row["height"], row["width"], row["nChannels"]) if row["width"] > 0 else None
                values = [row["origin"], row["width"] if image is not None else None, row["height"] if image is not None else None, *[TOLD[n][1](image) if image is not None else None for n in told]]
                yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(values, schema)], schema=schema)

    ddl = "path string, width int, height int" + "".join(f", {n} {TOLD[n][0]}" for n in told)
    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, ddl)


def model_inputs(files: DataFrame, size: int, transforms: list[str] | None = None, key: str = "path", content: str = "content", channels_first: bool = False) -> DataFrame:
    """(key, transform, values): each readable PNG file as a model's input, size x size x 3 numbers
    from 0 to 1, in each of the ways of pixels.TRANSFORMS or some of them."""
    ways = transforms or list(pixels.TRANSFORMS)
    schema = pa.schema([("key", pa.string()), ("transform", pa.string()), ("values", pa.list_(pa.float32()))])

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    image = pixels.read_png(data.as_py() or b"")
                except pixels.BadImage:
                    continue
                values = [pixels.model_input(image, size, way, channels_first).reshape(-1) for way in ways]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ways) + 1, dtype=np.int32) * (3 * size * size)), pa.array(np.concatenate(values)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ways), pa.string()), pa.array(ways), flat], schema=schema)

    out = files.select(F.col(key).cast("string").alias("key"), F.col(content).cast("binary")).mapInArrow(run, "key string, transform string, values array<float>")
    return out.withColumnRenamed("key", key)
