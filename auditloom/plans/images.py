"""Queries on images: PNG files drawn from the embeddings, decoded, examined and compared."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from auditloom.functions import pixels
from auditloom.operators import similarity as sim, vectors as v
from auditloom.operators.scratch import stored
from auditloom.plans.fixtures import table
from auditloom.sources import images

#: Pixels of a value's block: files are 24 wide and 32 high, or 64 by 64.
SMALL, SQUARE = (3, 4), (8, 8)


def drawn(spark, d, block):
    """path, vec_id, label, content: each embedding as a PNG file, its values blocks of 8 by 8 colours."""
    wide, high = block
    schema = pa.schema([("path", pa.string()), ("vec_id", pa.int64()), ("label", pa.int32()), ("content", pa.binary())])

    def run(batches):
        for batch in batches:
            for i, label, vector in zip(*[batch.column(c).to_pylist() for c in range(3)]):
                level = np.clip(np.floor(128 + 256 * np.array(vector, np.float64)), 0, 255).astype(np.uint8)
                colours = np.stack([level, np.roll(level, -1), 255 - np.roll(level, -2)], 1).reshape(8, 8, 3)
                content = pixels.png(colours.repeat(high, 0).repeat(wide, 1))
                yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip([f"{label}/{i}.png", i, label, content], schema)], schema=schema)

    # a row costs milliseconds here and in what reads the files: few row groups would make few long tasks
    even = table(spark, d, "embeddings").select("vec_id", "label", "embedding").repartition(4 * spark.sparkContext.defaultParallelism, "vec_id")
    return even.mapInArrow(run, "path string, vec_id long, label int, content binary")


def image_signatures(spark, d):
    """Size and difference hash of each file, by Lanczos from 24 x 32 pixels to 9 x 8 gray ones."""
    files = drawn(spark, d, SMALL)
    return images.examined(files, ["dhash"]).select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("vec_id"), "width", "height", "dhash")


def image_near_pairs(spark, d):
    """Pairs of files with difference hashes at distance 14 or less."""
    signed = stored(image_signatures(spark, d), spark)  # both sides of the join read it
    return sim.near_pairs(signed, signed, "vec_id", "dhash", 14, self_join=True)


def corrupt_images(spark, d):
    """Files of which some are empty, cut off, of another kind, or changed: how many by label and reason."""
    content, size = F.col("content"), F.octet_length("content")
    # 8 bytes begin the file, 25 hold its header; the pixels' chunk begins at 33 with size and name
    changed = F.concat(F.substring("content", 1, 60), F.unhex(F.hex(F.substring(F.sha2("path", 256).cast("binary"), 1, 9))), F.substring(content, F.lit(70), size - 69))
    damage = F.when(F.col("vec_id") % 9 == 1, F.unhex(F.lit(""))).when(F.col("vec_id") % 9 == 2, F.substring(content, F.lit(1), F.floor(size / 2).cast("int"))).when(F.col("vec_id") % 9 == 3, F.concat(F.unhex(F.lit("FFD8FFE0")), content)).when(F.col("vec_id") % 9 == 4, changed).when(F.col("vec_id") % 9 == 5, F.col("path").cast("binary")).when(F.col("vec_id") % 9 == 6, F.lit(None)).otherwise(content)
    found = images.examined(drawn(spark, d, SMALL).withColumn("content", damage))
    return found.groupBy(F.split("path", "/")[0].cast("int").alias("label"), "kind", "reason").agg(F.count("*").alias("n"))


def colour_histograms(spark, d):
    """The 40 shares of hue, saturation and value of each file."""
    found = images.examined(drawn(spark, d, SQUARE), ["hsv"])
    return found.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("vec_id"), F.posexplode("hsv").alias("bin", "share")).filter("share > 0").withColumn("share", F.round("share", 9))


def colour_audit(spark, d):
    """Are the pictures of label 2 nearer in colour to those of label 0 (reference) than of label 1 (control)?"""
    found = images.examined(drawn(spark, d, SQUARE), ["hsv"])
    e = found.select(F.split("path", "/")[0].cast("int").alias("label"), F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("vec_id"), F.col("hsv").alias("embedding")).filter("label < 3")
    e = stored(e, spark)  # pictures are decoded once
    c = v.centroids(e.filter("vec_id % 2 = 0"), "label", "embedding")
    ref, control = (F.broadcast(c.filter(F.col("label") == i).select(F.col("centroid").alias(n))) for i, n in ((0, "r"), (1, "k")))
    closer = v.closer_to(F.col("embedding"), F.col("r"), F.col("k")).cast("double")
    rows = e.filter("(vec_id % 2 = 1 and label < 2) or label = 2").join(ref).join(control).groupBy().agg(*[F.round(F.avg(F.when(F.col("label") == i, closer)), 6).alias(n) for i, n in ((0, "ref_rate"), (1, "control_rate"), (2, "suspect_rate"))])
    return rows.withColumn("verdict", v.audit_verdict(F.col("ref_rate"), F.col("control_rate"), F.col("suspect_rate")))


def image_inputs(spark, d):
    """Each file as a model's input of 16 x 16 in five ways, channels first: mean and largest value by channel."""
    made = images.model_inputs(drawn(spark, d, SMALL), 16, channels_first=True).select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("vec_id"), "transform", F.posexplode("values").alias("pos", "value"))
    return made.groupBy("vec_id", "transform", F.floor(F.col("pos") / 256).cast("int").alias("channel")).agg(F.round(F.avg(F.col("value").cast("double")), 6).alias("mean"), F.round(F.max("value").cast("double"), 6).alias("most"))


QUERIES = {f.__name__: f for f in (image_signatures, image_near_pairs, corrupt_images, colour_histograms, colour_audit, image_inputs)}

_LEVEL = "greatest(0, least(255, floor(128 + 256 * embedding[{0}]::DOUBLE)))::BIGINT"
#: Colours of the 8 x 8 blocks, and the pixels of the files of 24 x 32.
_COLOURS = f"""c AS (SELECT vec_id, label, i // 8 AS iy, i % 8 AS ix, {_LEVEL.format("i + 1")} AS r, {_LEVEL.format("(i + 1) % 64 + 1")} AS g, 255 - {_LEVEL.format("(i + 2) % 64 + 1")} AS b FROM embeddings, range(64) t(i))"""


def _weights(name: str, size: int, to: int, kernel: str, reach: int) -> str:
    """The banded matrix of a filter as a table (out, place, w) of whole numbers."""
    scale, stretch = size / to, max(size / to, 1)
    return f"""{name} AS (SELECT o, p, trunc(w + sign(w) * 0.5)::BIGINT AS w FROM (SELECT o, p, k / sum(k) OVER (PARTITION BY o) * 4194304 AS w FROM (
  SELECT o, p, {kernel} AS k FROM (SELECT o, p, (p - (o + 0.5::DOUBLE) * {scale}::DOUBLE + 0.5) / {stretch}::DOUBLE AS t FROM range({to}) a(o), range({size}) b(p)
    WHERE p >= greatest(0, trunc((o + 0.5::DOUBLE) * {scale}::DOUBLE - {reach * stretch}::DOUBLE + 0.5)) AND p < least({size}, trunc((o + 0.5::DOUBLE) * {scale}::DOUBLE + {reach * stretch}::DOUBLE + 0.5))))))"""


_SINC = "CASE WHEN t = 0 THEN 1.0 WHEN t >= -3 AND t < 3 THEN sin(pi() * t) / (pi() * t) * (sin(pi() * t / 3) / (pi() * t / 3)) ELSE 0.0 END"
_BYTE = "greatest(0, least(255, (sum({0}) + 2097152) >> 22))"
_HASHES = f"""WITH {_COLOURS}, {_weights("wx", 24, 9, _SINC, 3)}, {_weights("wy", 32, 8, _SINC, 3)},
l AS (SELECT vec_id, iy, ix, (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 AS v FROM c),
h AS (SELECT vec_id, iy, o AS x, {_BYTE.format("v * w")}::BIGINT AS v FROM l JOIN wx ON wx.p // 3 = l.ix GROUP BY ALL),
s AS (SELECT vec_id, x, o AS y, {_BYTE.format("v * w")}::BIGINT AS v FROM h JOIN wy ON wy.p // 4 = h.iy GROUP BY ALL),
z AS (SELECT a.vec_id, sum(CASE WHEN a.v > b.v THEN 1::HUGEINT << (a.y * 8 + a.x)::INT ELSE 0 END) AS u, string_agg(CASE WHEN a.v > b.v THEN '1' ELSE '0' END, '' ORDER BY a.y, a.x)::BIT AS bits FROM s a JOIN s b ON a.vec_id = b.vec_id AND a.y = b.y AND b.x = a.x + 1 GROUP BY a.vec_id)"""

#: Hue, saturation and value of each block's colour, in single precision as far as that is used.
_HSV = f"""WITH {_COLOURS}, m AS (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low FROM c),
q AS (SELECT *, (top - low)::FLOAT AS d, CASE WHEN top > low THEN (top - r)::FLOAT / (top - low)::FLOAT END AS rc, CASE WHEN top > low THEN (top - g)::FLOAT / (top - low)::FLOAT END AS gc, CASE WHEN top > low THEN (top - b)::FLOAT / (top - low)::FLOAT END AS bc FROM m),
u AS (SELECT *, CASE WHEN r = top THEN bc - gc WHEN g = top THEN 2::FLOAT + rc - bc ELSE 4::FLOAT + gc - rc END::DOUBLE AS hh FROM q),
p AS (SELECT vec_id, label, CASE WHEN d = 0 THEN 0 ELSE trunc((fmod(hh / 6.0::DOUBLE + 1.0::DOUBLE, 1.0::DOUBLE)::FLOAT)::DOUBLE * 255)::INT END AS h, CASE WHEN d = 0 THEN 0 ELSE trunc(((d / top::FLOAT)::FLOAT)::DOUBLE * 255)::INT END AS s, top::INT AS v FROM u),
k AS (SELECT vec_id, label, h * 24 // 256 AS bin FROM p UNION ALL SELECT vec_id, label, 24 + s * 8 // 256 FROM p UNION ALL SELECT vec_id, label, 32 + v * 8 // 256 FROM p),
t AS (SELECT vec_id, label, bin, count(*) / 64::DOUBLE AS share FROM k GROUP BY ALL)"""

ORACLE_SQL = {
    "image_signatures": f"{_HASHES} SELECT vec_id, 24::INT AS width, 32::INT AS height, CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END::BIGINT AS dhash FROM z",
    "image_near_pairs": f"{_HASHES}, e AS (SELECT vec_id, bits FROM z) SELECT a.vec_id AS id_a, b.vec_id AS id_b, CAST(bit_count(xor(a.bits, b.bits)) AS INT) AS distance FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.bits, b.bits)) <= 14",
    "corrupt_images": """SELECT label, CASE vec_id % 9 WHEN 1 THEN 'unknown' WHEN 3 THEN 'jpeg' WHEN 5 THEN 'unknown' WHEN 6 THEN 'unknown' ELSE 'png' END AS kind,
  CASE vec_id % 9 WHEN 1 THEN 'empty file' WHEN 2 THEN 'truncated file' WHEN 3 THEN 'not a PNG file: jpeg' WHEN 4 THEN 'checksum differs' WHEN 5 THEN 'not a PNG file: unknown' WHEN 6 THEN 'empty file' END AS reason, count(*) AS n FROM embeddings GROUP BY ALL""",
    "colour_histograms": f"{_HSV} SELECT vec_id, bin::INT AS bin, round(share, 9) AS share FROM t",
    "colour_audit": f"""{_HSV}, x AS (SELECT i.vec_id, i.label, i.bin, coalesce(share, 0) AS e FROM (SELECT vec_id, label, bin FROM embeddings, range(40) r(bin) WHERE label < 3) i LEFT JOIN t USING (vec_id, bin)),
n AS (SELECT label, bin, avg(e) AS m FROM x WHERE vec_id % 2 = 0 GROUP BY ALL), w AS (SELECT vec_id, x.label, sum((e - a.m) * (e - a.m)) < sum((e - o.m) * (e - o.m)) AS closer FROM x JOIN n a ON a.bin = x.bin AND a.label = 0 JOIN n o ON o.bin = x.bin AND o.label = 1 WHERE (vec_id % 2 = 1 AND x.label < 2) OR x.label = 2 GROUP BY ALL),
z AS (SELECT round(avg(closer::INT) FILTER (WHERE label = 0), 6) AS ref_rate, round(avg(closer::INT) FILTER (WHERE label = 1), 6) AS control_rate, round(avg(closer::INT) FILTER (WHERE label = 2), 6) AS suspect_rate FROM w)
SELECT *, CASE WHEN NOT (ref_rate >= 0.75 AND control_rate <= 0.25) THEN 'unusable' WHEN suspect_rate >= 0.6 THEN 'reference' WHEN suspect_rate <= 0.4 THEN 'control' ELSE 'mixed' END AS verdict FROM z""",
}
