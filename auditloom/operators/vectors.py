"""Score and feature vectors: centroids, nearest class, top-k, parity of two engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): elementwise means, summed by (label, place) on the map side."""
    places = rows.select(label, F.posexplode(vector).alias("pos", "v"))
    mean = places.groupBy(label, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def nearest_centroid(rows: DataFrame, centres: DataFrame, key: str, label: str, vector: str, most: int = 10_000) -> DataFrame:
    """(key, label, nearest, distance): for each row the label of the closest centroid, the
    smallest label among equals.

    The centroids, one for each class, become an array that goes along with the rows; more
    than `most` classes are refused, as this plan is for a class list of a proven size."""
    n = centres.count()
    if n > most:
        raise ValueError(f"{n} centroids; at most {most} are sent to the executors")
    table = centres.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col("centroid").alias("c")))).alias("_centres"))
    best = F.array_min(F.transform("_centres", lambda s: F.struct(squared_distance(F.col(vector), s["c"]).alias("d"), s["l"].alias("l"))))
    return rows.select(key, label, vector).join(F.broadcast(table)).withColumn("_b", best).select(key, label, F.col("_b.l").alias("nearest"), F.sqrt("_b.d").alias("distance"))


def closer_to(vector: Column, reference: Column, control: Column) -> Column:
    """Strictly closer to the reference than to the control."""
    return squared_distance(vector, reference) < squared_distance(vector, control)


def audit_verdict(ref_rate: Column, control_rate: Column, suspect_rate: Column) -> Column:
    """Unusable where the method fails its own test (reference >= 0.75, control <= 0.25); else
    which side the suspects fall on."""
    usable = (ref_rate >= 0.75) & (control_rate <= 0.25)
    return F.when(~usable, "unusable").when(suspect_rate >= 0.60, "reference").when(suspect_rate <= 0.40, "control").otherwise("mixed")


def top_k(scores: Column, k: int) -> Column:
    """array<struct<idx, p>>: the k largest, the lowest index first among equals."""
    ranked = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x.cast("double")).alias("neg"), i.alias("idx"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: F.struct(s["idx"].alias("idx"), (-s["neg"]).alias("p")))


def argmax(scores: Column) -> Column:
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def bound(value: Column, use) -> Column:
    """use(value), with the value worked out once a row: a lambda's variable, not an expression that
    is repeated for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def ties_at_top(scores: Column) -> Column:
    return bound(F.array_max(scores), lambda top: F.size(F.filter(scores, lambda x: x == top)))


def softmax_if_needed(scores: Column) -> Column:
    """Probabilities pass through (none negative, sum within 0.9 and 1.1); other scores get a
    softmax, shifted by their maximum."""

    def softmax(values: Column) -> Column:
        exp = bound(F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top)))
        return bound(exp, lambda e: bound(_sum(e), lambda total: F.transform(e, lambda x: x / total)))

    plain = lambda v: (F.array_min(v) >= 0) & _sum(v).between(0.9, 1.1)
    return bound(F.transform(scores, lambda x: x.cast("double")), lambda v: F.when(plain(v), v).otherwise(softmax(v)))


def clip_and_normalise(scores: Column) -> Column:
    """Negative values become 0, then the sum 1; null where nothing is left."""
    clipped = F.transform(scores, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    return bound(clipped, lambda c: bound(_sum(c), lambda total: F.when(total > 0, F.transform(c, lambda x: x / total))))


def mean_of_two(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2)


def quantise(values: Column, scale: float, zero: int, low: int = -128, high: int = 127) -> Column:
    """round(x / scale) + zero with halves to even, clipped."""
    return F.transform(values, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), F.rint(x.cast("double") / scale) + zero)).cast("int"))


def quantise_half_up(values: Column, scale: float, zero: int) -> Column:
    """round(x / scale + zero), halves upwards, as whole numbers that nothing cuts off."""
    return F.transform(values, lambda x: F.floor(x.cast("double") / scale + zero + 0.5).cast("int"))


def dequantise(values: Column, scale: float, zero: int) -> Column:
    return F.transform(values, lambda q: (q - zero) * F.lit(float(scale)))


def parity(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """Two engines on the same items: key, whether the top class agrees, largest difference."""
    joined = a.select(key, F.col(vector).alias("_a")).join(b.select(key, F.col(vector).alias("_b")), key)
    delta = F.array_max(F.zip_with("_a", "_b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return joined.select(key, (argmax(F.col("_a")) == argmax(F.col("_b"))).alias("agree"), delta.alias("max_delta"))


def parity_verdict(rows: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """n, agreement, max_delta, ok: all agree and no difference exceeds the tolerance."""
    out = rows.agg(F.count("*").alias("n"), F.avg(F.col("agree").cast("double")).alias("agreement"), F.max("max_delta").alias("max_delta"))
    return out.withColumn("ok", (F.col("agreement") >= 1.0) & (F.col("max_delta") <= tolerance))
