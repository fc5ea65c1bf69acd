"""Queries on signatures and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import metrics, similarity as sim, vectors as v
from auditloom.plans.fixtures import SQL_SIGS, signatures, table

#: Signs of random vectors: at 18 of 64 some pairs are near.
LIMIT = 18


def neardup_pairs(spark, d):
    s = signatures(spark, d)
    return sim.near_pairs(s, s, "vec_id", "sig", LIMIT, ["label"], self_join=True)


def neardup_cross(spark, d):
    """Pairs across two halves, whatever their labels."""
    s = signatures(spark, d)
    return sim.near_pairs(s.filter("vec_id % 2 = 0"), s.filter("vec_id % 2 = 1"), "vec_id", "sig", LIMIT)


def neardup_apart(spark, d):
    """Pairs of one table whose rows are in different splits."""
    s = signatures(spark, d).withColumn("split", F.col("vec_id") % 3)
    return sim.near_pairs(s, s, "vec_id", "sig", LIMIT, self_join=True, apart="split")


def neardup_hist(spark, d):
    return metrics.histogram(neardup_cross(spark, d), F.col("distance"), [0.0, 10.0, 14.0, 16.0, 19.0])


def neardup_flagged(spark, d):
    """Rows with a near pair in the other half, by label."""
    near = neardup_cross(spark, d).select(F.col("id_a").alias("vec_id")).distinct()
    return signatures(spark, d).filter("vec_id % 2 = 0").join(near.withColumn("near", F.lit(True)), "vec_id", "left").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.coalesce("near", F.lit(False))).cast("long").alias("flagged"))


def _vector_pairs(spark, d):
    """Near pairs of one label with the differences of their vectors, times 100."""
    rows = table(spark, d, "embeddings").withColumn("sig", sim.sign_signature(F.col("embedding")))
    near = sim.near_differences(rows, "vec_id", "sig", "embedding", LIMIT, ["label"])
    return near.withColumns({"most": F.col("most") * 100, "mean": F.col("mean") * 100})


def best_twin(spark, d):
    out = sim.best_twin(_vector_pairs(spark, d), "id_a", "id_b", "most", "mean")
    return out.withColumn("most", F.round("most", 6)).withColumn("mean", F.round("mean", 6))


def mae_verdicts(spark, d):
    return _vector_pairs(spark, d).select("id_a", "id_b", F.round("mean", 6).alias("mae"), sim.verdict(F.col("mean"), 5.0, 8.0).alias("verdict"))


def greedy_dedup(spark, d):
    return sim.greedy_keep(signatures(spark, d), "vec_id", "sig", 14)


def centroids(spark, d):
    c = v.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("pos", "m")).select("label", "pos", F.round("m", 6).alias("mean"))


def nearest_centroid(spark, d):
    e = table(spark, d, "embeddings")
    return v.nearest_centroid(e, v.centroids(e, "label", "embedding"), "vec_id", "label", "embedding").withColumn("distance", F.round("distance", 6))


def label_audit_verdict(spark, d):
    """Are the vectors of label 2 nearer to label 0 (reference) than to label 1 (control)?"""
    e = table(spark, d, "embeddings")
    c = v.centroids(e.filter("vec_id % 2 = 0"), "label", "embedding")
    ref, control = (F.broadcast(c.filter(F.col("label") == i).select(F.col("centroid").alias(n))) for i, n in ((0, "r"), (1, "k")))
    closer = v.closer_to(F.col("embedding"), F.col("r"), F.col("k")).cast("double")
    rows = e.filter("(vec_id % 2 = 1 and label < 2) or label = 2").join(ref).join(control).groupBy().agg(*[F.round(F.avg(F.when(F.col("label") == i, closer)), 6).alias(n) for i, n in ((0, "ref_rate"), (1, "control_rate"), (2, "suspect_rate"))])
    return rows.withColumn("verdict", v.audit_verdict(F.col("ref_rate"), F.col("control_rate"), F.col("suspect_rate")))


def vector_topk(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", F.posexplode(v.top_k(F.col("embedding"), 3)).alias("rank", "s"))
    return t.select("vec_id", "rank", F.col("s.idx").alias("idx"), F.round("s.p", 6).alias("p"))


def score_ties(spark, d):
    tens = F.transform("embedding", lambda x: F.round(x.cast("double") * 5, 0))
    return table(spark, d, "embeddings").select("vec_id", v.argmax(tens).cast("long").alias("first"), v.ties_at_top(tens).cast("long").alias("ties"))


def _two_engines(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e, e.select("vec_id", F.transform("v", lambda x, i: F.when((F.col("vec_id") % 50 == 0) & (i == 0), x + 1.0).otherwise(x + 0.0005)).alias("v"))


def parity_delta(spark, d):
    return v.parity(*_two_engines(spark, d), "vec_id", "v").withColumn("max_delta", F.round("max_delta", 6))


def parity_verdict(spark, d):
    out = v.parity_verdict(v.parity(*_two_engines(spark, d), "vec_id", "v"))
    return out.withColumn("agreement", F.round("agreement", 6)).withColumn("max_delta", F.round("max_delta", 6))


def softmax_scores(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(v.softmax_if_needed(F.col("embedding"))).alias("idx", "p"))
    return e.select("vec_id", "idx", F.round("p", 6).alias("p"))


def quantised(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", v.quantise(F.col("embedding"), 0.004, 3).alias("q"))
    return e.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_min("q").alias("low"), F.array_max("q").alias("high"))


QUERIES = {f.__name__: f for f in (neardup_pairs, neardup_cross, neardup_apart, neardup_hist, neardup_flagged, best_twin, mae_verdicts, greedy_dedup, centroids, nearest_centroid, label_audit_verdict, vector_topk, score_ties, parity_delta, parity_verdict, softmax_scores, quantised)}

_S = f"WITH {SQL_SIGS}"
_NEAR = f"{_S}, n AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, CAST(bit_count(xor(a.sig, b.sig)) AS INT) AS distance FROM s a JOIN s b ON a.vec_id < b.vec_id AND a.label = b.label WHERE bit_count(xor(a.sig, b.sig)) <= {LIMIT})"
_CROSS = f"{_S}, n AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, CAST(bit_count(xor(a.sig, b.sig)) AS INT) AS distance FROM s a, s b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND bit_count(xor(a.sig, b.sig)) <= {LIMIT})"
_V = f"{_NEAR}, v AS (SELECT id_a, id_b, 100 * list_max([abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) FOR i IN range(1, 65)]) AS most, 100 * list_sum([abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) FOR i IN range(1, 65)]) / 64 AS mean FROM n JOIN embeddings a ON a.vec_id = id_a JOIN embeddings b ON b.vec_id = id_b)"
_C = "WITH x AS (SELECT vec_id, label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS e FROM embeddings)"
_D = "x2 AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS e, label FROM embeddings)"
ORACLE_SQL = {
    "greedy_dedup": f"""{_S.replace('WITH', 'WITH RECURSIVE')}, o AS (SELECT vec_id, sig, row_number() OVER (ORDER BY vec_id) AS r FROM s),
g AS (SELECT 0::BIGINT AS r, []::BIT[] AS held, NULL::BIGINT AS vec_id, NULL::BOOLEAN AS kept
  UNION ALL SELECT r, CASE WHEN ok THEN list_append(held, sig) ELSE held END, vec_id, ok FROM (SELECT o.*, g.held, len(list_filter(g.held, lambda x: bit_count(xor(x, o.sig)) <= 14)) = 0 AS ok FROM g JOIN o ON o.r = g.r + 1))
SELECT vec_id, kept FROM g WHERE r > 0""",
    "neardup_pairs": f"{_NEAR} SELECT * FROM n",
    "neardup_cross": f"{_CROSS} SELECT * FROM n",
    "neardup_apart": f"{_S} SELECT a.vec_id AS id_a, b.vec_id AS id_b, CAST(bit_count(xor(a.sig, b.sig)) AS INT) AS distance FROM s a JOIN s b ON a.vec_id < b.vec_id AND a.vec_id % 3 <> b.vec_id % 3 WHERE bit_count(xor(a.sig, b.sig)) <= {LIMIT}",
    "neardup_hist": f"{_CROSS}, e AS (SELECT unnest(range(4))::INT AS bin, unnest([0.0, 10.0, 14.0, 16.0])::DOUBLE AS low, unnest([10.0, 14.0, 16.0, 19.0])::DOUBLE AS high) SELECT bin, low, high, count(n.id_a) AS n FROM e LEFT JOIN n ON distance >= low AND distance < high GROUP BY ALL",
    "neardup_flagged": f"{_CROSS} SELECT label, count(*) AS n, count(*) FILTER (WHERE vec_id IN (SELECT id_a FROM n)) AS flagged FROM s WHERE vec_id % 2 = 0 GROUP BY label",
    "best_twin": f"{_V}, r AS (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY most, mean, id_b) AS r FROM v) SELECT id_a, id_b, round(most, 6) AS most, round(mean, 6) AS mean, CASE WHEN most = 0 THEN 'identical' WHEN mean <= 10 THEN 'near' ELSE 'other' END AS band FROM r WHERE r = 1",
    "mae_verdicts": f"{_V} SELECT id_a, id_b, round(mean, 6) AS mae, CASE WHEN mean <= 5 THEN 'same' WHEN mean <= 8 THEN 'similar' ELSE 'different' END AS verdict FROM v",
    "centroids": f"{_C} SELECT label, CAST(pos AS INT) AS pos, round(avg(e), 6) AS mean FROM x GROUP BY ALL",
    "nearest_centroid": f"{_C}, c AS (SELECT label, pos, avg(e) AS m FROM x GROUP BY ALL), q AS (SELECT vec_id, x.label, c.label AS nearest, sum((e - m) * (e - m)) AS d FROM x JOIN c USING (pos) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, nearest) AS r FROM q) SELECT vec_id, label, nearest, round(sqrt(d), 6) AS distance FROM r WHERE r = 1",
    "label_audit_verdict": f"""WITH {_D}, c AS (SELECT label, pos, avg(e) AS m FROM x2 WHERE vec_id % 2 = 0 GROUP BY ALL), q AS (SELECT vec_id, x2.label, sum((e - r.m) * (e - r.m)) < sum((e - k.m) * (e - k.m)) AS closer FROM x2 JOIN c r ON r.pos = x2.pos AND r.label = 0 JOIN c k ON k.pos = x2.pos AND k.label = 1 WHERE (vec_id % 2 = 1 AND x2.label < 2) OR x2.label = 2 GROUP BY ALL),
z AS (SELECT round(avg(closer::INT) FILTER (WHERE label = 0), 6) AS ref_rate, round(avg(closer::INT) FILTER (WHERE label = 1), 6) AS control_rate, round(avg(closer::INT) FILTER (WHERE label = 2), 6) AS suspect_rate FROM q)
SELECT *, CASE WHEN NOT (ref_rate >= 0.75 AND control_rate <= 0.25) THEN 'unusable' WHEN suspect_rate >= 0.6 THEN 'reference' WHEN suspect_rate <= 0.4 THEN 'control' ELSE 'mixed' END AS verdict FROM z""",
    "vector_topk": f"{_C}, r AS (SELECT vec_id, pos, e, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, pos) - 1 AS r FROM x) SELECT vec_id, CAST(r AS INT) AS rank, CAST(pos AS INT) AS idx, round(e, 6) AS p FROM r WHERE r < 3",
    "score_ties": f"{_C}, y AS (SELECT vec_id, pos, round(e * 5, 0) AS t FROM x), z AS (SELECT *, max(t) OVER (PARTITION BY vec_id) AS top FROM y) SELECT vec_id, min(pos) AS first, count(*) AS ties FROM z WHERE t = top GROUP BY vec_id",
    "parity_delta": f"{_C}, y AS (SELECT vec_id, pos, e, CASE WHEN vec_id % 50 = 0 AND pos = 0 THEN e + 1.0 ELSE e + 0.0005 END AS g FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, pos) AS re, row_number() OVER (PARTITION BY vec_id ORDER BY g DESC, pos) AS rg FROM y) SELECT vec_id, min(CASE WHEN re = 1 THEN pos END) = min(CASE WHEN rg = 1 THEN pos END) AS agree, round(max(abs(e - g)), 6) AS max_delta FROM z GROUP BY vec_id",
    "parity_verdict": f"{_C}, y AS (SELECT vec_id, pos, e, CASE WHEN vec_id % 50 = 0 AND pos = 0 THEN e + 1.0 ELSE e + 0.0005 END AS g FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, pos) AS re, row_number() OVER (PARTITION BY vec_id ORDER BY g DESC, pos) AS rg FROM y), w AS (SELECT min(CASE WHEN re = 1 THEN pos END) = min(CASE WHEN rg = 1 THEN pos END) AS agree, max(abs(e - g)) AS dl FROM z GROUP BY vec_id) SELECT count(*) AS n, round(avg(agree::INT), 6) AS agreement, round(max(dl), 6) AS max_delta, avg(agree::INT) >= 1 AND max(dl) <= 0.001 AS ok FROM w",
    "softmax_scores": f"{_C}, y AS (SELECT vec_id, pos, e, min(e) OVER w AS lo, max(e) OVER w AS hi, sum(e) OVER w AS t FROM x WINDOW w AS (PARTITION BY vec_id)) SELECT vec_id, CAST(pos AS INT) AS idx, round(CASE WHEN lo >= 0 AND t BETWEEN 0.9 AND 1.1 THEN e ELSE exp(e - hi) / sum(exp(e - hi)) OVER (PARTITION BY vec_id) END, 6) AS p FROM y",
    "quantised": f"{_C}, y AS (SELECT vec_id, greatest(-128, least(127, CAST(round_even(e / 0.004::DOUBLE, 0) AS INT) + 3)) AS q FROM x) SELECT vec_id, CAST(sum(q) AS BIGINT) AS total, min(q) AS low, max(q) AS high FROM y GROUP BY vec_id",
}
