"""Queries that split and sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import splits as s
from auditloom.plans.fixtures import SQL_FILES, files, table


def _events(spark, d):
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("label"), F.col("user_id").alias("family"), "value", "ts")


def split_by_family(spark, d):
    return s.split_families(_events(spark, d)).select("label", "family", "size", "side")


def split_promote(spark, d):
    return s.split_families(_events(spark, d), least_val=450)


def split_applied(spark, d):
    e = _events(spark, d)
    return s.apply_families(e, s.split_families(e)).groupBy("label", "side").agg(F.count("*").alias("n"))


def split_rowwise(spark, d):
    return s.split_rows(_events(spark, d), ["label"], "event_id").groupBy("label", "side").agg(F.count("*").alias("n"), F.sum("event_id").cast("long").alias("ids"))


def split_compat(spark, d):
    return s.compat_split(_events(spark, d))


def sample_even(spark, d):
    return s.sample_even(_events(spark, d), ["label"], ["event_id"], 12).select("label", "event_id")


def sample_first_n(spark, d):
    return s.first_n(_events(spark, d), ["label"], ["event_id"], 3).select("label", "event_id")


def sample_seeded(spark, d):
    return s.sample_rows(_events(spark, d), 50, "event_id").select("event_id")


def sample_uniform_quota(spark, d):
    return s.sample_quota(_events(spark, d), "label", "event_id", 123).select("label", "event_id")


def trusted_halves(spark, d):
    return s.halves(_events(spark, d), ["label"], "event_id").select("label", "event_id", "half")


def dense_index(spark, d):
    return s.dense_index(_events(spark, d), "label")


def rename_collisions(spark, d):
    return s.rename_collisions(files(spark, d), ["label", "split"], "name", ["doc_id"]).select("path", "destination")


def best_epoch_running(spark, d):
    curve = table(spark, d, "events").select(F.col("event_id").alias("epoch"), "value")
    return s.running_best(curve, "epoch", "value", 10)


QUERIES = {f.__name__: f for f in (split_by_family, split_promote, split_applied, split_rowwise, split_compat, sample_even, sample_first_n, sample_seeded, sample_uniform_quota, trusted_halves, dense_index, rename_collisions, best_epoch_running)}

_E = "WITH e AS (SELECT event_id, event_type AS label, user_id AS family, value, ts FROM events)"
_CUT = "CASE WHEN {n} > 1 THEN greatest(1, least(CAST(floor({n} * {s}::DOUBLE) AS BIGINT), {n} - 1)) ELSE {n} END"
_FAM = """, z AS (SELECT label, family, count(*) AS size FROM {src} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || family), family) AS r, count(*) OVER (PARTITION BY label) AS k FROM z),
y AS (SELECT *, r <= """ + _CUT.format(n="k", s="0.8") + """ AS tr FROM r)"""
ORACLE_SQL = {
    "split_by_family": f"{_E}{_FAM.format(src='e')} SELECT label, family, size, CASE WHEN tr THEN 'train' ELSE 'val' END AS side FROM y",
    "split_promote": f"""{_E}{_FAM.format(src='e')},
u AS (SELECT *, sum(CASE WHEN tr THEN 0 ELSE size END) OVER (PARTITION BY label) AS val, coalesce(sum(CASE WHEN tr THEN size END) OVER (PARTITION BY label ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved FROM y),
v AS (SELECT *, tr AND val + moved < 450 AND r > 1 AS promoted FROM u) SELECT label, family, size, promoted, CASE WHEN tr AND NOT promoted THEN 'train' ELSE 'val' END AS side FROM v""",
    "split_applied": f"{_E}{_FAM.format(src='e')} SELECT e.label, CASE WHEN tr THEN 'train' ELSE 'val' END AS side, count(*) AS n FROM e JOIN y ON e.label = y.label AND e.family = y.family GROUP BY ALL",
    "split_rowwise": f"{_E}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || event_id), event_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM e) SELECT label, CASE WHEN r <= {_CUT.format(n='n', s='0.8')} THEN 'train' ELSE 'val' END AS side, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM r GROUP BY ALL",
    "sample_even": f"{_E}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM e) SELECT label, event_id FROM r WHERE r % greatest(n // 12, 1) = 0 AND r // greatest(n // 12, 1) < 12",
    "sample_first_n": f"{_E} SELECT label, event_id FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY event_id) <= 3",
    "sample_seeded": f"{_E} SELECT event_id FROM e ORDER BY md5('42:' || event_id), event_id LIMIT 50",
    "sample_uniform_quota": f"{_E}, q AS (SELECT label, 123 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY label) <= 123 % count(*) OVER () THEN 1 ELSE 0 END AS quota FROM (SELECT DISTINCT label FROM e)), r AS (SELECT label, event_id, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || event_id), event_id) AS r FROM e) SELECT label, event_id FROM r JOIN q USING (label) WHERE r <= quota",
    "trusted_halves": f"{_E} SELECT label, event_id, CAST(ntile(2) OVER (PARTITION BY label ORDER BY md5('42:' || event_id)) AS INT) AS half FROM e",
    "dense_index": f"{_E} SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS idx FROM (SELECT DISTINCT label FROM e)",
    "rename_collisions": f"WITH {SQL_FILES}, n AS (SELECT *, row_number() OVER (PARTITION BY label, split, name ORDER BY doc_id) - 1 AS nth FROM f) SELECT path, CASE WHEN nth = 0 THEN name ELSE replace(name, '.txt', '') || '__dup' || nth || '.txt' END AS destination FROM n",
    "best_epoch_running": """WITH c AS (SELECT event_id AS epoch, value FROM events),
b AS (SELECT *, max(value) OVER (ORDER BY epoch) AS best, value > coalesce(max(value) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) AS fresh FROM c),
a AS (SELECT *, max(CASE WHEN fresh THEN epoch END) OVER (ORDER BY epoch) AS best_at FROM b) SELECT epoch, value, best, best_at, epoch - best_at AS since, epoch - best_at >= 10 AS "stop" FROM a""",
}
