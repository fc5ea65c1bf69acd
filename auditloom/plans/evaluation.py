"""Queries that judge predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import metrics as m
from auditloom.plans.fixtures import SQL_GROUP, SQL_PRED, THRESHOLDS, class_names, group_of, predictions

_T = ", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS)
_SWEEP = """SELECT {by} threshold, count(*) FILTER (WHERE conf >= threshold) AS shown, count(*) AS total,
  count(*) FILTER (WHERE conf >= threshold)::DOUBLE / count(*) AS coverage,
  count(*) FILTER (WHERE conf >= threshold AND "truth" = pred) AS correct, count(*) FILTER (WHERE conf >= threshold AND "truth" <> pred) AS wrong,
  count(*) FILTER (WHERE conf >= threshold AND "truth" = pred)::DOUBLE / nullif(count(*) FILTER (WHERE conf >= threshold), 0) AS precision,
  count(*) FILTER (WHERE conf >= threshold AND "truth" = pred)::DOUBLE / count(*) AS recall
FROM p, (VALUES """ + _T + """) AS v(threshold) GROUP BY ALL"""
_SCORES = """
sc AS (SELECT c.name, count(*) FILTER (WHERE p."truth" = c.name) AS support, count(*) FILTER (WHERE p.pred = c.name) AS predicted,
         count(*) FILTER (WHERE p."truth" = c.name AND p.pred = c.name) AS hit FROM c, p GROUP BY c.name),
sd AS (SELECT *, hit::DOUBLE / nullif(predicted, 0) AS precision, hit::DOUBLE / nullif(support, 0) AS recall FROM sc),
se AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM sd)"""


def gate_sweep(spark, d):
    return m.gate_sweep(predictions(spark, d), THRESHOLDS)


def gate_sweep_by_class(spark, d):
    return m.gate_sweep(predictions(spark, d), THRESHOLDS, by=["truth"])


def gate_by_group(spark, d):
    rows = predictions(spark, d).withColumn("group", group_of(F.col("truth")))
    return m.gate_sweep(rows, THRESHOLDS, by=["group"]).select("group", "threshold", F.col("total").alias("n"), "shown", "precision")


def gate_pick(spark, d):
    right = F.when((F.col("id") % 10 >= 7) & (F.col("conf") >= 0.6), F.col("truth")).otherwise(F.col("pred"))
    rows = predictions(spark, d).withColumn("pred", right)
    return m.pick_gate(m.gate_sweep(rows, THRESHOLDS)).select("threshold", "shown", "correct")


def accuracy_summary(spark, d):
    ranked = predictions(spark, d).withColumn("ranked", F.array("pred", F.when(F.col("id") % 10 == 7, F.col("truth")).otherwise(F.col("pred"))))
    return m.accuracy(ranked, top="ranked")


def _scores(spark, d):
    return m.class_scores(predictions(spark, d), m.class_table(spark, class_names(spark, d)))


def class_prf(spark, d):
    return _scores(spark, d)


def _moved(label, of, where=None, to="click"):
    """The label, but another where it is `of` and the condition holds."""
    return F.when((label == of) & (F.lit(True) if where is None else where), to).otherwise(label)


def class_prf_zero(spark, d):
    p = predictions(spark, d)  # no row is `view`, none is called `error`
    rows = p.withColumn("truth", _moved(F.col("truth"), "view")).withColumn("pred", _moved(F.col("pred"), "error"))
    return m.class_scores(rows, m.class_table(spark, class_names(spark, d)), zero_division=0.0)


def macro_weighted(spark, d):
    out = m.averages(_scores(spark, d))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def confusion_long(spark, d):
    return m.confusion(predictions(spark, d))


def confusion_wide(spark, d):
    return m.confusion_wide(predictions(spark, d), class_names(spark, d))


def mispairs_topk(spark, d):
    return m.mispairs(predictions(spark, d), 7)


def confident_mistakes(spark, d):
    return predictions(spark, d).filter("truth <> pred and conf >= 0.5").orderBy(F.desc("conf"), "id").limit(25).select("id", "truth", "pred", "conf")


def group_rollup(spark, d):
    return m.group_rollup(predictions(spark, d), group_of)


def healthy_summary(spark, d):
    return m.healthy_summary(predictions(spark, d), lambda c: c == "view")


def family_accuracy(spark, d):
    return m.family_accuracy(predictions(spark, d))


def prior_ratio(spark, d):
    rows = predictions(spark, d)
    return m.prior_ratio(rows.withColumn("truth", _moved(F.col("truth"), "view", F.col("id") % 3 > 0)), m.class_table(spark, class_names(spark, d)))


def worst_classes(spark, d):
    rows = predictions(spark, d)
    return m.worst_classes(rows.withColumn("truth", _moved(F.col("truth"), "click", F.col("id") % 2 == 0, "view")), 3)


def class_balance(spark, d):
    rows = predictions(spark, d)
    return m.class_balance(rows.withColumn("truth", _moved(F.col("truth"), "view", F.col("id") % 4 > 0)), m.class_table(spark, [*class_names(spark, d), "zoom"]), low=600)


def exclusion_rescore(spark, d):
    rules = {"none": F.lit(False), "low": F.col("conf") < 0.3, "first family": F.col("family") < 20, "sure": F.col("conf") > 0.9}
    out = m.exclusion_summary(predictions(spark, d), rules)
    return out.withColumn("accuracy", F.round("accuracy", 6)).withColumn("delta", F.round("delta", 6))


def two_runs(spark, d):
    a = predictions(spark, d)
    b = a.withColumn("pred", F.when(F.col("id") % 5 == 0, F.col("truth")).otherwise(F.col("pred"))).withColumn("conf", F.abs(F.col("conf") - 0.25))
    return m.compare_runs(a, b, "id").select("id", "pred_a", "pred_b", "agree", "delta")


def conf_histogram(spark, d):
    return m.histogram(predictions(spark, d), F.col("conf"), [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 2.0, 3.0])


def bootstrap_ci(spark, d):
    out = m.bootstrap_interval(predictions(spark, d))
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "low", "high")})


def worst_missed(spark, d):
    """Classes with a miss, with hits and rows."""
    return m.confusion(predictions(spark, d)).groupBy("truth").agg(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).cast("long").alias("hits"), F.sum("n").cast("long").alias("n")).filter("hits < n")


QUERIES = {f.__name__: f for f in (gate_sweep, gate_sweep_by_class, gate_by_group, gate_pick, accuracy_summary, class_prf, class_prf_zero, macro_weighted, confusion_long, confusion_wide, mispairs_topk, confident_mistakes, group_rollup, healthy_summary, family_accuracy, prior_ratio, worst_classes, class_balance, exclusion_rescore, two_runs, conf_histogram, bootstrap_ci, worst_missed)}

_P = f"WITH {SQL_PRED}"
_BITS = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"
ORACLE_SQL = {
    "bootstrap_ci": f"""{_P}, blocks AS (SELECT {_BITS.format("id::VARCHAR")} % 1000 AS block, count(*) AS n, count(*) FILTER (WHERE "truth" = pred) AS yes FROM p GROUP BY 1),
draws AS (SELECT r, n, yes, {_BITS.format("'42:' || r || ':' || block")} AS u FROM blocks, range(1000) z(r)), weighted AS (SELECT r, n, yes, {" + ".join(f"(u >= {x})::INT" for x in m.POISSON_STEPS)} AS times FROM draws),
shares AS (SELECT sum(times * yes)::DOUBLE / sum(times * n) AS a FROM weighted GROUP BY r)
SELECT (SELECT sum(n)::BIGINT FROM blocks) AS n, round((SELECT sum(yes)::DOUBLE / sum(n) FROM blocks), 9) AS accuracy, round(quantile_cont(a, 0.025), 9) AS low, round(quantile_cont(a, 0.975), 9) AS high FROM shares""",
    "gate_sweep": f"{_P} {_SWEEP.format(by='')}",
    "gate_sweep_by_class": f'{_P} {_SWEEP.format(by=chr(34) + "truth" + chr(34) + ",")}',
    "gate_by_group": f'{_P}, w AS ({_SWEEP.format(by=SQL_GROUP.format(chr(34) + "truth" + chr(34)) + " AS grp,")}) SELECT grp AS "group", threshold, total AS n, shown, precision FROM w',
    "gate_pick": f"{_P.replace(', p AS', ', p0 AS')} , w AS ({_SWEEP.format(by='').replace('FROM p,', 'FROM (SELECT id, family, "truth", CASE WHEN id % 10 >= 7 AND conf >= 0.6 THEN "truth" ELSE pred END AS pred, conf FROM p) p,')}) SELECT threshold, shown, correct FROM w WHERE precision >= 1.0 AND shown >= 4 ORDER BY threshold LIMIT 1",
    "accuracy_summary": f'{_P} SELECT count(*) AS n, count(*) FILTER (WHERE "truth" = pred) AS correct, count(*) FILTER (WHERE "truth" = pred OR id % 10 = 7) AS top_hits, count(*) FILTER (WHERE "truth" = pred)::DOUBLE / count(*) AS top1, count(*) FILTER (WHERE "truth" = pred OR id % 10 = 7)::DOUBLE / count(*) AS top_rate FROM p',
    "class_prf": f"{_P}, {_SCORES} SELECT * FROM se",
    "class_prf_zero": f"""{_P}, {_SCORES.replace('FROM c, p GROUP', "FROM c, (SELECT CASE WHEN " + '"truth"' + " = 'view' THEN 'click' ELSE " + '"truth"' + " END AS " + '"truth"' + ", CASE WHEN pred = 'error' THEN 'click' ELSE pred END AS pred FROM p) p GROUP")} SELECT name, support, predicted, hit, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall, coalesce(2 * coalesce(precision, 0) * coalesce(recall, 0) / nullif(coalesce(precision, 0) + coalesce(recall, 0), 0), 0) AS f1 FROM se""",
    "macro_weighted": f"{_P}, {_SCORES} SELECT " + ", ".join(f"round(avg(coalesce({c}, 0)), 6) AS macro_{c}, round(sum(coalesce({c}, 0) * support) / sum(support), 6) AS weighted_{c}" for c in ("precision", "recall", "f1")) + " FROM se WHERE support > 0",
    "confusion_long": f'{_P} SELECT "truth", pred, count(*) AS n FROM p GROUP BY ALL',
    "confusion_wide": f'{_P} SELECT c.name AS "truth", ' + ", ".join(f"count(*) FILTER (WHERE pred = '{n}') AS {n}" for n in ("click", "error", "purchase", "signup", "view")) + ' FROM c LEFT JOIN p ON p."truth" = c.name GROUP BY c.name',
    "mispairs_topk": f'{_P} SELECT "truth", pred, count(*) AS n, round(avg(conf), 6) AS mean_conf FROM p WHERE "truth" <> pred GROUP BY ALL ORDER BY n DESC, "truth", pred LIMIT 7',
    "confident_mistakes": f'{_P} SELECT id, "truth", pred, conf FROM p WHERE "truth" <> pred AND conf >= 0.5 ORDER BY conf DESC, id LIMIT 25',
    "group_rollup": f'{_P}, g AS (SELECT *, {SQL_GROUP.format(chr(34) + "truth" + chr(34))} AS a, {SQL_GROUP.format("pred")} AS b FROM p) SELECT a AS "group", count(*) AS n, count(*) FILTER (WHERE "truth" = pred) AS correct, count(*) FILTER (WHERE "truth" <> pred AND a = b) AS within, count(*) FILTER (WHERE a <> b) AS across FROM g GROUP BY a',
    "healthy_summary": f"""{_P}, h AS (SELECT "truth" = 'view' AS t, pred = 'view' AS q, "truth" = pred AS r FROM p) SELECT count(*) FILTER (WHERE t) AS healthy, count(*) FILTER (WHERE t AND q) AS healthy_kept, count(*) FILTER (WHERE t AND NOT q) AS false_alarm, count(*) FILTER (WHERE NOT t) AS diseased, count(*) FILTER (WHERE NOT t AND q) AS missed, count(*) FILTER (WHERE NOT t AND NOT q AND NOT r) AS misnamed FROM h""",
    "family_accuracy": f'{_P}, e AS (SELECT count(*) AS n, avg(("truth" = pred)::INT) AS acc FROM p GROUP BY "truth", family) SELECT count(*) AS families, count(*) FILTER (WHERE acc = 1) AS all_right, round(avg(acc), 6) AS mean_accuracy, round(avg(n), 6) AS mean_size FROM e',
    "prior_ratio": f"""{_P}, {_SCORES.replace('FROM c, p GROUP', "FROM c, (SELECT CASE WHEN " + '"truth"' + " = 'view' AND id % 3 > 0 THEN 'click' ELSE " + '"truth"' + " END AS " + '"truth"' + ", pred FROM p) p GROUP")} SELECT name, support, predicted, predicted::DOUBLE / nullif(support, 0) AS ratio, predicted::DOUBLE / sum(predicted) OVER () AS share, coalesce(predicted::DOUBLE / nullif(support, 0), 'inf'::DOUBLE) >= 1.25 AND predicted >= 3 AS over_predicted FROM se""",
    "worst_classes": f"""{_P}, q AS (SELECT CASE WHEN "truth" = 'click' AND id % 2 = 0 THEN 'view' ELSE "truth" END AS "truth", pred FROM p), a AS (SELECT "truth", count(*) AS support, count(*) FILTER (WHERE "truth" = pred) AS correct FROM q GROUP BY 1), w AS (SELECT "truth", pred, count(*) AS n, row_number() OVER (PARTITION BY "truth" ORDER BY count(*) DESC, pred) AS r FROM q WHERE "truth" <> pred GROUP BY 1, 2)
SELECT a."truth", support, correct, correct::DOUBLE / support AS accuracy, w.pred AS wrong_answer, w.n AS wrong_n FROM a LEFT JOIN w ON w."truth" = a."truth" AND r = 1 WHERE support >= 20 ORDER BY accuracy, a."truth" LIMIT 3""",
    "class_balance": f"""{_P}, k AS (SELECT name FROM c UNION ALL SELECT 'zoom'), n AS (SELECT k.name, count(q."truth") AS n FROM k LEFT JOIN (SELECT CASE WHEN "truth" = 'view' AND id % 4 > 0 THEN 'click' ELSE "truth" END AS "truth" FROM p) q ON q."truth" = k.name GROUP BY k.name), md AS (SELECT median(n) AS md FROM n WHERE n > 0) SELECT name, n, n / md AS ratio, n < 0.5 * md AS weak, n < 600 AS low FROM n, md""",
    "exclusion_rescore": f"""{_P}, x AS (SELECT "truth" = pred AS r, unnest(['none', 'low', 'first family', 'sure']) AS rule, unnest([false, conf < 0.3, family < 20, conf > 0.9]) AS flag FROM p), y AS (SELECT rule, count(*) AS n, count(*) FILTER (WHERE r) AS c, count(*) FILTER (WHERE flag) AS excluded, count(*) FILTER (WHERE flag AND r) AS correct_excluded FROM x GROUP BY rule)
SELECT rule, excluded, n - excluded AS "left", round((c - correct_excluded)::DOUBLE / nullif(n - excluded, 0), 6) AS accuracy, round(100 * ((c - correct_excluded)::DOUBLE / nullif(n - excluded, 0) - c::DOUBLE / n), 6) AS delta, correct_excluded FROM y""",
    "two_runs": f"""{_P}, a AS (SELECT * FROM p), b AS (SELECT id, CASE WHEN id % 5 = 0 THEN "truth" ELSE pred END AS pred, abs(conf - 0.25) AS conf FROM a)
SELECT a.id, a.pred AS pred_a, b.pred AS pred_b, a.pred = b.pred AS agree, round(abs(a.conf - b.conf), 6) AS delta FROM a JOIN b USING (id)""",
    "conf_histogram": f"""{_P}, e AS (SELECT unnest(range(7))::INT AS bin, unnest([0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 2.0])::DOUBLE AS low, unnest([0.05, 0.25, 0.5, 0.75, 0.95, 2.0, 3.0])::DOUBLE AS high) SELECT bin, low, high, count(p.id) AS n FROM e LEFT JOIN p ON conf >= low AND conf < high GROUP BY ALL""",
    "worst_missed": f'{_P} SELECT "truth", count(*) FILTER (WHERE "truth" = pred) AS hits, count(*) AS n FROM p GROUP BY 1 HAVING hits < n',
}
