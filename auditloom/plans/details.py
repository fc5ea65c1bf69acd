"""Queries on messages, labels of photos, quantised scores, shared files and advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import labels as lb
from auditloom.functions import rules
from auditloom.operators import contract, integrity, metrics as m, vectors as v
from auditloom.plans.fixtures import SQL_FILES, SQL_PRED, files, predictions, table


def risk_reports(spark, d):
    """What app and service say of the weather of every event: risk, growth, urgency and messages."""
    p = predictions(spark, d)
    humidity, disease = (F.col("id") % 101).cast("double"), F.when(F.col("id") % 2 == 0, "Late_Blight").otherwise(F.concat(F.col("truth"), F.lit("_spot")))
    app = rules.app_risk_report(humidity, disease, F.when(F.col("id") % 6 > 0, F.col("id") % 130 - 10), F.col("id") % 5 == 0)
    out = p.select("id", app.alias("a"), rules.weather_message(disease, F.when(F.col("id") % 9 > 0, humidity), F.col("id") % 4).alias("service"), rules.retake_message(F.col("conf")).alias("retake"))
    return out.select("id", "a.risk", "a.low", "a.high", "a.urgency", "a.message", "service", "retake")


def photo_labels(spark, d):
    """The label in a photo's name, by both rules."""
    name = F.concat("source", F.when(F.col("doc_id") % 3 == 0, "_Leaf Spot_").when(F.col("doc_id") % 3 == 1, "-Rust ").otherwise("_"), F.when(F.col("doc_id") % 4 > 0, F.col("doc_id").cast("string")).otherwise(""), F.lit(".JPG"))
    return table(spark, d, "documents").select("doc_id", lb.label_of_photo(name).alias("kept"), lb.label_from_file(name).alias("lowered"))


def quantised_both(spark, d):
    """Values quantised with halves to even and clipped, and with halves upwards and not clipped: sums and differences by vector."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 2)).alias("x"))
    q = e.select("vec_id", v.quantise(F.col("x"), 0.002, 3).alias("a"), v.quantise_half_up(F.col("x"), 0.002, 3).alias("b"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return q.select("vec_id", total("a").alias("clipped"), total("b").alias("whole"), F.size(F.filter(F.zip_with("a", "b", lambda x, y: x != y), lambda x: x)).alias("differ"))


def shared_files(spark, d):
    """The files of digests that are in train and val."""
    return integrity.shared_files(files(spark, d)).select("digest", "split", "path")


def mispair_margins(spark, d):
    """The most frequent wrong pairs with mean confidence and mean margin to the second answer."""
    p = predictions(spark, d).withColumn("margin", F.col("conf") - F.col("conf") * (F.col("id") % 7) / 7)
    return m.mispairs(p, 6, margin="margin")


def advice_contract(spark, d):
    """Nations as classes: the regions they cover, and whether each has advice."""
    n = table(spark, d, "nation")
    classes = n.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("___", "r_name", "n_name").alias("name"))
    k = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    advice = classes.filter(k % 8 > 0).select(F.col("name").alias("key"), F.when(k % 6 > 0, F.concat(F.lit("spray "), "name")).otherwise(" ").alias("chemical"), F.lit("weed").alias("organic")).union(spark.createDataFrame([("extra", "x", "")], "key string, chemical string, organic string"))
    return contract.report([contract.crop_check(classes, lb.split_class(F.col("name"))["crop"], 5), *contract.advice_checks(classes, advice, "key", ["chemical", "organic"])])


QUERIES = {f.__name__: f for f in (risk_reports, photo_labels, quantised_both, shared_files, mispair_margins, advice_contract)}

_F, _P = f"WITH {SQL_FILES}", f"WITH {SQL_PRED}"


def _text(template: str, *values: str) -> str:
    """A template of format_string as a concatenation in SQL; its parts in brackets stay as they are."""
    parts = template.replace("%%", "\0").replace("%d", "%s").split("%s")
    out = [f"'{part.replace(chr(0), '%').replace(chr(39), chr(39) * 2)}'" for part in parts]
    return " || ".join(x for pair in zip(out, [*values, ""]) for x in pair if x)


def _cases(column: str, of) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{r}' THEN {of(r)}" for r in rules.APP_GROWTH) + " END"


_SERVICE = " ".join(f"WHEN fungal = {str(f).lower()} AND wr = '{r}' THEN {_text(t, *(['rain', 'shown'] if t.count('%') == 2 else ['shown']))}" for (f, r), t in rules.SERVICE_TEXT.items())
ORACLE_SQL = {
    "risk_reports": f"""{_P}, x AS (SELECT id, conf, (id % 101)::DOUBLE AS hum, CASE WHEN id % 2 = 0 THEN 'Late_Blight' ELSE "truth" || '_spot' END AS disease, id % 2 = 0 AS fungal, CASE WHEN id % 6 > 0 THEN greatest(0, least(100, id % 130 - 10)) ELSE 0 END::INT AS area, id % 4 AS rain FROM p),
y AS (SELECT *, replace(disease, '_', ' ') AS shown, CASE WHEN hum > 80 THEN 'HIGH' WHEN hum > 60 THEN 'MODERATE' ELSE 'LOW' END AS risk, CASE WHEN id % 9 = 0 THEN NULL WHEN fungal THEN CASE WHEN hum > 75 AND rain >= 2 THEN 'HIGH' WHEN hum > 60 THEN 'MODERATE' ELSE 'LOW' END WHEN hum > 80 THEN 'HIGH' WHEN hum > 60 THEN 'MODERATE' ELSE 'LOW' END AS wr FROM x)
SELECT id, risk, {_cases("risk", lambda r: rules.APP_GROWTH[r][0])}::INT AS low, {_cases("risk", lambda r: rules.APP_GROWTH[r][1])}::INT AS high, {_cases("risk", lambda r: f"'{rules.APP_URGENCY[r]}'")} AS urgency,
  CASE WHEN id % 5 = 0 THEN '{rules.APP_NO_DISEASE}' ELSE {_cases("risk", lambda r: _text(rules.APP_RISK_TEXT, "disease", f"'{rules.APP_RISK_NAME[r]}'", str(rules.APP_GROWTH[r][0]), str(rules.APP_GROWTH[r][1]), "area"))} END AS message,
  CASE {_SERVICE} END AS service, CASE WHEN conf < 0.95 THEN {_text(rules.WEAK_TEXT, "format('{:.1f}', round(conf * 100, 1))")} END AS retake FROM y""",
    "photo_labels": r"""WITH x AS (SELECT doc_id, source || CASE doc_id % 3 WHEN 0 THEN '_Leaf Spot_' WHEN 1 THEN '-Rust ' ELSE '_' END || CASE WHEN doc_id % 4 > 0 THEN doc_id::VARCHAR ELSE '' END AS s FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(s, '^.+_\d+$') THEN regexp_replace(s, '_\d+$', '') ELSE s END AS kept, lower(regexp_replace(regexp_replace(s, '[_\-\s]*\d+$', ''), '^[_\- ]+|[_\- ]+$', '', 'g')) AS lowered FROM x""",
    "quantised_both": """WITH x AS (SELECT vec_id, round(unnest(embedding)::DOUBLE, 2) AS e FROM embeddings), q AS (SELECT vec_id, greatest(-128, least(127, CAST(round_even(e / 0.002::DOUBLE, 0) AS INT) + 3)) AS a, floor(e / 0.002::DOUBLE + 3 + 0.5)::INT AS b FROM x)
SELECT vec_id, sum(a)::BIGINT AS clipped, sum(b)::BIGINT AS whole, count(*) FILTER (WHERE a <> b)::INT AS differ FROM q GROUP BY 1""",
    "shared_files": f"{_F} SELECT digest, split, path FROM f WHERE digest IN (SELECT digest FROM f WHERE split = 'train') AND digest IN (SELECT digest FROM f WHERE split = 'val')",
    "mispair_margins": f"""{_P} SELECT "truth", pred, count(*) AS n, round(avg(conf), 6) AS mean_conf, round(avg(conf - conf * (id % 7) / 7), 6) AS mean_margin FROM p WHERE "truth" <> pred GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 6""",
    "advice_contract": """WITH c AS (SELECT r_name, n_nationkey AS k, r_name || '___' || n_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey), a AS (SELECT * FROM c WHERE k % 8 > 0), g AS (SELECT list_sort(list(DISTINCT r_name)) AS l FROM c)
SELECT 'crop coverage' AS name, len(l) = 5 AS ok, len(l) || ': ' || array_to_string(l, ', ') AS detail FROM g UNION ALL SELECT 'every class has advice', count(*) = 0, CASE WHEN count(*) = 0 THEN 'none' ELSE count(*) || ' first: ' || min(name) END FROM c WHERE k % 8 = 0
UNION ALL SELECT 'entries beyond the classes', true, '1' UNION ALL SELECT 'chemical not blank', count(*) = 0, CASE WHEN count(*) = 0 THEN 'none' ELSE count(*) || ' first: ' || min(name) END FROM a WHERE k % 6 = 0 UNION ALL SELECT 'organic not blank', true, 'none'""",
}
