"""Queries of rules, lookups, labels and contract checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import labels as lb
from auditloom.functions import rules
from auditloom.operators import contract, lookup, metrics
from auditloom.operators.splits import dense_index
from auditloom.plans.fixtures import SQL_PRED, class_names, files, predictions, table
from auditloom.sources.files import forecast_summary


def severity_bands(spark, d):
    p = predictions(spark, d).withColumn("s", rules.severity(F.when(F.col("truth") == "view", "x___healthy").otherwise(F.col("truth")), F.col("conf")))
    return p.groupBy("s.stage", "s.percent").agg(F.count("*").alias("n"))


def weather_risk(spark, d):
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), (F.col("event_id") % 4).alias("rain"))
    disease = F.when(F.col("event_type") == "click", "Early_blight").when(F.col("event_type") == "view", "leaf mold").otherwise(F.col("event_type"))
    return e.groupBy("event_type", rules.weather_risk(disease, F.when(F.col("k") < 97, F.col("k")), F.col("rain")).alias("risk")).agg(F.count("*").alias("n"))


def forecast_by_user(spark, d):
    """Events of a user as forecast slots: means with missing values as 0, and rainy slots."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("city"), F.when(F.col("event_id") % 7 > 0, F.get_json_object("props", "$.k").cast("double")).alias("humidity"), F.floor("value").cast("double").alias("temp"), F.when(F.col("event_type") == "view", "Rain").otherwise("Clear").alias("weather"))
    return forecast_summary(e)


def history_recent(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", "ts", "event_type")


def json_props(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"), F.count_distinct(F.get_json_object("props", "$.k")).alias("kinds"))


def text_steps(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.explode(rules.steps(F.col("text"))).alias("s")).select("conv_id", "turn", "s.n", F.length("s.step").alias("chars"))


def label_normalise(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.initcap("p_name"), F.lit("___"), "p_brand").alias("name"))
    return p.select("p_partkey", lb.normalised(F.col("name")).alias("norm"), lb.split_class(F.col("name"))["crop"].alias("crop"), lb.split_class(F.col("name"))["rest"].alias("rest"), lb.snake(F.col("name")).alias("snake"))


def family_key(spark, d):
    ends = F.concat(F.when(F.col("doc_id") % 3 == 0, "_90deg").when(F.col("doc_id") % 3 == 1, "_flip").otherwise(""), F.when(F.col("doc_id") % 5 == 0, "__1").otherwise(""))
    h = F.md5(F.col("doc_id").cast("string"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    named = F.concat("label", F.lit("___Leaf "), F.col("doc_id") % 50, ends)
    bare = F.concat(F.lit("Scan "), F.col("doc_id") % 50, ends)
    known = F.concat(F.lit("IMG "), uuid, F.lit("___"), "label", ends)
    name = F.concat(F.when(F.col("doc_id") % 4 == 0, named).when(F.col("doc_id") % 4 == 1, known).otherwise(bare), F.lit(".JPG"))
    f = files(spark, d).select("doc_id", name.alias("file"))
    return f.select("doc_id", lb.family_of_photo(F.col("file")).alias("f1"), lb.family_of_file(F.col("file")).alias("f2"), lb.family_of_leaf(F.col("file")).alias("f3"), lb.label_from_file(F.col("file")).alias("label"))


def routing(spark, d):
    p = predictions(spark, d).withColumn("triage", F.when(F.col("id") % 13 == 0, None).when(F.col("truth") == "error", "pest_damage").otherwise(F.col("truth")))
    return p.groupBy(rules.route(F.col("triage"), F.col("conf"), (F.col("id") % 7) / F.lit(6.0), 0.5).alias("route")).agg(F.count("*").alias("n"))


def gate_messages(spark, d):
    return predictions(spark, d).select("id", rules.low_confidence_message(F.col("conf")).alias("message"), rules.badge(F.col("conf") * 100).alias("badge"), rules.percent(F.col("conf")).alias("percent"))


def lookup_fallback(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key0"), F.col("o_custkey").alias("key"))
    first = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).otherwise(-F.col("c_custkey")).alias("key"), F.col("c_mktsegment").alias("value"))
    second = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"))
    out = lookup.lookup_with_fallback(o, "key", [first, second], "value", F.concat(F.lit("key "), F.col("key").cast("string")))
    return out.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("value").alias("kinds"))


def coverage_counts(spark, d):
    key = F.when(F.col("c_nationkey") % 4 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey"))
    return lookup.coverage_counts(table(spark, d, "customer").select(key.alias("n_nationkey")), table(spark, d, "nation"), "n_nationkey")


def mapping_gaps(spark, d):
    return lookup.uncovered(table(spark, d, "events").select("event_type"), table(spark, d, "events").filter("event_type < 'p'").select("event_type").distinct(), "event_type")


def index_labels(spark, d):
    names = metrics.class_table(spark, class_names(spark, d))
    return lookup.label_of_index(table(spark, d, "events").select((F.col("event_id") % 8).cast("int").alias("i")), "i", names).groupBy("name").agg(F.count("*").alias("n"))


def resolve_labels(spark, d):
    """Part names, spelt three ways, against the classes first word___second word."""
    p = table(spark, d, "part")
    classes = dense_index(p.select(F.regexp_replace("p_name", " ", "___").alias("name")), "name")
    said = F.when(F.col("p_partkey") % 3 == 0, F.upper(F.regexp_replace("p_name", " ", "-"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("s"))).otherwise(F.concat(F.lit("zz_"), "p_name"))
    return lookup.resolve_labels(p.select(said.alias("label")), classes, aliases={"zz_small ring": "small___ring", "zz_red bolt": "no___class"})


def contract_report(spark, d):
    names = class_names(spark, d)
    classes = metrics.class_table(spark, [*names, "view", " zoom"])
    e = table(spark, d, "events").select(F.col("event_type").alias("label"), F.when(F.col("event_id") % 5 == 0, "val").otherwise("train").alias("split"))
    checks = contract.class_list_checks(classes, len(names)) + contract.folder_checks(classes, e, "label", "split", ["train", "val"])
    return contract.report(checks)


def low_data(spark, d):
    f = files(spark, d)
    return f.groupBy("label").agg(F.count("*").alias("n")).withColumn("low", F.col("n") < 45)


def scope_totals(spark, d):
    f = files(spark, d).filter(F.col("label").contains("src1"))
    return f.groupBy("label").agg(F.count("*").alias("total"), F.count_if(F.col("split") == "train").cast("long").alias("train"), F.count_if(F.col("split") == "val").cast("long").alias("val")).orderBy(F.desc("total"), "label")


def smallest_largest(spark, d):
    c = files(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    return c.agg(F.min_by("label", F.struct("n", "label")).alias("smallest"), F.min("n").alias("n_min"), F.max_by("label", F.struct("n", "label")).alias("largest"), F.max("n").alias("n_max"))


QUERIES = {f.__name__: f for f in (severity_bands, weather_risk, forecast_by_user, history_recent, json_props, text_steps, label_normalise, family_key, routing, gate_messages, lookup_fallback, coverage_counts, mapping_gaps, index_labels, resolve_labels, contract_report, low_data, scope_totals, smallest_largest)}

_P = f"WITH {SQL_PRED}"
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
ORACLE_SQL = {
    "resolve_labels": """WITH x AS (SELECT DISTINCT p_partkey % 3 AS k, p_name AS n FROM part), a AS (SELECT DISTINCT p_name AS n FROM part)
SELECT CASE k WHEN 0 THEN upper(replace(n, ' ', '-')) WHEN 1 THEN replace(n, ' ', '_') || 's' ELSE 'zz_' || n END AS label, CASE WHEN k < 2 OR (n = 'small ring' AND n IN (FROM a)) THEN replace(n, ' ', '___') END AS name,
  CASE WHEN k = 0 THEN 'exact' WHEN k = 1 THEN format('fuzzy({:.2f})', 2.0 * length(string_split(n, ' ')[2]) / (2 * length(string_split(n, ' ')[2]) + 1)) WHEN n = 'small ring' THEN 'alias' ELSE 'unmatched' END AS how FROM x""",
    "severity_bands": f"""{_P}, z AS (SELECT CASE WHEN "truth" = 'view' THEN 0 WHEN conf < 0.6 THEN 1 WHEN conf <= 0.85 THEN 2 ELSE 3 END AS stage FROM p) SELECT stage, [0, 15, 40, 75][stage + 1] AS percent, count(*) AS n FROM z GROUP BY ALL""",
    "weather_risk": f"""WITH e AS (SELECT event_type, CASE WHEN {_K} < 97 THEN {_K} END AS h, event_id % 4 AS rain, event_type IN ('click', 'view') AS fungal FROM events)
SELECT event_type, CASE WHEN h IS NULL THEN 'UNKNOWN' WHEN fungal AND h > 75 AND rain >= 2 THEN 'HIGH' WHEN NOT fungal AND h > 80 THEN 'HIGH' WHEN h > 60 THEN 'MODERATE' ELSE 'LOW' END AS risk, count(*) AS n FROM e GROUP BY ALL""",
    "forecast_by_user": f"SELECT CAST(user_id AS VARCHAR) AS city, round(avg(CASE WHEN event_id % 7 > 0 THEN {_K} ELSE 0 END), 1) AS humidity, round(avg(floor(value)), 1) AS temp, count(*) FILTER (WHERE event_type = 'view') AS rain_slots FROM events GROUP BY 1",
    "history_recent": "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC",
    "json_props": f"SELECT event_type, CAST(sum({_K}) AS BIGINT) AS total, count(DISTINCT {_K}) AS kinds FROM events GROUP BY 1",
    "text_steps": r"""WITH p AS (SELECT conv_id, turn, string_split(regexp_replace(regexp_replace(text, '\.', chr(46) || chr(10), 'g'), '\n+', chr(10), 'g'), chr(10)) AS parts FROM conversations),
q AS (SELECT conv_id, turn, list_filter(list_transform(parts, lambda x: trim(regexp_replace(trim(x), '^-+\s*', ''))), lambda x: x <> '') AS s FROM p) SELECT conv_id, turn, CAST(unnest(range(1, len(s) + 1)) AS INT) AS n, CAST(unnest(list_transform(s, lambda x: length(x))) AS INT) AS chars FROM q""",
    "label_normalise": r"""WITH x AS (SELECT p_partkey, p_name AS a, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS n, p_brand AS b FROM part)
SELECT p_partkey, regexp_replace(lower(n || '___' || b), '[^a-z0-9]', '', 'g') AS norm, n AS crop, b AS rest, replace(lower(n), ' ', '_') || '_' || lower(b) AS snake FROM x""",
    "family_key": rf"""WITH x AS (SELECT doc_id, source AS l, CASE WHEN doc_id % 3 = 0 THEN '_90deg' WHEN doc_id % 3 = 1 THEN '_flip' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN '__1' ELSE '' END AS e, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
y AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN l || '___Leaf ' || (doc_id % 50) || e WHEN doc_id % 4 = 1 THEN 'IMG ' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '___' || l || e ELSE 'Scan ' || (doc_id % 50) || e END AS s FROM x),
z AS (SELECT doc_id, s, string_split_regex(regexp_replace(regexp_replace(s, '{lb.AUGMENTED}', ''), '__\d+$', ''), '_{{3,}}')[1] AS a, string_split_regex(s, '_{{3,}}')[1] AS b FROM y)
SELECT doc_id, lower(CASE WHEN regexp_extract(a, '{lb.UUID}', 1) <> '' THEN regexp_extract(a, '{lb.UUID}', 1) ELSE a END) AS f1, lower(CASE WHEN regexp_extract(b, '{lb.UUID}', 1) <> '' THEN regexp_extract(b, '{lb.UUID}', 1) ELSE b END) AS f2,
  string_split(s, '___')[1] AS f3, lower(regexp_replace(regexp_replace(s, '[_\-\s]*\d+$', ''), '^[_\- ]+|[_\- ]+$', '', 'g')) AS label FROM z""",
    "routing": f"""{_P}, z AS (SELECT CASE WHEN id % 13 = 0 THEN NULL WHEN "truth" = 'error' THEN 'pest_damage' ELSE "truth" END AS tr, conf, (id % 7) / 6.0::DOUBLE AS dc FROM p) SELECT CASE WHEN tr IS NULL THEN 'failure' WHEN conf < 0.5 THEN 'retake' WHEN tr = 'pest_damage' THEN 'questionnaire' WHEN dc >= 0.5 THEN 'result' ELSE 'retake' END AS route, count(*) AS n FROM z GROUP BY 1""",
    "gate_messages": f"{_P} SELECT id, CASE WHEN conf < 0.95 THEN format('Not sure enough ({{:.1f}}%); please take another picture.', conf * 100) END AS message, CASE WHEN conf * 100 >= 85 THEN 'high' WHEN conf * 100 >= 60 THEN 'medium' ELSE 'low' END AS badge, round(conf * 100, 1) AS percent FROM p",
    "lookup_fallback": """WITH j AS (SELECT o_custkey AS k, c_mktsegment AS a, s_name AS b FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 = 0 LEFT JOIN supplier ON s_suppkey = o_custkey),
z AS (SELECT CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 ELSE 0 END AS source, coalesce(a, b, 'key ' || k) AS v FROM j) SELECT source, count(*) AS n, count(DISTINCT v) AS kinds FROM z GROUP BY 1""",
    "coverage_counts": "SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON CASE WHEN c_nationkey % 4 = 0 THEN c_nationkey + 1 ELSE c_nationkey END = n_nationkey GROUP BY 1",
    "mapping_gaps": "SELECT DISTINCT event_type FROM events WHERE event_type >= 'p'",
    "index_labels": f"{_P} SELECT coalesce(c.name, 'class_' || (event_id % 8)) AS name, count(*) AS n FROM events LEFT JOIN c ON c.idx = event_id % 8 GROUP BY 1",
    "contract_report": f"""{_P}, k AS (SELECT idx, name FROM c UNION ALL SELECT max(idx) + 1, 'view' FROM c UNION ALL SELECT max(idx) + 2, ' zoom' FROM c),
v AS (SELECT 'no blank names' AS name, CAST(idx AS VARCHAR) AS x FROM k WHERE trim(name) = '' UNION ALL SELECT 'no padded names', name FROM k WHERE name <> trim(name) UNION ALL SELECT 'unique names', name FROM k GROUP BY name HAVING count(*) > 1
 UNION ALL SELECT 'sorted names', b.name FROM k a JOIN k b ON b.idx = a.idx + 1 WHERE a.name >= b.name
 UNION ALL SELECT DISTINCT s || ': no missing class', k.name FROM k, (VALUES ('train', false), ('val', true)) AS w(s, v) WHERE k.name NOT IN (SELECT event_type FROM events WHERE (event_id % 5 = 0) = w.v)),
n AS (SELECT unnest(['no blank names', 'no padded names', 'unique names', 'sorted names', 'train: no missing class', 'train: no unexpected class', 'val: no missing class', 'val: no unexpected class']) AS name),
r AS (SELECT n.name, count(x) AS m, min(x) AS first FROM n LEFT JOIN v ON v.name = n.name GROUP BY n.name)
SELECT name, m = 0 AS ok, CASE WHEN m = 0 THEN 'none' ELSE m || ' first: ' || first END AS detail FROM r UNION ALL SELECT 'class count', count(*) = (SELECT count(*) FROM c), CAST(count(*) AS VARCHAR) FROM k""",
    "low_data": "SELECT source AS label, count(*) AS n, count(*) < 45 AS low FROM documents GROUP BY 1",
    "scope_totals": "SELECT source AS label, count(*) AS total, count(*) FILTER (WHERE doc_id % 2 = 0) AS train, count(*) FILTER (WHERE doc_id % 2 = 1) AS val FROM documents WHERE contains(source, 'src1') GROUP BY 1 ORDER BY total DESC, label",
    "smallest_largest": "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT (SELECT source FROM c ORDER BY n, source LIMIT 1) AS smallest, min(n) AS n_min, (SELECT source FROM c ORDER BY n DESC, source DESC LIMIT 1) AS largest, max(n) AS n_max FROM c",
}
