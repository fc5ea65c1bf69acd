"""Queries on trees of files and on what is written once: listings, gated plans, stored results, histories."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from auditloom.operators import contract, integrity
from auditloom.operators.scratch import shared_folder
from auditloom.plans.fixtures import SQL_FILES, SQL_PRED, class_names, files, predictions, table
from auditloom.sources import files as src
from auditloom.sources import sinks
from auditloom.streaming import live


def _folder(spark, name):
    return f"{shared_folder(spark)}/auditloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _written_tree(spark, d):
    """A tree split/label of real files, some text and some named as images, below a new folder."""
    path, f = _folder(spark, "tree"), files(spark, d)
    f.groupBy("split", "label").agg(F.count("*").alias("n")).select(F.concat_ws(" ", "split", "label", "n").alias("t"), "split", "label").repartition(4, "split", "label").write.partitionBy("split", "label").text(path)
    return path


def listed_tree(spark, d):
    """Files of a written tree by class and split, from their metadata, without those of one class's scope."""
    held = src.list_images(spark, _written_tree(spark, d), endings=("txt",), scope="src1")
    name = lambda c: F.regexp_replace(c, "^(split|label)=", "")
    return held.select(name("label").alias("label"), name("split").alias("split")).groupBy("label", "split").agg(F.count("*").alias("files"))


def splits_missing(spark, d):
    """Splits of which a written tree has no file."""
    held = src.list_images(spark, _written_tree(spark, d), endings=("txt",)).withColumn("split", F.regexp_replace("split", "^split=", ""))
    return src.missing_splits(held, ("train", "val", "test", "valid"))


def files_by_class(spark, d):
    """Every class of the list with its files in a written tree, 0 included."""
    held = src.list_images(spark, _written_tree(spark, d), endings=("txt",)).withColumn("label", F.regexp_replace("label", "^label=", ""))
    names = files(spark, d).select(F.col("label").alias("name")).distinct()
    return src.count_images(held, names.union(names.select(F.concat("name", F.lit("_none")))))


def _paths(spark, d):
    """Paths of a tree as a listing gives it, with the odd shapes that audits look for: 2 to 6 levels."""
    i, label, ending = F.col("doc_id"), F.col("source"), F.when(F.col("doc_id") % 11 == 0, ".txt").otherwise(F.when(F.col("doc_id") % 2 == 0, ".JPG").otherwise(".png"))
    side = F.when(i % 4 == 0, "Val").otherwise("train")
    shape = F.when(i % 5 == 0, F.concat_ws("/", F.lit("sets/one"), side, label)).when(i % 5 == 1, F.concat_ws("/", F.lit("sets/two/train/Train"), label)).when(i % 5 == 2, F.concat_ws("/", F.lit("loose"), label, label)).when(i % 5 == 3, F.concat_ws("/", F.lit("notes"), label)).otherwise(F.lit("sets/deep/a/b/c"))
    ending = F.when(i % 5 == 3, ".txt").otherwise(ending)
    return table(spark, d, "documents").select(F.concat(F.lit("store:/data/"), shape, F.lit("/f"), i.cast("string"), ending).alias("path"))


def tree_profile(spark, d):
    """Every folder of a tree: images in it and below it, folders and files in it, whether it is the root of splits."""
    return src.tree_folders(_paths(spark, d), "store:/data").select("folder", "name", "depth", "parent", "images", "all_images", "folders", "files", "split_root")


def tree_anomalies(spark, d):
    return src.nesting_anomalies(src.tree_folders(_paths(spark, d), "store:/data"))


def _checks():
    """Of a plan with columns label, split, shared (its digest is in both splits), reason."""
    kept = F.col("reason").isNull()
    return {"no label": F.count_if(F.col("label").isNull()), "copies kept in both splits": F.count_if(kept & F.col("shared")), "long families kept": F.count_if(kept & (F.length("family") > 3))}


def gated_plans(spark, d):
    """Three plans through the gate: one whose checks hold, one that is refused, and that one by force; with the rows that were left."""
    f = files(spark, d)
    sides = f.groupBy("digest").agg((F.min("split") != F.max("split")).alias("shared"))
    bad = integrity.quarantine_plan(f).join(sides, "digest").withColumn("reason", F.when(F.col("shared") & (F.col("split") == "val") & (F.col("doc_id") % 2 == 1), F.lit("leak")).otherwise(F.col("reason")))
    good = bad.withColumn("reason", F.when(F.col("shared"), F.lit("leak")).otherwise(F.col("reason")))
    broken = bad.withColumn("label", F.when(F.col("doc_id") % 50 == 0, F.lit(None)).otherwise(F.col("label")))
    out = []
    for name, plan, force in (("good", good, False), ("broken", broken, False), ("forced", broken, True)):
        path = _folder(spark, f"plan-{name}")
        found = sinks.publish_plan(plan.select("path", "label", "split", "family", "shared", "reason"), path, _checks(), ["split"], apply=True, force=force)
        left = spark.read.parquet(path).count() if sinks.exists(spark, path) else 0
        out.append(found.select(F.lit(name).alias("plan"), "check", "violations", "ok", "written", F.lit(left).cast("long").alias("left")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def stored_results(spark, d):
    """A summary computed, used again, and computed anew after its input has grown: which of the runs computed it, and what it says."""
    source, path = _folder(spark, "scores"), _folder(spark, "summary")
    p = predictions(spark, d).select("id", "truth", "conf")
    runs, computed = [], []

    def summary():
        computed.append(True)
        return spark.read.parquet(source).groupBy("truth").agg(F.count("*").alias("n"), F.round(F.sum("conf"), 4).alias("total"))

    for run, rows in enumerate((p.filter("id % 2 = 0"), None, p.filter("id % 2 = 1"), None)):
        if rows is not None:
            rows.write.parquet(source, mode="append")
        before = len(computed)
        result, reused = sinks.cached(spark, [source], path, summary)
        runs.append(result.select(F.lit(run).alias("run"), F.lit(reused).alias("reused"), F.lit(len(computed) - before).alias("computed"), "truth", "n", "total"))
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).unionByName(runs[3])


class _Killed(RuntimeError):
    pass


def history_saved_once(spark, d):
    """A stream of scans into a history, killed after the write of one batch and started again: scans and distinct scans by class."""
    source, path, state = _folder(spark, "scans"), _folder(spark, "history"), _folder(spark, "state")
    table(spark, d, "events").select("event_id", "event_type").repartitionByRange(4, "event_id").write.parquet(source)
    tries: list[int] = []

    def kill(number):
        tries.append(number)
        if tries == [0, 1]:
            raise _Killed(f"after batch {number}")

    for _ in range(2):
        stream = spark.readStream.schema("event_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(source)
        query = stream.writeStream.foreachBatch(live.save_once(path, "event_id", kill)).option("checkpointLocation", state).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as e:
            if "after batch" not in str(e):
                raise
    held = spark.read.parquet(path)
    return held.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("scans"))


# --------------------------------------------------------------------------- text sources


def manifest_tabs(spark, d):
    """Counts of classes through a file with tabs and back."""
    path = _folder(spark, "counts")
    f = files(spark, d).groupBy("label").agg(F.count_if(F.col("split") == "train").alias("train"), F.count("*").alias("total"))
    f.select("label", F.when(F.col("train") > 0, F.concat_ws(", ", F.lit("has"), F.col("train").cast("string"))).alias("note"), "total").write.csv(path, header=True, sep="\t")
    return src.read_csv(spark, path, "label string, note string, total long", separator="\t")


def keyed_records(spark, d):
    """A JSON object of records by customer segment, written and read with a default for what is missing."""
    path = _folder(spark, "records")
    by = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    record = F.struct(F.concat(F.lit("n"), F.col("n").cast("string")).alias("display"), F.when(F.col("n") % 2 == 0, F.lit("soon")).alias("urgency"))
    by.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c_mktsegment", record))))).alias("value")).write.text(path)
    return src.read_keyed_records(spark, path, "display string, urgency string", {"urgency": "later"})


def numbered_list(spark, d):
    """Nations as numbered lines, some without a number and some blank."""
    path = _folder(spark, "lines")
    k = F.col("n_nationkey")
    line = F.when(k % 7 == 0, F.col("n_name")).when(k % 5 == 0, F.concat(F.lit("  "), k.cast("string"), F.lit("\t"), F.col("n_name"), F.lit(" "))).otherwise(F.concat_ws(" ", k.cast("string"), F.col("n_name")))
    table(spark, d, "nation").select(F.explode(F.array(line, F.lit(" "))).alias("value")).write.text(path)
    return src.read_numbered_list(spark, path).withColumn("idx", F.coalesce("idx", F.lit(-1)))


def report_facts(spark, d):
    """A training report as text, and the facts read out of it."""
    path = _folder(spark, "report")
    e = table(spark, d, "events").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("k"))
    text = F.concat_ws("\n", F.lit("run of today"), F.concat(F.col("k").cast("string"), F.lit(" classes")), F.lit("flatbuffer: model.bin"), F.concat(F.lit("  "), F.format_number("n", 0), F.lit(" bytes")), F.concat(F.lit("  sha256 "), F.sha2(F.col("n").cast("string"), 256)), F.lit("end"))
    e.select(text.alias("value")).write.text(path)
    return src.scrape_report(spark, f"{path}/*.txt")


def forecast_documents(spark, d):
    """Forecasts of users as JSON documents, read as slots, the first eight, and summed up by city."""
    e = table(spark, d, "events")
    slot = F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("dt"), F.struct(F.floor("value").cast("double").alias("temp"), F.get_json_object("props", "$.k").cast("double").alias("humidity")).alias("main"), F.array(F.struct(F.when(F.col("event_type") == "view", "Rain").otherwise("Clear").alias("main"), F.lit("").alias("description"))).alias("weather"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("dt_txt"))
    # a document holds a user's events of one day, a bounded list
    doc = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(slot)).alias("list"))
    documents = doc.select(F.to_json(F.struct("list", F.struct(F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("name")).alias("city"))).alias("value"))
    return src.forecast_summary(src.forecast_slots(documents, most=8))


def contract_json(spark, d):
    """The checks of a class list as one JSON text, read back."""
    names = class_names(spark, d)
    from auditloom.operators.metrics import class_table

    made = contract.as_json(contract.report(contract.class_list_checks(class_table(spark, [*names, names[0], " padded"]), len(names))))
    back = made.select(F.from_json("json", "ok boolean, checks array<struct<name:string,ok:boolean,detail:string>>").alias("j"))
    return back.select(F.col("j.ok").alias("all_ok"), F.explode("j.checks").alias("c")).select("all_ok", "c.name", "c.ok", "c.detail")


def live_gates(spark, d):
    """Shown and right predictions by day from a stream of events, as far as the watermark has closed the days."""
    source, sink, state = _folder(spark, "events"), _folder(spark, "gates"), _folder(spark, "gate-state")
    p = predictions(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "conf", (F.col("truth") == F.col("pred")).alias("right"))
    p.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(source)
    stream = spark.readStream.schema(p.schema).parquet(source)
    query = live.live_gate_counts(stream, "ts", 0.5, "conf", F.col("right")).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(sink)
    query.awaitTermination()
    return spark.read.parquet(sink).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "total", "shown", "correct")


QUERIES = {f.__name__: f for f in (listed_tree, splits_missing, files_by_class, tree_profile, tree_anomalies, gated_plans, stored_results, history_saved_once, manifest_tabs, keyed_records, numbered_list, report_facts, forecast_documents, contract_json, live_gates)}

_F, _P = f"WITH {SQL_FILES}", f"WITH {SQL_PRED}"
_TREE = """WITH RECURSIVE p AS (SELECT CASE doc_id % 5 WHEN 0 THEN 'sets/one/' || CASE WHEN doc_id % 4 = 0 THEN 'Val' ELSE 'train' END || '/' || source WHEN 1 THEN 'sets/two/train/Train/' || source WHEN 2 THEN 'loose/' || source || '/' || source WHEN 3 THEN 'notes/' || source ELSE 'sets/deep/a/b/c' END AS folder,
  (doc_id % 11 <> 0 AND doc_id % 5 <> 3)::INT AS image FROM documents),
t AS (SELECT folder AS a, NULL::VARCHAR AS child, image FROM p UNION ALL SELECT CASE WHEN contains(a, '/') THEN regexp_replace(a, '/[^/]*$', '') ELSE '' END, regexp_extract(a, '[^/]*$'), image FROM t WHERE a <> ''),
f AS (SELECT a AS folder, CASE WHEN a = '' THEN 0 ELSE 1 + length(a) - length(replace(a, '/', '')) END::INT AS depth, CASE WHEN a = '' THEN 'data' ELSE regexp_extract(a, '[^/]*$') END AS name, CASE WHEN a <> '' THEN CASE WHEN contains(a, '/') THEN regexp_replace(a, '/[^/]*$', '') ELSE '' END END AS parent,
  coalesce(sum(image) FILTER (WHERE child IS NULL), 0)::BIGINT AS images, sum(image)::BIGINT AS all_images, count(DISTINCT child) AS folders, count(*) FILTER (WHERE child IS NULL) AS files,
  coalesce(bool_or(lower(child) = 'train'), false) AND coalesce(bool_or(lower(child) IN ('val', 'valid')), false) AS split_root, CASE WHEN count(DISTINCT child) = 1 THEN min(child) END AS only_child FROM t GROUP BY a)"""
_PLAN = f"""{_F}, m AS (SELECT f.*, (SELECT count(DISTINCT split) FROM f x WHERE x.digest = f.digest) > 1 AS shared, (SELECT count(DISTINCT label) FROM f x WHERE x.digest = f.digest) AS nl, row_number() OVER (PARTITION BY label, digest ORDER BY CASE WHEN split = 'train' THEN 0 ELSE 1 END, lower(path), path) AS r FROM f),
q AS (SELECT *, nl > 1 OR r > 1 OR (shared AND split = 'val') AS gone FROM m),
v AS (SELECT unnest(['good', 'broken', 'forced']) AS plan),
w AS (SELECT plan, unnest(['no label', 'copies kept in both splits', 'long families kept']) AS "check", unnest([CASE WHEN plan = 'good' THEN 0 ELSE (SELECT count(*) FROM q WHERE doc_id % 50 = 0) END,
  CASE WHEN plan = 'good' THEN 0 ELSE (SELECT count(*) FROM q WHERE NOT gone AND shared) END, CASE WHEN plan = 'good' THEN (SELECT count(*) FROM q WHERE NOT (gone OR shared) AND length(family) > 3) ELSE (SELECT count(*) FROM q WHERE NOT gone AND length(family) > 3) END]) AS violations FROM v),
z AS (SELECT plan, plan = 'forced' OR sum(violations) = 0 AS written FROM w GROUP BY plan)"""
_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
ORACLE_SQL = {
    "listed_tree": f"{_F} SELECT label, split, 1::BIGINT AS files FROM f WHERE contains(label, 'src1') GROUP BY ALL",
    "splits_missing": "SELECT unnest(['test', 'valid']) AS split",
    "files_by_class": f"{_F}, c AS (SELECT label, count(DISTINCT split) AS n FROM f GROUP BY 1) SELECT label AS name, n FROM c UNION ALL SELECT label || '_none', 0 FROM c",
    "tree_profile": f"{_TREE} SELECT folder, name, depth, parent, images, all_images, folders, files, split_root FROM f",
    "tree_anomalies": f"""{_TREE} SELECT folder, 'depth>3' AS anomaly FROM f WHERE depth > 3 UNION ALL SELECT folder, '0 images' FROM f WHERE images = 0 AND folders = 0
UNION ALL SELECT folder, 'nested split folder' FROM f WHERE lower(only_child) = lower(name) AND lower(name) IN ('train', 'val', 'valid', 'test') UNION ALL SELECT folder, 'repeated folder name' FROM f WHERE lower(only_child) = lower(name)""",
    "gated_plans": f'{_PLAN} SELECT plan, "check", violations, violations = 0 AS ok, written, CASE WHEN written THEN (SELECT count(*) FROM f) ELSE 0 END AS "left" FROM w JOIN z USING (plan)',
    "stored_results": f"""{_P}, r AS (SELECT unnest([0, 1, 2, 3])::INT AS run) SELECT run, run IN (1, 3) AS reused, CASE WHEN run IN (0, 2) THEN 1 ELSE 0 END::INT AS computed, "truth", count(*) AS n, round(sum(conf), 4) AS total FROM r JOIN p ON run >= 2 OR id % 2 = 0 GROUP BY ALL""",
    "history_saved_once": "SELECT event_type, count(*) AS n, count(*) AS scans FROM events GROUP BY 1",
    "manifest_tabs": f"{_F} SELECT label, CASE WHEN count(*) FILTER (WHERE split = 'train') > 0 THEN 'has, ' || count(*) FILTER (WHERE split = 'train') END AS note, count(*) AS total FROM f GROUP BY 1",
    "keyed_records": "SELECT c_mktsegment AS key, 'n' || count(*) AS display, CASE WHEN count(*) % 2 = 0 THEN 'soon' ELSE 'later' END AS urgency FROM customer GROUP BY 1",
    "numbered_list": "SELECT CASE WHEN n_nationkey % 7 > 0 THEN n_nationkey ELSE -1 END AS idx, n_name AS name FROM nation",
    "report_facts": "SELECT count(*) AS bytes, sha256(count(*)::VARCHAR) AS sha256, count(DISTINCT event_type)::INT AS classes FROM events",
    "forecast_documents": f"""WITH r AS (SELECT user_id, ts, event_type, value, {_K} AS k, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY epoch(ts)::BIGINT, floor(value), {_K}, event_type = 'view') AS r FROM events)
SELECT user_id || '/' || ts::DATE AS city, round(avg(coalesce(k, 0)), 1) AS humidity, round(avg(floor(value)), 1) AS temp, count(*) FILTER (WHERE event_type = 'view') AS rain_slots FROM r WHERE r <= 8 GROUP BY 1""",
    "contract_json": f"""{_P}, n AS (SELECT count(*) AS k, min(name) AS first FROM c) SELECT false AS all_ok, name, ok, detail FROM n, LATERAL (VALUES ('no blank names', true, 'none'), ('no padded names', false, '1 first:  padded'), ('unique names', false, '1 first: ' || first), ('class count', false, (k + 2)::VARCHAR), ('sorted names', false, '2 first:  padded')) w(name, ok, detail)""",
    "live_gates": f"""{_P}, w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS total, count(*) FILTER (WHERE conf >= 0.5) AS shown, count(*) FILTER (WHERE conf >= 0.5 AND "truth" = pred) AS correct FROM p GROUP BY 1) SELECT strftime(start, '%Y-%m-%d') AS day, total, shown, correct FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM p)""",
}
