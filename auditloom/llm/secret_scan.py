"""Secrets in texts, told from copied examples by how many owners have them; built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import NULL_ID, materialise, with_id

#: (kind, pattern, group that holds the secret, what all must be found in a match that counts), in
#: the order in which kinds are listed; the first three are the fixed base. What must be found
#: is looked for in one pass each, so that a word of any length costs no more than its length.
KINDS: tuple[tuple[str, str, int, tuple[str, ...]], ...] = (
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, ("^.{6}",)),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, ()),
    ("hex", r"[0-9a-f]{24,}", 0, ()),
    ("opaque", r"[A-Za-z0-9+/_-]{20,}", 0, ("[A-Za-z]", "[0-9]")),
)
BASE = 3


def _candidates(number: int) -> Column:
    """array<struct<kind, gap, size, ok, hash>>: a kind's matches, leftmost first.

    gap is the number of characters between the previous match and this one: split() gives
    what lies between the matches, in the same order as regexp_extract_all gives the matches.
    """
    _, pattern, group, like = KINDS[number]
    text = F.col("_text")
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secret = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("gap"), whole.alias("whole"), secret.alias("secret"))
    each = F.transform(
        zipped,
        lambda m: F.struct(
            F.lit(number).alias("kind"),
            F.length(m["gap"]).alias("gap"),
            F.length(m["whole"]).alias("size"),
            reduce(Column.__and__, [m["secret"].rlike(x) for x in like], F.lit(True)).alias("ok"),
            F.sha2(m["secret"], 256).alias("hash"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,gap:int,size:int,ok:boolean,hash:string>>")
    return F.when(text.rlike(pattern), each).otherwise(none)


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_cols: tuple[str, ...] = ("source", "lang"),
    max_owners: int = 2,
    max_repos: int = 3,
) -> DataFrame:
    """For each row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_opaque, n_live, n_example.

    Base spans are the matches of the first three kinds. Their secrets, and long opaque
    strings of letters and digits, are candidates; a candidate's hash is counted over all
    documents by distinct owners and repositories. One that more than max_owners owners or
    max_repos repositories have is a copied example, else it looks live. The spans of live
    opaque strings that touch no base span are added to the base ones as kind `opaque`.
    Offsets are in code points, the end exclusive; matches of a kind don't overlap.

    Only secrets' hashes and places are shuffled, never texts. A hash is counted by (hash,
    owner, repository) first, with map-side sums, so a secret that every document has is a
    few rows a partition; where the examples join the spans again, Spark splits frequent ones.

    Null text: empty, no spans. Null owners or repositories count as one of their own. A null
    doc_id stays null, rows that repeat a doc_id each get a row, an empty table gives none.
    """
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    repo = F.to_json(F.array(*[F.col(c).cast("string") for c in repo_cols]))
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"),
        owner.alias("owner"),
        repo.alias("repo"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
    )
    found = F.concat(*[_candidates(i) for i in range(len(KINDS))])
    scanned = materialise(rows.select("_row", "_id", "owner", "repo", found.alias("found")), "secrets")

    each = scanned.filter(F.size("found") > 0).select("_row", "owner", "repo", F.posexplode("found").alias("pos", "m")).select("_row", "owner", "repo", "pos", "m.*")
    before = Window.partitionBy("_row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(before).cast("long")
    spans = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).filter("ok")

    owned = each.filter("ok").groupBy("hash", "owner", "repo").agg(F.count("*").alias("times"))
    counted = owned.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))
    examples = counted.filter((F.col("owners") > max_owners) | (F.col("repos") > max_repos)).select("hash", F.lit(True).alias("example"))
    judged = spans.select("_row", "kind", "start", "end", "hash").join(examples, "hash", "left").withColumn("example", F.coalesce("example", F.lit(False)))

    # a sweep from either side finds base spans that reach into a span, or begin before its end
    is_base = F.col("kind") < BASE
    behind = Window.partitionBy("_row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("_row").orderBy(F.col("start").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    reaches = F.max(F.when(is_base, F.col("end"))).over(behind) > F.col("start")
    begins = F.min(F.when(is_base, F.col("start"))).over(ahead) < F.col("end")
    free = ~F.coalesce(reaches, F.lit(False)) & ~F.coalesce(begins, F.lit(False))
    swept = judged.withColumn("shown", is_base | (~F.col("example") & free))

    per_row = swept.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "example", "shown"))).alias("all"))
    joined = scanned.select("_row", "_id").join(per_row, "_row", "left")
    every = F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,example:boolean,shown:boolean>>"))
    base = F.filter("every", lambda s: s["kind"] < BASE)
    shown = F.filter("every", lambda s: s["shown"])
    name = F.array(*[F.lit(k[0]) for k in KINDS])

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(spans: str, keep) -> Column:
        return F.size(F.filter(spans, keep)).cast("long")

    def of_kind(spans: str, number: int) -> Column:
        return count(spans, lambda s: s["kind"] == number)

    with_lists = joined.select("_id", every.alias("every")).withColumn("base", base).withColumn("shown", shown)
    return with_lists.select(
        with_id(),
        *[of_kind("base", i).alias(f"n_{KINDS[i][0]}") for i in range(BASE)],
        F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.col("shown")).alias("spans"),
        of_kind("shown", BASE).alias("n_opaque"),
        count("every", lambda s: ~s["example"]).alias("n_live"),
        count("every", lambda s: s["example"]).alias("n_example"),
    )


def oracle_sql(max_owners: int = 2, max_repos: int = 3) -> str:
    """The same over `documents`, for DuckDB."""
    parts = []
    for i, (_, pattern, group, like) in enumerate(KINDS):
        p = pattern.replace("'", "''")
        ok = " AND ".join([f"regexp_matches(x, '{x}')" for x in like] or ["true"])
        parts.append(f"""
SELECT r, owner, repo, {i} AS kind, unnest(range(1, len(w) + 1)) AS pos,
       unnest(list_transform(list_slice(string_split_regex(t, '{p}'), 1, len(w)), lambda x: length(x))) AS gap,
       unnest(list_transform(w, lambda x: length(x))) AS size,
       unnest(list_transform(s, lambda x: {ok})) AS ok, unnest(list_transform(s, lambda x: sha256(x))) AS hash
FROM (SELECT r, owner, repo, t, regexp_extract_all(t, '{p}') AS w, regexp_extract_all(t, '{p}', {group}) AS s FROM d WHERE regexp_matches(t, '{p}'))""")
    names = ", ".join(f"'{k[0]}'" for k in KINDS)
    span = f"[{names}][kind + 1] || ':' || \"start\" || ':' || \"end\""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, coalesce(source, '~') || '/' || coalesce(lang, '~') AS repo, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
p AS (SELECT *, sum(gap + size) OVER (PARTITION BY r, kind ORDER BY pos) AS "end" FROM m),
e AS (SELECT hash, count(DISTINCT owner) > {max_owners} OR count(DISTINCT repo) > {max_repos} AS example FROM m WHERE ok GROUP BY hash),
s AS (SELECT r, kind, CAST("end" - size AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end", example FROM p JOIN e USING (hash) WHERE ok),
x AS (SELECT s.*, kind < {BASE} OR (NOT example AND NOT EXISTS (SELECT 1 FROM s b WHERE b.r = s.r AND b.kind < {BASE} AND b."start" < s."end" AND s."start" < b."end")) AS shown FROM s),
a AS (SELECT r, {", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{KINDS[i][0]}" for i in range(BASE))},
  string_agg({span}, ',' ORDER BY "start", kind) FILTER (WHERE kind < {BASE}) AS base, string_agg({span}, ',' ORDER BY "start", kind) FILTER (WHERE shown) AS spans,
  count(*) FILTER (WHERE kind = {BASE} AND shown) AS n_opaque, count(*) FILTER (WHERE NOT example) AS n_live, count(*) FILTER (WHERE example) AS n_example FROM x GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{KINDS[i][0]}, 0) AS n_{KINDS[i][0]}" for i in range(BASE))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_opaque, 0) AS n_opaque, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN a USING (r)
"""
