"""URL rules, and trust propagated over the host graph where no rule fits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import NULL_ID, materialise, with_id

#: (verdict, host, path)
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Links of a page, in quotes of either kind or none.
HREF = r"""(?i)href[\x20\t\r\n]*=[\x20\t\r\n]*["']?([^"'<>\x20\t\r\n]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _parents(host: Column) -> Column:
    """The host and every domain it belongs to: a.b.c, b.c, c."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def best_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct<name, verdict> of the longest rule that fits, the first listed of equals, else null."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for verdict, h, p in reversed(ranked):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def linked_host(link: Column) -> Column:
    """The host that a link names, by scheme://host or //host; empty for relative links."""
    return host_of(F.when(link.startswith("//"), F.concat(F.lit("x:"), link)).otherwise(link))


def host_edges(pages: DataFrame, same_domain: bool = False) -> DataFrame:
    """(src, dst, weight): how many links the pages of one host have to another host.

    Links that name a host count as such; relative links stay within their host. With
    same_domain every host is also joined both ways to the domain above it, as if hosts of one
    domain answered for each other.
    """
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("url"))
    out = links.select("src", linked_host(F.col("url")).alias("dst")).filter("dst <> '' and src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    if not same_domain:
        return out
    hosts = pages.filter("host <> ''").select("host").distinct()
    return out.unionByName(_domain_edges(hosts)).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _domain_edges(hosts: DataFrame) -> DataFrame:
    chain = hosts.filter("instr(host, '.') > 0").select(_parents(F.col("host")).alias("chain"))
    steps = chain.select(F.explode(F.arrays_zip(F.slice("chain", F.lit(1), F.size("chain") - 1).alias("low"), F.slice("chain", F.lit(2), F.size("chain") - 1).alias("high"))).alias("e"))
    pairs = steps.select("e.low", "e.high").filter("instr(high, '.') > 0").distinct()  # a top-level domain joins no hosts
    both = pairs.select(F.col("low").alias("src"), F.col("high").alias("dst")).union(pairs.select("high", "low"))
    return both.select("src", "dst", F.lit(1.0).alias("weight"))


#: Rounds between two looks at what is still on its way, each of which writes the ranks out. A round
#: has the ranks of the one before twice in its plan, so there are few between two writes.
LOOK = 2


def most_rounds(damping: float, tolerance: float) -> int:
    """After so many rounds, a multiple of LOOK, less than `tolerance` of the mass is on its way,
    since each round passes on `damping` of it at most."""
    return LOOK * math.ceil(math.log(tolerance) / math.log(damping) / LOOK)


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(kind, host, score): personalised PageRank, each kind on its own graph.

    edges (kind, src, dst, weight); seeds (kind, host, seed), whose values sum to 1 in each
    kind. Mass starts at the seeds; a host keeps 1 - damping of what reaches it as score and
    passes the rest on, by link weight. It goes on until less than `tolerance` is on its way in
    every kind. What reaches a host without links would go back to the seeds; that only scales
    all scores of a kind, so they are scaled to the sum 1 at the end instead.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    shares = materialise(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (damping * F.col("weight") / F.col("total")).alias("share")), "shares")
    state = seeds.select("kind", "host", F.col("seed").alias("moving"), F.lit(0.0).alias("score"))
    for i in range(most_rounds(damping, tolerance)):
        passed = shares.join(state, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("share") * F.col("moving")).alias("moving"), F.lit(0.0).alias("score"))
        kept = state.select("kind", "host", F.lit(0.0).alias("moving"), (F.col("score") + (1 - damping) * F.col("moving")).alias("score"))
        state = passed.union(kept).groupBy("kind", "host").agg(F.sum("moving").alias("moving"), F.sum("score").alias("score"))
        if i % LOOK == LOOK - 1:
            state = materialise(state, "rank")
            if all(r[0] <= tolerance for r in state.groupBy("kind").agg(F.sum("moving")).select("sum(moving)").collect()):
                break
    total = state.groupBy("kind").agg(F.sum("score").alias("total"))
    return state.join(F.broadcast(total), "kind").select("kind", "host", (F.col("score") / F.col("total")).alias("score"))  # a row for each kind


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[tuple[str, str, str], ...] = RULES, damping: float = 0.85, margin: float = 1.0, tolerance: float = 1e-6, same_domain: bool = False) -> DataFrame:
    """For each row: page_id, host, path, rule, verdict, trust, distrust.

    The longest rule that fits the host (or a domain above it) and the start of the path gives
    the verdict. Without a rule the host's place in the link graph decides: trust flows from
    hosts of pages that rules allow along the links, distrust from hosts of pages that rules
    block against the links; a host is blocked if distrust > margin * trust. Both are shares of
    1, and their comparison leaves out a relative difference of 1e-9, which rounding may make.

    Seeds weigh as many pages as they stand for. Edges and ranks are tables of hosts, summed
    on the map side; a host with very many pages is one row of them. A url that is null or has
    no :// has an empty host and path and is allowed, with no trust and no distrust. A null
    html has no links. A null page_id stays null, rows that repeat a page_id each get a row,
    an empty table gives no rows. same_domain: see host_edges().
    """
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    fitted = rows.withColumn("fit", best_rule(F.col("host"), F.col("path"), rules))
    edges = materialise(host_edges(rows, same_domain), "edges")
    both = edges.select(F.lit("allow").alias("kind"), "src", "dst", "weight").union(edges.select(F.lit("block"), "dst", "src", "weight"))
    counted = fitted.filter("fit is not null and host <> ''").groupBy(F.col("fit.verdict").alias("kind"), "host").agg(F.count("*").alias("n"))
    counted = materialise(counted, "seeds")
    totals = counted.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = counted.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("seed"))  # a row for each kind
    ranks = personalised_rank(both, seeds, damping, tolerance)
    scores = ranks.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == kind, F.col("score"))).alias(name) for kind, name in (("allow", "trust"), ("block", "distrust"))])
    joined = fitted.drop("html").join(scores, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("fit.verdict", F.when((distrust > 0) & (distrust > margin * trust * (1 + 1e-9)), "block").otherwise("allow"))
    return joined.select(with_id("_id", "page_id"), "host", "path", F.col("fit.name").alias("rule"), verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def oracle_sql(rules: tuple[tuple[str, str, str], ...] = RULES, damping: float = 0.85, margin: float = 1.0, tolerance: float = 1e-6) -> str:
    """page_id, host, path, rule, verdict over `pages`, for DuckDB."""
    href = HREF.replace("'", "''")
    host = lambda u: f"translate(regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    return f"""
WITH RECURSIVE rows AS MATERIALIZED (SELECT page_id, {host('url')} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages),
fitted AS MATERIALIZED (SELECT page_id, host, path, {case(1)} AS rule, {case(2)} AS fit FROM rows),
links AS (SELECT src, {host("CASE WHEN starts_with(u, '//') THEN 'x:' || u ELSE u END")} AS dst FROM (SELECT host AS src, unnest(regexp_extract_all(html, '{href}', 1)) AS u FROM rows)),
edges AS MATERIALIZED (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM links WHERE dst <> '' AND src <> dst AND src <> '' GROUP BY 1, 2),
graph AS MATERIALIZED (SELECT kind, src, dst, {damping} * weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM (SELECT 'allow' AS kind, src, dst, weight FROM edges UNION ALL SELECT 'block', dst, src, weight FROM edges)),
seeds AS MATERIALIZED (SELECT fit AS kind, host, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY fit) AS seed FROM fitted WHERE fit IS NOT NULL AND host <> '' GROUP BY 1, 2),
moves AS (SELECT 0 AS i, kind, host, seed AS moving FROM seeds
  UNION ALL SELECT i + 1, kind, host, sum(m) AS moving FROM (SELECT v.i, v.kind, g.dst AS host, g.share * v.moving AS m FROM moves v JOIN graph g ON g.kind = v.kind AND g.src = v.host WHERE v.i < {most_rounds(damping, tolerance)}) GROUP BY 1, 2, 3),
mass AS (SELECT i, kind, sum(moving) AS mass FROM moves GROUP BY ALL),
looks AS (SELECT unnest(range({LOOK}, {most_rounds(damping, tolerance) + 1}, {LOOK})) AS i),
stop AS (SELECT min(i) AS last FROM looks WHERE i = {most_rounds(damping, tolerance)} OR NOT EXISTS (SELECT 1 FROM mass WHERE mass.i = looks.i AND mass > {tolerance})),
scores AS (SELECT kind, host, {1 - damping} * sum(moving) AS score FROM moves, stop WHERE i < last GROUP BY ALL),
ranks AS (SELECT kind, host, score / sum(score) OVER (PARTITION BY kind) AS score FROM scores),
hosts AS (SELECT host, coalesce(sum(score) FILTER (WHERE kind = 'allow'), 0) AS trust, coalesce(sum(score) FILTER (WHERE kind = 'block'), 0) AS distrust FROM ranks GROUP BY host)
SELECT page_id, f.host, path, rule, coalesce(fit, CASE WHEN distrust > 0 AND distrust > {margin} * trust * (1 + 1e-9) THEN 'block' ELSE 'allow' END) AS verdict
FROM fitted f LEFT JOIN hosts h ON h.host = f.host
"""
