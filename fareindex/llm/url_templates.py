"""URL filter: a tree of path templates for each host, judged by the smoothed share of good pages; fixed rules come first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import LOWER, UPPER, ascii_lower, written


@dataclass(frozen=True)
class Templates:
    depth: int = 4              # levels of the tree; what lies deeper is one last segment
    min_support: int = 20       # a segment stays as it is from so many urls on ...
    min_percent: int = 5        # ... that are this share of its node; the others become wildcards by their shape
    z_squared: float = 3.84     # sibling branches whose shares of good pages differ less are merged
    weight: float = 10.0        # of the host in its template's share, and of all pages in their host's
    limit: float = 0.75         # templates with a smaller share are blocked


#: Shapes of variable segments, the first that fits.
SHAPES = (("^[0-9]+$", "{number}"), ("^[0-9]+[.][A-Za-z0-9]+$", "{number.ext}"), ("^[0-9A-Fa-f-]{8,}$", "{hex}"), ("[0-9]", "{mixed}"))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def shape(segment: Column) -> Column:
    out = F.lit("{text}")
    for pattern, name in reversed(SHAPES):
        out = F.when(segment.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest of a short list of (host, path, verdict) that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _segments(path: Column, depth: int) -> Column:
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    last = F.array(F.array_join(F.slice(parts, depth, F.greatest(F.size(parts), F.lit(1))), "/"))
    return F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth - 1), last)).otherwise(parts)


def _level(rows: DataFrame, k: int, t: Templates) -> DataFrame:
    """One level of the tree: each row's `template` grows by its branch. All sums are combined before the shuffle; a node has at most
    100 / `min_percent` own segments and one branch a shape, so what is sorted within a node is small."""
    value = F.coalesce(F.get(F.col("segments"), F.lit(k)), F.lit(""))
    after = F.get(F.col("segments"), F.lit(k + 1))
    at = rows.withColumn("value", value).withColumn("next", F.when(after.isNull(), F.lit("")).otherwise(shape(after)))
    node = ["host", "template"]
    values = (at.filter("value <> ''").groupBy(*node, "value", "next")
              .agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")))
    values = written(values, "url-values")
    by_value = values.groupBy(*node, "value").agg(F.sum("n").alias("n"))
    totals = values.groupBy(*node).agg(F.sum("n").alias("total"))
    own = written(by_value.filter(F.col("n") >= t.min_support).join(totals, node).filter(100 * F.col("n") >= t.min_percent * F.col("total")).select(*node, "value"), "url-own")
    named = values.join(own.withColumn("own", F.lit(True)), [*node, "value"], "left").withColumn("branch", F.when(F.col("own"), F.col("value")).otherwise(shape(F.col("value"))))
    profile = named.groupBy(*node, "branch", "next").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    branches = profile.groupBy(*node, "branch").agg(F.max(F.struct("n", "next"))["next"].alias("profile"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    # Siblings that lead on alike, in the order of their share of good pages: a new group starts where neighbours differ surely.
    order = Window.partitionBy(*node, "profile").orderBy((F.col("good") + 1) / (F.col("labelled") + 2), "branch")
    n1, g1, n2, g2 = F.lag("labelled").over(order), F.lag("good").over(order), F.col("labelled"), F.col("good")
    p = (g1 + g2) / (n1 + n2)
    apart = F.pow(g1 / n1 - g2 / n2, F.lit(2.0)) >= F.lit(t.z_squared) * p * (1 - p) * (1 / n1 + 1 / n2)
    differ = F.when((n1 > 0) & (n2 > 0) & (p > 0) & (p < 1) & apart, 1).otherwise(0)
    grouped = branches.withColumn("differ", differ).withColumn("group", F.sum("differ").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy(*node, "profile", "group").agg(F.array_sort(F.collect_list("branch")).alias("members"))
    names = merged.select(*node, F.explode("members").alias("branch"), F.array_join("members", "|").alias("merged"))
    names = written(names, "url-branches")
    placed = at.join(own.withColumn("own", F.lit(True)), [*node, "value"], "left").withColumn("branch", F.when(F.col("own"), F.col("value")).otherwise(shape(F.col("value"))))
    placed = placed.join(names, [*node, "branch"], "left")
    grown = F.when((F.col("value") != "") & F.col("merged").isNotNull(), F.concat("template", F.lit("/"), "merged")).otherwise(F.col("template"))
    return placed.select("page_id", "host", "path", "segments", "good", grown.alias("template"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], t: Templates = Templates()) -> DataFrame:
    """Verdict on each row of `pages` (`page_id`, `url`): the longest fixed rule's, else that of its host's path template.

    `labels` has `page_id` and `good` (0 or 1) for some pages; of several the smallest counts. Adds `template` and `purity`, the share of
    good pages of the template, drawn towards its host's and that towards all pages'. A null url or one without `://` has an empty host
    and path and the template of such urls. Rows that repeat an id are judged each; a null id is never labelled.
    """
    marks = (labels.select(F.col("page_id").cast("long").alias("page_id"), F.col("good").cast("long").alias("good"))
             .filter("page_id IS NOT NULL AND good IN (0, 1)").groupBy("page_id").agg(F.min("good").alias("good")))
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.join(marks, "page_id", "left").select("page_id", "host", "path", _segments(F.col("path"), t.depth).alias("segments"), "good", F.lit("").alias("template"))
    rows = written(rows, "url-rows")
    for k in range(t.depth):
        rows = written(_level(rows, k, t), "url-rows")
    sums = [F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")]
    every = rows.agg(*sums).first()
    share = (every.good + 1.0) / (every.labelled + 2.0)
    hosts = rows.groupBy("host").agg(*sums).select("host", ((F.col("good") + t.weight * share) / (F.col("labelled") + t.weight)).alias("host_share"))
    templates = (rows.groupBy("host", "template").agg(*sums).join(hosts, "host")
                 .select("host", "template", ((F.col("good") + t.weight * F.col("host_share")) / (F.col("labelled") + t.weight)).alias("purity")))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    by_template = F.when(F.col("purity") < t.limit, F.lit("block")).otherwise(F.lit("allow"))
    return (rows.join(written(templates, "url-templates"), ["host", "template"], "left")
            .select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, by_template).alias("verdict"), "template", "purity"))


def _shape_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{name}'" for p, name in SHAPES) + " ELSE '{text}' END"


def judge_sql(labels: str, rules: list[tuple[str, str, str]], t: Templates = Templates()) -> str:
    """The same as one DuckDB statement; `labels` is a subquery of `page_id` and `good` over `split` (page_id, host, path)."""
    ctes = [f"""split AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)""",
            f"marks AS (SELECT page_id, min(good) AS good FROM ({labels}) WHERE page_id IS NOT NULL AND good IN (0, 1) GROUP BY 1)",
            f"""r0 AS (SELECT page_id, host, path, good, '' AS template,
  CASE WHEN len(parts) > {t.depth} THEN list_append(parts[1:{t.depth - 1}], array_to_string(parts[{t.depth}:], '/')) ELSE parts END AS segments
  FROM (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM split LEFT JOIN marks USING (page_id)))"""]
    for k in range(t.depth):
        ctes += [f"""a{k} AS (SELECT *, coalesce(segments[{k + 1}], '') AS value, CASE WHEN segments[{k + 2}] IS NULL THEN '' ELSE {_shape_sql(f'segments[{k + 2}]')} END AS next FROM r{k})""",
                 f"v{k} AS (SELECT host, template, value, next, count(*) AS n, count(good) AS labelled, coalesce(sum(good), 0) AS good FROM a{k} WHERE value <> '' GROUP BY ALL)",
                 f"""o{k} AS (SELECT host, template, value FROM (SELECT host, template, value, sum(n) AS n FROM v{k} GROUP BY ALL)
  JOIN (SELECT host, template, sum(n) AS total FROM v{k} GROUP BY ALL) USING (host, template) WHERE n >= {t.min_support} AND 100 * n >= {t.min_percent} * total)""",
                 f"""b{k} AS (SELECT host, template, branch, max(row(n, next)) AS top, sum(labelled) AS labelled, sum(good) AS good FROM
  (SELECT host, template, CASE WHEN o.value IS NOT NULL THEN v.value ELSE {_shape_sql('v.value')} END AS branch, next, sum(n) AS n, sum(labelled) AS labelled, sum(good) AS good
   FROM v{k} v LEFT JOIN o{k} o USING (host, template, value) GROUP BY ALL) GROUP BY host, template, branch)""",
                 f"""c{k} AS (SELECT host, template, branch, top[2] AS profile, labelled, good, lag(labelled) OVER w AS n1, lag(good) OVER w AS g1
  FROM b{k} WINDOW w AS (PARTITION BY host, template, top[2] ORDER BY (good + 1) / (labelled + 2), branch))""",
                 f"""d{k} AS (SELECT *, sum(CASE WHEN n1 > 0 AND labelled > 0 AND (g1 + good) > 0 AND (g1 + good) < (n1 + labelled)
   AND pow(g1 / n1 - good / labelled, 2.0) >= {t.z_squared} * ((g1 + good) / (n1 + labelled)) * (1 - (g1 + good) / (n1 + labelled)) * (1 / n1 + 1 / labelled) THEN 1 ELSE 0 END)
   OVER (PARTITION BY host, template, profile ORDER BY (good + 1) / (labelled + 2), branch ROWS UNBOUNDED PRECEDING) AS grp FROM c{k})""",
                 f"""m{k} AS (SELECT host, template, unnest(members) AS branch, array_to_string(members, '|') AS merged FROM
  (SELECT host, template, profile, grp, list_sort(list(branch)) AS members FROM d{k} GROUP BY ALL))""",
                 f"""r{k + 1} AS (SELECT page_id, host, path, good, CASE WHEN value <> '' AND merged IS NOT NULL THEN template || '/' || merged ELSE template END AS template, segments FROM
  (SELECT a.*, CASE WHEN o.value IS NOT NULL THEN a.value ELSE {_shape_sql('a.value')} END AS branch FROM a{k} a LEFT JOIN o{k} o USING (host, template, value))
  LEFT JOIN m{k} USING (host, template, branch))"""]
    last = f"r{t.depth}"
    name = verdict = "NULL"
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        name, verdict = f"CASE WHEN {fits} THEN '{h + p}' ELSE {name} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    ctes += [f"every_page AS (SELECT (coalesce(sum(good), 0) + 1.0::DOUBLE) / (count(good) + 2.0::DOUBLE) AS share FROM {last})",
             f"hosts AS (SELECT host, (coalesce(sum(good), 0) + {t.weight}::DOUBLE * any_value(share)) / (count(good) + {t.weight}::DOUBLE) AS host_share FROM {last}, every_page GROUP BY host)",
             f"""templates AS (SELECT host, template, (coalesce(sum(good), 0) + {t.weight}::DOUBLE * any_value(host_share)) / (count(good) + {t.weight}::DOUBLE) AS purity
  FROM {last} JOIN hosts USING (host) GROUP BY host, template)"""]
    return "WITH " + ",\n".join(ctes) + f"""
SELECT page_id, host, path, {name} AS rule, coalesce({verdict}, CASE WHEN purity < {t.limit} THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM {last} JOIN templates USING (host, template)"""
