"""URL filters by a path-template tree, in DataFrame functions only.

Fixed rules come first. For the rest, each host's paths form a tree: level by level a segment becomes `*` where it is
numeric or its parent has too many different children for them to be names. Every page has a label: its rule's verdict,
else that of a table of labelled pages where one is given, else whether its host or path holds a word of WORDS. Labels
are counted for each branch. From its template upwards a page's branch is merged with its siblings as long as its share
of bad labels doesn't differ from that of the branch above by more than chance; the merged branch's share, smoothed
towards the host's, is its purity, and where enough labels say so its pages are blocked. So a bad word in one page of a
clean branch blocks nothing, and pages without one are blocked in a branch whose pages are nearly all bad.

All steps work on distinct paths with their counts. Each level is a table that holds only the paths that go on, until
there are none; sides of joins are tables, so a host with a third of all pages is split over tasks. Defined cases: null
url, or one without ://, has empty host and path and is allowed; repeated rows are judged alike; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import quoted, written

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its own.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words of a host or path, in ASCII lower case between other characters than letters and digits.
WORDS = ("adult", "betting", "casino", "cialis", "escort", "gambling", "pills", "poker", "porn", "sex", "torrent", "viagra", "warez", "xxx")
NUMERIC = r"^[0-9]+([._-][0-9A-Za-z]+)?"


def split_url(df: DataFrame) -> DataFrame:
    rest = "CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END"
    parts = df.withColumn("rest_", F.expr(f"coalesce({rest}, '')"))
    host = F.translate(F.regexp_extract("rest_", "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return parts.withColumns({"host": host, "path": F.regexp_extract("rest_", "^[^/?#]*([^?#]*)", 1)}).drop("rest_")


def ruled(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict, else null."""
    name = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tried first
        fits = F.expr(f"(host = {quoted(host)} OR endswith(host, {quoted('.' + host)})) AND startswith(path, {quoted(path)})")
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def word_pattern(words: tuple[str, ...] = WORDS) -> str:
    return f"(^|[^a-z0-9])({'|'.join(words)})([^a-z0-9]|$)"


def templates(paths: DataFrame, many: int = 12, share: float = 0.2) -> DataFrame:
    """paths (distinct host and path, and n, their pages) with the column template."""
    out = None
    left = written(paths.withColumn("s_", F.split(F.regexp_replace("path", "^/", ""), "/")).withColumn("template", F.lit("")))
    level = 0
    while True:
        segment = F.get("s_", F.lit(level))
        here = left.withColumn("c_", F.when(segment.rlike(NUMERIC + r"\z"), "*").otherwise(segment))
        children = here.filter("c_ <> '*'").groupBy("host", "template", "c_").agg(F.sum("n").alias("r_"))
        wide = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("d_"), F.sum("r_").alias("r_")).filter(f"d_ > {many} AND d_ > {share}D * r_")
        wide = written(wide.select(F.col("host").alias("h_"), F.col("template").alias("t_")))
        both = here.join(wide, (here["host"] == wide["h_"]) & (here["template"] == wide["t_"]), "left")
        named = F.concat("template", F.lit("/"), F.when(F.col("h_").isNotNull() & (F.col("c_") != ""), "*").otherwise(F.col("c_")))
        done = written(both.withColumn("template", named).drop("c_", "h_", "t_"))
        level += 1
        ended = done.filter(F.size("s_") == level).drop("s_")
        out = ended if out is None else out.unionByName(ended)
        left = done.filter(F.size("s_") > level)
        if not left.limit(1).count():
            return out


def purities(paths: DataFrame, weight: float = 4.0) -> DataFrame:
    """host, template, seen and purity (the smoothed share of bad labels) of every template. paths: host, template, k (labels), b (bad ones).

    Branches are known by their templates' beginnings and hold all below them. A template is merged with its own branch,
    and that with the one above, while their shares lie within two standard errors; then the one above speaks for it.
    Smoothing pulls towards the host's share.
    """
    leaves = written(paths.groupBy("host", "template").agg(F.sum("k").alias("k"), F.sum("b").alias("b")).filter("k > 0"))
    # '/a/b' lies below '/a' and ''; at: how far above the template
    parts = F.expr("split(template, '/')")
    above = F.expr("transform(sequence(0, size(p_) - 1), i -> struct(i AS at, array_join(slice(p_, 1, size(p_) - i), '/') AS branch))")
    walked = leaves.withColumn("p_", parts).select("host", "template", "k", "b", F.explode(above).alias("x")).select("host", "template", "k", "b", "x.*")
    branches = written(walked.groupBy("host", "branch").agg(F.sum("k").alias("bk"), F.sum("b").alias("bb")))
    chain = walked.join(branches, ["host", "branch"])
    chain = chain.groupBy("host", "template").agg(F.first("k").alias("k"), F.first("b").alias("b"), F.expr("array_sort(collect_list(struct(at, bk AS k, bb AS b)))").alias("c"))
    p = "((x.b + 1) / (x.k + 2))"
    alike = f"abs(a.b / a.k - x.b / x.k) <= 2 * sqrt({p} * (1 - {p}) / a.k)"
    step = f"CASE WHEN NOT a.open OR NOT ({alike}) THEN named_struct('k', a.k, 'b', a.b, 'open', false) ELSE named_struct('k', x.k, 'b', x.b, 'open', true) END"
    merged = chain.select("host", "template", F.expr(f"aggregate(c, named_struct('k', k, 'b', b, 'open', true), (a, x) -> {step})").alias("m"), F.expr("element_at(c, -1)").alias("h"))
    return merged.select("host", "template", F.col("m.k").alias("seen"), F.expr(f"(m.b + {weight}D * (h.b / h.k)) / (m.k + {weight}D)").alias("purity"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, labels: DataFrame | None = None, words: tuple[str, ...] = WORDS, least: int = 5, purity: float = 0.8) -> DataFrame:
    """page_id, host, path, rule, verdict, template of every page. labels: page_id and bad (0 or 1, null ones ignored)."""
    name, kind = ruled(rules)
    df = split_url(pages.select("page_id", "url")).withColumns({"rule": name, "kind": kind}).withColumn("bad", F.when(kind == "block", 1).when(kind == "allow", 0))
    if labels is not None:
        said = labels.groupBy("page_id").agg(F.max("bad").alias("said"))
        df = df.join(said, "page_id", "left").withColumn("bad", F.coalesce("bad", "said")).drop("said")
    if words:
        lower = F.concat("host", F.translate("path", string.ascii_uppercase, string.ascii_lowercase))
        df = df.withColumn("bad", F.coalesce("bad", lower.rlike(word_pattern(words)).cast("int")))
    df = written(df.select("page_id", "host", "path", "rule", "kind", "bad"))
    paths = df.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("k"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    paths = templates(paths)
    rejected = written(purities(paths).filter(f"seen >= {least} AND purity >= {purity}").select(F.col("host").alias("h_"), F.col("template").alias("t_")))
    known = paths.join(rejected, (paths["host"] == rejected["h_"]) & (paths["template"] == rejected["t_"]), "left")
    known = written(known.select(F.col("host").alias("h_"), F.col("path").alias("p_"), "template", F.col("t_").isNotNull().alias("out_")))
    out = df.join(known, (df["host"] == known["h_"]) & (df["path"] == known["p_"]))
    return out.select("page_id", "host", "path", "rule", F.coalesce("kind", F.when(F.col("out_"), "block").otherwise("allow")).alias("verdict"), "template")


def oracle_sql(rules: tuple[tuple[str, str, str], ...] = RULES, words: tuple[str, ...] = WORDS, many: int = 12, share: float = 0.2, weight: float = 4.0, least: int = 5, purity: float = 0.8) -> str:
    """judge() without a table of labels as DuckDB SQL over pages."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in ordered]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, ordered, strict=True))
    kind = " ".join(f"WHEN {f} THEN '{k}'" for f, (k, _, _) in zip(fits, ordered, strict=True))
    rest = "coalesce(CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END, '')"
    lower = lambda x: f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    p = "((x.b + 1)::DOUBLE / (x.k + 2)::DOUBLE)"
    steps = [
        f"a AS (SELECT page_id, {rest} AS rest FROM pages)",
        f"b AS (SELECT page_id, {lower("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)",
        f"d AS (SELECT *, CASE {rule} END AS rule, CASE {kind} END AS kind, CASE coalesce(CASE {kind} END, CASE WHEN regexp_matches(host || {lower('path')}, '{word_pattern(words)}') THEN 'block' ELSE 'allow' END) WHEN 'block' THEN 1 ELSE 0 END AS bad FROM b)",
        "u AS (SELECT host, path, count(*) AS n, sum(bad) AS b, string_split(regexp_replace(path, '^/', ''), '/') AS s FROM d GROUP BY host, path)",
        "t AS (SELECT host, path, n, b, s, 0 AS level, '' AS template FROM u UNION ALL "
        f"SELECT host, path, n, b, s, level + 1, template || '/' || CASE WHEN e > {many} AND e > {share}::DOUBLE * r AND c <> '' THEN '*' ELSE c END FROM ("
        "SELECT *, count(DISTINCT c) FILTER (c <> '*') OVER (PARTITION BY host, template) AS e, sum(n) FILTER (c <> '*') OVER (PARTITION BY host, template) AS r FROM ("
        f"SELECT *, CASE WHEN regexp_full_match(s[level + 1], '{NUMERIC}') THEN '*' ELSE s[level + 1] END AS c FROM t WHERE len(s) > level)))",
        "l AS (SELECT host, path, template, n, b FROM t WHERE level = len(s))",
        "g AS (SELECT host, template, sum(n) AS k, sum(b) AS b, string_split(template, '/') AS s FROM l GROUP BY host, template)",
        "w AS (SELECT host, template, up, array_to_string(s[1:len(s) - up], '/') AS branch, k, b FROM (SELECT *, unnest(range(len(s))) AS up FROM g))",
        "h AS (SELECT host, branch, sum(k) AS k, sum(b) AS b FROM w GROUP BY host, branch)",
        "m AS (SELECT host, template, -1 AS up, k, b FROM g UNION ALL SELECT a.host, a.template, a.up + 1, x.k, x.b FROM m AS a JOIN w ON a.host = w.host AND a.template = w.template AND w.up = a.up + 1 "
        f"JOIN h AS x ON x.host = w.host AND x.branch = w.branch WHERE abs(a.b::DOUBLE / a.k::DOUBLE - x.b::DOUBLE / x.k::DOUBLE) <= 2 * sqrt({p} * (1 - {p}) / a.k::DOUBLE))",
        "z AS (SELECT host, template, max(up) AS up FROM m GROUP BY host, template)",
        f"y AS (SELECT m.host, m.template FROM m JOIN z USING (host, template, up) JOIN h ON h.host = m.host AND h.branch = '' WHERE m.k >= {least} AND (m.b::DOUBLE + {weight}::DOUBLE * (h.b::DOUBLE / h.k::DOUBLE)) / (m.k::DOUBLE + {weight}::DOUBLE) >= {purity}::DOUBLE)",
    ]
    return f"WITH RECURSIVE {', '.join(steps)} SELECT page_id, host, path, rule, coalesce(kind, CASE WHEN y.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, template FROM d JOIN l USING (host, path) LEFT JOIN y USING (host, template)"


def op9_urls(pages: DataFrame) -> DataFrame:
    return judge(pages)
