"""Secret scans by multipart credential linking, in DataFrame functions only.

Certain secrets match one pattern alone (the base kinds). Weak candidates do not: an opaque token of 20 or more
characters, an account name, an endpoint. They are cut out of each text with their places, dealt to cells of `scope`
code points and interval-joined on (document, cell): an opaque token is reported (kind `linked`) only where an AKIA id
lies within the scope of its beginning, or both an account name and an endpoint do.

The joins are semi-joins over neighbouring cells, so nothing multiplies however many parts a document has; only
documents with complementary parts take part, without their texts.

Defined cases: null text counts as empty; rows that share doc_id and text get the same spans; null doc_id is a value
like any other; no rows give no rows. Places are code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPANS, listed, matched, quoted, text_of, written

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "linked")
BASE = (
    (ASSIGN, f"length(regexp_extract(m, {quoted(ASSIGN)}, 1)) >= 12"),
    (r"AKIA[A-Z0-9]{14,}", "true"),
    (r"[0-9a-f]{16,}", "true"),
)
#: Weak kinds, never reported alone.
WEAK = {
    "opaque": (r"[A-Za-z0-9+/_=-]{20,}", "m rlike '[A-Z]' AND m rlike '[a-z]' AND m rlike '[0-9]'"),
    "account": (r"""(?i:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", "true"),
    "endpoint": (r"""(?:https?|jdbc|postgres|mysql|mongodb|redis|amqp|ftp|s3)(?::[a-z]+)?://[^\x20\x09-\x0D"'<>]++""", "true"),
}


def parts(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, th (the text's hash), base and the weak kinds of every document, as arrays of spans."""
    df = docs.withColumn("t_", text_of(docs))
    base = ", ".join(matched("t_", p, k, o) for o, (p, k) in enumerate(BASE))
    return df.select(*keep, F.xxhash64("t_").alias("th"), F.expr(f"array_sort(concat({base}))").alias("base"), *[F.expr(matched("t_", p, k, 3)).alias(name) for name, (p, k) in WEAK.items()])


def linked(found: DataFrame, scope: int = 400) -> DataFrame:
    """doc_id, th and the array `more` of opaque tokens with complementary parts in their scope."""
    both = found.filter("size(opaque) > 0").withColumn("access", F.expr("filter(base, x -> x.o = 1)")).filter("size(access) > 0 OR size(account) > 0 AND size(endpoint) > 0")
    cells = lambda c: F.expr(f"sequence(({c}.s DIV {scope}) - 1, ({c}.e DIV {scope}) + 1)")
    opaque = both.select("doc_id", "th", F.explode("opaque").alias("x")).select("doc_id", "th", "x", F.expr(f"x.s DIV {scope}").alias("cell"))

    def near(left: DataFrame, name: str) -> DataFrame:
        right = both.select(F.col("doc_id").alias("d_"), F.col("th").alias("h_"), F.explode(name).alias("y"))
        right = right.select("d_", "h_", "y", F.explode(cells("y")).alias("c_"))
        here = left["doc_id"].eqNullSafe(right["d_"]) & (left["th"] == right["h_"]) & (left["cell"] == right["c_"])
        return left.join(right, here & F.expr(f"y.s <= x.s + {scope} AND y.e + {scope} >= x.s"), "left_semi")

    sure = near(opaque, "access").unionByName(near(near(opaque, "account"), "endpoint"))
    return sure.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("x")).alias("more"))


def scan(docs: DataFrame, scope: int = 400) -> DataFrame:
    """doc_id, base and spans (arrays of struct(s, o, e); o is the place in KINDS) of every document."""
    found = written(parts(docs, "doc_id"))
    more = linked(found, scope).withColumnsRenamed({"doc_id": "d_", "th": "h_"})
    out = found.join(more, found["doc_id"].eqNullSafe(more["d_"]) & (found["th"] == more["h_"]), "left")
    return out.select("doc_id", "base", F.expr(f"array_sort(concat(base, coalesce(more, CAST(array() AS {SPANS}))))").alias("spans"))


def op1_secrets(docs: DataFrame) -> DataFrame:
    count = [F.expr(f"CAST(size(filter(base, x -> x.o = {o})) AS BIGINT)").alias(f"n_{k}") for o, k in enumerate(KINDS[:3])]
    return scan(docs).select("doc_id", *count, F.sha2(F.expr(listed("base", KINDS)), 256).alias("base_sha256"), F.expr(listed("spans", KINDS)).alias("spans"))


def oracle_sql(scope: int = 400) -> str:
    """op1_secrets as DuckDB SQL over documents."""
    tests = {"m rlike '[A-Z]' AND m rlike '[a-z]' AND m rlike '[0-9]'": "regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')", "true": "true"}
    kinds = [(p, f"length(regexp_extract(m, {_sql(p)}, 1)) >= 12" if p == ASSIGN else tests[k]) for p, k in (*BASE, *WEAK.values())]
    found = []
    for o, (p, keep) in enumerate(kinds):
        p = p.replace("++", "+")  # a possessive end matches the same
        cut = f"SELECT r, unnest(regexp_extract_all(t, {_sql(p)})) AS m, unnest(string_split_regex(t, {_sql(p)})) AS g, generate_subscripts(string_split_regex(t, {_sql(p)}), 1) AS i FROM d"
        ends = f"SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM ({cut}) WHERE m IS NOT NULL"
        found.append(f"SELECT r, {o} AS o, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM ({ends}) WHERE {keep}")
    near = lambda o: f"EXISTS (SELECT 1 FROM f AS y WHERE y.r = x.r AND y.o = {o} AND y.s <= x.s + {scope} AND y.e + {scope} >= x.s)"
    name = f"['{"', '".join(KINDS)}'][o + 1]"
    return (
        f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(found)}), "
        f"g AS (SELECT * FROM f WHERE o < 3 UNION ALL SELECT * FROM f AS x WHERE o = 3 AND ({near(1)} OR {near(4)} AND {near(5)})), "
        f"h AS (SELECT r, o, s, e, {name} || ':' || s || ':' || e AS span FROM g) "
        + f"SELECT doc_id, {', '.join(f'count(*) FILTER (o = {o}) AS n_{k}' for o, k in enumerate(KINDS[:3]))}, sha256(coalesce(string_agg(span, ',' ORDER BY s, o, e) FILTER (o < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, o, e), '') AS spans FROM d LEFT JOIN h USING (r) GROUP BY r, doc_id"
    )


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
