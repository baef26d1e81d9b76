"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets counts over its whole text, and four ratios from them, in whole units of 1 / UNIT. Quantile sketches of
the ratios are kept per language and source, merged per language and over everything, and turned into fences; a document
outside a fence of its group is rejected. A sketch is a table of counts by bucket: a ratio's bucket is its highest BITS
bits, so a quantile is off by 2 ** (1 - BITS) of its value at most, sketches are merged by adding counts, and the same
documents give the same fences in any order. Groups with too few documents take their language's fences, and small
languages the corpus's. Thresholds are joined back by (lang, source), a table of one row for each group; documents are
scanned once and not exchanged.

Defined cases: null text counts as empty (no words: the base rules reject it); null lang or source is a group of its
own; repeated rows are judged alike; an empty table gives no rows; `stage` returns all columns as they came, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, let, text_of, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
UNIT, BITS = 10_000, 11
#: Ratio: (counts, quantile in hundredths that sets the fence, times its distance from the median, floor of that in units
#: where the group has (nearly) no spread, whether low values are outliers too). Most documents have none of what the last
#: three count, so quartiles say nothing about them; symbols are 0 or many, so a higher quantile would lie among those to
#: be rejected.
RATIOS = {
    "q_word_len": (("word_chars", "n_words"), 75, 6, 1000, True),
    "q_symbols": (("n_symbols", "word_chars"), 90, 3, 100, False),
    "q_dup_lines": (("n_dup_lines", "n_words"), 95, 3, 100, False),
    "q_repeats": (("n_repeat_words", "n_words"), 95, 3, 200, False),
}
WINDOW = 5


def _repeated(windows: str) -> str:
    """SQL: words within windows that occur twice or more, from an array of window hashes."""
    ordered = f"sort_array(transform({windows}, (h, i) -> struct(h, i)))"
    twice = "transform(filter(o, (x, k) -> x.h = get(o, k - 1).h OR x.h = get(o, k + 1).h), x -> x.i)"
    covered = f"aggregate(transform(p, (x, k) -> coalesce(least({WINDOW}, get(p, k + 1) - x), {WINDOW})), 0L, (a, x) -> a + x)"
    return f"CASE WHEN size(array_distinct({windows})) = size({windows}) THEN 0L ELSE {let(ordered, 'o', let(f'sort_array({twice})', 'p', covered))} END"


def measured(docs: DataFrame) -> DataFrame:
    """docs with the columns in COUNTS (longs)."""
    at = ", ".join(f"get(h, i + {k})" for k in range(WINDOW))
    windows = let("transform(w_, x -> xxhash64(x))", "h", f"transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({at}))")
    first = docs.withColumn("t_", text_of(docs)).withColumn("w_", F.array_remove(F.split("t_", SPACE), ""))
    second = first.withColumn("g_", F.expr(f"CASE WHEN size(w_) >= {WINDOW} THEN {windows} ELSE CAST(array() AS array<bigint>) END")).withColumns(
        {
            "n_words": F.size("w_").cast("long"),
            "word_chars": F.length(F.array_join("w_", "")).cast("long"),
            "n_symbols": F.regexp_count("t_", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": F.expr(let(r"filter(split(t_, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')", "l", "CAST(size(l) - size(array_distinct(l)) AS BIGINT)")),
        }
    )
    return second.withColumn("n_repeat_words", F.expr(_repeated("g_"))).drop("t_", "w_", "g_")


def base_failed() -> F.Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


def ratio(name: str) -> str:
    """SQL of a ratio in units; null without words."""
    (above, below), *_ = RATIOS[name]
    return f"CASE WHEN {below} > 0 THEN ({UNIT} * {above}) DIV {below} END"


def sketched(counted: DataFrame) -> DataFrame:
    """lang, source, ratio (its number), low (the least value of the bucket), c: counts of documents that pass the base rules."""
    values = F.array(*[F.expr(ratio(name)) for name in RATIOS])
    good = counted.filter(~base_failed() & (F.col("word_chars") > 0)).select("lang", "source", F.posexplode(values).alias("ratio", "v"))
    low = F.expr(let(f"greatest(0, length(bin(v)) - {BITS})", "e", "shiftleft(shiftright(v, e), e)"))
    return good.groupBy("lang", "source", "ratio", low.alias("low")).agg(F.count(F.lit(1)).alias("c"))


def _quantiles(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, n_<name> (documents) and <name>: an array with a struct(lo, mid, hi) of quantiles for each ratio."""
    merged = sketch.groupBy(*keys, "ratio", "low").agg(F.sum("c").alias("c"))
    each = Window.partitionBy(*keys, "ratio")
    sums = merged.withColumns({"upto": F.sum("c").over(each.orderBy("low")), "n": F.sum("c").over(each)})
    high = F.get(F.array(*[F.lit(q) for _, q, *_ in RATIOS.values()]), F.col("ratio"))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("n") * q, F.col("low")))
    one = sums.groupBy(*keys, "ratio").agg(F.first("n").alias("n"), at(100 - high).alias("lo"), at(F.lit(50)).alias("mid"), at(high).alias("hi"))
    return one.groupBy(*keys).agg(F.max("n").alias(f"n_{name}"), F.transform(F.array_sort(F.collect_list(F.struct("ratio", "lo", "mid", "hi"))), lambda x: x.dropFields("ratio")).alias(name))


def fences(counted: DataFrame, least: int = 200, spread: float = 1.0) -> DataFrame:
    """One row for each (lang, source): the fences of every ratio.

    A fence lies as far from the median as RATIOS says, times `spread`: a multiple of the distance between the median
    and a quantile, or the floor where that is more. Only documents that pass the base rules are counted.
    """
    sketch = written(sketched(counted))
    fine, of_lang, of_all = (written(_quantiles(sketch, keys, name)) for keys, name in ((["lang", "source"], "fine"), (["lang"], "of_lang"), ([], "of_all")))
    of_lang = of_lang.withColumnRenamed("lang", "l_")
    one = fine.join(of_lang, fine["lang"].eqNullSafe(of_lang["l_"])).join(F.broadcast(of_all))  # of_all is one row
    one = one.withColumn("q", F.expr(f"CASE WHEN n_fine >= {least} THEN fine WHEN n_of_lang >= {least} THEN of_lang ELSE of_all END"))
    out = [F.col("lang").alias("lang_"), F.col("source").alias("source_")]
    for k, (name, (_, _, times, floor, both)) in enumerate(RATIOS.items()):
        out.append(F.expr(f"q[{k}].mid + {spread}D * greatest({floor}, {times} * (q[{k}].hi - q[{k}].mid))").alias(f"{name}_most"))
        out.append(F.expr(f"q[{k}].mid - {spread}D * greatest({floor}, {times} * (q[{k}].mid - q[{k}].lo))" if both else "CAST(NULL AS DOUBLE)").alias(f"{name}_least"))
    return one.select(*out)


def judge(docs: DataFrame, least: int = 200, spread: float = 1.0, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, lang, source, COUNTS, base_failed and kept of every document. A group whose documents all fail the base rules has no fences and needs none."""
    counted = written(measured(docs).select(*keep, "lang", "source", *COUNTS))
    # written, so that its size is known: Spark broadcasts it under its threshold, and exchanges no text for it then
    limits = written(fences(counted, least, spread))
    beyond = [f"coalesce({ratio(k)} > {k}_most, false) OR coalesce({ratio(k)} < {k}_least, false)" for k in RATIOS]
    seen = counted.join(limits, counted["lang"].eqNullSafe(limits["lang_"]) & counted["source"].eqNullSafe(limits["source_"]), "left")
    verdict = F.expr(f"NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR {' OR '.join(beyond)})")
    return seen.withColumns({"base_failed": base_failed(), "kept": verdict}).drop("lang_", "source_", *[f"{k}_{end}" for k in RATIOS for end in ("most", "least")])


def op7_quality(docs: DataFrame) -> DataFrame:
    """The digest of every document: doc_id, COUNTS, base_failed, kept."""
    return judge(docs.select("doc_id", "text", "lang", "source"), keep=("doc_id",)).select("doc_id", *COUNTS, "base_failed", "kept")


def stage(docs: DataFrame) -> DataFrame:
    """The kept rows of docs, with all of its columns as they are."""
    packed = docs.select(F.struct("*").alias("row_"), "doc_id", "text", "lang", "source")
    return judge(packed, keep=("row_",)).filter("kept").select("row_.*")


def oracle_sql(least: int = 200) -> str:
    """op7_quality as DuckDB SQL over documents."""
    blank, word = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
    value = lambda name: f"CASE WHEN {RATIOS[name][0][1]} > 0 THEN ({UNIT} * {RATIOS[name][0][0]}) // {RATIOS[name][0][1]} END"
    quantile = lambda q: f"min(low) FILTER (upto * 100 >= n * ({q}))"
    high = f"[{', '.join(str(q) for _, q, *_ in RATIOS.values())}][ratio + 1]"

    def level(name: str, keys: tuple[str, ...]) -> str:
        by = "".join(f"{k}, " for k in keys)
        sums = f"SELECT {by}ratio, low, sum(c) OVER (PARTITION BY {by}ratio ORDER BY low) AS upto, sum(c) OVER (PARTITION BY {by}ratio) AS n FROM (SELECT {by}ratio, low, count(*) AS c FROM b GROUP BY {by}ratio, low)"
        return f"{name} AS (SELECT {by}ratio, any_value(n) AS n, {quantile(f'100 - {high}')} AS lo, {quantile('50')} AS mid, {quantile(high)} AS hi FROM ({sums}) GROUP BY {by}ratio)"

    times, floor = (f"[{', '.join(str(x[k]) for x in RATIOS.values())}][v.ratio + 1]" for k in (2, 3))
    both = f"[{', '.join(str(x[4]).lower() for x in RATIOS.values())}][v.ratio + 1]"
    pick = lambda c: f"CASE WHEN f.n >= {least} THEN f.{c} WHEN l.n >= {least} THEN l.{c} ELSE a.{c} END AS {c}"
    return (
        f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents), "
        f"w AS (SELECT *, list_filter(string_split_regex(t, '{blank}'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM d), "
        f"g AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)), "
        f"p AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g), range({WINDOW}) AS o(k) WHERE c > 1 GROUP BY r), "
        f"m AS (SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, "
        f"CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN p USING (r)), "
        f"e AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m), "
        f"v AS (SELECT *, unnest([{', '.join(map(value, RATIOS))}]) AS v, unnest(range({len(RATIOS)})) AS ratio FROM e), "
        f"b AS (SELECT lang, source, ratio, (v >> greatest(0, length(bin(v)) - {BITS})) << greatest(0, length(bin(v)) - {BITS}) AS low FROM v WHERE NOT base_failed AND word_chars > 0), "
        f"{level('f', ('lang', 'source'))}, {level('l', ('lang',))}, {level('a', ())}, "
        f"q AS (SELECT f.lang, f.source, f.ratio, {pick('lo')}, {pick('mid')}, {pick('hi')} FROM f JOIN l ON f.lang IS NOT DISTINCT FROM l.lang AND f.ratio = l.ratio JOIN a ON f.ratio = a.ratio), "
        f"o AS (SELECT r, bool_or(coalesce(v > mid + greatest({floor}, {times} * (hi - mid)) OR {both} AND v < mid - greatest({floor}, {times} * (mid - lo)), false)) AS beyond FROM v LEFT JOIN q ON v.lang IS NOT DISTINCT FROM q.lang AND v.source IS NOT DISTINCT FROM q.source AND v.ratio = q.ratio GROUP BY r) "
        f"SELECT doc_id, {', '.join(COUNTS)}, base_failed, NOT (base_failed OR beyond) AS kept FROM e JOIN o USING (r)"
    )
