"""Personal data by weak-supervision aggregation, in DataFrame functions only.

Matches of four base kinds are always reported. Other candidate shapes (local phone numbers, national ids, account
numbers, birth dates, names after a title, long numbers that fail the card's checksum) are weak. Six labelers vote -1, 0
or 1 on every candidate: shape, gazetteer, cue words before it, counter-cues before it, personal data elsewhere in the
document, checksum or grammar. Counts of vote patterns and context (the word before, hashed to CONTEXTS buckets) over all
candidates of all documents feed an expectation-maximisation for the labelers' reliabilities, in which base matches with no
vote against them are certain; its posteriors are the soft labels on which a logistic span classifier of kind, votes and
context is fitted. Weak candidates that it accepts become spans; base matches that it doubts stay spans and are named
apart (`doubtful`), so that a reader may leave them out.

The tables that reach the driver have a row for each kind, vote pattern and context: at most 10 x 3^6 x 16 at any input size.

Defined cases: null text counts as empty; repeated rows get the same spans; without candidates nothing is added; an
empty table gives no rows. Places are code points, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import before, let, listed, matched, quoted, text_of, written

KINDS = ("email", "ip", "card", "phone", "local_phone", "national_id", "account", "birth_date", "name", "number")
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
LUHN = "aggregate(sequence(1, length(d)), 0L, (a, i) -> a + {x}) % 10 = 0".format(x=let("CAST(substring(d, -i, 1) AS INT) * (2 - i % 2)", "v", "v DIV 10 + v % 10"))
CARD = let("regexp_replace(m, '[^0-9]', '')", "d", f"length(d) BETWEEN 14 AND 19 AND {LUHN}")
DIGITS = "length(regexp_replace(m, '[^0-9]', ''))"
#: Possessive loops and the look-behind change no match; they keep time linear and the stack flat on any text.
BASE = (
    (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", f"m rlike {quoted(rf'^{OCTET}(?:\.{OCTET}){{3}}$')}"),
    (r"[0-9](?:[\x20-]?[0-9])++", f"length(m) BETWEEN 14 AND 37 AND {CARD}"),
    (r"\+[0-9][\x20().0-9-]+[0-9]", f"{DIGITS} BETWEEN 10 AND 15"),
)
WEAK = (
    (r"(?<![0-9+(-])(?<![+][0-9]{1,3}[\x20.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", "true"),
    (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "true"),
    (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])", "true"),
    (r"(?<![0-9./-])[0-3]?[0-9][./-][0-3]?[0-9][./-](?:19|20)[0-9]{2}(?![0-9])", "true"),
    (r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?", "true"),
    (r"(?<![0-9A-Za-z.+-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![0-9A-Za-z-])", f"NOT ({CARD})"),
)
SHAPES = (
    "m rlike '[.][A-Za-z]{2,}$'",
    "m rlike '^0*(?:[1-9][0-9]?|1[0-9][0-9]|2[01][0-9]|22[0-3])[.]'",
    "m rlike '^[3-6]'",
    f"{DIGITS} BETWEEN 10 AND 13",
    "m rlike '^[(]?[2-9]'",
    "NOT m rlike '^(?:000|666|9)' AND NOT m rlike '-00-|-0000$'",
    "m rlike '^(?:AD|AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)'",
    "m rlike '^(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|1[0-2])[./-]|^(?:0?[1-9]|1[0-2])[./-](?:0?[1-9]|[12][0-9]|3[01])[./-]'",
    "NOT m rlike ' (?:The|And|Der|Die|Das|Le|La|El)$'",
    "m rlike '^[3-6]'",
)
#: Whether a kind's own checksum or grammar speaks for it (2), against it (0), or there is none (1).
CHECKED = (2, 2, 2, 2, 1, 1, 1, 1, 1, 0)
GAZETTEER = "(?i)example[.](?:com|net|org)|mail|gmail|555[ .-]|anna|maria|john|james|mary|peter|paul|jean|marie|jose|carlos|thomas|michael"
CUES = "(?i)(?:phone|tel|call|fax|mobile|ssn|social|security|iban|account|konto|compte|cuenta|born|birth|dob|geboren|nacid|name|contact|mail|patient|customer|card|visa|address)[^A-Za-z]{0,12}$"
COUNTER = "(?i)(?:order|invoice|version|isbn|serial|part|page|item|ticket|issue|rfc|release|build|commit|total|amount)[^A-Za-z]{0,12}$"
LABELERS, CONTEXTS = 6, 16
#: Codes of votes and context of one kind.
CODES = 3**LABELERS * CONTEXTS


def _votes(kind: int) -> str:
    """SQL of the labelers' votes as digits in base 3, and above them the context; the fifth vote, on the document, is added later."""
    votes = {0: f"CASE WHEN {SHAPES[kind]} THEN 2 ELSE 0 END", 1: f"CASE WHEN m rlike {quoted(GAZETTEER)} THEN 2 ELSE 1 END", 2: f"CASE WHEN right(g, 40) rlike {quoted(CUES)} THEN 2 ELSE 1 END", 3: f"CASE WHEN right(g, 40) rlike {quoted(COUNTER)} THEN 0 ELSE 1 END", 5: str(CHECKED[kind])}
    before = f"lower(regexp_extract(right(g, 24), {quoted(r'([A-Za-z]+)[^A-Za-z]*$')}, 1))"
    return " + ".join([*(f"{3**j} * ({v})" for j, v in votes.items()), f"{3**LABELERS} * CAST(pmod(xxhash64({before}), {CONTEXTS}) AS INT)"])


def candidates(docs: DataFrame, *keep: str | Column, unit: str = "length") -> DataFrame:
    """keep, base and weak: arrays of struct(s, o, e, v); v holds the votes. unit: see matched()."""
    df = docs.withColumn("t_", text_of(docs))
    spans = [matched("t_", p, k, o, _votes(o), unit) for o, (p, k) in enumerate(BASE + WEAK)]
    df = df.select(*keep, F.expr(f"concat({', '.join(spans[:4])})").alias("base"), F.expr(f"concat({', '.join(spans[4:])})").alias("weak"))
    elsewhere = lambda c, n: F.expr(f"transform({c}, x -> struct(x.s AS s, x.o AS o, x.e AS e, x.v + {3**4} * (CASE WHEN size(base) > {n} THEN 2 ELSE 1 END) AS v))")
    return df.withColumns({"base": elsewhere("base", 1), "weak": elsewhere("weak", 0)})


def votes_of(code: int) -> list[int]:
    return [code // 3**j % 3 for j in range(LABELERS)]


def certain(kind: int, code: int) -> bool:
    """A base match with no vote against it."""
    return kind < 4 and 0 not in votes_of(code)


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = 50) -> dict[tuple[int, int], float]:
    """The posterior of each (kind, votes) by expectation-maximisation over counts.

    A labeler has a distribution of its vote among true spans and one among false ones.
    """
    merged: dict[tuple[int, int], int] = {}
    for (kind, code), n in counts.items():
        key = (kind, code % 3**LABELERS)
        merged[key] = merged.get(key, 0) + n
    votes = {key: votes_of(key[1]) for key in merged}
    free = [k for k in merged if not certain(*k)]
    post = {k: 1.0 if certain(*k) else min(0.95, max(0.05, 0.5 + 0.2 * sum(x - 1 for x in v))) for k, v in votes.items()}
    for _ in range(rounds):
        table = [[[1.0, 2.0, 1.0] for _ in range(LABELERS)] for _ in (0, 1)]
        mass = [2.0, 2.0]
        for k, n in merged.items():
            for truth, w in ((1, n * post[k]), (0, n * (1 - post[k]))):
                if not certain(*k):
                    mass[truth] += w
                for j, x in enumerate(votes[k]):
                    table[truth][j][x] += w
        total = [[sum(row) for row in side] for side in table]
        for k in free:
            odds = math.log(mass[1] / mass[0]) + sum(math.log(table[1][j][x] / total[1][j]) - math.log(table[0][j][x] / total[0][j]) for j, x in enumerate(votes[k]))
            post[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return {(kind, code): post[kind, code % 3**LABELERS] for kind, code in counts}


def classifier(counts: dict[tuple[int, int], int], post: dict[tuple[int, int], float], steps: int = 200) -> dict[tuple[int, int], float]:
    """The probabilities of a logistic model of kind, votes and context, fitted to the posteriors by gradient steps."""

    def features(key: tuple[int, int]) -> list[int]:
        first = len(KINDS) + 3 * LABELERS
        return [key[0], *(len(KINDS) + 3 * j + x for j, x in enumerate(votes_of(key[1]))), first + key[1] // 3**LABELERS]

    weight, at = [0.0] * (len(KINDS) + 3 * LABELERS + CONTEXTS), {k: features(k) for k in counts}
    score = lambda k: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight[i] for i in at[k])))))
    # the root of a count: a frequent base kind must not drown the rare ones
    share = {k: math.sqrt(n) for k, n in counts.items()}
    total = sum(share.values()) or 1.0
    for _ in range(steps):
        slope = [1e-3 * w for w in weight]
        for k, n in share.items():
            gap = (score(k) - post[k]) * n / total
            for i in at[k]:
                slope[i] += gap
        weight = [w - 2.0 * d for w, d in zip(weight, slope, strict=True)]
    return {k: score(k) for k in counts}


def judged(found: DataFrame) -> tuple[list[int], list[int]]:
    """Codes CODES * kind + votes and context of the weak candidates that the classifier accepts, and of the base matches that it doubts."""
    rows = found.select(F.explode(F.expr("concat(base, weak)")).alias("x")).groupBy("x.o", "x.v").count().collect()  # at most 10 x 3^6 x 16
    counts = {(r["o"], r["v"]): r["count"] for r in sorted(rows)}
    scores = classifier(counts, reliabilities(counts)) if not all(certain(*k) for k in counts) else {}
    return sorted(CODES * o + v for (o, v), p in scores.items() if o >= 4 and p >= 0.5), sorted(CODES * o + v for (o, v), p in scores.items() if o < 4 and p < 0.5)


def scan(docs: DataFrame, *keep: str, unit: str = "length") -> DataFrame:
    """keep, base, spans and doubtful (those of base) of every document: arrays of struct(s, o, e); o is the place in KINDS."""
    found = written(candidates(docs, *keep, unit=unit))
    accepted, doubted = (f"CAST(array({', '.join(map(str, codes))}) AS array<int>)" for codes in judged(found))
    plain = lambda a: f"transform({a}, x -> struct(x.s AS s, x.o AS o, x.e AS e))"
    more = plain(f"filter(weak, x -> array_contains({accepted}, {CODES} * x.o + x.v))")
    doubtful = plain(f"filter(base, x -> array_contains({doubted}, {CODES} * x.o + x.v))")
    return found.select(*keep, *[F.expr(f"array_sort({sql})").alias(name) for name, sql in (("base", plain("base")), ("spans", f"concat({plain('base')}, {more})"), ("doubtful", doubtful))])


def op3_pii(docs: DataFrame) -> DataFrame:
    count = [F.expr(f"CAST(size(filter(base, x -> x.o = {o})) AS BIGINT)").alias(f"n_{k}") for o, k in enumerate(KINDS[:4])]
    return scan(docs, "doc_id").select("doc_id", *count, F.sha2(F.expr(listed("base", KINDS)), 256).alias("base_sha256"), *[F.expr(listed(c, KINDS)).alias(c) for c in ("spans", "doubtful")])


def stage(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in brackets, n_chars (where there is one) made to fit; other columns as they are."""
    names = f"array({', '.join(quoted(f'[{k.upper()}]') for k in KINDS)})"
    found = scan(docs.select(F.struct("*").alias("row_"), "text"), "row_", unit="octet_length")
    # overlapping spans: the later one starts where those before it have ended, and vanishes where nothing is left of it.
    # Bytes are cut, as Spark counts a text's code points from its beginning each time.
    piece = f"CASE WHEN x.e > get(p_, i) THEN concat(CAST(substring(b_, get(p_, i) + 1, greatest(x.s - get(p_, i), 0)) AS STRING), {names}[x.o]) ELSE '' END"
    rest = "CAST(substring(b_, array_max(transform(spans, x -> x.e)) + 1) AS STRING)"
    ends = before("transform(spans, x -> x.e)", "greatest(s, y)")
    clean = let("CAST(row_.text AS BINARY)", "b_", let(ends, "p_", f"concat(array_join(transform(spans, (x, i) -> {piece}), ''), {rest})"))
    text = F.expr(f"CASE WHEN size(spans) = 0 THEN row_.text ELSE {clean} END")
    out = found.withColumn("row_", F.col("row_").withField("text", text))
    if "n_chars" in docs.columns:
        out = out.withColumn("row_", F.col("row_").withField("n_chars", F.when(F.size("spans") > 0, F.length("row_.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row_.n_chars"))))
    return out.select("row_.*")
