"""Secret scans with a trigram inverted index.

Each rule is a regular expression with a least length of one group.  From the expression comes a Boolean query over
trigrams; the index has one posting for each trigram (of those that the queries name) and text that holds it.  Postings
are intersected per text, and only candidates are scanned with the expression.  Rules without a mandatory trigram scan
every text.  Everything is a Spark expression; a posting is a few bytes, and a common trigram is no hot key, as postings
meet by text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.base import shielded
from vecloom.llm.trigrams import ALL, trigram_query, trigrams


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  Matches are leftmost and do not overlap; those whose ``group`` is shorter than ``least`` fail."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# The base rules.  A run of hex digits is matched from 24 on at once: runs are maximal, so shorter ones fail.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES
BLOCK = 256


def _key() -> Column:
    # Of text and id: copies of one text stay apart, and equal keys only mean a shared list of candidates.
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index (gram, key) of the lower-case texts, for the trigrams asked for."""
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return docs.where(F.length("text") >= 3).select(_key().alias("key"), low.alias("low")).select("key", F.explode(held).alias("gram"))


def _holds(query: tuple, number: dict[str, int]) -> Column:
    if query[0] == "gram":
        return F.array_contains("grams", number[query[1]])
    parts = [_holds(q, number) for q in query[1:]]
    result = parts[0]
    for part in parts[1:]:
        result = (result & part) if query[0] == "and" else (result | part)
    return result


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """(key, one flag for each rule with a trigram query): the texts whose postings satisfy it."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    queries = {kind: q for kind, q in queries.items() if q != ALL}
    grams = sorted(set().union(*map(trigrams, queries.values())))
    number = {g: i for i, g in enumerate(grams)}
    met = postings(docs, grams).groupBy("key").agg(F.collect_set("gram").alias("grams"))
    flags = met.select("key", *[_holds(q, number).alias(f"_is_{kind}") for kind, q in queries.items()])
    some = F.lit(False)
    for kind in queries:
        some = some | F.col(f"_is_{kind}")
    return flags.where(some)


def _rule_spans(df: DataFrame, rule: Rule, wanted: Column) -> DataFrame:
    """``df`` with a column ``_spans_<kind>``: array of (start, end, kind), empty where ``wanted`` is false.

    Positions are the lengths of the matches and of what lies between them, added up block by block.
    """
    between = F.transform(F.split("text", rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)), F.length)
    tested = whole if rule.group == 0 else F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)), F.length)
    steps = F.arrays_zip(between.alias("gap"), whole.alias("whole"), tested.alias("tested"))

    def block(at: Column) -> Column:
        own = F.slice("_steps", at, BLOCK)
        before = F.aggregate(F.slice("_steps", F.lit(1), at - 1), F.lit(0), lambda n, x: n + x["gap"] + F.coalesce(x["whole"], F.lit(0)))
        return F.struct(own.alias("own"), before.alias("before"))

    df = df.withColumn("_steps", F.when(wanted & F.col("text").rlike(rule.pattern), steps))
    count = F.size("_steps")
    blocks = F.when(count > 1, F.transform(F.sequence(F.lit(1), count, F.lit(BLOCK)), block))
    df = df.withColumn("_blocks", blocks)

    def inside(b: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            start = b["before"] + x["gap"] + F.aggregate(F.slice(b["own"], F.lit(1), i), F.lit(0), lambda n, y: n + y["gap"] + F.coalesce(y["whole"], F.lit(0)))
            return F.struct(start.alias("start"), (start + x["whole"]).alias("end"), x["tested"].alias("tested"))

        return F.transform(b["own"], one)

    found = F.filter(F.flatten(F.transform("_blocks", inside)), lambda s: s["end"].isNotNull() & (s["tested"] >= rule.least))
    named = F.transform(found, lambda s: F.struct(s["start"], s["end"], F.lit(rule.kind).alias("kind")))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return df.withColumn(f"_spans_{rule.kind}", F.coalesce(named, empty)).drop("_steps", "_blocks")


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with a column ``secrets``: array of (start, end, kind), by start and then by the order of the rules.

    Positions are code points, the end is exclusive.  A null or empty text has none.  Rows with equal or null ids and
    repeated rows are each scanned; other columns stay as they are.  ``docs`` must not have a column ``secrets``.
    """
    at = {r.kind: i for i, r in enumerate(rules)}
    own = [c for c in docs.columns]
    found = candidates(docs.select("doc_id", "text"), rules)
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")
    df = docs.select(_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"), row).join(found, "key", "left")
    for rule in rules:
        flag = f"_is_{rule.kind}"
        wanted = F.coalesce(flag, F.lit(False)) if flag in found.columns else F.lit(True)
        df = _rule_spans(df, rule, wanted)

    def ranked(rule: Rule) -> Column:
        rank = F.lit(at[rule.kind]).alias("rank")
        return F.transform(f"_spans_{rule.kind}", lambda s: F.struct(s["start"], rank, s["end"], s["kind"]))

    spans = F.concat(*map(ranked, rules))
    ordered = F.transform(F.array_sort(spans), lambda s: F.struct(s["start"], s["end"], s["kind"]))
    return df.select("_row.*", ordered.alias("secrets"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find_secrets``: one row for each row of it."""
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    return found.select(
        "doc_id",
        *[F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )


def redact(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``find_secrets`` with every secret of ``text`` replaced by ``mark``; overlapping ones become one mark.

    Texts without secrets, null and empty ones among them, and all other columns, whatever their names, stay as they are.
    """
    return shielded(found, ("_cuts",), lambda rows: _redact(rows, mark))


def _redact(found: DataFrame, mark: str) -> DataFrame:
    merged = F.aggregate(
        "secrets",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]),
            F.concat(
                F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    df = found.withColumn("_cuts", F.when(F.size("secrets") > 0, merged))
    starts = F.concat(F.array(F.lit(0)), F.transform("_cuts", lambda c: c["end"]))
    ends = F.concat(F.transform("_cuts", lambda c: c["start"]), F.array(F.length("text")))
    kept = F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), a + 1, b - a))
    return df.withColumn("text", F.when(F.size("secrets") > 0, F.array_join(kept, mark)).otherwise(F.col("text"))).drop("_cuts")
