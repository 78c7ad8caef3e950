"""One query for each operator: whole tables, production parameters, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.base import in_fold, table
from vecloom.llm.bpe import bpe_digest, bpe_round_trip
from vecloom.llm.chat import format_chats, link_calls
from vecloom.llm.decontaminate import find_leaks
from vecloom.llm.fingerprints import fingerprint_edits, likeness, near_fingerprints
from vecloom.llm.html import extract_text
from vecloom.llm.jaccard import jaccard_join
from vecloom.llm.language import fit_language, identify
from vecloom.llm.manifest_sql import OP11_SQL, OP12_SQL
from vecloom.llm.merkle import FIELDS, build_manifest, climb, leaf_digest
from vecloom.llm.quality import fit_quality, score_quality
from vecloom.llm.resample import importance_resample
from vecloom.llm.rules import apply_cutoffs, fit_cutoffs, measure
from vecloom.llm.secrets import find_secrets, secret_digest
from vecloom.llm.toxicity import ToxicModel, fit_toxicity, score_toxicity
from vecloom.session import written

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from folds 1 to 3 (ratios, margin) and 4 (curve) of 5; fold 0 is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = docs.where(F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 5, 0)).join(labelled(spark, sf_dir, "quality"), "doc_id")
    model = fit_quality(learned.select("text", "label", in_fold(F.col("doc_id"), 5, 4).cast("int").alias("part")))
    return score_quality(docs, model).select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from folds 0, 1 and 3 of 4; fold 2 is held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit_language(docs.where(F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 4, 2)).select("text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digest(bpe_round_trip(docs, tokenizer_path()))


def tool_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as tool traffic: an assistant's turn calls a tool, the user's next turn is its result.

    The identifier comes from conversation and round (two turns), the tool from the turn's first letter, and the arguments
    from its size and beginning; turns before the first round and the system's stay plain.
    """
    call = F.col("role") == "assistant"
    result = (F.col("role") == "user") & (F.col("turn") > 1)
    at = F.when(call, F.col("turn")).when(result, F.col("turn") - 1)
    first = F.lower(F.substring("text", 1, 1))
    tool = F.when(first.between("a", "h"), "search").when(first.between("i", "s"), "measure").otherwise("note")
    size = F.length("text")
    found = F.create_map(F.lit("query"), F.substring("text", 1, 40), F.lit("limit"), F.when(size % 7 == 0, F.lit("many")).otherwise(size.cast("string")))
    measured = F.create_map(F.lit("value"), size.cast("string"), F.lit("exact"), (size % 2 == 0).cast("string"))
    noted = F.when(size % 5 == 0, F.create_map(F.lit("body"), F.col("text"))).otherwise(F.create_map(F.lit("text"), F.substring("text", 1, 40)))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(result, F.lit("tool")).otherwise(F.col("role")).alias("role"),
        "text",
        F.when(at.isNotNull(), F.concat(F.lit("call-"), at.cast("string"))).alias("call_id"),
        F.when(call, tool).alias("name"),
        F.when(call, F.when(tool == "search", found).when(tool == "measure", measured).otherwise(noted)).alias("arguments"),
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "name string, required array<string>, kinds map<string,string>"
    tools = spark.createDataFrame(
        [
            ("search", ["query"], {"query": "string", "limit": "integer"}),
            ("measure", ["value"], {"value": "number", "exact": "boolean"}),
            ("note", ["text"], {"text": "string"}),
        ],
        schema,
    )
    lines = format_chats(link_calls(tool_messages(table(spark, sf_dir, "conversations")), tools))
    return lines.select("conv_id", "turn", "place", "role", "call_id", "status", "line")


OP6_SQL = """
with m as (
  select conv_id, turn, case when role = 'user' and turn > 1 then 'tool' else role end as role, text, length(text) as size,
         case when role = 'assistant' then 'call-' || turn when role = 'user' and turn > 1 then 'call-' || (turn - 1) end as call_id,
         case when role = 'assistant' then case when lower(left(text, 1)) between 'a' and 'h' then 'search'
              when lower(left(text, 1)) between 'i' and 's' then 'measure' else 'note' end end as name
  from conversations),
ids as (
  select conv_id, call_id, min(turn) filter (role = 'assistant') as called, min(turn) filter (role = 'tool') as answered
  from m where call_id is not null group by all),
l as (
  select m.*, called, answered from m left join ids using (conv_id, call_id)),
s as (
  select *,
    case when call_id is null then 'ok'
         when role = 'assistant' and ((name = 'search' and size % 7 = 0) or (name = 'note' and size % 5 = 0)) then 'bad_arguments'
         when role = 'assistant' and answered is null then 'unanswered'
         when role = 'tool' and called is null then 'orphan' else 'ok' end as status
  from l)
select conv_id, turn, cast(row_number() over (partition by conv_id order by turn) as integer) as place, role, call_id, status,
  '{' ||
  case when role <> 'assistant' then ''
       when name = 'search' then '"arguments":{"limit":"' || case when size % 7 = 0 then 'many' else size::varchar end || '","query":' || to_json(left(text, 40))::varchar || '},'
       when name = 'measure' then '"arguments":{"exact":"' || case when size % 2 = 0 then 'true' else 'false' end || '","value":"' || size || '"},'
       when size % 5 = 0 then '"arguments":{"body":' || to_json(text)::varchar || '},'
       else '"arguments":{"text":' || to_json(left(text, 40))::varchar || '},' end
  || case when call_id is null then '' else '"call_id":"' || call_id || '",' end
  || '"content":' || to_json(text)::varchar || ','
  || case when role = 'assistant' then '"name":"' || name || '",' else '' end
  || '"role":"' || role || '"}' as line
from s
"""


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_near``: for every id divisible by 20, how many other rows have a fingerprint within the radius."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = written(fingerprint_edits(docs), "fingerprints")
    numbers = made.groupBy(F.col("own").alias("found")).agg(F.count("*").alias("n"))
    asked = made.where("doc_id % 20 = 0").select(F.col("own").alias("fp"))
    near = near_fingerprints(asked, made.select(F.col("own").alias("fp"))).join(numbers, "found")
    same = asked.distinct().join(numbers, F.col("fp") == F.col("found")).select(F.col("fp").alias("query"), (F.col("n") - 1).alias("n"))
    near = near.select("query", "n").unionByName(same).groupBy("query").agg(F.sum("n").alias("n_near"))
    found = made.join(near, F.col("own") == F.col("query"), "left")
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lpad(F.lower(F.hex("own")), 16, "0").alias("fingerprint"),
        F.lpad(F.lower(F.hex("changed")), 16, "0").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
        F.when(F.col("doc_id") % 20 == 0, F.coalesce("n_near", F.lit(0))).alias("n_near"),
    )


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def labelled(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One label for each labelled document, the larger if several are given.

    Labels grow with the documents, so they are always joined by a sorted shuffle, never broadcast.
    """
    labels = table(spark, sf_dir, "labels").where(f"{name} is not null and doc_id is not null")
    return labels.groupBy("doc_id").agg(F.max(name).alias("label")).hint("merge")


def toxicity_model(spark: SparkSession, sf_dir: str) -> ToxicModel:
    """Learned from folds 0, 1 (counts) and 3 (curve) of 4; fold 2 is held out."""
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 4, 2))
    rows = docs.select("doc_id", "text").join(labelled(spark, sf_dir, "toxic"), "doc_id")
    return fit_toxicity(rows.select("text", "label", in_fold(F.col("doc_id"), 4, 3).cast("int").alias("part")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document by crc32 of its id comes back with its text's capitals lower-cased."""
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = leaf_digest(*[lowered if name == "text" else F.col(name) for name in FIELDS])
    return climb(build_manifest(docs, found=F.when(in_fold(F.col("doc_id"), 5, 0), changed)))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata are languages; every labelled document designs or tests, by a hash of its id."""
    measured = written(measure(table(spark, sf_dir, "documents"), keep=["doc_id", "lang"]), "rules-measured")
    kept = apply_cutoffs(measured, fit_cutoffs(measured, labelled(spark, sf_dir, "quality")))
    return kept.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_quality": op2_quality,
    "op3_jaccard": op3_jaccard,
    "op4_language": op4_language,
    "op5_bpe": op5_bpe,
    "op6_chat": op6_chat,
    "op7_fingerprints": op7_fingerprints,
    "op8_html": op8_html,
    "op9_decontaminate": op9_decontaminate,
    "op10_toxicity": op10_toxicity,
    "op11_merkle": op11_merkle,
    "op12_resample": op12_resample,
    "op13_rules": op13_rules,
}
SQL: dict[str, str] = {"op6_chat": OP6_SQL, "op11_merkle": OP11_SQL, "op12_resample": OP12_SQL}
