"""The corpus queries, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.llm.bagminhash import near_duplicates
from tidewatch.llm.common import read
from tidewatch.llm.decontaminate import CONTAMINATION_SQL, contamination
from tidewatch.llm.fuzzylines import deduplicate_lines
from tidewatch.llm.langid import identify
from tidewatch.llm.merkle import fingerprint_documents
from tidewatch.llm.mixing import mix
from tidewatch.llm.negatives import NEGATIVES_SQL, hard_negatives
from tidewatch.llm.quality import quality
from tidewatch.llm.ranked import RANKED_SQL, ranked
from tidewatch.llm.sharding import shard_documents
from tidewatch.llm.suffixdedup import REPEATS_SQL, remove_repeats
from tidewatch.llm.toxicity import classify
from tidewatch.llm.urlrank import JUDGE_SQL, judge, rule_table


def op1_quality(spark, folder):
    return quality(read(spark, folder, "documents"), read(spark, folder, "labels")).drop("key")


def op2_sharding(spark, folder):
    return shard_documents(read(spark, folder, "documents"))


def op3_fingerprints(spark, folder):
    return fingerprint_documents(read(spark, folder, "documents"))


def op4_repeats(spark, folder):
    return remove_repeats(read(spark, folder, "documents"))


def op5_lines(spark, folder):
    return deduplicate_lines(read(spark, folder, "documents"))


def op6_mixing(spark, folder):
    return mix(read(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark, folder):
    return classify(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op8_url_filter(spark, folder):
    judged = judge(read(spark, folder, "pages"), rule_table(spark))
    # The last digits of a sum depend on its order.
    return judged.withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})


def op9_near_duplicates(spark, folder):
    return near_duplicates(read(spark, folder, "documents")).drop("key")


def op10_decontamination(spark, folder):
    return contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op11_language(spark, folder):
    return identify(read(spark, folder, "documents"))


def op12_hard_negatives(spark, folder):
    return hard_negatives(read(spark, folder, "embeddings"))


def op13_ranked_search(spark, folder):
    return ranked(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_sharding": op2_sharding,
    "op3_fingerprints": op3_fingerprints,
    "op4_repeats": op4_repeats,
    "op5_lines": op5_lines,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_url_filter": op8_url_filter,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_decontamination": op10_decontamination,
    "op11_language": op11_language,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL: dict[str, str] = {
    "op4_repeats": REPEATS_SQL,
    "op8_url_filter": JUDGE_SQL,
    "op10_decontamination": CONTAMINATION_SQL,
    "op12_hard_negatives": NEGATIVES_SQL,
    "op13_ranked_search": RANKED_SQL,
}
