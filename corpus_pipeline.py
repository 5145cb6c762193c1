"""Documents to packed training sequences: five stages, each by one operator of ``tessera.llm``.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first three drop documents, the
fourth cuts repeated strings out of their texts, the last packs what is left.

All stages take the five columns of documents and leave other ones aside, so their names can't clash. A null text counts as empty: no classifier calls it
toxic, the quality rules drop it. A null id is kept as one; among near copies such a row stays only if no row with an id is near. Repeated rows are
judged alike and are near copies of each other. An empty table gives an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, quality, simhash, substrings, toxicity
from tessera.llm.common import table, written
from tessera.llm.queries import WORD_BPE, toxicity_labels

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Only wordless documents are too short. The quality query asks for 50 words, but short clean documents are to stay.
MIN_WORDS = 1
#: Words that a text needs before a rule on shares means something: one line said twice, or an address, is no junk.
RULE_WORDS = {"repeated_words": 30, "letters": 5}
RULES = tuple(quality.from_words(rule, RULE_WORDS.get(rule.name, 0)) for rule in quality.RULES)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    return toxicity.keep_civil(docs.select(*COLUMNS), toxicity_labels(spark, sf_dir))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the cascade of rules keeps; of the base only the least words are left, as a rule tests repeated words."""
    return quality.keep_good(docs.select(*COLUMNS), RULES, min_words=MIN_WORDS, most_repeated=100)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: Jaccard similarity of 0.8 over five-word shingles.

    SimHash and its balls choose the pairs first, and the sets of shingles decide. Copies at 0.8 are 7 bits apart in the median, out of
    reach of a ball, so minimal hashes choose from what is left.
    """
    return simhash.keep_first(docs.select(*COLUMNS), words=5, percent=80)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings that an earlier document has; n_chars is counted anew."""
    kept = substrings.remove_repeats(docs, columns="doc_id long, text string, lang string, source string", carry=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document in sequences of 4096 tokens, a row per piece."""
    return packing.pack(docs, WORD_BPE, 4096, 1)


STAGES = [
    ("toxicity", remove_toxic),
    ("quality_rules", apply_quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", remove_repeated_strings),
    ("best_fit_packing", pack_sequences),
]

#: Tokenizers, fingerprints and models can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
