"""Documents to token ids in five stages: quality rules, near-duplicates, personal data, mix, byte-level BPE.

Each stage works on all that the stage before has kept; all but the last return the columns of documents. Null texts count as empty and are
rejected by the first stage, as are other texts of under 20 words; null ids, sources and languages pass through. Very long texts are read whole.
Rows alike in id and text are one to the second stage. Extra columns, whatever their names, come out of all stages but the last as they
went in. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import bpe, mixing, privacy, quality, simhash
from siftline.llm.common import dropped, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are far from every language go."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by their fingerprints, the one with the least doc_id stays."""
    return simhash.first_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; terms that disclose it are generalised or removed."""
    return privacy.sanitised(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out so that the sources interleave by their weights. The layout, and the rule told with it, are what token_ids goes by."""
    return mixing.in_mix_order(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded bytes, and its place in the mix.

    Documents' columns have no room for the mix, so it comes as the order of rows in the files that source_mix has laid out, and is told here:
    slot, place within the slot's block and balanced. Rows by slot and place, up to where balanced ends, are the mix. Documents
    that source_mix hasn't laid out are in no mix; their slot and place are null.
    """
    return bpe.tokenised(mixing.laid_slots(docs), ["doc_id", "source", "slot", "place", "balanced"])


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: SQL has neither XXH64 nor the merge loop; tests hold the whole pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents. Each result is a table in the shared folder; it goes when the next is written, the last one stays for the rows returned."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
