"""The pipeline's near-duplicate stage: SimHash blocks and min-wise samples find candidates, and the similarity of the whole shingle sets decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingle_links, simhash
from .common import fresh, saved
from .components import components


def without_copies(docs: DataFrame, words: int = 5, distance: int = 2, blocks: int = 4, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest doc_id; all columns stay.

    Groups are the components over texts whose sets of shingles are at least ``similarity`` alike. Fingerprints at most ``distance`` bits apart are
    candidates and no more: they count repeated shingles, so texts that one run of words or marks dominates share them, whatever else they say. A group holds all that a chain of such steps
    reaches, so a text may go that is less alike than that to the one that stays. Rows without doc_id stay, as do all rows that repeat the doc_id kept. Null, empty and wordless texts are one group.
    The columns of ``docs`` may have any names.
    """
    prints = simhash.near_duplicates(docs, words, distance, blocks, doc_id=doc_id, text=text).where("doc_id is not null")
    prints = saved(prints.select("doc_id", F.col("component_id").alias("group")), "print-groups")
    alike = shingle_links.similar_documents(docs, words, similarity, doc_id=doc_id, text=text, groups=prints)
    (g,) = fresh(docs, 1)
    gone = components(alike).where("node <> root").select(F.col("node").alias(g))
    return docs.join(saved(gone, "near-copies"), F.col(doc_id).cast("long") == F.col(g), "left_anti")
