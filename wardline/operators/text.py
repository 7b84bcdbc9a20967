"""Text jobs: observations in notes, identifier leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a note is searched for (name, code, pattern, unit).
NOTE_PATTERNS = (
    ("Platelets", "777-3", r"(?i)platelets?\s*(?:count)?\s*(?:of|=|:)?\s*(\d+(?:\.\d+)?)\s*(x?10\^?9/?[lL])?", "10*9/L"),
    ("Bilirubin", "1975-2", r"(?i)(?:total\s+)?bilirubin\s*(?:of|=|:)?\s*(\d+(?:\.\d+)?)\s*mg/?dL", "mg/dL"),
    ("Creatinine", "2160-0", r"(?i)creatinine\s*(?:of|=|:)?\s*(\d+(?:\.\d+)?)\s*mg/?dL", "mg/dL"),
    ("GCS", "9269-2", r"(?i)(?:GCS|Glasgow\s+Coma\s+Scale)\s*(?:of|=|:)?\s*(\d{1,2})", None),
    ("MAP", "8478-0", r"(?i)(?:MAP|mean\s+arterial\s+pressure)\s*(?:of|=|:)?\s*(\d+(?:\.\d+)?)\s*mmHg", "mmHg"),
)
NOTE_CONFIDENCE = 0.85
# A word that every match of the pattern contains.
NOTE_WORDS = {"Platelets": ("platelet",), "Bilirubin": ("bilirubin",), "Creatinine": ("creatinine",), "GCS": ("gcs", "glasgow"),
              "MAP": ("map", "mean")}

# Identifier patterns that must not appear in shared text.
LEAK_PATTERNS = (
    r"(?i)\bhadm_id\s*[:=]\s*\d+", r"(?i)\bsubject_id\s*[:=]\s*\d+", r"(?i)\bstay_id\s*[:=]\s*\d+",
    r"(?i)data/mimic[\w\-./]*", r"(?i)physionet\.org/files", r"(?i)/files/mimiciv/",
)


def _found(text: Column, match: Column, name: str, code: str, pattern: str, unit: str | None) -> Column:
    # The first occurrence of the matched text is where it matched; its number is read from the match alone.
    start = F.instr(text, match) - 1
    return F.when(match != "", F.struct(
        F.lit(name).alias("display"), F.lit(code).alias("code"),
        F.regexp_extract(match, pattern, 1).cast("double").alias("value"), F.lit(unit).alias("unit"),
        start.alias("span_start"), (start + F.length(match)).alias("span_end"), match.alias("span_text"),
        F.lit(NOTE_CONFIDENCE).alias("confidence")))


def extract_notes(notes: DataFrame, text: str = "text") -> DataFrame:
    """First mention of each measurement as an array, with an abstain status when there is none."""
    # Each text is searched once per pattern; a projection of its own keeps the matches from being redone.
    # Every pattern needs one of its words, and looking for a word is far cheaper than the pattern.
    notes = notes.withColumn("_lower", F.lower(F.coalesce(text, F.lit(""))))
    matches = {}
    for i, (name, _, pattern, _) in enumerate(NOTE_PATTERNS):
        worth = F.lit(False)
        for word in NOTE_WORDS[name]:
            worth = worth | F.contains("_lower", F.lit(word))
        matches[f"_m{i}"] = F.when(worth, F.regexp_extract(text, pattern, 0)).otherwise("")
    notes = notes.withColumns(matches)
    found = F.array_compact(F.array(*[_found(F.col(text), F.col(m), *p) for m, p in zip(matches, NOTE_PATTERNS)]))
    return notes.withColumn("observations", found).drop(*matches, "_lower").withColumn(
        "extraction_status", F.when(F.size("observations") == 0, "abstain").otherwise("ok"))


def note_observations(extracted: DataFrame, keys: list[str]) -> DataFrame:
    """One row per extracted observation with its position in the note."""
    # The outer form keeps the optimizer from computing the matches once more in a filter below.
    rows = extracted.select(*keys, F.posexplode_outer("observations").alias("index", "o")).where(F.col("index").isNotNull())
    return rows.select(*keys, "index", "o.*")


def leak_hits(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per text and leak pattern it contains."""
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(p)) for p in LEAK_PATTERNS]))
    return rows.select(*keys, F.explode(hits).alias("pattern"))
