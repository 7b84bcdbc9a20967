"""Deterministic identifiers and content hashes as column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_uuid(raw: Column) -> Column:
    """Name-based UUID (version 3, no namespace) of a string."""
    h = F.md5(raw)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("3"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def _text(c: Column | None, missing: str = "") -> Column:
    return F.coalesce(c.cast("string"), F.lit(missing))


def _millis(us: Column) -> Column:
    return F.call_function("div", us, F.lit(1000))


def alert_id(patient: Column, encounter: Column, indicator: Column, score: Column, event_us: Column,
             version: Column) -> Column:
    """Same score of the same patient at the same millisecond is the same alert."""
    ms = _millis(event_us)
    return F.concat(
        F.lit("alert-"),
        name_uuid(
            F.concat_ws(
                "|", _text(patient, "null"), _text(encounter),
                F.coalesce(indicator, F.lit("sofa-deterioration")), _text(score, "null"),
                ms.cast("string"), _text(version),
            )
        ),
    )


def episode_id(patient: Column, encounter: Column, opened_us: Column, first_signal: Column) -> Column:
    ms = _millis(opened_us).cast("string")
    return F.concat(
        F.lit("episode-"),
        name_uuid(F.concat_ws("|", patient, _text(encounter), ms, first_signal)),
    )


def delivery_key(path: Column, kind: Column, rid: Column, version: Column) -> Column:
    """Key of one stored resource version."""
    raw = F.concat_ws("|", path, _text(kind), _text(rid), F.coalesce(version, F.lit("0")))
    return F.substring(F.sha2(raw, 256), 1, 32)


def semver(c: Column) -> Column:
    """``major.minor.patch`` as a comparable integer array; build and pre-release parts are dropped."""
    core = F.split(F.split(F.trim(c), r"\+")[0], "-")[0]
    return F.transform(F.split(core, r"\."), lambda p: p.cast("int"))


def semver_key(text: str) -> tuple[int, int, int]:
    core = text.strip().split("+", 1)[0].split("-", 1)[0].split(".")
    if len(core) != 3:
        raise ValueError(f"not a semantic version: {text!r}")
    return tuple(int(p) for p in core)  # type: ignore[return-value]


def canonical_hash(document: dict) -> str:
    """Hash of a small configuration document, independent of key order."""
    text = json.dumps(document, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()
