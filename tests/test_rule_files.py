"""Rule bundles in files are used only when name and content agree."""

import json

from wardline.sources import rule_files as RF

SCORERS = ("sofa",)


def body(**changes):
    whole = {"bundle_id": "a", "version": "1.0.0", "indicator": "x", "score": {"type": "sofa"}} | changes
    return json.dumps({k: v for k, v in whole.items() if v is not None}, indent=1)


def test_folder_of_bundles(spark, tmp_path):
    """Files in sub-folders count, so that a version can be there twice; an empty file has no row."""
    (tmp_path / "bundles" / "old").mkdir(parents=True)
    for name, text in {
        "a.v1.0.0.json": body(), "b.v1.0.0.json": body(bundle_id="b"), "old/b.v1.0.0.json": body(bundle_id="b"), "a.v1.1.0.json": body(),
        "a.v2.json": body(version="2"), "a.v1.2.0.json": "{", "a.v1.3.0.json": "", "a.json": body(), "a.v1.4.0.json": body(version="1.4.0", score=None),
        "a.v1.5.0.json": body(version="1.5.0", score={"type": ""}), "a.v1.6.0.json": body(version="1.6.0", score={"type": "guess"}),
        "c.v1.0.0.json": body(), "a.v1.7.0-rc+b1.json": body(version="1.7.0-rc+b1"), "a.v1.8.0.json": body(version=None), "a.v1.9.0.json": "[1]",
    }.items():
        (tmp_path / "bundles" / name).write_text(text)
    checked = RF.checked_bundles(RF.read_rule_files(spark, str(tmp_path / "bundles")), SCORERS)
    got = {}
    for r in checked.collect():
        got.setdefault(r["name"], []).append(r["error"])
    assert got == {
        "a.v1.0.0.json": [None], "b.v1.0.0.json": ["duplicate_version"] * 2, "a.v1.1.0.json": ["version_mismatch"], "a.v2.json": ["bad_version"],
        "a.v1.2.0.json": ["malformed"], "a.json": ["file_name"], "a.v1.4.0.json": ["missing:score"],
        "a.v1.5.0.json": ["no_score_type"], "a.v1.6.0.json": ["unknown_scorer"], "c.v1.0.0.json": ["bundle_mismatch"], "a.v1.7.0-rc+b1.json": [None],
        "a.v1.8.0.json": ["missing:version"], "a.v1.9.0.json": ["malformed"]}

    (tmp_path / "activation.json").write_text(json.dumps({"active": {"a": "1.0.0", "b": "1.0.0", "d": "1.0.0"}}))
    active = RF.read_activation(spark, str(tmp_path / "activation.json"))
    report = {r["bundle_id"]: r["verdict"] for r in RF.activation_report(checked, active).collect()}
    assert report == {"a": "ok", "b": "duplicate_version", "d": "not_found"}
    (tmp_path / "empty.json").write_text("{}")
    assert RF.read_activation(spark, str(tmp_path / "empty.json")).count() == 0
