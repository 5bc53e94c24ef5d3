"""Labelled accuracy cases from YAML files."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

CASE = "id string, text string, language string, expected array<struct<type:string,text:string>>, description string"


def read_cases(spark: SparkSession, folder: str, languages: list[str] | None = None) -> DataFrame:
    """All cases of a folder's *.yaml files, checked, filtered by language if asked, by id. The folder is the driver's: cases are a small, hand-written set."""
    rows = []
    for path in sorted(Path(folder).glob("*.yaml")):
        tree = yaml.safe_load(path.read_text()) or []
        for case in tree.get("test_cases", tree.get("cases", [])) if isinstance(tree, dict) else tree:
            if not all(isinstance(case.get(k), str) for k in ("id", "text", "language")) or not isinstance(case.get("expected"), list):
                raise ValueError(f"{path.name}: a case needs id, text, language and expected")
            expected = [(e["type"], e["text"]) for e in case["expected"]]
            if not languages or case["language"] in languages:
                rows.append((case["id"], case["text"], case["language"], expected, case.get("description")))
    return spark.createDataFrame(sorted(rows, key=lambda r: r[0]), CASE)
