"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

import importlib

from .common import table

MODULES = ("packing", "fingerprints", "secrets", "language", "jaccard", "topk", "mixing", "attribution", "warc", "licenses")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= {k: getattr(_module, k) for k in dir(_module) if k.startswith("op") and k[2:3].isdigit()}
    ORACLE |= getattr(_module, "ORACLE", {})


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
__all__ = ["ORACLE", "QUERIES", "table"]
