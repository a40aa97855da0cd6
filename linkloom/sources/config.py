"""Site list and article rules (A2, A3)."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from linkloom.functions import urls as U

SITE_SCHEMA = "site string, name string, url string, domain string, output_dir string, description string"


def load_article_rules(path: str | None = "blog_config.json") -> U.ArticleRules:
    """A3: rules from ``article_detection`` of a config file.  No readable file ->
    built-in defaults (6 include / 17 exclude); a file missing a key -> that key's
    own default (2 include / 13 exclude)."""
    try:
        if path and Path(path).exists():
            cfg = json.loads(Path(path).read_text()).get("article_detection", {})
            return U.ArticleRules(
                include=list(cfg.get("url_patterns", U.MISSING_KEY_INCLUDE)),
                exclude=list(cfg.get("exclude_patterns", U.MISSING_KEY_EXCLUDE)),
                title_exclude=list(cfg.get("title_exclude_patterns", [])),
                min_title_length=int(cfg.get("min_title_length", 0)),
            )
    except Exception:  # noqa: BLE001 - any unreadable config falls back to defaults
        pass
    return U.ArticleRules()


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """A2: one row per configured site; ``site`` = its output directory name."""
    cfg = json.loads(Path(path).read_text())
    rows = [(b.get("output_dir"), b.get("name"), b.get("url"), b.get("domain"), b.get("output_dir"), b.get("description"))
            for b in cfg.get("blog_paths", [])]
    return spark.createDataFrame(rows, SITE_SCHEMA)


def crawl_limits(path: str) -> dict:
    """max_pages / max_depth of ``crawl_settings`` (the only limits the pipeline reads)."""
    cfg = json.loads(Path(path).read_text()).get("crawl_settings", {})
    return {"max_pages": int(cfg.get("max_pages", 100)), "max_depth": int(cfg.get("max_depth", 3))}
