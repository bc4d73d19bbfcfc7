"""Repository names and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Host that serves pages, host that serves raw files.
PAGE_HOST = "github.com"
RAW_HOST = "raw.githubusercontent.com"


def clone_url(repo: Column) -> Column:
    """Clone URL of ``owner/name``; no login is embedded."""
    return F.concat(F.lit(f"https://{PAGE_HOST}/"), repo, F.lit(".git"))


def base_name(path: Column) -> Column:
    """Last part of a path or of ``owner/name``."""
    return F.element_at(F.split(path, "/"), -1)


def repo_name(url: Column) -> Column:
    """Last part of a URL or path, up to its first dot."""
    return F.split_part(base_name(url), F.lit("."), F.lit(1))


def raw_url(url: Column) -> Column:
    """Raw-file form of a page URL that shows a file; other URLs stay as they are."""
    parts = F.split(url, "/")
    blob = F.array_position(parts, "blob").cast("int")
    rest = F.concat(
        F.slice(parts, F.lit(4), F.greatest(blob - 4, F.lit(0))),
        F.slice(parts, blob + 1, F.greatest(F.size(parts) - blob, F.lit(0))),
    )
    rewritten = F.array_join(
        F.concat(F.slice(parts, 1, 2), F.array(F.lit(RAW_HOST)), rest), "/"
    )
    is_file_page = url.contains(PAGE_HOST) & url.contains("/blob/") & (blob >= 4)
    return F.when(is_file_page, rewritten).otherwise(url)


def content_id(*parts: Column) -> Column:
    """36-character id that depends on the content alone, so reruns agree."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 36)
