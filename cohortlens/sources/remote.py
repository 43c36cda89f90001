"""Listings of remote archives that answer in pages of JSON:API documents."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, size bigint, download string"


def fetch_json(url: str, timeout: float = 60) -> dict:
    with urlopen(url, timeout=timeout) as answer:
        return json.load(answer)


def list_remote(url: str, fetch: Callable[[str], dict] = fetch_json, prefix: str = "") -> Iterator[tuple[str, int | None, str | None]]:
    """(path, size, download) of all files below a folder's URL: pages by links.next, folders by their related link.

    A stack takes the place of recursion, and a page that was read is not read again.
    """
    todo, seen = [(url, prefix)], set()
    while todo:
        at, base = todo.pop()
        if at in seen:
            continue
        seen.add(at)
        page = fetch(at)
        following = (page.get("links") or {}).get("next")
        if following:
            todo.append((following, base))
        for item in page.get("data", []):
            about, name = item.get("attributes", {}), item.get("attributes", {}).get("name", "")
            if about.get("kind") == "folder":
                inner = item["relationships"]["files"]["links"]["related"]
                todo.append((inner["href"] if isinstance(inner, dict) else inner, f"{base}{name}/"))
            else:
                yield f"{base}{name}", about.get("size"), (item.get("links") or {}).get("download")


def remote_manifest(spark: SparkSession, url: str, fetch: Callable[[str], dict] = fetch_json) -> DataFrame:
    """path, size, ext, download of a remote folder."""
    rows = spark.createDataFrame(list(list_remote(url, fetch)), SCHEMA)
    return rows.select("path", "size", F.lower(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^.+(\.[^.]+)$", 1)).alias("ext"), "download")
