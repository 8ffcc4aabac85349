"""The raw cache with its manifest, and results cached by what made them."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def file_sha256(path: str | Path, chunk: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(chunk):
            h.update(part)
    return h.hexdigest()


def download(url: str, dest: str | Path, retries: int = 4, wait: Callable[[float], None] = time.sleep) -> dict:
    """Fetch into a temporary file and rename it; waits 2, 4, 8 ... seconds between tries. Returns the provenance."""
    dest = Path(dest)
    dest.parent.mkdir(parents=True, exist_ok=True)
    part = dest.with_name(dest.name + ".part")
    for n in range(retries):
        try:
            with urllib.request.urlopen(url, timeout=120) as r, part.open("wb") as f:  # noqa: S310
                shutil.copyfileobj(r, f, 1 << 20)
                headers = r.headers
            os.replace(part, dest)
            return {"url": url, "etag": headers.get("ETag"), "last_modified": headers.get("Last-Modified"),
                    "fetched_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "bytes": dest.stat().st_size, "sha256": file_sha256(dest)}
        except OSError:
            part.unlink(missing_ok=True)
            if n == retries - 1:
                raise
            wait(2.0 ** (n + 1))
    raise ValueError("retries must be positive")


class Manifest:
    """What the cache holds, by key, in a JSON file with sorted keys."""

    def __init__(self, path: str | Path):
        self.path = Path(path)
        self.entries: dict[str, dict] = json.loads(self.path.read_text()) if self.path.exists() else {}

    def save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        part = self.path.with_name(self.path.name + ".part")
        part.write_text(json.dumps(self.entries, indent=2, sort_keys=True) + "\n")
        os.replace(part, self.path)

    @property
    def vintage(self) -> str:
        """12 hex digits over the hashes of all files; "unknown" for an empty cache."""
        if not self.entries:
            return "unknown"
        pairs = {k: v.get("sha256") for k, v in self.entries.items()}
        return hashlib.sha256(json.dumps(pairs, sort_keys=True).encode()).hexdigest()[:12]


@dataclass(frozen=True)
class Source:
    """A file of the cache: its key in the manifest, where it comes from and its name; an optional one may be missing there."""

    key: str
    url: str
    name: str
    optional: bool = False


def adopt(source: Source, dest: Path) -> dict:
    """The entry of a file that came into the cache by another way."""
    return {"url": source.url, "fetched_at": datetime.now(timezone.utc).isoformat(), "bytes": dest.stat().st_size, "sha256": file_sha256(dest), "note": "adopted pre-existing cache file"}


def fetch(folder: str | Path, sources: list[Source], force: bool = False, get: Callable[..., dict] = download) -> Manifest:
    """Bring the cache up to date: keep files that are there, record those that aren't recorded, forgive optional ones that fail."""
    folder = Path(folder)
    manifest = Manifest(folder / "manifest.json")

    def entry(source: Source) -> dict | None:
        dest = folder / source.name
        here = dest.exists() and dest.stat().st_size > 0
        if here and not force:
            return manifest.entries.get(source.key) or adopt(source, dest)
        try:
            return get(source.url, dest)
        except OSError:
            if not source.optional:
                raise
            return manifest.entries.get(source.key)

    found = {s.key: entry(s) for s in sources}
    manifest.entries |= {k: e for k, e in found.items() if e}
    manifest.save()
    return manifest


def config_hash(values: dict) -> str:
    return hashlib.sha256(json.dumps(values, sort_keys=True, default=str).encode()).hexdigest()[:12]


def cached(spark: SparkSession, folder: str, name: str, vintage: str, settings: dict, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table of that vintage and those settings: read if it was written whole, else built and written."""
    path = f"{folder}/{name}_{vintage}_{config_hash(settings)}.parquet"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if force or not fs.exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def content_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, bytes and sha256 of files, hashed where they lie: the distributed form of the manifest."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def vintage_of(hashes: DataFrame) -> DataFrame:
    """One row: the vintage that a manifest of these (key, sha256) has; "unknown" without any.

    The manifest's digest is over a JSON object with sorted keys; the same text is put together here.
    """
    from pyspark.sql import functions as F

    pair = F.concat(F.lit('"'), "key", F.lit('": "'), "sha256", F.lit('"'))  # keys are plain names
    pairs = F.array_sort(F.collect_list(F.struct("key", pair.alias("pair"))))
    text = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda x: x["pair"]), ", "), F.lit("}"))
    return hashes.agg(F.when(F.count(F.lit(1)) == 0, "unknown").otherwise(F.substring(F.sha2(text, 256), 1, 12)).alias("vintage"))


def keyed(hashes: DataFrame) -> DataFrame:
    """content_hashes with the key that each file has in a manifest: its name without what follows the first dot."""
    from pyspark.sql import functions as F

    return hashes.select(F.substring_index(F.element_at(F.split("path", "/"), -1), ".", 1).alias("key"), "bytes", "sha256")
