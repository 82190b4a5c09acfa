"""Sinks: Parquet tables, JSON records, manifests with digests of their inputs."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, *, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def file_sha256(path: str | Path, block: int = 1 << 20) -> str:
    """SHA-256 of a local file in blocks; a folder (a table) has the digest of its files' names and digests."""
    path = Path(path)
    digest = hashlib.sha256()
    if path.is_dir():
        for part in sorted(p for p in path.rglob("*") if p.is_file()):
            digest.update(f"{part.relative_to(path)}:{file_sha256(part, block)}\n".encode())
        return digest.hexdigest()
    with path.open("rb") as handle:
        while data := handle.read(block):
            digest.update(data)
    return digest.hexdigest()


def write_json(record: dict[str, Any], path: str | Path) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(record, indent=2, sort_keys=True, default=str) + "\n", encoding="utf-8")
    return path


def read_json(path: str | Path) -> dict[str, Any]:
    return json.loads(Path(path).read_text(encoding="utf-8"))
