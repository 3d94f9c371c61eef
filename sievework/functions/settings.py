"""Time stamps of runs, and digests of the driver's files."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Seoul"


def file_digest(path: str) -> str:
    """SHA-256 of a file of the driver."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def stamp(at: Column, zone: str = ZONE) -> Column:
    """yyyymmdd_HHMMSS in a zone, of a timestamp without zone that is in UTC."""
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyyMMdd_HHmmss")
