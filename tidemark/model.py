"""Schemas and settings."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T

MUTATION = T.StructType([
    T.StructField("key", T.BinaryType(), False),
    T.StructField("value", T.BinaryType(), True),
    T.StructField("deleted", T.BooleanType(), False),
    T.StructField("seq", T.LongType(), False),
])

MANIFEST = T.StructType([
    T.StructField("segment_id", T.StringType(), False),
    T.StructField("level", T.IntegerType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("min_key", T.BinaryType(), True),
    T.StructField("max_key", T.BinaryType(), True),
    T.StructField("min_seq", T.LongType(), True),
    T.StructField("max_seq", T.LongType(), True),
    T.StructField("n_entries", T.LongType(), False),
    T.StructField("n_deletes", T.LongType(), False),
    T.StructField("size_bytes", T.LongType(), False),
    T.StructField("max_batch", T.LongType(), False),
])


@dataclass(frozen=True)
class Config:
    """Limits of levels.  Sizes are payload bytes: keys and values."""

    compaction_bytes: int = 256
    levels: int = 4

    def __post_init__(self):
        for f in fields(self):
            if getattr(self, f.name) < 0:
                raise ValueError(f"{f.name} must not be negative")
        if self.levels < 2:
            raise ValueError("levels must be two at least")

    @classmethod
    def from_dict(cls, given: dict) -> Config:
        """Unknown names are an error; missing ones take their default."""
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**given)

    @classmethod
    def from_file(cls, path: str) -> Config:
        """Settings from a file of ``name: number`` lines; text after ``#`` does not count."""
        with open(path, encoding="utf-8") as f:
            lines = [x.partition("#")[0].strip() for x in f]
        return cls.from_dict({k.strip(): int(v) for k, _, v in (x.partition(":") for x in lines if x)})
