"""Frozen settings with the validation rules of the data model."""

from __future__ import annotations

import re
from dataclasses import dataclass


class ConfigurationError(ValueError):
    pass


class InvalidQueryError(ValueError):
    pass


class CollectionNotFoundError(LookupError):
    pass


class DocumentNotFoundError(LookupError):
    pass


def require(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigurationError(what)


@dataclass(frozen=True)
class ChunkSettings:
    chunk_size: int = 1000
    chunk_overlap: int = 200
    min_chunk_size: int = 100

    def __post_init__(self):
        require(self.chunk_size > 0, "chunk_size must be positive")
        require(0 <= self.chunk_overlap < self.chunk_size, "chunk_overlap must be at least 0 and below chunk_size")
        require(self.min_chunk_size > 0, "min_chunk_size must be positive")


#: Recommended chunker and settings for each kind of document.
RECOMMENDED = {
    "general": ("sentence", ChunkSettings(1000, 200)),
    "academic": ("sentence", ChunkSettings(1500, 300)),
    "legal": ("sentence", ChunkSettings(2000, 400)),
    "code": ("fixed", ChunkSettings(800, 100)),
}


def recommended(kind: str = "general") -> tuple[str, ChunkSettings]:
    """The chunker and settings for a kind of document; an unknown kind is treated as general."""
    return RECOMMENDED.get(kind, RECOMMENDED["general"])


@dataclass(frozen=True)
class SourceSettings:
    max_file_size_mb: int = 100
    timeout_seconds: int = 300

    def __post_init__(self):
        require(self.max_file_size_mb > 0, "max_file_size_mb must be positive")
        require(self.timeout_seconds > 0, "timeout_seconds must be positive")


@dataclass(frozen=True)
class EmbeddingSettings:
    model_name: str
    batch_size: int = 32
    max_retries: int = 3

    def __post_init__(self):
        require(bool(self.model_name and self.model_name.strip()), "model_name cannot be empty")
        object.__setattr__(self, "model_name", self.model_name.strip())
        require(self.batch_size > 0, "batch_size must be positive")
        require(self.max_retries >= 0, "max_retries must be non-negative")


@dataclass(frozen=True)
class SearchQuery:
    """A vector query: nearest ``n_results`` among the rows that pass ``where`` and ``where_document``."""

    vector: tuple[float, ...]
    n_results: int = 10
    metric: str = "cosine"
    where: dict | None = None
    where_document: dict | None = None
    min_score: float | None = None

    def __post_init__(self):
        if not self.vector:
            raise InvalidQueryError("a query needs a vector")
        if self.n_results <= 0:
            raise InvalidQueryError("n_results must be positive")


def collection_name(name: str) -> str:
    require(bool(re.fullmatch(r"[A-Za-z0-9_-]+", name)), "a collection name has letters, digits, _ and - only")
    return name
