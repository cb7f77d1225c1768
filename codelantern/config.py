"""User-facing options and driver-side settings."""

from __future__ import annotations

import os
from collections.abc import Iterable, MutableMapping
from dataclasses import dataclass, fields
from pathlib import Path

from codelantern import fixed_values as fv


@dataclass(frozen=True)
class FilterConfig:
    """Which files take part in ingestion.  An empty list overrides; ``None`` keeps the default."""

    ignored_directories: tuple[str, ...] = fv.IGNORED_DIRECTORIES
    ignored_extensions: tuple[str, ...] = fv.IGNORED_EXTENSIONS
    ignored_filenames: tuple[str, ...] = fv.IGNORED_FILENAMES
    allowed_code_extensions: tuple[str, ...] = fv.ALLOWED_CODE_EXTENSIONS
    allowed_doc_filenames: tuple[str, ...] = fv.ALLOWED_DOC_FILENAMES
    allowed_doc_extensions: tuple[str, ...] = fv.ALLOWED_DOC_EXTENSIONS
    max_file_size_bytes: int = fv.MAX_FILE_SIZE_BYTES

    @classmethod
    def merged(cls, **overrides: Iterable[str] | int | None) -> FilterConfig:
        known = {f.name for f in fields(cls)}
        unknown = set(overrides) - known
        if unknown:
            raise TypeError(f"unknown filter option(s): {sorted(unknown)}")
        given = {k: v for k, v in overrides.items() if v is not None}
        return cls(**{k: v if isinstance(v, int) else tuple(v) for k, v in given.items()})


@dataclass(frozen=True)
class SearchOptions:
    """Ranking sizes, plus the measured limits under which a side may be broadcast."""

    top_k: int = fv.TOP_K
    top_n: int = fv.TOP_N
    rrf_k: int = fv.RRF_K
    broadcast_rows: int = 50_000
    broadcast_bytes: int = 16 * 1024 * 1024
    listed_repos: int = 1_000
    salts: int = 16
    block_rows: int = 50_000
    block_queries: int = 2_000
    bounded_from: int = 64      # blocks of stored token rows from which score bounds are asked first
    first_blocks: int = 24      # blocks per query that are scored to learn what the others must reach
    listed_blocks: int = 2_000  # blocks that are pushed into a scan as a literal filter


@dataclass(frozen=True)
class GenerationOptions:
    temperature: float = fv.TEMPERATURE
    max_tokens: int = fv.MAX_TOKENS
    model: str | None = None
    allow_multi_hop: bool = True


def load_env(directory: str | Path = ".", env: MutableMapping[str, str] | None = None) -> None:
    """Read ``.env`` then ``.env.local``; a key is set only when absent or a ``your_`` placeholder."""
    env = os.environ if env is None else env
    for name in (".env", ".env.local"):
        path = Path(directory) / name
        if not path.is_file():
            continue
        for raw in path.read_text(encoding="utf-8").splitlines():
            key, sep, value = raw.strip().partition("=")
            key, value = key.strip(), value.strip()
            if not sep or not key or key.startswith("#"):
                continue
            if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            if not env.get(key) or env[key].startswith("your_"):
                env[key] = value


@dataclass(frozen=True)
class EmbeddingSettings:
    """Which embedding to use: provider, models and sizes, as ``EMBEDDING_PROVIDER`` and ``EMBEDDING_MODEL`` name them."""

    provider: str = "local"
    model: str = "hashing"
    fallback: str | None = None
    dimension: int = fv.LOCAL_EMBEDDING_DIM
    batch_size: int = fv.LOCAL_BATCH

    @classmethod
    def from_env(cls, env: MutableMapping[str, str] | None = None) -> EmbeddingSettings:
        """Anything but a name of the cloud service is local.  A retired model stands for the present one."""
        env = os.environ if env is None else env
        if env.get("EMBEDDING_PROVIDER", "").strip().lower() not in fv.CLOUD_PROVIDERS:
            return cls()
        name = env.get("EMBEDDING_MODEL", "").strip() or fv.CLOUD_MODEL
        full = name if name.startswith("models/") else f"models/{name}"
        model = fv.CLOUD_MODEL if full == fv.CLOUD_RETIRED_MODEL else full
        second = fv.CLOUD_MODEL if fv.CLOUD_SECOND_MODEL in model else fv.CLOUD_SECOND_MODEL
        return cls("cloud", model, second, fv.CLOUD_EMBEDDING_DIM, fv.CLOUD_BATCH)


def require_text(name: str, value: object) -> str:
    """Argument check for the public entry points: a non-blank string."""
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a non-empty string")
    return value.strip()
