"""Settings: defaults, then a TOML file, then environment variables ``QUARRY__SECTION__KEY``."""

from __future__ import annotations

import dataclasses
import os
import tomllib
from dataclasses import dataclass, field


@dataclass
class IndexConfig:
    chunk_max_lines: int = 200
    chunk_overlap_pct: int = 25
    doc_chunk_max_lines: int = 40
    max_file_size_kb: int = 512

    def chunking(self) -> dict[str, int]:
        """Arguments of the chunker."""
        return {"max_lines": self.chunk_max_lines, "overlap": self.chunk_overlap_pct, "doc_lines": self.doc_chunk_max_lines}


@dataclass
class EmbeddingConfig:
    backend: str = "hash"
    model: str = ""
    api_key: str = field(default="", repr=False)
    base_url: str = ""
    folder: str = ""
    dim: int = 0
    rpm: int = 0

    def options(self) -> dict:
        """Arguments of the backend: those that it has and that are set."""
        own = {"hash": ("dim",), "onnx": ("model", "folder"), "openai": ("model", "api_key", "base_url", "dim", "rpm"), "ollama": ("model", "base_url", "dim", "rpm")}
        return {k: getattr(self, k) for k in own.get(self.backend, ()) if getattr(self, k)}


@dataclass
class WatchConfig:
    debounce_ms: int = 200
    batch_size: int = 100

    @property
    def quiet(self) -> str:
        return f"{self.debounce_ms} milliseconds"


@dataclass
class Config:
    index: IndexConfig = field(default_factory=IndexConfig)
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    watch: WatchConfig = field(default_factory=WatchConfig)
    data_dir: str = "~/.quarry"

    @property
    def home(self) -> str:
        return os.path.expanduser(self.data_dir)


def _set(config, path: list[str], value) -> None:
    for name in path[:-1]:
        config = getattr(config, name)
    kinds = {f.name: f.type for f in dataclasses.fields(config)}
    if path[-1] not in kinds:
        raise ValueError(f"unknown setting {'.'.join(path)}")
    setattr(config, path[-1], int(value) if kinds[path[-1]] == "int" else value)


def load_config(path: str | None = None, env: dict[str, str] | None = None) -> Config:
    """An explicit file that is missing is an error."""
    config = Config()
    if path is not None:
        with open(path, "rb") as f:
            for section, values in tomllib.load(f).items():
                for key, value in values.items() if isinstance(values, dict) else [(None, values)]:
                    _set(config, [section, key] if key else [section], value)
    for name, value in sorted((os.environ if env is None else env).items()):
        if name.startswith("QUARRY__"):
            _set(config, name.lower().split("__")[1:], value)
    return config
