"""Settings: defaults, overridden by a TOML file, overridden by arguments."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


@dataclass
class HttpSettings:
    url: str = "http://localhost:11434"
    model: str = "jina-embeddings-v2-base-code"
    timeout: int = 30
    parallelism: int = 8


@dataclass
class EmbeddingSettings:
    model: str | None = None
    provider: str = "cpu"
    device_id: int = 0
    batch_size: int | None = None
    backend: str = "hashing"
    ollama: HttpSettings = field(default_factory=HttpSettings)


@dataclass
class IndexingSettings:
    max_chunk_lines: int = 75
    max_chunk_chars: int = 2000
    overlap_lines: int = 10


@dataclass
class Config:
    embedding: EmbeddingSettings = field(default_factory=EmbeddingSettings)
    indexing: IndexingSettings = field(default_factory=IndexingSettings)


def _merged(into, values: dict):
    for f in fields(into):
        if f.name in values:
            old = getattr(into, f.name)
            setattr(into, f.name, _merged(old, values[f.name]) if hasattr(old, "__dataclass_fields__") else values[f.name])
    return into


def config_path() -> Path:
    return Path.home() / ".lodeseek" / "config.toml"


def load(path: Path | str | None = None) -> Config:
    """A missing file gives the defaults, a partial one fills in the rest, unknown keys are ignored."""
    p = Path(path) if path else config_path()
    return _merged(Config(), tomllib.loads(p.read_text()) if p.exists() else {})


def save(config: Config, path: Path | str) -> None:
    lines: list[str] = []

    def put(name: str, values: dict) -> None:
        lines.append(f"[{name}]")
        for k, v in values.items():
            if v is not None and not isinstance(v, dict):
                lines.append(f"{k} = {v}" if isinstance(v, int) else f'{k} = "{v}"')
        lines.append("")
        for k, v in values.items():
            if isinstance(v, dict):
                put(f"{name}.{k}", v)

    for name, values in asdict(config).items():
        put(name, values)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(lines))
