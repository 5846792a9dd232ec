"""Settings: defaults, files, environment, validation."""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from eventide.errors import InvalidConfig
from eventide.schema import DEFAULT_KINDS, DEFAULT_LIMIT, INDEXED_TAGS

GRANULARITIES = ("monthly", "weekly", "yearly")
#: Fragmentation from which a period is rewritten, by strategy.
STRATEGIES = {"aggressive": 0.1, "balanced": 0.2, "lazy": 0.4}


@dataclass(frozen=True)
class StorageConfig:
    path: str = "./events"
    max_records_per_file: int = 1_000_000
    write_batch_size: int = 500


@dataclass(frozen=True)
class IndexConfig:
    tags: tuple[str, ...] = INDEXED_TAGS
    granularity: str = "monthly"


@dataclass(frozen=True)
class LogConfig:
    enabled: bool = False
    checkpoint_interval: str = "30 seconds"


@dataclass(frozen=True)
class CompactionConfig:
    fragmentation: float = 0.2
    recommend_ratio: float = 0.1
    max_concurrent: int = 2


@dataclass(frozen=True)
class ShardConfig:
    enabled: bool = False
    count: int = 4
    virtual_nodes: int = 150


@dataclass(frozen=True)
class QueryConfig:
    default_limit: int = DEFAULT_LIMIT
    default_kinds: tuple[int, ...] = DEFAULT_KINDS


@dataclass(frozen=True)
class Config:
    storage: StorageConfig = field(default_factory=StorageConfig)
    index: IndexConfig = field(default_factory=IndexConfig)
    log: LogConfig = field(default_factory=LogConfig)
    compaction: CompactionConfig = field(default_factory=CompactionConfig)
    shard: ShardConfig = field(default_factory=ShardConfig)
    query: QueryConfig = field(default_factory=QueryConfig)

    def validate(self) -> Config:
        """Itself, if its values can be used; else InvalidConfig names all that can't."""
        wrong = []
        if not self.storage.path:
            wrong.append("storage.path is empty")
        if self.storage.max_records_per_file < 1:
            wrong.append("storage.max_records_per_file must be positive")
        if not 1 <= self.storage.write_batch_size <= 10_000:
            wrong.append("storage.write_batch_size must lie in 1..10000")
        if self.index.granularity not in GRANULARITIES:
            wrong.append(f"index.granularity must be one of {', '.join(GRANULARITIES)}")
        if not all(self.index.tags):
            wrong.append("index.tags holds an empty name")
        if not 0 < self.compaction.fragmentation <= 1:
            wrong.append("compaction.fragmentation must lie in (0, 1]")
        if self.shard.enabled and (self.shard.count < 1 or self.shard.virtual_nodes < 1):
            wrong.append("shard.count and shard.virtual_nodes must be positive")
        if self.query.default_limit < 1:
            wrong.append("query.default_limit must be positive")
        if any(not 0 <= k <= 65535 for k in self.query.default_kinds):
            wrong.append("query.default_kinds must lie in 0..65535")
        if wrong:
            raise InvalidConfig("; ".join(wrong))
        return self

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), indent=2))

    @classmethod
    def from_dict(cls, data: Mapping) -> Config:
        """Defaults overlaid with ``data``; unknown names are errors."""
        out = {}
        parts = {f.name: f.default_factory for f in dataclasses.fields(cls)}
        for name, values in data.items():
            if name not in parts:
                raise InvalidConfig(f"unknown section {name}")
            base = parts[name]()
            known = {f.name for f in dataclasses.fields(base)}
            if unknown := set(values) - known:
                raise InvalidConfig(f"unknown setting {name}.{min(unknown)}")
            out[name] = dataclasses.replace(base, **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
        return cls(**out).validate()

    @classmethod
    def load(cls, path: str, environment: Mapping[str, str] | None = None) -> Config:
        """A JSON file, or YAML where its library is there, under EVENTIDE_SECTION_NAME variables."""
        text = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ModuleNotFoundError:
                raise InvalidConfig("reading YAML needs its library; use JSON") from None
            data = yaml.safe_load(text) or {}
        else:
            data = json.loads(text)
        return cls.from_dict(data).with_environment(os.environ if environment is None else environment)

    def with_environment(self, environment: Mapping[str, str]) -> Config:
        data = self.to_dict()
        for section, values in data.items():
            for name, now in values.items():
                raw = environment.get(f"EVENTIDE_{section}_{name}".upper())
                if raw is None:
                    continue
                try:
                    if isinstance(now, bool):
                        values[name] = {"true": True, "1": True, "false": False, "0": False}[raw.lower()]
                    elif isinstance(now, (tuple, list)):
                        values[name] = [type(now[0])(x) if now else x for x in raw.split(",") if x]
                    else:
                        values[name] = type(now)(raw)
                except (KeyError, ValueError):
                    raise InvalidConfig(f"EVENTIDE_{section}_{name}".upper() + f" can't be {raw!r}") from None
        return self.from_dict(data)
