"""Settings from YAML, closed-world: unknown and missing keys raise, and values are checked once, on the driver."""

from __future__ import annotations

from dataclasses import MISSING, dataclass, field, fields
from typing import Any, TypeVar

C = TypeVar("C")


@dataclass(frozen=True)
class DataConfig:
    """Limits and switches of a corpus build."""

    instruction_min_chars: int = 10
    instruction_max_chars: int = 2000
    response_min_chars: int = 10
    response_max_chars: int = 12000
    response_max_lines: int = 300
    near_duplicate: bool = True
    near_duplicate_threshold: float = 0.90
    require_known_license: bool = True
    seed: int = 42
    ratios: tuple[float, ...] = (0.90, 0.05, 0.05)

    def __post_init__(self) -> None:
        if not 0 < self.near_duplicate_threshold <= 1:
            raise ValueError("near_duplicate_threshold must be in (0, 1]")
        if len(self.ratios) != 3 or min(self.ratios) < 0 or abs(sum(self.ratios) - 1) > 1e-9:
            raise ValueError("ratios must be three shares that sum to 1")
        for low, high in (("instruction_min_chars", "instruction_max_chars"), ("response_min_chars", "response_max_chars")):
            if not 0 <= getattr(self, low) <= getattr(self, high):
                raise ValueError(f"{low} must not exceed {high}")


@dataclass(frozen=True)
class TokenizerConfig:
    vocabulary: int = 32_000
    min_count: int = 2
    specials: tuple[str, ...] = ("<PAD>", "<BOS>", "<EOS>", "<UNK>")
    include_instruction: bool = True
    include_input: bool = True
    include_response: bool = True

    def __post_init__(self) -> None:
        if self.vocabulary < 256 + len(self.specials):
            raise ValueError("a byte-level vocabulary needs room for all bytes and the specials")
        if len(set(self.specials)) != len(self.specials) or self.min_count < 1:
            raise ValueError("specials must differ and min_count be positive")


@dataclass(frozen=True)
class TrainingConfig:
    steps: int
    sequence_length: int
    top_rate: float
    least_rate: float = 0.0
    warm_up: int = 0
    batch: int = 8
    extra: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.steps <= 0 or self.sequence_length <= 0 or self.batch <= 0 or not 0 <= self.warm_up <= self.steps or not 0 <= self.least_rate <= self.top_rate:
            raise ValueError("steps, lengths and rates must be positive and in order")


@dataclass(frozen=True)
class ProductionConfig:
    """A corpus build that is published: sizes, shares, and the gates that must be on."""

    minimum_examples: int
    maximum_examples: int
    ratios: tuple[float, ...] = (0.90, 0.05, 0.05)
    difficulty: dict[str, float] = field(default_factory=lambda: {"easy": 0.45, "medium": 0.40, "hard": 0.15})
    require_known_license: bool = True
    benchmark_exclusion: bool = True
    execution_validation: bool = True
    near_duplicate_threshold: float = 0.90

    def __post_init__(self) -> None:
        if not 0 < self.minimum_examples <= self.maximum_examples:
            raise ValueError("minimum_examples must be positive and not exceed maximum_examples")
        for name, shares in (("ratios", self.ratios), ("difficulty", tuple(self.difficulty.values()))):
            if any(x < 0 for x in shares) or abs(sum(shares) - 1) > 1e-9:
                raise ValueError(f"{name} must be shares that sum to 1")
        if not (self.require_known_license and self.benchmark_exclusion):
            raise ValueError("a published corpus needs known licenses and benchmark exclusion")


@dataclass(frozen=True)
class ModelConfig:
    """Shape of a decoder and the special ids of its vocabulary."""

    vocabulary: int = 32_000
    layers: int = 24
    width: int = 768
    heads: int = 12
    hidden: int = 2176
    context: int = 1024
    special_ids: tuple[int, ...] = (0, 1, 2, 3)

    def __post_init__(self) -> None:
        if min(self.vocabulary, self.layers, self.width, self.heads, self.hidden, self.context) <= 0 or self.width % self.heads or (self.width // self.heads) % 2:
            raise ValueError("sizes must be positive, and the width must give every head an even share")
        if len(set(self.special_ids)) != len(self.special_ids) or any(not 0 <= i < self.vocabulary for i in self.special_ids):
            raise ValueError("special ids must differ and lie in the vocabulary")

    @property
    def parameters(self) -> int:
        d = self.width
        return self.vocabulary * d + self.layers * (4 * d * d + 3 * d * self.hidden + 2 * d) + d


def load(kind: type[C], values: dict[str, Any]) -> C:
    """kind from a mapping; lists become tuples."""
    names = {f.name for f in fields(kind)}
    needed = {f.name for f in fields(kind) if f.default is MISSING and f.default_factory is MISSING}
    if unknown := sorted(set(values) - names):
        raise ValueError(f"unknown keys: {', '.join(unknown)}")
    if missing := sorted(needed - set(values)):
        raise ValueError(f"missing keys: {', '.join(missing)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def load_yaml(kind: type[C], path: str, section: str | None = None) -> C:
    import yaml

    with open(path, encoding="utf-8") as f:
        values = yaml.safe_load(f) or {}
    return load(kind, values[section] if section else values)


def license_catalog(spark, sources: list[dict[str, Any]]):
    """(name, license, enabled) of the configured sources, as a dimension table."""
    rows = [(str(s["name"]), s.get("license"), bool(s.get("enabled", True))) for s in sources]
    return spark.createDataFrame(rows, "name string, license string, enabled boolean")
