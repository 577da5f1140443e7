"""Settings with names, ranges and an environment prefix."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from corvane.errors import ConfigurationError

MODELS, FIELDS, POOLINGS = ("skipgram", "fasttext"), ("abstract", "title"), ("mean", "sif")
PREFIX = "CORVANE_"
#: Largest values that make sense.
MOST = {"top_n": 1000, "vector_size": 1000, "window": 50, "epochs": 100, "buckets": 2_000_000}


@dataclass(frozen=True)
class Settings:
    """Where things lie and how the engine is trained and asked.

    Every field may come from the environment as CORVANE_<NAME>.
    """

    corpus: str = "corpus.csv"
    root: str = "artefacts"
    model: str = "fasttext"
    field: str = "abstract"
    pooling: str = "mean"
    union: bool = True
    top_n: int = 10
    vector_size: int = 100
    window: int = 5
    min_count: int = 2
    epochs: int = 5
    buckets: int = 50_000
    seed: int = 42
    partitions: int = 1
    sif_a: float = 1e-3
    max_artefact_mb: float = 200.0

    def __post_init__(self):
        for name, allowed in (("model", MODELS), ("field", FIELDS), ("pooling", POOLINGS)):
            if getattr(self, name) not in allowed:
                raise ConfigurationError(f"{name} must be one of {allowed}")
        for name in ("top_n", "vector_size", "window", "min_count", "epochs", "buckets", "partitions"):
            if getattr(self, name) < 1:
                raise ConfigurationError(f"{name} must be 1 or more")
        for name, most in MOST.items():
            if getattr(self, name) > most:
                raise ConfigurationError(f"{name} must be {most} or less")
        if not self.sif_a > 0:
            raise ConfigurationError("sif_a must be positive")
        if self.max_artefact_mb <= 0:
            raise ConfigurationError("max_artefact_mb must be positive")

    @classmethod
    def from_env(cls, *, env_file: str = ".env", **given) -> Settings:
        """Settings given, else of the environment, else of ``env_file`` (lines NAME=value), else the defaults."""
        out, filed = {}, {}
        if os.path.exists(env_file):
            with open(env_file, encoding="utf-8") as f:
                lines = [line.strip().removeprefix("export ").partition("=") for line in f if "=" in line and not line.lstrip().startswith("#")]
            filed = {name.strip(): value.strip().strip("'\"") for name, _, value in lines}
        for f in fields(cls):
            name = PREFIX + f.name.upper()
            raw = os.environ.get(name, filed.get(name))
            if given.get(f.name) is not None:
                out[f.name] = given[f.name]
            elif raw is not None:
                kind = type(f.default)
                try:
                    out[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
                except ValueError as e:
                    raise ConfigurationError(f"{name}: {raw!r} is no {kind.__name__}") from e
        return cls(**out)

    def tokens_path(self) -> str:
        return f"{self.root}/tokens"

    def model_path(self, model: str | None = None, field: str | None = None) -> str:
        return f"{self.root}/models/{model or self.model}-{field or self.field}"

    def index_path(self, model: str | None = None, field: str | None = None, pooling: str | None = None) -> str:
        return f"{self.root}/index/{model or self.model}-{field or self.field}{'-sif' if (pooling or self.pooling) == 'sif' else ''}"
