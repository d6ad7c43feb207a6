"""Settings of the stages, checked when they are made."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass

NO_GENRES = "(no genres listed)"


@dataclass(frozen=True)
class PrepareConfig:
    """Seeds derive from one: +1 for validation negatives, +2 for test negatives, +31 for training negatives."""

    min_interactions: int = 5
    negatives: int = 100
    seed: int = 2026
    max_rows: int | None = None

    def __post_init__(self):
        if self.min_interactions < 1 or self.negatives < 1:
            raise ValueError("min_interactions and negatives must be at least 1")
        if self.max_rows is not None and self.max_rows < 1:
            raise ValueError("max_rows must be positive or None")

    def negative_seed(self, split: str) -> int:
        return self.seed + {"val": 1, "test": 2, "train": 31}[split]


@dataclass(frozen=True)
class TrainConfig:
    model: str = "mf"
    dim: int = 64
    hidden: int = 128
    epochs: int = 1
    batch_size: int = 4096
    steps_per_epoch: int | None = None
    learning_rate: float = 0.01
    l2: float = 1e-5
    weight_decay: float = 1e-5
    seed: int = 2026
    blocks: int = 8

    def __post_init__(self):
        if self.model not in ("mf", "two-tower"):
            raise ValueError("model must be mf or two-tower")
        if self.steps_per_epoch is not None and self.steps_per_epoch < 1:
            raise ValueError("steps_per_epoch must be positive or None")
        if min(self.dim, self.hidden, self.epochs, self.batch_size, self.blocks) < 1:
            raise ValueError("sizes must be positive")


@dataclass(frozen=True)
class RerankWeights:
    relevance: float = 0.70
    calibration: float = 0.15
    diversity: float = 0.15

    def __post_init__(self):
        given = list(asdict(self).values())
        if any(w < 0 for w in given) or abs(math.fsum(given) - 1) > 1e-5:
            raise ValueError("weights must be non-negative and sum to 1")


def fingerprint(*configs, inputs: list | None = None) -> str:
    """A hash of settings and of the inputs' names, sizes and times: cached stages are reused only under the same one."""
    text = json.dumps([[asdict(c) for c in configs], inputs], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]
