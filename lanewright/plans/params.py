"""All parameters of the training-data computations in one place."""

from __future__ import annotations

from dataclasses import dataclass

# Lane, evaluation or not, target share, protected floor. A document's lane is its source number mod 6.
LANES = (
    ("COMMON_CRAWL", False, 0.50, None),
    ("BOOKS", False, 0.15, 0.10),
    ("CODE", False, 0.25, None),
    ("OPUS", False, 0.10, 0.05),
    ("EVAL", True, None, None),
    ("VALIDATION", True, None, None),
)
# Curriculum stages as [first step, end) and lane weights in the order of the training lanes.
STAGES = (
    ("warmup", 0, 15, (0.60, 0.10, 0.20, 0.10)),
    ("main", 15, 35, (0.50, 0.15, 0.25, 0.10)),
    ("cooldown", 35, 9999, (0.40, 0.20, 0.25, 0.15)),
)


@dataclass(frozen=True)
class Params:
    seed: int = 42
    vocab: int = 512
    context: int = 128
    batch: int = 4
    steps: int = 40
    checkpoint_every: int = 10
    crash_at: int = 22
    fork_from: int = 10
    accept: float = 0.50
    defer: float = 0.35
    opus_floor: float = 0.05
    #: Documents whose ids share a quotient by this width form a block of a two-level prefix sum or ordered hash.
    block: int = 4096


P = Params()
TRAIN_LANES = tuple(x[0] for x in LANES if not x[1])
EVAL_LANES = tuple(x[0] for x in LANES if x[1])
FLOORS = {x[0]: x[3] for x in LANES if x[3] is not None}
