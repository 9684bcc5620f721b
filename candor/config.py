"""Parameters of truth discovery."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    clusters: int = 30
    max_iter: int = 100
    tolerance: float = 1e-12
    sweeps: int = 100
    #: Prior counts by [indicator * 2 + observation], and of the indicators
    alpha: tuple[float, float, float, float] = (90.0, 10.0, 50.0, 50.0)
    beta: tuple[float, float] = (10.0, 10.0)
    top_k: int = 5
    epsilon: float = 3.0
    log2_delta: int = -32
    seed: str = "truth"


#: Questions of each exam
EXAM_SIZES = (7, 7, 7, 7, 4, 7, 7, 7, 7, 7, 10, 10)
