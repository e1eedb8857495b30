"""Options of the pipelines in one place, read from the environment where a variable of the same name is set."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Options:
    k_lex: int = 200
    k_sem: int = 300
    topn: int = 50
    topk: int = 12
    mmr_lambda: float = 0.5
    step_sim: float = 0.70
    param_tol: float = 0.10
    top_keywords: int = 10
    min_steplen: int = 20
    num_queries: int = 2
    self_win: int = 1200
    self_step: int = 1000
    evid_trunc: int = 1800
    self_sections: str = "methods"

    @classmethod
    def from_environment(cls) -> Options:
        return cls(**{f.name: type(f.default)(os.environ[f.name.upper()]) for f in fields(cls) if f.name.upper() in os.environ})
