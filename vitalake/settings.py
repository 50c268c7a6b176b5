"""Settings of a run: files merged one over the other, a logger, seeds."""

from __future__ import annotations

import copy
import json
import logging
import os
import random

import numpy as np


def deep_merge(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``; dictionaries within are merged, anything else is replaced. Neither is changed."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else copy.deepcopy(v)
    return out


def load_settings(path: str, overrides: list[str] = ()) -> dict:
    """Settings of a JSON file with those of further files over them; files that aren't there are passed over, but for the first."""

    def read(p: str) -> dict:
        with open(p, encoding="utf-8") as f:
            return json.load(f) or {}

    out = read(path)
    for p in overrides:
        if os.path.exists(p):
            out = deep_merge(out, read(p))
    return out


def logger(name: str, level: int = logging.INFO) -> logging.Logger:
    """A logger with time, level and name, set up once."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
        log.setLevel(level)
    return log


def set_seed(seed: int) -> None:
    """Seed the generators of the driver; operators take their seed as a parameter."""
    random.seed(seed)
    np.random.seed(seed)
