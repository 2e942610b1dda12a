"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = ("detection_queries", "evidence_queries", "serving_queries", "learning_queries", "streaming_queries")


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"emberline.plans.{m}")
