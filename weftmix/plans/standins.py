"""Deterministic stand-ins for the model and the judge (tests and driver
queries). Each mirrors a SQL form so its output can be checked exactly."""

from __future__ import annotations

import hashlib
import threading

from weftmix.plans.evaluation import EXPLAIN


def _h(key: str, salt: str) -> int:
    """Python twin of ``functions.text.seeded_hash`` for one string key."""
    return int(hashlib.md5(f"{key}|{salt}".encode("utf-8")).hexdigest()[:8], 16)


def generator_factory():
    """J2 stand-in model: states how much prompt it read."""
    return lambda prompt: f"Answer of {len(prompt)} characters. "


def judge_factory():
    """J3 stand-in judge: the same text as ``evaluation.stand_in_judge`` on a
    first attempt; every prompt whose hash says 'flaky' fails once first. A
    request's tries follow each other in one thread, which holds its last
    failed prompt alone."""
    last = threading.local()

    def call(system_prompt: str, prompt: str, max_tokens: int) -> str:
        if _h(prompt, "flaky") % 4 == 0 and prompt != getattr(last, "failed", None):
            last.failed = prompt
            raise RuntimeError("transient judge failure")
        a, b = str(_h(prompt, "judge-a") % 11), str(_h(prompt, "judge-b") % 11)
        fmt = _h(prompt, "judge-fmt-0") % 6
        if system_prompt.startswith("You check"):
            work = "Working through both answers.\n"
            return {2: f"{work}The output tuple is ({a}, {b}).", 3: "error",
                    4: f"{work}Scores: [{a},{b}]"}.get(fmt, f"{work}Output: ({a}, {b})")
        return {1: f"{a},{b}\n{EXPLAIN}", 2: f"{a}, {b}\n{EXPLAIN}", 3: "error", 4: f"{a} {b} \n{EXPLAIN}",
                5: f"  {a} {b}\r\n{EXPLAIN}"}.get(fmt, f"{a} {b}\n{EXPLAIN}")

    return call
