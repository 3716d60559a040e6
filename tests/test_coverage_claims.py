"""COVERAGE.md names functions and queries that exist, and only what has no code is left out."""

import importlib
import re
from pathlib import Path

from covaria import plans

TEXT = (Path(__file__).parents[1] / "COVERAGE.md").read_text()
LINES = [line.split("|") for line in TEXT.splitlines() if line.count("|") > 2 and not line.startswith("|-")]
FOLDERS = ("covaria.operators", "covaria.sources", "covaria.functions", "covaria")


def found(name):
    """Whether covaria has module.function, or a module of that name."""
    *parts, last = name.split(".")
    for folder in FOLDERS:
        try:
            return hasattr(importlib.import_module(".".join([folder, *parts])), last) or bool(importlib.import_module(".".join([folder, *parts, last])))
        except ImportError:
            continue
    return False


def test_queries_exist():
    known = plans.queries()
    named = {q.strip() for line in LINES for run in re.findall(r"\*([a-z0-9_, ]+)\*", line[2]) for q in run.split(",")}
    assert len(named) > 120 and not named - known.keys()


def test_functions_exist():
    named = {n for line in LINES for n in re.findall(r"`([a-z]+(?:\.[A-Za-z_]+)+)`", line[2])}
    assert len(named) > 80
    assert not {n for n in named if not n.startswith("tests") and not found(n.removeprefix("covaria."))}


def test_what_is_left_out():
    out = {i for line in LINES if "left out" in line[2].split(";")[0][:12] for i in re.findall(r"[A-Z]\d+", line[1])}
    assert {"S3", "S6", "F29", "L12", "L38", "N2", "Q7"} <= out and not out & {"N10", "N11", "N21", "L11", "X7", "L34"}
