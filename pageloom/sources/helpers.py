"""Measuring text with an external program, batch by batch in each task.

The program gets a JSON object on its input, ``{"requests": [...], "render_font_path": ...}``, and answers with one: either
``{request_id: {"line_count", "height_px"}}`` or ``{"results": [{"id", "measured_line_count", "measured_height_pt"}]}``.  A script in
Python is sent ``{"items": [...]}`` instead, in points.  What goes wrong has an error of its own; a program that hangs is ended, and
a batch is tried once more with a new one.
"""

from __future__ import annotations

import json
import math
import os
import shutil
import subprocess
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: Pixels a point; the least time limit; the default one; requests of a batch; how often a batch is tried.
PX, LEAST_S, TIMEOUT_S, BATCH, ATTEMPTS = 96 / 72, 1.0, 20.0, 500, 2
REQUEST = ("request_id", "text", "font_family_css", "font_size_px", "line_height_px", "max_width_px", "letter_spacing_em")


class MeasurementError(RuntimeError):
    """Text couldn't be measured."""


class HelperMissing(MeasurementError):
    """The script, or what runs it, isn't there."""


class HelperTimeout(MeasurementError):
    """The program took longer than it may."""


class HelperFailed(MeasurementError):
    """The program ended with an error."""


class BadAnswer(MeasurementError):
    """The program's answer isn't JSON, or not of the agreed shape."""


def _found(script: str) -> str:
    """The script's path on this machine: as it is, or as sent by SparkContext.addFile."""
    sent = [SparkFiles.get(os.path.basename(script))] if SparkFiles._is_running_on_worker else []
    for path in (script, *sent):
        if os.path.isfile(path):
            return path
    raise HelperMissing(f"no measuring script at {script}")


def _asked(script: str, requests: list[dict], font: str) -> tuple[list[str], dict]:
    """The command, and what it is sent."""
    if not script.lower().endswith(".py"):
        if (node := shutil.which("node")) is None:
            raise HelperMissing("the measuring script needs node, which isn't installed")
        return [node, script], {"requests": requests, "render_font_path": font}
    points = lambda r, k: float(r.get(k) or 0.0) / PX
    items = [{"id": r["request_id"].strip(), "text": r.get("text") or "", "font_family": r.get("font_family_css") or "sans-serif", "font_size_pt": points(r, "font_size_px"), "line_height_pt": points(r, "line_height_px"), "width_pt": points(r, "max_width_px"), "letter_spacing_em": r.get("letter_spacing_em")} for r in requests]
    return [sys.executable, script], {"items": items}


def _number(value: object, other: float) -> float:
    try:
        x = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return other
    return x if math.isfinite(x) else other


def answers(said: str) -> dict[str, tuple[int, float]]:
    """request_id -> (lines, height in pixels) of a program's output; entries without an id, or of another shape, are left out."""
    try:
        found = json.loads(said)
    except ValueError as e:
        raise BadAnswer("the measuring program's answer isn't JSON") from e
    if not isinstance(found, dict):
        raise BadAnswer("the measuring program's answer is no object")
    if "results" not in found:
        return {k: (max(int(_number(x.get("line_count", 1), 1)), 1), _number(x.get("height_px", 0.0), 0.0)) for k, x in found.items() if isinstance(x, dict)}
    if not isinstance(found["results"], list):
        raise BadAnswer("the measuring program's results are no list")
    out = {}
    for x in found["results"]:
        if isinstance(x, dict) and (name := str(x.get("id", "")).strip()):
            out[name] = (max(int(_number(x.get("measured_line_count", 1), 1)), 1), round(_number(x.get("measured_height_pt", 0.0), 0.0) * PX, 3))
    return out


def ask(requests: list[dict], script: str, font: str = "", timeout: float = TIMEOUT_S) -> dict[str, tuple[int, float]]:
    """One run of the program for some requests."""
    if not requests:
        return {}
    path = _found(script)
    command, payload = _asked(path, requests, font)
    try:
        done = subprocess.run(command, cwd=os.path.dirname(path) or ".", input=json.dumps(payload, ensure_ascii=False), text=True, encoding="utf-8", capture_output=True, check=False, timeout=max(timeout, LEAST_S))
    except subprocess.TimeoutExpired as e:
        raise HelperTimeout(f"the measuring program took longer than {max(timeout, LEAST_S):g} s") from e
    except OSError as e:
        raise HelperFailed(f"the measuring program couldn't be started: {e}") from e
    if done.returncode != 0:
        raise HelperFailed(f"the measuring program ended with {done.returncode}: {(done.stderr or done.stdout).strip()[-500:] or 'no word of why'}")
    return answers(done.stdout)


def measuring(script: str, font: str = "", timeout: float = TIMEOUT_S, batch: int = BATCH, attempts: int = ATTEMPTS) -> Callable[[DataFrame], DataFrame]:
    """A measure: requests (REQUEST) -> request_id, line_count, height_px, one row for each that was answered.

    Requests without an id are left out.  A batch whose program hangs or fails is tried again; a bad answer, or a missing script, isn't.
    """

    def tried(requests: list[dict]) -> dict[str, tuple[int, float]]:
        for left in range(attempts - 1, -1, -1):
            try:
                return ask(requests, script, font, timeout)
            except (HelperTimeout, HelperFailed):
                if not left:
                    raise
        return {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = [{k: None if v is None or v != v else v for k, v in r.items()} for r in x.to_dict("records") if isinstance(r["request_id"], str) and r["request_id"].strip()]
            for i in range(0, len(rows), batch):
                found = tried(rows[i : i + batch])
                yield pd.DataFrame([(k, n, h) for k, (n, h) in found.items()], columns=["request_id", "line_count", "height_px"])

    return lambda requests: requests.select(*REQUEST).mapInPandas(run, "request_id string, line_count int, height_px double")
