"""Settings with aliases, defaults and clamps, from the environment or a Spark session's configuration."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

from pageloom.functions.text import PROVIDERS

YES = ("1", "true", "yes", "on")


def truth(text: str | None, default: bool = False) -> bool:
    return default if text is None else text.strip().lower() in YES


def engine(text: str | None) -> str:
    x = (text or "").strip().lower()
    return x if x in ("legacy", "pretext") else "legacy"


def provider(text: str | None) -> str:
    x = (text or "").strip().lower()
    return PROVIDERS.get(x, x)


def version(text: str) -> tuple[int, ...]:
    """Leading numbers of a version."""
    return tuple(int(m[0]) for part in text.strip().lstrip("v").split(".") if (m := re.match(r"\d+", part)))


def _least(low: float, kind: type = float) -> Callable[[str], float]:
    return lambda text: max(kind(text), kind(low))


@dataclass(frozen=True)
class Setting:
    """keys: the first that is set counts; a value that can't be read is an error."""

    keys: tuple[str, ...]
    default: object
    read: Callable[[str], object] = str.strip


#: What each setting is where nothing is set, and its least value.
SETTINGS: dict[str, Setting] = {
    "workspace_root": Setting(("workspace_root",), "workspace"),
    "default_provider": Setting(("default_provider",), "ctranslate2", provider),
    "default_model": Setting(("default_model",), ""),
    "target_language": Setting(("default_target_language",), "Simplified Chinese"),
    "iou_threshold": Setting(("duplicate_box_iou_threshold",), 0.85, float),
    "iom_threshold": Setting(("duplicate_box_iom_threshold", "duplicate_box_threshold", "box_overlap_threshold"), 0.9, float),
    "base_font_size": Setting(("base_font_size",), 10.0, float),
    "render_font_path": Setting(("render_font_path",), ""),
    "layout_engine": Setting(("render_layout_engine",), "legacy", engine),
    "adjust_spacing": Setting(("adjust_render_letter_spacing_for_overlap",), True, truth),
    "helper_timeout_s": Setting(("pretext_helper_timeout_seconds",), 20.0, _least(1.0)),
    "running_jobs": Setting(("job_queue_concurrency",), 2, _least(1, int)),
    "waiting_jobs": Setting(("job_queue_max_size",), 8, _least(1, int)),
    "retention_h": Setting(("workspace_retention_hours",), 24.0, _least(0.0)),
    "cleanup_every_s": Setting(("workspace_cleanup_interval_seconds",), 600.0, _least(30.0)),
    "rate_limit": Setting(("rate_limit_enabled",), False, truth),
    "daily_seconds": Setting(("rate_limit_daily_seconds",), 500, _least(1, int)),
    "time_zone": Setting(("rate_limit_timezone",), "Asia/Seoul", lambda x: x.strip() or "Asia/Seoul"),
    "store_path": Setting(("rate_limit_storage_path",), ""),
    "trust_forwarded": Setting(("trust_forwarded_for",), True, truth),
    "remote_url": Setting(("remote_api_base_url",), ""),
}


def settings(given: Mapping[str, str] | None = None, prefix: str = "PAGELOOM_") -> dict[str, object]:
    """Every setting (S8); given: the environment, or any mapping of texts.  A blank text counts as not set for numbers."""
    given = os.environ if given is None else given
    out = {}
    for name, s in SETTINGS.items():
        said = next((given[k] for key in s.keys if (k := prefix + key.upper()) in given), None)
        out[name] = s.default if said is None or (not said.strip() and isinstance(s.default, (int, float))) else s.read(said)
    return out


def of_session(spark: SparkSession, prefix: str = "pageloom.") -> dict[str, object]:
    """The same from a session's configuration: ``pageloom.base_font_size`` and so on."""
    found = {}
    for s in SETTINGS.values():
        for key in s.keys:
            if (said := spark.conf.get(prefix + key, None)) is not None:
                found["PAGELOOM_" + key.upper()] = said
    return settings(found)
