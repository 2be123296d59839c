"""Parsers as adaptors: functions from a file's bytes to its page tree, by name."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A parser gets (path, content) and gives a page tree as JSON-like objects.
Parser = Callable[[str, bytes], object]
PARSERS: dict[str, Parser] = {}


class MissingParser(RuntimeError):
    """What a parser needs isn't installed."""


def register(name: str) -> Callable[[Parser], Parser]:
    def keep(f: Parser) -> Parser:
        PARSERS[name] = f
        return f

    return keep


@register("json")
def from_json(path: str, content: bytes) -> object:
    """Files that already hold a page tree."""
    return json.loads(content)


def parsed(files: DataFrame, parser: str | Parser) -> DataFrame:
    """files (path, content) with tree (JSON) and error: null, or why a file couldn't be parsed.

    One bad file doesn't end the job: ``required`` turns errors into one, and rows with an error are a dead-letter table.
    """
    f = PARSERS[parser] if isinstance(parser, str) else parser

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            trees, errors = [], []
            for path, content in zip(x["path"], x["content"], strict=True):
                try:
                    trees.append(json.dumps(f(path, bytes(content)), ensure_ascii=False))
                    errors.append(None)
                except ImportError as e:
                    raise MissingParser(f"parsing needs {e.name}, which isn't installed") from e
                except Exception as e:  # whatever a parser may raise is told with its file
                    trees.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": x["path"], "tree": pd.Series(trees, dtype=object), "error": pd.Series(errors, dtype=object)})

    return files.select("path", "content").mapInPandas(run, "path string, tree string, error string")


def required(trees: DataFrame) -> DataFrame:
    """path and tree; the first error met ends the job."""
    why = F.raise_error(F.concat(F.lit("could not parse "), "path", F.lit(": "), "error")).cast("string")
    return trees.select("path", F.when(F.col("error").isNotNull(), why).otherwise(F.col("tree")).alias("tree"))


def split_off(rows: DataFrame, bad: str, path: str) -> DataFrame:
    """rows without those for which ``bad`` (SQL) holds; these are appended to the dead-letter table at path."""
    rows.filter(bad).write.mode("append").parquet(path)
    return rows.filter(f"not coalesce({bad}, false)")
