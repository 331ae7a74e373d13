"""The analysis pipeline as a registry of steps over lazy frames, and the scorer's interface."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane.functions.taxonomy import FINANCE, Taxonomy


class Analyzer(ABC):
    @abstractmethod
    def analyze(self, data: dict[str, DataFrame], **options) -> dict[str, DataFrame]:
        """Named result frames from the pipeline's frames."""


@dataclass
class Options:
    """Steps to run, in order; None runs all."""

    steps: tuple[str, ...] | None = None


@dataclass
class Pipeline:
    """Named steps from frames to frames. A step that fails is reported and the others run."""

    data: dict[str, DataFrame]
    steps: dict[str, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]] = field(default_factory=dict)
    failures: dict[str, Exception] = field(default_factory=dict)

    def register(self, name: str, step: Analyzer | Callable) -> None:
        self.steps[name] = step.analyze if isinstance(step, Analyzer) else step

    def run(self, options: Options = Options()) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}
        for name, step in self.steps.items():
            if options.steps is not None and name not in options.steps:
                continue
            try:
                found = step(self.data | out)
            except Exception as e:  # noqa: BLE001  one step's fault is its own
                self.failures[name] = e
            else:
                out |= {f"{name}.{k}": v for k, v in found.items()}
        return out


class Scorer(ABC):
    """Probabilities for texts. Made once a task, so that a model loads once."""

    @abstractmethod
    def score(self, texts: list[str]) -> list[dict[str, float]]: ...


class HashScorer(Scorer):
    """Deterministic probabilities without a model, for tests."""

    def __init__(self, tax: Taxonomy = FINANCE) -> None:
        self.labels = tax.labels

    def score(self, texts: list[str]) -> list[dict[str, float]]:
        import zlib

        return [{k: zlib.crc32(f"{k}|{t}".encode()) % 1001 / 1000 for k in self.labels} for t in texts]


def scored(rows: DataFrame, text: str, make: Callable[[], Scorer], batch: int = 128, out: str = "pred") -> DataFrame:
    """rows and a map of probabilities. A batch whose answers don't match its texts gets the error map, each text in its place."""

    @F.pandas_udf("map<string,double>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make()
        for texts in batches:
            found: list[dict] = []
            for k in range(0, len(texts), batch):
                part = texts[k : k + batch].fillna("").tolist()
                try:
                    answer = scorer.score(part)
                except OSError:
                    answer = []
                found += answer if len(answer) == len(part) else [{"error": -1.0}] * len(part)
            yield pd.Series(found)

    return rows.withColumn(out, udf(F.col(text)))
