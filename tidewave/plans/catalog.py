"""The catalogue of operators: public functions of the package's modules, by component."""

from __future__ import annotations

import importlib
import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPONENTS = ("functions.arrays", "functions.fourier", "functions.windows", "operators.temporal", "operators.spectral", "operators.spectrograms", "operators.filterbanks", "operators.pitch", "operators.voice", "operators.linear", "operators.stats", "operators.kernels", "operators.formants", "operators.constant_q", "operators.probabilistic_pitch", "operators.periodicity", "operators.blocks", "operators.rhythm", "operators.chains", "operators.clusters", "plans.extract", "plans.report", "plans.scorecard", "sources.signals", "sources.files", "streaming.framing")
SCHEMA = "component string, name string, signature string, description string, error string"


def build_catalog(spark: SparkSession, components: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """One row per public function; a component that cannot be imported is one row with an error."""
    rows = []
    for component in components:
        try:
            module = importlib.import_module(f"tidewave.{component}")
        except ImportError as e:
            rows.append((component, None, None, None, str(e)))
            continue
        for name, f in inspect.getmembers(module, inspect.isfunction):
            if f.__module__ == module.__name__ and not name.startswith("_"):
                rows.append((component, name, str(inspect.signature(f)), (inspect.getdoc(f) or "").split("\n")[0], None))
    return spark.createDataFrame(rows, SCHEMA)


def summarize(catalog: DataFrame) -> DataFrame:
    """Functions and errors per component, with a total row (null component)."""
    return catalog.rollup("component").agg(F.count("name").alias("functions"), F.count("error").alias("errors"))


def to_markdown(catalog: DataFrame) -> str:
    lines = ["| component | name | description |", "|---|---|---|"]
    return "\n".join(lines + [f"| {r.component} | {r.name} | {r.description} |" for r in catalog.where("name is not null").orderBy("component", "name").collect()])
