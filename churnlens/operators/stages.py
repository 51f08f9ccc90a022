"""Pipeline stages that MLlib lacks, so that one saved ``PipelineModel`` scores raw customer rows.

Each is a plain DataFrame expression (no Python code runs on the executors) that is written and
read with the pipeline it stands in: filled copies of columns, the class of a probability, the
risk factors of a feature vector, the persona of a cluster, and the removal of working columns.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators.scoring import attach_persona, risk_factors_of_vector

FILLED = "_fill_"  # prefix of the filled copies


def filled(columns: list[str]) -> list[str]:
    return [FILLED + c for c in columns]


class FillMissing(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Copies of the input columns with nulls replaced by learned values; the columns themselves stay."""

    inputCols = Param(Params._dummy(), "inputCols", "columns to copy", TypeConverters.toListString)
    fills = Param(Params._dummy(), "fills", "JSON object: column -> value for its nulls", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, fills=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = json.loads(self.getOrDefault(self.fills))
        copies = {FILLED + c: F.col(c) if values.get(c) is None else F.coalesce(F.col(c), F.lit(values[c])) for c in self.getOrDefault(self.inputCols)}
        return dataset.withColumns(copies) if copies else dataset


class ChurnClass(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """M3: ``outputCol`` = 1 where the probability is above one half; a tie gives 0."""

    inputCol = Param(Params._dummy(), "inputCol", "probability column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "class column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._setDefault(inputCol="churn_probability", outputCol="prediction")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOrDefault(self.outputCol), (F.col(self.getOrDefault(self.inputCol)) > 0.5).cast("int"))


class RiskFactors(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """R5 on a feature vector: the tree's importances, feature names and numeric columns travel with the stage."""

    inputCol = Param(Params._dummy(), "inputCol", "feature vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "risk factors column", TypeConverters.toString)
    names = Param(Params._dummy(), "names", "feature name of each slot", TypeConverters.toListString)
    importances = Param(Params._dummy(), "importances", "importance of each slot", TypeConverters.toListFloat)
    numeric = Param(Params._dummy(), "numeric", "numeric columns", TypeConverters.toListString)
    topN = Param(Params._dummy(), "topN", "factors a row", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, names=None, importances=None, numeric=None, topN=None):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="risk_factors", topN=5)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        return dataset.withColumn(get(self.outputCol), risk_factors_of_vector(
            F.col(get(self.inputCol)), get(self.names), get(self.importances), get(self.numeric), get(self.topN)))


class DropColumns(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Drops the named columns and those that begin with one of the prefixes."""

    columns = Param(Params._dummy(), "columns", "columns to drop", TypeConverters.toListString)
    prefixes = Param(Params._dummy(), "prefixes", "prefixes of columns to drop", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, columns=(), prefixes=()):
        super().__init__()
        self._set(columns=list(columns), prefixes=list(prefixes))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        start = tuple(self.getOrDefault(self.prefixes))
        gone = [c for c in dataset.columns if c in self.getOrDefault(self.columns) or (start and c.startswith(start))]
        return dataset.drop(*gone)


class PersonaLookup(Transformer, MLReadable, MLWritable):
    """R4 with the persona table (one row per cluster) that is written beside the stage's parameters."""

    clusters = Param(Params._dummy(), "clusters", "rows of the persona table", TypeConverters.toInt)

    def __init__(self, lookup: DataFrame | None = None, clusters: int | None = None):
        super().__init__()
        self.lookup = lookup
        if clusters is not None:
            self._set(clusters=clusters)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return attach_persona(dataset, self.lookup, known_rows=self.getOrDefault(self.clusters))

    def write(self) -> MLWriter:
        return _LookupWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _LookupReader()


class _LookupWriter(MLWriter):
    def __init__(self, stage: PersonaLookup):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.lookup.coalesce(1).write.parquet(f"{path.rstrip('/')}/lookup")


class _LookupReader(MLReader):
    def load(self, path: str) -> PersonaLookup:
        known = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = PersonaLookup(self.sparkSession.read.parquet(f"{path.rstrip('/')}/lookup"))
        stage._resetUid(known["uid"])
        DefaultParamsReader.getAndSetParams(stage, known)
        return stage
