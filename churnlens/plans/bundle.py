"""Everything that scoring needs as one saved pipeline.

    raw rows -> filled copies -> encoding -> tree -> class, risk factors
             -> encoding and scaling for clusters -> nearest centre -> persona

``Bundle.save`` writes one ``PipelineModel`` that carries the fills, category dictionaries, tree,
driver names, scaling, centres and persona table; an application that only knows the path loads
it and scores tables (R2), predicts records (R6) or streams (R7).  All stages are narrow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from churnlens.functions.columns import label_text, risk_level
from churnlens.operators import churn as M
from churnlens.operators import dashboard as Q
from churnlens.operators import personas as P
from churnlens.operators import quality as V
from churnlens.operators import scoring as R
from churnlens.operators import segments as K
from churnlens.operators.stages import FILLED, ChurnClass, DropColumns, PersonaLookup, RiskFactors
from churnlens.sources.schema import LABEL_COL

PREDICTION_COLUMNS = ["customer_id", "prediction", "prediction_label", "probability", "risk_level", "risk_factors",
                      "persona", "explanation"]
TOP_FACTORS = 5  # fixed: risk factors served with a prediction


def _flat(model: PipelineModel) -> list:
    """The stages of a pipeline, those of inner pipelines in their place."""
    return [x for s in model.stages for x in (_flat(s) if isinstance(s, PipelineModel) else [s])]


@dataclass
class Bundle:
    model: PipelineModel

    @classmethod
    def of(cls, churn: M.ChurnModel, segments: K.ClusterModel, profiles: DataFrame, top_n: int = TOP_FACTORS) -> Bundle:
        factors = RiskFactors(names=churn.names, importances=churn.importances(), numeric=churn.numeric, topN=top_n)
        working = DropColumns(columns=["features"], prefixes=["_oh_", FILLED])
        last = DropColumns(columns=["features", "scaled"], prefixes=["_oh_", "_scaled", FILLED])
        return cls(PipelineModel([*_flat(churn.model), ChurnClass(), factors, working, *_flat(segments.encoding), segments.kmeans,
                                  PersonaLookup(P.persona_lookup(profiles), segments.k), last]))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> Bundle:
        try:
            reader = PipelineModel.read()
            return cls((reader.session(spark) if spark else reader).load(path))
        except Exception as e:  # noqa: BLE001
            raise FileNotFoundError(f"no readable scoring pipeline at {path}; train and save one first") from e

    def score(self, df: DataFrame) -> DataFrame:
        """R2: probability, risk, cluster, persona and Yes/No label for every cleaned row, its own values unchanged."""
        out = self.model.transform(df).withColumn("risk_level", risk_level("churn_probability"))
        if LABEL_COL in out.columns:
            out = out.withColumn(LABEL_COL, label_text(LABEL_COL))
        return out.select(*[c for c in Q.LISTING_COLUMNS if c in out.columns])

    def predict_valid(self, valid: DataFrame) -> DataFrame:
        """R6 payload of rows that passed the checks."""
        return R.prediction_payload(self.model.transform(V.parse_numeric_column(valid))).select(*PREDICTION_COLUMNS)

    def predict(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(payload of the valid records, rejected records with the rules they break); flags are trimmed first."""
        checked = check_records(df)
        return self.predict_valid(V.valid_rows(checked)), V.rejected_rows(checked)


def check_records(df: DataFrame) -> DataFrame:
    """V4 + V3 on prediction records: ``violations`` is empty where a record may be scored.

    The label is no part of a prediction record; where a table has one it is not checked.
    """
    trimmed = V.trim_flags(df)
    required = [c for c in df.columns if c not in (*V.ID_COLS, LABEL_COL)]
    return V.check_constraints(trimmed, required=required)

