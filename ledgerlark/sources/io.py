"""Readers and writers: planes, result tables, the alert queue and fitted scorers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUNDLE_VERSION = 1


def read_plane(spark: SparkSession, path: str, schema: StructType, required: bool = False) -> DataFrame:
    """A Parquet plane; an optional one that is missing is empty, a required one is an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if required or problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_plane(df: DataFrame, path: str, by: str = "day") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_features(featured: DataFrame, test_ids: DataFrame, key: str, path: str) -> None:
    """The test window's features, without scratch columns."""
    kept = featured.join(test_ids.select(key), key, "left_semi")
    kept.select(*[c for c in kept.columns if not c.startswith("_")]).write.mode("overwrite").parquet(path)


def write_result(df: DataFrame, path: str) -> None:
    """A small result table as one CSV."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_result(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | None = None) -> tuple[bool, DataFrame | None]:
    """``(available, table)``: absent is not the same as empty."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        return True, reader.option("header", True).format(kind).load(path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False, None
        raise


def record_alerts(scored: DataFrame, path: str, run_id: str, columns: list[str]) -> None:
    """Idempotent upsert of one run: its partition is replaced, absent columns are NULL, lists are joined."""
    types = dict(scored.dtypes)
    picked = [F.lit(None).cast("string").alias(c) if c not in types else
              F.array_join(F.col(c), ", ").alias(c) if types[c].startswith("array") else F.col(c) for c in columns]
    scored.select(*picked, F.lit(run_id).alias("run_id")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def record_case(spark: SparkSession, path: str, run_id: str, txn_id: str, status: str, disposition: str, note: str, updated_at: int) -> None:
    """Append one case event; readers take the last per payment."""
    row = [(run_id, txn_id, status, disposition, note, updated_at)]
    spark.createDataFrame(row, "run_id string, txn_id string, status string, disposition string, note string, updated_at long").write.mode("append").parquet(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.relate import latest
    return latest(spark.read.parquet(path), ["run_id", "txn_id"], F.col("updated_at"))


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row: NaN and infinities are null, timestamps ISO."""
    from ..functions.scalar import finite
    cols = [finite(F.col(c)).alias(c) if t in ("double", "float") else
            F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def save_scorer(scorer, spark: SparkSession, path: str) -> None:
    """Fitted stages plus one row with the cut, the novelty grid and a version."""
    parts = {"gbt": scorer.gbt, "rf": scorer.rf, "meta": scorer.meta, "imputer": scorer.encoder._imputer}
    parts |= {f"index_{i}": m for i, m in enumerate(scorer.encoder._indexers)}
    for name, model in parts.items():
        model.write().overwrite().save(f"{path}/{name}")
    grid = [(c, float(p), float(q)) for c, pairs in scorer.novelty.grid.items() for p, q in pairs]
    spark.createDataFrame(grid, "column string, p double, q double").coalesce(1).write.mode("overwrite").parquet(f"{path}/grid")
    head = [(BUNDLE_VERSION, float(scorer.cut), scorer.encoder.numeric, scorer.encoder.categories)]
    spark.createDataFrame(head, "version int, cut double, numeric array<string>, categories array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")


def load_scorer(spark: SparkSession, path: str):
    from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
    from pyspark.ml.feature import ImputerModel, StringIndexerModel

    from ..operators.models import StackedScorer
    head = spark.read.parquet(f"{path}/head").first()
    if head["version"] != BUNDLE_VERSION:
        raise ValueError(f"scorer version {head['version']} is not {BUNDLE_VERSION}; refit it")
    out = StackedScorer(head["numeric"], head["categories"])
    out.gbt, out.rf = GBTClassificationModel.load(f"{path}/gbt"), RandomForestClassificationModel.load(f"{path}/rf")
    out.meta, out.encoder._imputer = LogisticRegressionModel.load(f"{path}/meta"), ImputerModel.load(f"{path}/imputer")
    out.encoder._indexers = [StringIndexerModel.load(f"{path}/index_{i}") for i in range(len(head["categories"]))]
    rows = spark.read.parquet(f"{path}/grid").collect()
    out.novelty.grid = {c: sorted((r["p"], r["q"]) for r in rows if r["column"] == c) for c in head["numeric"]}
    out.cut = head["cut"]
    return out
