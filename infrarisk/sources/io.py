"""Sources and sinks.

The JSON-lines history store of the modelled service (file lock, read-all-lines) is re-aimed as
an append-only JSON table partitioned by date: appends are Spark writes, reads tolerate corrupt
lines (DROPMALFORMED) and a missing folder (empty result), newest-N is a top-k.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.validate import require_columns
from ..operators.infer import LinearModel
from ..operators.stats import Preprocessor
from ..schema import INCIDENTS, LABELED, RAW_INPUT_COLUMNS, REQUEST, TARGET_COLUMNS, TELEMETRY, TIME_COLUMN


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON requests (one a line) with the declared schema; broken lines go to ``read_rejected_requests``."""
    return _parsed(spark, path).where(F.col("broken").isNull()).select("request.*")


def read_rejected_requests(spark: SparkSession, path: str) -> DataFrame:
    """The raw text of every line that is no request, for quarantine."""
    return _parsed(spark, path).where(F.col("broken").isNotNull()).select(F.col("broken").alias("line"))


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    corrupt = T.StructField("_corrupt_record", T.StringType())
    made = F.from_json("value", T.StructType([*REQUEST.fields, corrupt]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).withColumn("parsed", made)
    broken = F.when(F.col("parsed").isNull() | F.col("parsed._corrupt_record").isNotNull(), F.col("value"))
    return lines.select(broken.alias("broken"), F.struct(*[F.col(f"parsed.{f.name}") for f in REQUEST.fields]).alias("request"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with header and a declared schema; S3 checks the header against the schema."""
    df = spark.read.option("header", True).schema(schema).option("enforceSchema", False).csv(path)
    require_columns(df, [f.name for f in schema.fields])
    return df


def read_telemetry_csv(spark, path):
    return read_csv(spark, path, TELEMETRY)


def read_incidents_csv(spark, path):
    return read_csv(spark, path, INCIDENTS)


def read_labeled_csv(spark, path):
    df = read_csv(spark, path, LABELED)
    require_columns(df, [TIME_COLUMN, *RAW_INPUT_COLUMNS, *TARGET_COLUMNS], "labeled dataset")
    return df


def write_labeled(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Labeled dataset, partitioned by date (partition pruning on time filters)."""
    out = df.withColumn("date", F.to_date(TIME_COLUMN))
    out.write.mode("overwrite").partitionBy("date").format(fmt).options(**(AS_CSV if fmt == "csv" else {})).save(path)


AS_CSV = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}  # the writer would trim texts


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header, texts as they are; ``read_csv`` reads it back."""
    df.write.options(**AS_CSV).csv(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Long metric tables (target, [model, window,] metric columns) -- small by construction."""
    df.coalesce(1).write.mode("overwrite").format(fmt).save(path)


def publish_report(df: DataFrame, path: str) -> int:
    """Writes a new version of a report and then its manifest; returns the version.

    Versions are never overwritten, and readers go by manifests, so a reader sees the version before or all of this one.
    """
    spark = df.sparkSession
    version = max([r["version"] for r in _manifests(spark, path).collect()], default=0) + 1  # one row a version
    folder = f"{version:06d}-{uuid.uuid4().hex[:8]}"
    rows = Observation("report")
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/versions/{folder}")
    manifest = spark.range(1).select(F.lit(version).alias("version"), F.lit(folder).alias("folder"), F.lit(rows.get["n"]).cast("long").alias("n"))
    manifest.coalesce(1).write.mode("append").json(f"{path}/manifests")
    return version


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    schema = "version int, folder string, n long"
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{path}/manifests").where("folder IS NOT NULL")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that has a manifest (of two writers of one version number, the last by folder name)."""
    last = _manifests(spark, path).orderBy(F.col("version").desc(), F.col("folder").desc()).first()
    if last is None:
        raise FileNotFoundError(f"no complete report in {path}")
    return spark.read.parquet(f"{path}/versions/{last['folder']}")


# ---------------------------------------------------------------------------
# History (S6, S7, K1)
# ---------------------------------------------------------------------------
HISTORY_SCHEMA = T.StructType([
    T.StructField("assessment_id", T.StringType()),
    T.StructField("saved_at", T.TimestampType()),
    T.StructField("request", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("date", T.DateType()),
])


def assessment_id(deterministic_from: list[str] | None = None):
    """``asm_`` + 12 hex.  With key columns the id is a hash of them (retries and replays write the
    same id: exactly-once friendly); without, a random ``uuid()``."""
    if deterministic_from:
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in deterministic_from])
        return F.concat(F.lit("asm_"), F.substring(F.sha2(key, 256), 1, 12))
    return F.concat(F.lit("asm_"), F.substring(F.regexp_replace(F.expr("uuid()"), "-", ""), 1, 12))


def to_history(assessed: DataFrame, request_cols: list[str], response_cols: list[str],
               key_cols: list[str] | None = None, id_col: str = "telemetry_id") -> DataFrame:
    """S6 rows: id, saved_at, request JSON, response JSON.

    The id is a hash of ``key_cols``; by default of the row id with city and time, so two requests of one city and time
    keep ids of their own (without a row id: of the whole request).  12 hex digits name an assessment for people;
    they are no key for joins over billions of rows.
    """
    key = list(key_cols) if key_cols else [id_col, "city", "timestamp"] if id_col in assessed.columns else list(request_cols)
    return assessed.select(
        assessment_id(key).alias("assessment_id"),
        F.current_timestamp().alias("saved_at"),
        F.to_json(F.struct(*request_cols)).alias("request"),
        F.to_json(F.struct(*response_cols)).alias("response"),
    ).withColumn("date", F.to_date("saved_at"))


def append_history(history: DataFrame, path: str) -> None:
    """Append (JSON lines, date partitions)."""
    history.write.mode("append").partitionBy("date").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Corrupt lines are skipped, a missing store reads as empty; any other failure is raised."""
    try:
        return spark.read.schema(HISTORY_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], HISTORY_SCHEMA)


def newest(history: DataFrame, limit: int = 20) -> DataFrame:
    """K1: newest first, N clipped to 1..200 (TakeOrderedAndProject: a per-task top-N, then merge)."""
    n = max(1, min(200, int(limit)))
    return history.orderBy(F.col("saved_at").desc(), F.col("assessment_id")).limit(n)


# ---------------------------------------------------------------------------
# Models (S9)
# ---------------------------------------------------------------------------
def save_model(models: list[LinearModel], path: str, thresholds: dict[str, float] | None = None) -> None:
    """Linear models as two tables: feature parameters, and city weights by target."""
    spark = next(m.city_weights.sparkSession for m in models if m.city_weights is not None)
    rows, cities = [], None
    for m in models:
        rows += [(m.target, k, c, m.pre.medians[c], m.pre.means[c], m.pre.stds[c], m.weights[c]) for k, c in enumerate(m.pre.numeric_features)]
        rows.append((m.target, -1, "__bias__", None, None, None, m.bias))
        if thresholds and m.target in thresholds:
            rows.append((m.target, -2, "__threshold__", None, None, None, thresholds[m.target]))
        if m.city_weights is not None:
            own = m.city_weights.select(F.lit(m.target).alias("target"), "city", F.col(m.city_weight_col).alias("weight"))
            cities = own if cities is None else cities.unionByName(own)
    params = spark.createDataFrame(rows, "target string, position int, feature string, median double, mean double, std double, weight double")
    params.coalesce(1).write.mode("overwrite").parquet(f"{path}/params")
    cities.write.mode("overwrite").parquet(f"{path}/city_weights")


def load_model(spark: SparkSession, path: str) -> tuple[list[LinearModel], dict[str, float]]:
    """(models, thresholds) as saved; parameters (a few rows a target) are read, city weights stay tables."""
    params, cities = spark.read.parquet(f"{path}/params").orderBy("target", "position").collect(), spark.read.parquet(f"{path}/city_weights")
    models, thresholds = [], {}
    for target in dict.fromkeys(r["target"] for r in params):
        own = [r for r in params if r["target"] == target]
        features = [r for r in own if r["position"] >= 0]
        named = {r["feature"]: r["weight"] for r in own if r["position"] < 0}
        pre = Preprocessor([r["feature"] for r in features], *({r["feature"]: r[k] for r in features} for k in ("median", "mean", "std")))
        models.append(LinearModel(target, pre, {r["feature"]: r["weight"] for r in features}, named["__bias__"], cities.where(F.col("target") == target).select("city", "weight")))
        if "__threshold__" in named:
            thresholds[target] = named["__threshold__"]
    return models, thresholds


def read_bundle(spark: SparkSession, path: str) -> tuple[list[LinearModel], dict[str, float], dict]:
    """(models, thresholds, global metrics) of a published JSON bundle.

    A bundle has ``targets`` by name, each with a ``preprocessor`` (numeric_features, city_categories, medians, means, stds),
    a ``model`` (weights: the numeric ones, then one a city; bias) and a ``threshold``.
    """
    import json

    body = json.loads(spark.read.text(path, wholetext=True).first()[0])  # one model file
    models, thresholds = [], {}
    for target, t in body["targets"].items():
        p, weights = t["preprocessor"], t["model"]["weights"]
        names, cities = p["numeric_features"], p.get("city_categories", [])
        if len(weights) != len(names) + len(cities):
            raise ValueError(f"{target}: {len(weights)} weights for {len(names)} features and {len(cities)} cities")
        pre = Preprocessor(names, p["medians"], p["means"], p["stds"], cities)
        table = spark.createDataFrame(list(zip(cities, map(float, weights[len(names):]), strict=True)), "city string, weight double")
        models.append(LinearModel(target, pre, dict(zip(names, map(float, weights), strict=False)), float(t["model"]["bias"]), table))
        thresholds[target] = float(t.get("threshold", 0.5))
    return models, thresholds, body.get("global_metrics", {})
