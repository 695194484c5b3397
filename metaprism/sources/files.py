"""File scans and sinks.

Scans are Spark readers with explicit schemas; only the ARFF header (a few
lines) is parsed on the driver, the data lines are read by ``spark.read.text``
and parsed with ``from_csv`` in parallel.  Sinks are partitioned parquet
appends; scratch output goes to the shared checkpoint folder.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import Frame, infer_kinds

# fixed values: lower-case accented letters and their base letters (accent fold)
ACCENTED = "áàäâãåéèëêíìïîóòöôõúùüûñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuunc"


def scan_csv(spark: SparkSession, path: str, target: str | None = None, schema: str | None = None,
             row_id: str | None = None) -> Frame:
    """Header CSV -> Frame with the target split off as label."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    num, cat = infer_kinds(df, exclude={target, row_id})
    return Frame(df=df, num=tuple(num), cat=tuple(cat), label=target, row_id=row_id, name=os.path.basename(path))


def normalise_task(c) -> "F.Column":
    """lower(trim(text)) with accents removed."""
    return F.translate(F.lower(F.trim(c)), ACCENTED, PLAIN)


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV (tarea, task_id); task normalised."""
    df = spark.read.schema("tarea string, task_id long").csv(path)
    return df.select(normalise_task(F.col("tarea")).alias("tarea"), "task_id")


def scan_id_list(spark: SparkSession, path: str) -> DataFrame:
    """S3: one integer id per line (blank lines skipped); the task is the file
    name stem before the first underscore."""
    df = spark.read.text(path)
    # file name stem; for a Spark-written folder of part files, the folder name
    stem = F.regexp_extract(F.regexp_replace(F.input_file_name(), r"/part-[^/]*$", ""), r"([^/]+?)(\.[^./]*)?$", 1)
    return (df.select(F.trim("value").alias("v"), F.split(stem, "_").getItem(0).alias("tarea"))
            .where(F.col("v") != "")
            .select(normalise_task(F.col("tarea")).alias("tarea"), F.col("v").cast("long").alias("task_id")))


_ATTR = re.compile(r"@attribute\s+('([^']+)'|\"([^\"]+)\"|(\S+))\s+(.+)$", re.IGNORECASE)


def arff_schema(header_lines: list[str]) -> tuple[T.StructType, dict]:
    """Schema from the ARFF header: numeric/real/integer -> double, nominal
    {a,b} and string -> string.  Returns (schema, nominal levels)."""
    fields, levels = [], {}
    for line in header_lines:
        m = _ATTR.match(line.strip())
        if not m:
            continue
        name = m.group(2) or m.group(3) or m.group(4)
        kind = m.group(5).strip()
        if kind.startswith("{"):
            levels[name] = [v.strip().strip("'\"") for v in kind.strip("{}").split(",")]
            fields.append(T.StructField(name, T.StringType()))
        elif kind.lower() in ("numeric", "real", "integer"):
            fields.append(T.StructField(name, T.DoubleType()))
        else:
            fields.append(T.StructField(name, T.StringType()))
    return T.StructType(fields), levels


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, id): trimmed lines, ids in file order."""
    return spark.read.text(path).select(F.trim("value").alias("_line"), F.monotonically_increasing_id().alias("_id"))


def scan_arff(spark: SparkSession, path: str, header_path: str | None = None) -> Frame:
    """ARFF, last attribute is the class.  Spark finds the @data line and
    the @attribute lines before it (one row an attribute goes to the driver)
    and parses everything after it as data."""
    lines = _numbered(spark, header_path or path)
    is_data = F.lower("_line").startswith("@data")
    start = lines.where(is_data).agg(F.min("_id")).first()[0]
    head = lines.where(F.lower("_line").startswith("@attribute"))
    if start is not None:
        head = head.where(F.col("_id") < start)
    schema, _ = arff_schema([r["_line"] for r in head.orderBy("_id").collect()])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    data = _numbered(spark, path).where((F.col("_line") != "") & ~F.col("_line").startswith("%"))
    if header_path is None and start is not None:
        data = data.where(F.col("_id") > start)
    parsed = data.select(F.from_csv("_line", ddl, {"quote": "'", "nullValue": "?"}).alias("r")).select("r.*")
    label = schema.fields[-1].name
    num, cat = infer_kinds(parsed, exclude={label})
    return Frame(df=parsed, num=tuple(num), cat=tuple(cat), label=label, name=os.path.basename(path))


def write_arff(df: DataFrame, path: str, relation: str, nominal: dict[str, list[str]]) -> None:
    """Write a DataFrame as ARFF: header from the schema, data lines by Spark
    (text files in ``path``/data, header in ``path``/header.arff)."""
    spark = df.sparkSession
    lines = [f"@relation {relation}"]
    for f in df.schema.fields:
        if f.name in nominal:
            lines.append(f"@attribute {f.name} {{{','.join(nominal[f.name])}}}")
        elif isinstance(f.dataType, T.NumericType):
            lines.append(f"@attribute {f.name} numeric")
        else:
            lines.append(f"@attribute {f.name} string")
    lines.append("@data")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    quoted = [F.when(F.col(f.name).isNull(), F.lit("?")).otherwise(
        F.concat(F.lit("'"), F.col(f.name).cast("string"), F.lit("'")) if not isinstance(f.dataType, T.NumericType)
        else F.col(f.name).cast("string")) for f in df.schema.fields]
    df.select(F.concat_ws(",", *quoted).alias("value")).write.mode("overwrite").text(f"{path}/data")


def align_xy(fr: Frame) -> dict:
    """Label and features live in one DataFrame, so alignment is
    structural; one aggregate validates non-empty input and label presence."""
    r = fr.df.agg(F.count(F.lit(1)).alias("n"),
                  (F.count(fr.y()) if fr.label else F.lit(None)).alias("ny")).first()
    if r["n"] == 0:
        raise ValueError("X is empty")
    if fr.label and r["ny"] != r["n"]:
        raise ValueError("label has missing values")
    return {"rows": r["n"], "attrs": len(fr.attrs)}


RUN_LOG_SCHEMA = T.StructType([
    T.StructField("nombre_dataset", T.StringType()), T.StructField("num_pipeline", T.IntegerType()),
    T.StructField("num_modelo", T.IntegerType()), T.StructField("mtf_json", T.StringType()),
    T.StructField("pipeline_json", T.StringType()), T.StructField("paso_t", T.IntegerType()),
    T.StructField("estado_actual", T.ArrayType(T.DoubleType())), T.StructField("accion", T.StringType()),
    T.StructField("estado_siguiente", T.ArrayType(T.DoubleType())), T.StructField("llm_seleccionado", T.StringType()),
    T.StructField("nombre_modelo", T.StringType()), T.StructField("tipo_tarea", T.StringType()),
    T.StructField("metricas", T.StringType()), T.StructField("completado", T.IntegerType()),
    T.StructField("tiempo_ejecucion", T.DoubleType()),
])


def sink_run_log(log: DataFrame, path: str) -> None:
    """Batch append of run-log rows, partitioned by dataset."""
    log.select(*[F.col(f.name).cast(f.dataType) for f in RUN_LOG_SCHEMA.fields]) \
        .write.mode("append").partitionBy("nombre_dataset").parquet(path)


def metafeature_record(dataset: str, results: DataFrame) -> DataFrame:
    """S7 shape: one row per dataset with the (name -> value) map, its JSON
    text and the value vector ordered by name."""
    agg = results.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("mtf"),
                      F.transform(F.array_sort(F.collect_list(F.struct("name", "value"))), lambda s: s["value"]).alias("vector"))
    return agg.select(F.lit(dataset).alias("dataset"), "mtf", F.to_json("mtf").alias("mtf_json"), "vector")


def sink_metafeatures(record: DataFrame, path: str) -> None:
    """Append the per-dataset record."""
    record.write.mode("append").partitionBy("dataset").parquet(path)
