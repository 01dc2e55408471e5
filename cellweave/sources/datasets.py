"""Readers, writers and table-level checks of datasets."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Platforms a dataset may come from.
PLATFORMS = ("visium", "xenium", "slide_seq", "merfish", "seqfish", "generic")
READERS = {"parquet": "parquet", "csv": "csv", "jsonl": "json"}


def read_matrix(spark: SparkSession, path: str, fmt: str = "parquet", platform: str = "generic") -> dict[str, DataFrame]:
    """obs, var and expr tables below ``path``; an unknown platform or format is an error."""
    if platform.lower() not in PLATFORMS:
        raise ValueError(f"unknown platform {platform!r}")
    if fmt not in READERS:
        raise ValueError(f"unknown format {fmt!r}")
    schemas = {
        "obs": "cell_id string, sample_id string, cell_type string, x double, y double",
        "var": "gene_id string, symbol string",
        "expr": "cell_id string, gene_id string, value double",
    }
    reader = spark.read
    if fmt == "parquet":
        return {name: reader.parquet(f"{path}/{name}") for name in schemas}
    return {name: reader.format(READERS[fmt]).option("header", fmt == "csv").schema(schema).load(f"{path}/{name}") for name, schema in schemas.items()}


def read_mtx_triplets(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A text matrix directory: matrix.mtx (row, column, count), barcodes.tsv and features.tsv.

    Line numbers of the two index files come from the file itself, read whole
    lines in one partition per file; the matrix is scanned in parallel.
    """
    lines = spark.read.option("sep", " ").option("comment", "%").schema("row long, col long, value double").csv(f"{path}/matrix.mtx")

    def numbered(name: str, schema: str) -> DataFrame:
        rows = spark.read.option("sep", "\t").schema(schema).csv(f"{path}/{name}").withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33))
        sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
        offset = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))  # one row per partition
        return rows.join(offset, "_p").withColumn("idx", F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).drop("_m", "_p", "_o")

    barcodes = numbered("barcodes.tsv", "cell_id string")
    features = numbered("features.tsv", "gene_id string, symbol string, kind string")
    n_rows, n_cols, n_entries = features.count(), barcodes.count(), lines.count() - 1
    # The size line holds (rows, columns, entries); should the last entry look the same, one of the two stays.
    size_line = (F.col("row") == n_rows) & (F.col("col") == n_cols) & (F.col("value") == n_entries)
    body = lines.filter(~size_line)
    if lines.filter(size_line).count() > 1:
        body = body.unionByName(lines.filter(size_line).limit(1))
    expr = body.join(features.select(F.col("idx").alias("row"), "gene_id"), "row").join(barcodes.select(F.col("idx").alias("col"), "cell_id"), "col").select("cell_id", "gene_id", "value")
    return {"obs": barcodes.select("cell_id"), "var": features.select("gene_id", "symbol"), "expr": expr}


def read_spots(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Spot positions: barcode, in_tissue, array_row, array_col, pixel row and column; tissue spots only."""
    schema = "cell_id string, in_tissue int, array_row long, array_col long, pxl_row double, pxl_col double"
    rows = spark.read.option("header", header).schema(schema).csv(path)
    return rows.filter("in_tissue = 1").select("cell_id", "array_row", "array_col", F.col("pxl_col").alias("x"), F.col("pxl_row").alias("y"))


def make_unique_ids(df: DataFrame, key: str, order: str) -> DataFrame:
    """Second and later copies of a name get ``-1``, ``-2`` …, in ``order``."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return df.withColumn("_n", n).withColumn(key, F.when(F.col("_n") > 0, F.concat_ws("-", key, F.col("_n").cast("string"))).otherwise(F.col(key))).drop("_n")


def coordinate_report(obs: DataFrame) -> DataFrame:
    """One row: rows, missing and non-finite coordinates."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return obs.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("x").isNull() | F.col("y").isNull(), 1)).alias("n_missing"),
        F.count(F.when(bad("x") | bad("y"), 1)).alias("n_non_finite"))


def validate_coords(obs: DataFrame, required: bool = True) -> DataFrame:
    """The table itself, or an error: both axes present, numeric, non-null and finite."""
    types = dict(obs.dtypes)
    missing = [c for c in ("x", "y") if c not in types]
    if missing:
        if required:
            raise ValueError(f"coordinates missing: {missing}")
        return obs
    wrong = [c for c in ("x", "y") if types[c] not in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    if wrong:
        raise ValueError(f"coordinates not numeric: {wrong}")
    report = coordinate_report(obs.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).first()
    if report["n_missing"] or report["n_non_finite"]:
        raise ValueError(f"coordinates missing in {report['n_missing']} rows and not finite in {report['n_non_finite']}")
    return obs


def merge_samples(samples: list[tuple[DataFrame, DataFrame]], names: list[str], join: str = "inner", batch_key: str = "batch", rows_per_task: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """Stack (expr, obs) samples: ids get the sample's name in front, genes are those of all samples or of any.

    Genes of all samples are looked up with about ``rows_per_task`` rows of expr in a task, so that its memory doesn't grow with them.
    """
    if len(set(names)) != len(names) or len(names) != len(samples):
        raise ValueError("sample names must be unique and as many as the samples")
    if join not in ("inner", "outer"):
        raise ValueError(f"unknown join {join!r}")
    expr = obs = None
    for (e, o), name in zip(samples, names):
        tag = F.concat_ws("_", F.lit(name), F.col("cell_id").cast("string"))
        e, o = e.withColumn("cell_id", tag).withColumn(batch_key, F.lit(name)), o.withColumn("cell_id", tag).withColumn(batch_key, F.lit(name))
        expr = e if expr is None else expr.unionByName(e, allowMissingColumns=True)
        obs = o if obs is None else obs.unionByName(o, allowMissingColumns=True)
    if join == "inner":
        # one sum for each gene: a count of different samples would hold their pairs four times in a task
        seen = expr.groupBy("gene_id").agg(*[F.max(F.when(F.col(batch_key) == name, 1)).alias(f"_{i}") for i, name in enumerate(names)])
        shared = seen.dropna(subset=[f"_{i}" for i in range(len(names))]).select("gene_id")
        # Rows meet their gene, and usually their next sum, in one task: many rows need many tasks.
        parts = expr.count() // rows_per_task + 1
        if parts > int(expr.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            expr, shared = expr.repartition(parts, "gene_id"), shared.repartition(parts, "gene_id")
        expr = expr.join(shared, "gene_id").select(*expr.columns)  # genes are unique; a semi join would be pushed below the repartition
    return expr, obs


def pair_modalities(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of both sides with coordinates from the side that has them; differing cell sets are an error."""
    sides = a.select("cell_id", F.lit(1).alias("_s")).unionByName(b.select("cell_id", F.lit(2).alias("_s"))).groupBy("cell_id").agg(F.sum("_s").alias("_s"))
    if not sides.filter("_s <> 3").isEmpty():
        raise ValueError("the two modalities hold different cells")
    pick = lambda df, tag: df.select("cell_id", *[(F.col(c) if c in df.columns else F.lit(None)).cast("double").alias(f"{c}{tag}") for c in ("x", "y")])
    return pick(a, "1").join(pick(b, "2"), "cell_id").select("cell_id", F.coalesce("x1", "x2").alias("x"), F.coalesce("y1", "y2").alias("y"))


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "csv") -> None:
    """One folder per result table; executors write their own parts."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(f"{path}/{name}")


def write_summary_json(summary: DataFrame, path: str) -> None:
    """Result envelope rows as JSON lines."""
    summary.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def record_run(spark: SparkSession, path: str, skill: str, method: str, params: dict) -> None:
    """Append one provenance row to the run log."""
    row = spark.createDataFrame([(skill, method, {k: json.dumps(v) for k, v in params.items()})], "skill string, method string, params map<string,string>")
    row.withColumn("run_id", F.expr("uuid()")).withColumn("ts", F.current_timestamp()).write.mode("append").parquet(path)


def read_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """Parquet and JSON-lines files, concatenated; any other suffix is an error."""
    kinds = {".parquet": "parquet", ".json": "json", ".jsonl": "json"}
    grouped: dict[str, list[str]] = {}
    for f in files:
        suffix = PurePosixPath(f).suffix.lower()
        if suffix not in kinds:
            raise ValueError(f"unsupported file {f}")
        grouped.setdefault(kinds[suffix], []).append(f)
    out = None
    for kind, names in grouped.items():
        part = spark.read.format(kind).load(names)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def dump_generations(df: DataFrame, path: str, step: int) -> None:
    """Inputs, outputs and scores of one step as JSON lines."""
    df.withColumn("step", F.lit(step)).write.mode("overwrite").json(f"{path}/step={step}")
