"""Sources and sinks: path rules, CSV and Parquet scans, prepared splits, flat payloads, records, fitted nodes."""

from __future__ import annotations

import os
import shutil
import tempfile
import urllib.request
import uuid
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings that count as missing in a CSV field.
DEFAULT_NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
SCHEMES = ("", "file", "http", "https", "s3a", "hdfs", "abfs", "abfss", "gs", "viewfs")
SPLITS = ("train", "validation", "test")


@dataclass(frozen=True)
class Source:
    path: str
    format: str
    scheme: str


def resolve_source(uri: str, format: str | None = None, schemes: tuple[str, ...] = SCHEMES) -> Source:
    """Path, format and scheme of a dataset URI; the format comes from the suffix, without any query string."""
    uri = (uri or "").strip()
    if not uri:
        raise ValueError("the dataset URI is blank")
    parts = urlparse(uri)
    scheme = parts.scheme.lower() if len(parts.scheme) > 1 else ""
    if scheme not in schemes:
        raise ValueError(f"scheme {scheme!r} is not allowed; allowed: {', '.join(filter(None, schemes))} or a path")
    path = uri if scheme not in ("", "file") else uri if not scheme else (f"//{parts.netloc}" if parts.netloc else "") + unquote(parts.path)
    suffix = os.path.splitext(parts.path if scheme else uri)[1].lower()
    found = format or {".csv": "csv", ".parquet": "parquet", ".pq": "parquet"}.get(suffix)
    if found not in ("csv", "parquet"):
        raise ValueError(f"can't tell the format of {uri!r}; give a .csv, .parquet or .pq path, or format=")
    if found == "parquet" and scheme in ("http", "https"):
        raise ValueError("Parquet over http isn't read; stage it to a file system first")
    return Source(path, found, scheme)


def load(spark: SparkSession, uri: str, *, format: str | None = None, na_tokens=DEFAULT_NA, schema=None) -> DataFrame:
    """Scan a CSV or Parquet dataset. CSV types are inferred over strings whose missing-value tokens are null."""
    source = resolve_source(uri, format)
    path = source.path
    if source.scheme in ("http", "https"):
        path = staged(spark, path)
    elif not source.scheme or source.scheme == "file":
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            raise FileNotFoundError(path)
    if source.format == "parquet":
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    raw = spark.read.csv(path, header=True, inferSchema=False)
    clean = raw.select([F.when(~F.col(f"`{c}`").isin(*na_tokens), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return cast_to(clean, schema) if schema else infer_types(clean)


def staged(spark: SparkSession, url: str) -> str:
    """The path of a copy of ``url`` in the shared folder, which executors can read as well."""
    from sparkforest.operators.train import scratch

    target = f"{scratch(spark)}/{os.path.basename(urlparse(url).path) or 'data.csv'}"
    with urllib.request.urlopen(url) as found, tempfile.NamedTemporaryFile() as local:  # on the driver alone
        shutil.copyfileobj(found, local)
        local.flush()
        path = spark._jvm.org.apache.hadoop.fs.Path
        to = path(target)
        to.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(path(local.name), to)
    return target


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def infer_types(df: DataFrame) -> DataFrame:
    """The narrowest of bigint, double, boolean that every value of a string column has, in one pass; else string."""
    kinds = ("bigint", "double", "boolean")
    checks = [F.min((F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast(k).isNotNull()).cast("int")).alias(f"{i}_{k}") for i, c in enumerate(df.columns) for k in kinds]
    checks += [F.count(f"`{c}`").alias(f"{i}_n") for i, c in enumerate(df.columns)]
    row = df.agg(*checks).first()
    kind = lambda i: next((k for k in kinds if row[f"{i}_n"] and row[f"{i}_{k}"]), "string")
    return df.select([F.col(f"`{c}`").cast(kind(i)).alias(c) for i, c in enumerate(df.columns)])


def write_prepared(df: DataFrame, root: str, job_id: str, schema_row: DataFrame | None = None, report_row: DataFrame | None = None) -> None:
    """Splits as one table partitioned by ``split``, with schema and report as JSON beside it. Spark's commit
    protocol makes each write whole or absent."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{root}/jobs/{job_id}/prepared")
    for name, row in (("schema", schema_row), ("report", report_row)):
        if row is not None:
            row.write.mode("overwrite").json(f"{root}/jobs/{job_id}/{name}")


def read_split(spark: SparkSession, root: str, job_id: str, split: str) -> DataFrame:
    """One split; the partition filter reads only its folder."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    return spark.read.parquet(f"{root}/jobs/{job_id}/prepared").where(F.col("split") == split)


def explode_payload(df: DataFrame, id: str, values: str, n_rows: str, n_cols: str) -> DataFrame:
    """Rows (id, row_no, features) of flat row-major payloads; a size that doesn't fit is an error."""
    fits = F.size(values) == F.col(n_rows) * F.col(n_cols)
    checked = F.when(fits, F.col(values)).otherwise(F.raise_error(F.lit("payload size is not n_rows * n_cols")).cast("array<double>"))
    rows = F.when(F.col(n_rows) > 0, F.transform(F.sequence(F.lit(0), F.col(n_rows).cast("int") - 1), lambda i: F.slice(F.col("_v"), i * F.col(n_cols).cast("int") + 1, F.col(n_cols).cast("int"))))
    return df.withColumn("_v", checked).select(F.col(id), F.posexplode(rows).alias("row_no", "features"))


def pack_payload(df: DataFrame, id: str, row_no: str, feature_cols: list[str]) -> DataFrame:
    """(id, values, n_rows, n_cols) of each request's rows; a request is one message, so its size is bounded. Requests are
    dealt into as many partitions as the rows need."""
    from sparkforest.operators.train import dealt

    df = dealt(df.select(id, row_no, *[c for c in feature_cols if c not in (id, row_no)]), df.count(), id)
    one = F.struct(F.col(row_no).alias("r"), F.array(*[F.col(c).cast("double") for c in feature_cols]).alias("f"))
    rows = df.groupBy(id).agg(F.array_sort(F.collect_list(one)).alias("_rows"))
    return rows.select(id, F.flatten(F.transform("_rows", lambda s: s["f"])).alias("values"), F.size("_rows").alias("n_rows"), F.lit(len(feature_cols)).alias("n_cols"))


#: Record kinds and what a missing field becomes.
RECORDS = {
    "job": ("job_id string, status string, created_at double, updated_at double, dataset_uri string, target_column string, selected_experiment_id string, model_id string, message string", {"status": "PENDING"}),
    "experiment": ("experiment_id string, job_id string, ordinal int, status string, expected_trees int, completed_trees int, assigned_workers array<string>", {"status": "PENDING", "expected_trees": 0, "completed_trees": 0}),
    "model": ("model_id string, job_id string, experiment_id string, status string, created_at double", {"status": "READY"}),
}


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON documents as typed rows; fields that are missing take their defaults, unreadable documents are dropped."""
    schema, defaults = RECORDS[kind]
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return rows.fillna(defaults)


#: Columns of node tables, as files have them.
NODE_FIELDS = "tree_index int, node_id int, feature int, threshold double, left int, right int, prediction double, count double, gain double, missing_left boolean"


def _node_rows(nodes: DataFrame) -> DataFrame:
    """A node table with all columns in order; one that lacks ``missing_left`` gets nulls."""
    known = nodes if "missing_left" in nodes.columns else nodes.withColumn("missing_left", F.lit(None))
    return known.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in NODE_FIELDS.split(", ")])


def tree_digests(nodes: DataFrame) -> DataFrame:
    """(tree_index, digest, n_nodes): an order-free digest of a tree's nodes."""
    rows = _node_rows(nodes)
    fields = [F.col(c) for c in rows.columns]
    one = F.xxhash64(*fields, *[c.isNull() for c in fields])
    return rows.select("tree_index", one.alias("h")).groupBy("tree_index").agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("digest"), F.count("*").alias("n_nodes"))


def write_nodes(nodes: DataFrame, root: str, model_id: str) -> None:
    """Append the trees that aren't stored yet; a second write of the same trees adds nothing. A tree that is stored
    otherwise is an error: nothing is replaced, and no tree of another forest fills a gap."""
    spark, path = nodes.sparkSession, f"{root}/nodes"
    new, stored = _node_rows(nodes), stored_nodes(spark, root, model_id)
    if stored is not None:
        there = tree_digests(stored).select("tree_index", F.col("digest").alias("_there"))
        other = tree_digests(new).join(there, "tree_index").where("digest <> _there").select("tree_index").limit(5).collect()
        if other:
            raise ValueError(f"{model_id!r} has other trees of the indexes {sorted(r[0] for r in other)}")
        new = new.join(there, "tree_index", "left_anti")
    new.withColumn("model_id", F.lit(model_id)).write.mode("append").partitionBy("model_id").parquet(path)


def read_nodes(spark: SparkSession, root: str, model_id: str | None) -> DataFrame:
    """A model's trees, or those of all models."""
    nodes = spark.read.schema(f"{NODE_FIELDS}, model_id string").parquet(f"{root}/nodes")
    return nodes if model_id is None else nodes.where(F.col("model_id") == model_id)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stored_nodes(spark: SparkSession, root: str, model_id: str) -> DataFrame | None:
    """The trees of a model; None where nothing has been stored yet."""
    return read_nodes(spark, root, model_id) if _exists(spark, f"{root}/nodes") else None


def write_trees(nodes: DataFrame, root: str, key: str) -> None:
    """Append grown trees under the key of their content. Each node says how many its tree has, by which a reader knows
    whether a tree is whole, whatever the file system does when a writer dies."""
    rows = _node_rows(nodes)
    sizes = rows.groupBy("tree_index").agg(F.count("*").alias("n_nodes"))
    rows.join(sizes, "tree_index").write.mode("append").parquet(f"{root}/trees/{key}")


def whole_trees(spark: SparkSession, root: str, key: str) -> tuple[DataFrame | None, dict[int, int]]:
    """(nodes, {tree index: number of nodes}) of the trees that are stored whole under the key; a tree that two writers
    stored, which are equal, counts once."""
    path = f"{root}/trees/{key}"
    if not _exists(spark, path):
        return None, {}
    nodes = spark.read.schema(f"{NODE_FIELDS}, n_nodes long").parquet(path).dropDuplicates(["tree_index", "node_id"])
    counts = nodes.groupBy("tree_index").agg(F.count("*").alias("n"), F.max("n_nodes").alias("of")).where("n = of")
    whole = {r["tree_index"]: r["n"] for r in counts.collect()}  # a row for each tree
    return nodes.where(F.col("tree_index").isin(list(whole))).drop("n_nodes"), whole


CODE_FIELDS = "column string, value string, n long, mean double, code long"


def write_codes(codes: DataFrame, root: str, model_id: str) -> None:
    """A model's category codes, a table of its own; written again, it takes the place of the one before."""
    codes.write.mode("overwrite").parquet(f"{root}/codes/{model_id}")


def read_codes(spark: SparkSession, root: str, model_id: str) -> DataFrame:
    return spark.read.schema(CODE_FIELDS).parquet(f"{root}/codes/{model_id}")


def new_id(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex}"


def is_missing(column: Column, na_tokens=DEFAULT_NA) -> Column:
    return column.isNull() | column.isin(*na_tokens)
