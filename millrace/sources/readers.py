"""Documents, manifests and id tables from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.core.session import prepare
from millrace.operators.interleaved import SCHEMA, align
from millrace.operators.rows import add_id

EXTENSIONS = {"json": "*.{json,jsonl,ndjson}", "parquet": "*.parquet", "csv": "*.{csv,tsv}"}


def read_documents(
    spark: SparkSession, path: str | list[str], fmt: str = "parquet", fields: list[str] | None = None, schema: str | None = None,
    block_bytes: int | None = None, file_limit: int | None = None, with_id: str | None = None, allow_empty: bool = False, **options,
) -> DataFrame:
    """Rows of parquet or line-wise JSON files below a path.

    ``fields`` projects (missing ones are left out), and with parquet the scan
    reads no others. ``block_bytes`` bounds a task's input. ``file_limit`` takes
    the first files by name. ``with_id`` adds ids by file and place. An empty
    input raises unless ``allow_empty``.
    """
    prepare(spark)
    if fmt not in EXTENSIONS:
        raise ValueError(f"unknown format {fmt}")
    if block_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block_bytes))
    reader = spark.read.options(**{"recursiveFileLookup": "true", "pathGlobFilter": EXTENSIONS[fmt], **options})
    df = (reader.schema(schema) if schema else reader).format(fmt).load(path)
    if file_limit is not None:
        some = sorted(df.inputFiles())[:file_limit]
        df = (spark.read.schema(df.schema).options(**options).format(fmt)).load(some)
    if not allow_empty and df.isEmpty():
        raise ValueError(f"no rows in {path}")
    if fields:
        df = df.select(*(c for c in fields if c in df.columns))
    return add_id(df, with_id) if with_id else df


def read_listed(spark: SparkSession, listing: str, root: str, fmt: str = "parquet", **options) -> DataFrame:
    """Files that a JSON list of relative paths names."""
    names = prepare(spark).read.text(listing, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("p"))
    return spark.read.format(fmt).options(**options).load([f"{root.rstrip('/')}/{r.p}" for r in names.collect()])


def read_manifest(spark: SparkSession, path: str, audio_dir: str | None = None, path_col: str = "audio_filepath", how: str = "basename", schema: str | None = None) -> DataFrame:
    """A JSON-lines manifest; paths are put below ``audio_dir`` by file name or as they are relative."""
    reader = prepare(spark).read
    df = (reader.schema(schema) if schema else reader).json(path)
    if audio_dir:
        tail = F.element_at(F.split(path_col, "/"), -1) if how == "basename" else F.col(path_col)
        df = df.withColumn(path_col, F.concat_ws("/", F.lit(audio_dir.rstrip("/")), tail))
    return df


def read_transcripts(spark: SparkSession, path: str, audio_dir: str, columns: tuple[str, ...] = ("id", "file_name", "raw_text", "text")) -> DataFrame:
    """Manifest rows from a tab-separated transcript."""
    schema = ", ".join(f"{c} string" for c in columns)
    df = prepare(spark).read.schema(schema).options(sep="\t", quote="").csv(path)
    return df.select(F.concat_ws("/", F.lit(audio_dir.rstrip("/")), "file_name").alias("audio_filepath"), "text")


def list_media(spark: SparkSession, path: str, pattern: str = "*.wav", limit: int | None = None, with_content: bool = False) -> DataFrame:
    """Paths (and bytes) of media files; without bytes the scan doesn't read them."""
    df = prepare(spark).read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=pattern).load(path)
    df = df.select("path", "length", *(["content"] if with_content else []))
    return df.orderBy("path").limit(limit) if limit else df


def read_interleaved(spark: SparkSession, path: str) -> DataFrame:
    """Interleaved parquet with the usual columns first, cast."""
    return align(prepare(spark).read.option("mergeSchema", "true").parquet(path), SCHEMA)


def read_pdf_manifest(spark: SparkSession, path: str, names_col: str = "cc_pdf_file_names", name_col: str = "file_name", url_col: str = "url", limit: int | None = None) -> DataFrame:
    """(file_name, url) of PDFs, from a list column or a single one."""
    df = prepare(spark).read.json(path)
    url = F.col(url_col) if url_col in df.columns else F.lit(None).cast("string")
    if names_col in df.columns:
        df = df.select(F.explode(names_col).alias("file_name"), url.alias("url"))
    else:
        df = df.select(F.col(name_col).alias("file_name"), url.alias("url"))
    return df.limit(limit) if limit else df


def read_lance(spark: SparkSession, path: str, fields: list[str] | None = None, fragments: list[int] | None = None) -> DataFrame:
    """A Lance dataset at its present version, fragment by fragment, with ``_rowid`` and ``_fragment_id``. Needs the lance package."""
    try:
        import lance
    except ImportError as e:
        raise ImportError("reading Lance needs the lance package") from e
    from pyspark.sql.pandas.types import from_arrow_schema

    data = lance.dataset(path)
    version, ids = data.version, [f.fragment_id for f in data.get_fragments()]
    if fragments is not None and set(fragments) - set(ids):
        raise ValueError(f"no fragments {sorted(set(fragments) - set(ids))}")
    base = from_arrow_schema(data.schema if fields is None else data.scanner(columns=fields).projected_schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in b.column(0).to_pylist():
                part = lance.dataset(path, version=version).get_fragment(i)
                for x in part.scanner(columns=fields, with_row_id=True).to_batches():
                    yield pa.RecordBatch.from_arrays([*x.columns, pa.array([i] * x.num_rows, pa.int32())], names=[*x.schema.names, "_fragment_id"])

    out = base.add("_rowid", "long").add("_fragment_id", "int")
    chosen = fragments if fragments is not None else ids
    return spark.createDataFrame([(i,) for i in chosen], "i int").repartition(max(1, len(chosen))).mapInArrow(run, out)

