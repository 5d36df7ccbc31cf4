"""Writers: documents, token streams, tars, and helpers that merge or split output.

Executors write only through Spark or to a folder that is named by the caller
and shared. Files are written under a temporary name and renamed, so a task
that runs again leaves one copy.
"""

from __future__ import annotations

import io
import json
import os
import struct
import tarfile
import uuid
from collections.abc import Iterator
from contextlib import suppress
from itertools import chain, groupby, islice
from operator import itemgetter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.core.session import prepare
from millrace.operators.interleaved import align, drop_failed
from millrace.operators.models import Factory, infer

#: Fixed values of the token stream format: the index's first bytes and its codes of number types.
MAGIC = b"MMIDIDX\x00\x00"
CODES = {"uint16": 8, "int32": 4}


def write_documents(df: DataFrame, path: str, fmt: str = "parquet", fields: list[str] | None = None, mode: str = "ignore", max_records: int | None = None, partition_by: list[str] | None = None) -> None:
    """Parquet or JSON lines (nulls are written). ``ignore`` adds files to whatever is there, ``error`` wants an empty place."""
    df = df.select(*fields) if fields else df
    how = {"ignore": "append", "append": "append", "overwrite": "overwrite", "error": "errorifexists"}[mode]
    w = df.write.mode(how)
    if max_records:
        w = w.option("maxRecordsPerFile", max_records)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.option("ignoreNullFields", "false").format(fmt).save(path)


def write_interleaved(df: DataFrame, path: str, on_error: str = "error", mode: str = "ignore") -> None:
    write_documents(align(drop_failed(df, on_error)), path, mode=mode)


def place(final: str, fill) -> None:
    """Fill a file under a name of its own, then move it to its place."""
    os.makedirs(os.path.dirname(final), exist_ok=True)
    tmp = f"{final}.{uuid.uuid4().hex}.tmp"
    try:
        with open(tmp, "wb") as f:
            fill(f)
        os.replace(tmp, final)
    finally:
        with suppress(FileNotFoundError):
            os.remove(tmp)


class _Unkept(list):
    """What a tar's writer puts its headers in, and never reads."""

    def append(self, _) -> None:
        pass


def write_tars(df: DataFrame, folder: str, per_tar: int = 1000) -> DataFrame:
    """Tars of at most ``per_tar`` rows' members; returns (tar, members) of what was written.

    ``df`` has name and content. A tar's name is its partition's number and its
    place there. ``folder`` is a shared, mounted folder.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        rows = ((n.as_py(), c.as_py() or b"") for b in batches for n, c in zip(b.column(0), b.column(1)))
        while (first := next(rows, None)) is not None:
            final, members = f"{folder}/{part:05d}-{k:05d}.tar", 0

            def fill(f):
                nonlocal members
                with tarfile.open(fileobj=f, mode="w") as tar:
                    tar.members = _Unkept()
                    for name, content in chain([first], islice(rows, per_tar - 1)):
                        info = tarfile.TarInfo(name)
                        info.size = len(content)
                        tar.addfile(info, io.BytesIO(content))
                        members += 1

            place(final, fill)
            yield pa.RecordBatch.from_pydict({"tar": [final], "members": pa.array([members], pa.int64())})
            k += 1

    return df.select("name", "content").mapInArrow(run, "tar string, members long")


def sample_members(df: DataFrame) -> DataFrame:
    """(name, content) of tar members for interleaved rows: a JSON with text and image lists by position, and the images."""
    file = F.concat_ws(".", F.concat_ws("_", "sample_id", "position"), F.element_at(F.split("content_type", "/"), -1))
    rows = df.where("position >= 0").withColumn("__file", F.when(F.col("modality") == "image", file))
    item = F.struct("position", F.when(F.col("modality") == "text", F.col("text_content")).alias("t"), F.col("__file").alias("i"))
    listed = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    body = F.to_json(F.struct(F.transform("x", lambda x: x["t"]).alias("texts"), F.transform("x", lambda x: x["i"]).alias("images")), {"ignoreNullFields": "false"})
    meta = listed.select(F.concat("sample_id", F.lit(".json")).alias("name"), body.cast("binary").alias("content"))
    return meta.unionByName(rows.where("modality = 'image' AND binary_content IS NOT NULL").select(F.col("__file").alias("name"), F.col("binary_content").alias("content")))


def index_bytes(lengths: list[int], dtype: str) -> bytes:
    """The index of a token stream: one document a sequence."""
    n = np.asarray(lengths, dtype=np.int64)
    starts = (np.cumsum(n) - n) * np.dtype(dtype).itemsize
    head = MAGIC + struct.pack("<QBQQ", 1, CODES[dtype], len(n), len(n) + 1)
    return head + n.astype("<i4").tobytes() + starts.astype("<i8").tobytes() + np.arange(len(n) + 1, dtype="<i8").tobytes()


def read_index(raw: bytes) -> tuple[str, np.ndarray]:
    """(number type, lengths) of an index."""
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not an index")
    _, code, n, _ = struct.unpack_from("<QBQQ", raw, len(MAGIC))
    return {v: k for k, v in CODES.items()}[code], np.frombuffer(raw, dtype="<i4", count=n, offset=len(MAGIC) + 25)


def write_tokens(df: DataFrame, factory: Factory, folder: str, vocabulary: int, input_col: str = "text", end: int | None = None) -> DataFrame:
    """Token streams (.bin) and indexes (.idx), a pair for each partition; returns (prefix, documents, tokens).

    Two bytes a token if the vocabulary fits, else four; ``end`` is put after
    each text. Null texts are passed over. ``folder`` is shared and mounted.
    """
    prepare(df.sparkSession)
    dtype = "uint16" if vocabulary <= 1 << 16 else "int32"
    ids = infer(df.select(input_col).where(F.col(input_col).isNotNull()), factory, "__ids", "array<int>", input_col, sort_by_length=False).select("__ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        prefix, lengths = f"{folder}/{TaskContext.get().partitionId():05d}", []

        def fill(f):
            for b in batches:
                for x in b.column(0).to_pylist():
                    x = [*x, end] if end is not None else x
                    f.write(np.asarray(x, dtype=dtype).tobytes())
                    lengths.append(len(x))

        place(f"{prefix}.bin", fill)
        place(f"{prefix}.idx", lambda f: f.write(index_bytes(lengths, dtype)))
        yield pa.RecordBatch.from_pydict({"prefix": [prefix], "documents": pa.array([len(lengths)], pa.int64()), "tokens": pa.array([sum(lengths)], pa.int64())})

    return ids.mapInArrow(run, "prefix string, documents long, tokens long")


def merge_token_files(folder: str, prefix: str) -> int:
    """All pairs of a folder as one, in order of name; returns the number of documents."""
    lengths, dtype = [], None
    Path(prefix).parent.mkdir(parents=True, exist_ok=True)
    with open(f"{prefix}.bin", "wb") as out:
        for idx in sorted(Path(folder).glob("*.idx")):
            kind, n = read_index(idx.read_bytes())
            if dtype not in (None, kind):
                raise ValueError("number types differ")
            dtype = kind
            lengths += n.tolist()
            with open(idx.with_suffix(".bin"), "rb") as f:
                while part := f.read(1 << 24):
                    out.write(part)
    Path(f"{prefix}.idx").write_bytes(index_bytes(lengths, dtype or "int32"))
    return len(lengths)


def merge_lines(spark: SparkSession, shards: str, target: str, delete: bool = True) -> int:
    """Line files of a folder as one file, in order of name and line; returns the number of lines.

    On a mounted folder the tasks that read the lines write them, each from
    where its stretch of a file begins in the target. Elsewhere lines are sorted
    by where they stand and written by one task, which spills if it must.
    """
    meta = F.col("_metadata")
    reader = prepare(spark).read.option("pathGlobFilter", "*.json*")
    rows = reader.text(shards).select("value", meta["file_name"].alias("file"), meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"))
    stretches = rows.groupBy("file", "path", "block").agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.count(F.lit(1)).alias("n")).orderBy("file", "path", "block").collect()  # some for each file
    n, folder = sum(s.n for s in stretches), f"{target}.{uuid.uuid4().hex}.tmp"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":
        _written_in_place(rows, stretches, fs, path, folder, target)
    else:
        rows.coalesce(1).sortWithinPartitions("file", "path", "block", "at").select("value").write.text(folder)
        part = next(s.getPath() for s in fs.globStatus(path(f"{folder}/part-*")))
        fs.delete(path(target), False)
        if not fs.rename(part, path(target)):
            raise OSError(f"can't move {part} to {target}")
        fs.delete(path(folder), True)
    for s in fs.globStatus(path(f"{shards}/*.json*")) if delete else []:
        if s.isFile():
            fs.delete(s.getPath(), False)
    return n


def _written_in_place(rows: DataFrame, stretches: list, fs, path, folder: str, target: str) -> None:
    """Lines into one file by many tasks: a task that runs again writes the same bytes to the same places."""
    local = lambda p: fs.makeQualified(path(p)).toUri().getPath()
    starts, end = {}, 0
    for s in stretches:
        starts[s.path, s.block], end = end, end + s.bytes
    tmp = local(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, 0
        with open(tmp, "r+b") as f:
            for b in batches:
                for key, lines in groupby(zip(*(b.column(k).to_pylist() for k in range(3))), itemgetter(0, 1)):
                    if key != now:
                        now = key
                        f.seek(starts[key])
                    done += f.write(b"".join(x + b"\n" for _, _, x in lines))
        yield pa.RecordBatch.from_pydict({"bytes": pa.array([done], pa.int64())})

    with open(tmp, "wb") as f:
        f.truncate(end)
    try:
        written = rows.select("path", "block", F.col("value").cast("binary")).mapInArrow(run, "bytes long").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        if written != end:
            raise OSError(f"{written} of {end} bytes written to {target}")
        fs.delete(path(target), False)
        os.replace(tmp, local(target))
    finally:
        with suppress(FileNotFoundError):
            os.remove(tmp)


def split_by_size(spark: SparkSession, source: str, target: str, megabytes: int, fmt: str = "parquet") -> None:
    """Files of about a size from large ones; text and row groups are read in splits of it."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(megabytes << 20))
        spark.read.format(fmt).load(source).write.mode("append").option("ignoreNullFields", "false").format(fmt).save(target)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def finish_manifest(df: DataFrame, manifest: str, metrics: str) -> None:
    """A manifest as JSON lines, and its totals as one JSON row."""
    df.write.mode("overwrite").json(manifest)
    df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("seconds")).write.mode("overwrite").json(metrics)


def clip_paths(df: DataFrame, root: str) -> DataFrame:
    """Where a clip, its metadata and its preview go."""
    return df.select("*", *(F.concat_ws("/", F.lit(root), F.lit(kind), F.concat("clip_id", F.lit(end))).alias(f"{kind}_path") for kind, end in (("clips", ".mp4"), ("metas", ".json"), ("previews", ".webp"))))


def write_lance(df: DataFrame, path: str, mode: str = "create") -> int:
    """Fragments written by tasks, committed at once by the driver; returns the version. Needs the lance package."""
    try:
        import lance
    except ImportError as e:
        raise ImportError("writing Lance needs the lance package") from e
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)

    def run(batches):
        parts = lance.fragment.write_fragments(pa.RecordBatchReader.from_batches(schema, batches), path)
        yield pa.RecordBatch.from_pydict({"f": [json.dumps(p.to_json()) for p in parts]})

    done = [lance.FragmentMetadata.from_json(r.f) for r in df.mapInArrow(run, "f string").collect()]
    kind = lance.LanceOperation.Append(done) if mode == "append" else lance.LanceOperation.Overwrite(schema, done)
    return lance.LanceDataset.commit(path, kind).version
