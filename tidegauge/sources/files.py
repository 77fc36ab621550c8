"""Typed file scans: CSV with exact headers, JSON lines with strict keys, vendor exports, raw artifacts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tidegauge.functions import rules as R
from tidegauge.operators.lab import EVENT_SCHEMA
from tidegauge.operators.scan import OBSERVATION_SCHEMA

# The vendor export's header.
VENDOR_HEADER = ("Date", "Price", "Open", "High", "Low", "Vol.", "Change %")
# Limits of an outcome evidence packet.
PACKET_ARTIFACTS = 32
PACKET_BYTES = 128 * 1024 * 1024

CHUNK_BYTES = 1 << 20
GROUP_BYTES = 128 << 20  # of the files that one task hashes, at most unless one file is larger
GROUP_FILES = 10_000
CHUNKED_STORES = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The header fields of the first file line, byte-order mark removed."""
    line = spark.read.text(path).limit(1).collect()
    if not line:
        raise ValueError(f"empty CSV: {path}")
    return [c.strip().strip('"') for c in line[0]["value"].lstrip("﻿").split(",")]


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], line_breaks: bool = False) -> DataFrame:
    """CSV as strings; the header must be exactly ``columns``, each once.

    Spark checks every file's header against the schema (``enforceSchema=false``)
    and a malformed row is kept in ``_corrupt`` instead of being dropped. A file
    is split over many tasks unless ``line_breaks`` allows quoted line breaks.
    """
    header = csv_header(spark, path)
    if len(set(header)) != len(header):
        raise ValueError(f"duplicate CSV headers: {path}")
    if header != list(columns):
        raise ValueError(f"CSV headers differ: {header}")
    schema = StructType([StructField(c, StringType()) for c in columns] + [StructField("_corrupt", StringType())])
    return spark.read.schema(schema).csv(
        path, header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", multiLine=line_breaks, escape='"'
    )


def _with_text_times(schema: StructType) -> StructType:
    """The schema with timestamps read as text, so that their offset can be checked before the cast."""
    fields = []
    for f in schema.fields:
        t = f.dataType
        if t.typeName() == "timestamp":
            t = StringType()
        elif isinstance(t, ArrayType) and isinstance(t.elementType, StructType):
            t = ArrayType(_with_text_times(t.elementType))
        fields.append(StructField(f.name, t))
    return StructType(fields)


def _retyped(schema: StructType):
    return lambda element: F.struct(*_typed(element, schema))


def _typed(col: Column, schema: StructType) -> list[Column]:
    out = []
    for f in schema.fields:
        c = col[f.name]
        if f.dataType.typeName() == "timestamp":
            c = R.aware_timestamp(c)
        elif isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType):
            c = F.transform(c, _retyped(f.dataType.elementType))
        out.append(c.alias(f.name))
    return out


def parse_json_lines(lines: DataFrame, ddl: str, column: str = "value") -> DataFrame:
    """Strict records from JSON text: exact key set, offsets on all times; the raw line is kept.

    Works on a batch or a stream. Unknown or missing keys and unreadable lines
    become issue codes.
    """
    schema = StructType.fromDDL(ddl)
    expected = [f.name for f in schema.fields]
    keys = F.json_object_keys(column)
    parsed = lines.withColumn("_j", F.from_json(F.col(column), _with_text_times(schema)))
    # Elements are read once more as maps: a struct would hide keys it does not know or lacks.
    nested = {f.name: f.dataType.elementType.names for f in schema.fields
              if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType)}
    loose = F.from_json(F.col(column), ", ".join(f"{name} array<map<string,string>>" for name in nested)) if nested else F.lit(None)
    typed = parsed.withColumn("_m", loose).select(
        F.col(column).alias("raw_line"), keys.alias("_keys"), "_m", *_typed(F.col("_j"), schema))
    times = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp"]
    return R.check(
        typed,
        R.never("JSON_UNREADABLE", F.col("_keys").isNull()),
        R.never("UNKNOWN_KEYS", F.size(F.array_except("_keys", F.lit(expected))) > 0),
        R.never("MISSING_KEYS", F.size(F.array_except(F.lit(expected), F.col("_keys"))) > 0),
        *[R.never(f"UNKNOWN_KEYS:{name}", F.exists(F.col("_m")[name], lambda m: F.size(F.array_except(F.map_keys(m), F.lit(known))) > 0))
          for name, known in nested.items()],
        *[R.never(f"MISSING_KEYS:{name}", F.exists(F.col("_m")[name], lambda m: F.size(F.array_except(F.lit(known), F.map_keys(m))) > 0))
          for name, known in nested.items()],
        *[R.never(f"TIMESTAMP_WITHOUT_OFFSET:{t}", F.col("_keys").isNotNull() & F.col(t).isNull()) for t in times],
    ).drop("_keys", "_m")


def read_event_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_json_lines(spark.read.text(path), EVENT_SCHEMA)


def read_observation_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_json_lines(spark.read.text(path), OBSERVATION_SCHEMA)


IDENTITY_SCHEMA = (
    "security_id string, official_code string, isin string, symbol_en string, symbol_ar string, issuer_id string, segment string, "
    "instrument_type string, valid_from date, valid_to date, known_from string, known_to string, tradable boolean"
)


def read_identity(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of bitemporal identity records, one or many files."""
    rows = spark.read.schema(IDENTITY_SCHEMA).json(path, multiLine=True)
    return rows.withColumns({"known_from": R.aware_timestamp("known_from"), "known_to": R.aware_timestamp("known_to")})


def suffixed_volume(text: Column) -> Column:
    """``1.25M`` style text to a whole number, NULL when it is not one."""
    clean = F.upper(F.trim(F.regexp_replace(text, ",", "")))
    scale = (
        F.when(clean.endswith("K"), 1_000).when(clean.endswith("M"), 1_000_000).when(clean.endswith("B"), 1_000_000_000).otherwise(1)
    )
    number = F.regexp_extract(clean, r"^([0-9]+(?:\.[0-9]+)?)\s*[KMB]?$", 1).try_cast("decimal(24,12)") * scale.cast("decimal(12,0)")
    return F.when(number == F.floor(number), number.cast("bigint"))


def vendor_date(text: Column) -> Column:
    # The cast first: it refuses a text without raising, and no text fits both it and a pattern.
    return F.coalesce(F.trim(text).try_cast("date"), F.try_to_date(F.trim(text), "MMM d, yyyy"), F.try_to_date(F.trim(text), "MMM dd, yyyy"))


def read_vendor_exports(spark: SparkSession, path: str, manifest: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """Vendor price CSVs bound to their manifest row by file name.

    ``manifest(file_name, code, source_id, sha256)``. With ``artifacts`` (see
    ``scan_artifacts``) the bytes of each file are held against the manifest.
    Returns bars with ``change_percent`` and row issue codes, the newest-first
    order included; check change reconciliation with ``prices.change_mismatches``.
    """
    schema = StructType([StructField(c, StringType()) for c in VENDOR_HEADER])
    raw = spark.read.schema(schema).csv(path, header=True, enforceSchema=False).withColumns({
        "file_name": F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1),
        # Place of the row: its split of the file, then its place in the split.
        "_split": F.col("_metadata.file_block_start"), "_place": F.monotonically_increasing_id()})
    dec = lambda c: F.regexp_replace(F.col(f"`{c}`"), "[,%+]", "").try_cast("decimal(20,6)")
    rows = raw.select(
        "file_name", vendor_date(F.col("Date")).alias("trade_date"), dec("Open").alias("open"), dec("High").alias("high"), dec("Low").alias("low"),
        dec("Price").alias("close"), suffixed_volume(F.col("`Vol.`")).alias("volume"), dec("Change %").alias("change_percent"), "_split", "_place",
    )
    # An export has one row per date, so a window over a file is bounded by the calendar.
    # The rows of a date are counted there too: the files are read once and shuffled once, by file name.
    rows = rows.withColumn("_later", F.lag("trade_date").over(Window.partitionBy("file_name").orderBy("_split", "_place"))).drop("_split", "_place")
    rows = rows.withColumn("_n", F.when(F.col("trade_date").isNotNull(), F.count("*").over(Window.partitionBy("file_name", "trade_date"))))
    bound = rows.join(manifest.withColumn("_bound", F.lit(True)), "file_name", "left")
    if artifacts is None:
        hashed = bound.withColumn("_stored", F.lit(None).cast("string"))
    else:
        name = F.element_at(F.split("path", "/"), -1)
        hashed = bound.join(artifacts.select(name.alias("file_name"), F.col("sha256").alias("_stored")), "file_name", "left")
    return R.check(
        hashed,
        R.never("FILE_SHA256_MISMATCH", F.col("_bound") & F.col("_stored").isNotNull() & (F.col("sha256") != F.col("_stored"))),
        R.never("ROWS_NOT_NEWEST_FIRST", F.col("trade_date") > F.col("_later")),
        R.must("FILE_NOT_IN_MANIFEST", F.col("_bound")),
        R.must("DATE_UNREADABLE", F.col("trade_date").isNotNull()),
        R.never("DATE_DUPLICATE", F.col("_n") > 1),
        R.must("PRICE_NOT_POSITIVE", F.least("open", "high", "low", "close") > 0),
        R.never("OHLC_IMPOSSIBLE", (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))),
        R.must("VOLUME_NOT_WHOLE", F.col("volume").isNotNull()),
        R.must("CHANGE_UNREADABLE", F.col("change_percent").isNotNull()),
    ).drop("_bound", "_n", "_later", "_stored")


@dataclass
class FileGroup(InputPartition):
    """Files that one task hashes."""

    paths: list[str]


class ArtifactReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.chunk_bytes = options["root"], int(options.get("chunk_bytes", CHUNK_BYTES))

    def partitions(self) -> list[FileGroup]:
        """Files in groups of about ``GROUP_BYTES``; names and sizes only."""
        store, base = fs.FileSystem.from_uri(self.root)
        groups, size = [[]], 0
        for info in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=False)):
            if info.type != fs.FileType.File:
                continue
            if groups[-1] and (size + info.size > GROUP_BYTES or len(groups[-1]) >= GROUP_FILES):
                groups.append([])
                size = 0
            groups[-1].append(info.path)
            size += info.size
        return [FileGroup(g) for g in groups]

    def read(self, partition: FileGroup) -> Iterator[tuple[str, int, str]]:
        store, base = fs.FileSystem.from_uri(self.root)
        for path in partition.paths:
            made, size = hashlib.sha256(), 0
            with store.open_input_stream(path) as stream:
                while chunk := stream.read(self.chunk_bytes):
                    made.update(chunk)
                    size += len(chunk)
            yield path.removeprefix(base.rstrip("/") + "/"), size, made.hexdigest()


class ArtifactFiles(DataSource):
    """Files below ``root`` as rows ``path, size_bytes, sha256``; no file is ever held whole."""

    @classmethod
    def name(cls) -> str:
        return "artifact_files"

    def schema(self) -> str:
        return "path string, size_bytes bigint, sha256 string"

    def reader(self, schema: StructType) -> ArtifactReader:
        return ArtifactReader(self.options)


def _uri(root: str) -> str:
    return re.sub("^file:/*", "file:///", root) if ":/" in root else f"file://{root}"


def scan_artifacts(spark: SparkSession, root: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every file below ``root``, empty ones too, with its relative path, size and sha256.

    A task reads a group of files in chunks, so a file may be larger than a value or the memory can hold. A store that
    only Spark's readers open is hashed from whole values instead; there a file ends at 2 GiB and empty files are not seen.
    """
    if _uri(root).split(":/")[0] in CHUNKED_STORES:
        spark.dataSource.register(ArtifactFiles)
        return spark.read.format("artifact_files").options(root=_uri(root), chunk_bytes=str(chunk_bytes)).load()
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/") + "/"
    return listed.select(F.replace("path", F.lit(prefix), F.lit("")).alias("path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def _store_files(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    store, base = fs.FileSystem.from_uri(root)
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            store.create_dir(f"{base}/{path}".rsplit("/", 1)[0])
            with store.open_output_stream(f"{base}/{path}") as out:
                out.write(content or b"")
        yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])


def store_artifacts(artifacts: DataFrame, root: str) -> int:
    """Writes ``artifacts(path, content)`` as files below ``root``, each by the task that holds it; returns their number.

    Paths are relative, given once, and end in a name. A task that runs again writes the same bytes again.
    """
    odd = F.col("path").rlike(r"^/|(^|/)\.{1,2}(/|$)|//|/$|^$") | F.col("path").isNull()
    if artifacts.where(odd).limit(1).count():
        raise ValueError("artifact paths must be relative and canonical")
    rows = artifacts.select("path", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(partial(_store_files, root=_uri(root)), "path string").count()


def audit_manifest(artifacts: DataFrame, manifest: DataFrame, sources: DataFrame, cutoff: Column, not_before: Column | None = None) -> DataFrame:
    """Declared artifacts against stored bytes, both ways, with source and time rules."""
    found = artifacts.select("path", F.col("sha256").alias("_sha"), F.col("size_bytes").alias("_size"))
    repeated = manifest.groupBy("path").agg(F.count("*").alias("_n"))
    known = sources.select("source_id", F.lit(True).alias("_known")).distinct()
    j = manifest.withColumn("_declared", F.lit(True)).join(repeated, "path", "left").join(known, "source_id", "left").join(found, "path", "full_outer")
    declared = F.coalesce("_declared", F.lit(False))
    both = declared & F.col("_sha").isNotNull()
    rules = [
        R.never("ARTIFACT_MISSING", declared & F.col("_sha").isNull()),
        R.never("ARTIFACT_NOT_IN_MANIFEST", ~declared),
        R.never("ARTIFACT_PATH_DUPLICATE", F.col("_n") > 1),
        R.never("SOURCE_UNKNOWN", declared & F.col("_known").isNull()),
        R.never("ARTIFACT_SIZE_MISMATCH", both & (F.col("size_bytes") != F.col("_size"))),
        R.never("ARTIFACT_HASH_MISMATCH", both & (F.col("sha256") != F.col("_sha"))),
        R.never("OBSERVED_AFTER_CUTOFF", F.col("observed_at") > cutoff),
        R.never("PROVIDER_TIME_AFTER_OBSERVED", F.col("provider_as_of") > F.col("observed_at")),
    ]
    if not_before is not None:
        rules.append(R.never("OBSERVED_BEFORE_WINDOW", F.col("observed_at") < not_before))
    return R.check(j, *rules).select("path", "issue_codes")


def audit_packets(artifacts: DataFrame, manifest: DataFrame, packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcome evidence packets: the raw inventory of each must equal its manifest; ``(rows, packets)``.

    ``artifacts(path, size_bytes, sha256)`` is a scan, a packet's files lie below ``<packet_id>/``.
    ``manifest(packet_id, path, sha256, size_bytes, observed_at)`` declares paths below the packet, and
    ``packets(packet_id, manifest_sha256, decision_at, observed_at)`` holds each packet's times. Rows are declared or
    found files with their codes. A packet is PASS without any code; only then has it ``packet_sha256``, the hash of the
    canonical JSON of its manifest's hash and its files in path order. A packet holds at most 32 artifacts and 128 MiB, so
    its entries are gathered in one row only after they were counted.
    """
    found = artifacts.select(
        F.substring_index("path", "/", 1).alias("packet_id"), F.regexp_replace("path", "^[^/]*/", "").alias("path"), F.col("sha256").alias("_sha"),
        F.col("size_bytes").alias("_size"))
    times = packets.select(
        "packet_id", "manifest_sha256", F.col("decision_at").alias("_from"), F.col("observed_at").alias("_to"), F.lit(True).alias("_known"))
    paths = manifest.groupBy("packet_id", "path").agg(F.count("*").alias("_paths"))
    hashes = manifest.groupBy("packet_id", "sha256").agg(F.count("*").alias("_hashes"))
    declared = manifest.withColumn("_declared", F.lit(True)).join(paths, ["packet_id", "path"]).join(hashes, ["packet_id", "sha256"], "left")
    j = declared.join(found, ["packet_id", "path"], "full_outer").join(times, "packet_id", "left")
    named, both = F.coalesce("_declared", F.lit(False)), F.col("_declared") & F.col("_sha").isNotNull()
    rows = R.check(
        j,
        R.never("PACKET_UNKNOWN", F.col("_known").isNull()),
        R.never("ARTIFACT_MISSING", named & F.col("_sha").isNull()),
        R.never("ARTIFACT_UNREFERENCED", ~named),
        R.never("ARTIFACT_PATH_DUPLICATE", F.col("_paths") > 1),
        R.never("ARTIFACT_SHA256_INVALID", named & ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))),
        R.never("ARTIFACT_SHA256_DUPLICATE", F.col("_hashes") > 1),
        R.never("ARTIFACT_SIZE_INVALID", named & ~F.coalesce(F.col("size_bytes") >= 0, F.lit(False))),
        R.never("ARTIFACT_SIZE_MISMATCH", both & (F.col("size_bytes") != F.col("_size"))),
        R.never("ARTIFACT_HASH_MISMATCH", both & (F.col("sha256") != F.col("_sha"))),
        R.never("ARTIFACT_OUTSIDE_OUTCOME_TIMES", named & ~F.coalesce(F.col("observed_at").between(F.col("_from"), F.col("_to")), F.lit(False))),
    ).select("packet_id", "path", "sha256", "size_bytes", "issue_codes")
    judged = packets.join(rows.groupBy("packet_id").agg(
        F.count("*").alias("artifact_count"), F.sum("size_bytes").alias("total_bytes"), F.count_if(F.size("issue_codes") > 0).alias("_bad")), "packet_id", "left")
    checked = R.check(
        judged,
        R.never("PACKET_TIMES_REVERSED", F.col("observed_at") < F.col("decision_at")),
        R.never("PACKET_EMPTY", F.col("artifact_count").isNull()),
        R.never("PACKET_TOO_LARGE", (F.col("artifact_count") > PACKET_ARTIFACTS) | (F.col("total_bytes") > PACKET_BYTES)),
        R.never("PACKET_INVENTORY_DIFFERS", F.col("_bad") > 0))
    entry = F.to_json(F.struct("path", "sha256", F.col("size_bytes").cast("bigint").alias("size_bytes")))
    sound = checked.where(F.size("issue_codes") == 0).select("packet_id", "manifest_sha256")
    digests = rows.join(sound, "packet_id").groupBy("packet_id", "manifest_sha256").agg(
        F.array_sort(F.collect_list(F.struct("path", entry.alias("entry")))).alias("entries")).select("packet_id", F.sha2(F.concat(
            F.format_string('[{"path":"manifest.json","sha256":"%s"},', "manifest_sha256"), F.array_join(F.transform("entries", lambda e: e["entry"]), ","), F.lit("]")), 256).alias("packet_sha256"))
    status = F.when(F.size("issue_codes") == 0, "PASS").otherwise("BLOCKED").alias("status")
    return rows, checked.join(digests, "packet_id", "left").select("packet_id", status, "artifact_count", "total_bytes", "packet_sha256", "issue_codes")


def write_sorted(df: DataFrame, columns: Sequence[str], keys: Sequence[str], path: str, fmt: str = "csv") -> None:
    """Sorted sink with a fixed header; an existing target is an error."""
    writer = df.select(*columns).orderBy(*keys).write.mode("errorifexists")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_report(frames: dict[str, DataFrame], path: str, fmt: str = "json") -> None:
    """One folder per named artifact of a run (model, weights, predictions, seal)."""
    for name, df in frames.items():
        df.write.mode("errorifexists").format(fmt).save(f"{path}/{name}")
