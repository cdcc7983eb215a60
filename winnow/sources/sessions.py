"""Session files: line-wise JSON in two formats, listings, fingerprints, and JSON results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.functions.text import blocks_text, rollout_text
from winnow.operators import turns as T
from winnow.sources.scratch import file_system

# Record types that are no part of a conversation.
SKIPPED = {"blocks": ("progress", "file-history-snapshot", "system", "summary", "queue-operation"), "rollout": ("session_meta", "event_msg")}
# End of fixed values.


def lines(spark: SparkSession, path: str) -> DataFrame:
    """conv_id (the file's path), line_no, raw: lines that hold a JSON object; blank and malformed ones are skipped.

    A file is read as a whole to keep its order of lines; files, not lines, are what is spread over the cluster.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("conv_id"), "value")
    rows = files.select("conv_id", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("line_no", "line"))
    rows = rows.select("conv_id", F.col("line_no").cast("long").alias("line_no"), F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("raw"))
    return rows.where("raw <> ''").withColumn("rec", F.try_parse_json("raw")).where(F.schema_of_variant("rec").startswith("OBJECT"))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("rec", f"$.{path}", kind)


def block_records(rows: DataFrame) -> DataFrame:
    """Records of the block format: conv_id, line_no, raw, is_user, text."""
    content = F.try_variant_get("rec", "$.message.content", "variant")
    of = F.schema_of_variant(content)
    blocks = F.from_json(F.to_json(content), "array<struct<type:string>>")
    plain = of.startswith("ARRAY") & ~F.coalesce(F.exists(blocks, lambda b: b["type"] == "tool_result"), F.lit(False))
    from_tool = F.coalesce(_get("sourceToolAssistantUUID"), F.lit("")).isin("", "false", "0")
    user = (F.coalesce(_get("type"), F.lit("")) == "user") & from_tool & F.coalesce((of == "STRING") | plain, F.lit(False))
    kept = rows.where(~F.coalesce(_get("type"), F.lit("")).isin(*SKIPPED["blocks"]))
    return kept.select("conv_id", "line_no", "raw", user.alias("is_user"), blocks_text("raw").alias("text"))


def rollout_records(rows: DataFrame) -> DataFrame:
    """Records of the rollout format: conv_id, line_no, raw, class, text."""
    kind = F.coalesce(_get("type"), F.lit(""))
    role = F.coalesce(_get("payload.role"), _get("role"), F.lit(""))
    cls = F.when(kind == "compacted", "compacted").when(kind == "turn_context", "context").when((kind == "response_item") & (role == "user"), "user").when(kind == "response_item", "system")
    kept = rows.where(~kind.isin(*SKIPPED["rollout"]))
    return kept.select("conv_id", "line_no", "raw", cls.alias("class"), rollout_text("raw").alias("text"))


def read_turns(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Turns of session files in format blocks or rollout."""
    rows = lines(spark, path)
    grouped = T.group_blocks(block_records(rows)) if fmt == "blocks" else T.group_rollout(rollout_records(rows))
    return T.joined(grouped)


def header(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, raw: the first session_meta line of each file, kept word for word for the sink."""
    meta = lines(spark, path).where(_get("type") == "session_meta")
    return meta.groupBy("conv_id").agg(F.min_by("raw", "line_no").alias("raw"))


def files(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, modified, content of the files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.col("modificationTime").alias("modified"), "length", "content")


def latest(listing: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The newest path, of each key if there are any."""
    return listing.groupBy(*(keys or [])).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def newest(listing: DataFrame, n: int = 20, least: int = 0) -> DataFrame:
    """The n newest files with their line counts, and only those of `least` lines or more."""
    count = F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 1
    return listing.select("path", "modified", count.cast("long").alias("lines")).where(F.col("lines") >= least).orderBy(F.col("modified").desc(), "path").limit(n)


def fingerprint(listing: DataFrame, ratio: float) -> DataFrame:
    """path, conv_hash: of the size, the ratio and the first and last 4096 bytes."""
    head, size = F.substring("content", 1, 4096), F.col("length")
    tail = F.when(size > 4096, F.substring("content", -4096, 4096)).otherwise(F.lit(b""))
    whole = F.concat(F.encode(size.cast("string"), "UTF-8"), F.encode(F.lit(f"{ratio:.4f}"), "UTF-8"), head, tail)
    return listing.select("path", F.substring(F.sha2(whole, 256), 1, 16).alias("conv_hash"))


def results(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """Rows of JSON files that hold an object or an array of objects each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(paths)


def cached_probes(spark: SparkSession, folder: str, conv_hash: str, version: str) -> DataFrame | None:
    """Probes that were stored for a conversation and version, or None."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{folder}/conv_hash={conv_hash}/version={version}")
    except AnalysisException:
        return None


def store_probes(probes: DataFrame, folder: str, conv_hash: str, version: str) -> None:
    probes.write.mode("overwrite").parquet(f"{folder}/conv_hash={conv_hash}/version={version}")


def expired_backups(listing: DataFrame, keep: int = 3) -> DataFrame:
    """Backups besides the newest `keep` of each session: (session, path, modified) -> those to remove."""
    order = Window.partitionBy("session").orderBy(F.col("modified").desc(), "path")
    return listing.withColumn("_n", F.row_number().over(order)).where(F.col("_n") > keep).drop("_n")


def replace(spark: SparkSession, path: str, lines: list[str], backups: str, keep: int = 3) -> str | None:
    """Put `lines` in the place of a session's file. What stood there goes to the folder of backups first, of which the
    `keep` newest of this session stay; readers see the old file or the new one, whole. Returns the backup's path, or None
    if there are no lines: then nothing is touched."""
    if not lines:
        return None
    jvm = spark._jvm
    (target, fs), (store, kept) = file_system(spark, path), file_system(spark, backups)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    kept.mkdirs(store)
    stamp = f"{fs.getFileStatus(target).getModificationTime():020d}-{uuid.uuid4().hex}"
    backup = jvm.org.apache.hadoop.fs.Path(store, f"{target.getName()}.{stamp}.bak")
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, target, kept, backup, False, conf)
    temporary = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{stamp}.tmp")
    out = fs.create(temporary)
    out.write(bytearray(("\n".join(lines) + "\n").encode()))
    out.close()
    old = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{stamp}.old")
    if not fs.rename(temporary, target):  # where a file that exists is in the way
        fs.rename(target, old)
        if not fs.rename(temporary, target):
            fs.rename(old, target)
            raise OSError(f"{path} could not be replaced; its backup is {backup}")
        fs.delete(old, False)
    mine = sorted(s.getPath().getName() for s in kept.listStatus(store) if s.getPath().getName().startswith(f"{target.getName()}."))
    for name in mine[:-keep]:
        kept.delete(jvm.org.apache.hadoop.fs.Path(store, name), False)
    return backup.toString()
