"""WARC archives: a deterministic sharded writer, and a reader of what it has committed.

Records are range-sorted by page_id: shards are ranges of ids with nearly equal payload bytes, and each shard is a task of
its own. An id of more bytes than a shard, and the rows without id, are dealt over several shards by url and digest. A shard
rolls to a new file when its compressed size is reached. Files are written under temporary names and renamed; the manifest, written last, names the files that
count. The same table gives the same files, byte for byte, so that a task run twice does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import blocks_for, materialise
from winnow.sources.scratch import new_path

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace for URLs of RFC 4122
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CELLS = 16  # of ids for each shard
_STEP = 1 << 16  # bytes that are unpacked at once
_DATE = "2000-01-01T00:00:00Z"  # fixed, as the table has none and reruns must agree


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the response's HTTP headers but not its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c if 0x20 < ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or f"urn:page:{page_id}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(hashlib.sha1(block).hexdigest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of the records of an archive, one gzip member each."""
    at = 0
    while at < len(data):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(data):
                raise ValueError("the last record is cut off")
            part = data[at : at + _STEP]
            parts.append(member.decompress(part))
            at += len(part) - len(member.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a WARC record: {lines[0]!r}")
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        yield fields, rest[: int(fields["content-length"])]


@dataclass(frozen=True)
class Shards:
    """Shard i holds the ids from starts[i] on; heavy ids (in order) take `parts` shards each instead, from `first` on, and
    rows without id the last `loose` ones."""

    starts: np.ndarray
    heavy: np.ndarray
    parts: np.ndarray
    loose: int

    @property
    def count(self) -> int:
        return len(self.starts) + int(self.parts.sum()) + self.loose

    def of(self, page_id: pd.Series, dealt: pd.Series) -> pd.Series:
        none = page_id.isna().to_numpy()
        ids = page_id.fillna(0).to_numpy(np.int64)
        out = np.maximum(0, np.searchsorted(self.starts, ids, "right") - 1)
        spread = dealt.to_numpy(np.int64).view(np.uint64)
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, ids), len(self.heavy) - 1)
            first = len(self.starts) + np.cumsum(self.parts) - self.parts
            out = np.where(self.heavy[at] == ids, first[at] + (spread % self.parts[at].astype(np.uint64)).astype(np.int64), out)
        if self.loose:
            out = np.where(none, self.count - self.loose + (spread % np.uint64(self.loose)).astype(np.int64), out)
        return pd.Series(out.astype(np.int32))


def _shards(sized: DataFrame, shard_bytes: int) -> Shards:
    """Exact and the same on each run, however the rows are laid out; the driver sees some numbers for each shard.

    Ids of the smallest hashes, some _CELLS for each shard, cut the ids into cells, whose bytes are then added up: so cells
    follow the ids, wherever those lie.
    """
    loose = sized.where("page_id is null").agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    loose = blocks_for(loose[0], shard_bytes) if loose[1] else 0
    by_id = materialise(sized.where("page_id is not null").groupBy("page_id").agg(F.sum("bytes").alias("bytes")), "ids")
    heavy = sorted((r.page_id, blocks_for(r.bytes, shard_bytes)) for r in by_id.where(F.col("bytes") > shard_bytes).collect())
    light = by_id.where(F.col("bytes") <= shard_bytes)
    total, n = light.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    share = min(1.0, _CELLS * blocks_for(total, shard_bytes) / max(1, n))
    cuts = np.array(sorted(r.page_id for r in light.where(F.xxhash64("page_id") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))).collect()), np.int64)

    @F.pandas_udf("long")
    def cell(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, page_id.to_numpy(np.int64), "right"))

    cells = light.groupBy(cell("page_id").alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("page_id").alias("least")).collect()
    starts, before, shard = [], 0, -1
    for r in sorted(cells, key=lambda r: r.cell):
        if before // shard_bytes > shard:
            shard = before // shard_bytes
            starts.append(r.least)
        before += r.bytes
    return Shards(np.array(starts, np.int64), np.array([x for x, _ in heavy], np.int64), np.array([k for _, k in heavy], np.int64), loose)


def write(pages: DataFrame, folder: str, min_payload: int = 0, shard_bytes: int = 32 << 20, file_bytes: int = 8 << 20, level: int = 6) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html) and commit; returns the manifest (path, records, bytes,
    sha256).

    Of rows with equal payloads of min_payload bytes at least, the one with the largest page_id is a response and the
    others are revisits of it; rows of equal payload without page_id revisit it too, unless none has one. A null html is
    an empty payload, a null url becomes urn:page:<page_id>. Of repeated rows of the largest page_id all are responses.
    An empty table gives no file and an empty manifest. Extra columns are ignored.
    """
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", raw.alias("payload"))
    sha1 = F.unhex(F.sha1("payload"))
    dealt = F.xxhash64("url", sha1)
    sized = materialise(pages.select("page_id", dealt.alias("dealt"), sha1.alias("sha1"), F.octet_length("payload").cast("long").alias("bytes")), "digests")
    lead = sized.where(F.col("bytes") >= min_payload).groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    lead = lead.where("n > 1 and refers_to is not null").select(F.col("sha1").alias("_sha1"), "refers_to")
    revisits = sized.join(lead, F.col("sha1") == F.col("_sha1")).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = revisits.select("page_id", "dealt", "sha1", "refers_to").distinct()
    shards = _shards(sized, shard_bytes)
    shard_of = F.pandas_udf(shards.of, "int")
    nothing = F.lit(None)
    both = pages.select("page_id", dealt.alias("dealt"), "url", "payload", nothing.cast("binary").alias("sha1"), nothing.cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", "dealt", nothing.cast("string").alias("url"), nothing.cast("binary").alias("payload"), "sha1", "refers_to")
    )
    # a page's own revisits stand before it: the payload moves once, to the task that writes its shard
    both = both.withColumn("shard", shard_of("page_id", "dealt")).drop("dealt")
    dealt = both.repartitionById(max(1, shards.count), "shard").sortWithinPartitions("shard", "page_id", F.col("sha1").isNull(), "url", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        shard = page = known = None
        out, rolled, done = None, 0, []

        def close() -> None:
            nonlocal out, rolled
            if out is not None:
                stream, temporary, digest, count, size = out
                stream.close()
                name = f"part-{shard:06d}-{rolled:05d}.warc.gz"
                where.move(temporary, f"{root}/{name}")
                done.append((name, count, size, digest.hexdigest()))
                out, rolled = None, rolled + 1

        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("shard", "page_id", "url", "payload", "sha1", "refers_to")], strict=True):
                if row[0] != shard:
                    close()
                    shard, rolled, page, known = row[0], 0, object(), {}
                if row[1] != page:
                    page, known = row[1], {}
                if row[4] is not None:
                    known[row[4]] = row[5]
                    continue
                payload = row[3]
                digest = hashlib.sha1(payload).digest()
                refers_to = known.get(digest)
                text = record(page, row[2], payload, base32_sha1(digest.hex()), refers_to, digest in known)
                zipped = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = zipped.compress(text) + zipped.flush()
                if out is None:
                    temporary = f"{root}/.{uuid.uuid4().hex}.tmp"
                    out = [where.open_output_stream(temporary), temporary, hashlib.sha256(), 0, 0]
                out[0].write(data)
                out[2].update(data)
                out[3] += 1
                out[4] += len(data)
                if out[4] >= file_bytes:
                    close()
        close()
        columns = list(zip(*done, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["path", "records", "bytes", "sha256"])

    manifest = dealt.mapInArrow(run, "path string, records long, bytes long, sha256 string")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload (null for revisits) of the records
    in the files that the folder's manifest names; digests are checked on the way."""
    manifest = spark.read.schema("path string, records long, bytes long, sha256 string").parquet(f"{folder}/manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    kept = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").join(manifest, F.col("name") == F.col("path"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        number = lambda x: None if x is None else int(x)
        for b in batches:
            for i in range(len(b)):
                rows = []
                for fields, block in records(b.column("content")[i].as_py()):
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-block-digest"] != "sha1:" + base32_sha1(hashlib.sha1(block).hexdigest()):
                        raise ValueError(f"block digest of {fields['warc-record-id']} is wrong")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                    revisit = fields["warc-type"] == "revisit"
                    if not revisit and base32_sha1(hashlib.sha1(payload).hexdigest()) != digest:
                        raise ValueError(f"payload digest of {fields['warc-record-id']} is wrong")
                    rows.append((number(fields.get("x-page-id")), length, digest, fields["warc-type"], number(fields.get("x-refers-to-page-id")), fields["warc-target-uri"], None if revisit else payload))
                    if len(rows) == 500:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    return kept.select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def archive(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    write(pages, folder, min_payload)
    return read(spark, folder)
