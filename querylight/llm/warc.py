"""WARC archives: a deterministic sharded writer, and a reader.

Records are range-sorted by id. The cuts between shards are ids of a hash sample of about
`CUT_SAMPLE` rows, so they depend on the rows alone; every row is written. A shard's records go to
gzip members, one each, and a new file begins when `roll_bytes` of compressed bytes are reached. All
headers, record ids and digests are made anew from the content, so equal tables give equal files.

Commit: a task writes below temporary names of its own and returns a manifest row per file. The
manifest of the attempts that succeeded is written as a table, then each row's file takes its final
name, which can be repeated, and last the manifest is written beside the archives. Files of lost
attempts stay outside the manifest and are never read.

Equal payloads of `REVISIT_BYTES` or more are stored once, with the largest id; the others become
revisit records that name the response's record id and address. The table of repeated digests is aggregated
before any join. Every shard is a task of its own, and a payload of any length one record of its shard.

Results for odd input: a null payload is empty, a null url an empty header. Rows of equal id and
payload are records each; those of the largest id are responses all. A null id sorts first and loses
to any other; a group of null ids alone is responses all. An empty table writes no archive. Columns beyond id,
url and payload are not archived, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylight.llm.common import small
from querylight.llm.registry import query, table
from querylight.session import stage, stage_path

ROLL_BYTES = 64 << 20  # compressed bytes at which a new file begins
SHARD_BYTES = 32 << 20  # payload bytes aimed at per shard
CUT_SAMPLE = 20_000
IDS_A_SHARD = 8  # sampled ids a shard, at least
REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"  # the tables carry no capture time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 6


def open_store(path: str):
    """File system and path of a shared folder's address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sha1_base32(data: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(page: int | None, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest} {url}')}>"


def record_bytes(
    page: int | None, url: str, payload: bytes, refers_to: int | None, refers_url: str | None = None, date: str = DATE
) -> bytes:
    """One record: a response with its payload, or a revisit of the record (refers_to, refers_url) with the HTTP headers alone."""
    url = " ".join(url.split())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = sha1_base32(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_urn(page, url, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: {digest}",
        f"WARC-Block-Digest: {sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"Page-Id: {page}")
    if refers_to is not None:
        kept = " ".join((refers_url or "").split())
        head += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {record_urn(refers_to, kept, digest)}",
            f"WARC-Refers-To-Target-URI: {kept}",
            f"WARC-Refers-To-Date: {date}",
            f"Refers-To-Page-Id: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(page, url, payload, refers_to, refers_url): the last two, id and url of the response, are null for responses."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    keyed = rows.withColumn("digest", F.sha1("payload"))
    large = keyed.filter(F.octet_length("payload") >= REVISIT_BYTES)
    repeated = large.groupBy("digest").agg(F.count("*").alias("c"), F.max(F.struct("page", "url")).alias("kept"))
    repeated = repeated.filter("c > 1 and kept.page is not null")
    repeated = stage(repeated.select("digest", F.col("kept.page").alias("kept"), F.col("kept.url").alias("kept_url")), "repeated")
    n, url_bytes = repeated.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("kept_url")), F.lit(0))).first()
    joined = keyed.join(small(repeated, n, 160 + url_bytes // max(n, 1)), "digest", "left")
    other = F.col("kept").isNotNull() & ~F.col("page").eqNullSafe(F.col("kept"))
    refers = [F.when(other, F.col("kept")).alias("refers_to"), F.when(other, F.col("kept_url")).alias("refers_url")]
    return joined.select("page", "url", "payload", *refers)


def shard_cuts(records: DataFrame, shard_bytes: int) -> np.ndarray:
    """Ids at which shards begin, from a hash sample of ids and the bytes of all payloads."""
    total = records.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()
    shards = max(1, -(-total[1] // shard_bytes))
    every = max(1, total[0] // max(CUT_SAMPLE, IDS_A_SHARD * shards))
    picked = records.select("page").filter(F.col("page").isNotNull() & (F.pmod(F.xxhash64(F.lit(3), "page"), F.lit(every)) == 0))
    ids = np.sort(np.array([r[0] for r in picked.distinct().collect()], dtype=np.int64))
    if len(ids) <= shards:
        return ids[1:]
    return np.unique(ids[[len(ids) * i // shards for i in range(1, shards)]])


def give_name(store, temp: str, final: str, size: int) -> None:
    """Move a written file to its final name; a repeated task finds it there already."""
    from pyarrow import fs

    if store.get_file_info(temp).type != fs.FileType.NotFound:
        store.move(temp, final)
    if store.get_file_info(final).size != size:
        raise FileNotFoundError(f"{final} is not there with its {size} bytes")


def write_archives(records: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write `records` of `with_revisits` as archives below `folder`; returns the manifest
    (file, shard, part, records, bytes, sha256)."""
    spark = records.sparkSession
    cuts = shard_cuts(records, shard_bytes)

    @F.pandas_udf("int")
    def shard_of(pages: pd.Series) -> pd.Series:
        return pd.Series(np.where(pages.isna(), 0, np.searchsorted(cuts, pages.fillna(0).astype("int64"), side="right")))

    sorted_rows = (
        records.withColumn("shard", shard_of("page"))
        .repartitionById(len(cuts) + 1, "shard")
        .sortWithinPartitions("shard", "page", "url", F.sha1("payload"))
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_store(folder)
        store.create_dir(f"{root}/data", recursive=True)
        shard = part = out = None
        done: list[tuple] = []

        def close() -> None:
            out["stream"].close()
            done.append((f"{shard:06d}-{part:04d}.warc.gz", out["name"], shard, part, out["n"], out["size"], out["sum"].hexdigest()))

        for batch in batches:
            pages = batch["page"].astype("object").where(batch["page"].notna(), None)
            refers = batch["refers_to"].astype("object").where(batch["refers_to"].notna(), None)
            fields = (batch["shard"], pages, batch["url"], batch["payload"], refers, batch["refers_url"])
            for own, page, url, payload, refer, refer_url in zip(*fields):
                if out is not None and (own != shard or out["size"] >= roll_bytes):
                    close()
                    part, out = (part + 1 if own == shard else 0), None
                if out is None:
                    part = 0 if own != shard else part
                    shard, name = own, f"data/.{uuid.uuid4().hex}.tmp"
                    out = {"name": name, "stream": store.open_output_stream(f"{root}/{name}"), "n": 0, "size": 0, "sum": hashlib.sha256()}
                page, refer = (None if v is None else int(v) for v in (page, refer))
                data = gzip_member(record_bytes(page, url, bytes(payload), refer, refer_url))
                out["stream"].write(data)
                out["sum"].update(data)
                out["n"], out["size"] = out["n"] + 1, out["size"] + len(data)
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["file", "temp", "shard", "part", "records", "bytes", "sha256"])

    manifest = stage(
        sorted_rows.mapInPandas(write, "file string, temp string, shard int, part int, records long, bytes long, sha256 string"),
        "warc_attempts",
    )

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_store(folder)
        for batch in batches:
            for temp, file, size in zip(batch["temp"], batch["file"], batch["bytes"]):
                give_name(store, f"{root}/{temp}", f"{root}/data/{file}", size)
            yield batch.drop(columns="temp")

    committed = manifest.mapInPandas(commit, "file string, shard int, part int, records long, bytes long, sha256 string")
    committed.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def members(stream: io.RawIOBase, size: int = 1 << 20) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one after the other."""
    squeeze, parts = zlib.decompressobj(31), []
    while chunk := stream.read(size):
        while chunk:
            parts.append(squeeze.decompress(chunk))
            chunk = b""
            if squeeze.eof:
                chunk = squeeze.unused_data
                yield b"".join(parts)
                squeeze, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("an archive ends within a record")


def headers(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, body


def parse_record(data: bytes) -> dict:
    """A record's fields; checks its length and digests."""
    head, rest = headers(data)
    length = int(head["content-length"])
    block = rest[:length]
    if rest[length:] != b"\r\n\r\n" or sha1_base32(block) != head["warc-block-digest"]:
        raise ValueError(f"damaged record {head.get('warc-record-id')}")
    http, payload = headers(block)
    if head["warc-type"] == "response" and sha1_base32(payload) != head["warc-payload-digest"]:
        raise ValueError(f"damaged payload {head.get('warc-record-id')}")
    page, refers = head.get("page-id"), head.get("refers-to-page-id")
    return {
        "page": None if page is None else int(page),
        "url": head["warc-target-uri"],
        "record_type": head["warc-type"],
        "payload_bytes": int(http["content-length"]),
        "payload_digest": b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex(),
        "refers_to": None if refers is None else int(refers),
        "record_id": head["warc-record-id"],
        "refers_to_id": head.get("warc-refers-to"),
        "payload": payload if head["warc-type"] == "response" else None,
    }


RECORD = "page long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, refers_to_id string, payload binary"


def read_archives(manifest: DataFrame, folder: str, columns: list[str] | None = None) -> DataFrame:
    """The records of all files in the manifest, a file at a time."""
    wanted = columns or [f.split()[0] for f in RECORD.split(", ")]
    schema = ", ".join(f for f in RECORD.split(", ") if f.split()[0] in wanted)
    names = [f.split()[0] for f in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_store(folder)
        for batch in batches:
            for file in batch["file"]:
                rows = []
                with store.open_input_stream(f"{root}/data/{file}", compression=None) as stream:
                    for data in members(stream):
                        record = parse_record(data)
                        rows.append([record[c] for c in names])
                        if len(rows) == 1000:
                            yield typed(rows, names)
                            rows = []
                yield typed(rows, names)

    spread = manifest.select("file").repartition(max(manifest.sparkSession.sparkContext.defaultParallelism, 1), "file")
    return spread.mapInPandas(read, schema)


def typed(rows: list[list], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names, dtype=object)
    return out.assign(**{c: out[c].astype("Int64") for c in ("page", "refers_to", "payload_bytes") if c in names})


ORACLE = """
with p as (
  select page_id, encode(coalesce(html, '')) as b, sha1(coalesce(html, '')) as payload_digest from pages),
k as (select payload_digest, max(page_id) as kept from p where octet_length(b) >= 1000 group by payload_digest)
select p.page_id, cast(octet_length(b) as bigint) as payload_bytes, p.payload_digest,
  case when k.kept <> p.page_id then 'revisit' else 'response' end as record_type,
  case when k.kept <> p.page_id then k.kept end as refers_to
from p left join k using (payload_digest)
"""


@query("op5_warc", ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = with_revisits(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    folder = stage_path(spark, "warc")
    manifest = write_archives(records, folder)
    read = read_archives(manifest, folder, ["page", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return read.select(
        F.col("page").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to",
    )

