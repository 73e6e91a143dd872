r"""WARC writer and reader (operator 3): deterministic, sharded, sorted by key.

Writing: payload digests are grouped (partial minima, no payload moves) to find
the response of each payload; pages and these decisions meet in one shuffle by
shard, where both are sorted by key.  Shards are ranges of the key, cut on a
histogram of bytes: ranges that hold more than a shard's bytes are cut again by
the key's lower bits, single keys by the payload's digest, so an outlying or
very frequent key spoils nothing, and the same table gives the same shards.  A
task writes its shard as gzip members, one per record, with headers and digests
made anew, and rolls to a new file once `roll_bytes` compressed bytes are
written.  A task takes a run of neighbouring shards (one, up to TASKS shards),
dealt by number.  Files get a temporary name and are renamed when complete; a repeated
task writes the same bytes under the same name.  Their names, sizes, record
counts and SHA-256 form the manifest, a Parquet table written last: an archive
without it is incomplete.  Temporary files of lost attempts go after that.

Reading: tasks stream the files of the manifest, check every file's SHA-256 and
every block's digest, and return a row per record.

Tasks open paths through pyarrow.fs (file, hdfs, s3, gs, abfs; s3a and s3n are
read as s3), since Python workers have no Hadoop file system.  Edge cases: null html is an
empty payload; of equal payloads the smallest key is the response (null keys are
never referred to unless all are null, then each is a response); rows that
repeat a key and payload: the first is the response, the rest refer to that key;
an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbelo.llm.common import discard, materialize, new_folder

#: Bytes of payload a shard is meant to hold at least, and compressed bytes after which a file ends.
SHARD_BYTES, ROLL_BYTES = 32 << 20, 8 << 20
#: Shards that an archive is meant to have at most: of a larger one, they hold more bytes.
SHARDS = 1 << 17
#: Tasks that write.
TASKS = 1 << 16
#: Ranges of the histogram's first level; later levels together have about 2^20, and the driver holds a row for each.
BINS = 1 << 15
#: Bits of the digest that cut a single key.
DIGEST_BITS = 16
LEVEL = 4
DATE = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")  # of every record: the same input gives the same bytes

MANIFEST = "name string, shard long, records long, bytes long, sha256 string"
RECORDS = "key string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def _filesystem(uri: str) -> tuple[pfs.FileSystem, str]:
    scheme, _, rest = uri.partition("://")
    return pfs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(key: str | None, digest: str, n: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{key} {digest} {n}'.encode()).digest())}>"


def _clean(url: str | None) -> str:
    """A header holds one line."""
    return " ".join((url or "").split()) or "about:blank"


def record(key: str | None, url: str | None, payload: bytes, refers_to: str | None, original: bool, n: int) -> bytes:
    """A response with its payload, or a revisit with the response's headers only."""
    digest = sha1_base32(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += payload if original else b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if original else 'revisit'}", f"WARC-Record-ID: {_record_id(key, digest, n)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response"]
    if not original:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest, 0)}", f"X-Refers-To-Key: {refers_to}"]
    if key is not None:
        head.append(f"X-Key: {key}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # a gzip member without time or name
    return z.compress(data) + z.flush()


class _Roller:
    """Files of one shard: written under a temporary name, renamed when complete."""

    def __init__(self, uri: str, shard: int, roll_bytes: int):
        self.fs, self.root = _filesystem(uri)
        self.shard, self.roll, self.count, self.sink, self.done = shard, roll_bytes, 0, None, []

    def write(self, member: bytes) -> None:
        if self.sink is None:
            self.name = f"shard-{self.shard:06d}-{self.count:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
            self.sink, self.hash, self.bytes, self.records = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, -1
            self.count += 1
            self.write(_member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: %s\r\nWARC-Date: %s\r\nWARC-Filename: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n" % (_record_id(self.name, "", 0).encode(), DATE.encode(), self.name.encode())))
        self.sink.write(member)
        self.hash.update(member)
        self.bytes += len(member)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.sink is None:
            return
        self.sink.close()
        self.sink = None
        final = f"{self.root}/{self.name}"
        try:
            self.fs.move(self.temporary, final)
        except OSError:  # some stores do not rename onto a file: an earlier attempt has left the same bytes
            info = self.fs.get_file_info(final)
            if info.type != pfs.FileType.File or info.size != self.bytes:
                raise
            self.fs.delete_file(self.temporary)
        self.done.append((self.name, self.shard, self.records, self.bytes, self.hash.hexdigest()))


def _cut(digests: DataFrame, shard_bytes: int) -> tuple[list[tuple[int, bool, DataFrame]], int]:
    """Tables (at, shard) by level of the histogram, with the level's shift and whether it cuts digests, and the number of shards.

    `at` is a key without its lower `shift` bits; on the last level, with the
    upper bits of the digest behind it as text.  A row falls on one level.
    """
    spark = digests.sparkSession
    lo, hi = digests.agg(F.min("key"), F.max("key")).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    shift = next(k for k in range(64) if (hi >> k) - (lo >> k) < BINS)
    levels, leaves, open_, by_digest = [], [], None, False
    rows = digests.withColumn("key", F.coalesce("key", F.lit(lo)))
    while True:
        at = _at(shift, by_digest)
        own = rows.withColumn("at", at)
        if open_ is not None:
            own = own.withColumn("above", _at(above, False)).join(F.broadcast(spark.createDataFrame([(str(x),) for x in open_], "above string")), "above")
        bins = own.groupBy("at").agg(F.sum("size").alias("size"), F.min("key").alias("first")).collect()
        level = len(levels)
        levels.append((shift, by_digest))
        large = [] if by_digest else [r for r in bins if r["size"] > shard_bytes]
        taken = {r["at"] for r in large}
        leaves += [((r["first"], r["at"] if by_digest else ""), level, r["at"], r["size"]) for r in bins if r["at"] not in taken]
        if not large:
            break
        open_, above = [int(r["at"]) for r in large], shift
        bits = max(5, 20 - len(open_).bit_length())
        shift, by_digest = max(0, shift - bits), shift == 0
    shard, held, named = 0, 0, [[] for _ in levels]
    for _, level, at, size in sorted(leaves):
        if held and held + size > shard_bytes:
            shard, held = shard + 1, 0
        held += size
        named[level].append((at, shard))
    return [(shift, by_digest, spark.createDataFrame(own, "at string, shard long")) for (shift, by_digest), own in zip(levels, named, strict=True)], shard + 1


def _at(shift: int, by_digest: bool):
    """The bin of a row (key, digest) on one level."""
    kept = F.shiftright("key", shift).cast("string")
    return F.concat(kept, F.lit(":"), F.substring(F.hex("digest"), 1, DIGEST_BITS // 4)) if by_digest else kept


def _with_shard(rows: DataFrame, levels: list[tuple[int, bool, DataFrame]], lo: int) -> DataFrame:
    key = rows.withColumns({"own": F.col("key"), "key": F.coalesce("key", F.lit(lo))})
    found = []
    for k, (shift, by_digest, table) in enumerate(levels):
        key = key.withColumn("at", _at(shift, by_digest)).join(F.broadcast(table.withColumnRenamed("shard", f"shard{k}")), "at", "left").drop("at")
        found.append(f"shard{k}")
    return key.withColumns({"shard": F.coalesce(*found), "key": F.col("own")}).drop("own", *found)


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the archive of pages (key: an integer) into a new folder and returns its manifest."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), body.alias("body")).withColumn("digest", F.unhex(F.sha1("body")))
    spark = pages.sparkSession
    digests = materialize(rows.select("key", "digest", F.length("body").cast("long").alias("size")), "warc-digests")
    lo, total = digests.agg(F.min("key"), F.sum("size")).first()
    levels, shards = _cut(digests, max(shard_bytes, (total or 0) // SHARDS))
    tasks = min(shards, TASKS)
    firsts = digests.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    decided = digests.join(firsts, "digest").select("key", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("body"), "digest", "first").distinct()
    both = rows.select("key", "url", "body", "digest", F.lit(None).cast("long").alias("first")).unionByName(decided)
    # the decision on a digest comes before the bodies that have it
    dealt = _with_shard(both, levels, 0 if lo is None else lo).repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int")).sortWithinPartitions("shard", "key", "digest", F.col("body").isNotNull(), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, at, first, n = None, (None,), None, -1
        for batch in batches:
            names = batch.schema.names
            cols = [batch.column(names.index(c)) for c in ("shard", "key", "url", "body", "digest", "first")]
            for i in range(batch.num_rows):
                s, k, u, b, d, refers = (c[i].as_py() for c in cols)
                if roller is not None and at[0] != s:
                    roller.close()
                    yield _manifest(roller.done)
                    roller = None
                if (s, k, d) != at:
                    at, first, n, shared = (s, k, d), None, -1, False
                if b is None:
                    first, shared = refers, True
                    continue
                if roller is None:
                    roller = _Roller(folder, s, roll_bytes)
                n += 1
                original = not shared or (first == k and n == 0)
                roller.write(_member(record(None if k is None else str(k), u, b, None if original else str(first), original, n)))
        if roller is not None:
            roller.close()
            yield _manifest(roller.done)

    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    discard(digests)
    left = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_temporary")
    left.getFileSystem(spark._jsc.hadoopConfiguration()).delete(left, True)
    return read_manifest(spark, folder)


def _manifest(done: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], kind) for i, kind in enumerate(kinds)], names=["name", "shard", "records", "bytes", "sha256"])


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    z, parts = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            parts.append(z.decompress(data))
            if not z.eof:
                break
            yield b"".join(parts)
            data, z, parts = z.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the last member is cut off")


def parse(member: bytes) -> dict:
    """Headers (lower-case names) and, at 'block', the block of one record; checks its length and digest."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    out = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(out["content-length"])
    out["block"] = rest[:n]
    if lines[0] != "WARC/1.1" or len(out["block"]) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    if (digest := out.get("warc-block-digest")) and digest != f"sha1:{sha1_base32(out['block'])}":
        raise ValueError(f"{out['warc-record-id']}: the block does not have its digest")
    return out


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the archive, without payloads."""
    files = read_manifest(spark, folder).select("name", "sha256", "records")
    tasks = max(1, min(files.count(), 10 * spark.sparkContext.defaultParallelism))

    def run(batches):
        for batch in batches:
            for name, sha, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, root = _filesystem(folder)
                hashed, rows = hashlib.sha256(), []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw:

                    class Tee:
                        def read(self, n, raw=raw, hashed=hashed):
                            data = raw.read(n)
                            hashed.update(data)
                            return data

                    total = 0
                    for member in _members(Tee()):
                        r = parse(member)
                        if r["warc-type"] == "warcinfo":
                            continue
                        http = r["block"].partition(b"\r\n\r\n")
                        size = int(http[0].decode("latin-1").lower().rpartition("content-length:")[2])
                        digest = r["warc-payload-digest"].removeprefix("sha1:")
                        if r["warc-type"] == "response" and (len(http[2]) != size or sha1_base32(http[2]) != digest):
                            raise ValueError(f"{r['warc-record-id']}: the payload does not have its digest")
                        rows.append((r.get("x-key"), r["warc-target-uri"], size, digest, r["warc-type"], r.get("x-refers-to-key")))
                        total += 1
                        if len(rows) >= 5000:
                            yield _rows(rows)
                            rows = []
                if hashed.hexdigest() != sha or total != records:
                    raise ValueError(f"{name} is not the file of the manifest")
                yield _rows(rows)

    return files.repartition(tasks).mapInArrow(run, RECORDS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], names=["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def report(pages: DataFrame, key: str = "page_id", folder: str | None = None, **options) -> DataFrame:
    """key, payload_bytes, payload_digest, record_type, refers_to of every page, from the archive read back."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    write(pages, folder, key, **options)
    return read(spark, folder).select(F.col("key").cast("long").alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
