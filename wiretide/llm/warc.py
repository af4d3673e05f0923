"""WARC archives: a deterministic sharded writer with deduplication by revisit records, and a reader.

Each page becomes a record.  Of records with equal payloads of at least ``least`` bytes the one with the largest page_id (of
equal ids the largest url) is the response, the others are revisits that refer to it; smaller payloads are always responses.

*Order.*  Records are sorted by page_id, payload digest and url.  Small rows (no payload from ``least`` bytes on) are
range-sorted and carry the running number of bytes; a shard is a fixed span of that sum, so shards depend on the rows
alone, not on how Spark deals them.  Then payloads are shuffled once, to the task of their shard, each behind the small row
that says what to write.  There are at most SHARDS shards: their first keys are all that the driver and the tasks hold.

*Files.*  A shard's task rolls to a new file once the current one has ``file_bytes`` compressed.  Headers and digests are
made from the bytes; each record is a gzip member without a time, so the same rows give the same files.

*Commit.*  Files are written under temporary names that no other attempt shares; the names that count are those in the
manifest, a table that only successful tasks get into.  A second job renames them (again without harm if it is repeated),
and the manifest, written last, makes the archive visible: readers open what it lists and nothing else.

Cases: a null html is an empty payload; a null page_id ranks lowest and is written without its header; a null url is
``about:blank``; control characters and spaces of a url are percent-encoded.  Exactly repeated rows are one small row with
a number of copies, of which at most one is a response where payloads are shared.  An empty table gives a manifest without
files and no records.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, pick, shared_dir

LEAST, SHARDS = 1000, 65_536
SHARD_BYTES, FILE_BYTES = 64 << 20, 256 << 20
#: About what a record's headers take before compression.
HEAD = 700
DATE = "2000-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "shard int, file string, temporary string, n_records long, n_bytes long, sha256 string"
RECORDS = "file string, record_type string, record_id string, refers_to string, page_id long, url string, payload_bytes long, payload_digest string, sound boolean"


def key_of(page_id: Column, digest: Column, url: Column) -> Column:
    """One string that sorts as (page_id, digest, url) with nulls first, and says whether two rows are the same record."""
    number = F.lpad(F.hex(page_id.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.coalesce(number, F.lit("-")), F.lit(" "), digest, F.coalesce(F.concat(F.lit(" "), url), F.lit("")))


def rows_of(pages: DataFrame) -> DataFrame:
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), "url", body.alias("body"), F.sha2(body, 256).alias("digest"))
    return rows.withColumn("n_bytes", F.octet_length("body").cast("long")).withColumn("key", key_of(F.col("page_id"), F.col("digest"), F.col("url")))


def decisions(rows: DataFrame, least: int) -> DataFrame:
    """One small row for each different record: how often it is written, as what, and what a revisit refers to."""
    small = F.when(F.col("n_bytes") < least, F.col("body")).alias("small")
    each = rows.select("key", "page_id", "url", "digest", "n_bytes", F.sha1("body").alias("sha1"), small)
    each = each.groupBy(*each.columns).agg(F.count(F.lit(1)).alias("copies"))
    shared = each.where(F.col("n_bytes") >= least).groupBy("digest")
    shared = shared.agg(F.max("key").alias("refers_key"), F.max_by("url", "key").alias("refers_url"), F.sum("copies").alias("all")).where(F.col("all") > 1)
    kept = each.join(shared.drop("all"), "digest", "left").drop("digest")
    response = F.col("refers_key").isNull() | (F.col("refers_key") == F.col("key"))
    weight = F.col("copies") * HEAD + F.when(F.col("n_bytes") < least, F.col("copies") * F.col("n_bytes")).when(response, F.col("n_bytes")).otherwise(0)
    return kept.select("*", response.alias("response"), weight.alias("weight"))


def sharded(decided: DataFrame, shard_bytes: int) -> tuple[DataFrame, list[str]]:
    """The decisions with their shards, and each shard's first key."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, so_far = TaskContext.get().partitionId(), 0
        for b in batches:
            ends = so_far + np.cumsum(b.column("weight").to_numpy(zero_copy_only=False))
            so_far = int(ends[-1]) if len(ends) else so_far
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(ends), part, dtype=np.int32)), pa.array(ends.astype(np.int64))], names=[*b.schema.names, "part", "ends"])

    spark = decided.sparkSession
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in decided.schema)
    spread = decided.orderBy("key").mapInArrow(run, f"{kinds}, part int, ends long")
    spread = materialise(spread, "warc-order")
    before, total = [], 0
    for part, weight in sorted(tuple(r) for r in spread.groupBy("part").agg(F.max("ends")).collect()):
        before.append((part, total))
        total += weight
    size = max(shard_bytes, -(-total // SHARDS))
    at = spark.createDataFrame(before, "part int, before long")
    shard = F.floor((F.col("before") + F.col("ends") - F.col("weight")) / F.lit(size)).cast("int")
    placed = spread.join(at, "part").select(*decided.columns, shard.alias("shard"))
    firsts = sorted(tuple(r) for r in placed.groupBy("shard").agg(F.min("key")).collect())
    number = {s: i for i, (s, _) in enumerate(firsts)}
    named = spark.createDataFrame(list(number.items()), "shard int, dense int")
    return placed.join(named, "shard").drop("shard").withColumnRenamed("dense", "shard"), [k for _, k in firsts]


def shard_of(firsts: list[str]) -> Callable:
    """The shard of a key, by bisection among the first keys."""
    codes = [k.encode() for k in firsts]

    def at(keys):
        return keys.map(lambda k: max(0, bisect.bisect_right(codes, k.encode()) - 1)).astype("int32")

    return F.pandas_udf(at, "int")


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record_id(key: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}#{copy}')}>"


def target(url: str | None) -> str:
    """The url as a header can hold it."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else "about:blank"


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", base32(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in head) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(row: dict, copy: int, payload: bytes) -> bytes:
    """The response for a page's first copy where it is one, or the revisit for what refers to another record."""
    response = row["response"] and (copy == 0 or row["small"] is not None)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    digest = hashlib.sha1(payload).digest() if response else bytes.fromhex(row["sha1"])
    fields = [("WARC-Record-ID", record_id(row["key"], copy)), ("WARC-Date", DATE), ("WARC-Target-URI", target(row["url"]))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", base32(digest))]
    if row["page_id"] is not None:
        fields.append(("Page-ID", str(row["page_id"])))
    if response:
        return record("response", fields, http + payload)
    refers = [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", record_id(row["refers_key"], 0)), ("WARC-Refers-To-Target-URI", target(row["refers_url"])), ("WARC-Refers-To-Date", DATE)]
    return record("revisit", fields + refers, http)


def store(path: str):
    """The file system of a path and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class Rolling:
    """The current file of a shard: opened under a temporary name, closed and described when it is full."""

    def __init__(self, root: str, shard: int, file_bytes: int) -> None:
        self.fs, self.root = store(root)
        self.shard, self.file_bytes, self.number, self.out, self.done = shard, file_bytes, 0, None, []

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:05d}-{self.number:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}-{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self.size, self.n, self.sum = 0, -1, hashlib.sha256()
            info = b"software: wiretide\r\nformat: WARC File Format 1.1\r\n"
            self.write(record("warcinfo", [("WARC-Record-ID", record_id(self.name, 0)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)
        self.n += 1
        if self.size >= self.file_bytes and self.n:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.name, self.temporary, self.n, self.size, self.sum.hexdigest()))
            self.number, self.out = self.number + 1, None


def writer(root: str, file_bytes: int) -> Callable:
    """Writes the sorted rows of a partition and gives the rows of its files."""

    def run(batches):
        import pyarrow as pa

        file, row = None, None
        for b in batches:
            names, columns = b.schema.names, b.columns
            for i in range(b.num_rows):
                value = {n: c[i].as_py() for n, c in zip(names, columns, strict=True) if n != "body"}
                if file is None or file.shard != value["shard"]:
                    if file is not None:
                        file.close()
                    done, file = (file.done if file else []), Rolling(root, value["shard"], file_bytes)
                    file.done = done
                if value["payload"]:  # the payload of the decision before it
                    if row is not None and row["key"] == value["key"] and row["response"]:
                        file.write(page_record(row, 0, columns[names.index("body")][i].as_py()))
                        row = None
                    continue
                row = value
                for copy in range(0 if row["small"] is not None or not row["response"] else 1, row["copies"]):
                    file.write(page_record(row, copy, row["small"] or b""))
        if file is not None:
            file.close()
        done = file.done if file else []
        names = [c.split()[0] for c in FILES.split(", ")]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], names=names)

    return run


def renamed(root: str) -> Callable:
    """Gives the listed files their names; one that has its name already is left."""

    def run(parts):
        from pyarrow import fs

        at, base = store(root)
        for part in parts:
            for temporary, name, size in zip(part["temporary"], part["file"], part["n_bytes"], strict=True):
                if at.get_file_info(f"{base}/{temporary}").type != fs.FileType.NotFound:
                    at.move(f"{base}/{temporary}", f"{base}/{name}")
                elif at.get_file_info(f"{base}/{name}").size != size:
                    raise FileNotFoundError(f"{base}/{temporary}")
            yield part

    return run


def write_archives(pages: DataFrame, root: str, least: int = LEAST, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the pages (page_id, url, html) as archives under root, a folder that all executors share; gives the manifest."""
    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest")):
        raise FileExistsError(f"{root} holds an archive")
    temporary = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_temporary")
    fs.mkdirs(temporary)
    rows = rows_of(pages)
    placed, firsts = sharded(decisions(rows, least), shard_bytes)
    large = rows.where(F.col("n_bytes") >= least).select("key", "body")
    if not placed.where((F.col("copies") > 1) & (F.col("n_bytes") >= least)).isEmpty():
        large = large.dropDuplicates(["key"])
    large = large.select(shard_of(firsts)("key").alias("shard"), "key", "body", F.lit(True).alias("payload"))
    told = placed.drop("weight").withColumn("payload", F.lit(False))
    both = told.unionByName(large, allowMissingColumns=True)
    both = both.repartitionById(max(1, len(firsts)), F.col("shard")).sortWithinPartitions("shard", "key", "payload")
    made = materialise(both.mapInArrow(writer(root, file_bytes), FILES), "warc-files")
    n = max(1, min(made.count(), spark.sparkContext.defaultParallelism * 4))
    made.repartition(n, "file").mapInPandas(renamed(root), FILES).drop("temporary").write.parquet(f"{root}/_manifest")
    fs.delete(temporary, True)
    return spark.read.parquet(f"{root}/_manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a file, compressed or not."""
    stream = io.BufferedReader(stream)
    f = gzip.GzipFile(fileobj=stream) if stream.peek(2)[:2] == b"\x1f\x8b" else stream
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields: dict[str, str] = {}
        last = ""
        while (line := f.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t":
                fields[last] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
        n = int(fields["content-length"])
        block = f.read(n)
        if len(block) < n:
            raise ValueError("a record ends early")
        yield fields, block


def page_of(file: str, fields: dict[str, str], block: bytes) -> tuple:
    """A row of RECORDS: size and digest come from the payload itself, for a revisit from what its headers say of it."""
    kind = fields["warc-type"]
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    sound = fields.get("warc-block-digest", base32(hashlib.sha1(block).digest())) == base32(hashlib.sha1(block).digest())
    told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        digest = base64.b32decode(told).hex() if told else None
    else:
        length, digest = len(payload), hashlib.sha1(payload).hexdigest()
        sound = sound and (not told or base64.b32decode(told).hex() == digest)
    page = fields.get("page-id")
    return file, kind, fields.get("warc-record-id"), fields.get("warc-refers-to"), int(page) if page else None, fields.get("warc-target-uri"), length, digest, sound


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """A row of RECORDS for each response and revisit of the files that the manifest lists."""

    def run(parts):
        import pandas as pd

        at, base = store(root)
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for part in parts:
            for file in part["file"]:
                out = []
                with at.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for fields, block in records(stream):
                        if fields["warc-type"] in ("response", "revisit"):
                            out.append(page_of(file, fields, block))
                        if len(out) >= 10_000:
                            yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64"})
                            out = []
                yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64"})

    files = spark.read.parquet(f"{root}/_manifest").select("file")
    return files.repartition(max(1, files.count()), "file").mapInPandas(run, RECORDS)


def resolve(found: DataFrame) -> DataFrame:
    """The records with refers_to as the page_id of the response referred to, and with that response's size and digest."""
    original = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("o_id"), F.col("payload_bytes").alias("o_n"), F.col("payload_digest").alias("o_digest"))
    joined = found.join(original, "refers_to", "left")
    refers = F.when(F.col("record_type") == "revisit", F.col("o_id"))
    return joined.select("page_id", F.coalesce("o_n", "payload_bytes").alias("payload_bytes"), F.coalesce("o_digest", "payload_digest").alias("payload_digest"), "record_type", refers.alias("refers_to"), "sound")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to a new folder of the shared one, read them back and resolve their revisits."""
    spark = pages.sparkSession
    root = f"{shared_dir(spark)}/wiretide/warc-{uuid.uuid4().hex}"
    write_archives(pages, root, **options)
    return resolve(materialise(read_archives(spark, root), "warc-records"))
