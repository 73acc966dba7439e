"""WARC files and a fixity audit of their replicas by Merkle trees."""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from figtrail.llm.common import as_bytes, stored
from figtrail.llm.token_files import _filesystem, _write

FANOUT = 16
DATE = "2024-01-01T00:00:00Z"


def warc_record(key: int | None, url: bytes, payload: bytes) -> bytes:
    head = (b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:%s>\r\nWARC-Date: %s\r\nWARC-Target-URI: %s\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n"
            % (b"" if key is None else b"%d" % key, DATE.encode(), url, len(payload)))
    return head + payload + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    """A record as a gzip member of its own, the compressed form of WARC: any record can be read without those before it."""
    return gzip.compress(record, 6, mtime=0)


def _digest(member: bytes) -> str:
    """Of the record in a member. Bytes that are no whole member are hashed as they stand, so they differ from every record."""
    try:
        return hashlib.sha256(gzip.decompress(member)).hexdigest()
    except (OSError, EOFError, zlib.error):
        return hashlib.sha256(member).hexdigest()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes part-00000.warc.gz and on, each a range of ascending ids and each record a gzip member, and returns the
    manifest, one row per record: seq (over the archive), page_id, part, at and stored (place and length of its member in
    the file), offset and length (place over the archive and length, both of plain records), body (where the payload
    starts in the plain record), payload.

    Null ids come first and are written without a number, null payloads and urls as empty; repeated rows are records of
    their own. Other columns are left out. An empty table writes no file. Records are written as they come."""
    root_uri = folder.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, at, start = TaskContext.get().partitionId(), [], 0, 0
        fs, root = _filesystem(root_uri)

        def records():
            nonlocal at, start
            for b in batches:
                for key, url, payload in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), as_bytes(b.column(2)), strict=True):
                    one = warc_record(key, url, payload)
                    member = _member(one)
                    rows.append((key, part, len(rows), at, len(member), start, len(one), len(one) - len(payload) - 4, len(payload)))
                    at += len(member)
                    start += len(one)
                    yield member

        stream = records()
        first = next(stream, None)
        if first is None:
            return
        _write(fs, f"{root}/part-{part:05d}.warc.gz", (x for group in ([first], stream) for x in group))
        names = ["page_id", "part", "no", "at", "stored", "start", "length", "body", "payload"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), *[pa.int64()] * 7], strict=True)], names=names)

    fs, root = _filesystem(root_uri)
    fs.create_dir(root, recursive=True)
    keyed = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(payload_col).alias("_body"), F.monotonically_increasing_id().alias("_tie"))
    order = [F.col("_id").asc_nulls_first(), F.col("_tie")]
    written = stored(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_url", "_body").mapInArrow(write, "page_id long, part int, no long, at long, stored long, start long, length long, body long, payload long"), "warc-manifest")
    sizes = written.groupBy("part").agg(F.count("*").alias("_n"), F.sum("length").alias("_bytes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_bytes")])  # one row per file
    placed = written.join(F.broadcast(bases), "part")
    return placed.select((F.col("_n") + F.col("no")).alias("seq"), "page_id", "part", "at", "stored", (F.col("_bytes") + F.col("start")).alias("offset"), "length", "body", "payload")


def _by_file(manifest: DataFrame) -> DataFrame:
    return manifest.select("part", "at", "stored", "seq", "page_id", "length", "body", "payload", "offset").repartition(F.col("part")).sortWithinPartitions("part", "at")


def damaged_copy(manifest: DataFrame, source: str, target: str, damaged: Callable[[int | None], bool]) -> DataFrame:
    """A replica whose records for the given ids have the lowest bit of the first payload byte flipped. A changed record
    compresses to another length, so the replica's own places come back: seq, at, stored."""
    source_uri, target_uri = source.rstrip("/"), target.rstrip("/")

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, to = _filesystem(target_uri)
        src, root = _filesystem(source_uri)
        rows = (r for b in batches for r in b.to_pylist())
        waiting = next(rows, None)
        while waiting is not None:
            part, places = waiting["part"], []

            def chunks(part: int = part, places: list = places):
                nonlocal waiting
                at = 0
                with src.open_input_file(f"{root}/part-{part:05d}.warc.gz") as f:
                    while waiting is not None and waiting["part"] == part:
                        member = f.read_at(waiting["stored"], waiting["at"])
                        if waiting["payload"] and damaged(waiting["page_id"]):
                            data = bytearray(gzip.decompress(member))
                            data[waiting["body"]] ^= 1
                            member = _member(bytes(data))
                        places.append((waiting["seq"], at, len(member)))
                        at += len(member)
                        yield member
                        waiting = next(rows, None)

            _write(fs, f"{to}/part-{part:05d}.warc.gz", chunks())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*places, strict=True)], names=["seq", "at", "stored"])

    fs, root = _filesystem(target_uri)
    fs.create_dir(root, recursive=True)
    return stored(_by_file(manifest).mapInArrow(copy, "seq long, at long, stored long"), "warc-copy")


def hash_records(manifest: DataFrame, folder: str, replica: str) -> DataFrame:
    """(replica, level 0, idx, lo, hi, digest): the SHA-256 of the plain record that stands in the replica at each
    record's place. A missing or short file, or a member that cannot be unpacked, gives the digest of the bytes there."""
    root_uri = folder.rstrip("/")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(root_uri)
        now, f = None, None
        for b in batches:
            digests = []
            for part, at, length in zip(b.column("part").to_pylist(), b.column("at").to_pylist(), b.column("stored").to_pylist(), strict=True):
                if part != now:
                    if f is not None:
                        f.close()
                    now, path = part, f"{root}/part-{part:05d}.warc.gz"
                    f = fs.open_input_file(path) if fs.get_file_info(path).type == pafs.FileType.File else None
                there = max(0, min(length, f.size() - at)) if f is not None else 0
                digests.append(_digest(f.read_at(there, at) if there else b""))
            lo = b.column("offset")
            hi = pa.array([x + y for x, y in zip(lo.to_pylist(), b.column("length").to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("seq"), lo, hi, pa.array(digests)], names=["idx", "lo", "hi", "digest"])
        if f is not None:
            f.close()

    return _by_file(manifest).mapInArrow(hashed, "idx long, lo long, hi long, digest string").select(F.lit(replica).alias("replica"), "*")


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """A node covers `fanout` ordered children: their digests and its byte range are hashed together."""
    group = nodes.groupBy("replica", F.expr(f"idx div {fanout}").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("_c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return group.select("replica", "idx", "lo", "hi", F.sha2(F.concat_ws("|", F.col("_c.digest"), F.col("lo"), F.col("hi")), 256).alias("digest"))


def audit(manifest: DataFrame, primary: str, replica: str, fanout: int = FANOUT, replica_places: DataFrame | None = None) -> DataFrame:
    """The records whose bytes differ: seq, page_id, offset, length, primary_sha256, replica_sha256. A replica whose members
    lie at other places than the primary's brings them as `replica_places` (seq, at, stored).

    Every record of both replicas is hashed; levels of `fanout` children each are built up to one root, and from roots
    that differ only the children of differing nodes are compared. Equal roots end the audit with an empty result, as
    does an empty manifest. Levels shrink by the fanout and are stored, so their number is the logarithm of the records."""
    manifest = stored(manifest, "warc-placed")
    n = manifest.count()
    there = manifest if replica_places is None else manifest.drop("at", "stored").join(replica_places, "seq")
    levels = [stored(hash_records(manifest, primary, "a").unionByName(hash_records(there, replica, "b")), "merkle-0")]
    while n > 1:
        n = -(-n // fanout)
        levels.append(stored(_parents(levels[-1], fanout), f"merkle-{len(levels)}"))
    wrong = None
    for nodes in reversed(levels):
        if wrong is not None:
            nodes = nodes.withColumn("_up", F.expr(f"idx div {fanout}")).join(wrong.select(F.col("idx").alias("_up")), "_up", "left_semi")
        pair = nodes.groupBy("idx").agg(F.max(F.when(F.col("replica") == "a", F.col("digest"))).alias("primary_sha256"), F.max(F.when(F.col("replica") == "b", F.col("digest"))).alias("replica_sha256"))
        wrong = stored(pair.where("NOT primary_sha256 <=> replica_sha256"), "merkle-wrong")
    return wrong.withColumnRenamed("idx", "seq").join(manifest.select("seq", "page_id", "offset", "length"), "seq")
