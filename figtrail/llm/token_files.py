"""Token-id files: flat unsigned integers, 64-bit document offsets, read through memory maps."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from figtrail.llm.common import as_bytes, stored
from figtrail.llm.encode import encoder


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _write(fs: pafs.FileSystem, path: str, chunks) -> None:
    """Written under a name of the attempt and moved, so a repeated or doubled task leaves whole files only."""
    context = TaskContext.get()
    draft = f"{path}.{context.taskAttemptId() if context else 0}"
    with fs.open_output_stream(draft) as out:
        for c in chunks:
            out.write(c)
    fs.move(draft, path)


NO_ID = np.iinfo(np.int64).min
#: Parts are at most this many, however large the table.
MOST_PARTS = 10_000


def _bounds(keyed: DataFrame, part_bytes: int) -> np.ndarray:
    """Ids that split the table into parts of about so many bytes of text, by approximate percentiles: one row."""
    size = keyed.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = min(MOST_PARTS, max(1, -(-size // part_bytes)))
    cuts = [i / n for i in range(1, n)]
    found = keyed.agg(F.percentile_approx("_id", cuts)).first()[0] if cuts else None
    return np.array(found or [], np.int64)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 32 << 20) -> DataFrame:
    """Writes part-00000.ids (unsigned little-endian integers of `width` bytes, 2 or 4), .offsets (signed 64-bit
    starts over the whole set, one per document and one past the end) and .docs (signed 64-bit ids) per range of
    ascending ids, and a table of parts: part, n_docs, n_tokens, base. The bases are prefix sums over one row per part.

    Null texts count as empty and hold the end id alone. Documents with a null id stand first and are stored under the
    smallest 64-bit integer; repeated ids are stored as often as they come, and one that fills several parts is dealt over
    them. An empty table gives no file. A text is encoded whole, where it is read, and only its ids are shuffled; a
    task writes documents, places and ids as they come. `width` 2 refuses ids over 65,535."""
    fs_root, kind, end = folder.rstrip("/"), {2: "<u2", 4: "<u4"}[width], end_id.to_bytes(4, "little")
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(text_col).alias("_text"))
    bounds = _bounds(keyed, part_bytes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            out = []
            for text in as_bytes(b.column(1)):
                ids = enc.ids(text) + end
                if width == 2:
                    wide = np.frombuffer(ids, "<u4")
                    if wide.max() > 65_535:
                        raise ValueError("an id does not fit in 16 bits; write with width=4")
                    ids = wide.astype("<u2").tobytes()
                out.append(ids)
            doc = b.column(0).to_numpy()
            low, high = np.searchsorted(bounds, doc, "left"), np.searchsorted(bounds, doc, "right")
            yield pa.RecordBatch.from_arrays([pa.array((low + np.arange(len(doc)) % (high - low + 1)).astype(np.int32)), b.column(0), pa.array(out, pa.binary())], names=["part", "_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        part, attempt, n, at = first.column(0)[0].as_py(), TaskContext.get().taskAttemptId(), 0, 0
        fs, root = _filesystem(fs_root)
        names = [f"{root}/part-{part:05d}.{x}" for x in ("ids", "docs", "ends")]
        # drafts bear the attempt's name and are moved when whole, so a repeated or doubled task leaves whole files only
        to_ids, to_docs, to_ends = (fs.open_output_stream(f"{name}.{attempt}") for name in names)
        to_ends.write(np.zeros(1, "<i8").tobytes())
        while first is not None:
            sizes = np.fromiter((len(x) // width for x in first.column(2).to_pylist()), np.int64, first.num_rows)
            to_ids.write(b"".join(first.column(2).to_pylist()))
            to_docs.write(first.column(1).to_numpy().astype("<i8").tobytes())
            to_ends.write((at + np.cumsum(sizes)).astype("<i8").tobytes())
            n, at, first = n + first.num_rows, at + int(sizes.sum()), next(batches, None)
        for stream, name in zip((to_ids, to_docs, to_ends), names, strict=True):
            stream.close()
            fs.move(f"{name}.{attempt}", name)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": pa.array([n], pa.int64()), "n_tokens": pa.array([at], pa.int64())})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(fs_root)

        def based(name: str, base: int):
            with fs.open_input_stream(name) as f:
                while block := f.read(1 << 23):
                    yield (np.frombuffer(block, "<i8") + base).astype("<i8").tobytes()

        for b in batches:
            for part, base in zip(b.column("part").to_pylist(), b.column("base").to_pylist(), strict=True):
                _write(fs, f"{root}/part-{part:05d}.offsets", based(f"{root}/part-{part:05d}.ends", base))
            yield b

    fs, root = _filesystem(fs_root)
    fs.create_dir(root, recursive=True)
    placed = keyed.mapInArrow(encode, "part int, _id long, ids binary").repartitionById(len(bounds) + 1, "part").sortWithinPartitions("_id")
    parts = stored(placed.mapInArrow(write, "part int, n_docs long, n_tokens long"), "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    done = stored(based.repartition(max(1, parts.count()), "part").mapInArrow(place, "part int, n_docs long, n_tokens long, base long"), "token-bases")
    with fs.open_output_stream(f"{root}/format.json") as out:
        out.write(json.dumps({"width": width, "end_id": end_id}).encode())
    return done


def _mapped(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A memory map where the store is a local or mounted folder, a ranged read elsewhere."""
    if isinstance(fs, pafs.LocalFileSystem) or getattr(fs, "base_fs", None):
        return np.memmap(path, kind, "r") if fs.get_file_info(path).size else np.zeros(0, kind)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_token_files(spark: SparkSession, parts: DataFrame, folder: str) -> DataFrame:
    """Reads the files back, one task or more per part: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers). `parts` is the table that write_token_files returns."""
    fs_root = folder.rstrip("/")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(fs_root)
        with fs.open_input_file(f"{root}/format.json") as f:
            kind = {2: "<u2", 4: "<u4"}[json.loads(f.read())["width"]]
        for b in batches:
            for part in b.column("part").to_pylist():
                name = f"{root}/part-{part:05d}"
                ids, docs, at = _mapped(fs, f"{name}.ids", kind), _mapped(fs, f"{name}.docs", "<i8"), _mapped(fs, f"{name}.offsets", "<i8")
                for lo in range(0, len(docs), 4096):
                    hi = min(lo + 4096, len(docs))
                    starts = np.asarray(at[lo:hi + 1])
                    crc = [zlib.crc32(ids[s - at[0]:e - at[0]].astype("<u4").tobytes()) for s, e in zip(starts[:-1], starts[1:], strict=True)]
                    keys = np.asarray(docs[lo:hi])
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64(), mask=keys == np.iinfo(np.int64).min), "start": pa.array(starts[:-1], pa.int64()), "n_tokens": pa.array(np.diff(starts), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    # the rows are few and their files are not: as many tasks as files
    return parts.select("part").repartition(max(1, parts.count()), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
