"""Token ids in ascending document order, as Huffman-coded files.

Format. A file set is a folder with two Parquet tables. `codes` has one row per
id that occurs: (id, length), the canonical code of the global counts. `blocks`
has one row per independent block: shard (ascending with the document order),
block (ascending within the shard), n_ids, doc_ids, doc_tokens (ids of each
document), doc_bytes (byte offset of each in the payload), checkpoints (bit
offset of every further segment of a document, in order) and payload. A block
holds whole documents; any block decodes with the code table alone."""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import bound_arrow, scratch, shared_path, shuffles_dropped, trimmed
from ledgerline.llm.huffman import SEGMENT, canonical_codes, code_lengths, decode, decode_table, encode
from ledgerline.llm.word_tokens import WordTokenizer

#: Bytes of ids coded at a time: what stays in a core's cache.
_SLICE_BYTES = 1 << 17
#: Ids of a block and of a shard, about.
BLOCK_IDS, SHARD_IDS = 1 << 18, 1 << 22
_BLOCKS = "shard long, block long, n_ids long, doc_ids array<long>, doc_tokens array<long>, doc_bytes array<long>, checkpoints array<long>, payload binary"


def _tokenise(path: str, end_id: int | None, wide: bool):
    kind = np.uint32 if wide else np.uint16

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer.at(path)
        gc.disable()  # lists of bytes hold no cycles; looking for some costs a lot
        tail = b"" if end_id is None else np.array([end_id], kind).tobytes()
        for part in batches:
            rows = coder.encode(part.column(1))
            if coder.width != kind().itemsize:
                rows = [np.frombuffer(r, coder.code).astype(kind).tobytes() for r in rows]
            rows = [r + tail for r in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) // kind().itemsize for r in rows], pa.int64()), pa.array([xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in rows], pa.int64()), pa.array(rows, pa.binary())], ["id", "n", "h", "ids"])
        gc.enable()

    return trimmed(run)


def _count(wide: bool, size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for row in batch.column(0):
                total += np.bincount(np.frombuffer(row.as_buffer(), np.uint32 if wide else np.uint16), minlength=size) if len(row.as_buffer()) > 4 * size else 0
            small = [row.as_buffer() for row in batch.column(0) if len(row.as_buffer()) <= 4 * size]
            for at in range(0, len(small), 256):
                total += np.bincount(np.frombuffer(b"".join(small[at : at + 256]), np.uint32 if wide else np.uint16), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["id", "count"])

    return trimmed(run)


def _packed(lengths: np.ndarray, wide: bool):
    """Rows (shard, id, n, ids) in the order of the file set to its blocks."""

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        kind = np.uint32 if wide else np.uint16
        for batch in batches:
            rows = [r.as_buffer() for r in batch.column(3)]
            payloads, points, at = [], [], 0
            while at < len(rows):
                held, end = 0, at
                while end < len(rows) and (end == at or held + len(rows[end]) <= _SLICE_BYTES):
                    held += len(rows[end])
                    end += 1
                ids = np.frombuffer(b"".join(rows[at:end]), kind)
                starts = np.concatenate([[0], np.cumsum([len(r) // kind().itemsize for r in rows[at:end]])])
                payload, where, marks = encode(ids, starts, codes, lengths)
                payloads += [payload[a:b] for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
                points += [m[1:] for m in marks]
                at = end
            cuts = np.concatenate([[0], np.cumsum([len(p) for p in points])])
            flat = np.concatenate([np.zeros(0, np.int64), *points])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat)), pa.array(payloads, pa.binary())],
                ["shard", "id", "n", "points", "payload"],
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        WordTokenizer.forget()
        yield from _blocks(coded(batches))

    return trimmed(run)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (shard, id) to blocks of whole documents."""
    shard, block, held = None, 0, 0
    some: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        rows = pa.Table.from_batches(some).combine_chunks()
        payloads = rows.column("payload").to_pylist()
        sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
        points = pa.concat_arrays([c.flatten() for c in rows.column("points").chunks])
        lists = [rows.column("id"), rows.column("n"), pa.chunked_array([pa.array(np.cumsum(sizes) - sizes)]), pa.chunked_array([points])]
        whole = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.concat_arrays(c.chunks).cast(pa.int64())) for c in lists]
        numbers = [pa.array([int(x)], pa.int64()) for x in (shard, block, held)]
        return pa.RecordBatch.from_arrays([*numbers, *whole, pa.array([b"".join(payloads)], pa.binary())], schema=_arrow_blocks)

    for batch in batches:
        shards, sizes = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("shard", "n"))
        at = 0
        while at < len(shards):
            if some and (shards[at] != shard or held >= BLOCK_IDS):
                yield flush()
                some, held, block = [], 0, block + 1
            if shards[at] != shard:
                shard, block = shards[at], 0
            same = at + int(np.searchsorted(shards[at:], shard, "right"))
            sums = np.cumsum(sizes[at:same])
            end = min(same, at + int(np.searchsorted(sums, BLOCK_IDS - held)) + 1)
            some.append(batch.slice(at, end - at))
            held += int(sums[end - at - 1])
            at = end
    if some:
        yield flush()


_many = pa.list_(pa.int64())
_arrow_blocks = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", _many), ("doc_tokens", _many), ("doc_bytes", _many), ("checkpoints", _many), ("payload", pa.binary())])


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, max_bits: int = 18) -> None:
    """Encode every whole text and write the ids as a file set at `path`, in
    ascending order of id_col (null ids first, rows that share an id by a hash
    of their ids).

    Null and empty texts have only the end id. Texts are read once; the ids are
    counted over all documents, dealt to shards by sampled ranges of (id, hash),
    sorted there and coded. Extra columns are ignored. An empty table gives an
    empty file set."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    bound_arrow(spark)
    size = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), (end_id or 0) + 1)
    wide = size > 1 << 16
    schema = "id long, n long, h long, ids binary"
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_tokenise(tokenizer_path, end_id, wide), schema)
    with scratch():
        table_path = shared_path(spark, "ids")
        ids.write.option("compression", "zstd").parquet(table_path)
        table = spark.read.schema(schema).parquet(table_path)
        counted = table.select("ids").mapInArrow(_count(wide, size), "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).toArrow()
        counts = np.zeros(size, np.int64)
        counts[counted.column("id").to_numpy()] = counted.column("count").to_numpy()
        lengths = code_lengths(counts, max_bits)
        used = np.flatnonzero(lengths)
        codes = spark.createDataFrame(pa.table({"id": used.astype(np.int64), "length": lengths[used].astype(np.int32)}))
        codes.coalesce(1).write.parquet(f"{path}/codes")
        order = [F.col("id").asc_nulls_first(), F.col("h").asc()]
        shards = max(int(counts.sum()) // SHARD_IDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = table.repartitionByRange(shards, *order).sortWithinPartitions(*order)
        with shuffles_dropped(spark):
            dealt.select(F.spark_partition_id().cast("long").alias("shard"), "id", "n", "ids").mapInArrow(_packed(lengths, wide), _BLOCKS).write.parquet(f"{path}/blocks")


def block_starts(blocks: DataFrame) -> DataFrame:
    """Rows (shard, block, start): ids of the file set before each block. Sums
    run over shard totals first, then over the blocks within a shard."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("in_shard")).join(base, "shard").select("shard", "block", (F.col("base") + F.col("in_shard")).alias("start"))


def decode_block(row: dict, table: np.ndarray, bits: int) -> list[np.ndarray]:
    """The ids of each document of a block."""
    tokens = np.array(row["doc_tokens"], np.int64)
    segments = -(-tokens // SEGMENT)
    first = np.repeat(np.concatenate([[0], np.cumsum(segments)])[:-1], segments)
    number = np.arange(int(segments.sum())) - first
    offsets = np.repeat(np.array(row["doc_bytes"], np.int64) * 8, segments)
    offsets[number > 0] += np.array(row["checkpoints"], np.int64)
    counts = np.minimum(SEGMENT, np.repeat(tokens, segments) - number * SEGMENT)
    ids = decode(row["payload"], offsets, counts, table, bits)
    return np.split(ids, np.cumsum(tokens)[:-1]) if len(tokens) else []


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Read a file set back: per document (id_col, start, n_tokens, ids_crc32)
    and, if asked for, ids (array of int). start counts the ids of all documents
    before it; the crc is of the ids as little-endian 32-bit integers."""
    blocks = spark.read.parquet(f"{path}/blocks")
    codes = spark.read.parquet(f"{path}/codes").toArrow()
    lengths = np.zeros(int(max(codes.column("id").to_numpy(), default=0)) + 1, np.uint8)
    lengths[codes.column("id").to_numpy()] = codes.column("length").to_numpy()
    starts = block_starts(blocks.select("shard", "block", "n_ids"))
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = decode_table(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                docs = decode_block(row, table, bits)
                tokens = np.array(row["doc_tokens"], np.int64)
                out = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["start"] + np.cumsum(tokens) - tokens),
                    pa.array(tokens),
                    pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in docs], pa.int64()),
                    *([pa.array([d.astype(np.int32) for d in docs], pa.list_(pa.int32()))] if with_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(out, schema=pa.schema(kinds))

    read = blocks.join(starts, ["shard", "block"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
    return read.withColumnRenamed("doc_id", id_col)
