"""SentencePiece encoding and decoding through a table of distinct chunks.

A model whose pieces hold the whitespace marker only at their front cannot merge across a marker that
follows other characters. So a text is cut in front of every run of markers, and each distinct chunk
is segmented once for the whole table:

1. One pass over the texts cuts them into blocks of whole documents. A block lists its distinct chunks,
   dealt into buckets by their hash, and keeps each document as positions in that list.
2. The chunks of a bucket come together from all blocks; each distinct one is segmented once, and every
   block gets its ids back. A block names a chunk once, so no chunk is hot however frequent it is.
3. The ids are joined back by block and position. The blocks lie in a table bucketed by block, so only
   the ids of chunks travel for this.

The result equals ``encode`` of the library on the whole text. ``check_model`` refuses models for which the cut is
not exact (other normalisation, pieces across markers, user-defined symbols).

A null text is empty and has no ids, as an empty one; an empty table gives no rows; repeated rows and null ids
are encoded alike. Kept columns of the names ``ids`` or ``decoded`` give way to the results.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from ordersight.session import cut, fresh_dir

BLOCK = 1 << 23  # characters of a block, unless one text is longer
MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
ACROSS = re.compile(f"[^{MARK}]{MARK}")
PLAIN_KINDS = (1, 2, 3, 6)  # ordinary, unknown, control and byte pieces


@cache
def processor(path: str):
    """The model of ``path``, once per process; executors read the same path as the driver."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_model(path: str) -> None:
    """Raise ``ValueError`` if texts cannot be segmented chunk by chunk with this model."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rule = model.normalizer_spec
    if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not (rule.add_dummy_prefix and rule.escape_whitespaces):
        raise ValueError("the model normalises texts: chunks of the raw text are not its chunks")
    if model.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only merges with the marker in front can be cut at markers")
    if any(ACROSS.search(piece.piece) or piece.type not in PLAIN_KINDS for piece in model.pieces):
        raise ValueError("a piece crosses a whitespace marker, or is a user-defined symbol")
    if all(piece.piece != MARK for piece in model.pieces):
        raise ValueError("the marker is no piece of its own")


def chunks(text: str) -> list[str]:
    """The marked chunks of a text, in order; together they are the marked text."""
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def segment(path: str, marked: list[str]) -> list[list[int]]:
    """Ids of marked chunks. The library puts the first marker in front again."""
    model = processor(path)
    found = model.encode([chunk[1:] for chunk in marked], num_threads=1)
    lone = [model.piece_to_id(MARK)]
    return [ids if chunk != MARK else lone for chunk, ids in zip(marked, found, strict=True)]


def pack(data: bytes) -> bytes:
    """Compressed bytes: chunk lists and ids travel and lie on disk as a third of their size."""
    return zstandard.compress(data, 3)


unpack = zstandard.decompress


def pack_codes(codes: np.ndarray) -> bytes:
    """Positions byte plane by byte plane: their high bytes are nearly all zero."""
    return pack(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_codes(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(unpack(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


class _Block:
    """Documents that share one list of distinct chunks."""

    def __init__(self, buckets: int, schema: pa.Schema) -> None:
        self.buckets, self.schema = buckets, schema
        self.seen: dict[str, int] = {}
        self.codes: list[np.ndarray] = []
        self.kept: list[pa.StructArray] = []
        self.characters = 0

    def add(self, text: str | None) -> None:
        own = chunks(text or "")
        seen = self.seen
        self.codes.append(np.fromiter((seen.setdefault(c, len(seen)) for c in own), np.int32, len(own)))
        self.characters += len(text or "")

    def rows(self, name: int) -> pa.RecordBatch:
        """One row per filled bucket with its chunks, then one row with the documents (bucket -1)."""
        listed = list(self.seen)
        bucket = np.fromiter((crc32(c.encode()) % self.buckets for c in listed), np.int32, len(listed))
        by = np.argsort(bucket, kind="stable")
        filled, counts = np.unique(bucket, return_counts=True)
        n = len(filled) + 1
        ends = np.cumsum(counts).tolist()
        in_order = [listed[i] for i in by.tolist()]
        # a chunk holds no space, so that spaces part the chunks of a row
        texts = [" ".join(in_order[low:high]) for low, high in zip([0, *ends], ends, strict=False)]

        def last(values: pa.Array) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array([0] * n + [len(values)], pa.int32()), values)

        kept = pa.concat_arrays(self.kept)
        columns = [
            pa.array([name] * n, pa.int64()),
            pa.array([*filled.tolist(), -1], pa.int32()),
            pa.array([*[pack(own.encode()) for own in texts], None], pa.binary()),
            last(kept),
            last(pa.array([len(c) for c in self.codes], pa.int32())),
            pa.array([*[None] * len(filled), pack_codes(np.concatenate(self.codes))], pa.binary()),
            last(pa.array(bucket)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "bucket", "chunks", "kept", "sizes", "codes", "buckets"])


def _blocks(buckets: int):
    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, block = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            first, texts = 0, batch.column(0)
            rest = pa.StructArray.from_arrays(batch.columns[1:], fields=list(batch.schema)[1:])
            for i in range(len(texts)):
                block = block or _Block(buckets, batch.schema)
                block.add(texts[i].as_py())
                if block.characters >= BLOCK:
                    block.kept.append(rest.slice(first, i + 1 - first))
                    yield block.rows(name)
                    name, block, first = name + 1, None, i + 1
            if block and first < len(texts):
                block.kept.append(rest.slice(first))
        if block:
            yield block.rows(name)

    return cut_texts


def _segmented(path: str, kind: type):
    def of_bucket(rows: pa.Table) -> pa.Table:
        seen: dict[str, int] = {}  # the distinct chunks of this bucket, whatever blocks they are from
        places = []
        for listed in rows["chunks"]:
            own = unpack(listed.as_py()).decode().split(" ")
            places.append(np.fromiter((seen.setdefault(c, len(seen)) for c in own), np.int32, len(own)))
        found = segment(path, list(seen))
        lengths = np.array([len(ids) for ids in found], np.int32)
        flat = np.fromiter(chain.from_iterable(found), kind, int(lengths.sum()))
        counts = [lengths[at] for at in places]
        ids = [_gather(flat, lengths, at) for at in places]
        packed = {"counts": [pack(own.tobytes()) for own in counts], "ids": [pack(own.tobytes()) for own in ids]}
        return pa.table({"block": rows["block"], "bucket": rows["bucket"], **packed})

    return of_bucket


def _gather(flat: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs ``at`` of ``flat``, one behind the other, where run k is ``lengths[k]`` long."""
    starts, taken = np.cumsum(lengths, dtype=np.int64) - lengths, lengths[at]
    ends = np.cumsum(taken, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    places = np.repeat((starts[at] - (ends - taken)).astype(kind), taken)
    places += np.arange(total, dtype=kind)
    return flat[places]


def _joined(kind: type):
    def of_block(blocks: pa.Table, segmented: pa.Table) -> pa.Table:
        """The documents of one block, with the ids of their chunks in place of positions."""
        rows = segmented.sort_by("bucket")
        numbers = lambda name: np.asarray(blocks[name].combine_chunks().flatten())
        packed = lambda name: b"".join(unpack(own.as_py()) for own in rows[name])
        counts, flat = np.frombuffer(packed("counts"), np.int32), np.frombuffer(packed("ids"), kind)
        by = np.argsort(numbers("buckets"), kind="stable")
        slot = np.empty(len(by), np.int32)
        slot[by] = np.arange(len(by), dtype=np.int32)
        at, sizes = slot[unpack_codes(blocks["codes"][0].as_py())], numbers("sizes")
        sums = np.concatenate([[0], np.cumsum(counts[at], dtype=np.int64)])[np.concatenate([[0], np.cumsum(sizes)])]
        ids = _lists(_gather(flat, counts, at).astype(np.int32), np.diff(sums))
        return pa.table([blocks["kept"].combine_chunks().flatten(), ids], names=["kept", "ids"])

    return of_block


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``ids`` (array of int): what the model at ``path`` makes of ``text``.

    No begin or end ids, no sampling. A block is the largest thing in one task beside a single text.
    """
    check_model(path)
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = StructType([docs.schema[c] for c in keep])
    whole = F.col(f"`{text}`").cast("string").alias("text")
    plain = docs.select(whole, *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    inner = StructType([StructField(f"k{i}", field.dataType) for i, field in enumerate(kept)])
    numbers = ArrayType(IntegerType())
    layout = StructType(
        [
            StructField("block", LongType()),
            StructField("bucket", IntegerType()),
            StructField("chunks", BinaryType()),
            StructField("kept", ArrayType(inner)),
            StructField("sizes", numbers),
            StructField("codes", BinaryType()),
            StructField("buckets", numbers),
        ]
    )
    name = f"blocks_{uuid.uuid4().hex}"
    writer = plain.mapInArrow(_blocks(buckets), layout).write.bucketBy(buckets, "block")
    writer.option("path", fresh_dir(spark, "blocks")).option("compression", "zstd").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name goes; the files and the plan that reads them stay
    listed = blocks.filter("bucket >= 0").select("block", "bucket", "chunks")
    kind = np.uint16 if processor(path).vocab_size() <= 1 << 16 else np.int32
    segmented = cut(
        listed.groupBy("bucket").applyInArrow(_segmented(path, kind), "block long, bucket int, counts binary, ids binary")
    )
    documents = blocks.filter("bucket < 0").select("block", "kept", "sizes", "codes", "buckets")
    both = documents.groupBy("block").cogroup(segmented.groupBy("block"))
    result = StructType([StructField("kept", inner), StructField("ids", numbers)])
    found = both.applyInArrow(_joined(kind), result)
    names = [c for c in keep if c != "ids"]
    return found.select(*[F.col(f"kept.k{i}").alias(c) for i, c in enumerate(keep) if c in names], "ids")


def decoder(path: str):
    """A function from a column of ids to the text that the model's ``decode`` makes of them; null gives null."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        model = processor(path)
        # one list of Python numbers at a time
        return pa.array([model.decode(own.as_py()) if own.is_valid else None for own in ids], pa.string())

    return decode


def digest(ids: Column) -> Column:
    """Lowercase hex sha256 of the decimal ids, joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
