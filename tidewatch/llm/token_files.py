"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are renumbered by falling frequency over the whole corpus, so the common ones take one byte. A number takes 1 to 4
data bytes, little-endian; two bits in a stream of control bytes tell how many, four numbers to a control byte. Blocks
of documents are rows of Parquet files, which Spark commits whole: a lost executor leaves no half-written block.
Decoding looks each control byte up in a table of four lengths and gathers the data bytes with numpy.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.llm.common import stored
from tidewatch.llm.tokens import END_ID, default_path, token_ids, tokenizer
from tidewatch.session import shared_dir

#: Documents and ids in a block, at most (a longer document stands alone).
BLOCK_IDS = 500_000
BLOCKS = "part int, block int, n_docs int, n_ids long, doc_ids binary, nulls binary, sizes binary, control binary, data binary"
#: Lengths of the four numbers that a control byte describes.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def encode(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    numbers = np.ascontiguousarray(numbers, dtype="<u4")
    extra = (numbers > 0xFF).astype(np.uint8)
    if len(numbers) and numbers.max() > 0xFFFF:
        extra += (numbers > 0xFFFF).astype(np.uint8) + (numbers > 0xFFFFFF).astype(np.uint8)
    four = np.zeros(-(-len(numbers) // 4) * 4, dtype=np.uint8)
    four[:len(numbers)] = extra
    four = four.reshape(-1, 4)
    control = four[:, 0] | (four[:, 1] << 2) | (four[:, 2] << 4) | (four[:, 3] << 6)
    width = int(extra.max()) + 1 if len(numbers) else 1
    raw = numbers.view(np.uint8).reshape(-1, 4)[:, :width]
    data = raw[np.arange(width, dtype=np.uint8) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of a block."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    begins = ends - lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw[begins].astype("<u4")
    for k in range(1, int(lengths.max()) if n else 1):
        more = np.flatnonzero(lengths > k)
        out[more] |= raw[begins[more] + k].astype("<u4") << np.uint32(8 * k)
    return out


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Blocks of plain ids in ascending doc_id order (null ids first), stored."""
    wide = "<u2" if max(tokenizer(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held, docs_, total = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pd.DataFrame:
            ids = np.concatenate(held)
            null = np.array([d is None for d in docs_], dtype=np.uint8)
            names = np.array([0 if d is None else d for d in docs_], dtype="<i8")
            return pd.DataFrame([(part, number, len(docs_), len(ids), names.tobytes(), null.tobytes(),
                                  np.array([len(x) for x in held], "<i8").tobytes(), b"", ids.astype(wide).tobytes())],
                                columns=["part", "block", "n_docs", "n_ids", "doc_ids", "nulls", "sizes", "control", "data"])

        for b in batches:
            known = b["doc_id"].astype("Int64")
            for doc, ids in zip(known, token_ids(b["text"], path, end_id)):
                if held and total + len(ids) > BLOCK_IDS:
                    yield flush()
                    number, held, docs_, total = number + 1, [], [], 0
                held.append(ids)
                docs_.append(None if doc is pd.NA else int(doc))
                total += len(ids)
        if held:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInPandas(blocks, BLOCKS)), wide


def frequency_ranks(blocks: DataFrame, wide: str) -> np.ndarray:
    """All ids of the corpus by falling count, ties to the smaller id: rank to id. As long as the vocabulary."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for data in b["data"]:
                more = np.bincount(np.frombuffer(data, wide))
                if len(more) > len(total):
                    more[:len(total)] += total
                    total = more
                else:
                    total[:len(more)] += more
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen, "n": total[seen]})

    counts = blocks.select("data").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(dtype="<u4")


def write_token_files(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Tokenise ``docs`` (doc_id, text; a null text is empty, a null doc_id sorts first) and write
    ``out``/vocabulary (rank to id) and ``out``/blocks. Documents that share a doc_id stay separate, ordered by text."""
    spark = docs.sparkSession
    plain, wide = tokenised(docs, path or default_path(), end_id)
    by_rank = frequency_ranks(plain, wide)
    ranks = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, dtype="<u4")
    ranks[by_rank] = np.arange(len(by_rank), dtype="<u4")

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [encode(ranks[np.frombuffer(x, wide)]) for x in b["data"]]
            yield b.assign(control=[c for c, _ in pairs], data=[d for _, d in pairs])

    spark.createDataFrame([(bytearray(by_rank.tobytes()),)], "ids binary").coalesce(1).write.parquet(f"{out}/vocabulary")
    plain.mapInPandas(coded, BLOCKS).write.parquet(f"{out}/blocks")


def block_arrays(row, by_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, null flags, sizes and all ids of a block."""
    return (np.frombuffer(row.doc_ids, "<i8"), np.frombuffer(row.nulls, np.uint8), np.frombuffer(row.sizes, "<i8"),
            by_rank[decode(row.control, row.data, row.n_ids)])


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    by_rank = np.frombuffer(bytes(spark.read.parquet(f"{out}/vocabulary").first()[0]), "<u4")
    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                names, null, sizes, ids = block_arrays(row, by_rank)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - n:e]) for e, n in zip(ends, sizes)]
                yield pd.DataFrame({"doc_id": pd.array(names, "Int64"), "part": row.part, "block": row.block, "within": ends - sizes,
                                    "n_tokens": sizes, "ids_crc32": crc}).assign(doc_id=lambda x: x["doc_id"].mask(null.astype(bool)))

    per_doc = blocks.mapInPandas(documents, "doc_id long, part int, block int, within long, n_tokens long, ids_crc32 long")
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each file
    earlier = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    in_part = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("in_part", in_part).join(earlier, "part").select("part", "block", (F.col("part_start") + F.col("in_part")).alias("at"))
    return per_doc.join(starts, ["part", "block"]).select("doc_id", (F.col("at") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_file_digest(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the files in a new folder under the shared one and return what reading them back gives."""
    out = f"{shared_dir(docs.sparkSession)}/{uuid.uuid4().hex}"
    write_token_files(docs, out, path, end_id)
    return read_token_files(docs.sparkSession, out)
