"""Packing by power-of-two decomposition: sequences that never cross a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import encoder


#: Bits of a sequence id below the bucket (its length is a power of two up to 2^31) and below the task.
BUCKET_AT, TASK_AT = 58, 33


def cut(length: int, longest: int) -> list[int]:
    """Piece lengths of a document: full pieces, then the binary digits of the rest, falling."""
    pieces = [longest] * (length // longest)
    rest = length % longest
    return pieces + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int, longest: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document as pieces of power-of-two length, each a sequence of its own.

    ``longest`` is a power of two.  A document of L ids (its end id included) becomes
    L // longest full pieces and one piece per binary digit of the rest; the pieces of one
    length form a bucket from which batches of equal shape are drawn, so there is no padding
    and no attention across documents.  Sequences are numbered inside their bucket: the ids of
    length 2^b are those from b << BUCKET_AT to the next bucket's, in one gapless run per task,
    so a bucket of any size is a range of ids and needs no shuffle (``bucket_of``, ``place_of``).

    Rows: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset (always 0).  Null and empty texts are the end id alone, repeated rows are packed
    each, other columns are left out.  A task run again gives the same numbers.
    """
    if longest & (longest - 1) or not 1 <= longest < 1 << 31:
        raise ValueError("longest is a power of two")
    kind = docs.schema[id_col].dataType.simpleString()

    def pieces(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(tokenizer, 4)
        task = TaskContext.get().partitionId() << TASK_AT
        upcoming = [(b << BUCKET_AT) + task for b in range(longest.bit_length())]
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, starts, lengths, ids, totals, sequences = [], [], [], [], [], []
                for row, body in enumerate(encode(part.column(1).to_pylist())):
                    body += end
                    total, start = len(body) // 4, 0
                    for n in cut(total, longest):
                        rows.append(row)
                        starts.append(start)
                        lengths.append(n)
                        ids.append(body[4 * start : 4 * (start + n)])
                        totals.append(total)
                        bucket = n.bit_length() - 1
                        sequences.append(upcoming[bucket])
                        upcoming[bucket] += 1
                        start += n
                if rows:
                    named = part.column(0).take(pa.array(rows))
                    arrays = [named, pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64()), pa.array(sequences, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id"])

    schema = f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint"
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(pieces, schema)
    return rows.withColumn("offset", F.lit(0).cast("long"))


def bucket_of(sequence_id: Column) -> Column:
    """b of the bucket of sequences of 2^b ids."""
    return F.shiftright(sequence_id, BUCKET_AT).cast("int")


def place_of(sequence_id: Column) -> Column:
    """Number of a sequence within its bucket and task, from 0."""
    return sequence_id.bitwiseAND(F.lit((1 << TASK_AT) - 1).cast("long"))


def write_buckets(packed: DataFrame, folder: str) -> None:
    """One folder per sequence length, ready for batches of equal shape."""
    packed.write.partitionBy("length").parquet(folder)


def bucket_report(packed: DataFrame) -> DataFrame:
    return packed.groupBy("length").agg(F.count("*").alias("n_sequences"), F.sum("length").alias("n_tokens"))
