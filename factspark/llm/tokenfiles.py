"""Flat files of token ids, written by tasks into the shared folder and read by range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder


def store(folder: str):
    """The file system of a folder's URI and the folder's path there."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(folder)


def write_flat(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int, id_col: str, text_col: str, headers: bool,
               specials_as_text: bool = False) -> DataFrame:
    """Write each partition as one file of ids and return one row per document.

    A document is its ids and ``end_id``, ``width`` bytes each, after a header with that
    number as 4 bytes if ``headers``.  Rows: shard (partition number), file, ordinal, doc_id,
    offset (bytes), before (ids before it in the file), n_tokens.  A file name holds a random
    part, so a second attempt of a task never touches the first one's file; only the
    rows of the attempt that Spark commits name a file.  The result must be written once
    before it is used (see ``common.saved``).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    system, path = store(folder)
    system.create_dir(path, recursive=True)

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(tokenizer, width, specials_as_text)
        end = end_id.to_bytes(width, "little")
        shard = TaskContext.get().partitionId()
        name = f"{shard:08d}-{uuid.uuid4().hex}.ids"
        system, path = store(folder)
        out, at, before, ordinal = None, 0, 0, 0
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, 1000):
                    part = batch.slice(lo, 1000)
                    rows = []
                    if out is None:
                        out = system.open_output_stream(f"{path}/{name}")
                    for body in encode(part.column(1).to_pylist()):
                        n = len(body) // width + 1
                        head = n.to_bytes(4, "little") if headers else b""
                        out.write(head + body + end)
                        rows.append((at, before, n, ordinal))
                        at += len(head) + n * width
                        before += n
                        ordinal += 1
                    offset, prior, n, ordinals = (pa.array(x, pa.int64()) for x in zip(*rows))
                    same = [pa.array([x] * len(rows)) for x in (shard, name)]
                    yield pa.RecordBatch.from_arrays(
                        [same[0].cast(pa.int32()), same[1], ordinals, part.column(0), offset, prior, n],
                        names=["shard", "file", "ordinal", "doc_id", "offset", "before", "n_tokens"],
                    )
        finally:
            if out is not None:
                out.close()

    schema = f"shard int, file string, ordinal bigint, doc_id {kind}, offset bigint, before bigint, n_tokens bigint"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(write, schema)
