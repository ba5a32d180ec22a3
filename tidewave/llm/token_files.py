"""Token-id files: flat unsigned integers plus 64-bit document offsets, in ascending document order.

`write_tokens` range-partitions the documents by id, so that each task holds one contiguous run of the order, encodes it
and writes three flat files: `.bin` (ids, unsigned 16 bits, little-endian), `.idx` (64-bit offsets of the documents in
the file and its end) and `.ids` (64-bit document ids). The manifest has one row per file; the base of a file is the
prefix sum of the id counts before it. `read_tokens` maps the files into memory and returns documents.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm._common import fresh_dir, lean, open_input, open_output, table, text_or_empty

def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents of `docs` as token files under `folder`; returns the manifest.

    Manifest columns: file (path without suffix), part (place in the order), docs, nulls (documents with a null id, the
    first ones), tokens, base (ids before the file). A null text counts as empty and yields the end id alone; null ids sort
    first; rows that repeat an id all stay, in the order of a hash of their texts, however many tasks they fill; an empty
    table gives an empty manifest. A task that is run again writes under a new name, so the manifest only names files of
    finished tasks. The manifest has a row per partition; only it meets in the driver.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    # Three numbers are sampled for the ranges, no texts; the last one parts equal rows, whose order does not matter.
    order = ["id", "_hash", "_row"]
    ordered = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    @lean
    def write(batches: Iterator) -> Iterator:
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from tidewave.llm import vocab

        encode = vocab.encoder(tokenizer).encode_all
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        end, offsets, ids, out = np.array([end_id], "<u2").tobytes(), [0], [], None
        for batch in batches:
            if batch.num_rows and out is None:
                out = open_output(name + ".bin")
            for _, _, coded in encode(batch.column("text")):
                for packed in coded:
                    out.write(packed + end)
                    offsets.append(offsets[-1] + len(packed) // 2 + 1)
            ids += batch.column("id").to_pylist()
        if out is None:
            return
        out.close()
        for suffix, values in ((".idx", offsets), (".ids", [0 if i is None else i for i in ids])):
            with open_output(name + suffix) as f:
                f.write(np.array(values, "<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int32()), "docs": pa.array([len(ids)], pa.int64()), "nulls": pa.array([ids.count(None)], pa.int64()), "tokens": pa.array([offsets[-1]], pa.int64())})

    found = sorted(ordered.mapInArrow(write, "file string, part int, docs long, nulls long, tokens long").collect(), key=lambda r: r.part)
    manifest, base = [], 0
    for r in found:
        manifest.append((r.file, r.part, r.docs, r.nulls, r.tokens, base))
        base += r.tokens
    spark = docs.sparkSession
    return spark.createDataFrame(manifest, "file string, part int, docs long, nulls long, tokens long, base long").repartition(max(1, len(manifest)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Documents of token files: doc_id, start (ids before it in the whole order), n_tokens, ids (binary, little-endian 32 bits)."""

    @lean
    def read(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(open_input(row["file"] + ".ids").read(), "<i8")
                offsets = np.frombuffer(open_input(row["file"] + ".idx").read(), "<i8")
                with open_input(row["file"] + ".bin") as f:
                    for a in range(0, len(ids), 512):
                        b = min(a + 512, len(ids))
                        f.seek(2 * int(offsets[a]))
                        wide = np.frombuffer(f.read(2 * int(offsets[b] - offsets[a])), "<u2").astype("<u4")
                        cut = offsets[a : b + 1] - offsets[a]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(ids[a:b], mask=np.arange(a, b) < row["nulls"]), "start": pa.array(offsets[a:b] + row["base"]), "n_tokens": pa.array(np.diff(offsets[a : b + 1])),
                            "ids": pa.array([wide[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                        })

    return manifest.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, as read back from token files written in ascending doc_id order."""
    import public_tokenizers

    manifest = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fresh_dir(spark, "tokens"))
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op8_token_files": op8_token_files}
SQL: dict[str, str] = {}
