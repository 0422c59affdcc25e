"""Token-id output in training order: fixed-stride binary shards filled by a keyed permutation of all sequences.

Sequences are numbered densely. A Feistel network over the smallest even number of bits that holds their count permutes the
numbers under a key; numbers that leave the range are sent through again until they are back in it (cycle-walking), so every
sequence gets a slot of 0 .. count - 1 and the order is the same in every rerun. Slots are range-partitioned into shards of
`slots` rows of equal length, so that the bytes of a slot are at slot % slots * stride and a reader goes on anywhere by seeking.
A shard is written under another name and then renamed: a task that is run again after the loss of an executor writes the same
bytes, and a half-written shard is never seen.

A text's ids, then the id that ends a document, are cut into parts of `length` ids; the last part is filled up with that id.
Two kinds of ids are offered. BPE ids (two bytes each) are the registered ones: `bpe_slots`, for documents read from files,
encodes once and numbers the parts in the order of the files and their rows, from one count per file split; `sequences` and
`slotted`, for any documents, number them in the order of (doc_id, part, payload). Byte ids (`byte_slots`, one byte each, for
documents read from files) are an option: a text's UTF-8 bytes; 255, which UTF-8 never uses, ends a document.

A null or empty text is one part that holds only the end. A null doc_id is kept (first in order for `slotted`). Rows that repeat
get a slot each. An empty table writes no shard. Extra columns are ignored.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from basketlens.llm import bpe
from basketlens.llm.common import in_chunks, numbered, shared_folder, table, tell_workers, written
from basketlens.session import settled

LENGTH, SLOTS, KEY = 512, 4096, 20240229
#: Ranges of shards that are shuffled one after the other.
WAVES = 6
END, BYTE_END = 50256, 255
ROUNDS = 6
#: What names a split of the files.
PLACE = ["file_path", "file_block_start", "file_block_length"]


def _store(folder: str):
    """The file system of a folder that all executors see, and the folder in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if re.match(r"\w+:", folder) else f"file://{folder}")


def _parts(doc, ids: np.ndarray, length: int, fill: bool) -> list:
    """(doc, part, ids in it, their bytes) of a document's ids and the end; `fill` fills the last part up."""
    n = len(ids) + 1
    all_of = np.full(-(-n // length) * length if fill else n, END, "<u2")
    all_of[: n - 1] = ids
    return [(doc, i, min(length, n - i * length), all_of[i * length : (i + 1) * length].tobytes()) for i in range(-(-n // length))]


def sequences(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, part, n_tokens, payload): parts of `length` little-endian 16-bit ids; n_tokens counts them without the filling."""
    tell_workers(docs.sparkSession)
    path = vocabulary or bpe.default_vocabulary()

    def run(batches):
        c = bpe.codec(path)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"], c.encoded(batch["text"].tolist())):
                rows += _parts(doc, ids, length, fill=True)
            yield pd.DataFrame(rows, columns=["doc_id", "part", "n_tokens", "payload"]).astype({"doc_id": "Int64"})

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(run, "doc_id long, part long, n_tokens long, payload binary")


def _split(docs: DataFrame) -> Column:
    """A number for the split of a file that a row comes from, whatever columns the table has."""
    place = docs.metadataColumn("_metadata")
    return F.xxhash64(*[place.getField(c) for c in PLACE])


def bpe_slots(docs: DataFrame, length: int = LENGTH, key: int = KEY, vocabulary: str | None = None) -> tuple[DataFrame, int]:
    """((doc_id, part, n_tokens, payload, slot) of all parts of documents read from files, without filling; number of parts). Texts
    are encoded once and written; parts are numbered from one count per file split."""
    tell_workers(docs.sparkSession)
    path = vocabulary or bpe.default_vocabulary()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _split(docs).alias("split"))

    def run(batches):
        c, at = bpe.codec(path), {}
        for batch in batches:
            all_of = list(zip(batch["doc_id"], batch["text"].tolist(), batch["split"].tolist()))
            for some in in_chunks(all_of, lambda x: len(x[1]), 4 * bpe.CHUNK):
                rows = []
                for (doc, _, split), ids in zip(some, c.encoded([x[1] for x in some])):
                    parts, first = _parts(doc, ids, length, fill=False), at.get(split, 0)
                    at[split] = first + len(parts)
                    rows += [(*part, first + i, split) for i, part in enumerate(parts)]
                yield pd.DataFrame(rows, columns=["doc_id", "part", "n_tokens", "payload", "at", "split"]).astype({"doc_id": "Int64"})

    parts = written(texts.mapInPandas(run, "doc_id long, part long, n_tokens long, payload binary, at long, split long"))
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("split").agg(F.count("*").alias("n"))  # two numbers for each split of the files
    offsets = written(counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))))
    count = offsets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), count, key))

    # called nondeterministic so that a filter on the slots stays above it and each row's slot is worked out once
    placed = parts.join(F.broadcast(offsets.drop("n")), "split").withColumn("slot", slot.asNondeterministic()(F.col("offset") + F.col("at")))
    return placed.drop("offset", "at", "split"), count


def permuted(x: np.ndarray, count: int, key: int = KEY) -> np.ndarray:
    """The slot of each number of 0 .. count - 1."""
    half = np.uint64(max(1, -(-(count - 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)

    def once(v):
        left, right = v >> half, v & mask
        for r in range(ROUNDS):
            f = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key + r * 0x632BE59BD9B4E019 & (1 << 64) - 1)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return left << half | right

    out = once(x.astype(np.uint64))
    while (outside := out >= count).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def byte_slots(docs: DataFrame, length: int = LENGTH, key: int = KEY) -> tuple[DataFrame, int]:
    """((doc_id, part, n_tokens, slot, payload) of all parts of documents read from files; number of parts)."""
    tell_workers(docs.sparkSession)
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", text.alias("text"), _split(docs).alias("split"))
    parts = F.ceil((F.octet_length("text") + 1) / length)
    before, count = {}, 0
    for r in rows.groupBy("split").agg(F.sum(parts).alias("n")).orderBy("split").collect():  # two numbers for each split of the files
        before[r["split"]] = count
        count += r["n"]

    def run(batches):
        at = {}
        for batch in batches:
            rows, slots = [], []
            for doc, text, split in zip(batch["doc_id"], batch["text"], batch["split"].tolist()):
                n = len(text) + 1
                padded = text + bytes([BYTE_END]) * (-(-n // length) * length - len(text))
                first = at.setdefault(split, before[split])
                k = len(padded) // length
                at[split] = first + k
                slots.append(np.arange(first, first + k))
                rows += [(doc, i, min(length, n - i * length), padded[i * length : (i + 1) * length]) for i in range(k)]
            out = pd.DataFrame(rows, columns=["doc_id", "part", "n_tokens", "payload"]).astype({"doc_id": "Int64"})
            out.insert(3, "slot", permuted(np.concatenate(slots), count, key) if slots else [])
            yield out

    return rows.mapInPandas(run, "doc_id long, part long, n_tokens long, slot long, payload binary"), count


def slotted(rows: DataFrame, key: int = KEY) -> tuple[DataFrame, int]:
    """(rows with their slot, number of rows)."""
    placed = numbered(written(rows), "index", F.col("doc_id").asc_nulls_first(), F.col("part"), F.col("payload"))
    count = placed.agg(F.max("index")).first()[0]
    count = 0 if count is None else count + 1

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), count, key))

    return placed.withColumn("slot", slot("index")).drop("index"), count


def write_shards(rows: DataFrame, folder: str, count: int, slots: int = SLOTS, stride: int | None = None, fill: bytes = b"") -> DataFrame:
    """Writes the shards of rows (slot, payload, ...) and returns where each row is: shard, at (its first byte), n_bytes and a
    checksum in place of payload. A payload shorter than the stride is filled up."""
    shards = max(1, -(-count // slots))
    shard = F.floor(F.col("slot") / slots)  # a range of slots; all of its rows go to one task, in order
    placed = rows.repartition(shards, shard).sortWithinPartitions("slot").withColumn("shard", shard)
    keep = [f for f in rows.schema.fields if f.name != "payload"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", shard long, at long, n_bytes long, crc long"

    def run(batches):
        store, base = _store(folder)
        shard, stream = None, None

        def finish():
            if stream is not None:
                stream.close()
                store.move(f"{name}.part-{task}", name)

        task = TaskContext.get().taskAttemptId()
        for batch in batches:
            at, sizes, sums = [], [], []
            for number, payload in zip(batch["shard"].tolist(), batch["payload"].tolist()):
                if stride and len(payload) < stride:
                    payload += fill * ((stride - len(payload)) // len(fill))
                if number != shard:
                    finish()
                    shard, name, offset = number, posixpath.join(base, f"shard-{number:08d}.bin"), 0
                    stream = store.open_output_stream(f"{name}.part-{task}")
                stream.write(payload)
                at.append(offset)
                sizes.append(len(payload))
                sums.append(zlib.crc32(payload))
                offset += len(payload)
            out = batch.drop(columns=["payload"])
            out["at"], out["n_bytes"], out["crc"] = at, sizes, sums
            yield out
        finish()

    tell_workers(rows.sparkSession)
    return placed.mapInPandas(run, schema)


def read_slots(folder: str, first: int, n: int, slots: int = SLOTS, length: int = LENGTH, kind: str = "<u2") -> np.ndarray:
    """n sequences from slot `first` on, in training order, by one seek a shard; kind is <u1 for byte ids, <u2 for BPE ids."""
    store, base = _store(folder)
    stride, out = np.dtype(kind).itemsize * length, []
    while n > 0:
        name = posixpath.join(base, f"shard-{first // slots:08d}.bin")
        if store.get_file_info(name).type.name == "NotFound":
            break
        with store.open_input_file(name) as f:
            f.seek(first % slots * stride)
            got = f.read(min(n, slots - first % slots) * stride)
        if not got:
            break
        out.append(np.frombuffer(got, kind).reshape(-1, length))
        first, n = first + len(out[-1]), n - len(out[-1])
    return np.concatenate(out) if out else np.empty((0, length), kind)


def write_in_waves(rows: DataFrame, folder: str, count: int, slots: int = SLOTS, waves: int = WAVES, **options) -> DataFrame:
    """`write_shards` for a range of shards after the other, so that only a part of the payload is in a shuffle at any time; the
    rows, which have to be written, are read once a wave."""
    shards = max(1, -(-count // slots))
    step = -(-shards // waves) * slots
    found = []
    for first in range(0, max(count, 1), step):
        some = rows.where((F.col("slot") >= first) & (F.col("slot") < first + step))
        found.append(written(write_shards(some, folder, min(step, count - first), slots, **options)))
    return reduce(DataFrame.unionByName, found)


def op2_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Writes the shards of all documents' BPE ids and gives where each sequence is: (slot, shard, at, n_bytes, crc, doc_id, part,
    n_tokens). What is written on the way is removed once the shards stand."""
    target = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    store, base = _store(target)
    store.create_dir(base, recursive=True)

    def build() -> DataFrame:
        rows, count = bpe_slots(table(spark, folder, "documents"))
        return write_in_waves(rows, target, count, stride=2 * LENGTH, fill=END.to_bytes(2, "little"))

    return settled(spark, build)
