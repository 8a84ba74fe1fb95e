"""Token-ID output in training order: permuted slots, fixed-stride binary shards.

Each text is encoded and cut into sequences of ``length`` token ids, an end-of-text token closing
the document. The rows are ranged by a 128-bit hash of doc_id and text, and their sequences are
numbered in that order: the numbers follow from the rows alone, however they are partitioned. A
keyed Feistel permutation with cycle-walking gives each number a global slot below the number of
sequences. Shard k holds the slots from k * shard_size on, every record of the same length, so the
record of a slot is found by arithmetic and reading can stop and go on at any slot.

Record (little endian): doc_id int64 (null: -2**63), sequence number uint32, tokens uint32, then
``length`` token ids uint16, padded with the end-of-text id. Header of 80 bytes: magic, version,
length, stride, 0, first slot, records, total, key, run, hash of the records. The run is a hash of all
sequences and of the parameters: equal runs write equal bytes.

A shard is written under a temporary name and moved into place: a task that runs twice does no harm.
A shard in place with the header that this run would write is not written again; any other is replaced.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.llm.common import discard, hash128, kept_in_worker, materialise, new_path, remove

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LENGTH = 256
SHARD_SIZE = 1 << 16
KEY = 0x243F6A8885A308D3
ROUNDS = 6
HEADER, HEADER_SIZE = "<8sIIIIqqqQQQ8x", struct.calcsize("<8sIIIIqqqQQQ8x")
MAGIC, VERSION = b"DLTOKENS", 2
NO_ID = -(1 << 63)
#: Bytes of token ids of a task that are packed by shard at once.
PACKED = 1 << 25
#: Bytes of text that are encoded at once.
SLICE = 1 << 23
#: White space that is not a single space or line feed between words.
_UNEVEN = r"[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$"


class Encoder:
    """Ids of texts under a byte-level BPE vocabulary of ranks.

    Where all white space is single spaces and line feeds between words, the pattern splits before
    each space and around each line feed, so the distinct words (with the space before them) of a
    batch are encoded once, in one call, with line feeds between them: no word holds one, so its
    token marks where words end. Other texts are encoded whole.
    """

    def __init__(self, name: str = VOCABULARY):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = len(ranks)
        if self.end >= 1 << 16:
            raise ValueError("token ids must fit 16 bits")
        self.bpe = tiktoken.Encoding("driftloom", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        # Words hold no white space but a space before them, so the look-ahead of the pattern is no matter there.
        self.word_bpe = tiktoken.Encoding("driftloom-words", pat_str=public_tokenizers.PATTERN.replace(r"|\s+(?!\S)|\s+", r"|\s"), mergeable_ranks=ranks, special_tokens={})
        (self.feed,) = self.bpe.encode_ordinary("\n")

    def whole(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, disallowed_special=()).astype("<u2")

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each word); words hold no white space but a space before them."""
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py() + "\n"
        ids = self.word_bpe.encode_to_numpy(text, disallowed_special=()).astype("<u2")
        ends = np.flatnonzero(ids == self.feed)
        return ids, np.diff(ends, prepend=-1) - 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text) of a few texts; null is empty."""
        texts = pc.fill_null(texts, "")
        even = pc.invert(pc.match_substring_regex(texts, _UNEVEN))
        # A mark before each space and around each line feed, where the pattern always splits.
        marked = pc.replace_substring(pc.replace_substring(pc.if_else(even, texts, ""), " ", "\0 "), "\n", "\0\n\0")
        words = pc.split_pattern(marked, "\0")
        coded, ends = words.flatten().dictionary_encode(), words.offsets.to_numpy()
        feed = pc.index(coded.dictionary, "\n").as_py()
        ids, counts = self.words(pc.replace_substring(coded.dictionary, "\n", ""))
        at = np.cumsum(counts + 1) - counts - 1
        if feed >= 0:  # it stands as the empty word, whose end is a line feed itself
            counts[feed] = 1
        place = coded.indices.to_numpy()
        n = counts[place]
        upto = np.concatenate(([0], np.cumsum(n)))
        out = ids[np.repeat((at[place] - upto[:-1]).astype(np.int32), n) + np.arange(upto[-1], dtype=np.int32)]
        upto = upto[ends]
        sizes = np.diff(upto)
        if pc.all(even).as_py() is False:
            parts, last = [], 0
            for i in np.flatnonzero(~even.to_numpy(zero_copy_only=False)).tolist():
                own = self.whole(texts[i].as_py())
                parts += [out[last : upto[i]], own]
                last, sizes[i] = upto[i], len(own)
            out = np.concatenate([*parts, out[last:]])
        return out, sizes


def encoder_for(vocabulary: str) -> Encoder:
    """One encoder for each process and vocabulary."""
    return kept_in_worker(("encoder", vocabulary), lambda: Encoder(vocabulary))


def slices(b: pa.RecordBatch, column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``size`` bytes of a text column, or of one longer text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < b.num_rows:
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + size, "right")))
        yield b.slice(start, end - start)
        start = end


def _sequences(vocabulary: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = encoder_for(vocabulary), TaskContext.get().partitionId(), 0
        for b in (s for batch in batches for s in slices(batch, 1)):
            ids, sizes = encoder.encode(b.column(1))
            sizes, of = sizes + 1, np.repeat(np.arange(b.num_rows), sizes)
            flat = np.full(len(ids) + b.num_rows, encoder.end, "<u2")  # an end-of-text token closes each text
            flat[np.arange(len(ids)) + of] = ids
            counts = -(-sizes // length)
            n, first = int(counts.sum()), np.cumsum(counts) - counts
            seq = np.arange(n) - np.repeat(first, counts)
            starts = np.append(np.repeat(np.cumsum(sizes) - sizes, counts) + seq * length, len(flat))
            tokens = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * starts).astype("<i4")), pa.py_buffer(flat)])
            ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), counts)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), ids, pa.array(seq.astype(np.int32)), tokens], names=["part", "at", "doc_id", "seq", "tokens"])
            at += n

    return run


def permute(index: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """The slots of these numbers below ``total``: a bijection of range(total)."""
    half = max(1, ((max(total - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = np.array(index, np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(ROUNDS):
            f = right + np.uint64((key + (r + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
            f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(31))) & mask)
        x[todo] = left << np.uint64(half) | right
        todo = todo[x[todo] >= total]  # walk the cycle until it is below the total again
    return x.astype(np.int64)


def _record(length: int) -> np.dtype:
    return np.dtype([("doc_id", "<i8"), ("seq", "<u4"), ("n", "<u4"), ("ids", "<u2", (length,))])


def pack(slots: np.ndarray, ids: np.ndarray, seqs: np.ndarray, sizes: np.ndarray, tokens: memoryview) -> bytes:
    """Sequences as one compressed block: count, columns (slots count within the shard), then all token ids
    one after the other."""
    raw = b"".join((struct.pack("<q", len(slots)), slots.astype("<u4").tobytes(), ids.astype("<i8").tobytes(), seqs.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), tokens))
    return struct.pack("<q", len(raw)) + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def unpack(block: bytes, length: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, records) of a block, the records padded with ``end``."""
    raw = pa.Codec("zstd").decompress(block[8:], decompressed_size=struct.unpack_from("<q", block)[0], asbytes=True)
    (n,), at = struct.unpack_from("<q", raw), 8
    slots = np.frombuffer(raw, "<u4", n, at)
    out = np.empty(n, _record(length))
    out["doc_id"] = np.frombuffer(raw, "<i8", n, at + 4 * n)
    out["seq"] = np.frombuffer(raw, "<u4", n, at + 12 * n)
    out["n"] = np.frombuffer(raw, "<u4", n, at + 16 * n)
    ids = np.full((n, length), end, "<u2")
    ids[np.arange(length) < out["n"][:, None]] = np.frombuffer(raw, "<u2", -1, at + 20 * n)
    out["ids"] = ids
    return slots, out


def _blocks(total: int, size: int, key: int):
    """Gives sequences their slots and packs those of a task that go to the same shard."""
    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        slot = permute(t.column(0).to_numpy(), total, key)
        order = np.argsort(slot // size, kind="stable")  # sequences of a document stay together: they compress better
        t, slot = t.take(pa.array(order)).combine_chunks(), slot[order]
        ids, seqs, tokens = t.column(1).fill_null(NO_ID).to_numpy(), t.column(2).to_numpy(), t.column(3).chunk(0)
        ends, data = np.frombuffer(tokens.buffers()[1], "<i4", len(tokens) + 1, 4 * tokens.offset), memoryview(tokens.buffers()[2])
        sizes, shards = np.diff(ends) // 2, slot // size
        cuts = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1], [True]))).tolist()
        blocks = [pack(slot[a:b] % size, ids[a:b], seqs[a:b], sizes[a:b], data[ends[a] : ends[b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(shards[cuts[:-1]].astype(np.int32)), pa.array(blocks, pa.binary())], names=["shard", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.column(3).nbytes
            if n >= PACKED:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return run


def shard_name(k: int) -> str:
    return f"shard-{k:08d}.bin"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _writer(folder: str, total: int, length: int, size: int, key: int, end: int, run_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _filesystem(folder)
        shard, records, seen = None, None, 0

        def close() -> pa.RecordBatch:
            first, count, stride = shard * size, len(records), records.itemsize
            if seen != count or not have.all():
                raise RuntimeError(f"shard {shard} has not all of its slots")
            data = memoryview(records).cast("B")
            header = struct.pack(HEADER, MAGIC, VERSION, length, stride, 0, first, count, total, key % (1 << 64), run_id, xxhash.xxh64_intdigest(data))
            name = f"{base}/{shard_name(shard)}"
            info = filesystem.get_file_info(name)
            if info.size != HEADER_SIZE + len(data) or _header(filesystem, name) != header:
                part = f"{base}/.{shard_name(shard)}.{uuid.uuid4().hex}"
                with filesystem.open_output_stream(part) as f:
                    f.write(header)
                    f.write(data)
                filesystem.move(part, name)
            at = np.arange(count) * stride
            return pa.RecordBatch.from_arrays([
                pa.array(records["doc_id"], mask=records["doc_id"] == NO_ID), pa.array(records["seq"].astype(np.int32)), pa.array(records["n"].astype(np.int32)), pa.array(first + np.arange(count)),
                pa.array(np.full(count, shard, np.int64)), pa.array(HEADER_SIZE + at), pa.array([xxhash.xxh64_hexdigest(data[i : i + stride]) for i in at.tolist()])], names=_OUT)

        for b in batches:
            for k, block in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != shard:
                    if shard is not None:
                        yield close()
                    shard, seen = k, 0
                    records = np.zeros(min(size, total - k * size), _record(length))
                    have = np.zeros(len(records), bool)
                slots, part = unpack(block.as_py(), length, end)
                records[slots] = part
                have[slots] = True
                seen += len(slots)
        if shard is not None:
            yield close()

    return run


def _header(filesystem, name: str) -> bytes:
    with filesystem.open_input_file(name) as f:
        return f.read(HEADER_SIZE)


_OUT = ["doc_id", "seq", "n_tokens", "slot", "shard", "byte_offset", "record_xxh64"]


def write_shards(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, length: int = LENGTH, shard_size: int = SHARD_SIZE, key: int = KEY) -> tuple[DataFrame, str]:
    """Writes the shards of ``docs`` (doc_id, text, ...) and a manifest.json to ``folder`` (by default
    a new one in the shared folder); gives (doc_id, seq, n_tokens, slot, shard, byte_offset,
    record_xxh64), a row for each sequence, and the folder.

    Null and empty texts give one sequence, with the end-of-text token only; null doc_ids stand as
    -2**63 in the records; repeated rows are written each; other columns are ignored. An empty table
    gives no shard, a manifest of 0 sequences and no rows.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-shards")
    _mkdirs(spark, folder)
    # Equal rows are interchangeable; the salt lets a range end between them.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *hash128("doc_id", "text"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    ranged = rows.repartitionByRange("rk1", "rk2", "salt").sortWithinPartitions("rk1", "rk2").select("doc_id", "text")
    staged = ranged.mapInArrow(_sequences(vocabulary, length), "part int, at long, doc_id long, seq int, tokens binary")
    staged = materialise(staged, "token-sequences", level=6, page=8 << 20)  # the largest table there is beside the shards
    # Dense numbers: a base for each task that staged sequences, then the position within it.
    own = F.xxhash64("doc_id", "seq", "tokens")
    parts = staged.groupBy("part").agg(F.count("*").alias("n"), F.bit_xor(own).alias("x"), F.sum(F.shiftright(own, 24)).alias("s"))
    parts = materialise(parts.select("part", "n", "x", "s", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")), "token-parts")
    total, x, s = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.bit_xor("x"), F.sum("s")).first()
    end = encoder_for(vocabulary).end
    run_id = xxhash.xxh64_intdigest(repr((total, x, s, vocabulary, length, shard_size, key, end)))
    numbered = staged.join(F.broadcast(parts.select("part", "base")), "part").select((F.col("base") + F.col("at")).alias("index"), "doc_id", "seq", "tokens")  # a row for each task
    blocks = numbered.mapInArrow(_blocks(total, shard_size, key), "shard int, block binary")
    shards = -(-total // shard_size)
    manifest = {"sequences": total, "length": length, "stride": 16 + 2 * length, "header": HEADER_SIZE, "shard_size": shard_size, "shards": shards, "key": key, "run": run_id, "vocabulary": vocabulary, "end_of_text": end}
    if _manifest(folder) != manifest:
        remove(spark, f"{folder}/manifest.json")  # no reader takes the shards of two runs for one
    dealt = blocks.repartitionById(max(1, shards), "shard").sortWithinPartitions("shard")
    out = materialise(dealt.mapInArrow(_writer(folder, total, length, shard_size, key, end, run_id), "doc_id long, seq int, n_tokens int, slot long, shard long, byte_offset long, record_xxh64 string"), "token-records")
    discard(staged)
    discard(parts)
    _remove_others(folder, shards)
    _write_text(spark, f"{folder}/manifest.json", json.dumps(manifest))
    return out, folder


def _manifest(folder: str) -> dict | None:
    filesystem, base = _filesystem(folder)
    if not filesystem.get_file_info(f"{base}/manifest.json").is_file:
        return None
    with filesystem.open_input_file(f"{base}/manifest.json") as f:
        return json.loads(f.read())


def _remove_others(folder: str, shards: int) -> None:
    """Deletes what earlier runs have left beside the shards: unfinished files and shards beyond the last."""
    from pyarrow import fs

    filesystem, base = _filesystem(folder)
    for f in filesystem.get_file_info(fs.FileSelector(base)):
        name = f.base_name
        if name.startswith(".shard-") or (name.startswith("shard-") and int(name[6:-4]) >= shards):
            filesystem.delete_file(f.path)


def _mkdirs(spark: SparkSession, folder: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


class ShardReader:
    """Reads the records of a folder of shards in training order, from any slot on."""

    def __init__(self, folder: str):
        self.filesystem, self.base = _filesystem(folder)
        with self.filesystem.open_input_file(f"{self.base}/manifest.json") as f:
            self.manifest = json.loads(f.read())

    def records(self, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, int | None, int, np.ndarray]]:
        """(slot, doc_id, sequence number, token ids) of the slots from start to stop."""
        m = self.manifest
        stop = m["sequences"] if stop is None else min(stop, m["sequences"])
        while start < stop:
            shard, first = divmod(start, m["shard_size"])
            count = min(m["shard_size"] - first, stop - start)
            with self.filesystem.open_input_file(f"{self.base}/{shard_name(shard)}") as f:
                data = f.read_at(count * m["stride"], m["header"] + first * m["stride"])
            for k in range(count):
                r = data[k * m["stride"] : (k + 1) * m["stride"]]
                doc_id, seq, n = struct.unpack_from("<qII", r)
                yield start + k, None if doc_id == NO_ID else doc_id, seq, np.frombuffer(r, "<u2", n, 16)
            start += count


def op2_token_shards(spark, sf_dir: str) -> DataFrame:
    return write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
