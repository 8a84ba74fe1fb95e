"""Token counts of whole texts under a public tokenizer, with overlap resynchronisation.

A text longer than a chunk is encoded in overlapping chunks with offsets. Neighbouring chunks
are spliced at a common boundary in their overlap that is proven stable: ASCII white space,
which this family of tokenizers drops, so that normalisation, word splitting and merges on its
two sides never see each other, and where both encodings have a token boundary. If the overlap
has none, it is widened, at last to the end of the text.

The same proof lets shorter texts be counted word by word: a bounded memo holds the counts of
words between ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import kept_in_worker

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Code points of a chunk and of the overlap that is tried first.
CHUNK = 1 << 15
OVERLAP = 1 << 9
#: Words whose counts a worker remembers.
MEMO = 300_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Counter:
    """Counts tokens as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Splicing and the memo rest on the vocabulary dropping ASCII white space; whether it does is
    tested once, and otherwise texts are encoded whole.
    """

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.chunk, self.overlap, self.limit = chunk, overlap, memo
        self.memo: dict[bytes, int] = {}
        self.drops_space = all(
            self._ids(f"{a}{s}{b}") == self._ids(a) + self._ids(b)
            for a, b in (("ab", "cd"), ("1", "2"), ("x!", "?y"), ("é", "́e")) for s in " \t\n\x0b\x0c\r")

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.drops_space:
            return len(self._ids(text))
        if len(text) > self.chunk:
            return self.count_long(text)
        memo, words = self.memo, text.encode().split()  # bytes are split at ASCII white space only
        fresh = [w for w in dict.fromkeys(words) if w not in memo]
        if fresh:
            if len(memo) + len(fresh) > self.limit:
                memo.clear()
                fresh = list(dict.fromkeys(words))
            for w, e in zip(fresh, self.tok.encode_batch_fast([w.decode() for w in fresh], add_special_tokens=False), strict=True):
                memo[w] = len(e.ids)
        return sum([memo[w] for w in words])

    def count_long(self, text: str) -> int:
        """Tokens of a long text from overlapping chunks: [start, end) is the chunk, and its
        tokens are taken from the last splice up to the next one."""
        total, start, n = 0, 0, len(text)
        while n - start > self.chunk:
            end, overlap = start + self.chunk, self.overlap
            left = self._offsets(text, start, end)
            while True:
                right_from = max(start, end - overlap)
                right = self._offsets(text, right_from, min(n, end + overlap))
                splice = self._common(text, left, right, right_from, end)
                if splice is not None or end >= n:
                    break
                overlap *= 2  # no stable boundary: widen on both sides and encode again
                end = min(n, end + overlap)
                left = self._offsets(text, start, end)
            if splice is None:
                return total + len(left)
            total += sum(1 for s, _ in left if s < splice)
            start = splice
        return total + len(self._offsets(text, start, n))

    def _offsets(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        e = self.tok.encode(text[start:end], add_special_tokens=False)
        return [(a + start, b + start) for a, b in e.offsets]

    @staticmethod
    def _common(text, left, right, low: int, high: int) -> int | None:
        """The last white space in [low, high) that no token of either chunk covers."""
        inside = lambda spans: {i for s, e in spans for i in range(max(s, low), min(e, high))}
        covered = inside(left) | inside(right)
        for i in range(high - 1, low, -1):
            if text[i] in " \t\n\x0b\x0c\r" and i not in covered:
                return i
        return None


def counter(path: str) -> Counter:
    """One counter for each worker process and vocabulary."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept_in_worker(("counter", path), lambda: Counter(path))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs`` (doc_id, text, ...).

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows are counted each; other columns
    are ignored; an empty table gives no rows. ``vocabulary`` is the name of a public file, found
    on each worker by its own package, never copied.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary_path(vocabulary))
        for b in batches:
            tokens = pa.array([c.count(t.as_py()) for t in b.column(1)], pa.int64())
            size = pc.fill_null(pc.cast(pc.binary_length(b.column(1)), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), size, tokens, pc.greater(tokens, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
