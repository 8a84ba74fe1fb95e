"""Language-model scores: cross-entropy difference of matched n-gram models.

The tokens are the code points of the texts, all of them: one vocabulary of every code point, a
boundary and an unknown token is shared. A target model is counted on the documents that ``labels``
marks as good (quality 1, toxic 0), a background model on all documents; both are trigram models of
the same order, vocabulary and smoothing (Witten-Bell interpolation down to add-one unigrams), so
their losses are comparable token by token. A document's score is the mean over its tokens of target
loss minus background loss: the lower, the more it reads like the target.

The models are distributed tables that grow with the n-grams of the corpus; nothing of them is
collected or sent out but two totals. Documents are dealt by doc_id into chunks of about CHUNK code
points. A chunk's distinct trigrams are counted, joined with the losses, and come back to its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import materialise

#: Tokens: all code points, boundary and unknown.
VOCABULARY = 0x110000 + 2
BOUNDARY = 0x110000
#: Bits of a token in a trigram.
BITS = 21
#: Code points of a chunk, about; a longer text stands alone.
CHUNK = 1 << 21


def trigrams(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct trigrams, index into them of each token, text sizes); two boundaries stand before
    each text."""
    held = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts.to_pylist()]
    sizes = np.array([len(x) for x in held], np.int64)
    line = np.full(int((sizes + 2).sum()), BOUNDARY, np.int64)
    own = np.repeat(2 * np.arange(1, len(sizes) + 1), sizes) + np.arange(int(sizes.sum()))
    line[own] = np.concatenate(held) if len(own) else 0
    coded = pa.array(line[own - 2] << 2 * BITS | line[own - 1] << BITS | line[own], pa.int64()).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy(), sizes


def _count(docs: pa.Table, good: pa.Table) -> pa.Table:
    grams, at, sizes = trigrams(docs["text"])
    held = set(good["doc_id"].to_pylist())
    marked = np.repeat(np.array([i in held for i in docs["doc_id"].to_pylist()], bool), sizes)
    n, g = np.bincount(at, minlength=len(grams)), np.bincount(at[marked], minlength=len(grams))
    chunk = docs["chunk"][0].as_py() if docs.num_rows else 0
    return pa.table({"chunk": pa.array(np.full(len(grams), chunk, np.int64)), "gram": pa.array(grams, pa.int64()), "n": pa.array(n, pa.int64()), "g": pa.array(g, pa.int64())})


def _score(docs: pa.Table, known: pa.Table) -> pa.Table:
    grams, at, sizes = trigrams(docs["text"])
    keys = known["gram"].to_numpy()
    order = np.argsort(keys)
    place = order[np.searchsorted(keys, grams, sorter=order)] if len(grams) else np.zeros(0, np.int64)
    ends, means = np.concatenate(([0], np.cumsum(sizes))), []
    for name in ("target", "background"):
        total = np.concatenate(([0.0], np.cumsum(known[name].to_numpy()[place][at])))
        means.append((total[ends[1:]] - total[ends[:-1]]) / np.maximum(sizes, 1))
    t, b = means
    return pa.table({"doc_id": docs["doc_id"], "n_tokens": pa.array(sizes), "target_loss": pa.array(t), "background_loss": pa.array(b), "score": pa.array(t - b)})


def losses(counts: DataFrame) -> DataFrame:
    """(gram, target, background): -log p(c | a, b) of each trigram of ``counts`` (gram, n in the
    background, g in the target); trigrams backed by bigrams, unigrams and add-one."""
    col, kinds = F.col, lambda c: F.sum((F.col(c) > 0).cast("long"))
    context = lambda df, key: df.groupBy(key).agg(F.sum("n").alias("hn"), F.sum("g").alias("hg"), kinds("n").alias("kn"), kinds("g").alias("kg"))

    def backed(c: str):
        return F.when(col(f"h{c}") > 0, (col(c) + col(f"k{c}") * col(f"p{c}")) / (col(f"h{c}") + col(f"k{c}"))).otherwise(col(f"p{c}"))

    low = lambda c, bits: col(c).bitwiseAND(F.lit((1 << bits) - 1))
    three = counts.select("gram", "n", "g", F.shiftright("gram", BITS).alias("ab"), low("gram", 2 * BITS).alias("bc"))
    two = three.groupBy("bc").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).withColumns({"b": F.shiftright("bc", BITS), "c": low("bc", BITS)})
    two = materialise(two, "lm-bigrams")
    one = two.groupBy("c").agg(F.sum("n").alias("n1"), F.sum("g").alias("g1"))
    total = two.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("g"), F.lit(0))).first()
    one = one.select("c", ((col("n1") + 1) / F.lit(float(total[0] + VOCABULARY))).alias("pn"), ((col("g1") + 1) / F.lit(float(total[1] + VOCABULARY))).alias("pg"))
    two = two.join(one, "c").join(context(two, "b"), "b").select("bc", backed("n").alias("pn"), backed("g").alias("pg"))
    return three.join(two, "bc").join(context(three, "ab"), "ab").select("gram", (-F.log(backed("g"))).alias("target"), (-F.log(backed("n"))).alias("background"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for each row of ``docs`` (doc_id,
    text, ...); losses are means over the tokens, in nats.

    Null and empty texts have no tokens, losses and score 0. Without target documents the target
    model is uniform. Null doc_ids are in the background and scored; repeated rows count and are
    scored each; other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    good = labels.where("quality = 1 and toxic = 0").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    chunks = max(1, -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // CHUNK))
    dealt = lambda c: F.pmod(F.xxhash64(c), F.lit(chunks)).cast("long").alias("chunk")
    docs = docs.select(dealt(F.coalesce("doc_id", F.xxhash64("text"))), "doc_id", "text")
    good = good.select(dealt(F.col("doc_id")), "doc_id")
    counts = docs.groupBy("chunk").cogroup(good.groupBy("chunk")).applyInArrow(_count, "chunk long, gram long, n long, g long")
    counts = materialise(counts, "lm-counts")
    model = losses(materialise(counts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("g").alias("g")), "lm-trigrams"))
    known = counts.select("chunk", "gram").join(model, "gram").select("chunk", "gram", "target", "background")
    return docs.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_score, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
