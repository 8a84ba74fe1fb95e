"""Embeddings against brute force; the pipeline against its stages; the registered queries."""

import random
import re
from collections import Counter

import numpy as np

from driftloom.llm import embed_dedup, entry, shingle_dedup

import __spark_entry__ as driver
import corpus_pipeline


def unit_rows(n, dim, seed):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, dim))
    return [(centres[r.integers(12)] + r.standard_normal(dim) * r.choice([0.0, 0.05, 0.15, 1.0])).astype(np.float32).tolist() for _ in range(n)]


def brute(rows, threshold=0.98):
    """(vec_id, links, component) for each row; rows are (vec_id, vector, label)."""
    def ok(x, label):
        return label is not None and bool(x) and all(v is not None and np.isfinite(v) for v in x) and any(x)

    n = len(rows)
    use = [ok(x, label) for _, x, label in rows]
    adj = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if use[i] and use[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    adj[i].append(j)
                    adj[j].append(i)
    seen, out = {}, []
    for i in range(n):
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            for k in adj[todo.pop()]:
                if k not in group:
                    group.add(k)
                    todo.append(k)
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        seen |= dict.fromkeys(group, min(ids) if ids else None)
    for i in range(n):
        out.append((rows[i][0], len(adj[i]), seen[i], rows[i][0] is not None and rows[i][0] == seen[i]))
    return Counter(out)


def test_embeddings(spark):
    r = random.Random(2)
    vectors = unit_rows(260, 16, 1)
    rows = [(i, v, r.randrange(3)) for i, v in enumerate(vectors)]
    rows += [(300, vectors[0], 0), (300, vectors[0], 0), (301, vectors[0], 1), (None, vectors[3], 1), (302, None, 0), (303, [], 0), (304, [0.0] * 16, 0), (305, [None] * 16, 0),
             (306, [float("nan")] * 16, 0), (307, [float("inf")] * 16, 0), (308, vectors[5], None), (309, vectors[5][:8], 0), (310, [1e30] * 16, 2), (311, [3e30] * 16, 2), (312, [1e-30] * 16, 2)]
    frame = spark.createDataFrame([(i, v, y, "clash") for i, v, y in rows], "vec_id long, embedding array<float>, label int, tile string")
    for tile in (1024, 16):
        got = Counter(tuple(x) for x in embed_dedup.near_duplicates(frame, tile=tile).collect())
        assert got == brute(rows)
    assert embed_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_bounds_are_rigorous():
    """No pair at or over a threshold is ruled out, and most others are."""
    x = np.array(unit_rows(400, 64, 3), np.float64)
    q, s, e = embed_dedup.quantise(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    real = u @ u.T
    for t in (0.5, 0.9, 0.98):
        may = embed_dedup.possible(q, s, e, q, s, e, t)
        assert may[real >= t].all() and may.mean() < (real >= t - 0.06).mean() + 0.01


def documents(spark, n=240):
    r = random.Random(11)
    vocab = "thorn river quiet garden winter marble silver distant harbor lantern meadow copper amber velvet orchard".split()
    bench = [(i, " ".join(r.choice(vocab) + str(r.randrange(30)) for _ in range(25))) for i in range(5)]
    rows, labels = [], []
    for i in range(n):
        clean = "The " + " ".join(r.choice(vocab) + str(r.randrange(9)) for _ in range(r.randrange(30, 120))) + "."
        if i % 5 == 0:
            clean = " ".join(w.upper() + "!!" for w in clean.split())
        elif i % 17 == 1:
            clean += " " + bench[i % 5][1]
        elif i % 13 == 1 and i > 20:
            clean = rows[1][1]
        rows.append((i, clean, "en", f"s{i % 4}", len(clean)))
        labels.append((i, 0 if i % 5 == 0 else 1, 0))
    rows += [(None, None, None, None, None), (n, "", "en", None, 0), rows[2]]
    return rows, labels, bench


def test_pipeline(spark, tmp_path):
    """Each stage keeps what it should of its own input; run() gives what the stages give."""
    rows, labels, bench = documents(spark)
    d = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        seen[name] = docs
        assert name == "token_output" or docs.columns == columns
    ids = {name: Counter(r.doc_id for r in df.collect()) for name, df in seen.items()}
    quality = ids["quality_classifier"]
    assert not [i for i in quality if i is not None and i < 240 and i % 5 == 0] and sum(1 for i in range(240) if i % 5 and i in quality) > 185
    once = ids["simhash_near_dedup"]
    texts = {r.doc_id: r.text for r in seen["quality_classifier"].collect()}
    assert max(once.values()) == 1 and len({texts[i] for i in once}) == len(once) == len(set(texts.values()) - {None, ""}) + (1 if {None, ""} & set(texts.values()) else 0)
    held = {i for i, t in texts.items() if i in once and t and any(b in t for _, b in bench)}
    assert set(once) - set(ids["benchmark_decontamination"]) == held and held
    sizes = Counter()
    for r in seen["benchmark_decontamination"].collect():
        sizes["all"] += len(re.findall(r"\S+", r.text or ""))
    mixed = sum(len(re.findall(r"\S+", r.text or "")) for r in seen["source_mixing"].collect())
    assert abs(mixed - sizes["all"]) < 4 * 130
    out = seen["token_output"]
    assert {r.doc_id for r in out.collect()} == set(ids["source_mixing"])
    key = lambda df: Counter((r.doc_id, r.seq, r.n_tokens, r.record_xxh64) for r in df.collect())
    assert key(corpus_pipeline.run(spark, d)) == key(out)


def test_pipeline_near_copies(spark):
    """The near-duplicate stage links just the pairs of 0.8 or more on five words, in large groups too."""
    r, rows = random.Random(12), []
    group = ["b%d" % k for k in range(150)]
    for i in range(60):
        body = [f"w{r.randrange(5000)}" for _ in range(r.randrange(80, 500))]
        rows.append(body)
        for _ in range(2):
            copy = list(body)
            for _ in range(r.randrange(1, len(body) // 50 + 1)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(5000)}"
            rows.append(copy)
    for k in range(40):
        rows.append([*group[:60], f"y{k}", *group[61:]])
        rows.append([*group[:60], *(f"z{k}{j}" for j in range(40)), *group[60:]])  # less than 0.8
    shingles = [{tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in rows]
    root = list(range(len(rows)))
    linked = 0
    for i in range(len(rows)):
        for j in range(i):
            if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                a, b = sorted((root[i], root[j]))
                root, linked = [a if x == b else x for x in root], linked + 1
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)] + [(900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (None, "one two")], "doc_id long, text string")
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert sorted(x.doc_id for x in kept.collect()) == sorted({*root, 900, 902}) and linked > 300
    assert corpus_pipeline.simhash_near_dedup(spark, docs.limit(0), "").count() == 0


def near_sets(n, seed):
    """Sets of shingle hashes, each with a copy whose similarity is 0.8 to 0.95."""
    r, out = np.random.default_rng(seed), []
    for _ in range(n):
        size = int(r.integers(9, 300))
        own = r.integers(0, 1 << 64, size, np.uint64)
        other = own.copy()
        other[: r.integers(1, size // 9 + 1)] = r.integers(0, 1 << 64, 1, np.uint64)
        out += [np.unique(own), np.unique(other)]
    return out


def test_pipeline_simhash_variants():
    """Pairs of 0.8 lie within the radius and meet under a variant; a half of a segment gives a forest of
    just the pairs that share a variant of it, also over two tiles."""
    sets = near_sets(150, 4)
    h, mean = sets[0], 255 * len(sets[0])
    weights = ((h ^ shingle_dedup._XOR) * shingle_dedup._ODD)
    weights = (weights ^ weights >> np.uint64(32)).astype("<u8")[:, :, None].view(np.uint8)
    bits = [2 * int(weights[k, :, b].sum(dtype=np.int64)) > mean for k in range(56) for b in (0, 2, 4, 6, 1, 3, 5, 7)]
    assert shingle_dedup.fingerprint(h).tolist() == [sum(bits[7 * q + p] << p for p in range(7)) for q in range(64)]
    prints = np.array([shingle_dedup.fingerprint(h) for h in sets])
    words, n = prints.view(np.uint64), np.array([len(h) for h in sets])
    apart = np.bitwise_count(prints[:, None] ^ prints[None])
    near = apart.sum(axis=2) <= shingle_dedup.RADIUS
    alike = (apart.reshape(len(sets), len(sets), 32, 2).sum(axis=3) <= 1).any(axis=2)
    for i in range(0, len(sets), 2):
        if shingle_dedup.jaccard(sets[i], sets[i + 1]) >= 0.8:
            assert near[i, i + 1] and alike[i, i + 1]
    total, tile = 0, np.arange(len(sets)) % 2
    for half in range(64):
        for value in np.unique(prints[:, half]):
            at = np.flatnonzero(prints[:, half] == value)
            for tiles in (None, tile[at]):
                pairs = shingle_dedup.meetings(half, at, n[at], words[at], tiles)
                total += len(pairs)
                root = np.arange(len(at))
                for i, j in pairs:
                    root[root == root[j]] = root[i]
                other = half ^ 1
                held = near[np.ix_(at, at)] & (apart[at[:, None], at[None], other] <= 1)
                held &= np.minimum(n[at][:, None], n[at]) >= 0.8 * np.maximum(n[at][:, None], n[at])
                if half % 2:  # pairs equal in the whole segment are taken up under the first half
                    held &= apart[at[:, None], at[None], other] == 1
                if tiles is not None:
                    held &= tiles[:, None] != tiles
                want = np.arange(len(at))
                for i, j in np.argwhere(held):
                    want[want == want[j]] = want[i]
                assert ((root[:, None] == root) == (want[:, None] == want)).all()
    assert total > 500


def test_pipeline_links_come_by_simhash(spark):
    """The near-duplicate stage finds its pairs by the fingerprints: none within a radius that holds none. A link
    that the forest of its cluster has left out is found too."""
    r = random.Random(5)
    body = [f"w{r.randrange(5000)}" for _ in range(300)]
    rows = [(i, " ".join([*body[:k], f"x{i}", *body[k + 1 :]])) for i, k in enumerate(range(20, 290, 30))]
    docs = spark.createDataFrame([*rows, (50, "  " + rows[4][1].upper())], "doc_id long, text string")
    assert [x.doc_id for x in shingle_dedup.deduplicate(docs).collect()] == [0]
    assert sorted(x.doc_id for x in shingle_dedup.deduplicate(docs, radius=-1).collect()) == [i for i, _ in rows]
    # 0.67 to 0.77 to the hub, of which some are 0.8 or more to one another.
    hub, rows = [f"h{k}" for k in range(200)], []
    for i in range(60):
        copy = list(hub)
        for k in range(i % 6, 6 + i % 3):
            copy[10 + 30 * (k % 6)] = f"y{i % 12}{k}"
        rows.append([*copy, *(f"z{i}{k}" for k in range(i // 12 * 4))])
    sets = [{tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    assert sorted(x.doc_id for x in shingle_dedup.deduplicate(docs).collect()) == sorted(set(root)) and 1 < len(set(root)) < 50


def test_registered():
    names = list(driver.queries())
    assert [n for n in names if re.match(r"op\d+_", n)] == list(entry.QUERIES) and "pipeline" in names
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in entry.QUERIES} == set(range(1, 11))
    assert set(driver.oracle_sql()) <= set(names) and [k for k, _ in corpus_pipeline.STAGES][0] == "quality_classifier"
