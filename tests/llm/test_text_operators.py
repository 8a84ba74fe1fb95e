"""Text operators against brute force, on a table with every awkward kind of row."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from driftloom.llm import decontam, line_dedup, lm_score, mixing, pii, quality, simhash, token_count, token_shards
from driftloom.llm.common import connected_components

#: Extra columns bear names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rk1 string, fp int, size string, h string, keys int, _k int, at int, x int"
LINE = "the common line"


def words(r, n):
    return " ".join(r.choice("alpha Beta gamma delta EPSILON zeta eta theta iota kappa über façade mañana".split()) + r.choice(["", "", ".", ","]) for _ in range(n))


def messy_rows():
    r = random.Random(5)
    texts = [words(r, r.randrange(1, 60)) for _ in range(30)]
    texts += [f"  {LINE}  \n{words(r, 5)}\n{LINE.upper()}" for _ in range(12)]
    texts += [None, "", " ", "\n\n", "one", "one two three", "ÀÉ é x y", "a\x1cb\x85c", "x" * 5000, words(r, 3000), "tab\there\r\nand\x0bthere", "😀 emoji 😀", texts[0], texts[0] + " extra"]
    rows = [(i, t, "en", f"s{i % 5}" if i % 11 else None, len(t or ""), "clash", 1, "s", "h", 2, 3, 4, 5) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[31]]  # repeated rows
    rows += [(None, "no id", None, None, None, *[None] * 8), (None, None, None, "s1", None, *[None] * 8), (None, texts[1], "en", "s2", 1, *[None] * 8)]
    return rows


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# --- op4 ---

def brute_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] if len(ws) >= 4 else [" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, ids, radius=4):
    n = len(fps)
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    least = defaultdict(lambda: None)
    for i in range(n):
        if ids[i] is not None and (least[label[i]] is None or ids[i] < least[label[i]]):
            least[label[i]] = ids[i]
    return [least[x] for x in label]


def test_simhash_rows(messy, none):
    rows = messy_rows()
    fps = [brute_fingerprint(r[1]) for r in rows]
    comps = brute_components(fps, [r[0] for r in rows])
    got = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(messy).collect())
    assert got == Counter((r[0], f, c) for r, f, c in zip(rows, fps, comps, strict=True))
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_long_texts_in_blocks(monkeypatch):
    text = words(random.Random(1), 500)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_links_lose_no_connection(spark):
    """Dense clusters around random centres, with large buckets: components equal brute force."""
    r = random.Random(3)
    fps = set()
    for _ in range(6):
        centre = r.getrandbits(64)
        for _ in range(120):
            f = centre
            for b in r.sample(range(64), r.randrange(6)):
                f ^= 1 << b
            fps.add(f)
    fps |= {r.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    held = edges.collect()
    assert all(((e.a ^ e.b) & (2**64 - 1)).bit_count() <= 4 for e in held) and len(held) < 10 * len(fps)
    root = {e.v: e.root for e in connected_components(edges).collect()}
    want = brute_components(fps, signed)
    assert [root.get(f, f) for f in signed] == want


def test_simhash_keeps_one_of_each_group(messy):
    kept = simhash.deduplicate(messy)
    assert kept.columns == messy.columns
    found = simhash.near_duplicates(messy).collect()
    assert kept.count() == len({r.root for r in found})
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert set(ids) == {r.component_id for r in found if r.component_id is not None} and len(ids) == len(set(ids))


# --- op6 ---

def test_token_counts(messy, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_count.vocabulary_path())
    want = Counter()
    for r in messy_rows():
        n = len(tok.encode(r[1] or "", add_special_tokens=False).ids)
        want[r[0], len((r[1] or "").encode()), n, n > 100] += 1
    assert by_row(token_count.count_tokens(messy, limit=100), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_count.count_tokens(none).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 2), (64, 8), (300, 20)])
def test_chunks_resynchronise(chunk, overlap):
    r = random.Random(chunk)
    c = token_count.Counter(token_count.vocabulary_path(), chunk, overlap)
    parts = ["a", "é", "é", " ", "\n", "  ", "don't", "123", "<|endoftext|>", "漢字", "X" * 40, "!?", "́", " ", "word", "İ"]
    for _ in range(150):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 200)))
        assert c.count(text) == c.count_long(text) == len(c._ids(text))


def test_memo_is_bounded():
    c = token_count.Counter(token_count.vocabulary_path(), memo=10)
    texts = [f"w{i} v{i} u{i}" for i in range(20)]
    assert [c.count(t) for t in texts] == [len(c._ids(t)) for t in texts] and len(c.memo) <= 10


# --- op2 ---

def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 7, 100, 4097):
        assert sorted(token_shards.permute(np.arange(n), n)) == list(range(n))
    assert list(token_shards.permute(np.arange(100), 100, 1)) != list(token_shards.permute(np.arange(100), 100, 2))


def test_encoder_equals_whole_encoding():
    e, r = token_shards.Encoder(), random.Random(2)
    parts = ["a", "B", "'s", "'ll", " ", " ", "\n", "!", "é", "  ", " ", "漢", "9", "\0", "word"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(3000)] + [None, "", "x" * 99]
    for some in (texts, texts[:1], [], [t for t in texts if t and t.isalnum()]):
        ids, sizes = e.encode(pa.array(some, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == [e.bpe.encode_ordinary(t or "") for t in some]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    assert pa.Table.from_batches(token_shards.slices(batch, 0, 20)).column(0).to_pylist() == texts


def test_shards_round_trip(messy, none, tmp_path):
    rows, folder = token_shards.write_shards(messy, f"file://{tmp_path}/out", length=32, shard_size=50)
    e = token_shards.encoder_for(token_shards.VOCABULARY)
    docs = Counter((r[0], (r[1] or "")) for r in messy_rows())
    reader = token_shards.ShardReader(folder)
    records = list(reader.records())
    assert [s for s, *_ in records] == list(range(reader.manifest["sequences"])) == sorted(r.slot for r in rows.collect())
    want = Counter()
    for (doc_id, text), n in docs.items():
        data = e.bpe.encode_ordinary(text) + [e.end]
        for k in range(0, len(data), 32):
            want[doc_id, k // 32, tuple(data[k : k + 32])] += n
    assert Counter((d, q, tuple(t.tolist())) for _, d, q, t in records) == want
    assert [x[:3] for x in reader.records(117, 160)] == [x[:3] for x in records[117:160]]
    index = {r.slot: r for r in rows.collect()}
    for k in (0, 49, 50, len(records) - 1):
        data = (tmp_path / "out" / token_shards.shard_name(index[k].shard)).read_bytes()
        assert xxhash.xxh64_hexdigest(data[index[k].byte_offset :][: reader.manifest["stride"]]) == index[k].record_xxh64
    empty, folder = token_shards.write_shards(none, f"file://{tmp_path}/none")
    assert empty.count() == 0 and list(token_shards.ShardReader(folder).records()) == []


def shard_bytes(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir() if p.name.endswith(".bin") and not p.name.startswith(".")}


def test_shards_resume(messy, tmp_path):
    """A shard that was lost is written again, with the same bytes, however the rows lie; whole ones
    are left alone. Shards of another key, other documents or another size are replaced."""
    at, small = tmp_path / "out", {"length": 32, "shard_size": 50}
    rows, folder = token_shards.write_shards(messy.coalesce(1), f"file://{at}", **small)
    before, first, index = shard_bytes(at), rows.orderBy("slot").collect(), {p.name: p.stat().st_ino for p in at.iterdir()}
    (at / token_shards.shard_name(1)).unlink()
    (at / ".shard-00000001.bin.unfinished").write_bytes(b"x")
    (at / token_shards.shard_name(2)).write_bytes(b"\0" * len(before[token_shards.shard_name(2)]))
    again, _ = token_shards.write_shards(messy.repartition(5), folder, **small)
    assert shard_bytes(at) == before and again.orderBy("slot").collect() == first
    assert (at / token_shards.shard_name(0)).stat().st_ino == index[token_shards.shard_name(0)] and not list(at.glob(".shard*.unfinished"))
    for docs, more in ((messy, {"key": 7}), (messy.where("doc_id % 3 > 0"), {}), (messy, {"shard_size": 90})):
        rows, _ = token_shards.write_shards(docs, folder, **(small | more))
        fresh, _ = token_shards.write_shards(docs, f"file://{tmp_path}/fresh{len(list(tmp_path.iterdir()))}", **(small | more))
        assert rows.orderBy("slot").collect() == fresh.orderBy("slot").collect()
        assert shard_bytes(at) == shard_bytes(max(tmp_path.glob("fresh*"), key=lambda p: p.stat().st_mtime)) != before
        held = Counter((d, q) for _, d, q, _ in token_shards.ShardReader(folder).records())
        assert held == Counter((r.doc_id, r.seq) for r in rows.collect())


# --- op3 ---

def test_lm_scores(spark, messy, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    rows, v = messy_rows(), lm_score.VOCABULARY
    texts = [r[1] or "" for r in rows]
    counts = Counter("".join(texts))
    vocab = {c: i + 2 for i, c in enumerate(sorted(counts, key=lambda c: (-counts[c], ord(c)))[: v - 2])}
    good = {i for i in range(40) if i % 2} | {0}

    def model(chosen):
        n1, n2, n3 = Counter(), defaultdict(Counter), defaultdict(Counter)
        for t in chosen:
            ids = [0, 0, *(vocab.get(c, 1) for c in t)]
            for a, b, c in zip(ids, ids[1:], ids[2:], strict=False):
                n1[c] += 1
                n2[b][c] += 1
                n3[a, b][c] += 1
        total = sum(n1.values())

        def loss(t):
            ids, out = [0, 0, *(vocab.get(c, 1) for c in t)], 0.0
            for a, b, c in zip(ids, ids[1:], ids[2:], strict=False):
                p = (n1[c] + 1) / (total + v)
                for held in (n2[b], n3[a, b]):
                    if held:
                        p = (held[c] + len(held) * p) / (sum(held.values()) + len(held))
                out -= math.log(p)
            return out / len(t) if t else 0.0

        return loss

    target, background = model([t for r, t in zip(rows, texts, strict=True) if r[0] in good]), model(texts)
    got = sorted(((r.n_tokens, r.target_loss, r.background_loss, r.score) for r in lm_score.score_documents(messy, labels).collect()))
    want = sorted((len(t), target(t), background(t), target(t) - background(t)) for t in texts)
    assert np.allclose(np.array(got), np.array(want), atol=1e-5)
    assert lm_score.score_documents(none, labels).count() == 0


def test_lm_vocabulary_grows_with_the_corpus(spark):
    """Documents in code points beyond the most frequent ones are scored by what they say."""
    r = random.Random(8)
    han = lambda at: "".join(chr(0x4E00 + at + r.randrange(200)) for _ in range(150))
    texts = ["".join(chr(33 + r.randrange(300)) for _ in range(400)) for _ in range(40)] + [han(0) for _ in range(20)] + [han(1000) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40, 50)], "doc_id long, quality int, toxic int")
    score = {x.doc_id: x.score for x in lm_score.score_documents(docs, labels).collect()}
    assert max(score[i] for i in range(50, 60)) < min(score[i] for i in range(60, 80)) - 0.5


# --- op5 ---

def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Water-filling by rounds: clamp what is above its cap, deal out the rest by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, rest = {}, set(order), sum(sizes.values())
    while free:
        level = rest / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] >= most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            rest -= most * sizes[s]
        free -= over
    return out


def test_mixing(messy, none):
    got = mixing.mix(messy).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in messy_rows():
        sizes[r[3]] += size(r[1])
    want = brute_targets(sizes)
    taken, largest = Counter(), Counter()
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((r[0], size(r[1]), r[3]) for r in messy_rows())
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)
    columns = ("doc_id", "size", "target", "copies")
    assert by_row(mixing.mix(messy.repartition(7)), *columns) == by_row(mixing.mix(messy), *columns)
    assert mixing.mix(none).count() == 0


def test_mixing_edge_selection_is_exact(spark):
    """Many documents of a source: the selection equals a plain sort by hash."""
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), "ab"[i % 3 == 0]) for i in range(4000)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for s in "ab":
        own = sorted((r for r in got.values() if r.source == s), key=lambda r: (r.h, r.doc_id))
        whole = int(own[0].target // own[0].source_size)
        goal, upto = own[0].target - whole * own[0].source_size, 0
        for r in own:
            upto += r.size
            assert r.copies == whole + (upto - r.size / 2 <= goal)


def test_mixed_rows(messy):
    plan, out = mixing.mix(messy), mixing.mixed(messy)
    want = Counter()
    for r in plan.collect():
        want[r.doc_id, r.size] += r.copies
    got = Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in out.collect())
    assert got == +want and out.columns == messy.columns


def test_mixed_rows_follow_their_own_source(spark, none):
    """Equal texts without id in several sources, and rows that differ in other columns only."""
    rows = [(None, "same text here", s, k) for s, n in (("a", 1), ("b", 1), ("c", 4), (None, 2)) for k in range(n)]
    rows += [(i, "w " * (i % 9 + 1), "abc"[i % 3] if i % 20 else None, 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    for weights, epochs in (((1, 2, 30), 7),):
        want = Counter()
        for r in mixing.mix(docs, weights, epochs).collect():
            want[r.doc_id, r.source, r.size] += r.copies
        runs = [Counter(map(tuple, mixing.mixed(docs.repartition(n), weights, epochs).collect())) for n in (1, 6)]
        assert runs[0] == runs[1]
        got = Counter()
        for (i, t, s, _), n in runs[0].items():
            got[i, s, len(t.split())] += n
        assert got == +want and len({n for (i, _, s, _), n in runs[0].items() if i is None}) > 1
    assert mixing.mixed(none).count() == 0 and mixing.mixed(none).columns == none.columns


# --- op8 ---

def brute_contamination(text, items):
    """Every window of every item's size, compared in full."""
    ws, out = decontam.normalised(text), {}
    for item, t in items:
        own = decontam.normalised(t)
        if len(own) < 5:
            if own and any(ws[i : i + len(own)] == own for i in range(len(ws))):
                out[item] = 1.0
            continue
        a = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
        n = min(len(own), len(ws))
        for s in range(len(ws) - n + 1):
            b = Counter(tuple(ws[s + i : s + i + 5]) for i in range(n - 4))
            shared = sum((a & b).values())
            sim = shared / (sum(a.values()) + sum(b.values()) - shared) if b else 0
            if sim >= 0.8:
                out[item] = max(out.get(item, 0), sim)
    return out


def test_decontamination(spark, messy, none):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(15, 40)))) for i in range(20)] + [(50, "just two"), (51, ""), (52, "a a a a a a a a a a a a")]
    docs = []
    for i in range(60):
        filler = lambda: [r.choice(vocab) for _ in range(r.randrange(40))]
        body = items[i % 20][1].split()
        for _ in range(i // 20):  # none, one or two words changed
            body[r.randrange(len(body))] = "changed"
        text = " ".join(filler() + ([w.upper() + "!" for w in body] if i % 3 else []) + filler())
        docs.append((i, text))
    docs += [(100, "Just, two."), (101, "not just two"), (102, None), (103, "a " * 50), (None, items[3][1]), (0, docs[0][1])]
    frame = spark.createDataFrame([(i, t, *[None] * 11) for i, t in docs], SCHEMA)
    bench = spark.createDataFrame([*items, items[0], (None, items[1][1]), (60, None)], "item_id long, text string")
    got = Counter((x.doc_id, tuple(x.item_ids), round(x.similarity, 9)) for x in decontam.report(frame, bench).collect())
    want = Counter()
    for i, t in docs:
        found = brute_contamination(t, items)
        want[i, tuple(sorted(found)), round(max(found.values(), default=0.0), 9)] += 1
    assert got == want and sum(bool(k[1]) for k in want) > 10
    clean = decontam.clean(frame, bench)
    assert clean.columns == frame.columns and clean.count() == sum(n for k, n in want.items() if not k[1])
    blocks = decontam.contamination(frame, bench, block_bytes=500)
    assert blocks.count() == decontam.contamination(frame, bench).count()
    assert decontam.report(none, bench).count() == 0 and not any(x.contaminated for x in decontam.report(messy, bench.limit(0)).collect())


def test_items_without_id_are_looked_for(spark):
    item, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "uv")
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, f"only {other}"), (3, "nothing " * 20), (4, "two words")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (7, other), (None, "two words")], "item_id long, text string")
    assert [x.doc_id for x in decontam.clean(docs, bench).collect()] == [3]
    got = {x.doc_id: (x.n_items, x.item_ids, x.contaminated) for x in decontam.report(docs, bench).collect()}
    assert got == {1: (0, [], True), 2: (1, [7], True), 3: (0, [], False), 4: (0, [], True)}


def test_decontamination_finds_reordered_passages(monkeypatch):
    """The best window of an item with its halves swapped is aligned to no shingle."""
    r = random.Random(11)
    vocab, items, texts = [f"w{i}" for i in range(3000)], [], []
    for i in range(30):
        body = [r.choice(vocab) for _ in range(r.choice([60, 100, 200]))]
        items.append((i, " ".join(body)))
        at = r.randrange(20, len(body) - 20) if i % 2 else len(body) // 2
        filler = [r.choice(vocab) for _ in range(60)]
        texts.append(" ".join(filler + body[at:] + body[:at] + filler))
        texts.append(" ".join(filler + body[: at - 2] + ["more", "words"] + body[at:] + filler))
    items += [(95, "just Four words, here"), (96, "w1"), (97, "..."), (98, None)]
    texts += ["before it just four words here after", "just four", "w1", "w1 w2 w3 w4 w5 w6", "no item", ""]
    texts += ["the same words again " * 200, items[0][1] + " " + items[1][1]]
    items += [(90, "the same words again the same words again the same words"), (91, items[0][1] + " " + items[0][1])]
    index = decontam.ItemIndex(items)
    want = [brute_contamination(t, items) for t in texts]
    got = [index.matches(t) for t in texts]
    assert [set(x) for x in got] == [set(x) for x in want] and sum(map(bool, want)) > 50
    assert all(abs(g[k] - w[k]) < 1e-9 for g, w in zip(got, want, strict=True) for k in w)
    with monkeypatch.context() as m:  # a shingle that all items share, counted in small steps
        m.setattr(decontam, "MEETINGS", 7)
        shared = decontam.ItemIndex([(i, f"{items[0][1]} {i}") for i in range(50)])
        assert set(shared.matches(texts[0] + " " + items[0][1])) == set(range(50))


def test_multi_index_finds_all_within_radius():
    r = random.Random(4)
    index = decontam.ItemIndex([(i, " ".join(r.choice("abcdefgh") for _ in range(30))) for i in range(200)])
    for _ in range(100):
        fp = int(index.prints[r.randrange(200)])
        for b in r.sample(range(64), r.randrange(30)):
            fp ^= 1 << b
        want = np.flatnonzero(np.bitwise_count(index.prints ^ np.uint64(fp)) <= 23)
        assert list(index.within(fp)) == list(want)


# --- op9 ---

def brute_lines(rows, least=1, docs=10):
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    lines = [(r[1] or "").split("\n") for r in rows]
    df = Counter(k for ls in lines for k in {key(x) for x in ls} if len(k) >= least)
    out = Counter()
    for r, ls in zip(rows, lines, strict=True):
        keep = [x for x in ls if df[key(x)] < docs]
        out[r[0], len(ls), len(ls) - len(keep), "\n".join(keep)] += 1
    return out


@pytest.mark.parametrize(("batches", "docs"), [(1, 10), (4, 10), (7, 3), (3, 1)])
def test_line_dedup(messy, batches, docs):
    got = by_row(line_dedup.dedup_lines(messy, min_docs=docs, batches=batches), "doc_id", "n_lines", "n_dropped", "kept")
    assert got == brute_lines(messy_rows(), docs=docs)


def test_line_dedup_empty(none):
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_is_native(messy):
    rows = line_dedup.dedup_lines(messy)
    assert not re.search("Python|Arrow|Pandas", rows._jdf.queryExecution().toString())
    assert not re.search("Python|Arrow|Pandas", mixing.mix(messy)._jdf.queryExecution().toString())


# --- op10 ---

def test_quality(spark, none):
    r = random.Random(8)
    good = lambda: (words(r, r.randrange(20, 200)) + ".").replace(" gamma", ". The gamma")
    bad = lambda: " ".join(w.upper() + r.choice(["!!", "***", "###"]) for w in words(r, r.randrange(20, 200)).split())
    rows = [(i, good() if i % 4 else bad()) for i in range(600)] + [(None, good()), (900, None), (901, ""), (5, good())]
    docs = spark.createDataFrame([(i, t, *[None] * 11) for i, t in rows], SCHEMA)
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0, None) for i in range(600)] + [(None, 1, 0), (7, None, None), (8, 5, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs, labels).collect()
    import zlib

    assert len(got) == len(rows) and all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    held = [x for x in got if x.held_out and x.doc_id < 600]
    assert sum(x.predicted == (1 if x.doc_id % 4 else 0) for x in held) / len(held) > 0.97
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(x.predicted for x in got)
    assert quality.score_documents(none, labels).count() == 0
    assert {x.score for x in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_discriminant_restated():
    """Log-odds against log-densities written out with determinants and inverses."""
    r, d = np.random.default_rng(6), len(quality.FEATURES)
    x = [r.normal(size=(n, d)) @ r.normal(size=(d, d)) + r.normal(size=d) for n in (50, 90)]
    one = [np.concatenate((np.ones((len(y), 1)), y), axis=1) for y in x]
    model, at = quality.fit({k: y.T @ y for k, y in enumerate(one)}), r.normal(size=(20, d))
    pooled = sum((y - y.mean(0)).T @ (y - y.mean(0)) for y in x) / (140 - 2)
    logs = []
    for y in x:
        c = (1 - quality.TO_POOLED) * np.cov(y.T) + quality.TO_POOLED * pooled
        c = (1 - quality.TO_SPHERE) * c + quality.TO_SPHERE * np.diag(np.diag(pooled))
        z = at - y.mean(0)
        logs.append(np.log((len(y) + 1) / 142) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z))
    assert np.allclose(model.log_odds(at), logs[1] - logs[0])


def test_classifier_and_decontamination_of_empty_tables(spark, none):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "some item of a benchmark here")], "item_id long, text string")
    for out in (quality.accepted(none, labels), decontam.clean(none, items), simhash.deduplicate(none)):
        assert out.columns == none.columns and out.count() == 0


def test_training_ignores_held_out_labels(spark):
    """Wrong labels on the held-out fold change no score."""
    import zlib

    docs = spark.createDataFrame([(i, "Some plain words here." if i % 2 else "LOUD!! ### TEXT***") for i in range(60)], "doc_id long, text string")
    label = lambda flip: spark.createDataFrame([(i, (i % 2) ^ (flip and zlib.crc32(str(i).encode()) % 3 == 1)) for i in range(60)], "doc_id long, quality int")
    a, b = (sorted((x.doc_id, round(x.score, 9)) for x in quality.score_documents(docs, label(f)).collect()) for f in (False, True))
    assert a == b


# --- op1 ---

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in re.findall("[0-9]+", m.group())), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_the_patterns():
    r = random.Random(6)
    parts = ["a", "B.", "@", "x@y.zz", "1", "12", "255", "256", ".", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "10.0.0.1", "+49 30 1234567", "é", "%", "_", "\n", "4111-1111-1111-1111"]
    for _ in range(6000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(16)))
        assert pii.base_spans(text) == brute_base(text), text


def test_base_spans_are_linear():
    import time

    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "a@" * 100_000, "@" * 200_000):
        pii.base_spans(text)
    assert time.time() - began < 20


@pytest.fixture(scope="module")
def tagger():
    return {}  # as in production; trained once


def test_crf_against_all_paths():
    """Likelihood and best path of short windows against every sequence of tags."""
    t, r = pii.Tagger(5), np.random.default_rng(3)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    t.p["trans"] += r.normal(size=t.p["trans"].shape)
    ids = np.stack([pii.char_ids(x) for x in ("a@b1", "+4 9", "ab.c")])
    e, trans = t.emissions(ids), t.p["trans"] + pii.allowed()
    paths = np.array(list(itertools.product(range(pii.TAGS), repeat=4)))
    score = np.stack([sum(e[k, w, paths[:, k]] for k in range(4)) + sum(trans[paths[:, k], paths[:, k + 1]] for k in range(3)) for w in range(3)])
    tags, lead = t.decode(ids)
    assert np.array_equal(tags, paths[score.argmax(axis=1)])
    assert np.allclose(lead, [[e[k, w, tags[w, k]] - e[k, w, 0] for k in range(4)] for w in range(3)])
    gold = np.array([[0, 1, 2, 0], [3, 4, 4, 0], [0, 0, 5, 6]])
    own = [score[w][(paths == g).all(axis=1)][0] for w, g in enumerate(gold)]
    top = score.max(axis=1)
    assert math.isclose(t.loss(ids, gold)[0], np.mean(top + np.log(np.exp(score - top[:, None]).sum(axis=1)) - own), rel_tol=1e-9)


def test_gradients():
    t = pii.Tagger(2)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    ids, tags = pii.tag_matrix(*pii.labelled(3, 1))
    _, g = t.loss(ids, tags)
    r = np.random.default_rng(0)
    for name, v in t.p.items():
        at = (int(ids[0, 5]), 3) if name == "emb" else tuple(r.integers(0, s) for s in v.shape)
        was, slope = v[at], []
        for step in (1e-5, -1e-5):
            v[at] = was + step
            slope.append(t.loss(ids, tags)[0])
        v[at] = was
        assert math.isclose(g[name][at], (slope[0] - slope[1]) / 2e-5, rel_tol=1e-3, abs_tol=1e-5), name


def test_pii(spark, messy, none, tagger):
    extra = ["write jane.doe (at) thonre (dot) com please", "call (555) 010-4477 or 030-555-0199 now", "plain text without any", "on 2024-01-02 at 12:30 for 45.20", "mail bob@example.com 10.2.3.4 4111 1111 1111 1111 +49 30 1234567"]
    docs = messy.unionByName(spark.createDataFrame([(1000 + i, t, *[None] * 11) for i, t in enumerate(extra)], SCHEMA))
    got = pii.find_pii(docs, **tagger).collect()
    texts = Counter((r[0], r[1]) for r in messy_rows()) + Counter((1000 + i, t) for i, t in enumerate(extra))
    want = Counter()
    for (i, t), n in texts.items():
        base = brute_base(t)
        want[(i, *(sum(s[2] == k for s in base) for k in range(4)), hashlib.sha256(pii.joined(base).encode()).hexdigest())] += n
    assert Counter((x.doc_id, x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) for x in got) == want
    spans = {x.doc_id: x.spans for x in got}
    assert spans[1002] == spans[1003] == "" and "phone:5:19" in spans[1001] and spans[1000].startswith("email:6:")
    for i, t in enumerate(extra):
        assert set(filter(None, pii.joined(brute_base(t)).split(","))) <= set(spans[1000 + i].split(","))
    assert pii.find_pii(none, **tagger).count() == 0


def test_tagger_generalises(tagger):
    ids, tags = pii.tag_matrix(*pii.labelled(300, 4242))
    got, _ = pii.trained(**tagger).decode(ids)
    assert (got == tags)[tags > 0].mean() > 0.85 and (got[tags == 0] > 0).mean() < 0.05


def test_windows_are_reconciled():
    """A span over the edges of windows comes out once and whole."""
    text = "x" * 20 + " 4111.1111.1111.1111 " + "y" * 50
    pieces = [(21, 32, 2, 5.0, False, True), (21, 40, 2, 9.0, False, False), (32, 40, 2, 4.0, True, False)]
    assert pii.reconcile(text, pieces, []) == [(21, 40, 2)]
    assert pii.reconcile(text, [(21, 33, 2, 5.0, False, True), (30, 40, 2, 4.0, True, False)], []) == [(21, 40, 2)]
    assert pii.reconcile(text, pieces, [(25, 30, 1)]) == []
