"""Each operator against its plain version, on a fixture of awkward rows and on an empty table."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from brute import components, contaminated, crc, ids, repeats, simhash, token_planes

from paperloom.llm import bitplanes, exact_dedup, language, packing, quality, secrets, simhash as sh, tokens, url_lists, winnow
from paperloom.llm import repeats as rp
from paperloom.llm.tokens import vocabulary

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, id string, h long, __rn int"


def _texts():
    rng = random.Random(5)
    words = ["the", "of", "Straße", "naïve", "alpha", "beta", "gamma", "delta", "été", "x9", "日本", "omega,"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(24)]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(9000))
    passage = "a passage of well over one hundred bytes that several of the documents share word for word, é and all"
    out += [out[0], out[0], out[1] + " end", long, long + ".", out[2] + " " + passage, passage + "\n" + out[3], out[4] + passage + out[5]]
    out += ["", "  \n\t ", "one", "a a a a a a a a a a a a a a a a a a a a " * 20, "tab\tand\x00nul\x1c  two blanks ", "x" * 300]
    return out


@pytest.fixture(scope="module")
def rows():
    texts = [(i * 3 % 101 + i, t) for i, t in enumerate(_texts())]
    return [(900, None), *texts]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, None if d % 2 else "en", "s", "clash", 1, 2) for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _sorted(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def _block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))


@pytest.mark.parametrize("kept", [900_000, 40])
def test_tokens_of_awkward_texts(monkeypatch, kept):
    """Equal to the plain library, strings of special tokens included, however few pieces are kept."""
    monkeypatch.setattr(tokens, "KEPT", kept)
    rng = random.Random(1)
    marks = [" ", "  ", "\n", "\t", "a", "B", "é", ".", ",", "'s", "9", "12", "\0", "\x1c", "\u3000", "\u00a0", "\u0085", "日", "e\u0301", "\u0338", "<|endoftext|>", "<|startoftext|>", "<|", "\r", "|", "Σ", "İ", "×", "ß", "—", "the", "Word"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + ["x" * 5000, "ab " * 3000]
    for path in (WORD, BYTE):
        encode, end = tokens.Encoder(path).block, 7
        for lo in range(0, len(texts), 100):
            got, cuts = encode(*_block(texts[lo : lo + 100]), end)
            assert [got[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [x + [end] for x in ids(texts[lo : lo + 100], path)]
    plain = tokens.Encoder(BYTE, specials=False).block(*_block(["a<|endoftext|>"]))[0].tolist()
    assert 50256 not in plain and 50256 in tokens.Encoder(BYTE).block(*_block(["a<|endoftext|>"]))[0]


def test_planes_round_trip():
    x = np.random.default_rng(1).integers(0, 2**32, 4097).astype("<u4")
    for bits in (False, True):
        assert (bitplanes.from_planes(bitplanes.to_planes(x, bits), len(x)) == x).all()
    assert len(bitplanes.from_planes(bitplanes.to_planes(x[:0]), 0)) == 0


def test_token_planes(docs, empty, rows):
    got = _sorted(bitplanes.round_trip(docs, WORD, 2, shard_ids=5000), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == sorted(token_planes([(d, t or "") for d, t in rows], WORD, 2))
    assert bitplanes.round_trip(empty, WORD, 2).count() == 0


def test_token_planes_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(5, "b"), (5, "a"), (None, "c"), (5, "a")], "doc_id long, text string")
    got = bitplanes.round_trip(df, WORD, 2, bits=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 5, 5, 5] and got[1].ids_crc32 == got[2].ids_crc32 != got[3].ids_crc32


def test_packing(docs, empty, rows):
    pieces = packing.pack(docs, BYTE, 0, size=64, open_windows=4).collect()
    whole = {d: x + [0] for (d, _), x in zip(rows, ids([t for _, t in rows], BYTE))}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for d, x in whole.items():
        at = 0
        for p in sorted(by_doc.pop(d), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(x) and zlib.crc32(p.ids) == crc(x[at : at + p.length])
            at += p.length
        assert at == len(x)
    assert not by_doc
    for s in by_sequence.values():
        assert [p.offset for p in sorted(s, key=lambda p: p.offset)] == list(np.cumsum([0] + [p.length for p in sorted(s, key=lambda p: p.offset)])[:-1])
        assert sum(p.length for p in s) <= 64
    assert sum(sum(p.length for p in s) < 64 for s in by_sequence.values()) <= 1
    assert packing.pack(empty, BYTE, 0).count() == 0


def test_simhash(docs, empty, rows):
    fps = {d: simhash(t) for d, t in rows}
    expected = components(fps)
    got = sh.near_duplicates(docs).collect()
    assert {r.id: r.fp % 2**64 for r in got} == fps
    assert {r.id: r.component for r in got} == expected
    assert sh.near_duplicates(empty).count() == 0


def _signed(x):
    return x - 2**64 if x >= 2**63 else x


def _balls():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    fps = [int(b) for b in base]
    for b in base:
        for _ in range(4):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    dense = int(base[0])
    fps += [dense ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)]
    return list(dict.fromkeys(fps))


@pytest.mark.parametrize(("hot", "variants"), [(1 << 18, 2_000_000), (16, 20_000)])
def test_ball_links_keep_every_pair(spark, monkeypatch, hot, variants):
    """Also where prefixes are shared by several tasks, and groups are split."""
    monkeypatch.setattr(sh, "MAX_VARIANTS", variants)
    fps = sorted(map(_signed, _balls()))
    links = sh.ball_links(spark.createDataFrame([(t, x) for x in fps for t in (3, 5)], "t int, fp long"), group=8, hot=hot)
    one, other = ({(r.a, r.b) for r in links.filter(F.col("t") == t).collect()} for t in (3, 5))
    assert one == other and links.filter("t not in (3, 5)").isEmpty()
    links = links.filter("t = 3").drop("t")
    found = {r.node: r.component for r in sh.components(links).collect()}
    number = {x: i for i, x in enumerate(fps)}
    want = components({i: x % 2**64 for x, i in number.items()})
    assert {number[x]: number[found.get(x, x)] for x in fps} == want


def test_links_are_few_in_dense_groups():
    fp = np.sort(np.array(_balls(), np.uint64))
    left, free = np.full(len(fp), 2), list(range(64))
    pairs = sum(len(a) for a, _ in sh._meetings(fp, left, free))
    for nearest in (False, True):
        a, b = sh._links(fp, left, free, 4, nearest)
        assert len(a) < len(fp) < pairs and len(set(b.tolist())) == len(b)
        assert not nearest or (np.bitwise_count(a ^ b) <= 4).all()


def test_near_duplicates_of_many_copies_and_null_ids(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    same = " ".join(words)
    rows = [(i, same) for i in range(2000)] + [(5000, None), (4999, " "), (7, "a b c d e f"), (7, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sh.near_duplicates(df).collect()
    assert len(got) == len(rows) and {r.component for r in got if r.id < 2000 and r.id != 7} == {0} and {r.component for r in got if r.id > 2000} == {4999}
    links = sh.ball_links(sh.fingerprints(df).select(F.lit(0).alias("t"), "fp").distinct())
    assert links.count() <= 3
    # a row without an id joins the two beside it
    def flipped(x, bits):
        return _signed(x ^ sum(1 << b for b in bits))

    x = rng.getrandbits(64)
    fps = spark.createDataFrame([(1, _signed(x)), (None, flipped(x, [1, 2, 3, 4])), (2, flipped(x, range(1, 9))), (None, flipped(x, range(20, 40)))], "id long, fp long")
    from unittest.mock import patch

    with patch.object(sh, "fingerprints", lambda *a: fps):
        assert sorted((r.id or 0, r.component or 0) for r in sh.near_duplicates(df).collect()) == [(0, 0), (0, 1), (1, 1), (2, 1)]


def test_similar_groups(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(150)] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base[:6]:
        c = list(b)
        c[rng.randint(0, 149)] = "changed"
        texts.append(" ".join(c))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in sh.keep_one(df).collect()) == list(range(12))


def _linked(texts, similarity=0.8, shingle=5):
    """The smallest number that each text reaches over all pairs of ``similarity``, of those that reach a smaller one; and the pairs."""
    sets = [{tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set() for w in (t.split() for t in texts)]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    root = list(range(len(sets)))
    for _ in texts:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return {i: r for i, r in enumerate(root) if r < i}, pairs


def test_marks_never_rule_out_what_is_shared():
    rng = np.random.default_rng(8)
    for n, m, both in ((0, 0, 0), (5, 5, 5), (400, 420, 380), (3000, 3600, 2900), (900, 1100, 0), (70_000, 80_000, 69_000)):
        shared, x, y = (rng.integers(0, 2**64, k, np.uint64) for k in (both, n - both, m - both))
        most = sh._most_shared(sh._marks(np.append(shared, x)), sh._marks(np.append(shared, y)), n, m)
        assert both <= most <= min(n, m) and (both or most < 0.75 * min(n, m) or not n)


def test_similar_groups_are_complete(spark):
    rng = random.Random(19)
    texts = []
    for i in range(60):  # appended, cut and inserted text of new words at a similarity of 0.80 to 0.85
        n = 200 + i
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
        more = [f"n{rng.randint(0, 10**6)}" for _ in range(int((n - 4) * (0.17 + 0.07 * (i % 10) / 10)))]
        texts += [" ".join(base), " ".join([base + more, base[: n - int((n - 4) * (0.15 + 0.05 * (i % 10) / 10))], base[: n // 2] + more[4:] + base[n // 2 :]][i % 3])]
    texts += ["", "  ", "one", "one", "a b c d e", "a b c d e f"]
    want, pairs = _linked(texts)
    assert sum(a % 2 == 1 and b == a - 1 for a, b in pairs) >= 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.node: r.component for r in sh.similar_groups(df).collect()} == want


def test_similar_groups_in_crowds(spark):
    rng = random.Random(29)
    words, shared = [f"w{i}" for i in range(120)], [f"s{i}" for i in range(100)]
    decoys = [" ".join(rng.sample(words, 120)) for _ in range(1500)]  # equal word sets, other shingles
    near = [" ".join(d.split()[60 + i :] + d.split()[: 60 + i]) for i, d in enumerate(decoys[:20])]
    copies = [" ".join([*shared, f"c{i}"]) for i in range(200)]  # one crowd of near copies
    mixed = [" ".join(shared[:40] + [f"m{i // 2}_{j}" for j in range(10 + 2 * (i % 2))]) for i in range(60)]  # pairs that share much
    texts = decoys + near + copies + mixed
    order = rng.sample(range(len(texts)), len(texts))
    texts = [texts[i] for i in order]
    want, _ = _linked(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.node: r.component for r in sh.similar_groups(df, tables=2, crowd=16).collect()} == want
    grams = sh.prefix_grams(df, "doc_id", "text", 5, sh.frequent_grams(df, "doc_id", "text", 5), 0.8).withColumn("component", F.col("id")).filter(F.col("id").isin([i for i, k in enumerate(order) if 1520 <= k < 1720]))
    assert sh.prefix_pairs(grams, 0.8, crowd=16).filter("b is not null").count() < 200 * 25 < sh.prefix_pairs(grams, 0.8).count()


def test_words_within_classes_fit_large_counts():
    rng = np.random.default_rng(3)
    words, width = 560, language.CLASSES + 1
    share = rng.dirichlet(np.full(words, 0.05), width)
    share = 0.5 * share + 0.5 * share.mean(0)
    for times in (10**3, 10**6):  # a thousand times the text must not fit worse than the words' own shares
        pairs = np.round(share * times)
        cls = np.arange(words) % language.CLUSTERS
        m = language.Model(np.arange(words, dtype=np.uint64), cls, None, None, np.zeros((width, language.WORDS), np.float32), None)
        language._fit_inside(m, pairs, pairs.sum(0))
        log_share = np.log(pairs.sum(0) + 1)
        log_share -= np.log(np.bincount(cls, np.exp(log_share)))[cls]
        assert (pairs * m.inside[:, :words]).sum() > (pairs * log_share).sum()


def test_winnowing(spark, docs, empty, rows):
    rng = random.Random(3)
    pool = [t.split() for _, t in rows if t and len(t.split()) > 30]
    items = [(i, " ".join(w[5 : 5 + n])) for i, (w, n) in enumerate((rng.choice(pool), n) for n in (13, 14, 20, 25, 5, 1, 3, 12))]
    items += [(50, ""), (51, None), (52, "nothing of this occurs anywhere in any of the other texts at all really"), (0, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(contaminated(rows, items))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert _sorted(winnow.contaminated(docs, bench), *columns) == expected
    assert _sorted(winnow.contaminated(docs, bench, block=40), *columns) == expected  # several passes
    kept = sorted(e[0] for e in expected if not e[-1])
    for block in (winnow.BLOCK, 40):
        clean = winnow.clean(docs, bench, block=block)
        assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == kept
    assert winnow.contaminated(empty, bench).count() == 0
    assert winnow.contaminated(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_quality(spark, docs, empty):
    good = [(i, " ".join(random.Random(i).choices(["calm", "river", "stone", "light"], k=40))) for i in range(120)]
    bad = [(i, " ".join(random.Random(i).choices(["BUY!!", "NOW!!", "$$$"], k=40))) for i in range(120, 240)]
    df = spark.createDataFrame(good + bad + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)] + [(1, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(df, labels, where=quality.fold_of("doc_id", 4) != 2)
    got = {r.doc_id: r.p for r in quality.score(df, model, name="p").collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((got[i] >= 0.7) == (i < 120) for i in held)
    assert 0 < got[900] == got[901] < 1
    assert quality.score(empty, model).count() == 0
    nothing = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}


def test_repeats(docs, empty, rows):
    order = sorted((d, t or "") for d, t in rows)
    got = _sorted(rp.without_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(repeats([(d, t.encode()) for d, t in order]))
    assert rp.without_repeats(empty).count() == 0


def test_repeats_of_other_lengths_and_long_texts(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(400)) for _ in range(6)] + ["ab" * 300, "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length, gram in ((12, 4), (40, 8)):
        got = _sorted(rp.without_repeats(df, length=length, gram=gram), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == sorted(repeats([(d, t.encode()) for d, t in enumerate(texts)], length))
    cuts = list(rp._pieces(np.arange(100, dtype=np.uint8), np.array([0, 100]), 10))
    assert len(cuts) == 1
    monkeypatch.setattr(rp, "PIECE", 30)
    cuts = list(rp._pieces(np.arange(100, dtype=np.uint8), np.array([0, 100]), 10))
    assert [len(c[0]) for c in cuts] == [39, 39, 39, 10] and [c[2] for c in cuts] == [0, 30, 60, 90]


def test_repeats_around_a_hot_anchor(spark):
    """One passage in many different surroundings: its anchors' strings are settled one by one, in many shards."""
    rng = random.Random(18)

    def drawn(n):
        return "".join(rng.choice("abcdefghijklmnop qrs") for _ in range(n))

    short, long = drawn(60), drawn(150)
    texts = [drawn(rng.randint(0, 90)) + (short if i % 3 else long) + drawn(rng.randint(0, 90)) for i in range(400)] + [long + "é" + short] * 2 + ["", short]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = sorted(repeats([(d, t.encode()) for d, t in enumerate(texts)]))
    for hot in (rp.HOT, 20, 0):
        assert _sorted(rp.without_repeats(df, hot=hot), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_run_index_matches():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 500).astype(np.uint8)
    index = rp.RunIndex(text)
    neighbour, match = index.matching()
    order = sorted(range(500), key=lambda i: text[i:].tobytes())
    for before, i in zip(order, order[1:]):
        a, b = text[before:].tobytes(), text[i:].tobytes()
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert (neighbour[i], match[i]) == (before, n)
    assert len(index.run_starts) < 500


def test_exact_dedup(spark, docs, empty, rows):
    got = {r.doc_id: r for r in exact_dedup.annotate(docs).collect()}
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    for t, members in groups.items():
        for d in members:
            assert (got[d].keep_id, got[d].group_size, got[d].kept) == (max(members), len(members), d == max(members))
    kept = exact_dedup.keep(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(m) for m in groups.values())
    assert exact_dedup.annotate(empty).count() == 0 and exact_dedup.keep(empty).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None), (2, "b")], "doc_id long, text string")
    assert sorted(r.group_size for r in exact_dedup.annotate(twice).collect()) == [1, 1, 3, 3, 3]
    assert sum(r.kept for r in exact_dedup.annotate(twice).collect()) == 3
    assert exact_dedup.keep(twice).count() == 3


def test_exact_dedup_with_a_large_filter(spark, docs, empty, monkeypatch):
    """The filter is joined by shuffle, and hot slots and groups apart, with the same results."""
    texts = ["hot"] * 300 + [f"t{i // 2}" for i in range(200)] + [f"u{i}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    plain, kept = [_sorted(exact_dedup.annotate(d), *columns) for d in (df, docs)], _sorted(exact_dedup.keep(df), "doc_id")
    monkeypatch.setattr(exact_dedup, "MAX_WORDS", 0)
    monkeypatch.setattr(exact_dedup, "_hot", lambda rows: 50)
    assert [_sorted(exact_dedup.annotate(d), *columns) for d in (df, docs)] == plain
    assert _sorted(exact_dedup.keep(df), "doc_id") == kept and len(kept) == 501
    assert exact_dedup.annotate(empty).count() == 0
    words, bits, few = exact_dedup.repeated_slots(df.select(F.xxhash64("text").alias("h")), "h", len(texts))
    flagged = exact_dedup.maybe_repeated(df.withColumn("h", F.xxhash64("text")), "h", words, bits, few, 50, "again").filter("again").count()
    assert not few and 500 <= flagged <= 520  # only possible repeats go on


def test_language(docs, empty, rows):
    import collections
    import math

    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    words = {d: (t or "").encode().lower().split() + [None] for d, t in rows}
    c = collections.Counter(w for d in words if not held[d] for w in words[d])
    n, v = sum(c.values()), len(c)
    model, counts, tokens, distinct = language.train(docs)
    assert (tokens, distinct) == (n, v)
    for r in language.score(docs, model, counts, tokens, distinct).collect():
        w = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0
    model, counts, tokens, distinct = language.train(empty)
    assert language.score(empty, model, counts, tokens, distinct).count() == 0


def test_language_tail_is_joined(docs, monkeypatch):
    whole = language.score(docs, *language.train(docs)).select("doc_id", "n_known", "base_score").collect()
    monkeypatch.setattr(language, "HEAVY", 8)
    few = {r.doc_id: r for r in language.score(docs, *language.train(docs)).collect()}
    for r in whole:
        assert r.n_known == few[r.doc_id].n_known and abs(r.base_score - few[r.doc_id].base_score) < 1e-6


def test_language_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    w, b = rng.normal(size=(4 * language.FEATURES, language.CLASSES)).astype(np.float32), np.zeros(language.CLASSES, np.float32)
    f = language.contexts(rng.integers(0, 50, 30), np.arange(30))
    assert np.allclose(language._softmax(w, b, f).sum(1), 1, atol=1e-5)


def test_secrets(spark, docs, empty):
    hexes = ["%032x" % random.Random(i).getrandbits(128) for i in range(60)]
    texts = [f"réglage {i} password = \"{h}\" et la suite" for i, h in enumerate(hexes)] + [f"plain words {i} of no concern to anyone here" for i in range(60)]
    texts += [None, "", "AKIA" + "Q" * 14 + " AKIAQ", "Token:abcdefghijkl api_key=short0 APIKEY: 'ABCDEFGHIJKLMN'", "0123456789abcdef0 x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    field = secrets.train(df)
    got = {r.doc_id: [(secrets.KINDS[s.kind], s.start, s.end) for s in r.spans if s.kind < 3] for r in secrets.scan(df, field).collect()}
    assert got[0] == [("assign", 10, 10 + len('password = "') + 32), ("hex", 10 + len('password = "'), 10 + len('password = "') + 32)]
    n = len(texts)
    assert got[n - 5] == got[n - 4] == [] and got[n - 3] == [("access", 0, 18)]
    assert [s[0] for s in got[n - 2]] == ["assign", "assign"] and got[n - 1] == [("hex", 0, 17)]
    assert secrets.scan(empty, secrets.train(empty)).count() == 0


def _best(f, e):
    best, back = f.start + e[0], []
    for x in e[1:]:
        step = best[:, None] + f.moves
        back.append(step.argmax(0))
        best = step.max(0) + x
    label = [int(best.argmax())]
    for b in back[::-1]:
        label.append(int(b[label[-1]]))
    return label[::-1]


@pytest.mark.parametrize(("long", "together"), [(512, 1 << 14), (3, 2)])
def test_field_decodes_exactly(monkeypatch, long, together):
    """Also where very long runs are decoded apart, and few runs at once."""
    monkeypatch.setattr(secrets, "LONG", long)
    monkeypatch.setattr(secrets, "TOGETHER", together)
    rng = np.random.default_rng(6)
    f = secrets.Field([np.zeros((n, 3)) for n in secrets.TABLES], rng.normal(size=(3, 3)), rng.normal(size=3))
    f.moves[0, 2] = f.start[2] = -1e4
    e = rng.normal(size=(400, 3)) * 3 + np.array([4, 0, 0])
    doc = np.sort(rng.integers(0, 12, 400))
    got = f.decode(e, doc)
    for d in range(12):
        at = np.flatnonzero(doc == d)
        assert got[at].tolist() == _best(f, e[at])


def test_field_gradient(monkeypatch):
    """One step of training follows the derivative of the log-likelihood, found by differences over all paths."""
    import itertools

    monkeypatch.setattr(secrets, "ROUNDS", 1)
    monkeypatch.setattr(secrets, "TABLES", (4, 3))
    rng = np.random.default_rng(1)
    windows = [(np.stack([rng.integers(0, 4, n), rng.integers(0, 3, n)]), np.array(y)) for n, y in ((4, [0, 1, 2, 0]), (3, [1, 2, 2]), (2, [0, 0]))]

    def loss(f):
        total = 0.0
        for x, y in windows:
            e = f.emissions(list(x))
            paths = [f.start[p[0]] + e[0, p[0]] + sum(f.moves[a, b] + e[t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:]))) for p in itertools.product(range(3), repeat=len(y))]
            own = f.start[y[0]] + e[0, y[0]] + sum(f.moves[a, b] + e[t + 1, b] for t, (a, b) in enumerate(zip(y, y[1:])))
            total += np.log(np.exp(np.array(paths)).sum()) - own
        return total

    zero = secrets.Field([np.zeros((n, 3)) for n in (4, 3)], np.zeros((3, 3)), np.zeros(3))
    zero.moves[0, 2] = zero.start[2] = -1e4
    after = secrets.fit(windows)
    for place, table in enumerate([*zero.tables, zero.moves]):
        changed = [*after.tables, after.moves][place]
        for at in np.ndindex(table.shape):
            if table[at] > -1e3:
                table[at] += 1e-5
                up = loss(zero)
                table[at] -= 2e-5
                down = loss(zero)
                table[at] += 1e-5
                slope = (up - down) / 2e-5
                assert np.isclose(changed[at], -0.4 * np.sign(slope), atol=1e-3) or abs(slope) < 1e-3  # Adagrad's first step


def _base(text):
    """The base spans by plain expressions over code points."""
    import re

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_secrets_of_random_texts(spark):
    """Base spans equal plain expressions, on texts made of the patterns' own pieces; repeated rows are alike."""
    rng = random.Random(12)
    pieces = ["password", "PASSWD", "Token", "api_key", "apikey", "secret", '"', "'", " ", "  ", ":", "=", "é", "日", "AKIA", "AKIAB7", "Q" * 9, "0123456789ab", "deadbeef", "/+_.-", "x", "\n", "ſ", "K"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += [texts[3], texts[3], "z" * 200_000 + " password=" + "q" * 40_000, None, ""]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, h long")
    for r in secrets.scan(df, secrets.fit([])).collect():
        assert [(s.start, s.kind, s.end) for s in r.spans] == _base(texts[r.doc_id] or ""), texts[r.doc_id]


def test_the_field_finds_secrets_that_no_pattern_knows(spark):
    rng = random.Random(21)
    words = [f"{a}{b}{c}" for a in ("re", "ton", "la", "mi") for b in ("der", "ca", "lu", "ste") for c in ("n", "ing", "sen", "t")]

    def text(extra=()):
        some = [rng.choice(words) for _ in range(60)]
        some[rng.randint(5, 50)] = f"{rng.choice(words)}.{rng.randint(10, 99)}@mail.example.com"
        at = rng.randint(1, 58)
        return " ".join([*some[:at], *extra, *some[at:]])

    def drawn(n):
        return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))

    known = [text(["token", "=", f'"{rng.getrandbits(160):040x}"']) for _ in range(150)]
    plain = [text() for _ in range(450)]
    field = secrets.train(spark.createDataFrame([(i, t) for i, t in enumerate(known + plain)], "doc_id long, text string"))
    forms = [lambda: ["Authorization:", "Bearer", drawn(40)], lambda: ["pwd=", drawn(24)], lambda: [f"{rng.getrandbits(160):040X}"], lambda: ["ghp_" + drawn(36)]]
    hidden = [forms[i % 4]() for i in range(200)]
    held = [text(h) for h in hidden] + [text() for _ in range(400)]
    found = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == 3] for r in secrets.scan(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string"), field).collect()}
    caught = sum(any(h[-1] in held[i][a:b] or held[i][a:b] in h[-1] for a, b in found[i]) for i, h in enumerate(hidden))
    wrong = sum(len(v) for k, v in found.items()) - sum(len(found[i]) > 0 for i in range(200))
    assert caught >= 180 and wrong <= 6, (caught, wrong)


def test_url_lists(spark):
    captures = spark.createDataFrame([(1, "http://u@A.b.Example.org:80/x/y?q", 5), (2, "https://example.org/", 9), (3, None, 5), (4, "nonsense", 5), (5, "http://a.b.example.org/x", None), (6, "http://a.b.example.org/x/y", 7)], "page_id long, url string, fetched int")
    events = [("l", "domain", "example.org", "add", 3), ("l", "domain", "example.org", "remove", 6), ("l", "domain", "example.org", "add", 9), ("m", "prefix", "a.b.example.org/x/", "add", 1), ("m", "host", "b.example.org", "add", 1), ("n", "url", "https://example.org/", "remove", 2), ("n", "domain", None, "add", 1), ("m", "prefix", "a.b.example.org/x/", "add", 1)]
    got = {r.page_id: (r.n_active, r.lists, r.latest, r.blocked) for r in url_lists.judged(captures, spark.createDataFrame(events, "list string, scope string, pattern string, action string, at int")).collect()}
    assert got == {1: (2, "l,m", 3, True), 2: (1, "l", 9, True), 3: (0, "", None, False), 4: (0, "", None, False), 5: (0, "", None, False), 6: (1, "m", 1, True)}


def test_url_lists_of_repeated_rows_and_clashing_names(spark):
    events = [("l", "host", "a.org", "add", 3), ("l", "host", "a.org", "add", 3), (None, "host", "a.org", "add", 3), ("m", "host", None, "add", 3)]
    entries = spark.createDataFrame([(*e, "x", 7) for e in events], "list string, scope string, pattern string, action string, at int, url string, t int")
    long = "http://a.org/" + "x/" * 3000
    rows = [(1, "http://a.org/", 5), (1, "http://b.org/", 5), (1, "http://a.org/", 5), (1, "http://a.org/", 2), (None, "http://a.org/", 5), (2, "", 5), (3, long, 4)]
    captures = spark.createDataFrame([(*r, "k", "p") for r in rows], "id long, latest string, t int, list string, pattern string")
    got = sorted(((r[0] or 0, r[1][:14], r[2], r[3], r[6]) for r in url_lists.judged(captures, entries.filter("list is not null"), "id", "latest", "t").collect()))
    assert got == sorted([(1, "http://a.org/", 5, 1, True), (1, "http://b.org/", 5, 0, False), (1, "http://a.org/", 5, 1, True), (1, "http://a.org/", 2, 0, False), (0, "http://a.org/", 5, 1, True), (2, "", 5, 0, False), (3, "http://a.org/x", 4, 1, True)])
    assert url_lists.judged(captures.limit(0), entries, "id", "latest", "t").count() == 0
    assert not url_lists.judged(captures, entries.limit(0), "id", "latest", "t").filter("blocked").count()


AWKWARD = [(5, "b c"), (5, "b c"), (None, "b c"), (5, "a"), (None, None), (7, ""), (8, "é\u2028 x" * 3), (9, "one two three four five six seven eight nine ten eleven twelve thirteen"), (9, "one two three four five six seven eight nine ten eleven twelve thirteen")]


@pytest.fixture(scope="module")
def awkward(spark):
    """Null and repeated ids, repeated rows, and columns with the names that operators use."""
    rows = [(d, t, "x", 1, "y", 2.0) for d, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, rid int, part string, score double").repartition(3)


def test_packing_of_awkward_rows(awkward):
    import collections

    pieces = packing.pack(awkward, BYTE, 0, size=16).collect()
    got = collections.Counter()
    for p in pieces:
        got[(p.doc_id, p.doc_tokens)] += p.length
    want = collections.Counter()
    for (d, _), x in zip(AWKWARD, ids([t for _, t in AWKWARD], BYTE)):
        want[(d, len(x) + 1)] += len(x) + 1
    assert got == want


def test_token_planes_of_awkward_rows(awkward):
    got = bitplanes.round_trip(awkward, WORD, 2).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, _ in AWKWARD), key=lambda d: (d is not None, d)) and [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])


def test_winnowing_of_awkward_rows(spark, awkward):
    item = "nine " + AWKWARD[-1][1]
    bench = spark.createDataFrame([("q7", item), ("q7", item), (None, "b c"), ("z", "")], "item_id string, text string")
    want = sorted((contaminated(AWKWARD, [("q7", item), ("z", "")])), key=repr)
    for block in (winnow.BLOCK, 10):
        got = winnow.contaminated(awkward, bench, block=block)
        assert sorted((tuple(r) for r in got.drop("items").collect()), key=repr) == want and got.count() == len(AWKWARD)
        assert winnow.clean(awkward, bench, block=block).count() == sum(not w[-1] for w in want)


def test_winnowing_compares_a_long_span_once():
    import time

    span = " ".join(f"w{i}" for i in range(20_000))
    index = winnow.Index([("a", span)], 13, winnow.K)
    began = time.time()
    _, found = index.hits(*_block(["x " + span + " y"]))
    assert len(found[0][0]) == 20_000 and time.time() - began < 5


def test_near_duplicates_of_awkward_rows(awkward):
    fps = {}
    for d, t in AWKWARD:
        fps.setdefault(simhash(t), []).append(d)
    got = sh.near_duplicates(awkward).collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        own = [d for d in fps[r.fp % 2**64] if d is not None]
        assert r.component == min(own) or r.component < min(own)
    assert sh.keep_one(awkward).count() == len(AWKWARD)  # rows that share an id count as one document


def test_repeats_of_awkward_rows(awkward):
    long = AWKWARD * 1
    got = rp.without_repeats(awkward, length=6, gram=3).collect()
    order = sorted(((d if d is not None else -(10**18), t or "") for d, t in long), key=lambda r: r[0])
    assert len(got) == len(AWKWARD) and sum(r.n_bytes for r in got) == sum(len(t.encode()) for _, t in order)
    seen, gone = set(), 0
    texts = sorted((t or "" for d, t in AWKWARD if d == 9))
    for t in texts:  # the second of two equal rows goes whole
        gone += len(t) if t in seen else 0
        seen.add(t)
    assert sum(r.n_removed for r in got if r.doc_id == 9) >= gone


def test_language_of_awkward_rows(awkward):
    model = language.train(awkward)
    got = language.score(awkward, *model).collect()
    assert len(got) == len(AWKWARD) and {(r.n_tokens, r.base_score) for r in got if r.doc_id == 7} == {(1, got[[r.doc_id for r in got].index(7)].base_score)}
    same = [(r.base_score, r.score) for r in got if r.doc_id == 9]
    assert same[0] == same[1] and all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_language_scores_by_hand(docs, rows):
    """Scores equal a plain walk over the same model's tables, token by token."""
    import collections

    model, counts, tokens, distinct = language.train(docs)
    c = {r.h % 2**64: r.c for r in counts.collect()}
    for r in language.score(docs, model, counts, tokens, distinct).collect():
        text = next(t for d, t in rows if d == r.doc_id)
        s = language.stream(*_block([text or ""]))
        numbers, classes, total = [], [], 0.0
        for h, spelling in zip(s.h.tolist(), s.spelling.tolist()):
            at = model.words.tolist().index(h) if h in model.words.tolist() else -1
            numbers.append(at if at >= 0 else language.WORDS + spelling)
            classes.append(language.CLUSTERS if h == language.END else int(model.word_class[at]) if at >= 0 else language.CLUSTERS + 1 + spelling)
        f = language.contexts(np.array(numbers), np.arange(len(numbers)))
        for i, (h, k) in enumerate(zip(s.h.tolist(), classes)):
            z = model.bias.astype(float) + sum(model.weights[row].astype(float) for row in f[:, i])
            total += (z[k] - z.max() - np.log(np.exp(z - z.max()).sum())) / np.log(10)
            before = classes[i - 1] if i else language.CLASSES
            if k < language.CLUSTERS:
                total += model.inside[before, numbers[i]] / np.log(10)
            elif k > language.CLUSTERS:
                total += np.log10(c.get(h, 0) + 1) - model.spell_total[k - language.CLUSTERS - 1]
        assert abs(total - r.score) < 1e-3 * max(1, abs(total)), (total, r.score)
    # given a class before, the shares of a class's words sum to one
    groups = collections.defaultdict(list)
    for word, k in enumerate(model.word_class.tolist()):
        groups[k].append(word)
    for own in groups.values():
        assert np.allclose(np.exp(model.inside[:, own]).sum(1), 1, atol=1e-4)


def test_language_without_heavy_tokens(docs, monkeypatch):
    """Where the highest level of counts alone is too large, words are still chosen and all counts joined."""
    whole = {r.doc_id: r for r in language.score(docs, *language.train(docs)).collect()}
    monkeypatch.setattr(language, "HEAVY", 0)
    trained = language.train(docs)
    assert len(trained[0].words) > 0 and not len(trained[0].heavy)
    for r in language.score(docs, *trained).collect():
        assert r.n_known == whole[r.doc_id].n_known and abs(r.base_score - whole[r.doc_id].base_score) < 1e-6


def _plain_hash(raw):
    from paperloom.llm.common import mix

    base = 0x9E3779B97F4A7C15
    h = sum((b + 1) * pow(base, i, 2**64) for i, b in enumerate(raw)) + len(raw)
    return int(mix(np.array([h % 2**64], np.uint64))[0])


def test_quality_features_by_hand():
    import collections
    import re

    from paperloom.llm.common import mix

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é日 \n.") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", "   "]
    got = [collections.Counter() for _ in texts]
    for doc, bucket in quality.features(*_block(texts)):
        for d, b in zip(doc.tolist(), bucket.tolist()):
            got[d][b] += 1
    for text, found in zip(texts, got):
        want = collections.Counter()
        words = [_plain_hash(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        want.update(w % quality.BUCKETS for w in words)
        want.update(int(mix(np.array([(b - a + 0x51) % 2**64], np.uint64))[0]) % quality.BUCKETS for a, b in zip(words, words[1:]))
        flat = re.sub(r"[\x09-\x0D]", " ", text)
        for k in quality.GRAMS:
            grams = [flat[i : i + k] for i in range(len(flat) - k + 1)]
            want.update(_plain_hash(g.encode()) % quality.BUCKETS for g in grams if " " not in g[1:-1])
        assert found == want, text


def test_quality_training_by_hand(monkeypatch):
    """The folded model equals plain stochastic gradient descent, feature by feature in double precision."""
    monkeypatch.setattr(quality, "BUCKETS", 50)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(40):
        bucket = np.sort(rng.choice(50, 6, replace=False)).astype(np.int32)
        rows.append((i % 2, bucket, rng.integers(1, 4, 6).astype(np.int32)))
    model = quality.fit(rows, seed=3)
    draw = np.random.default_rng(3)
    vectors = draw.uniform(-1 / quality.DIM, 1 / quality.DIM, (50, quality.DIM)).astype(np.float32).astype(float)
    out, bias = draw.normal(0, 0.1, (quality.DIM, 2)).astype(np.float32).astype(float), np.zeros(2)
    steps, step = quality.EPOCHS * len(rows), 0
    for _ in range(quality.EPOCHS):
        for i in draw.permutation(len(rows)):
            rate, (label, bucket, count) = quality.RATE * (1 - step / steps), rows[i]
            step += 1
            hidden = sum(c * vectors[b] for b, c in zip(bucket, count)) / count.sum()
            z = np.array([sum(hidden[d] * out[d, k] for d in range(quality.DIM)) + bias[k] for k in range(2)])
            p = np.exp(z) / np.exp(z).sum() - np.eye(2)[label]
            back = out @ p
            for d in range(quality.DIM):
                out[d] -= rate * hidden[d] * p
            bias -= rate * 0.1 * p
            for b, c in zip(bucket, count):
                vectors[b] -= rate * 20 * c / count.sum() * back
    assert np.allclose(model.weights, vectors @ (out[:, 1] - out[:, 0]), atol=1e-3) and abs(model.bias - (bias[1] - bias[0])) < 1e-3


def test_quality_of_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(5, 1), (9, 0), (7, 0), (None, 1), (8, None), (5, 0)], "doc_id long, quality int")
    model = quality.train(awkward, labels)
    got = quality.score(awkward, model, name="p")
    assert got.columns == [*awkward.columns, "p"] and got.count() == len(AWKWARD) and all(0 < r.p < 1 for r in got.collect())
    clash = quality.score(awkward.withColumnRenamed("part", "c0"), model, name="q").collect()
    assert len(clash) == len(AWKWARD)
    long = spark.createDataFrame([(1, "word " * 400_000), (2, None)], "doc_id long, text string")
    assert all(0 < r.score < 1 for r in quality.score(long, model).collect())
