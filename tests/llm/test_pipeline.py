"""The pipeline's stages on the smallest driver tables, each against its plain version."""

import os

import pytest
from brute import contaminated, crc, ids, lower

import corpus_pipeline as cp
from paperloom.llm import winnow
from paperloom.llm.common import written
from paperloom.llm.tokens import vocabulary

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables are missing")


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    steps = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "benchmark decontamination", "packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}

    good = written(steps["quality classifier"](spark, docs, DIR), "t")
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert sum((d in kept) == (q == 1) for d, q in labels.items()) >= 0.95 * len(labels)

    once = written(steps["exact dedup"](spark, good, DIR), "t")
    last = {}
    for r in good.collect():
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert sorted(r.doc_id for r in once.collect()) == sorted(last.values())

    far = written(steps["simhash near-dedup"](spark, once, DIR), "t")
    texts = {r.doc_id: lower(r.text).split() for r in once.collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in texts.items()}
    stay = {r.doc_id for r in far.collect()}
    order = sorted(sets)
    near = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert all(not (a in stay and b in stay) for a, b in near) and all(d in {b for _, b in near} for d in set(sets) - stay)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    clean = written(steps["benchmark decontamination"](spark, far, DIR), "t")
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(e[0] for e in contaminated([(r.doc_id, r.text) for r in far.collect()], items) if not e[-1])

    whole = {r.doc_id: x + [0] for r, x in zip(clean.collect(), ids([r.text for r in clean.collect()], vocabulary("byte_bpe_50k.json")))}
    at = {}
    for p in sorted(steps["packing"](spark, clean, DIR).collect(), key=lambda p: (p.doc_id, p.start)):
        assert p.start == at.get(p.doc_id, 0) and p.ids_crc32 == crc(whole[p.doc_id][p.start : p.start + p.length])
        at[p.doc_id] = p.start + p.length
    assert at == {d: len(x) for d, x in whole.items()}
    assert cp.ORACLE_SQL is None and cp.run(spark, DIR).count() > 0


def test_run_of_awkward_and_empty_tables(spark, tmp_path):
    """Null and empty texts, repeated rows, long texts, extra columns and no rows at all."""
    good = [(i, " ".join(f"{w}{i % 7}" for w in ["calm", "river", "stone", "light"] * 8), "en") for i in range(40)]
    bad = [(i, "BUY!! NOW!! $$$ " * 12, "en") for i in range(40, 80)]
    odd = [(90, None, None), (91, "", "en"), (92, "calm river stone light " * 20_000, "en"), (3, good[3][1], "en"), (None, "calm river stone " * 12, "en")]
    schema = "doc_id long, text string, id string, component long, __loom_score int"
    labels = [(i, int(i < 40), 0) for i in range(80)]
    for name, rows in (("full", good + bad + odd), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame([(*r, i, 1) for i, r in enumerate(rows)], schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([("a", "calm4 river4 stone4 light4 " * 4)] if rows else [], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in cp.STAGES[:-1]:
            docs = written(f(spark, docs, str(folder)), "t")
            assert docs.columns == ["doc_id", "text", "id", "component", "__loom_score"], stage
        pieces = cp.run(spark, str(folder)).collect()
        kept = {r.doc_id for r in docs.collect()}
        assert {p.doc_id for p in pieces} == kept
        if rows:
            assert not kept & set(range(40, 80)) and 92 in kept and None in kept
            assert len({i % 7 for i in kept if i is not None and i < 40}) == len([i for i in kept if i is not None and i < 40]) == 6  # one of each text, and none of the benchmark's
        else:
            assert not pieces


def test_a_benchmark_window_in_a_long_text_is_caught(spark, tmp_path):
    """Passages under one word in twenty go as well; items under a window count by their share only."""
    words = [f"w{i}" for i in range(2_000)]
    item, other = [f"q{i}" for i in range(20)], [f"r{i}" for i in range(13)]
    rows = [
        (1, " ".join(words)),
        (2, " ".join(words[:900] + item + words[900:])),
        (3, " ".join(words[:900] + item[3:16] + words[900:])),  # one window
        (4, " ".join(words[:900] + item[3:15] + words[900:])),  # a word less
        (5, " ".join([*words, *other]).upper().replace(" ", ", ")),
        (6, " ".join(words[:900] + ["yes"] + words[900:])),
        (7, "yes it is"),
        (8, " ".join(words[:900] + ["yes"] * 13 + words[900:])),  # short items side by side are no window
        (9, None),
        (None, " ".join([*words, *item])),
        (None, "calm river"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, "yes"), (4, None)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [None, 1, 4, 6, 8, 9]
    got = dict(cp.STAGES)["benchmark decontamination"](spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    for kept in (got, winnow.clean(docs, items, any_window=True, block=10)):  # one pass and several
        found = [r.doc_id for r in kept.collect()]
        assert sorted(found, key=lambda d: -1 if d is None else d) == want
