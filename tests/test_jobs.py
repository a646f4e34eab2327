"""Sources, sinks and whole jobs, on temporary folders."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_extract import PAGE

from paperloom import schemas
from paperloom.operators import agents, curate, encoders, retrieve, sample
from paperloom.plans import cli, jobs
from paperloom.sources import files, pages, sinks
from paperloom.streaming import ingest


def test_tsv_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [("2410.00010", "1", "", 'a "b"\tc\nd'), ("2410.10000", "NA", "null", "")]
    df = spark.createDataFrame(rows, schemas.GENERATED)
    sinks.append_tsv(df, path)
    assert sorted(map(tuple, files.read_tsv(spark, path, schemas.GENERATED).collect())) == sorted(rows)
    sinks.append_tsv(df, path)
    assert files.read_tsv(spark, path, schemas.GENERATED).count() == 4
    assert files.read_tsv(spark, path, schemas.GENERATED, na=("NA",)).filter("figure_id = ''").count() == 2
    with pytest.raises(FileNotFoundError):
        files.require(spark, path, str(tmp_path / "none"))


def test_tsv_keeps_every_character(spark, tmp_path):
    rng, path = np.random.default_rng(5), str(tmp_path / "t")
    texts = [" a", "a\n", "\ta\t", "\r", " ", '"\x00', "\x00\n", *["".join(rng.choice(list(' \t\n\r"\\\0ab,'), 5)) for _ in range(500)]]
    rows = [(str(i), texts[-i], "", t) for i, t in enumerate(texts)]
    sinks.append_tsv(spark.createDataFrame(rows, schemas.GENERATED), path)
    assert sorted(map(tuple, files.read_tsv(spark, path, schemas.GENERATED).collect())) == sorted(rows)


def test_corpus_and_images(spark, tmp_path):
    root = tmp_path / "c"
    (root / "figures" / "24").mkdir(parents=True)
    (root / "metadata").mkdir()
    figure = {"figure_id": 1, "sub_id": "a", "image_id": "p_1_a", "local_path": "24/1a.PNG", "caption": "c", "sub_caption": None}
    (root / "figures" / "p.json").write_text(json.dumps({"figures": [figure, {**figure, "local_path": ""}], "figure_references": {"Figure 1": ["x", "y"]}}))
    (root / "figures" / "bad.json").write_text("{")
    (root / "metadata" / "p.json").write_text('{"title": "T"}')
    (root / "figures" / "24" / "1a.PNG").write_bytes(b"i")
    row = files.read_corpus(spark, str(root)).collect()
    assert [(r.paper_id, r.title, r.context_paras, r.image_id) for r in row] == [("p", "T", ["x", "y"], "p_1_a")]
    image = files.list_images(spark, str(root), content=True).collect()
    assert [(r.paper_id, r.fig_id, bytes(r.content)) for r in image] == [("24", "1a", b"i")]
    (tmp_path / "q.json").write_text(json.dumps([{"query": "a", "source_figure_uids": ["p::F1", "q::FF2"]}]))
    assert files.read_test_queries(spark, str(tmp_path / "q.json"), 5).first().stems == ["p_1", "q_2"]


def test_month_ids(spark):
    ids = [r.paper_id for r in files.month_ids(spark, ["24"], ["10", "11"], 99_998).orderBy("paper_id").collect()]
    assert ids == ["2410.99998", "2410.99999", "2411.99998", "2411.99999"]


def test_page_source(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>hé</p>")
    spark.dataSource.register(pages.PageSource)
    urls = json.dumps([f"file://{tmp_path}/a.html", "file:///none/b.html"])
    got = spark.read.format("pages").option("urls", urls).option("retries", 1).load().collect()
    assert [r.html for r in got] == ["<p>hé</p>", None]
    ids = spark.createDataFrame([("a.html",), ("b.html",)], "paper_id string")
    assert [r.page_id for r in pages.fetched(ids, f"file://{tmp_path}/", retries=1, pause=0).collect()] == ["a.html"]
    figures = spark.createDataFrame([("2410.1", "1", None, f"file://{tmp_path}/a.html"), ("2410.1", "2", "a", "file:///none"), ("2410.1", "3", None, None)], "paper_id string, figure_id string, sub_id string, source string")
    done = sinks.write_images(figures, f"file://{tmp_path}/out").collect()
    assert sorted((r.path.rpartition("/")[2], r.error is None) for r in done) == [("1.png", True), ("2a.png", False)]
    assert (tmp_path / "out/24/10/2410.1/1.png").exists()


def test_extract_resume_sample_and_generate(spark, tmp_path):
    out = str(tmp_path / "o")
    made = [(f"2410.{i:05d}", f"https://example.org/{i}", PAGE) for i in range(1, 7)] + [("2410.00099", "u", "<p>empty</p>")]
    source = str(tmp_path / "pages")
    spark.createDataFrame(made, schemas.PAGES).write.parquet(source)
    cli.main(["extract", "--pages", source, "--out", out, "--max-papers", "4"], spark)
    assert spark.read.parquet(f"{out}/done").count() == 4
    cli.main(["extract", "--pages", source, "--out", out], spark)
    assert spark.read.parquet(f"{out}/done").count() == 6 and spark.read.parquet(f"{out}/captions").count() == 30
    assert "year=24/month=10" in spark.read.parquet(f"{out}/metadata").inputFiles()[0]

    cli.main(["sample-figures", "--data", out, "--out", str(tmp_path / "f"), "--n", "5"], spark)
    figures = spark.read.options(sep="\t", header=True, quote='"', escape='"').csv(str(tmp_path / "f"))
    assert figures.columns == schemas.FIGURE_SAMPLE and figures.count() == 5 and figures.select("Paper ID", "Figure ID").distinct().count() == 5
    cli.main(["sample-tables", "--data", out, "--out", str(tmp_path / "s"), "--n", "7", "--base-url", "https://example.org/"], spark)
    tables = spark.read.options(sep="\t", header=True, quote='"', escape='"').csv(str(tmp_path / "s"))
    assert tables.columns == schemas.TABLE_SAMPLE and tables.count() == 7
    cli.main(["candidates", "--data", out, "--out", str(tmp_path / "c"), "--target", "3", "--pool-multiplier", "1"], spark)
    order = spark.read.parquet(str(tmp_path / "c"))
    assert [r.position for r in order.orderBy("position").collect()] == [1, 2, 3] and order.select("paper_id").distinct().count() == 3

    def factory():
        return agents.ScriptedModel(['{"query": "a\\tquery"}', '{"verdict": "ACCEPT"}'] * 50)

    target = str(tmp_path / "q")
    assert agents.generate(order, factory, 2, target, batch=1) == 2
    assert agents.generate(order, factory, 3, target) == 3
    found = files.read_tsv(spark, target, schemas.GENERATED)
    assert found.count() == 3 and found.first().query == "a query" and found.select("paper_id").distinct().count() == 3

    class Broken:
        def chat(self, *a):
            raise RuntimeError("no")

    assert {r.error for r in agents.queries_for(order, Broken).collect()} == {"RuntimeError: no"}


AUTHOR = """
class Author:
    def __init__(self, model_name="m"):
        self.model_name = model_name

    def chat(self, messages, temperature, image=None):
        return '{"verdict": "ACCEPT"}' if "Proposed query" in messages[-1]["content"][-1]["text"] else '{"query": "by %s"}' % self.model_name
"""


def test_commands(spark, tmp_path, capsys, monkeypatch):
    import io
    import sys

    out, source = str(tmp_path / "o"), str(tmp_path / "pages")
    spark.createDataFrame([(f"2410.{i:05d}", f"https://example.org/{i}", PAGE) for i in range(1, 7)], schemas.PAGES).write.parquet(source)
    feed = '<feed><entry><category term="cs.LG"/></entry></feed>'
    spark.createDataFrame([(f"2410.{i:05d}", feed) for i in range(1, 7)], "paper_id string, xml string").write.parquet(str(tmp_path / "feeds"))
    cli.main(["--log-dir", str(tmp_path / "log"), "extract", "--pages", source, "--out", out, "--kind", "figures", "--feeds", str(tmp_path / "feeds")], spark)
    assert not files.exists(spark, f"{out}/tables") and {r.categories for r in spark.read.parquet(f"{out}/metadata").collect()} == {"cs.LG"}
    assert {r.item_type for r in spark.read.parquet(f"{out}/item_captions").collect()} == {"figure"}
    [log] = (tmp_path / "log").iterdir()
    assert log.name.startswith("extract-") and "6 pages written" in log.read_text()
    cli.main(["extract", "--pages", source, "--out", str(tmp_path / "t"), "--kind", "tables"], spark)
    assert not files.exists(spark, f"{tmp_path}/t/captions") and files.read_tables(spark, f"{tmp_path}/t/tables").count() > 0

    (tmp_path / "author_of_tests.py").write_text(AUTHOR)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "author_of_tests.py"))
    cli.main(["generate", "--data", out, "--out", str(tmp_path / "q"), "--model", "author_of_tests:Author", "--model-name", "x", "--target", "2"], spark)
    found = files.read_tsv(spark, str(tmp_path / "q"), schemas.GENERATED)
    assert {r.query for r in found.collect()} == {"by x"} and found.count() == 2

    words = ["red apple", "green pear", "blue plum"]
    single = spark.createDataFrame([("p", str(i), [float(x) for x in v]) for i, v in enumerate(encoders.hashed_text(64)(words))], "paper_id string, fig_id string, embedding array<double>")
    single.withColumn("embedding", F.col("embedding").cast("array<float>")).write.parquet(str(tmp_path / "v"))
    multi = [(f"p_{i}", v.tolist()) for i, v in enumerate(encoders.hashed_words(64)(words))]
    spark.createDataFrame(multi, "image_id string, patches array<array<double>>").write.parquet(str(tmp_path / "m"))
    rows = [("p", str(i), w, "", "") for i, w in enumerate(words)]
    sinks.overwrite_tsv(spark.createDataFrame(rows, "`Paper ID` string, `Figure ID` string, `Query 1` string, `Query 2` string, `Query 3` string"), str(tmp_path / "e"))
    for kind, path in (("single", "v"), ("multi", "m")):
        cli.main(["evaluate", "--kind", kind, "--vectors", str(tmp_path / path), "--queries-tsv", str(tmp_path / "e"), "--top-k", "1"], spark)
        assert "|3        |0" in capsys.readouterr().out
        cli.main(["search", "--kind", kind, "--vectors", str(tmp_path / path), "--query", "green pear", "--top-k", "1"], spark)
        assert capsys.readouterr().out.startswith("green pear\t1\tp_1\t")
    monkeypatch.setattr(sys, "stdin", io.StringIO("blue plum\n\nred apple\n"))
    cli.main(["search", "--vectors", str(tmp_path / "v"), "--top-k", "1"], spark)
    assert [line.split("\t")[2] for line in capsys.readouterr().out.strip().split("\n")] == ["p_2", "p_0"]


def test_months_stop_at_the_limit(spark, tmp_path, monkeypatch):
    asked = []

    def fetched(ids, base_url, **options):
        some = sorted(r.paper_id for r in ids.collect())
        asked.extend(some)
        return spark.createDataFrame([(i, "u", PAGE) for i in some if int(i[-1]) % 2], schemas.PAGES)

    monkeypatch.setattr(jobs.pages, "fetched", fetched)
    assert jobs.extract_months(spark, "b", ["24"], ["10", "11"], str(tmp_path / "o"), limit=3, step=4) == 3
    assert asked == [f"2410.{i:05d}" for i in range(1, 9)] and spark.read.parquet(str(tmp_path / "o/done")).count() == 3
    assert jobs.extract_months(spark, "b", ["24"], ["10"], str(tmp_path / "o"), start=5, end=10, limit=2, step=4) == 2


def test_searches_in_blocks(spark):
    """Blocks of queries against parts of the corpus give the rows of one broadcast block."""
    import random

    from paperloom.operators import retrieve

    rng = random.Random(3)
    e = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(80)], "id long, embedding array<double>")
    q = e.filter("id % 5 = 0")
    targets = q.select(F.col("id").alias("query_id"), ((F.col("id") + 1) % 80).alias("target_id"))

    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    monkey = pytest.MonkeyPatch()
    plain = rows(retrieve.top_k(q, e, 3)), rows(retrieve.target_ranks(q, e, targets))
    bundles = e.select(F.col("id").alias("image_id"), F.array("embedding", "embedding").alias("patches"))
    asked = q.select(F.col("id").alias("query_id"), F.array("embedding").alias("tokens"))
    wanted = targets.withColumnRenamed("target_id", "image_id")
    multi = rows(retrieve.max_sim_top_k(asked, bundles, 3)), rows(retrieve.max_sim_ranks(asked, bundles, wanted))
    own = {r.query_id: np.array(r.tokens) for r in asked.collect()}
    patches = {r.image_id: np.array(r.patches) for r in bundles.collect()}
    best = sorted((round(-retrieve.max_sim(own[5], p), 9), i) for i, p in patches.items())[:3]
    assert [(round(-r[2], 9), r[1]) for r in multi[0] if r[0] == 5] != [] and sorted((round(-r[2], 9), r[1]) for r in multi[0] if r[0] == 5) == best
    with monkey.context() as m:
        m.setattr(retrieve._met, "__defaults__", (7,))  # parts of seven rows
        assert (rows(retrieve.top_k(q, e, 3, block=4)), rows(retrieve.target_ranks(q, e, targets, block=4))) == plain
        got = rows(retrieve.max_sim_top_k(asked, bundles, 3, block=4)), rows(retrieve.max_sim_ranks(asked, bundles, wanted, block=4))
    assert [r[:2] + r[3:] for r in got[0]] == [r[:2] + r[3:] for r in multi[0]] and got[1] == multi[1]
    assert retrieve.top_k(q.limit(0), e, 3).count() == 0 == retrieve.max_sim_top_k(asked, bundles.limit(0), 3).count()


def test_evaluation(spark):
    words = [f"alpha{i} beta{i} gamma{i}" for i in range(30)]
    vectors = spark.createDataFrame([("p", str(i), w) for i, w in enumerate(words)], "paper_id string, fig_id string, w string")
    encoder = encoders.single(lambda: encoders.hashed_text(512))
    vectors = vectors.withColumn("embedding", encoder(F.col("w"))).persist()
    queries = spark.createDataFrame([("p", f"{i}a", w) for i, w in enumerate(words)] + [("q", "1", "x")], "paper_id string, fig_id string, query string")
    got = jobs.evaluate_single(queries.repartition(3).persist(), vectors, encoder, (1, 1, 5)).first()
    assert (got.evaluated, got.no_match, got.recall_at_1, got.mrr) == (30, 1, 1.0, 1.0) and "recall_at_5" in got.asDict()
    multi = encoders.multi(lambda: lambda texts: [encoders.hashed_text(64)(t.split()) for t in texts], 64)
    items = vectors.select(F.concat_ws("_", "paper_id", "fig_id").alias("image_id"), multi(F.col("w")).alias("patches"))
    got = jobs.evaluate_multi(queries.persist(), retrieve.MultiVectorIndex(items), multi).first()
    assert got.evaluated == 30 and got.recall_at_1 > 0.9 and got.no_match == 1
    assert retrieve.metrics(spark.createDataFrame([], "rank long")).first().mrr == 0.0


def test_search_blocks_and_placeholders(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    a, b = (sorted((r[0], r[1], round(r[2], 9), r[3]) for r in retrieve.top_k(df, df, 3, block=n).collect()) for n in (4096, 7))
    assert a == b and all(r[1] == r[0] for r in a if r[3] == 1)
    assert len(retrieve.top_k(df, df.limit(2), 10).collect()) == 100
    items = spark.createDataFrame([("a", [[1.0, 0.0]], "x"), ("b", [[0.0, 0.0]], "y"), ("c", [[-1.0, 0.0]], "z")], "image_id string, patches array<array<float>>, caption string")
    q = spark.createDataFrame([("q", [[1.0, 0.0]])], "query_id string, tokens array<array<float>>")
    index = retrieve.MultiVectorIndex.at(spark, str(tmp_path / "i"), lambda: items)
    assert [(r.image_id, r["rank"]) for r in index.search(q, 2).collect()] == [("a", 1)]
    assert retrieve.MultiVectorIndex.at(spark, str(tmp_path / "i")).items.count() == 3


def test_hamilton_sums(spark):
    for sizes, n in (([5, 3, 1], 9), ([100, 1, 1, 1], 10), ([1] * 12, 5), ([7, 7, 7], 10)):
        df = spark.createDataFrame([(f"c{i}", s) for i, s in enumerate(sizes)], "category string, size long")
        slots = [r.slots for r in sample.hamilton(df, n).collect()]
        assert sum(slots) <= n if len(sizes) <= n else sum(slots) == n


def test_images_are_resolved_by_priority(spark):
    figures = spark.createDataFrame([("p", "1", "a"), ("p", "2", None), ("p", "3", None)], "paper_id string, figure_id string, sub_id string")
    listing = spark.createDataFrame([("r/p/1a.jpg",), ("r/p/1a.png",), ("r/p/2.JPEG",), ("r/p/3.gif",)], "path string")
    assert {(r.figure_id, r.image_path) for r in curate.resolved_images(figures, listing).collect()} == {("1", "r/p/1a.png"), ("2", "r/p/2.JPEG")}


def test_streams(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.createDataFrame([("2410.00001", "u", PAGE)], schemas.PAGES).write.parquet(source)
    ingest.stream_pages(spark, source, out, mark)
    spark.createDataFrame([("2410.00002", "u", PAGE)], schemas.PAGES).write.mode("append").parquet(source)
    ingest.stream_pages(spark, source, out, mark)
    got = spark.read.parquet(f"{out}/captions")
    assert got.count() == 16 and got.select("batch").distinct().count() == 2


def test_backfill(spark, tmp_path):
    meta, out = str(tmp_path / "m"), str(tmp_path / "b")
    spark.createDataFrame([("u", "p", "t", "a", " "), ("u", "q", "t", "a", "x")], schemas.METADATA).write.parquet(meta)
    feeds = spark.createDataFrame([("p", '<f><category term="cs.LG" scheme="s"/><category term="quant-ph" scheme="s"/></f>')], "paper_id string, xml string")
    jobs.backfill(spark, meta, feeds, out, "s")
    assert {r.paper_id: r.categories for r in spark.read.parquet(out).collect()} == {"p": "cs.LG; quant-ph", "q": "x"}
