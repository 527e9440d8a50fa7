"""Long texts in linear time, odd pages and overlapping rules, and the tables that operators leave."""

from __future__ import annotations

import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flightlens.llm import common, decontaminate, line_dedup, ngram_join, url_filter, warc
from flightlens.session import shared_dir
from tests.llm.test_texts_and_pages import _Plain

DOC = "doc_id long, text string, source string"


def seconds(run):
    began = time.time()
    run()
    return time.time() - began


def test_texts_of_many_lines_are_cleaned_in_linear_time(spark):
    boiler = [f"this line stands on every one of the sites {i}" for i in range(40_000)]
    long = "\n".join(x for i, b in enumerate(boiler) for x in (b, f"own line number {i}"))
    rows = [(0, long, "s0")] + [(i, "\n".join(boiler), f"s{i}") for i in range(1, 6)]
    docs = spark.createDataFrame(rows, DOC)
    found = {}

    def run():
        found.update((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs, min_chars=20).collect())

    assert seconds(run) < 40
    assert found[0] == "\n".join(f"own line number {i}" for i in range(40_000)) and found[3] == ""


def test_places_are_left_out(spark):
    rows = [([f"a{i}" for i in range(5)], [0, 3, 9]), (["x"], []), ([], [1]), (["x", "y"], None), (None, [1]), (["x"], [0]), (["p", None, "q"], [2])]
    df = spark.createDataFrame(rows, "items array<string>, gone array<int>").select("items", "gone", common.without_places(F.col("items"), F.col("gone")).alias("left"))
    for r in df.collect():
        want = r["items"] if r["gone"] is None or r["items"] is None else [x for i, x in enumerate(r["items"]) if i not in r["gone"]]
        assert r["left"] == want


def test_spans_of_long_texts_are_removed_in_linear_time(spark):
    item = " ".join(f"bench{i}" for i in range(13))
    text = " ".join(f"word{i} {item}." for i in range(6_000))
    docs = spark.createDataFrame([(1, text, "s"), (2, "clean words only", "s")], DOC)
    benchmark = spark.createDataFrame([("b", item)], "item_id string, text string")
    found = {}

    def run():
        found.update((r.doc_id, r.text) for r in decontaminate.decontaminate(docs, benchmark, remove="spans").collect())

    assert seconds(run) < 60
    assert re.findall(r"\w+", found[1]) == [f"word{i}" for i in range(6_000)] and found[2] == "clean words only"


@pytest.mark.parametrize(
    ("page", "text", "links", "lang"),
    [
        ("<p>5 < 6 and 7 > 3</p>", "5 < 6 and 7 > 3", [], None),
        ('<a title="a>b" href="x">t</a>', "t", ["x"], None),
        ('<a data-href="x" href="y">t</a>', "t", ["y"], None),
        ("<a href=z>t</a>", "t", ["z"], None),
        ('<html xml:lang="fr" lang="de">', "", [], "de"),
        ("<a href='it&amp;s' HREF=no>q</a >", "q", ["it&amp;s"], None),
        ("<p don't>a<p>b'c", "a\nb'c", [], None),
        ('<a href="x>t</a>', "t", ['"x'], None),
        ("a <3 b </ 5> c <?php x ?> d <!doctype html>e", "a <3 b c d e", [], None),
        ("a<", "a<", [], None),
        ("one <a href=x", "one <a href=x", [], None),
        ("<img alt='<p>'/>x<br/>y", "x\ny", [], None),
    ],
)
def test_odd_tags_and_attributes_are_read(page, text, links, lang):
    read = warc.read_page(page)
    assert (read.text, read.links, read.lang) == (text, links, lang)


def test_random_pages_equal_pythons_own_parser():
    rng = random.Random(8)
    pieces = ["<p>", "</p>", "<b class='a>b'>", "</b>", "5 < 6 ", "7 > 3", "<a title=\"a>b\" href=\"x\">", "<a data-href=\"x\" href='y&amp;z'>", "<a href=z>", "</a>", "<a name=n>", "<br/>", " word ", "&lt;i&gt; ", "<!-- c > <p> -->", "<script>if (a < b) {'<p>'}</script>", "<div\nid=q  lang=en>", "it's ", '"quoted" ', "<h1 a=b c>", "</h1>", "\n", "<img alt='<p>' src=s>"]
    for _ in range(400):
        page = "<html xml:lang='fr' lang=\"de\">" + "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))
        plain = _Plain()
        plain.feed(page)
        plain.close()
        text = "\n".join(x for x in (re.sub(r"[ \t\f\v\xa0]+", " ", line).strip() for line in re.split(r"[\r\n]+", "".join(plain.parts))) if x)
        read = warc.read_page(page)
        assert (read.text, [warc._one_line(x) for x in read.links], read.lang) == (text, plain.links, plain.lang), page


@pytest.mark.parametrize("piece", ["<a b ", "<a 'b ", "<a x=\"", "<a x='y\" ", "< ", "</", "<?", "<a b=c d='e' ", "<p x==", "</ "])
def test_odd_pages_take_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    for whole in (page, page + ">", page + "'>", page + "\">"):
        began = time.process_time()
        warc.read_page(whole)
        assert time.process_time() - began < 2


def test_rules_whose_hosts_and_paths_overlap(spark):
    rng = random.Random(9)
    hosts = ["net", "x.net", "exam", "example.net", "a.x.net", "ple.net", "com", "b.com"]
    paths = ["", "/", "/a", "/ab", "/a/b", "ple.net/", "/ab/"]
    rules = [("block", "exam", "ple.net/"), ("block", "x.net", "/"), ("allow", "net", "/ab"), ("block", "a/b", ""), ("allow", "", "/")]
    rules += [(rng.choice(["block", "allow"]), rng.choice(hosts), rng.choice(paths)) for _ in range(12)]
    urls = ["http://example.net/", "http://x.net/ab", "http://a/b", None, "x.net/ab"] + [f"http://{rng.choice(['', 'q.', 'www.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/a', '/abc', '/a/b', '/ab/c?x#y'])}" for _ in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark, rules)).collect()}
    for i, url in enumerate(urls):
        host, path = re.match(r"http://([^/?#]*)([^?#]*)", url).groups() if url and "://" in url else ("", "")
        fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == ((max(fits)[3], max(fits)[4]) if fits else (None, "allow")), url


def tables(spark):
    folder = Path(shared_dir(spark).removeprefix("file:")) / "flightlens"
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


def test_operators_leave_one_table(spark):
    docs = spark.createDataFrame([(i, f"some words that make up text {i % 3} and a few more of them", f"s{i}") for i in range(12)], DOC)
    before = tables(spark)
    common.finished(lambda: ngram_join.near_duplicates(docs))
    common.finished(lambda: line_dedup.line_report(docs))
    assert len(tables(spark) - before) == 2


def test_tables_of_others_are_never_deleted(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/own")
    with pytest.raises(ValueError, match="not a table"):
        common.discard(spark.read.parquet(f"{tmp_path}/own"))
    assert spark.read.parquet(f"{tmp_path}/own").count() == 3


def least_reachable(links, known=()):
    """rid to the least rid reachable, by spreading labels until nothing changes."""
    edges = [(x, y) for x, y in [*links, *known] if x != y]
    comp = {x: x for edge in edges for x in edge}
    changed = True
    while changed:
        changed = False
        for x, y in edges:
            least = min(comp[x], comp[y])
            changed |= comp[x] != least or comp[y] != least
            comp[x] = comp[y] = least
    return comp


def test_groups_are_those_reachable_whatever_a_task_joins_at_once(spark, monkeypatch):
    dice = random.Random(11)
    path = [(i, i + 1) for i in range(1_000, 1_060)]
    hub = [(9_999, i) for i in range(2_000, 2_300)]
    loose = [(dice.randrange(3_000, 3_400), dice.randrange(3_000, 3_400)) for _ in range(220)]
    links = path + hub + loose + [(5, 5), (-7, 1_030)]
    dice.shuffle(links)
    frame = spark.createDataFrame(links, "x long, y long").repartition(9)
    for nodes in (0, 3, 50, ngram_join.STAR_NODES):
        # Tasks read the module's value, so the function is told it by way of its globals.
        monkeypatch.setattr(ngram_join, "_stars", with_nodes(ngram_join.__dict__["_stars"], nodes))
        found = {r.rid: r.comp for r in ngram_join.components(frame).collect()}
        monkeypatch.undo()
        assert found == least_reachable(links), nodes


def with_nodes(stars, nodes):
    def run(batches):
        from flightlens.llm import ngram_join as worker

        before, worker.STAR_NODES = worker.STAR_NODES, nodes
        try:
            yield from stars(batches)
        finally:
            worker.STAR_NODES = before

    return run


def test_known_groups_grow_or_stay(spark):
    known = ngram_join.components(spark.createDataFrame([(4, 9), (9, 12), (20, 21)], "x long, y long"))
    assert ngram_join.components(spark.createDataFrame([], "x long, y long"), known) is known
    grown = ngram_join.components(spark.createDataFrame([(12, 20), (2, 30)], "x long, y long"), known)
    assert {r.rid: r.comp for r in grown.collect()} == {4: 4, 9: 4, 12: 4, 20: 4, 21: 4, 2: 2, 30: 2}


def test_groups_take_few_tasks(spark):
    """Near copies hang on a few hubs: a few shuffles join them, each of as many tasks as there are partitions."""
    links = [(hub, i) for hub in (500, 7, 900) for i in range(1_000, 1_400)] + [(i, i + 1) for i in range(0, 400, 4)]
    frame = spark.createDataFrame(links, "x long, y long").repartition(6)
    context, names = spark.sparkContext, ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {name: spark.conf.get(name) for name in names}
    context.setJobGroup("groups", "tasks of components")
    try:
        for name, value in zip(names, ("40", "false"), strict=True):
            spark.conf.set(name, value)
        found = {r.rid: r.comp for r in ngram_join.components(frame).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {stage for job in tracker.getJobIdsForGroup("groups") for stage in tracker.getJobInfo(job).stageIds}
    tasks = sum(info.numCompletedTasks for stage in stages if (info := tracker.getStageInfo(stage)))
    assert found == least_reachable(links)
    assert 0 < tasks < 250, tasks
