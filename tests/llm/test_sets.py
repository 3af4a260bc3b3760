"""Mixing, page templates, chat rotation and the pipeline."""

import math
import random
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from countgrove.llm import mixing, rotation, templates


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def _targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(2.0 * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in free) if free else 0.0
        over = {s for s in free if weight[s] * level > 2.0 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (1 + i * 37 % 211), ["a", "é", "z", None, "B"][i % 7 % 5]) for i in range(900)]
    rows += [(5000 + i, "w " * 40, "a") for i in range(700)]
    got = mixing.mix(_docs(spark, rows).repartition(5)).collect()
    again = {(r.doc_id, r.copies) for r in mixing.mix(_docs(spark, rows)).collect()}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    goals = _targets_by_hand(sizes)
    assert len(got) == len(rows) and {(r.doc_id, r.copies) for r in got} == again
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, goals[r.source], rel_tol=1e-12)
        assert r.taken == r.copies * r.size <= 2 * r.size
    for s in sizes:
        assert abs(taken[s] - goals[s]) <= largest[s]


def test_mix_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "x", "b")]
    docs = _docs(spark, rows).withColumn("size", F.lit("s"))
    got = mixing.mix(docs).collect()
    assert len(got) == 5 and {r.copies for r in got if r.source == "a"} == {0}
    out = mixing.emit(docs, mixing.mix(docs))
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(_docs(spark, [(1, None, "a")])).first().target == 0


PAGE = ("<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        "<nav><ul>{menu}</ul></nav><!-- x --><div class='ad'>Buy {i}</div><article><h1>Head {i}</h1><p>One <b>bo</b>ld {i}"
        "<br>line<p>Two &amp; &eacute; {i}</p><form>mail</form><div class='comments'>first!</div></article>"
        "<aside>side</aside><footer>&copy; same</footer></body></html>")


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_article_of_a_template(spark):
    rows = [(i, f"http://a.example.com/{i}", PAGE.format(i=i, menu="<li><a href='/x'>m</a></li>" * (1 + i % 3)))
            for i in range(12)] + [(50, "http://b.example.com/", PAGE.format(i=50, menu=""))]
    got = {r.page_id: r.text for r in templates.extract(_pages(spark, rows)).collect()}
    assert got == {i: f"Head {i} One bold {i} line Two & é {i}" for i in [*range(12), 50]}


def test_template_without_content_elements(spark):
    body = ("<html><body><div class='top'><a href=1>Home</a> <a href=2>News</a></div><div class='x{i}'><p>Story {i} of "
            "the day number {i}.</p></div><div class='legal'>All rights kept.</div></body>")
    rows = [(i, "http://h/x", body.format(i=i)) for i in range(8)]
    got = {r.page_id: r.text for r in templates.extract(_pages(spark, rows)).collect()}
    assert got == {i: f"Story {i} of the day number {i}." for i in range(8)}


def test_classes_share_occurrence_vectors(spark):
    rows = [(i, "http://h/x", "<html><body><ul>" + "<li><p>t</p></li>" * (1 + i % 4) + "</ul></body></html>")
            for i in range(8)]
    tokens = templates.token_counts(_pages(spark, rows)).collect()
    by_vector = defaultdict(set)
    for r in tokens:
        by_vector[r.vector].add(r.depth)
    assert sorted(map(sorted, by_vector.values())) == [[1, 2, 3], [4, 5]]


def _texts(spark, rows):
    return {r.page_id: r.text for r in templates.extract(_pages(spark, rows)).collect()}


@pytest.mark.parametrize("page", [
    "<body class='single has-sidebar'><article><p>Words {i} here {i}</p></article></body>",
    "<body class='sidebar'><div class='sidebar-first'>x</div><p>Words {i} here {i}</p></body>",
    "<body><div class='content-with-sidebar'><p>Words {i} here {i}</p></div><div class='sidebar'>s</div></body>",
    "<body><div class='header menu'><article><p>Words {i} here {i}</p></article></div></body>",
    "<body><form><nav>n</nav><div><p>Words {i} here {i}</p></div></form></body>",
    "<body><form><h1>Words {i}</h1><p>here {i}</p></form></body>",
    "<body><article class='category-social-science'><p>Words {i} here {i}</p></article></body>",
    "<body><article class='post social'><p>Words {i} here {i}</p></article><div class='social'>s</div></body>",
    "<body><article><div class='entry-header'><h1>Words {i}</h1></div><p>here {i}</p></article></body>",
    "<body><article><header class='entry-header'><h1>Words {i}</h1></header><p>here {i}</p><footer>by</footer></article></body>",
    "<body><article><figure>Words {i}<figcaption>here {i}</figcaption></figure><fieldset></fieldset></article></body>",
    "<body><article><math>Words {i}</math> <object>here {i}</object></article></body>",
    "<body><article><p>Words {i} here {i}</p></article><div id='discussion'><article><p>me too</p></article></div></body>",
    "<body><article><p>Words {i} here {i}</p><article><p>first</p></article></article><div class='comment-list'>z</div></body>",
    "<body><div class='related-posts'><article>more</article></div><article><p>Words {i} here {i}</p></article></body>",
])
@pytest.mark.parametrize("n", [1, 6])
def test_ordinary_pages_keep_their_text(spark, page, n):
    rows = [(i, "http://h/x", page.replace("{i}", str(i))) for i in range(n)]
    assert _texts(spark, rows) == {i: f"Words {i} here {i}" for i in range(n)}


def test_copies_of_a_page_keep_their_text(spark):
    page = "<body><div><p>The same article on all rows.</p></div></body>"
    assert set(_texts(spark, [(i, "http://h/x", page) for i in range(4)]).values()) == {"The same article on all rows."}
    near = [(i, "http://h/x", page.replace("<div>", f"<i>{i}</i><div>")) for i in range(6)]
    assert _texts(spark, near) == {i: f"{i} The same article on all rows." for i in range(6)}


def test_the_template_decides_inside_content(spark):
    page = ("<body><article><p>Story {i} tells of {i} things.</p><div class='box'>Subscribe now!</div>"
            "<ul><li><a href=1>One {i}</a></li><li><a href=2>Two {i}</a></li></ul></article>{more}</body>")
    rows = [(i, "http://h/x", page.format(i=i, more="")) for i in range(5)]
    assert _texts(spark, rows) == {i: f"Story {i} tells of {i} things." for i in range(5)}
    # one page has no template: its box and list are text like any other
    assert _texts(spark, rows[:1]) == {0: "Story 0 tells of 0 things. Subscribe now! One 0 Two 0"}
    # articles that repeat beside one that is once in every page are no content
    more = [(i, "http://h/x", page.format(i=i, more="<section>" + f"<article>reply {i}</article>" * i + "</section>"))
            for i in range(5)]
    assert _texts(spark, more) == {i: f"Story {i} tells of {i} things." for i in range(5)}
    # without such a one they are a list of articles
    several = [(i, "http://h/x", "<body>" + f"<article>part {i}</article>" * (i + 1) + "</body>") for i in range(3)]
    assert _texts(spark, several) == {i: " ".join([f"part {i}"] * (i + 1)) for i in range(3)}


class _Elements(HTMLParser):
    """Paths of well-formed pages by another parser."""

    def __init__(self):
        super().__init__()
        self.open, self.seen = [], Counter()

    def handle_starttag(self, tag, attrs):
        names = sorted(w for k, v in attrs if k in ("class", "id") for w in v.split())
        self.open.append(".".join([tag, *names]))
        self.seen[tuple(self.open)] += 1

    def handle_endtag(self, tag):
        self.open.pop()


def test_templates_equal_brute_force(spark):
    rng = random.Random(5)
    parts = ["<div class='x'><p>a</p></div>", "<div class='y'><ul><li>b</li></ul></div>", "<section><h2>c</h2></section>",
             "<table><tr><td>d</td></tr></table>"]
    rows = []
    for i in range(60):
        inner = "".join(p * rng.choice([0, 1, 1, 2]) for p in parts)
        rows.append((i, f"http://h{i % 3}/", f"<html><body><div class='top'>t {i}</div>{inner}</body></html>"))
    wanted = {}
    for host in range(3):
        vectors = defaultdict(lambda: [0] * 20)
        for place, (_, _, page) in enumerate(rows[host::3]):
            parser = _Elements()
            parser.feed(page)
            for path, n in parser.seen.items():
                vectors[path][place] = n
        often = {p: tuple(v) for p, v in vectors.items() if sum(map(bool, v)) >= 10}
        size = Counter(often.values())
        valid = {p for p, v in often.items() if size[v] > 1 or p[:-1] in often or len(p) == 1}
        wanted[f"h{host}"] = set()
        for path in valid:
            key = 0
            for component in path:
                key = templates.path_of(key, component)
            wanted[f"h{host}"].add(key)
    got = {r.host: {s.path for s in r.template} for r in templates.deduce(_pages(spark, rows)).collect()}
    assert got == wanted and any(len(v) > 4 for v in wanted.values())


def test_page_edge_cases(spark):
    rows = [(1, None, None), (2, "http://h/", ""), (3, "x", "plain  text &amp"), (3, "x", "plain  text &amp"),
            (None, "http://h/", "<p>a<p>b"), (5, "http://H/", "<div" * 50), (6, "http://q/", "<script>x"),
            (7, "http://r/", "<p>" + "long " * 50000)]
    got = templates.extract(_pages(spark, rows).withColumn("text", F.lit(0)).withColumn("host", F.lit(0))).collect()
    texts = sorted((str(r.page_id), r.text[:20]) for r in got)
    assert texts == [("1", ""), ("2", ""), ("3", "plain text &"), ("3", "plain text &"), ("5", ""), ("6", ""),
                     ("7", "long long long long "), ("None", "a b")]
    assert templates.extract(_pages(spark, rows).limit(0)).count() == 0


def _rotated_by_hand(rows):
    out = []
    talks = defaultdict(list)
    for d, t, s, x in rows:
        talks[d].append((t is not None, t or 0, s or "unknown", x or "", t))
    for d, turns in talks.items():
        for view in {s for _, _, s, _, _ in turns} - {"system"}:
            at = 0
            for _, _, s, x, t in sorted(turns, key=lambda v: v[:4]):
                head = "<|system|>\n" if s == "system" else "<|assistant|>\n" if s == view else f"<|user:{s}|>\n"
                text = head + x + "<|end|>\n"
                mask = (at + len(head), at + len(text)) if s == view else (None, None)
                out.append((d, view, t, s, text, at, *mask))
                at += len(text)
    return out


@pytest.fixture(params=[1, 7])
def ranges(spark, request):
    """Ordered tables are cut into so many ranges, however small they are."""
    wanted = {"spark.sql.shuffle.partitions": request.param, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    yield request.param
    for key, value in before.items():
        spark.conf.set(key, value)


def test_rotation_by_hand(spark, ranges):
    rows = [(1, t, ["user", "assistant", "ann", "system"][t % 4], f"text é😀 {t}") for t in range(11)]
    rows += [(2, 0, None, None), (2, 0, None, None), (2, None, "user", "x"), (None, 5, "user", ""), (3, 1, "system", "only")]
    rows += [(4, 0, "user", "same")] * 30 + [(4, 0, "ann", f"{i % 3}") for i in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", F.lit(1))
    got = rotation.rotate(df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, _rotated_by_hand(rows)))
    assert rotation.rotate(df.limit(0)).count() == 0


def test_pipeline_stages_chain(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.withColumn("Score", F.lit("x")).withColumn("kept", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, sf)
        assert out.columns == extra.columns, name
        assert stage(spark, extra.limit(0), sf).count() == 0, name
    tokens = corpus_pipeline.run(spark, sf)
    assert tokens.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and tokens.count() > 0


def test_different_pages_are_counted_exactly(spark):
    """Digests that agree in their last bits were taken for one page, so constant text of three pages stayed."""
    import xxhash

    body = "<body><div class='legal'>All rights kept.</div><div><p>Story {i} of day {i}.</p></div></body>"
    by_bit = defaultdict(list)
    for i in range(200):
        by_bit[xxhash.xxh64_intdigest(body.format(i=i)) % 62].append(i)
    alike = next(v for v in by_bit.values() if len(v) >= 3)[:3]
    rows = [(i, "http://h/x", body.format(i=i)) for i in alike]
    for parts in (1, 3):
        pages = _pages(spark, rows + rows).repartition(parts, "page_id")
        assert {r.page_id: r.text for r in templates.extract(pages).collect()} == {i: f"Story {i} of day {i}." for i in alike}
        assert {r.different for r in templates.token_counts(pages).collect()} == {3}
    two = _pages(spark, rows[:2] * 4).repartition(3)
    assert {r.different for r in templates.token_counts(two).collect()} == {2}
