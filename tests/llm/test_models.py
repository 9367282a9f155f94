"""Page texts, languages, quality, and the pipeline."""

import random
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casebook.llm import language, perplexity, wrappers
from tests.conftest import SMALL
from tests.llm.samples import documents, prose

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body>
<header><p>Site</p></header><nav><ul><li><a href="/a">Menu {k}</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="links"><a href="/1">One {k}</a> <a href="/2">Two</a></div><p>Constant line</p>
<article><h1>Head   {k}</h1><p>First&nbsp;&lt;b&gt; {k}<p><b>Second</b> {k}<br>more<ul><li>item {k}</li></ul>
<div class="comments"><p>A reader says {k}</p></div></article><aside>Side {k}</aside><form><p>Form</p></form><footer>&copy; {k}</footer></body></html>"""


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("template", F.lit(1))


def test_content_of_same_host_pages(spark):
    rows = [(k, f"https://Site.example/{k}", PAGE.format(k=k)) for k in range(5)]
    rows += [(90, None, None), (91, "https://site.example/x", ""), (None, "no url", "<p>Loose &eacute;"), (92, "http://one.example", "<article>Cut <b>off"), (92, "http://one.example", "<article>Cut <b>off")]
    got = sorted(map(tuple, wrappers.extract(_pages(spark, rows)).collect()), key=str)
    text = "Head {k}\nFirst <b> {k}\nSecond {k} more\nitem {k}"
    want = [(k, f"https://Site.example/{k}", t, len(t)) for k in range(5) for t in [text.format(k=k)]]
    want += [(90, None, "", 0), (91, "https://site.example/x", "", 0), (None, "no url", "Loose é", 7)] + [(92, "http://one.example", "Cut off", 7)] * 2
    assert got == sorted(want, key=str)


def test_two_hosts_of_few_pages_keep_what_no_alignment_can_tell(spark):
    got = wrappers.extract(_pages(spark, [(1, "http://a.example/", PAGE.format(k=1))])).first()
    assert got.text.startswith("Constant line\nHead 1\n")


def test_tree_matching_counts_the_largest_common_tree():
    left = wrappers.fold(wrappers.parse("<div><p>a</p><ul><li>b</li></ul><hr></div>"))
    right = wrappers.fold(wrappers.parse("<div><h1>x</h1><p>c</p><p>d</p><ul><li>e<b>f</b></li></ul></div>"))
    assert wrappers.match(left, right) == 5  # page, div, p, ul, li
    both = wrappers.unite(left, right)
    assert [c.label for c in both.children[0].children] == ["h1", "p", "ul", "hr"] and both.pages == 2
    assert wrappers.Slot.unpack(both.pack()).pack() == both.pack()


def test_pages_empty_and_long(spark):
    assert wrappers.extract(_pages(spark, []).where(F.lit(False))).count() == 0
    page = "<div>" * 300 + "deep" + "<p>x" * 20_000
    assert wrappers.extract(_pages(spark, [(1, "http://h/", page)])).first().text.startswith("deep\nx\nx")


def test_held_out_accuracy_and_undetermined(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "12 !"), (None, "La casa")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    both = docs.select("doc_id", "text", "lang").unionByName(odd).withColumn("score", F.lit("clash")).withColumn("at", F.lit(1)).withColumn("drawn", F.lit(1))
    model = language.train(both)
    got = language.identify(both, model)
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    assert {r.lang_pred for r in got.where("doc_id in (9001, 9002, 9003)").collect()} == {"und"}
    tested = got.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null")
    assert tested.where("lang = lang_pred").count() >= 0.9 * tested.count() > 0
    assert got.where(F.col("held_out") != F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))).count() == 0


def test_nothing_to_learn_from(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert language.train(docs) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def _brute(trusted):
    """Modified Kneser-Ney over dictionaries; a function to the log-probability of a text and its length."""
    top = Counter(p[i : i + 5] for t in trusted for p in ["\x02" * 4 + t + "\x03"] for i in range(len(t) + 1))
    counts = [top]
    while len(counts) < 5:
        counts.append(Counter(g[1:] for g in counts[-1]))
    counts = counts[::-1]
    letters, rules = len(counts[0]), []
    for table in counts:
        n = [sum(c == k for c in table.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [min(k - 0.01, max(0.05, k - (k + 1) * y * (n[k + 1] / n[k] if n[k] else 0.5))) for k in (1, 2, 3)]
        total, spare = Counter(), Counter()
        for gram, c in table.items():
            total[gram[:-1]] += c
            spare[gram[:-1]] += d[min(c, 3) - 1]
        rules.append((table, d, total, spare))

    def p(gram, order):
        if order == 0:
            return 1 / (letters + 1)
        table, d, total, spare = rules[order - 1]
        gram = gram[-order:]
        if not total[gram[:-1]]:
            return p(gram, order - 1)
        c = table[gram]
        return ((c - d[min(c, 3) - 1]) if c else 0) / total[gram[:-1]] + spare[gram[:-1]] / total[gram[:-1]] * p(gram, order - 1)

    def score(text):
        padded = "\x02" * 4 + text + "\x03"
        return math.exp(-sum(math.log(p(padded[i : i + 5], 5)) for i in range(len(text) + 1)) / (len(text) + 1))

    return score


@pytest.mark.parametrize("most", [3_000_000, 300])
def test_perplexity_matches_brute_force(spark, most, monkeypatch):
    """With the model in one shard and in many."""
    monkeypatch.setattr(perplexity.shards, "__defaults__", (most,))
    trusted = [prose(k, 40) for k in range(12)]
    tables = perplexity.fit(spark.createDataFrame([(t,) for t in trusted], "text string"))
    tested = [prose(50, 30), "QXZ unseen 漢字", "", "a"]
    docs = spark.createDataFrame([(k, "en", t) for k, t in enumerate([*tested, None])], "doc_id long, lang string, text string")
    got = {r.doc_id: r.perplexity for r in perplexity.perplexities(docs, tables).collect()}
    score = _brute(trusted)
    for k, t in enumerate([*tested, ""]):
        assert got[k] == pytest.approx(score(t), rel=1e-4)


def test_classifier_rejects_junk_and_keeps_trusted_text(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    judged = perplexity.judge(docs, labels).join(labels, "doc_id")
    good, bad = judged.where("quality = 1"), judged.where("quality = 0")
    assert good.where("accepted").count() >= 0.98 * good.count()
    assert bad.where("not accepted").count() >= 0.6 * bad.count()
    kept = perplexity.keep_accepted(docs, labels)
    assert kept.schema == docs.schema and 0 < kept.count() < docs.count()


def test_without_trusted_text_all_is_kept(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 0, 0), (None, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert perplexity.keep_accepted(docs, labels).count() == docs.count()
    none = docs.where(F.lit(False))
    assert perplexity.keep_accepted(none, labels).count() == 0


def test_pipeline_stages_hand_documents_on(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    schema, before = docs.schema, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.schema == schema, name
        docs = corpus_pipeline.stored(docs)
        assert docs.count() <= before
        before = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert out.count() == before == corpus_pipeline.run(spark, SMALL).count()
    texts = docs.select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256"))
    assert out.join(texts, "doc_id").where("decoded_sha256 = text_sha256").count() == before


def test_deep_and_differing_pages():
    deep = wrappers.parse("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after")
    assert wrappers.main_text("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after", wrappers.fold(deep)) == "deep\nafter"

    def nest(depth, side):
        return "" if not depth else f"<div class=a>{nest(depth - 1, side)}</div><{side}>x</{side}><div class=a></div>"

    one, two = (wrappers.fold(wrappers.parse(nest(40, side))) for side in ("p", "h2"))
    assert wrappers.match(one, two) > 80 and wrappers.unite(one, two).pages == 2


def _largest(a, b):
    """Simple tree matching stated by recursion over forests."""

    def forest(x, y):
        if not x or not y:
            return 0
        return max(forest(x[:-1], y), forest(x, y[:-1]), forest(x[:-1], y[:-1]) + _largest(x[-1], y[-1]))

    return 1 + forest(a.children, b.children) if a.label == b.label else 0


def test_matching_is_the_largest():
    rng = random.Random(4)

    def tree(depth):
        return wrappers.Slot(rng.choice("ab"), 1, 0, 0, 0, [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else [])

    for _ in range(200):
        a, b = tree(3), tree(3)
        assert wrappers.match(a, b) == _largest(a, b)


@pytest.mark.parametrize(
    "page",
    [
        "<div class='post-header'><h1>kept</h1></div>", "<article><div class=entry-header>kept</div></article>", "<div class='content has-sidebar'>kept</div>",
        "<div class='post comments-enabled'>kept</div>", "<section id=social-science>kept</section>", "<form><article>kept</article></form>",
        "<p title='a hidden gem'>kept</p>", "<article data-x='was hidden before'>kept</article>", "<div class=site-header>gone</div>kept", "<p hidden>gone</p>kept",
        "<div class='cookie-notice'>gone</div>kept", "<div id=adBox>gone</div>kept", "<form>gone</form>kept",
    ],
)
def test_only_names_that_say_a_role_leave_an_element_out(page):
    assert wrappers.main_text(page, None) == "kept"


def test_templates_keep_the_nodes_of_few_pages(spark):
    # Every page has an element of its own; all of them together are more than any fixed number of nodes.
    own = "".join(f"<div class=n{{k}}x{i}><b>w</b></div>" for i in range(400))
    links = "<div class=links><a href=/1>One {k}</a> <a href=/2>Two</a></div>"
    pages = [(k, "http://many.example/", f"<body>{own.format(k=k)}{links.format(k=k) if k == 0 else ''}<p>Text {k}</p></body>") for k in range(6)]
    template = None
    for _, _, page in pages:
        slot = wrappers.fold(wrappers.parse(page))
        template = slot if template is None else wrappers.unite(template, slot)
    body = template.children[0].children
    assert len(body) == 6 * 400 + 2 and [c.pages for c in body if c.label == "p"] == [6]
    got = {r.page_id: r.text for r in wrappers.extract(_pages(spark, pages)).collect()}
    assert "One" not in got[0] and got[0].endswith("Text 0")  # a list of links on one page of a large template


def test_alignment_leaves_out_labels_of_one_side_alone():
    rng = random.Random(9)

    def whole(left, right):
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + wrappers.match(a, b))
        pairs, i, j = [], len(left), len(right)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        return pairs[::-1]

    def tree(depth, labels):
        return wrappers.Slot(rng.choice(labels), 1, 0, 0, 0, [tree(depth - 1, labels) for _ in range(rng.randint(0, 4))] if depth else [])

    for _ in range(300):
        left, right = ([tree(2, labels) for _ in range(rng.randint(0, 6))] for labels in ("abcd", "abxy"))
        if [c.label for c in left] != [c.label for c in right]:
            assert wrappers.align(left, right) == whole(left, right)
