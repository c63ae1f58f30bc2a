"""Operators 1, 2, 6 and 10 against brute force and on odd rows."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from alertloom.llm.decontamination import contained_items, decontaminate
from alertloom.llm.html_text import extract_text, main_text
from alertloom.llm.line_dedup import drop_repeated_lines
from alertloom.llm.ngram_join import keep_one_of_each, ngram_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, cls long, size long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2) for i, t in rows], SCHEMA)


def tokens(text):
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(up, up.lower())))


def shingle_set(text):
    w = tokens(text)
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted((i if i is not None else -1, len(s), least.get(g) if s else i) for (i, s), g in zip(sets, group))


def copies(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = []
    base = [rng.choice(words) for _ in range(80)]
    shared = [rng.choice(words) for _ in range(60)]
    for i in range(n):
        kind = i % 4
        text = list(base) if kind == 0 else [rng.choice(words) for _ in range(rng.randint(1, 90))]
        if kind == 0:
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(80)] = f"x{rng.randrange(50)}"
        if kind == 1:
            text = shared + text[:30]
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = copies(seed, 60)
    rows += [(60, None), (61, ""), (62, " \t\n"), (63, "one"), (64, "ONE"), (65, "one two"), (66, rows[0][1]), (66, rows[0][1]), (67, rows[2][1].upper())]
    got = ngram_components(frame(spark, rows), sketch_bits=10).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_components_of_chains_without_a_common_leader(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):  # members are like their neighbours in the chain, far from its ends
        base[(7 * i) % 120] = f"c{i}"
        text = list(base)
        if i % 3 == 0:
            text[rng.randrange(120)] = f"d{i}"
        rows.append((i, " ".join(text)))
    rows = [(i, t) for i, t in rows if i % 10 != 7] + [(200 + i, " ".join(base[: 60 + i])) for i in range(20)]
    got = ngram_components(frame(spark, rows), sketch_bits=10).collect()
    expected = brute_components(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected
    assert len({c for _, _, c in expected}) > 1


def test_components_of_null_keys_and_long_texts(spark):
    long = " ".join(f"q{i}" for i in range(30_000))
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (5, "A b c d e f"), (9, long), (8, long + " end"), (None, "z y x w v u t")]
    got = ngram_components(frame(spark, rows), sketch_bits=10).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 5), (-1, 5), (5, 5), (8, 8), (9, 8)]
    assert {r.n_shingles for r in got if r.doc_id == 9} == {29_996}


def test_components_of_an_empty_table(spark):
    assert ngram_components(frame(spark, []), sketch_bits=10).count() == 0
    assert keep_one_of_each(frame(spark, []), sketch_bits=10).count() == 0


def test_one_of_each_stays(spark):
    a = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(3, a), (1, a + " u"), (1, a + " u"), (2, "other words stand here alone now"), (4, None), (4, None), (None, a)]
    docs = frame(spark, rows)
    got = keep_one_of_each(docs, sketch_bits=10)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == [(1, a + " u"), (2, rows[3][1]), (4, ""), (4, "")]


def test_contained_items_match_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate((1, 3, 5, 9, 14, 30, 59))] + [(7, None), (8, "")]
    docs = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 300))]
        if i % 3 == 0:
            item = tokens(items[rng.randrange(7)][1])
            if i % 2 and len(item) > 20:
                item[3] = "changed"
            at = rng.randint(0, len(text))
            text = text[:at] + item + text[at:]
        docs.append((i, " ".join(text)))
    docs += [(60, None), (61, "")]
    expected = set()
    for d, t in docs:
        w = tokens(t)
        for k, it in items:
            iw = tokens(it)
            n = min(5, len(iw))
            grams = {tuple(iw[j : j + n]) for j in range(len(iw) - n + 1)} if iw else set()
            own = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
            if grams and len(grams & own) >= 0.75 * len(grams):
                expected.add((d, k, len(grams), len(grams & own)))
    item_rows = spark.createDataFrame(items, "item_id long, text string")
    got = contained_items(frame(spark, docs), item_rows).collect()
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got} == expected
    assert len(got) == len(expected)
    kept = {r.doc_id for r in decontaminate(frame(spark, docs), item_rows).collect()}
    assert kept == {d for d, _ in docs} - {d for d, *_ in expected}


def test_decontamination_of_null_keys_and_empty_tables(spark):
    item = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    docs = frame(spark, [(None, "x a b c d e f g y"), (None, "clean"), (2, "a b c d e f g"), (2, "a b c d e f g")])
    assert [r.text for r in decontaminate(docs, item).collect()] == ["clean"]
    assert contained_items(docs, item).count() == 3
    assert contained_items(docs, item.limit(0)).count() == 0
    assert contained_items(frame(spark, []), item).count() == 0


def brute_line_dedup(docs, least=50):
    first, gone = {}, {}
    for key, text in sorted(docs):
        lines = [(i, x.strip(" "), len(tokens(x))) for i, x in enumerate(text.split("\n")) if tokens(x)]
        runs = []
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(x[2] for x in lines[a : b + 1]) >= least:
                    runs.append((a, b))
                    break
        for b in range(len(lines)):
            for a in range(b, -1, -1):
                if sum(x[2] for x in lines[a : b + 1]) >= least:
                    runs.append((a, b))
                    break
        for a, b in sorted(set(runs)):
            content = tuple(x[1] for x in lines[a : b + 1])
            at = (key, lines[a][0])
            if first.setdefault(content, at) != at:
                gone.setdefault(key, set()).update(x[0] for x in lines[a : b + 1])
    return {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(k, ())) for k, t in docs}


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(9)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([3, 12, 20, 55]))) for _ in range(25)]
    passage = [pool[0], pool[3], pool[5], pool[7], pool[9]]
    docs = []
    for i in range(30):
        lines = [f"{i} {rng.random()} own" for _ in range(rng.randint(0, 6))] + ([""] if i % 4 == 0 else [])
        if i % 2:
            at = rng.randint(0, len(lines))
            lines[at:at] = passage[rng.randint(0, 1) :]
        lines += [rng.choice(pool) for _ in range(3)]
        docs.append((i, "\n".join(lines)))
    got = {r.doc_id: r.text for r in drop_repeated_lines(frame(spark, docs)).collect()}
    assert got == brute_line_dedup(docs)


def test_line_dedup_of_odd_rows(spark):
    line = " ".join(f"v{i}" for i in range(60))
    docs = frame(spark, [(None, line), (1, line), (1, line), (2, None), (3, ""), (4, "\n\n"), (5, f"{line}\n{line}\nend")])
    got = sorted((r.doc_id or 0, r.text, r.n_lines_removed) for r in drop_repeated_lines(docs).filter("doc_id IS NULL OR doc_id <> 2").collect())
    assert got == [(0, line, 0), (1, "", 1), (1, "", 1), (3, "", 0), (4, "\n\n", 0), (5, "end", 2)]
    assert drop_repeated_lines(docs).filter("doc_id = 2").first().text is None
    assert drop_repeated_lines(frame(spark, [])).count() == 0


def test_line_dedup_of_long_texts_and_clashing_names(spark):
    long = "\n".join(" ".join(f"x{i}_{j}" for j in range(12)) for i in range(4000))
    docs = frame(spark, [(1, long), (2, "own start\n" + long + "\nown end")]).selectExpr("doc_id", "text", "1 AS _gone", "2 AS _k", "3 AS n_lines_removed", "4 AS _h")
    got = {r.doc_id: r for r in drop_repeated_lines(docs).collect()}
    assert got[1].text == long and got[2].text == "own start\nown end" and got[2].n_lines_removed == 4000
    assert (got[2]._gone, got[2]._k, got[2]._h) == (1, 2, 4)


def test_names_that_clash_in_filters(spark):
    docs = frame(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "clean words")]).selectExpr("doc_id", "text", "0 AS _leak", "0 AS _k", "0 AS _one", "0 AS _token")
    item = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontaminate(docs, item).columns == docs.columns and [r.doc_id for r in decontaminate(docs, item).collect()] == [3]
    one = keep_one_of_each(docs, sketch_bits=10)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == [1, 3]


def test_items_in_very_long_documents(spark):
    item = " ".join(f"i{k}" for k in range(20))
    long = " ".join(f"w{k}" for k in range(60_000))
    docs = frame(spark, [(1, f"{long} {item} {long}"), (2, long), (3, None)])
    items = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate(docs, items).orderBy("doc_id").collect()] == [2, 3]


PAGE = """<!doctype html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use <b>cookies</b></div>
<article><h1>Head &amp; line</h1><p>First   para<br>goes on&nbsp;here.<p>Second <i>par</i>a.<div class="ad">Buy!</div><ul><li>one</li><li>two</li></ul></article>
<aside>Side</aside><section id="comments"><p>Nice post!</p></section><form><input>Mail</form><footer>&copy; X</footer></body></html>"""


def test_main_text_keeps_the_article_only():
    assert main_text(PAGE) == "Head & line\nFirst para goes on here.\nSecond para.\none\ntwo"


def test_main_text_without_article_uses_the_line_distribution():
    body = "".join(f"<p>Sentence number {i} of the real text.</p>" for i in range(12))
    page = f"<div><a href=1>menu one</a></div><div><a href=2>menu two</a></div><div>{body}</div><div class='sidebar'>x</div><p>tiny</p>"
    assert main_text(page) == "\n".join(f"Sentence number {i} of the real text." for i in range(12))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav>open<article><p>A<p>B", "A\nB"),
        ("<article><p>a &lt; b &am c &amp d</article>", "a < b &am c & d"),
        ("<article><p>x</p><!-- <p>no</p> --><style>p{}</style></article>", "x"),
        ("plain", "plain"),
        ("<article><p>cut <b", "cut"),
    ],
)
def test_main_text_of_odd_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>A<img class="social-icon"> B</p><hr class="ad"><input type="hidden"><p>C</p></article>', "A B\nC"),
        ('<div><p>A</p><hr class="ad"><p>B</p></div>', "A\nB"),
        ('<div><p>A <svg class="x"/>B</p><math/><p>C</p><script src="s"/><p>D</p></div>', "A B\nC\nD"),
        ('<div><p>A</p><svg><g/><text>no</text></svg><p><a href=/x/>B</a> and so on</p></div>', "A\nB and so on"),
        ('<div><article><div class="ad">Buy!<p>more</article></div><main><p>A</p></main>', "A"),
        ('<article><section><div class="ad">Buy!</section><p>A</article>', "A"),
        ('<div><p>A</p></div><div class="ad">Buy!<p>B', "A\nB"),
    ],
)
def test_main_text_drops_only_the_tag_of_empty_elements_and_bounds_open_ones(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><div style="overflow:hidden">A</div><p data-id="menu" data-role="menu"><a href="/hidden-gems">B</a> C</p>'
         '<p><span title="a role=menu">D</span></p></article>', "A\nB C\nD"),
        ('<div class="content has-sidebar"><article><p>A</p></article><div class="sidebar">no</div></div>', "A"),
        ('<form id="aspnetForm"><nav>no</nav><article><p>A</p></article></form>', "A"),
        ('<form><p>A long text of the page.</p><p>And more of it.</p></form>', "A long text of the page.\nAnd more of it."),
        ('<article><h2 id="related-work">Related work</h2><p id="side-effects">None.</p><h2 id="comments">Comments</h2><p>B</p></article>',
         "Related work\nNone.\nComments\nB"),
        ('<main><article><p>A text.</p><div class="ad-slot">Buy!</div></article><div id="comments"><article>Nice.</article></div></main>',
         "A text."),
        ('<article><p>A</p></article><aside><article><a href=1>T</a></article></aside><p hidden>no</p>', "A"),
    ],
)
def test_main_text_reads_exact_attributes_and_keeps_what_holds_the_text(page, text):
    assert main_text(page) == text


LONG = "".join(f"<p>Sentence number {i} of the real text.</p>" for i in range(12))
LONG_TEXT = "\n".join(f"Sentence number {i} of the real text." for i in range(12))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div><h1>Head</h1><div class="ad">Buy!</div>{LONG}<div class="ad">Buy!</div><p>End.</p></div>', f"Head\n{LONG_TEXT}\nEnd."),
        (f"<div><p><a name=top>A</p>{LONG}</div>", f"A\n{LONG_TEXT}"),
        (f"<div><p>A <a href=1>b</p>{LONG}</div>", f"A b\n{LONG_TEXT}"),
        (f"<div><h2><a href=1>Head</a></h2><p>A</p><p><a href=2>All linked</a></p>{LONG}</div>", f"Head\nA\nAll linked\n{LONG_TEXT}"),
        (f"<div>{LONG}</div><div><article>Card</article></div><div><article>Other</article></div>", LONG_TEXT + "\nCard\nOther"),
        (f"<p>Short beside.</p><article>{LONG}</article>", LONG_TEXT),
    ],
)
def test_main_text_lets_the_window_sums_decide(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="page has-sidebar"><article><p>Main story text.</p></article></div>', "Main story text."),
        ('<article><p>A</p><h2 id="related-work">B</h2><p class="side-effects">C</p></article>', "A\nB\nC"),
        (f"<div>{LONG}<div class='ad'>Buy!</div><p>A closing paragraph of the text.</p></div>", f"{LONG_TEXT}\nA closing paragraph of the text."),
        (f"<div>{LONG}<p>See <a href=1>this long link to another page</a></p></div>", f"{LONG_TEXT}\nSee this long link to another page"),
        ("<article><!--><p>A</p><!-- x --!><p>B</p><!---><p>C</p></article>", "A\nB\nC"),
        ("<article>&am<b>p;</b></article>", "&amp;"),
        (f"<div>{LONG}</div><div><p>Another dense paragraph beside it.</p></div><ul>{'<li><a href=1>menu entry</a></li>' * 5}</ul>",
         f"{LONG_TEXT}\nAnother dense paragraph beside it."),
        ("<a href=1>all</a> <a href=2>links</a>", "all links"),
    ],
)
def test_main_text_drops_nothing_else(page, text):
    assert main_text(page) == text


class SlowPage(HTMLParser):
    """Text of the article by parser events: furniture elements are left out, blocks part lines."""

    blocks = {"p", "h1", "h2", "ul", "li", "div", "section", "article", "blockquote"}
    furniture = {"nav", "aside", "footer", "form", "script", "style", "header"}

    def __init__(self):
        super().__init__()
        self.open, self.lines = [], [""]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.lines[-1] += " "
            return
        self.open.append(tag in self.furniture or dict(attrs).get("class") == "ad")
        if tag in self.blocks:
            self.lines.append("")

    def handle_endtag(self, tag):
        if self.open.pop() or tag in self.blocks:
            self.lines.append("")

    def handle_data(self, data):
        if not any(self.open):
            self.lines[-1] += data


def random_block(rng, depth=0):
    words = " ".join(rng.choice(["one", "two&amp;", "&eacute;t", "<b>bold</b>", "x<br>y", "<i>in</i>side", "a  b\n c"]) for _ in range(rng.randint(1, 25)))
    kind = rng.choice(["p", "p", "p", "h2", "li", "div", "ad", "aside", "script"] if depth < 2 else ["p", "h2"])
    if kind == "li":
        return f"<ul>{''.join(f'<li>{words}</li>' for _ in range(3))}</ul>"
    if kind == "div":
        return f"<div>{''.join(random_block(rng, depth + 1) for _ in range(rng.randint(1, 3)))}</div>"
    if kind == "ad":
        return '<div class="ad">Buy this now!</div>'
    if kind == "script":
        return '<script>var a = "<p>no</p>";</script>'
    return f"<{kind}>{words}</{kind}>"


def test_main_text_matches_a_slow_parser():
    rng = random.Random(12)
    for _ in range(200):
        inside = f"<h1>Head</h1>{''.join(random_block(rng) for _ in range(rng.randint(1, 12)))}"
        slow = SlowPage()
        slow.feed(inside)
        article = rng.choice(["article", "main", "div"])
        page = f"<body><nav><a href=1>x</a></nav><{article}>{inside}</{article}><footer>&copy; all</footer></body>"
        assert main_text(page) == "\n".join(" ".join(x.split()) for x in slow.lines if x.strip()), page


def test_main_text_of_a_very_long_page():
    text = " ".join(f"w{i}" for i in range(50_000))
    assert main_text(f"<nav>x</nav><article>{''.join(f'<p>{text}</p>' for _ in range(4))}</article>") == "\n".join([text] * 4)


def test_extract_text_keeps_rows(spark):
    pages = spark.createDataFrame([Row(page_id=1, url="u", html=PAGE, text="clash"), Row(page_id=None, url=None, html=None, text=None)])
    got = extract_text(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, len(main_text(PAGE)))]
    assert extract_text(pages.limit(0)).count() == 0


def test_no_line_of_a_very_long_text_carries_its_text(spark):
    line = "array_join(transform(sequence(1, 55), j -> concat('w', (i * 7 + j * j) % 9973)), ' ')"
    long = spark.range(2).selectExpr("id AS doc_id", f"array_join(transform(sequence(1, 10000), i -> {line}), '\n') AS text")
    got = drop_repeated_lines(long)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [p for p in plan.split("\n") if "Generate" in p and "text#" in p]
    rows = {r.doc_id: (r.n_lines_removed, r.left) for r in got.selectExpr("doc_id", "n_lines_removed", "length(text) AS left").collect()}
    assert rows[1] == (10000, 0) and rows[0][0] == 10000 - 9973


def test_documents_of_one_template_form_no_pairs(spark):
    rng = random.Random(12)
    shared = [f"s{i}" for i in range(84)]
    rows = [(i, " ".join(shared + [f"u{i}x{k}" for k in range(20)])) for i in range(300)]
    # and some that are near copies of one of them, or of another size
    for i in range(0, 300, 15):
        words = rows[i][1].split()
        words[rng.randrange(100)] = "edit"
        rows.append((1000 + i, " ".join(words)))
        rows.append((2000 + i, " ".join(words[:80])))
    got = ngram_components(frame(spark, rows), sketch_bits=12).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_lists_of_a_template_are_left_out(spark):
    from alertloom.llm import ngram_join

    # eighty of a hundred shingles in common: each of these lists has members beyond the shorter prefix only
    lists = spark.range(500).selectExpr("7L AS h", "id AS cls", "100 AS n", "22 AS pos", "id AS part", "0L AS main", "0D AS outside")
    assert ngram_join._rest_of_pairs(lists, 75).count() == 0
    early = spark.range(500, 503).selectExpr("7L AS h", "id AS cls", "100 AS n", "3 AS pos", "id AS part", "0L AS main", "0D AS outside")
    early = lists.unionByName(early).withColumn("outside", F.lit(3.0))
    assert ngram_join._rest_of_pairs(early, 75).count() == 3
