"""Mixing, chat formatting, page extraction and the pipeline."""

import hashlib
import itertools
import random
import re
import sys
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from lanecraft.llm import chat, dom, mixing, wrapper
from lanecraft.llm import queries as Q
from lanecraft.llm.common import prepare
from tests.llm.util import DOCS, WORD, near_pairs, repeats, roots, table

SF = "/root/testdata/sf0.01"


# ── mixing ───────────────────────────────────────────────────────────────────

def test_targets_water_filling():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}, share=1.0) == {"a": 150.0, "b": 50.0, "c": 100.0}
    got = mixing.targets({"a": 10, "b": 1000, None: 5, "c": 1000})
    assert got["a"] == 20.0 and got[None] == 10.0 and sum(got.values()) == pytest.approx(1.5 * 2015)
    assert all(got[s] <= 2 * n for s, n in {"a": 10, "b": 1000, None: 5, "c": 1000}.items())
    assert mixing.by_code_point(["b", None, "Z", "é", "a"]) == ["Z", "a", "b", "é", None]
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_flow_is_a_cheapest_full_flow():
    """Against enumeration over all integer routings of small networks."""
    rng = random.Random(1)
    for _ in range(25):
        supply = {p: rng.randrange(0, 4) for p in rng.sample([("a",), ("b",), ("a", "b")], 2)}
        quota = {s: rng.randrange(0, 6) for s in ("a", "b")}
        got = mixing.min_cost_flow(supply, quota)
        arcs = list(got)
        value = lambda f: (sum(f.values()), -sum(max(0, sum(n for (q, _), n in f.items() if q == p) - supply[p]) for p in supply))
        best = (-1, 0)
        for flow in itertools.product(*[range(2 * supply[p] + 1) for p, _ in arcs]):
            f = dict(zip(arcs, flow))
            if all(sum(n for (q, _), n in f.items() if q == p) <= 2 * supply[p] for p in supply) and all(
                    sum(n for (_, s), n in f.items() if s == t) <= quota[t] for t in quota):
                best = max(best, value(f))
        assert value(got) == best


def test_flow_of_many_sources():
    """20,000 sources in 10,000 networks of their own, each like the flow of that network alone, in seconds."""
    rng = random.Random(2)
    supply, quota = {}, {}
    for k in range(10_000):
        a, b = f"a{k}", f"b{k}"
        supply |= {(a,): rng.randrange(50), (a, b): rng.randrange(50)}
        quota |= {a: rng.randrange(120), b: rng.randrange(80)}
    begin = time.time()
    got = mixing.min_cost_flow(supply, quota)
    assert time.time() - begin < 30 and len(got) == 30_000
    for k in range(0, 10_000, 997):
        a, b = f"a{k}", f"b{k}"
        alone = mixing._cheapest({p: supply[p] for p in ((a,), (a, b))}, {s: quota[s] for s in (a, b)}, 2)
        assert alone == {key: got[key] for key in alone}


def test_mix_meets_its_targets(spark):
    got = Q.op7_source_mix(spark, SF).toPandas().merge(table(SF, "documents"), on="doc_id")
    assert (got["size"] == [len(WORD.findall(t)) for t in got.text]).all() and len(got) == 1000
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), all=("source_size", "first"), size=("size", "sum"))
    assert (by["all"] == by["size"]).all() and by.target.sum() == pytest.approx(1.5 * by["size"].sum())
    assert ((by.taken - by.target).abs() <= 0.03 * by.target + 5).all()
    again = Q.op7_source_mix(spark, SF).toPandas().merge(table(SF, "documents"), on="doc_id")
    key = ["doc_id", "taken"]
    assert got[key].sort_values("doc_id").reset_index(drop=True).equals(again[key].sort_values("doc_id").reset_index(drop=True))


def test_mix_edge_rows_and_overlapping_sources(spark):
    prepare(spark)
    rows = [(i, "w " * (i % 7), None if i % 5 == 0 else f"s{i % 3}") for i in range(300)] + [(1000, None, "s0"), (1001, "", None), (7, "w " * 7, "s1"), (None, "a b", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as id", "3 as h", "4 as pattern", "5 as copies")
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows)
    own = pd.DataFrame([r.asDict() for s in got.sources for r in s[:1]])
    got = pd.concat([got.reset_index(drop=True), own], axis=1)
    taken = (got["size"] * got.copies).groupby(got.source, dropna=False).sum()
    target = got.groupby("source", dropna=False).target.first()
    assert ((taken - target).abs() <= 6).all() and got.copies.between(0, 2).all()
    assert mixing.mix(df.limit(0)).count() == 0
    several = df.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).when(F.col("doc_id") % 3 == 0, F.array(F.lit("y"))).otherwise(F.array(F.lit("x"))))
    both = mixing.mix(several).toPandas()
    quota = {(tuple(x.source for x in s), x.source): x.quota for s in both.sources for x in s}
    goal = {x.source: x.target for s in both.sources for x in s}
    for s in ("x", "y"):
        assert abs(sum(n for (_, t), n in quota.items() if t == s) - goal[s]) <= 1
    assert abs((both["size"] * both.copies).sum() - sum(quota.values())) <= 10


def shortfall(spark, sizes, share):
    """Words missing at the one source's target, and the sizes of the documents not taken."""
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n int").selectExpr("doc_id", "repeat('w ', n) as text", "'s' as source")
    got = mixing.mix(df, share=share, repeats=1).toPandas()
    left = got.sources[0][0].target - (got["size"] * got.copies).sum()
    assert left >= -0.5 and len(got) == len(sizes)
    return left, got["size"][got.copies == 0]


def test_mix_skips_what_overshoots(spark):
    """A very long document, or many of one size at the cut, leaves no quota open that other documents can fill."""
    prepare(spark)
    for sizes, share in (([100_000, *[100] * 1000], 0.75), ([100_000, *[100] * 1000], 0.4), ([900] * 40 + [400] * 40 + [7] * 3000, 0.5),
                         ([2000 - 50 * i for i in range(30)] + [1] * 2000, 0.6), ([3] * 10 + [10_000], 0.5)):
        left, others = shortfall(spark, sizes, share)
        assert left < others[others > 0].min() and (left <= 100 or max(sizes) == 10_000), (share, left)


def test_mix_cut_goes_on_behind_long_documents(spark):
    """First fit in hash order: also documents short of the long ones are skipped when they overshoot."""
    prepare(spark)
    left, others = shortfall(spark, [90 + i % 11 for i in range(3000)] + [1 + i % 5 for i in range(300)], 0.5)
    assert left < others.min() <= 5
    assert mixing.choose_long([(1, 0, 10, 10), (2, 0, 90, 90)], 95, 5) == [(2, 0, 90, 90)]
    assert mixing.choose_long([(1, 0, 500, 500)], 400, 1000) == []


def test_mix_keeps_every_row_of_odd_sources(spark):
    """Control characters, quotes, backslashes and separators in source names: no row is lost, targets are met."""
    prepare(spark)
    names = [f"s{chr(c)}x" for c in [*range(1, 32), 127, 0x2028, 0x2029, 0x85, 0x1F600]] + ['"', "\\", "\\u001b", "</s>", " ", ""]
    rows = [(i, "w " * (5 + i % 7), "en", names[i % len(names)], 0) for i in range(40 * len(names))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    own = got.select("doc_id", F.inline("sources"), (F.col("size") * F.col("copies")).alias("taken")).toPandas()
    assert sorted(own.doc_id) == list(range(len(rows)))
    assert set(own.source) == set(names)
    by = own.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.taken - by.target) <= 11).all()


def test_mix_writes_a_large_plan(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(mixing, "PLAN_BYTES", 10)
    rows = [(i, "w " * (1 + i % 5), "en", f"s{i % 3}", 0) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    large = {(r.doc_id, r.copies) for r in mixing.mix(df).collect()}
    monkeypatch.undo()
    assert large == {(r.doc_id, r.copies) for r in mixing.mix(df).collect()} and len(large) == 90


# ── chat formatting ──────────────────────────────────────────────────────────

def brute_chat(rows):
    """{conv: (n_turns, sha, loss_chars, loss sha)} from rows (conv, turn, role, text)."""
    out = {}
    key = lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")
    for conv, own in itertools.groupby(sorted(rows, key=key), key=lambda r: r[0]):
        own = list(own)
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def chat_rows():
    rng = random.Random(4)
    pool = ["</s>", "<s>[INST] ", "\\", "\\\\", "[/INST]", "\\[INST]", "hello there", "é日本", "\n", " ", "\U0001F600", "word " * 30]
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 30)):
            role = "system" if turn == 0 and conv % 3 == 0 else rng.choice(["user", "assistant", "tool\\", "a [/INST] b"])
            rows.append((conv, turn, role, "".join(rng.choice(pool) for _ in range(rng.randrange(12)))))
    rows += [(50, 0, None, None), (50, 1, "assistant", None), (50, None, "user", "x"), (51, 0, "assistant", "same"), (51, 0, "assistant", "same"),
             (None, 0, "user", "q"), (None, 1, "assistant", "a"), (52, 0, "assistant", "long " * 20_000), (52, 1, "user", "after"), (52, 2, "assistant", "end")]
    return rows


def test_chat_round_trip_and_windows(spark):
    prepare(spark)
    rows = chat_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as conv", "2 as window", "3 as body", "4 as cost")
    span, history = 100, 40
    made = chat.windows(df, span=span, history=history)
    got = {r["conv"]: tuple(r)[1:5] for r in chat.digests(made).collect()}
    assert got == brute_chat(rows)
    for r in made.collect():
        turns = chat.read_turns(r["formatted"])
        assert len(turns) == r["n_repeated"] + r["n_new"] and r["n_new"] > 0
        new = turns[r["n_repeated"]:]
        assert [(a, b) for role, _, a, b in new if role == "assistant"] == [tuple(x) for x in r["loss"]]
        cost = [len(re.findall(r"\w+|[^\w\s]", t, re.A)) + 1 for _, t, _, _ in new]
        assert sum(cost[:-1]) < span
        old = turns[:r["n_repeated"]]
        if r["conv"] is not None and r["conv"] < 40 and r["conv"] % 3 == 0 and r["window"] > 0:
            assert old[0][0] == "system"
            old = old[1:]
        assert sum(len(re.findall(r"\w+|[^\w\s]", t, re.A)) + 1 for _, t, _, _ in old[:-1]) <= history
    assert chat.digests(chat.windows(df.limit(0))).count() == 0


def test_every_later_window_repeats_the_turn_before(spark):
    """Turns of 700, 3,000, 250, 600, 260 and 1 words: the windows after the long answer hold it, and so on."""
    prepare(spark)
    sizes = [700, 3000, 250, 600, 260, 1]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k} " + "w " * (n - 1)) for k, n in enumerate(sizes)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("window").collect()
    seen = -1
    for r in made:
        turns = [int(t[1].split()[0][1:]) for t in chat.read_turns(r["formatted"])]
        new = turns[r["n_repeated"]:]
        assert new[0] == seen + 1 and (not turns[:r["n_repeated"]] if seen < 0 else turns[r["n_repeated"] - 1] == seen)
        seen = new[-1]
    assert seen == 5 and len(made) >= 4


def test_chat_query_formats_the_table(spark):
    t = table(SF, "conversations")
    rows = list(t[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None)) + [(-7, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))]
    got = {r["conv_id"]: tuple(r)[1:5] for r in Q.op4_chat_format(spark, SF).collect()}
    assert got == brute_chat(rows)


# ── pages ────────────────────────────────────────────────────────────────────

def page(host, k, body, extra=""):
    return f"""<!DOCTYPE html><html><head><title>Page {k}</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body class="b-{k}">
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li><li>More</li></ul></nav><div id="cookie-notice">We use cookies {k}</div>
<div class="wrap"><div class="main-{k}"><p class="tagline">Best site ever</p>{body}{extra}</div><div class="sidebar">Side {k}</div></div>
<form><p>Your name</p><input></form><section class="comments"><p>Nice {k}!</p></section><footer>&copy; {host} {k}</footer></body></html>"""


PAGES = [(i, f"https://one.example/{i}", page("one", i, f"<h1>Title {i}</h1><p>First  text\n{i} &amp; <b>bold</b>&nbsp;x<p>Second<br>line {i}<div class='ad'>Buy</div>")) for i in range(8)]
PAGES += [(100, "http://two.example/a", "<article><h1>Solo</h1><p>Only page &lt;tag&gt; &eacute; &#233; &notanentity;</p><aside>x</aside></article><div>Not this</div>"),
          (101, None, "plain text only"), (102, "http://two.example/b", None), (103, "odd", ""), (104, "http://three.example/", "<p>Cut off in a <b"),
          (105, "http://three.example/2", "<div>" * 3000 + "deep" + "</div>" * 3000), (106, "http://three.example/3", "<p>one</p><p>two</p><!-- no --><p>three</p><di")]


def test_wrapper_extracts_main_text(spark):
    prepare(spark)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as id", "2 as host", "3 as text", "4 as wrapper")
    got = wrapper.main_text(df.unionByName(df.limit(0))).toPandas().set_index("page_id")
    for i in range(8):
        assert got.text[i] == f"Title {i}\nFirst text {i} & bold x\nSecond line {i}", got.text[i]
    assert got.text[100] == "Solo\nOnly page <tag> é é &notanentity;".replace("&not", "¬")
    assert got.text[101] == "plain text only" and got.text[102] == "" and got.text[103] == "" and got.text[105] == "deep"
    assert got.text[104] == "Cut off in a" and got.text[106] == "one\ntwo\nthree"
    assert (got.n_chars == got.text.str.len()).all() and got.url[101] is None
    assert wrapper.main_text(df.limit(0)).count() == 0


def test_wrapper_with_long_comments_and_no_article(spark):
    """Unmarked long replies beside the content: the named container wins."""
    prepare(spark)
    rows = []
    for i in range(6):
        talk = "".join(f"<div class='x'><p>reply {i} {j} " + "blah " * 20 + "</p></div>" for j in range(3))
        rows.append((i, "https://c.example/", f"<html><body class='post'><div id='top'>Menu</div><div class='post-content'><h2>T{i}</h2><p>" + f"word{i} " * 120
                     + f"</p></div><div id='talk'>{talk}</div><div class='site-footer'>F{i}</div></body></html>"))
    got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas().set_index("page_id")
    for i in range(6):
        assert got.text[i] == f"T{i}\n" + " ".join([f"word{i}"] * 120)


def test_wrapper_of_copies_keeps_content(spark):
    """A host whose pages carry the same article several times: content must not be taken for template."""
    prepare(spark)
    same = page("h", 1, "<h1>Same</h1><p>Text that all copies share.</p>")
    rows = [(i, "https://h.example/x", same) for i in range(10)] + [(10, "https://h.example/y", page("h", 2, "<h1>Other</h1><p>Another text.</p>"))]
    got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    assert (got[got.page_id < 10].text.str.contains("Text that all copies share")).all()


def read_pages(bodies):
    """Texts of pages of one host."""
    found = wrapper.induce(pages := [f"<html><body><header>Site</header><nav>Home</nav>{b}<footer>F{i}</footer></body></html>" for i, b in enumerate(bodies)])
    return [wrapper.extract(p, found) for p in pages]


def test_wrapper_keeps_headline_beside_the_body():
    text = [f"<p>Body {i} " + f"w{i} " * 50 + "</p>" for i in range(6)]
    want = [f"Title {i}\nBody {i} " + " ".join([f"w{i}"] * 50) for i in range(6)]
    for outer in ("<article>{}</article>", "<main>{}</main>", "<div class='post'>{}</div>", "<div>{}</div>"):
        for head in ("<h1>Title {}</h1>", "<header><h1>Title {}</h1></header>"):
            if outer == "<div>{}</div>" and "header" in head:  # a header outside of any article is the site's
                continue
            got = read_pages([outer.format(head.format(i) + f"<div class='entry-content'>{x}</div>") for i, x in enumerate(text)])
            assert got == want, (outer, head, got[0])
    got = read_pages([f"<h1>Title {i}</h1><article>{x}</article><div>Not this {i}</div>" for i, x in enumerate(text)])
    assert all(g.startswith(w) for g, w in zip(got, want))


def test_wrapper_of_a_host_with_several_layouts(spark):
    """A rare layout that the majority's path fits, but whose article lies elsewhere."""
    prepare(spark)
    rows = [(i, "https://l.example/", f"<html><body><div><p>Major {i} {f'a{i} ' * 30}</p></div><div><p>Same on all</p></div></body></html>") for i in range(60)]
    rows += [(100 + i, "https://l.example/", f"<html><body><div><p>Lead {i}</p></div><section><h1>Minor {i}</h1><p>{f'b{i} ' * 30}</p></section></body></html>") for i in range(5)]
    rows += [(200 + i, "https://l.example/", f"<html><body><div><p>Lead {i}</p></div><div class='x'><p>Rare {i}</p><p>{f'c{i} ' * 30}</p></div></body></html>") for i in range(2)]
    got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas().set_index("page_id").text
    for i in range(60):
        assert f"Major {i} " in got[i]
    for i in range(5):
        assert got[100 + i] == f"Lead {i}\nMinor {i}\n" + " ".join([f"b{i}"] * 30), got[100 + i]
    for i in range(2):
        assert got[200 + i] == f"Lead {i}\nRare {i}\n" + " ".join([f"c{i}"] * 30), got[200 + i]


def test_wrapper_checks_every_page():
    """The sample says one node; a page of the same layout has more beside it, or most of its text elsewhere."""
    usual = "<html><body><div class='intro'><p>Welcome to us</p></div><div class='box'><p>Text {0} " + "w{0} " * 30 + "</p></div></body></html>"
    found = wrapper.induce([usual.format(i) for i in range(8)])
    assert wrapper.extract(usual.format(9), found) == "Text 9 " + " ".join(["w9"] * 30)
    for lead, text in (("A lead of its own", "Text"), ("An article " + "of many words " * 9, "short")):
        odd = f"<html><body><div class='intro'><p>{lead}</p></div><div class='box'><p>{text}</p></div></body></html>"
        assert wrapper.layout(dom.parse(odd)) == wrapper.layout(dom.parse(usual))
        assert wrapper.extract(odd, found) == f"{lead.strip()}\n{text}"


def test_wrapper_keeps_sections_with_generated_anchors():
    parts = ("<h2 id='related-work'>Related {0}</h2>", "<h2 id='discussion'>Discuss {0}</h2>", "<section id='search'><p>Search {0}</p></section>",
             "<p class='form-text'>Form {0}</p>", "<div class='section' id='notice'><p>Notice {0}</p></div>", "<p id='share'>Share {0}</p>",
             "<blockquote class='comment'>Quote {0}</blockquote>", "<div class='menu-card'>Dish {0}</div>")
    gone = "<div class='ad'>Buy {0}</div><ul class='related'><li>Other {0}</li></ul><div id='comments'>Nice {0}</div><p hidden>Secret {0}</p><form>Ask {0}</form>"
    want = ["Related {0}", "Discuss {0}", "Search {0}", "Form {0}", "Notice {0}", "Share {0}", "Quote {0}", "Dish {0}"]
    for outer in ("<article>{}</article>", "<main><div>{}</div></main>", "<div class='post-body'>{}</div>"):
        got = read_pages([outer.format("".join(parts) + gone).format(i) for i in range(6)])
        assert got == ["\n".join(want).format(i) for i in range(6)], (outer, got[0])
    got = read_pages([f"<h2 id='related-work'>Related {i}</h2><p class='form-text'>Form {i}</p><div class='comment-list'>Nice {i}</div>" for i in range(6)])
    assert got == [f"Related {i}\nForm {i}" for i in range(6)]


def test_wrapper_keeps_bodies_in_two_parts():
    for outer in ("<article>{}</article>", "<div class='wrap'>{}</div>", "{}"):
        for a, b in (("class='post-body'", "class='post-extra'"), ("class='post-body'", "class='more'"), ("class='x'", "class='y'"), ("", "id='y'")):
            got = read_pages([outer.format(f"<div {a}><p>first {i} {'one ' * 55}</p></div><div {b}><p>second {i} {'two ' * 12}</p></div>") for i in range(6)])
            assert got == [f"first {i} {('one ' * 55).strip()}\nsecond {i} {('two ' * 12).strip()}" for i in range(6)], (outer, a, got[0])


def reference_text(html):
    """The given pages' article, read by their fixed layout."""
    import html as H
    inner = re.search(r"(?s)<article>(.*?)(</article>|\Z)", html)[1]
    blocks = (" ".join(H.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_wrapper_on_the_table(spark):
    got = Q.op9_wrapper_text(spark, SF).toPandas().merge(table(SF, "pages"), on="page_id")
    assert len(got) == 250 and (got.text == got.html.map(reference_text)).all()


ARTICLE = "<article><h1>Title {k}</h1><p>First text {k} here</p><p>Second one {k}</p></article>"


def plain_page(k, cls="", depth=0, box=None):
    body = "<div>" * depth + ARTICLE.format(k=k) + "</div>" * depth
    body = f"<div class='{box}'>{body}</div>" if box else body
    return f"<html><body class='{cls}'><div class='menu'>Menu</div>{body}<div class='site-footer'>Foot</div></body></html>"


def read_all(pages):
    made = wrapper.induce(pages)
    return [wrapper.extract(p, made) for p in pages]


@pytest.mark.parametrize("cls", ["has-sidebar", "right-sidebar page", "no-cookie", "search-results", "with-sidebar", "site has-footer", "share-page", "search"])
def test_layout_words_around_an_article_drop_nothing(cls):
    want = [f"Title {k}\nFirst text {k} here\nSecond one {k}" for k in range(8)]
    assert read_all([plain_page(k, cls) for k in range(8)]) == want
    if cls != "search":
        assert read_all([plain_page(k, box=cls) for k in range(8)]) == want
    assert wrapper.extract(plain_page(3, cls), wrapper.induce([])) == want[3]


def test_words_still_drop_other_parts():
    page = "<body><main><h1>T</h1><p>a</p></main><div class='comment-list'><article class='comment-body'><p>Nice</p></article></div>" \
        "<div class='related-posts'><article><p>x</p></article><article><p>y</p></article></div><div class='site-footer'>f</div></body>"
    assert wrapper.extract(page, wrapper.induce([])) == "T\na"


@pytest.mark.parametrize("depth", [5, 45, 1500])
def test_articles_lie_at_any_depth(depth):
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(wrapper.DEEP)
    try:
        assert read_all([plain_page(k, depth=depth) for k in range(6)]) == read_all([plain_page(k) for k in range(6)])
    finally:
        sys.setrecursionlimit(limit)


def test_constant_sentences_inside_an_article_stay():
    pages = [f"<body><article><h1>T {k}</h1><p>Same lead sentence</p><p>Own {k}</p><ul><li>Same point</li><li>Own {k}</li></ul></article></body>" for k in range(8)]
    assert read_all(pages) == [f"T {k}\nSame lead sentence\nOwn {k}\nSame point\nOwn {k}" for k in range(8)]


def test_the_table_with_layout_words_on_every_body(spark):
    pages = spark.createDataFrame(table(SF, "pages"))
    marked = pages.withColumn("html", F.regexp_replace("html", "<body([^>]*)>", '<body class="post has-sidebar">'))
    prepare(spark)
    want = {r.page_id: r.text for r in wrapper.main_text(pages).collect()}
    assert {r.page_id: r.text for r in wrapper.main_text(marked).collect()} == want and any(want.values())


def test_pages_with_one_id_or_none(spark):
    prepare(spark)
    rows = [(i, f"http://h.example/{i}", plain_page(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(r.text for r in wrapper.main_text(df).collect())
    for ids in (F.lit(7).cast("long"), F.lit(None).cast("long")):
        got = wrapper.main_text(df.withColumn("page_id", ids).unionByName(df.limit(3).withColumn("page_id", ids)))
        assert sorted(set(r.text for r in got.collect())) == want and got.count() == 33


def random_tree(rng, depth):
    node = dom.Node(rng.choice("abc"))
    node.kids = [random_tree(rng, depth - 1) for _ in range(rng.randrange(4))] if depth else []
    return node


def plain_match(a, b):
    """The largest match of equal roots that keeps order and parents, by trying all sub-sequences."""
    if a.sig != b.sig:
        return 0
    best = 0
    for n in range(min(len(a.kids), len(b.kids)) + 1):
        for x in itertools.combinations(a.kids, n):
            for y in itertools.combinations(b.kids, n):
                parts = [plain_match(p, q) for p, q in zip(x, y)]
                best = max(best, sum(parts)) if all(parts) else best
    return 1 + best


def test_tree_matching_equals_brute_force():
    rng = random.Random(6)

    def whole(node):  # a shape without folded runs
        s = wrapper.Shape(node, 1, "", 0)
        s.kids = [whole(k) for k in node.kids]
        return s

    for _ in range(150):
        a, b = whole(random_tree(rng, 2)), whole(random_tree(rng, 2))
        assert wrapper.match(a, b, {}) == plain_match(a, b)


def test_tree_matching_aligns_children():
    a, b = (wrapper.shape(dom.parse(h)) for h in ("<div><h1>a</h1><p>x</p><ul></ul></div>", "<div><h1>b</h1><em>e</em><ul></ul></div>"))
    assert wrapper.match(a, b, {}) == 4  # root, div, h1, ul
    wrapper.merge(a, b, {})
    kids = a.kids[0].kids
    assert [k.sig for k in kids] == ["h1", "p", "em", "ul"] or [k.sig for k in kids] == ["h1", "em", "p", "ul"]
    assert kids[0].texts == {"a", "b"} and kids[0].seen == 2


# ── pipeline ─────────────────────────────────────────────────────────────────

def test_pipeline_stages(spark):
    rows = [(1, "Hello there my friend of the house and the garden", "en", "a", 0), (2, None, "en", "a", 0), (3, "123 !!", None, "b", 0),
            (4, "hello THERE my friend of the house and the garden", "en", "b", 0), (4, "hello THERE my friend of the house and the garden", "en", "b", 0),
            (5, "bonjour le monde et la maison dans le jardin " * 3, "fr", None, 0), (None, "no id but some words here", "en", "c", 0)]
    prepare(spark)
    docs = spark.createDataFrame(rows, DOCS)
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = step(spark, docs, SF)
        assert docs.columns == before.columns, name
        kept = {r["doc_id"] for r in docs.collect()}
        if name == "language_id":
            assert kept == {1, 4, 5, None}
        elif name == "minhash_dedup":
            assert kept == {1, 5, None} and docs.count() == 3
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
    empty = spark.createDataFrame([], DOCS)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, SF).count() == 0


def test_pipeline_against_brute_force(spark):
    """Each stage on its predecessor's result, compared with plain Python where it has one answer."""
    prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    one = steps["language_id"](spark, docs, SF).toPandas()
    assert set(one.doc_id) == {r["doc_id"] for r in docs.select("doc_id", "text").collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    two = steps["minhash_dedup"](spark, spark.createDataFrame(one, DOCS), SF).toPandas()
    one = one.sort_values("doc_id")
    ids = one.doc_id.tolist()
    assert sorted(two.doc_id) == sorted(set(roots(ids, list(near_pairs(one.text.tolist(), 80)))))
    three = steps["suffix_dedup"](spark, spark.createDataFrame(two, DOCS), SF).toPandas()
    two = two.sort_values("doc_id")
    want = {i: w for i, w in zip(two.doc_id, repeats(two.text, keep="first"))}
    assert {i: t.encode() for i, t in zip(three.doc_id, three.text)} == {i: w[4].decode("utf-8", "ignore").encode() for i, w in want.items() if w[4] or not w[1]}
    assert (three.n_chars == three.text.str.len()).all()


def test_pipeline_keeps_rows_without_or_with_repeated_ids(spark):
    """Null and repeated ids through dedup, mix and packing: copies belong to rows."""
    prepare(spark)
    say = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(i, say(i), "en", f"s{i % 2}", 0) for i in range(1, 20)] + [(None, say(100 + i), "en", f"s{i % 2}", 0) for i in range(4)]
    rows += [(7, say(200), "en", "s1", 0), (7, say(201), "en", "s0", 0), (7, say(200), "en", "s1", 0),  # id 7: three texts, one of them twice
             (3, say(202), "en", "s0", 0), (50, say(202), "en", "s1", 0), (9, say(1), "en", "s1", 0)]  # 3 keeps its second text, 9 loses its copy of 1
    docs = spark.createDataFrame(rows, DOCS)
    two = corpus_pipeline.near_duplicates(spark, docs, SF)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in two.collect())
    want = {(i or 0, t) for i, t, *_ in rows} - {(50, say(202)), (9, say(1))}
    assert got == sorted(want)
    three = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(two.collect(), DOCS), SF)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in three.collect()) == got
    two = spark.createDataFrame(two.collect() + [(11, say(11), "en", "s1", 0)], DOCS)  # and a row that repeats wholly
    taken = corpus_pipeline.target_weights(spark, two, SF)
    four = taken.toPandas()
    copies = mixing.mix(two, whole=True).toPandas()
    assert len(four) == copies.copies.sum() and (copies.copies > 0).any()
    assert four.groupby("text").size().to_dict() == copies[copies.copies > 0].assign(text=lambda x: x.row.map(lambda r: r["text"])).groupby("text").copies.sum().to_dict()
    for source, own in copies.groupby(copies.sources.map(lambda x: x[0]["source"])):
        assert abs((own["size"] * own.copies).sum() - own.sources.iloc[0][0]["target"]) <= 40
        assert four[four.source == source].text.str.split().str.len().sum() == (own["size"] * own.copies).sum()
    assert {r.row["text"] for r in copies.itertuples() if pd.isna(r.doc_id) and r.copies} == set(four[four.doc_id.isna()].text) != set()
    packed = corpus_pipeline.pack(spark, taken, SF).toPandas()
    assert len(packed) == len(four) and packed.doc_id.isna().sum() == four.doc_id.isna().sum()


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_pipeline_of_ids_of_any_type_and_odd_columns(spark, kind):
    """One id with two texts, int and string ids, extra columns with dots and quotes in their names."""
    prepare(spark)
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["the", "house", "river", "old", "green", "walks", "and", "sees", "morning", "bread"]) + str(rng.randrange(50)) for _ in range(60))
    twice = text()
    rows = [(i, text()) for i in range(20)] + [(3, text()), (5, twice), (30, twice), (31, twice), (31, twice)]
    rows = [(i, t, "en", "s", len(t), "x", "y", "z") for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, n_chars long, `a.b` string, `c``d` string, row string")
    df = df.withColumn("doc_id", F.col("doc_id").cast(kind))
    docs = df
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, "")
        assert docs.columns == df.columns, name
        if name == "minhash_dedup":
            kept = [(r[0], r[1]) for r in docs.collect()]
            want = {(str(i), t) for i, t, *_ in rows if t != twice} | {(str(5 if kind != "string" else min("5", "30", "31")), twice)}
            assert len(kept) == len(want) and {(str(i), t) for i, t in kept} == want
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_entry_without_the_subpackage(tmp_path):
    """The entry point imports, and keeps its other queries, when the training-data parts are gone."""
    import pathlib
    import shutil
    import subprocess
    import sys
    root = pathlib.Path(E.__file__).parent
    shutil.copytree(root / "lanecraft", tmp_path / "lanecraft", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(k.startswith('op1') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in E.queries() if re.match(r"op\d+_", k)} and "pipeline" in E.queries()
