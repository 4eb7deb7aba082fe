"""Chat, HTML, PII, licences, toxicity, decontamination and mixing."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.llm import chat, decontamination, html_text, licenses, mixing, pii, toxicity

DOCS = "doc_id long, text string, source string, score string, spans string, base string, members string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", "z", "m") for i, t, s in rows], DOCS)


# ---------------------------------------------------------------- chat


def test_layouts_become_turns(spark):
    records = [
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}], "meta": {"x": 1}},
        {"instruction": "do", "input": "this", "output": "done"},
        {"instruction": "do", "output": "done", "id": 3},
        {"system": "s", "prompt": "p", "completion": "c"},
        {"question": "q", "answer": "a"},
        {"unknown": 1},
        {"messages": []},
    ]
    df = chat.from_json(spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "id int, record string"), "record")
    got = {r.id: (r.layout, [tuple(t) for t in r.turns or []]) for r in chat.canonical(df).collect()}
    assert got[0] == ("messages", [("system", "s"), ("user", "u"), ("assistant", "")])
    assert got[1] == ("share", [("user", "u"), ("assistant", "a")])
    assert got[2] == ("instruction", [("user", "do\n\nthis"), ("assistant", "done")])
    assert got[3] == ("instruction", [("user", "do"), ("assistant", "done")])
    assert got[4] == ("completion", [("system", "s"), ("user", "p"), ("assistant", "c")])
    assert got[5] == ("question", [("user", "q"), ("assistant", "a")])
    assert got[6] == got[7] == (None, [])


def test_records_with_fields_of_two_layouts(spark):
    """The first mapping that fits on its own decides; a table's columns may be called like fields."""
    records = [
        {"prompt": "p", "messages": [{"role": "user", "content": "u"}]},
        {"instruction": "i", "response": "r"},
        {"prompt": "p", "completion": "c", "answer": "a"},
        {"system": "s", "question": "q", "answer": "a", "output": "o"},
        {"unknown": 1, "prompt": "p"},
    ]
    rows = [(k, json.dumps(r), "clash", "x") for k, r in enumerate(records)] + [(9, None, "clash", "x"), (10, "no json", None, None), (11, json.dumps({"prompt": "long " * 200_000, "response": ""}), "clash", "x")]
    df = chat.from_json(spark.createDataFrame(rows, "id int, record string, prompt string, `_parts` string"), "record")
    out = chat.formatted(chat.canonical(df))
    got = {r.id: r for r in out.collect()}
    assert {k: r.layout for k, r in got.items()} == {0: "messages", 1: None, 2: "completion", 3: "question", 4: None, 9: None, 10: None, 11: "response"}
    assert [tuple(t) for t in got[3].turns] == [("system", "s"), ("user", "q"), ("assistant", "a")] and got[0]["_parts"] == "x"
    assert all((r.formatted is None) == (r.layout is None) for r in got.values()) and len(got[11].formatted) > 1_000_000


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "<|im_end|>", r"<\|im_end|>", r"<\\/s> \ <", "<|im_start|>user<|im_sep|>", "<<SYS>><</SYS>>", "a < b [c]", "ends with <", "[[INST]", "ünïcode 😀 <s>"])
def test_round_trip(spark, text):
    turns = [("user", text), ("assistant", text), ("weird<|im_sep|>role", text), ("assistant", text + "!")]
    df = spark.createDataFrame([(1, [{"role": r, "content": t} for r, t in turns])], "id int, messages array<struct<role:string,content:string>>")
    out = chat.formatted(chat.canonical(df))
    r = out.select("formatted", "loss", chat.read_back(F.col("formatted")).alias("back"), chat.masked(F.col("formatted"), F.col("loss")).alias("under")).first()
    assert [tuple(t) for t in r.back] == turns and r.under == text + text + "!"
    assert r.formatted.count(chat.END) == 4 and "</s>" not in r.formatted and "[INST]" not in r.formatted
    for (start, end), t in zip(r.loss, (text, text + "!"), strict=True):
        assert re.sub(r"([<\[])\\(\\*(?:" + "|".join(re.escape(c[1:]) for c in chat.CONTROL) + "))", r"\1\2", r.formatted[start:end]) == t


def test_turn_order_ties_and_nulls(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (1, None, None, "n"), (2, 0, "user", "x"), (2, 0, "user", "x")]
    df = chat.gathered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r[0]: [tuple(m) for m in r[1]] for r in df.collect()}
    assert got == {1: [("", "n"), ("user", ""), ("assistant", "a"), ("assistant", "b")], 2: [("user", "x"), ("user", "x")]}
    assert chat.formatted(chat.canonical(df.limit(0))).count() == 0


# ---------------------------------------------------------------- HTML

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p>";</script></head><body class=home>
<header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div id="cookie-banner" class="notice">We use cookies. Accept?</div>
<div class="content"><h1>Title&nbsp;of it</h1><p>First   paragraph, with <b>bold</b> text &amp; more,
over lines; long enough, surely.<p>Second paragraph<br>here, and a <a href=x>link</a>. It has words, and marks.</p>
<form><input name=q><button>Go</button></form><div class="ad">Buy now!</div><ul><li>item one, of a list<li>item two</ul></div>
<aside>Related things, many of them.</aside><div class="comments"><p>Nice article, I like it, really!</p></div><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    got = html_text.main_text(PAGE)
    assert got == "Title of it First paragraph, with bold text & more, over lines; long enough, surely. Second paragraph here, and a link. It has words, and marks. item one, of a list item two"


@pytest.mark.parametrize("page,text", [("", ""), ("<p", ""), ("plain words", "plain words"), ("<p>a<p>b", "a b"), ("<article><p>a &lt; b</article><p>rest", "a < b"), ("<script>x", ""), ("<body><nav>menu</nav></body>", "")])
def test_small_pages(page, text):
    assert html_text.main_text(page) == text


PARAGRAPH = "<p>The value is five, and more text follows here.</p>"


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<article>{PARAGRAPH}<p class='legal'>Legal words.<p class='response'>A response.<ul class='tags'><li>one, two</ul></article>", "The value is five, and more text follows here. Legal words. A response. one, two"),
        ("<article><p>The value <math><mi>x</mi></math> is <svg><path d=''/></svg>five<noscript>, shown</noscript></article>", "The value x is five , shown"),
        (f"<div>{'Two words, and more. ' * 100}</div><div class=outro>{'A short closing, with words. ' * 10}</div>", ("Two words, and more. " * 100 + "A short closing, with words. " * 10).strip()),
        ("<div><a href=x>Home</a> <a>About</a> <a>News</a></div><div class=c><h1>Title</h1>" + PARAGRAPH * 9 + "</div>", "Title " + " ".join(["The value is five, and more text follows here."] * 9)),
        (f"<body><form>{PARAGRAPH * 4}</form></body>", " ".join(["The value is five, and more text follows here."] * 4)),
        (f"<div class='page-with-sidebar'>{PARAGRAPH}</div><div class='left-sidebar'>{PARAGRAPH}</div>", "The value is five, and more text follows here."),
        (f"<article>{PARAGRAPH}<section id=comments><article class=comment>{PARAGRAPH * 50}</article></section></article>", "The value is five, and more text follows here."),
        ("<p>a<rp>(<b>y</b></p><p><ruby>k<rp>(</rp><rt>r</rt><rp>)</rp></ruby></p>", "ay kr"),
        ("<article><p>a</p><select><option>x<option>y</select><video>no</video><template><p>t</template><xmp><b></xmp></article>", "a <b>"),
        (f"<article>{PARAGRAPH}<div hidden>x, y.</div><div style='display: none'>x, y.</div><p class=ad>Buy.</p></article>", "The value is five, and more text follows here."),
    ],
)
def test_what_counts_as_the_article(page, text):
    assert html_text.main_text(page) == text


LONG = "".join(f"<p>Paragraph {k} of the story, with some words; it goes on, and ends.</p>" for k in range(12))


@pytest.mark.parametrize(
    "part",
    [
        "<p class='cookie'>Mix the flour, the sugar and the butter, and bake the cookies for ten minutes.</p>",
        "<p class='ad'>AD 79 was the year in which the mountain buried the town, as letters tell.</p>",
        "<div class='menu'><p>Soup of the day, with bread.</p><p>Roast duck, red cabbage and dumplings.</p><p>Pears in wine, and cheese.</p></div>",
        "<div class='share'>Each heir got a share of the land, the house, and the mill by the river.</div>",
        "<fieldset><p>The fields lay in a set of long strips, each with a ditch, as maps show.</p></fieldset>",
    ],
)
def test_no_name_or_tag_alone_takes_text_from_an_article(part):
    page = f"<body><nav><a href=a>One</a> <a href=b>Two</a></nav><article><h1>Title</h1>{LONG}{part}{LONG}</article><footer>Imprint</footer></body>"
    bare = " ".join(re.sub("<[^>]*>", " ", part).split())
    assert bare in html_text.main_text(page) and "Imprint" not in html_text.main_text(page)


def test_a_short_closing_beside_long_content_stays():
    assert html_text.main_text(f"<div class=content>{LONG}</div><div class=outro>End.</div>").endswith("ends. End.")


def test_parts_without_names_are_told_by_their_ratio(monkeypatch):
    """Neither tags nor names say what is what; with constant ratios the links come in."""
    links = "".join(f"<div class=k{k}><a href=/{k}>Somewhere else {k}</a></div>" for k in range(9))
    page = f"<body><div class=q1>{links}</div><div class=q2>{LONG}</div></body>"
    assert html_text.main_text(page) == " ".join(re.sub("<[^>]*>", " ", LONG).split())
    monkeypatch.setattr(html_text, "ratios", lambda page, paths, *_: 0.5 + 0 * paths)
    assert "Somewhere" in html_text.main_text(page)


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_with_random_class_names(seed):
    """No element or name tells the article: 0.95 of its words stay, 0.95 of the link lists' go."""
    rnd = random.Random(seed)
    name = lambda: "".join(rnd.choice("qxzkjv") for _ in range(6))
    words = lambda tag, n: " ".join(f"{tag}{rnd.randrange(999)}" for _ in range(n))
    kept = wanted = wrong = total = 0
    for _ in range(120):
        body = "".join(f"<{t} class={name()}>{words('art', rnd.randrange(6, 60))}, {words('art', 4)}.</{t}>" if rnd.random() < 0.8 else f"<h2>{words('art', 4)}</h2>" for t in rnd.choices(("p", "div"), k=rnd.randrange(3, 15)))
        bars = ["".join(f"<{t}><a href=/{k}>{words('nav', rnd.randrange(1, 5))}</a></{t}>" for k in range(rnd.randrange(4, 15))) for t in ("li", "div")]
        page = f"<div class={name()}><ul>{bars[0]}</ul></div><div class={name()}><div id={name()}>{body}</div></div><div class={name()}>{bars[1]}</div>"
        got = html_text.main_text(page).split()
        art, nav = len(re.findall("art[0-9]", page)), len(re.findall("nav[0-9]", page))
        kept, wanted = kept + sum("art" in w for w in got), wanted + art
        wrong, total = wrong + sum("nav" in w for w in got), total + nav
    assert kept >= 0.95 * wanted and wrong <= 0.05 * total


def test_deep_and_broken_pages_are_linear():
    import tracemalloc

    tracemalloc.start()
    assert html_text.main_text("<div>" * 100_000 + "x") == "x"
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    for broken in ("<foo>" * 30_000 + "</x>" * 30_000, "<p><table>" + "<foo>" * 30_000 + "<hr>" * 30_000, '<a "' * 30_000, "<x y=" * 30_000, "<ul><li>" * 20_000, "<!--" * 30_000):
        assert html_text.main_text(broken) == ""


def test_recall_on_generated_pages():
    """Layouts that are nowhere in the tables: words of the article kept and other words left out, 0.95 or more each."""
    rnd = random.Random(3)
    sentence = lambda tag: " ".join(f"{tag}{rnd.randrange(999)}" for _ in range(rnd.randrange(5, 20))) + rnd.choice((".", ", more.", "!"))
    para = lambda tag: " ".join(sentence(tag) for _ in range(rnd.randrange(1, 6)))
    kept = wanted = wrong = total = 0
    for _ in range(150):
        body = "".join(rnd.choice(("<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<ul><li>{}<li>more</ul>", "<blockquote>{}</blockquote>", "<p>{} <a href=z>link</a></p>", "<p class=legal>{}</p>", "<pre>{}</pre>")).format(para("art")) for _ in range(rnd.randrange(3, 14)))
        links = "".join(f"<li><a href=/{k}>{sentence('nav')[:20]}</a></li>" for k in range(8))
        box = rnd.choice(("<article>{}</article>", "<main><div>{}</div></main>", "<div class=content>{}</div>", "<div id=story><section>{}</section></div>", "<table><tr><td>{}</td></tr></table>"))
        page = "<html><body>" + rnd.choice((f"<nav><ul>{links}</ul></nav>", f"<div><ul>{links}</ul></div>", f"<div class=menu>{links}</div>"))
        page += rnd.choice(("", f"<div class='cookie-notice'>{para('box')}</div>", f"<header><h1>{sentence('box')}</h1></header>")) + box.format(body)
        page += rnd.choice(("", f"<div id=comments><p>{para('box')}</p><p>{para('box')}</p></div>", f"<aside>{para('box')}</aside>", f"<div class='ad'>{para('box')}</div>", f"<div class='sidebar'><p>{para('box')}</p></div>"))
        page += rnd.choice(("", f"<footer>{sentence('box')}</footer>", f"<form>{sentence('box')}<input name=q></form>")) + "</body></html>"
        got = html_text.main_text(page)
        wanted += len(re.findall(r"\bart\d", page))
        kept += len(re.findall(r"\bart\d", got))
        total += len(re.findall(r"\b(?:nav|box)\d", page))
        wrong += len(re.findall(r"\b(?:nav|box)\d", got))
    assert kept / wanted >= 0.95 and wrong / total <= 0.05


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (2, None, "<article><p>" + "long text, of words. " * 20000 + "</article>", "t"), (2, None, "<p>x", "t")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.n_chars, len(r.text)) for r in html_text.extract(df).collect())
    assert got == [(1, 0, 0), (2, 1, 1), (2, 419_999, 419_999)]
    assert html_text.extract(df.limit(0)).count() == 0


# ---------------------------------------------------------------- PII

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_base_spans(spark):
    rnd = random.Random(5)
    bits = ["a@b.c", "@", ".", "-", " ", "+", "1", "23", "4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.255", "1.2.3.4.5.6.7.8", "256.1.1.1", "+1 (437) 555-0689", "x_y", "é", "😀", "mail0.example.com", "\n", "é@b.c", "0001.2.3.4", "0" * 30]
    texts = [None, "", "plain", "a" * 50_000 + "@b", "9 " * 20_000, *("".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 14))) for _ in range(400))]
    df = docs(spark, [(k, t, None) for k, t in enumerate(texts)])
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.personal_data(df).collect()}
    assert got == {k: spans(t) for k, t in enumerate(texts)}
    assert pii.personal_data(df.limit(0)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    """Numbers where phones stand are phones too; numbers elsewhere are not."""
    rows = [(k, f"nothing here. please call me at +1 437 555 01{k:02d} today and order 9{k}{k}77 boxes", None) for k in range(12)]
    rows += [(100, "please call me at 555-0199-7 today or never", None), (100, "please call me at 555-0199-7 today or never", None), (101, "the year 19991 was long", None), (102, None, None)]
    out = pii.personal_data(docs(spark, rows)).collect()
    added = [(r.doc_id, [tuple(s) for s in r.spans if s not in r.base]) for r in out]
    assert [x for x in added if x[1]] == [(100, [(18, 3, 28, "phone")])] * 2
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in out)


def test_addresses_in_words_need_no_other_sign(spark):
    """A text without any digit or at sign is searched too."""
    rows = [(k, f"please write mail to {'abcdef'[k]}x@host.com today", None) for k in range(5)]
    rows += [(9, "please write mail to john at host dot org today", None), (10, "look at this", None)]
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in pii.personal_data(docs(spark, rows)).collect()}
    assert got[9] == [(21, 41, "email")] and got[10] == []


def test_neighbours_are_whole_words_however_long(spark):
    """A long word in front, or far away, makes the same pattern at a seed and at an unseen number."""
    for word, gap in (("x" * 60, " "), ("y" * 150, " "), ("z" * 12_000, " "), ("call", " " * 300)):
        rows = [(k, f"start of it {word} at{gap}+1 437 555 01{k:02d} today", None) for k in range(5)] + [(9, f"start of it {word} at{gap}555-0199-7 today", None)]
        got = {r.doc_id: [s.kind for s in r.spans] for r in pii.personal_data(docs(spark, rows)).collect()}
        assert got[9] == ["phone"], (len(word), len(gap))


def test_rounds_go_on_until_nothing_is_new(spark):
    """A chain: each pattern becomes sure only by tokens that the one before it has made known."""
    edges = [("p0", f"s{k}", "phone") for k in range(3)]
    for level in range(7):
        for k in range(3):
            edges += [(f"p{level}", f"t{level}-{k}", None), (f"p{level + 1}", f"t{level}-{k}", None)]
    edges += [("p0", f"s{k}", "phone") for k in range(3, 9)]
    df = spark.createDataFrame(edges, "pattern string, token string, kind string")
    assert {r.token for r in pii.discovered(df, sure_token=0.5, sure_pattern=0.5).collect()} == {f"t{level}-{k}" for level in range(7) for k in range(3)}


def test_recall_of_unseen_identifiers(spark):
    """Forms that no base pattern knows, in contexts that known ones share: 0.9 or more found whole, few numbers taken wrongly."""
    rnd = random.Random(12)
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))

    def card(right: bool) -> str:
        while True:
            d = number(16)
            if luhn(d) == right:
                return " ".join(d[k : k + 4] for k in range(0, 16, 4))

    known = {"phone": lambda: f"+1 ({number(3)}) {number(3)}-{number(4)}", "email": lambda: f"{name()}@{name()}.com", "card": lambda: card(True), "ip": lambda: ".".join(str(rnd.randrange(256)) for _ in range(4))}
    unseen = {"phone": lambda: rnd.choice((f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)} {number(3)} {number(4)}", f"{number(3)}-{number(4)}")), "email": lambda: f"{name()} at {name()} dot org", "card": lambda: card(False), "ip": lambda: f"{rnd.randrange(256, 999)}.{number(2)}.{number(2)}.{number(2)}"}
    before = {"phone": ("please call us", "phone number is", "ring me on"), "email": ("write mail to", "my address is"), "card": ("paid by card", "card number is"), "ip": ("came from host", "logged in from")}
    rows, want = [], {}
    for k in range(400):
        kind = rnd.choice(list(known))
        new = k % 5 == 0
        lead = f"{name()} {name()} {rnd.choice(before[kind])} "
        value = (unseen if new else known)[kind]()
        rows.append((k, f"{lead}{value}, {name()} said. {name()} in {number(4)} there were {number(5)} {name()}", None))
        if new:
            want[k] = (len(lead), len(lead) + len(value), kind)
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans if s not in r.base] for r in pii.personal_data(docs(spark, rows)).collect()}
    caught = sum(w in got[k] for k, w in want.items())
    wrong = sum(len([s for s in x if s != want.get(k)]) for k, x in got.items())
    missed = [(rows[k][1], w, got[k]) for k, w in want.items() if w not in got[k]]
    assert caught / len(want) >= 0.9 and wrong <= 0.05 * len(rows), (caught, len(want), wrong, missed[:12])


def test_null_and_repeated_ids(spark):
    df = docs(spark, [(None, "a@b.cd", None), (None, "1.2.3.4", None), (1, "x", None), (1, "a@b.cd", None)]).withColumnRenamed("doc_id", "base_id")
    assert sorted((str(r.base_id), len(r.spans)) for r in pii.personal_data(df, "base_id").collect()) == [("1", 0), ("1", 1), ("None", 1), ("None", 1)]


# ---------------------------------------------------------------- licences


def test_licences(spark):
    mit = next(t for _, t in licenses.NOTICES if t.startswith("Permission is hereby"))
    wrapped = mit.replace(", ", ",\n")
    rows = [
        (1, f"Some words here.\n{wrapped}\nMore words follow.", None), (2, "Released under the MIT License.", None), (3, "His driving license was taken. Copyright is a right.", None),
        (4, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.", None), (5, "nothing of the kind", None), (6, None, None), (7, "Licensed under the Strange License, Version 9.", None), (2, "Released under the MIT License.", None),
    ]
    got = sorted((r.doc_id, r.paragraph, r.license) for r in licenses.scan(docs(spark, rows)).collect())
    assert got == [(1, 1, "MIT"), (2, 0, "MIT"), (2, 0, "MIT"), (3, 0, "unknown"), (4, 0, "CC-BY-NC-4.0"), (4, 1, "CC-BY-4.0"), (7, 0, "unknown")], got
    assert licenses.scan(docs(spark, [])).count() == 0


def plain(text):
    """The classifier and its confirmation in plain Python: (license, probability)."""
    import numpy as np

    classes, weights, bias = licenses.model()
    w = licenses.tokens(text)
    held = {g for n in range(1, licenses.WORDS + 1) for g in licenses.grams(w, n)}
    known = [g for g in held if g in weights]
    z = np.array(bias) + sum((np.array(weights[g]) for g in known), np.zeros(len(classes))) / np.sqrt(max(1, len(known)))
    p = np.exp(z - z.max())
    p /= p.sum()
    guess = classes[int(p.argmax())]
    share = max((len(s & held) / len(s) for f, t in licenses.templates() if f == guess for s in [licenses.shingles(licenses.tokens(t))]), default=0)
    return guess if guess != licenses.UNKNOWN and p.max() >= 0.5 and share >= 0.8 else licenses.UNKNOWN, float(p.max())


#: Wordings and sentences of which none is trained on.
SAID = ("You may use this under the {}.", "The code is offered under {}.", "Copyright 2020 X. Licensed under {}, see COPYING.", "This package is {} licensed.", "Published under the terms of {}.", "The files here fall under the {}.")
GRANT_NOTHING = (
    "He works at MIT.", "MIT published a paper on lakes.", "The Apache tribe lives in the south.", "They drove to the sea without a license.", "The eclipse was seen by many people.", "A boost in sales of software was reported.",
    "Copyright 2001 The Example Press.", "Permission to land was refused.", "The warranty of the car has ended.", "Public domain books are read by many.", "Her driving licence is valid until May.", "The general public may enter the hall.",
    "All rights are reserved by the museum.", "The licence of the casino was not renewed.", "The license server is down this week.", "Zlib is used to compress the files.", "The redistribution of seats took a year.",
    "No part of this book may be copied without permission.", "An apache is a kind of dancer in old films.", "The software was sold for a small fee.",
)


def test_recall_of_wordings_that_were_not_trained_on():
    found = [(f, plain(m.format(n))[0]) for f, names in licenses.NAMES.items() for n in names for m in SAID]
    assert sum(f == x for f, x in found) / len(found) >= 0.9
    assert all(plain(t)[0] == f for f, t in licenses.NOTICES)
    cut = [(f, plain(" ".join(t.split()[: -max(1, len(t.split()) // 10)]))[0]) for f, t in licenses.NOTICES if len(t.split()) > 20]
    assert sum(f == x for f, x in cut) / len(cut) >= 0.9
    assert sum(plain(t)[0] == "unknown" for t in GRANT_NOTHING) / len(GRANT_NOTHING) >= 0.9


def test_the_cue_loses_no_template():
    """More than a fifth of every template's shingles hold a licence word, so a paragraph without one confirms none."""
    for _, t in licenses.templates():
        at = [m.span() for m in licenses.TOKEN.finditer(t)]
        n = min(licenses.WORDS, len(at))
        held = [t[at[k][0] : at[k + n - 1][1]] for k in range(len(at) - n + 1)]
        assert sum(bool(re.search(licenses.CUE, x)) for x in held) > 0.2 * len(held), t


def test_scores_equal_a_plain_classifier(spark):
    texts = [t for _, t in licenses.NOTICES] + list(licenses.OTHERS) + [m.format(n) for names in licenses.NAMES.values() for n in names[:1] for m in SAID] + list(GRANT_NOTHING)
    rows = [(k, t, None) for k, t in enumerate(texts)] + [(9999, "software word " * 2500 + "released under the MIT License", None)]
    got = {r.doc_id: (r.license, r.probability) for r in licenses.scan(docs(spark, rows)).collect()}
    for k, t, _ in rows:
        if not re.search(licenses.CUE, t):
            assert k not in got and plain(t)[0] == "unknown"
        else:
            label, p = plain(t)
            assert got[k][1] == pytest.approx(p) and got[k][0] == label, t[:200]


# ---------------------------------------------------------------- toxicity


def toxic_corpus():
    rnd = random.Random(2)
    plain = [f"word{k}x" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        w = ["".join(c for c in rnd.choice(plain) if c.isalpha()) + rnd.choice("abcdefgh") * 3 for _ in range(rnd.randrange(5, 80))]
        bad = k % 4 == 0
        if bad:
            for _ in range(2):
                w.insert(rnd.randrange(len(w)), rnd.choice(("vile", "nasty", "grimhort" + rnd.choice("xyz"))))
        rows.append((k, " ".join(w), None))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    more = [(1000, None, None), (1001, "", None), (1002, "... 12", None), (1003, "vile " + "quite plain " * 30_000, None)]
    df, lb = docs(spark, rows + more), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(df, lb, ~toxicity.held_out()).collect()}
    held = {r[0] for r in df.where(toxicity.held_out()).select("doc_id").collect()}
    right = [(out[k].score >= 0.5) == (y == 1) for k, y in labels if k in held]
    assert sum(right) / len(right) > 0.97 and 0 <= out[1001].score < 0.5 and out[1000].score == out[1001].score == out[1002].score
    text = dict((k, t) for k, t, _ in rows)
    found = {text[k][int(a) : int(b)] for k in text if out[k].spans for a, b in (s.split(":") for s in out[k].spans.split(","))}
    assert {"vile", "nasty"} <= found and all(f in ("vile", "nasty") or f.startswith("grimhort") for f in found)
    kept = toxicity.without_toxic(df, df, lb, ~toxicity.held_out())
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, r in out.items() if r.score < 0.5) and kept.columns == df.columns


def test_toxic_spans_are_those_of_the_text_itself(spark):
    """Lowering may lengthen a text; ids may be null or come repeatedly; long texts stay within the sample's bounds."""
    rows, labels = toxic_corpus()
    odd = [(2000, "\u0130\u0130stanbul \u0130 vile word", None), (None, "vile", None), (8, rows[8][1], None), (8, "another vile text", None)]
    df, lb = docs(spark, rows + odd), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = [r for r in toxicity.score(df, lb, ~toxicity.held_out()).collect() if r.doc_id in (2000, None)]
    assert sorted(r.spans for r in out) == ["0:4", "12:16"]
    assert df.where("doc_id IS NULL").select(toxicity.held_out().alias("h")).first().h is False
    texts, share = toxicity.sample(df, lb, "doc_id", "text", "toxic", most=50, chars=2000)
    assert 0 < sum(len(t) for t, _ in texts) <= 2000 and share == 0.25
    texts, _ = toxicity.sample(df, lb, "doc_id", "text", "toxic")
    assert len(texts) == len(labels)


def test_toxicity_end_to_end_on_words_that_share_no_beginning(spark):
    """Held-out documents with several toxic words, none alike: 0.95 right, clean ones left alone."""
    rnd = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randrange(4, 10)))
    bad, plain = [word() for _ in range(40)], [word() for _ in range(2000)]
    rows, labels = [], []
    for k in range(900):
        w, y = [rnd.choice(plain) for _ in range(rnd.randrange(20, 90))], int(k % 3 == 0)
        for _ in range(4 * y):
            w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        rows.append((k, " ".join(w), None))
        labels.append((k, y))
    df, lb = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = {r[0] for r in df.where(toxicity.held_out()).select("doc_id").collect()}
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(df, lb, ~toxicity.held_out()).collect()}
    assert sum(got[k] == (y == 1) for k, y in labels if k in held) / len(held) >= 0.95


def test_toxicity_without_labels(spark):
    df = docs(spark, [(1, "a b", None), (2, None, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score < 0.01 for r in toxicity.score(df, none, ~toxicity.held_out()).collect()} == {True}
    assert toxicity.score(df.limit(0), none, ~toxicity.held_out()).count() == 0


def test_forward_backward_is_exact():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    e, a = rng.normal(size=9), rng.normal(size=(2, 2))
    starts, lengths = np.array([0, 5, 8]), np.array([5, 3, 1])
    p, _ = toxicity.forward_backward(e, starts, lengths, a)
    for s, n in zip(starts, lengths, strict=True):
        total, marg = 0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[s + t] * y[t] for t in range(n)) + sum(a[y[t - 1], y[t]] for t in range(1, n)))
            total += w
            marg += w * np.array(y)
        assert np.allclose(p[s : s + n], marg / total)


# ---------------------------------------------------------------- decontamination


def test_sql_finds_short_items(spark, tmp_path):
    """The SQL of the query against the operator, items of one to four words and without words included."""
    import duckdb

    spark.createDataFrame([(1, "one two three four five six"), (2, "xx two yy"), (3, None), (4, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "two"), (2, "two three"), (3, "one two three four"), (4, "two three four five six"), (5, ""), (6, None), (7, "seven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.sql(decontamination.ORACLE["op9_decontamination"]).fetchall())
    assert sorted(map(tuple, decontamination.op9_decontamination(spark, str(tmp_path)).collect())) == want and [w[:2] for w in want] == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)]


def test_contained_items(spark):
    rnd = random.Random(4)
    words = [f"t{k}" for k in range(40)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(k, text(rnd.choice((2, 5, 9, 30, 60)))) for k in range(30)] + [(40, None), (41, ""), (42, "t1 t2"), (42, "t1 t2")]
    rows = [(k, text(rnd.choice((0, 3, 50, 400))), None) for k in range(30)] + [(90, None, None)]
    for k in range(40):
        w = items[rnd.randrange(30)][1].split()
        if k % 2 and len(w) > 8:
            w[rnd.randrange(len(w))] = "other"
        rows.append((100 + k, f"{text(20)} {' '.join(w).upper()}!!! {text(300)}", None))
    want = []
    shingles = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    for i, t in items:
        w = re.findall(r"\w+", (t or "").lower())
        if w:
            n = min(5, len(w))
            s = shingles(w, n)
            for d, x, _ in rows:
                k = len(s & shingles(re.findall(r"\w+", (x or "").lower()), n))
                if k >= 0.8 * len(s) - 1e-9:
                    want.append((d, i, len(s), k))
    df, it = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    for bounds in ({}, {"block_items": 3}, {"block_chars": 50}):
        got = sorted(tuple(r)[:4] for r in decontamination.contained(df, it, **bounds).collect())
        assert got == sorted(want)
        kept = decontamination.without_items(df, it, **bounds)
        assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _, _ in rows} - {w[0] for w in want}) and kept.columns == df.columns
    assert decontamination.contained(df.limit(0), it).count() == 0 and decontamination.contained(df, it.limit(0)).count() == 0 and decontamination.without_items(df, it.limit(0)).count() == len(rows)


# ---------------------------------------------------------------- mixing


def test_targets_share_the_excess():
    sizes = {"a": 100, "b": 1000, "c": 10, None: 500}
    got = mixing.targets(sizes)
    assert got["a"] == 200 and got["c"] == 20 and sum(got.values()) == pytest.approx(1.5 * 1610)
    assert got[None] == 1000 and got["b"] == pytest.approx(1195) and mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_flow_reroutes_before_it_repeats():
    """The shared pattern must go where nothing else can; repetition starts only after all first copies."""
    patterns = {("a",): 10, ("a", "b"): 10, ("b",): 4}
    out = mixing.flow(patterns, {"a": 10, "b": 14})
    assert {p: sum(x) for p, x in out.items()} == {("a",): 10, ("a", "b"): 10, ("b",): 4} and all(x[1] == 0 for x in out.values())
    out = mixing.flow(patterns, {"a": 5, "b": 28})
    assert sum(out[("a", "b")]) + sum(out[("b",)]) + sum(out[("a",)]) == 33 and out[("a", "b")] == [10, 10] and out[("b",)] == [4, 4]


def test_flow_is_the_cheapest_one():
    """Against minimum cuts over all sets of sources: the most that first copies carry, and the most of all copies."""
    rnd = random.Random(9)
    names = ["a", "b", "c", "d"]

    def most(patterns, quotas, copies):
        cuts = [[s for k, s in enumerate(names) if m >> k & 1] for m in range(16)]
        return min(sum(quotas[s] for s in cut) + sum(copies * n for p, n in patterns.items() if not set(p) <= set(cut)) for cut in cuts)

    for _ in range(300):
        patterns = {tuple(sorted(rnd.sample(names, rnd.randrange(1, 4)))): rnd.randrange(0, 30) for _ in range(rnd.randrange(1, 7))}
        quotas = {s: rnd.randrange(0, 60) for s in names}
        out = mixing.flow(patterns, quotas)
        assert sum(x[0] for x in out.values()) == most(patterns, quotas, 1)
        assert sum(map(sum, out.values())) == most(patterns, quotas, 2)
        assert all(0 <= c <= patterns[p] for p, x in out.items() for c in x)


def test_mix_without_members(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, "a b c", []), (3, "w " * 10, ["s"]), (4, None, None), (3, "w", ["s"])], "doc_id long, text string, m array<string>")
    out = sorted(((r.doc_id, r["size"], r.taken) for r in mixing.mix(df, F.col("m")).collect()), key=str)
    assert [x for x in out if x[0] != 3] == [(1, 2, 0), (2, 3, 0), (4, 0, 0)] and sum(x[2] for x in out) == 22


def test_mix(spark):
    rnd = random.Random(6)
    rows = [(k, " ".join(["w"] * rnd.choice((0, 1, 5, 40))), rnd.choice(("s1", "s2", None))) for k in range(500)]
    rows += [(900, None, "s3"), (901, "w " * 5000, "s1"), (5, "w w", "s1"), (5, "w w", "s1")]
    df = docs(spark, rows)
    out = mixing.mix(df, F.array("source")).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in out)
    sums = {}
    for r in out:
        x = sums.setdefault(r.members[0], [0, 0, r.source_size, r.target])
        x[0] += r["size"]
        x[1] += r.taken
    assert all(x[0] == x[2] and abs(x[1] - x[3]) <= 1 for x in sums.values()) and sums["s3"][3] == 0
    again = mixing.mix(df.repartition(7), F.array("source")).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mix(df.limit(0), F.array("source")).count() == 0


def test_mix_of_overlapping_sources(spark):
    df = spark.createDataFrame([(k, "w " * 10, ["a"] if k % 3 else ["a", "b", "b"]) for k in range(90)], "doc_id long, text string, m array<string>")
    out = mixing.mix(df, F.col("m")).collect()
    assert sum(r.taken for r in out) == pytest.approx(1350, abs=2) and {tuple(r.members) for r in out} == {("a",), ("a", "b")}
