import random
import re
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from muster.llm.html_text import _nearest, extract_pages, main_text

GOOD = "This is the first paragraph of the text and it is long enough to be good, in the view of the rules that are used here."


def test_article_only():
    page = f"""<html><head><title>T</title><style>p{{}}</style><script>var a = "</p><p>no</p>";</script></head><body>
      <header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice"><p>{GOOD} cookies</p></div>
      <article><header><h1>Head &amp; line</h1></header><p>{GOOD}<p>Short&nbsp;one.<br>two   words</p><ul><li>item</ul><div class=ad>Buy the best of the things</div>
      <aside>{GOOD}</aside><form><p>{GOOD}</p></form><p><b>Bold &lt;b&gt; &#233;&eacute; <i>x</i>y</p></article>
      <section id="comments"><article class="comment"><p>{GOOD}</p></article></section><div id="sidebar">{GOOD}</div><footer>&copy; {GOOD}</footer></body></html>"""
    assert main_text(page).split("\n") == ["Head & line", GOOD, "Short one. two words", "item", "Bold <b> éé xy"]


def test_unmarked_page():
    page = f"<div class=menu><a href=a>one</a> <a href=b>two</a></div><div><h2>Title</h2><p>{GOOD}</p><p>Yes.</p><ul><li>one</li><li>two</li></ul></div><p>© 2020</p><div class=footer><p>x</p></div>"
    assert main_text(page).split("\n")[:5] == ["Title", GOOD, "Yes.", "one", "two"]


def test_broken_pages():
    for page in ("", "<", "<p", "</p></div>", "<!-- open", "<script>x", "<p>" * 3000 + "a" + "</p>" * 3000, "<a <b>", "&#xD800;&#99999999;&bogus;", "\x00<p>\x00"):
        assert isinstance(main_text(page), str)
    assert main_text("<nav>only</nav>") == ""


def test_unclosed_elements():
    for head in ("<head><title>T</title>", "<head><title>T", "<head><meta charset=utf-8><noscript><link href=x></noscript><title>T</title>", "<head><noscript><title>T</title>", "<head/><title>T</title>"):
        for body in ("<body><article><p>", "<article><p>"):
            assert main_text(f"<html>{head}{body}{GOOD}") == GOOD, (head, body)
    assert main_text(f"<head><title>T</title>{GOOD}") == GOOD == main_text(f"<html><head><title>T</title></head><body><head><p>{GOOD}")
    page = "<article><p>{g} First {icon}second</p><p>{g} third</p></article><div><p>x"
    for icon in ("<svg class=i />", "<svg><title>no</title><g><path d='M0'/></g></svg>", "<math/>", "<svg><path d=x>", "<iframe src=x></iframe>", "<iframe src=x />", "<noscript><div><p>no</p></div></noscript>",
                 "<object data=x><p>no</p></object>", "<canvas>no</canvas>", "<template><li>no<li>no</template>", "<svg><foreignObject><div><p>no</p></div></foreignObject></svg>"):
        lines = main_text(page.format(g=GOOD, icon=icon)).split("\n")
        assert lines[1] == f"{GOOD} third" and lines[0].startswith(f"{GOOD} First") and "no" not in lines[0].split(), icon
        assert lines[0].endswith("second") or icon == "<svg><path d=x>", icon
    for tag in ("svg", "math", "iframe", "object", "canvas", "template", "noscript"):
        assert main_text(f"<article><p>{GOOD}</p><{tag}><p>{GOOD} third</article>").split("\n") == [GOOD, f"{GOOD} third"], tag


def test_article_is_one_feature():
    long = [f"{GOOD} This is the part of it that has the number {i}." for i in range(6)]
    plain = "<div>" + "".join(f"<p>{x}</p>" for x in long) + "</div>"
    card = "<article><p>This is a quote of the one who is in the story and more of it.</p></article>"
    assert main_text(f"<body>{card}{plain}").split("\n")[-6:] == long
    junk = "<p>" + "Zkr Blo Mnx Wqe " * 20 + "</p>"
    assert main_text(f"<body><article>{junk}</article><div>{'<p>' + 5 * GOOD + '</p>'}</div>").split("\n") == [5 * GOOD]
    # an article with most of the good text: outside it only what is long and good stays
    page = f"<body><p>This is the one for you and me, and it is in the shop.</p><p>{GOOD} extra of the page</p><article>{plain}{junk}</article><p>Short.</p>{junk}"
    assert main_text(page).split("\n") == [f"{GOOD} extra of the page", *long, ("Zkr Blo Mnx Wqe " * 20).strip()]
    other = "Это длинный текст статьи на языке без списка частых слов. " * 6  # longer than the notice in a known language
    assert main_text(f"<div><p>{GOOD} cookies in use</p></div><article><p>{other}</p></article>").split("\n")[-1] == other.strip()


def test_table(spark):
    rows = [(1, "u", f"<article><p>{GOOD}</p></article>"), (1, "u", f"<article><p>{GOOD}</p></article>"), (2, None, None), (None, "v", ""), (3, "w", f"<article><p>{GOOD} " + "words of the text " * 50_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = extract_pages(df.drop("text")).collect()
    assert sorted(r["n_chars"] for r in got)[:4] == [0, 0, len(GOOD), len(GOOD)] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract_pages(df).columns == ["page_id", "url", "text", "n_chars"] and extract_pages(df.limit(0)).count() == 0


def bare(page):
    return re.sub(r"(?i)(</?)(article|main)\b", r"\1div", page)


def test_text_decides_without_article_tags():
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()
    same = sum(main_text(p) == main_text(bare(p)) for p in pages)
    assert len(pages) >= 20 and same >= 0.95 * len(pages)


def test_dense_text_decides_in_containers():
    junk = "Zkr Blo Mnx Wqe " * 20
    side = f"<div><p>{junk}</p><p>{junk}</p></div>"
    page = f"<body><div><p>{GOOD}</p><p>{junk}</p><p>{GOOD} And more of it.</p></div>{side}"
    # few stop words between good text of one container are part of it, alone they are not
    assert main_text(page).split("\n") == [GOOD, junk.strip(), f"{GOOD} And more of it."]
    assert main_text(f"<nav>{GOOD}</nav><div><p>Zkr blo.</p><p>Mnx | wqe | rty</p></div><div><p><a href=x>Yy</a></p></div>").split("\n") == ["Zkr blo.", "Mnx | wqe | rty"]


def nearest_by_hand(labels, groups):
    out = []
    for i, x in enumerate(labels):
        near = [(abs(i - j), not y, y) for j, y in enumerate(labels) if y is not None and groups[j] == groups[i]]
        out.append(x if x is not None else min(near)[2] if near else None)
    return out


def test_second_pass_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 30)
        labels, groups = [rng.choice([None, None, True, False]) for _ in range(n)], [rng.randrange(3) for _ in range(n)]
        assert _nearest(labels, groups) == nearest_by_hand(labels, groups)


@pytest.mark.parametrize("page", [
    "<script " * 4000, "<div>" * 4000 + "</span>" * 4000, "<a " * 9000, "<a>" + "<div>" * 4000 + "</a>" * 4000, '<a "' * 9000 + ">", "<a '\">" * 9000, "<div>" * 4000 + "<head>" * 4000,
    "<svg>" + "<g>" * 4000 + "<x>" * 4000, "<svg>" * 4000 + "<p>" * 4000, "<" * 30_000 + ">", "<!--" * 9000, "<head>" + "<noscript>" * 4000 + "<title>" * 4000, "<![CDATA[" * 4000 + ">", "<a x=\"" * 4000 + "'>" * 10,
])
def test_time_grows_with_the_page(page):
    def seconds(text):
        best = 9.0
        for _ in range(3):
            start = time.process_time()
            main_text(text)
            best = min(best, time.process_time() - start)
        return best

    assert seconds(page * 8) < 24 * seconds(page) + 0.2
