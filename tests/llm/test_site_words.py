"""Articles keep all their words, whatever recurs on the pages of their host."""

import random

import pytest
from quernstone.llm import site_text


def site(spark, bodies, host="h.example"):
    rows = [(i, f"https://{host}/{i}", f"<html><body><nav><a href='/'>Home</a></nav><div class='x1'>Seen on every page of the site</div>{b}<footer>f</footer></body></html>") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(pages):
    return {r.page_id: r.out.text for r in site_text.main_text(pages, site_text.templates(pages)).collect()}


CASES = {
    "link_and_code": ('<article><p>He number {i} was born in <a href="/wiki/France">France</a> and uses <code class="py">None</code> in case {i}.</p></article>', "He number {i} was born in France and uses None in case {i}."),
    "lead": ('<article><p class="lead">The same words lead.</p><p>But {i} differs.</p></article>', "The same words lead. But {i} differs."),
    "table": ('<article><table class="t"><tr><td>one</td><td>two</td></tr></table><p>Row {i}.</p></article>', "one two Row {i}."),
    "topic": ('<article><section class="social"><h2>Social history</h2><p>text {i} of people.</p></section></article>', "Social history text {i} of people."),
    "only_content": ('<div class="widget-area list-items"><p>only content {i}</p></div>', "only content {i}"),
    "header": ("<article><header><p>Intro {i}.</p></header><p>Body {i}.</p></article>", "Intro {i}. Body {i}."),
    "box": ('<article><p>Body {i}.</p><div class="x2"><p>Read our paper every day</p></div></article>', "Body {i}."),
    "related": ('<article><p>Body {i}.</p><div class="related"><h3>Related</h3><ul><li><a href="/{i}a">A {i}</a></li><li><a href="/b">B</a></li></ul></div></article>', "Body {i}."),
    "main": ('<main><div class="x3">Always here</div><p>See <time datetime="x">today</time> and <span class="q">always</span> {i}.</p></main>', "See today and always {i}."),
}


@pytest.mark.parametrize("few", [True, False])
def test_cases(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(site_text, "BROADCAST_ROWS", 0)
    pages = None
    for name, (body, _) in CASES.items():
        one = site(spark, [body.format(i=i) for i in range(10)], f"{name}.example")
        pages = one if pages is None else pages.unionByName(one)
    got = {(r.url, r.out.text) for r in site_text.main_text(pages, site_text.templates(pages)).collect()}
    assert got == {(f"https://{name}.example/{i}", want.format(i=i)) for name, (_, want) in CASES.items() for i in range(10)}


def test_no_word_of_an_article_goes(spark):
    rng = random.Random(8)
    inline = ["<a href='/w/{w}'>{w}</a>", "<code class='k'>{w}</code>", "<time>{w}</time>", "<span class='s'>{w}</span>", "<em>{w}</em>", "{w}", "{w}"]
    blocks = ["<p>{t}</p>", "<p class='lead'>{t}</p>", "<ul class='l'><li>{t}</li></ul>", "<blockquote>{t}</blockquote>", "<table class='t'><tr><td>{t}</td></tr></table>", "<h2 id='z'>{t}</h2>"]
    words = ["red", "green", "blue", "dark", "light", "old"]
    bodies, want = [], {}
    for i in range(60):
        parts = [[rng.choice(words) for _ in range(rng.randint(1, 4))] + [rng.choice(["same", str(i)])] for _ in range(rng.randint(2, 6))]
        bodies.append("<article>" + "".join(rng.choice(blocks).format(t=" ".join(rng.choice(inline).format(w=w) for w in p)) for p in parts) + "</article>")
        want[i] = " ".join(w for p in parts for w in p)
    assert texts(site(spark, bodies)) == want


def test_hot_host_carries_no_list(spark, monkeypatch):
    monkeypatch.setattr(site_text, "BROADCAST_ROWS", 10)
    bodies = [f"<div class='r{i % 40}'>box {i % 40}</div><article><p>text {i}</p></article>" for i in range(600)]
    pages = site(spark, bodies)
    found = site_text.templates(pages)
    assert found.columns == ["host", "hash"] and found.count() > 40
    held = site_text.hits(pages.selectExpr("cast(page_id as string) page", "'h.example' host", "html"), found)
    assert held.selectExpr("max(size(hashes)) n").first().n <= 8
    assert texts(pages) == {i: f"text {i}" for i in range(600)}
