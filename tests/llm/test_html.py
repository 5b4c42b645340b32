"""HTML extraction: pages of four languages with known text, broken and long pages, names that style tools make up."""

import time

import pytest

LANGUAGES = {
    "en": ("The council met on {i} and spoke about the bridge over the river.", "sidebar", "comments", "advert", "Read more"),
    "de": ("Der Rat traf sich zum {i}. Mal und sprach über die Brücke am Fluss.", "seitenleiste", "kommentare", "werbung", "Mehr lesen"),
    "fr": ("Le conseil a siégé {i} fois et a parlé du pont sur la rivière.", "barre-laterale", "commentaires", "encart", "Lire la suite"),
    "es": ("El consejo se reunió {i} veces y habló del puente sobre el río.", "barra-lateral", "comentarios", "anuncio", "Leer más"),
}


def gold(lang: str, i: int) -> tuple[str, str]:
    """A page and its text.  The strip has a name of no language and says the same on every page; the odd strip links elsewhere on each."""
    line, side, readers, advert, more = LANGUAGES[lang]
    said = [f"{line.format(i=i)} ({k}) {'abcdefgh'[i % 8] * 3}" for k in range(5)]
    links = "".join(f"<a href=/{i}{k}>{more} {i} {k}</a>" for k in range(4))
    paras = "".join(f"<p>{s}</p>" for s in said)
    html = f"""<html><head><title>{said[0]}</title></head><body><ul class="topline">{links}</ul><div class="page css-{'k9zXw'[i % 5]}Q{i}x7">
      <div class="story"><h1>{said[0]}</h1>{paras}<div class="qorvex"><p>{line.format(i=0)} Always the same.</p></div><div class="zulam">{links}</div>
      <div class="{advert}"><p>{more}! {i}</p></div></div>
      <div class="{side}"><p>{more}, {more} {i}.</p></div><div class="{readers}"><p>Anna: {more} {i}?</p><p>Otto: {more} {i + 1}.</p></div></div>
      <div class="qorvex2">&copy; {lang}</div></body></html>"""
    return html, " ".join([said[0], *said])


def test_four_languages(spark):
    from factloom.llm import html_extraction

    pages, want = [], {}
    for k, lang in enumerate(LANGUAGES):
        for i in range(9):
            html, text = gold(lang, i)
            pages.append((100 * k + i, f"https://{lang}.example.org/{i}", html))
            want[100 * k + i] = text
    got = {r["page_id"]: r["text"] for r in html_extraction.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    right = said = found = 0
    for page, text in want.items():
        a, b = got[page].split(), text.split()
        both = sum(min(a.count(w), b.count(w)) for w in set(b))
        right, said, found = right + both, said + len(b), found + len(a)
    assert right / said >= 0.99 and right / found >= 0.99, (right / said, right / found)


def test_boilerplate_needs_evidence_of_several_pages(spark):
    from factloom.llm import html_extraction

    schema = "page_id long, url string, html string"
    page = lambda i, box: f"<body><div class=story><p>Story {i} has its own words, quite a few of them.</p><div class=box><p>{box}</p></div></div></body>"
    few = [(i, "http://few.b/", page(i, "Same.")) for i in range(3)]
    copies = [(10 + i, "http://copies.b/", page(0, "Same.")) for i in range(9)]  # one page, nine times
    many = [(30 + i, "http://many.b/", page(i, "Same.")) for i in range(6)]
    own = [(50 + i, "http://own.b/", page(i, f"Own {i}.")) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extracted(spark.createDataFrame([*few, *copies, *many, *own], schema)).collect()}
    text = lambda i: f"Story {i} has its own words, quite a few of them."
    assert {i: got[i] for i, *_ in few} == {i: text(i) + " Same." for i in range(3)}
    assert all(got[i] == text(0) + " Same." for i, *_ in copies)
    assert {i - 30: got[i] for i, *_ in many} == {i: text(i) for i in range(6)}
    assert {i - 50: got[i] for i, *_ in own} == {i: f"{text(i)} Own {i}." for i in range(6)}
    assert html_extraction.extracted(spark.createDataFrame([], schema)).count() == 0


MB = 1_000_000


@pytest.mark.parametrize(
    "text",
    ["<a " * (MB // 3), "<b>" * (MB // 14) + "<div>x</div>" * (MB // 14), "<b>x" * (MB // 4), "<div>" * (MB // 15) + "</section>" * (MB // 15), '<a "<a" ' * (MB // 8), "<!-- " * (MB // 5), "<p>x<b>" * (MB // 7)],
    ids=["open tags", "inline then containers", "inline", "stray ends", "quotes", "comments", "paragraphs"],
)
def test_long_broken_pages_take_linear_time(text):
    from factloom.llm import html_extraction

    def took(t):
        began = time.process_time()
        root = html_extraction.parse(t)
        html_extraction.text_at(root, html_extraction.best(root)[0])
        html_extraction.own_texts(root)
        return time.process_time() - began

    half, whole = took(text[: len(text) // 2]), took(text)
    assert whole < 8 and whole < 4 * half + 0.5  # in seconds of a busy machine; in proportion


def test_made_up_names_are_generalised():
    from factloom.llm.html_extraction import generalised

    assert {generalised(x) for x in ("css-9zxk1", "css-1abq0", "css-x1Y2z")} == {"css-#"}
    assert generalised("sc-fzXfMw") == generalised("sc-AxirZ") == "sc-#"
    assert [generalised(x) for x in ("main-content", "story-body", "post-12", "Artikel-Inhalt")] == ["main-content", "story-body", "post-#", "artikel-inhalt"]
