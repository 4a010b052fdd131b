"""Operator 9: names that mislead, comments without telling names, and ratios that decide within an article."""

import numpy as np
import pytest

from quarry.llm import webtext
from quarry.llm.webtext import main_text

LONG = "The survey covered every valley of the region, and its results were printed in two volumes; later maps relied on them. "
PROSE = LONG * 3
IDS = (
    "related-work discussion comment-on-law share-of-market search-method side-effects legal-basis form-of-government social-history copyright-law "
    "alert-systems promotion-to-captain subscription-model login-protocol menu-of-the-day notice-of-intent banner-year ad-hoc rail-network "
    "foot-anatomy overlay-network toolbar-design reply-brief pager-duty adverts-in-print newsletter-history header-files"
).split()


def article(*inside, after=""):
    return f"<body><nav><a href=/x>Home</a></nav><article><h1>Title</h1><p>{PROSE}</p>{''.join(inside)}<p>{PROSE}</p>{after}</article><footer>Imprint</footer></body>"


@pytest.mark.parametrize("name", IDS)
@pytest.mark.parametrize("kind", ["id", "class"])
def test_a_section_of_the_article_stays_whatever_its_name(name, kind):
    text = main_text(article(f"<section {kind}={name}><h2>A heading</h2><p>{PROSE}</p><p>Short.</p></section>"))
    assert text.split("\n") == ["Title", PROSE.strip(), "A heading", PROSE.strip(), "Short.", PROSE.strip()]


@pytest.mark.parametrize("name", ["sidebar", "sidebar-left", "ad", "adSlot", "ad-box", "cookie-banner", "newsletter signup", "related-links", "share-bar", "comments", "comment-list", "site-footer", "promo_unit"])
def test_parts_of_the_page_go_by_their_whole_names(name):
    text = main_text(article(f"<div class='{name}'><a href=/1>One</a> <a href=/2>Two</a><p>Buy it now.</p></div>"))
    assert text.split("\n") == ["Title", PROSE.strip(), PROSE.strip()]


def comment(who, when, what, tag="div"):
    return f"<{tag}><p>{who}</p><p>{when}</p><p>{what}</p></{tag}>"


@pytest.mark.parametrize("tag, whens", [("div", ["3 hours ago", "2 days ago"]), ("li", ["2024-05-01 10:12", "2024-05-02 08:01"]), ("section", ["May 3, 2024", "12 June 2024"])])
def test_comments_without_telling_names_go(tag, whens):
    listed = "".join(comment(w, t, f"I think {LONG}", tag) for w, t in zip(("Anna B.", "user_42"), whens, strict=True))
    whole = f"<ul>{listed}</ul>" if tag == "li" else f"<div>{listed}</div>"
    text = main_text(article(after=f"<h2>Two answers</h2>{whole}"))
    assert text.split("\n") == ["Title", PROSE.strip(), PROSE.strip()]


def test_sections_with_dates_and_lists_of_the_article_stay():
    dated = "".join(f"<div><h3>Launch {k}</h3><p>May {k}, 2020</p><p>{PROSE}</p></div>" for k in (1, 2, 3))
    times = "<ul>" + "".join(f"<li>{k}:30 Train to the coast</li>" for k in (7, 8, 9)) + "</ul>"
    talk = "".join(f"<div><p>{LONG}</p><p>{LONG}</p></div>" for _ in range(3))
    text = main_text(article(dated, times, talk))
    assert text.count("Launch") == 3 and text.count("Train") == 3 and text.count(LONG.strip()) >= 6


def test_one_comment_alone_or_before_the_text_stays():
    assert "Anna" in main_text(article(after=comment("Anna", "3 hours ago", LONG)))
    first = "".join(comment(w, "3 hours ago", LONG) for w in ("Anna", "Ben"))
    assert "Anna" in main_text(f"<body><article><h1>T</h1><div>{first}</div><p>{PROSE}</p><p>{PROSE}</p></article></body>")


def test_ratios_decide_within_an_article(monkeypatch):
    """Of two containers with the same weak name, that of prose stays and that of labels goes; by names alone both fare alike."""
    prose = f"<div class=discussion><h2>Debate</h2><p>{PROSE}</p></div>"
    labels = "<div class=related><h2>More</h2>" + "".join(f"<span>Item {k}</span><hr>" for k in range(9)) + "</div>"
    text = main_text(article(prose, labels))
    assert "Debate" in text and "Item" not in text
    monkeypatch.setattr(webtext, "path_scores", lambda path, size, links, marks, prior: np.asarray(prior, float))
    without = main_text(article(prose, labels))
    assert ("Debate" in without) == ("Item" in without)
