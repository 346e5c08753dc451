"""Extraction where only the tag-path ratios tell the article, and its cost on deep pages."""

import time

import pytest

from brindle.llm import html_text

LONG = "Ein langer Absatz, der von Dingen handelt, die geschehen sind; er hat Satzzeichen, Kommas und einen Schluss. Noch ein Satz folgt, damit er lang ist."
LINKS = "".join(f"<li><a href='/{k}'>Thema {k}</a></li>" for k in range(8))
#: Pages without article or main elements and without telling names: what is around the text, and the text.
PAGES = [
    (f"<div class='x1'><ul>{LINKS}</ul></div><div class='x2'><h1>Titel</h1><p>{LONG}</p><p>{LONG}</p><p>Kurz.</p></div><div class='x4'><p>Alle Rechte</p></div>", f"Titel {LONG} {LONG} Kurz."),
    (f"<table><tr><td class='l'>{LINKS}</td><td class='r'><p>{LONG}</p><p>{LONG}</p></td></tr></table><div class='z'>Impressum</div>", f"{LONG} {LONG}"),
    (f"<div class='t'><span>Heute</span> <a href='/a'>Mehr</a></div><section class='s'><p>{LONG}</p><ul><li>Punkt eins</li></ul><p>{LONG}</p></section><div class='u'><a href='/x'>Weiter</a> <a href='/y'>Nach oben</a></div>", f"{LONG} Punkt eins {LONG}"),
]


@pytest.mark.parametrize(("body", "want"), PAGES)
def test_ratios_choose(monkeypatch, body, want):
    page = f"<html><body>{body}</body></html>"
    assert html_text.main_text(page) == want
    values = html_text.path_values
    monkeypatch.setattr(html_text, "path_values", lambda blocks: dict.fromkeys(values(blocks), 1.0))
    assert html_text.main_text(page) != want  # without the ratios, what is around the text stays


def test_priors():
    assert html_text.main_text(f"<div class='sidebar'><p>{LONG}</p><p>{LONG}</p></div><div><p>Ein kurzer Text.</p></div>") == "Ein kurzer Text."
    assert html_text.main_text(f"<nav><p>{LONG}</p></nav>") == "" == html_text.main_text("") == html_text.main_text(None)


def test_depth_is_linear():
    def took(n):
        start = time.process_time()
        html_text.main_text("<div>" * n + "x " * 9)
        return time.process_time() - start

    took(1000)
    assert took(16000) < 40 * took(1000) + 0.5
