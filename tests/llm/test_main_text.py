"""The page extractor over generated pages whose text is known, and its choice of passages against windows taken one by one."""

from __future__ import annotations

import random

from hypothesis import given, settings, strategies as st

from ragspark.llm.html_text import LINKS, SURGE, WINDOW, Line, chosen, main_text

WORDS = "amber basin cedar delta ember fjord grove heath inlet jetty knoll larch marsh north ocean plain quarry ridge shore tarn".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def generated(rng):
    """(page, text): one to three articles, short ones among them, with noise of every kind between and inside."""
    out, text = ["<header><a href='/'>" + prose(rng, 4) + "</a></header><nav><ul>" + "".join(f"<li><a href='/'>{prose(rng, 2)}</a></li>" for _ in range(6)) + "</ul></nav>"], []
    inside = [
        lambda: f"<div class='ad-slot'>{prose(rng, 40)}</div>", lambda: f"<ol class='comment-list'><li>{prose(rng, 30)}</li></ol>", lambda: f"<aside>{prose(rng, 40)}</aside>",
        lambda: f"<form>{prose(rng, 30)}<input></form>", lambda: "<script>let a = '<p>" + prose(rng, 30) + "</p>'</script>", lambda: f"<div class='newsletter-box'><p>{prose(rng, 30)}</p></div>",
        lambda: f"<article class='comment'><p>{prose(rng, 40)}</p></article>",
    ]
    for i in range(rng.randint(1, 3)):
        title = prose(rng, 3)
        out.append(f"<article id='a{i}'><h2>{title}</h2>")
        text.append(title)
        for _ in range(rng.choice((1, 1, 3, 6))):
            a, b = prose(rng, rng.choice((2, 8, 40))), prose(rng, 5)
            kind = rng.randrange(4)
            if kind == 0:
                out.append(f"<p>{a} <math><mi>x</mi><mo>+</mo><mn>1</mn></math> {b}</p>")
                text.append(f"{a} x+1 {b}")
            elif kind == 1:
                out.append(f"<p>{a} <svg width='9'><text>fig</text></svg>\n {b} &amp; more</p>")
                text.append(f"{a} fig {b} & more")
            elif kind == 2:
                out.append(f"<blockquote class='pull quote'>{a}</blockquote><ul><li>{b}</li></ul>")
                text += [a, b]
            else:
                out.append(f"<p id='menu'>{a}</p>")  # an anchor of the text
                text.append(a)
            if rng.random() < 0.5:
                out.append(rng.choice(inside)())
        out.append("</article>")
    out.append("<section class='comments-area'><h2>Comments</h2>" + "".join(f"<article class='comment-body' id='comment-{j}'><p>{prose(rng, 40)}</p></article>" for j in range(3)) + "</section>")
    out.append(f"<div id='sidebar'>{prose(rng, 60)}</div><footer>{prose(rng, 30)}</footer>")
    return f"<!doctype html><html><head><title>{prose(rng, 5)}</title></head><body class='comments-open'>{''.join(out)}</body></html>", "\n".join(text)


def test_generated_pages():
    rng = random.Random(11)
    for _ in range(200):
        page, text = generated(rng)
        assert main_text(page) == text


def plain_choice(lines):
    """Every window summed anew: lines belong to one passage as long as some window over a line and its neighbour holds text."""
    n, text = len(lines), [len(x.text) for x in lines]
    windows = {i: sum(text[max(0, i) : i + WINDOW]) for i in range(1 - WINDOW, n)}
    groups, i = [], 1 - WINDOW
    while i < n:
        if windows[i]:
            j = i
            while j < n and windows[j]:
                j += 1
            groups.append((max(0, i + WINDOW - 1), j, max(windows[x] for x in range(i, j))))
            i = j
        i += 1
    found = [(a, z, p) for a, z, p in groups if lines[a].inside or sum(x.linked for x in lines[a:z]) < LINKS * sum(text[a:z])]
    bar = min(SURGE, max((p for _, _, p in found), default=0) / 2)
    good = {lines[a].region for a, z, p in found if p >= bar or any(x.heading for x in lines[a:z])}
    inside = any(lines[a].region in good and lines[a].inside for a, _, _ in found)
    return [(a, z) for a, z, _ in found if lines[a].region in good and lines[a].inside == inside]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 0, 0, 1, 12, 40, 200]), st.integers(0, 2), st.booleans(), st.integers(0, 12)), max_size=40), st.integers(0, 3))
def test_passages_against_every_window(rows, switch):
    lines, region = [], 0
    for length, new, heading, linked in rows:
        if new == 2:
            region += 1
            lines += [Line("", region, region % 4 == switch, False, 0)] * WINDOW
        lines.append(Line("x" * length, region, region % 4 == switch, heading and length > 0, min(linked * 4, length)))
    assert chosen(lines) == plain_choice(lines)


def test_names_that_only_tell_a_state_are_no_comments():
    body = " ".join(WORDS)
    assert main_text(f"<div class='comments-open'><article class='post comment-status-open'><h1>T</h1><p>{body}</p></article></div>") == f"T\n{body}"


def test_two_articles_of_which_one_is_short():
    body = " ".join(WORDS * 3)
    assert main_text(f"<article><h1>T</h1><p>Short one.</p></article><article><h1>U</h1><p>{body}</p></article>") == f"T\nShort one.\nU\n{body}"
