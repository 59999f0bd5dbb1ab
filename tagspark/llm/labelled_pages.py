"""Labelled pages to train the content model on.

Pages are put together from parts in the ways sites write them: with elements named for their role, with classes or ids,
with tables, or with bare blocks. `data-y` on an element says whether what it holds is content (1) or not (0); what has
none takes its parent's. Words carry no meaning here: the model sees the shape of a text alone.
"""

from __future__ import annotations

from random import Random

SYLLABLES = ["ta", "mi", "ron", "el", "vas", "ko", "ne", "pri", "ul", "de", "sha", "on", "ber", "qui", "la", "fe", "gor", "ist"]


def word(r: Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3))))


def words(r: Random, low: int, high: int) -> str:
    return " ".join(word(r) for _ in range(r.randint(low, high)))


def sentences(r: Random, low: int, high: int) -> str:
    made = [words(r, 4, 18).capitalize() + r.choice(".....!?") for _ in range(r.randint(low, high))]
    text = " ".join(made) if r.random() < 0.9 else made[0].replace(".", "")
    if r.random() < 0.08:
        text = text.replace(" ", r.choice((" | ", "!! ", "*** ", " - ", "&amp; ")))
    return text.upper() if r.random() < 0.04 else text


def links(r: Random, n: int, item: str = "li") -> str:
    return "".join(f'<{item}><a href="/{word(r)}">{words(r, 1, 3)}</a></{item}>' for _ in range(n))


def boxed(r: Random, inside: str, y: int, tag: str | None, names: list[str], bare: float = 0.15) -> str:
    """The part in its own element, or in a div with a telling class or id, or in a bare one."""
    kind = r.random()
    if tag and kind < 0.45:
        return f'<{tag} data-y="{y}">{inside}</{tag}>'
    if kind > 1 - bare:
        return f'<div data-y="{y}">{inside}</div>'
    name, more = r.choice(names), r.choice(["", f" {word(r)}", f" {word(r)}-box"])
    return f'<{r.choice(("div", "div", "section"))} data-y="{y}" {r.choice(("class", "class", "id"))}="{name}{more}">{inside}</div>'


def paragraph(r: Random) -> str:
    kind, text = r.random(), sentences(r, 1, 7)
    if kind < 0.12:
        text = words(r, 1, 4).capitalize() + "."
    if kind > 0.85:
        text = text.replace(" ", f' <a href="/{word(r)}">{words(r, 1, 3)}</a> ', 1)
    if kind > 0.95:
        return f"<p><b>{text}<br>"
    return f"<p>{text}</p>" if r.random() < 0.9 else f"<p>{text}"


def article(r: Random) -> str:
    """The main text: a heading, paragraphs and what stands among them, part of it not content."""
    parts = [f"<h1>{words(r, 2, 12).capitalize()}{r.choice(['', '.', '?'])}</h1>"] if r.random() < 0.85 else []
    for _ in range(r.choice((1, 2, 3, 4, 6, 9))):
        kind = r.random()
        if kind < 0.68:
            parts.append(paragraph(r))
        elif kind < 0.74:
            parts.append(f"<h{r.choice('234')}>{words(r, 1, 6)}</h2>")
        elif kind < 0.80:
            parts.append("<ul>" + "".join(f"<li>{sentences(r, 1, 2) if r.random() < 0.6 else words(r, 1, 5)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.83:
            parts.append(f"<blockquote>{paragraph(r)}</blockquote>")
        elif kind < 0.86:
            parts.append("<table>" + "".join(f"<tr><td>{words(r, 1, 3)}</td><td>{r.randint(1, 999)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
        elif kind < 0.89:
            parts.append(f'<figure><img src="x"><figcaption>{sentences(r, 1, 1)}</figcaption></figure>')
        elif kind < 0.91:
            parts.append(f"<pre>{words(r, 3, 20)}</pre>")
        elif kind < 0.94:
            parts.append(advert(r))
        elif kind < 0.97:
            parts.append(boxed(r, f"<ul>{links(r, 3)}</ul>", 0, "aside", ["related", "share-buttons", "social", "read-more", "tags"], 0.02))
        else:
            parts.append(form(r))
    return "".join(parts)


def advert(r: Random) -> str:
    inside = r.choice((sentences(r, 1, 3), f"<p>{sentences(r, 1, 2)}</p>", f'<a href="/x">{words(r, 2, 6)}</a>'))
    return boxed(r, inside, 0, None, ["ad", "ads", "advert", "advertisement", "banner-ad", "sponsored", "promo", "ad-slot"], 0.0)


def form(r: Random) -> str:
    fields = "".join(f'<label>{words(r, 1, 2)}</label><input name="{word(r)}">' for _ in range(r.randint(1, 3)))
    inside = f"{r.choice(['', '<p>' + sentences(r, 1, 1) + '</p>'])}{fields}<button>{word(r)}</button>"
    return boxed(r, f"<form>{inside}</form>", 0, None, ["newsletter", "login", "search", "subscribe", "contact-form"], 0.2) if r.random() < 0.5 else f'<form data-y="0">{inside}</form>'


def navigation(r: Random) -> str:
    inside = r.choice((f"<ul>{links(r, r.randint(2, 9))}</ul>", links(r, r.randint(2, 7), "span"), links(r, r.randint(2, 5), "div")))
    return boxed(r, inside, 0, "nav", ["nav", "menu", "navbar", "main-menu", "breadcrumbs", "pagination", "topnav"])


def header(r: Random) -> str:
    inside = r.choice((f"<h1><a href='/'>{words(r, 1, 3)}</a></h1>", f"<p>{words(r, 1, 6)}</p>", f"<div>{words(r, 1, 3)}</div>{navigation(r)}", sentences(r, 1, 1)))
    return boxed(r, inside, 0, "header", ["header", "site-header", "masthead", "topbar", "banner"], 0.05)


def footer(r: Random) -> str:
    inside = r.choice((f"&copy; {words(r, 1, 4)}", f"<p>&copy; 20{r.randint(10, 26)} {words(r, 1, 4)} &middot; {sentences(r, 1, 1)}</p>", f"<ul>{links(r, 4)}</ul><p>{sentences(r, 1, 2)}</p>", sentences(r, 1, 3)))
    return boxed(r, inside, 0, "footer", ["footer", "site-footer", "copyright", "bottom", "legal"], 0.05)


def sidebar(r: Random) -> str:
    inside = r.choice((f"<h3>{words(r, 1, 3)}</h3><ul>{links(r, 5)}</ul>", f"<h4>{words(r, 1, 3)}</h4><p>{sentences(r, 1, 3)}</p>", "".join(f"<p><a href='/'>{words(r, 3, 8)}</a></p>" for _ in range(3))))
    return boxed(r, inside, 0, "aside", ["sidebar", "side", "widget", "related-posts", "aside", "rail"], 0.02)


def notice(r: Random) -> str:
    inside = f"<p>{sentences(r, 1, 3)}</p>{r.choice(['', '<button>' + word(r) + '</button>'])}"
    return boxed(r, inside, 0, None, ["cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "modal", "cookie-banner", "disclaimer"], 0.0)


def comments(r: Random) -> str:
    one = lambda: f'<div class="{r.choice(("comment", "reply", "comment-body", ""))}"><b>{word(r)}</b><p>{sentences(r, 1, 3)}</p></div>'
    listed = r.choice(("".join(one() for _ in range(r.randint(1, 4))), "<ol>" + "".join(f"<li>{one()}</li>" for _ in range(r.randint(1, 4))) + "</ol>"))
    return boxed(r, f"<h3>{words(r, 1, 2)}</h3>{listed}", 0, None, ["comments", "comment-list", "discussion", "responses", "reader-comments", "disqus"], 0.0)


def beside(html: str, seed: int) -> str:
    """The article of some pages with buttons, hidden parts and fallbacks of images after its paragraphs."""
    r = Random(f"beside {seed}")
    if r.random() < 0.7:
        return html
    extra = (
        lambda: f"<button>{word(r)}</button>",
        lambda: '<noscript><img src="x"></noscript>',
        lambda: f'<div aria-hidden="true">{r.choice(("", word(r)[:1], word(r), sentences(r, 1, 2)))}</div>',
        lambda: f'<p hidden="hidden">{sentences(r, 1, 2)}</p>',
        lambda: f'<div style="display:none">{sentences(r, 1, 1)}</div>',
    )
    parts = html.split("</p>")
    return "".join(part + ("</p>" + (r.choice(extra)() if r.random() < 0.5 else "") if i < len(parts) - 1 else "") for i, part in enumerate(parts))


def page(seed: int) -> str:
    """One labelled page."""
    r = Random(seed)
    main = beside(article(r), seed)
    if r.random() < 0.08:
        main = "".join(f"<p>{sentences(r, 1, 4)}</p>" for _ in range(r.randint(2, 5)))
    if r.random() < 0.1:
        main = "".join(f"<p>{words(r, 1, 4).capitalize()}.</p>" for _ in range(r.randint(1, 3)))
    kind = r.random()
    if kind < 0.4:
        main = f'<article data-y="1">{main}</article>'
    elif kind < 0.55:
        main = f'<main data-y="1">{main}</main>'
    elif kind < 0.62:
        main = f'<table><tr><td class="{r.choice(("", "left", "menu"))}" data-y="0"><ul>{links(r, 5)}</ul></td><td data-y="1">{main}</td></tr></table>'
    else:
        main = boxed(r, main, 1, None, ["content", "post", "entry", "article-body", "story", "main-content", "post-content", "text", "page-content"], 0.25)
    if r.random() < 0.3:
        main = r.choice((f"<main>{main}</main>", f'<div class="{r.choice(("wrapper", "container", "row", "layout"))}">{main}{sidebar(r)}</div>', f"<section>{main}</section>"))
    before = [f(r) for f, p in ((notice, 0.25), (header, 0.4), (navigation, 0.75), (advert, 0.4)) if r.random() < p]
    after = [f(r) for f, p in ((comments, 0.35), (sidebar, 0.35), (form, 0.2), (advert, 0.15), (notice, 0.1), (navigation, 0.1), (footer, 0.75)) if r.random() < p]
    if r.random() < 0.3:
        r.shuffle(before)
    body = "".join(before) + main + "".join(after)
    if r.random() < 0.25:
        body = f'<div id="{r.choice(("page", "wrap", "root", "container"))}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(r, 2, 6)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def pages(count: int) -> list[str]:
    return [page(seed) for seed in range(count)]
