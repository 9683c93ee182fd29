"""Pages with known main text, to train the extraction model on.

Each layout is a page whose elements say by ``y`` whether they belong to the article (1) or not (0);
an element without it takes its parent's. ``{p}`` stands for invented prose, ``{s}`` for a few words.
"""

from __future__ import annotations

import random

MENU = '<ul y=0><li y=0><a href="/a">{s}</a></li><li y=0><a href="/b">{s}</a></li><li y=0><a href="/c">{s}</a></li></ul>'
ARTICLE = [
    "<h1>{s}</h1><p>{p}</p><p>{p}</p>", "<h1>{s}</h1><p><b>{s}<br><p>{p}</p><p>{s}</p>", "<p>{p}</p>", "<h1>{s}</h1><p>{s}</p>",
    "<header y=1><h1>{s}</h1></header><p>{p}</p><h2>{s}</h2><p>{p} <a href='/x'>{s}</a> {s}</p>", "<h1>{s}</h1><div>{p}</div><div>{p}</div>",
    "<h2>{s}</h2><p>{p}</p><ul><li>{s}</li><li>{p}</li></ul><p>{p}</p>", "<h1>{s}</h1><blockquote><p>{p}</p></blockquote><pre>{s}</pre><p>{p}</p>",
    "<h1>{s}</h1><p>{p}</p><table><tr><td>{s}</td><td>{s}</td></tr></table><p>{p}</p>", "<h1>{s}</h1><section><h3>{s}</h3><p>{p}</p></section><figure><figcaption>{s}</figcaption></figure>",
    "<p>{s}</p><p>{s}</p><p>{s}</p><ol><li>{s}</li><li>{s}</li></ol><dl><dt>{s}</dt><dd>{p}</dd></dl>", "{p}", "<h1>{s}</h1>{p}<br>{p}",
]
INSIDE = [
    "", '<div class="ad" y=0>{s}</div>', '<aside class="related" y=0><h3>{s}</h3><ul><li><a href="/r">{s}</a></li></ul></aside>',
    '<div class="share social" y=0><a href="/t">{s}</a><a href="/f">{s}</a></div>', '<form class="newsletter subscribe" y=0><label>{s}</label><input><button>{s}</button></form>',
    '<div class="advertisement sponsored promo" y=0><p>{s}</p></div>', '<nav class="toc breadcrumb" y=0>' + MENU + "</nav>", '<div class="author byline meta" y=0>{s}</div>',
]
BEFORE = [
    "", "<nav y=0>" + MENU + "</nav>", '<header y=0><div class="logo">{s}</div><nav>' + MENU + "</nav></header>", '<div id="menu" class="nav navbar navigation" y=0>' + MENU + "</div>",
    '<div class="cookie notice banner consent" y=0><p>{s}</p><button>{s}</button></div>', '<div id="header" class="top masthead" y=0><h2>{s}</h2></div>',
    '<div class="ad" y=0>{s}</div>', '<div class="ad ads banner" y=0>{p}</div>', '<form class="search" y=0><input><button>{s}</button></form>',
    '<div class="breadcrumbs" y=0><a href="/">{s}</a> / <a href="/b">{s}</a></div>', '<div role="alert" class="notice popup modal" y=0>{p}</div>', '<div class="skip" y=0><a href="#m">{s}</a></div>',
]
AFTER = [
    "", "<footer y=0>&copy; {s}</footer>", '<aside y=0><h3>{s}</h3><p>{p}</p></aside>', '<div class="sidebar widget" id="sidebar" y=0><h3>{s}</h3>' + MENU + "</div>",
    '<div id="comments" class="comments" y=0><h3>{s}</h3><div class="comment"><p>{p}</p></div><div class="comment"><p>{s}</p></div></div>',
    '<section class="comments discussion replies" y=0><h2>{s}</h2><ol><li class="comment reply"><p>{p}</p></li></ol></section>', '<div class="footer copyright legal" id="footer" y=0><p>{s}</p></div>',
    '<form class="comment-form respond" y=0><label>{s}</label><textarea></textarea><button>{s}</button></form>', '<aside class="sidebar related recommended" y=0>' + MENU + "</aside>",
    '<div class="ad" y=0>{s}</div>', '<div class="popular trending more" y=0><a href="/1">{s}</a><a href="/2">{s}</a></div>', '<article class="comment" y=0><p>{p}</p></article>',
    '<div class="pagination pager" y=0><a href="/2">{s}</a></div>', '<div class="tags share" y=0><a href="/t">{s}</a></div>',
]
HOLDERS = ["<article y=1>{x}</article>", "<main y=1>{x}</main>", '<div class="content article post entry" id="content" y=1>{x}</div>', "<main y=0><article y=1>{x}</article></main>",
           '<div id="main" class="main wrapper container" y=0><div class="post-body article-content entry-content story text" y=1>{x}</div></div>', "<div y=0><div y=1>{x}</div></div>",
           '<article class="post" y=1>{x}</article>', '<section class="article story" y=1>{x}</section>', "<article y=1>{x}</article>"]


def pages(count: int = 600, seed: int = 7) -> list[str]:
    draw = random.Random(seed)

    def prose(words: int) -> str:
        return " ".join("".join(draw.choice("aeionrst") for _ in range(draw.randint(2, 8))) for _ in range(words)).capitalize() + "."

    def fill(x: str) -> str:
        while "{p}" in x or "{s}" in x:
            at, words = (x.find("{p}"), draw.randint(8, 60)) if "{p}" in x and (x.find("{s}") < 0 or x.find("{p}") < x.find("{s}")) else (x.find("{s}"), draw.randint(1, 6))
            x = x[:at] + prose(words) + x[at + 3:]
        return x

    out = []
    for _ in range(count):
        body = "".join(draw.choice(ARTICLE) + draw.choice(INSIDE) for _ in range(draw.choice([1, 1, 1, 2, 4])))
        around = [draw.choice(BEFORE) for _ in range(3)], [draw.choice(AFTER) for _ in range(3)]
        page = "".join(around[0]) + draw.choice(HOLDERS).replace("{x}", body) + "".join(around[1])
        out.append(fill(f"<!DOCTYPE html><html y=0><head><title>{{s}}</title></head><body y=0>{page}</body></html>"))
    return out
