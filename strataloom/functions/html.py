"""A page's blocks of text: a state machine over the tags of the page."""

from __future__ import annotations

import html
import re

#: Elements that begin and end a block of text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold what surrounds the content of a page.
FURNITURE = frozenset("nav footer aside header form menu button select dialog".split())
#: Elements whose content isn't text.
RAW = frozenset("script style noscript template textarea iframe svg math".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_token = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9]*)(?:[^"'>]|"[^"]*"|'[^']*')*>?|[^<]+|<""", re.DOTALL)
_raw_end = {name: re.compile(f"</{name}", re.IGNORECASE) for name in RAW}
_blank = re.compile("[\x09-\x0d\x20\xa0]+")


def blocks_of(page: str | None) -> tuple[str, list[tuple[str, int, int, bool, bool]]]:
    """The title, and of each block with a word: text, words, words within links, whether it is furniture, whether it is a heading.

    Tags that are never closed, quotes that never end, a page cut anywhere and stray '<' are read as they come: nothing raises, and every character is looked at a bounded number of times.
    """
    page = page or ""
    blocks, parts, title = [], [], []
    links = link_words = furniture = 0
    in_title = heading = False
    at, end = 0, len(page)

    def close():
        nonlocal link_words
        text = _blank.sub(" ", "".join(parts)).strip(" ")
        if text:
            blocks.append((text, text.count(" ") + 1, link_words, furniture > 0, heading))
        parts.clear()
        link_words = 0

    while at < end:
        found = _token.match(page, at)
        token, at = found.group(), found.end()
        name = (found.group(2) or "").lower()
        if not name:
            if token[:2] in ("<!", "<?"):
                continue
            text = html.unescape(token)
            if in_title:
                title.append(text)
                continue
            parts.append(text)
            if links:
                link_words += len(_blank.sub(" ", text).strip(" ").split(" ")) if _blank.sub("", text) else 0
            continue
        closing = bool(found.group(1))
        if name in RAW and not closing:
            over = _raw_end[name].search(page, at)
            at = over.start() if over else end
        elif name == "title":
            in_title = not closing
        elif name == "a":
            links = max(0, links + (-1 if closing else 1))
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            close()
            if name in FURNITURE:
                furniture = max(0, furniture + (-1 if closing else 1))
            heading = name in HEADINGS and not closing
            links = 0  # an anchor that was never closed ends with its block
    close()
    return _blank.sub(" ", "".join(title)).strip(" "), blocks

