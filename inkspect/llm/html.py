"""Blocks of text of an HTML page with the path of elements that each stands in."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Elements that end a block of text, that have no end, that hold no text to read.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set(
    "applet audio button canvas datalist head iframe input math noframes noscript object optgroup option script select "
    "style svg template textarea title video".split()
)
# Elements that a start tag closes if they are open, and where the search for them ends.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
# Elements, roles and class or id names that declare what is not the article. A name
# declares it if it consists of such words, alone or with words for a place or a container.
NOISE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog"}
NOISE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NOISE_NAMES = set(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "gdpr login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted promotion "
    "related replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
NEUTRAL_NAMES = set(
    "area articles bar block body bottom box btn button buttons col column container content desktop div element form "
    "global group header holder icon icons id inner item items js left level line link links list main message mobile "
    "module outer overlay page panel placeholder popover post posts primary right row secondary section site slot stories "
    "text title top ui unit wrap wrapper zone".split()
)
CONTENT_TAGS = {"article", "main"}
_NAME_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _declares(name: str) -> bool:
    """Whether a class or id says that its element isn't part of the article: ``ad-slot`` does, ``ad-hoc`` doesn't."""
    words = set(_NAME_PARTS.findall(_CAMEL.sub(" ", name).lower()))
    return bool(words & NOISE_NAMES) and words <= NOISE_NAMES | NEUTRAL_NAMES


class _Reader(HTMLParser):
    """Open elements as (tag, label, noise, content, silent), each flag holding for what is inside."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, bool, bool, bool]] = []
        self.blocks: list[tuple[str, str, bool, bool]] = []
        self.text: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            path = ">".join(label for tag, label, *_ in self.open if tag in BLOCKS)
            noise, content = self.open[-1][2:4] if self.open else (False, False)
            self.blocks.append((path, text, noise, content))

    def _pop(self, at: int) -> None:
        self.flush()
        del self.open[at:]

    def _close(self, tags: set[str], stop: set[str]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                self._pop(i)
                return
            if self.open[i][0] in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
        elif tag in BLOCKS:
            self.flush()
            # An open paragraph ends at the next block; cells and items end at their like.
            self._close({"p"}, BLOCKS - {"p"})
            if tag in CLOSES:
                self._close(*CLOSES[tag])
        if tag in VOID:
            return
        named = {k: v or "" for k, v in attrs}
        classes = named.get("class", "").split()
        _, _, noise, content, silent = self.open[-1] if self.open else ("", "", False, False, False)
        noise = noise or tag in NOISE_TAGS or named.get("role", "") in NOISE_ROLES or "hidden" in named
        # The page itself may carry such a name without being one.
        noise = noise or (tag not in ("html", "body", *CONTENT_TAGS) and any(map(_declares, [*classes, named.get("id", "")])))
        noise = noise or (tag == "header" and not content)
        content = content or tag in CONTENT_TAGS or named.get("role") == "main"
        label = ".".join([tag, *sorted(c.lower() for c in classes)])
        self.open.append((tag, label, noise, content, silent or tag in SILENT))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self.text.append(" ")
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in BLOCKS or any(o[0] in BLOCKS for o in self.open[i:]):
                    self.flush()
                del self.open[i:]
                return

    def handle_data(self, data):
        if not (self.open and self.open[-1][4]):
            self.text.append(data)


def blocks(html: str | None) -> list[tuple[str, str, bool, bool]]:
    """(path, text, declared noise, inside an article) of each block, in page order."""
    for source in (html or "", re.sub(r"<!(?!--)", "<", html or "")):
        reader = _Reader()
        try:
            reader.feed(source)
            reader.close()
        except AssertionError:  # a declaration that the parser can't read
            continue
        reader.flush()
        return reader.blocks
    return []
