"""Web pages as text. A page is read once, tag by tag; what an element becomes is decided where it ends."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that are dropped, that end a line, that break one, that never have content.
DROPPED = ("script", "style", "noscript")
ENDS = {"p", "div", "section", "article", "header", "footer", "table", "tr", "ul", "ol"}
BREAKS = {"br", "hr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Entities that are decoded beside numbers.
ENTITIES = {"nbsp": " ", "amp": "&", "quot": '"', "lt": "<", "gt": ">"}
# Elements and classes that hide, and the values of properties that do.
HIDDEN_TAGS = {"meta", "template", "svg", "canvas", "iframe", "object", "embed"}
HIDDEN_CLASSES = {"sr-only", "visually-hidden", "d-none", "hidden", "invisible", "screen-reader-only", "offscreen"}
HIDDEN_VALUES = {
    "display": r"none",
    "visibility": r"hidden",
    "opacity": r"0",
    "font-size": r"0(px|em|rem|pt|%)?",
    "text-indent": r"-\d{4,}px",
    "color": r"transparent|rgba\s*\(\s*\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*0(\.0+)?\s*\)|hsla\s*\(\s*[\d.]+\s*,\s*[\d.]+%?\s*,\s*[\d.]+%?\s*,\s*0(\.0+)?\s*\)",
    "clip-path": r"(?!none$).*inset\s*\(\s*(0*\.\d+|[1-9]\d*(\.\d+)?)%.*",
    "transform": r".*(scale\s*\(\s*0\s*\)|translate[XY]\s*\(\s*-\d{4,}px\s*\)).*",
    "left": r"-\d{4,}px",
    "top": r"-\d{4,}px",
}
#: These hide together only.
HIDDEN_BOX = {"width": r"0(px)?", "height": r"0(px)?", "overflow": r"hidden"}
# The original does not search larger or deeper pages for their main content; nor does to_main().
MAIN_CHARS, MAIN_DEPTH = 1_000_000, 3_000


def whole(s: str) -> str:
    """Text in which surrogates that stand side by side are one character, and others U+FFFD, which any encoding can hold."""
    return s.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if re.search("[\ud800-\udfff]", s) else s


def squeezed(s: str) -> str:
    """Lines without blanks at their ends, runs of blanks as one space, at most one empty line in a row."""
    lines: list[str] = []
    for line in s.replace("\r", "").split("\n"):
        line = re.sub(r"[ \t]{2,}", " ", line.rstrip(" \t"))
        if line or not lines or lines[-1]:
            lines.append(line)
    return "\n".join(lines).strip()


class _Markdown(HTMLParser):
    """Open elements that become something, each with the text inside it so far; the first is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open: list[tuple[str, str, list[str]]] = [("", "", [])]
        self.count: Counter[str] = Counter()  # of open elements by tag
        self.title: str | None = None
        self.main = ""
        self.dropped = ""

    def say(self, s: str) -> None:
        if not self.dropped:
            self.open[-1][2].append(s)

    def begin(self, tag: str, href: str) -> None:
        self.open.append((tag, href, []))
        self.count[tag] += 1

    def handle_starttag(self, tag, attrs):
        if self.dropped:
            return
        if tag in DROPPED:
            self.dropped = tag
        elif tag in BREAKS:
            self.say("\n")
        elif tag in ("title", "li", "article", "main") or re.fullmatch("h[1-6]", tag):
            self.begin(tag, "")
        elif tag == "a" and (href := dict(attrs).get("href")):
            self.begin(tag, href)

    def handle_startendtag(self, tag, attrs):
        if tag in BREAKS:
            self.say("\n")

    def handle_endtag(self, tag):
        if self.dropped:
            if tag == self.dropped:
                self.dropped = ""
            return
        if self.count[tag]:
            while self.close(self.open[-1][0] == tag) != tag:
                pass
        if tag in ENDS:
            self.say("\n")

    def close(self, ended: bool) -> str:
        """Closes the innermost element; one that was never ended leaves its text as it is."""
        tag, href, inside = self.open.pop()
        self.count[tag] -= 1
        text = "".join(inside)
        label = squeezed(whole(text)) if ended else ""
        if not ended:
            pass
        elif tag == "title":
            self.title = label if self.title is None else self.title
        elif tag == "a":
            text = f"[{label}]({href})" if label else href
        elif tag == "li":
            text = label and f"\n- {label}"
        elif tag in ("article", "main"):
            self.main = max(self.main, label, key=len)
        else:
            text = f"\n{'#' * int(tag[1])} {label}\n"
        self.say(text)
        return tag

    def handle_data(self, data):
        self.say(data)

    def handle_entityref(self, name):
        self.say(ENTITIES.get(name.lower(), f"&{name};"))

    def handle_charref(self, name):
        digits, base = (name[1:], 16) if name[:1] in "xX" else (name, 10)
        # a code unit, as in the original, to which a number too large for a double is none
        self.say(chr(int(digits, base) & 0xFFFF if len(digits) < 256 else 0))

    def read(self, page: str) -> str:
        self.feed(page)
        self.close_all()
        return squeezed(whole("".join(self.open[0][2])))

    def close_all(self) -> None:
        super().close()
        while len(self.open) > 1:
            self.close(False)


def to_markdown(page: str | None) -> tuple[str | None, str | None]:
    """Text and title: links, headings, list items and line ends become Markdown, other tags go."""
    if page is None:
        return None, None
    p = _Markdown()
    return p.read(page), p.title


def main_of(page: str | None) -> tuple[str | None, str | None]:
    """As to_markdown(), of the longest `article` or `main` element, or where the page names none that has text, of what weighs
    most by its paragraphs; of all where nothing does. Pages of any size and depth are searched."""
    from larkspur.functions.content import main_parts

    if page is None:
        return None, None
    p = _Markdown()
    whole_page = p.read(page)
    inner = p.main or "\n\n".join(filter(None, (to_markdown(page[a:b])[0] for a, b in main_parts(page))))
    return inner or whole_page, p.title


def to_main(page: str | None) -> tuple[str | None, str | None]:
    """main_of() within the original's bounds, all of a page beyond them. No column or query goes by it."""
    if page is not None and (len(page) > MAIN_CHARS or depth(page) > MAIN_DEPTH):
        return to_markdown(page)
    return main_of(page)


def _struct_of(page: Column, make) -> Column:
    @F.pandas_udf("text string, title string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([make(x) for x in s], columns=["text", "title"])

    return run(page)


def markdown(page: Column) -> Column:
    """Struct of text and title. What an element becomes depends on all that is inside it: Python, in batches."""
    return _struct_of(page, to_markdown)


def main_content(page: Column) -> Column:
    """Struct of text and title of a page's main content, however large the page; of all of it where it has none."""
    return _struct_of(page, main_of)


#: Marks of a line in Markdown: what begins it, and inside it pictures (group 1), links (label in 2) and code (in 3).
LINE_START = r"^(?:#{1,6}[ \t]+|[ \t]*[-*+][ \t]+|[ \t]*[0-9]+\.[ \t]+)"
INLINE = r"(!\[[^\]]*\]\([^)]+\))|\[([^\]]+)\]\([^)]+\)|`([^`]+)`"
FENCE = r"^[ \t]*```[^`]*$"


def plain_text(md: Column) -> Column:
    """Markdown without its marks, line by line: fences go, at most one empty line stays in a row."""

    def bare(line: Column) -> Column:
        line = F.regexp_replace(F.regexp_replace(line, INLINE, "$2$3"), LINE_START, "")
        return F.regexp_replace(F.regexp_replace(line, r"[ \t]+$", ""), r"[ \t]{2,}", " ")

    lines = F.filter(F.split(F.replace(md, F.lit("\r"), F.lit("")), "\n"), lambda x: ~x.rlike(FENCE))
    return F.regexp_replace(F.regexp_replace(F.array_join(F.transform(lines, bare), "\n"), r"\n{3,}", "\n\n"), r"^[ \t\n]+|[ \t\n]+$", "")


def visible_text(page: Column) -> Column:
    """What is left of a page by expressions alone: scripts, comments and tags out, six entities decoded, spaces collapsed."""
    for tag in DROPPED:
        page = F.regexp_replace(page, rf"(?is)<{tag}.*?</{tag}>", "")
    page = F.regexp_replace(F.regexp_replace(page, "(?s)<!--.*?-->", ""), "<[^>]+>", " ")
    for name, c in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        page = F.replace(page, F.lit(name), F.lit(c))
    return F.trim(F.regexp_replace(page, r"[ \t\r\n]+", " "))


#: A tag: whether it closes and its name in group 1, a slash at its end in group 2.
TAG = r"<(/?[a-zA-Z][a-zA-Z0-9-]*)[^>]*?(/?)>"


def depth(page: str) -> int:
    """The deepest nesting of elements that have content."""
    deep = now = 0
    for name, alone in re.findall(TAG, page):
        if not alone and name.lower().lstrip("/") not in VOID:
            now = max(0, now - 1) if name[0] == "/" else now + 1
            deep = max(deep, now)
    return deep


def nesting(page: Column) -> Column:
    """depth() as an expression; 0 for null."""
    names = F.regexp_extract_all(page, F.lit(TAG), F.lit(1))
    alone = F.regexp_extract_all(page, F.lit(TAG), F.lit(2))
    void = F.array(*[F.lit(x) for x in sorted(VOID)])

    def step(s: Column, t: Column) -> Column:
        name = F.lower(t["name"])
        counts = (t["alone"] == "") & ~F.array_contains(void, F.ltrim(name, F.lit("/")))
        now = F.when(~counts, s["now"]).when(name.startswith("/"), F.greatest(F.lit(0), s["now"] - 1)).otherwise(s["now"] + 1)
        return F.struct(now.alias("now"), F.greatest(s["deep"], now).alias("deep"))

    tags = F.zip_with(names, alone, lambda a, b: F.struct(a.alias("name"), b.alias("alone")))
    return F.coalesce(F.aggregate(tags, F.struct(F.lit(0).alias("now"), F.lit(0).alias("deep")), step, lambda s: s["deep"]), F.lit(0))


def hides(style: str) -> bool:
    """Whether an inline style hides its element. A property's first declaration counts."""
    declared: dict[str, str] = {}
    for part in style.split(";"):
        name, _, value = part.partition(":")
        declared.setdefault(name.strip().lower(), value.strip())
    fits = lambda name, pattern: name in declared and re.fullmatch(pattern, declared[name], re.I | re.S) is not None
    return any(fits(*x) for x in HIDDEN_VALUES.items()) or all(fits(*x) for x in HIDDEN_BOX.items())


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.hidden: list[str] = []

    @staticmethod
    def gone(tag: str, attrs: dict[str, str | None]) -> bool:
        classes = set((attrs.get("class") or "").lower().split())
        return bool(
            tag in HIDDEN_TAGS or "hidden" in attrs or attrs.get("aria-hidden") == "true" or classes & HIDDEN_CLASSES
            or hides(attrs.get("style") or "") or tag == "input" and (attrs.get("type") or "").lower() == "hidden"
        )

    def handle_starttag(self, tag, attrs):
        if self.hidden or self.gone(tag, dict(attrs)):
            if tag not in VOID:
                self.hidden.append(tag)
        else:
            self.out.append(self.get_starttag_text())

    def handle_startendtag(self, tag, attrs):
        if not self.hidden and not self.gone(tag, dict(attrs)):
            self.out.append(self.get_starttag_text())

    def handle_endtag(self, tag):
        if not self.hidden:
            self.out.append(f"</{tag}>")
        elif tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def without_hidden(page: Column) -> Column:
    """A page without comments and elements that a reader would not see."""

    def clean(x: str | None) -> str | None:
        if x is None:
            return None
        p = _Visible()
        p.feed(x)
        p.close()
        return "".join(p.out)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(clean)

    return run(page)
