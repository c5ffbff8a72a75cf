"""A small, forgiving DOM: tag tree of an HTML text, built without recursion."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"""(?s)<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_ATTR = re.compile(r"""(?s)\b(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"(?is)</{t}\s*>|</{t}\Z|\Z") for t in "script style textarea title noframes iframe xmp".split()}
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td
tfoot th thead tr ul""".split())
#: Opening the key closes an open element of the value, up to one of the fences.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "body": {"head"}}
FENCE = frozenset("ul ol dl table article section div main nav aside header footer body select form blockquote".split())


class Node:
    """``sig``: tag with its class, id and role words (digits folded); ``marks``: those of its words that don't come
    from the id; ``kids``: nodes and texts in order."""

    __slots__ = ("tag", "sig", "words", "marks", "kids", "around")

    def __init__(self, tag: str, words: tuple[str, ...] = (), marks: tuple[str, ...] | None = None):
        self.tag, self.words, self.marks, self.kids = tag, words, words if marks is None else marks, []
        self.around: bool | None = None
        self.sig = tag + "".join("." + w for w in words)


def _words(attributes: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """All words, and those of other attributes than the id; the attribute hidden is ``[hidden]``."""
    if "=" not in attributes and "hidden" not in attributes.lower():
        return (), ()
    found, ids = [], []
    for name, *values in _ATTR.findall(attributes):
        value = next((v for v in values if v), "")
        if name.lower() in ("hidden", "aria-hidden"):
            found += ["[hidden]"] if name.lower() == "hidden" or value.lower() == "true" else []
        else:
            (ids if name.lower() == "id" else found).extend(_DIGITS.sub("#", w.lower()) for w in value.split())
    return tuple(sorted({*found, *ids})), tuple(sorted(set(found)))


def parse(html: str) -> Node:
    """The tree under a ``#root`` node.  Unclosed elements end with their parent, stray end tags go, an
    unfinished tag at the end goes; contents of scripts and styles are dropped."""
    root = Node("#root")
    stack = [root]
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            rest = html[at:]
            cut = re.search(r"<[/!?a-zA-Z][^<]*\Z", rest)
            if cut:
                rest = rest[:cut.start()]
            if rest:
                stack[-1].kids.append(rest)
            break
        if m.start() > at:
            stack[-1].kids.append(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in FENCE:  # an inline end tag doesn't close a section
                    break
            continue
        shut = CLOSES.get(tag, ())
        if tag in BLOCK and tag not in ("body", "html"):
            shut = {"p", *shut}
        if shut:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in shut:
                    del stack[k:]
                    break
                if stack[k].tag in FENCE:
                    break
        node = Node(tag, *(_words(m[3]) if m[3] else ()))
        stack[-1].kids.append(node)
        if tag in RAW:
            end = RAW[tag].search(html, at)
            at = end.end()
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root
