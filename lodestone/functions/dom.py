"""Pages as trees: pruning of navigation and noise, runs of text by tag, heads of plain texts."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What is always pruned, and which tag an element's text has (fixed values).
PURGED = frozenset(("nav", "iframe", "noscript", "footer", "header"))
BAD_CLASSES = frozenset(("cookie-banner", "cookie", "cookie-notice", "cookie-policy", "nav", "navigation", "footer", "header", "menu", "toolbar", "tooltip", "alert", "alertdialog", "banner", "onetrust-consent-sdk"))
BAD_ROLES = frozenset(("alert", "alertdialog", "navigation", "banner", "dialog", "menu", "toolbar", "tooltip"))
TAG_OF = {"a": "anchor", "title": "title", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "code": "code", "pre": "code", "nav": "nav", "header": "nav", "footer": "nav"}
SKIPPED = frozenset(("script", "style", "form", "button", "select", "input", "textarea"))


class Node:
    __slots__ = ("attrs", "kids", "name")

    def __init__(self, name: str, attrs: dict[str, str]) -> None:
        self.name, self.attrs, self.kids = name, attrs, []


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def collapsed(text: str) -> int:
    return len(re.sub(r"\s+", " ", text).strip())


def purged(n: Node) -> bool:
    classes = {c.lower() for c in n.attrs.get("class", "").split()}
    return n.name in PURGED or bool(classes & BAD_CLASSES) or n.attrs.get("role", "").lower() in BAD_ROLES or n.attrs.get("aria-hidden", "").lower() == "true"


def prune(root: Node, threshold: float) -> Node:
    """Takes out purged elements, links and others without text of their own, and larger ones whose share of text outside links is below the threshold."""

    def size(n: Node, depth: int) -> tuple[int, int, int] | None:
        signal, noise, nodes, kept = 0, 0, 1, []
        for kid in n.kids:
            if isinstance(kid, str):
                got = (collapsed(kid), 0, 1)
            else:
                got = size(kid, depth + 1)
            if got is None:
                continue
            kept.append(kid)
            a, b, c = got
            nodes += c
            if n.name == "a":
                noise += a + b
            else:
                signal, noise = signal + a, noise + b
        n.kids = kept
        if n.name and purged(n):
            return None
        if depth > 1 and n.name not in VOID and (signal == 0 or noise > 0 and signal / (signal + noise) < threshold and nodes > 3):
            return None
        return signal, noise, nodes

    size(root, 0)
    return root


def text_of(n: Node | str) -> str:
    if isinstance(n, str):
        return n
    return " ".join(text_of(k) for k in n.kids if isinstance(k, str) or k.name not in SKIPPED)


def pruned_text(html: str, threshold: float = 0.5) -> str:
    return re.sub(r"\s+", " ", text_of(prune(tree(html), threshold))).strip()


def runs(html: str) -> list[tuple[str, str]]:
    """(tags, text) in order of the page: the tags of all elements around a text, joined by a comma (none: body); equal neighbours are one run."""
    out: list[list] = []

    def walk(n: Node, tags: frozenset[str]) -> None:
        for kid in n.kids:
            if isinstance(kid, str):
                if words := re.sub(r"\s+", " ", kid).strip():
                    if out and out[-1][0] == tags:
                        out[-1][1] += " " + words
                    else:
                        out.append([tags, words])
            elif kid.name not in SKIPPED:
                walk(kid, tags | {TAG_OF[kid.name]} if kid.name in TAG_OF else tags)

    walk(tree(html), frozenset())
    return [(",".join(sorted(t)) or "body", x) for t, x in out]


def spans_of(html: str) -> list[tuple[str, int, int]]:
    """(tag, start, end) of the words of each tag, positions from 1, ends exclusive: a tag's span ends where a run doesn't have it."""
    at, open_, out = 1, {}, []
    for tags, text in runs(html):
        own = set(tags.split(","))
        for t in [t for t in open_ if t not in own]:
            out.append((t, open_.pop(t), at))
        n = len(re.findall(r"[a-z0-9]+", text.lower()))
        if n:
            for t in own:
                open_.setdefault(t, at)
        at += n
    return sorted([*out, *((t, s, at) for t, s in open_.items())])


# ---- plain texts ----------------------------------------------------------------------------------------------


def is_underline(line: str) -> bool:
    s = line.strip()
    return len(s) > 8 and s[0] in "=_*" and len(set(s)) == 1


def is_sideline(line: str) -> bool:
    """A heading between marks, such as ==== HEADER ====."""
    s = line.strip()
    if len(s) < 9 or s[0] not in "=_*" or s[-1] != s[0]:
        return False
    left = s.lstrip(s[0])
    return len(left) >= 5 and len(left.rstrip(s[0])) >= 5


def plain_title(lines: list[str], path: str) -> str:
    """An underlined line, else a heading between marks, else a first line that a blank one follows, else the file's name."""
    heads = [x for x in lines if not (len(x) < 32 and ":" in x)]  # not the fields of a mail
    for before, line in zip(heads, heads[1:], strict=False):
        if is_underline(line) and len(before.strip()) > 16:
            return before.strip()[:128]
    for line in lines:
        if is_sideline(line):
            return re.sub(r"[^a-zA-Z0-9]+", " ", line).strip()
    if len(heads) >= 2 and not heads[1].strip() and len(heads[0].strip()) > 16:
        return heads[0].strip()
    return path.rpartition("/")[2] or path


def abbreviated(title: str, most: int = 128) -> str:
    return title if len(title) <= most else title[: most - 3] + "..."
