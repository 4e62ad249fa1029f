"""A small tolerant HTML reader for one page: elements, their text, and which of them are not part of the article."""

from __future__ import annotations

import re
from collections.abc import Iterator, Set
from html import unescape

import xxhash

TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>|<[a-zA-Z!?/][^>]*(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

# Names from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split())
IN_P = frozenset("option optgroup legend caption tr td th tbody tfoot thead body html".split())  # blocks that do not end an open paragraph
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that starts ends open ones of these names, looked for up to the nearest of those after it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
        "optgroup": ({"option", "optgroup"}, {"select"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
        "tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"})}
SCOPE = frozenset("table td th caption object template button marquee applet".split())  # an end tag does not reach beyond these
WIDE = frozenset("select svg math audio video canvas noscript map picture".split())  # not blocks, but their end tag ends blocks within

# What is not the article: by element, by role, by the first or last part of a class or id.
CUT_TAGS = frozenset("""head title script style template noscript nav footer aside form iframe object embed canvas svg audio video button select textarea
 menu dialog datalist search header""".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert status menu menubar toolbar tablist".split())
CUT_NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion promoted banner nav navbar
 navigation menu submenu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices notification notifications newsletter subscribe
 subscription signup login popup modal overlay share sharing social related recommended recommendations comment comments disqus respond reply replies pagination pager
 toolbar widget widgets skip paywall trending popular header""".split())
NOT_A_NAME = frozenset("has no not with without open closed enabled disabled hide show".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
TOP = frozenset(("", "html", "body", "main"))


def squeezed(text: str) -> str:
    return " ".join(text.split())


class Page:
    """Elements of a page in the order in which they start; element 0 is the page itself.

    `parts` of an element are its texts and child elements in order. Unclosed elements end as browsers end them.
    """

    def __init__(self, html: str):
        self.tags, self.parents, self.names, self.roles, self.hidden, self.parts = [""], [-1], [""], [""], [False], [[]]
        self._read(html)
        self.cut = [False] * len(self.tags)
        self.containers = self._containers()

    def _read(self, html: str) -> None:
        stack, at, size = [0], 0, len(html)
        tags, parts = self.tags, self.parts
        raw = None

        def text(data: str) -> None:
            if data:
                parts[stack[-1]].append(unescape(data) if "&" in data else data)

        def end(names: Set[str], bounds: Set[str]) -> None:
            for depth in range(len(stack) - 1, 0, -1):
                tag = tags[stack[depth]]
                if tag in names:
                    del stack[depth:]
                    return
                if tag in bounds:
                    return

        while at < size:
            if raw:
                found = re.compile(rf"</{raw}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
                stop = found.start() if found else size
                if at < stop:
                    parts[stack[-1]].append(html[at:stop])
                at, raw = (found.end() if found else size), None
                stack.pop()
                continue
            found = TOKEN.search(html, at)
            if not found:
                text(html[at:])
                break
            text(html[at:found.start()])
            at = found.end()
            if not found[2]:
                continue
            tag = found[2].lower()
            if found[1]:
                if tag not in ("body", "html"):
                    end({tag} if tag not in HEADINGS else HEADINGS, SCOPE - {tag} if tag in BLOCKS or tag in SCOPE or tag in WIDE else (SCOPE | BLOCKS) - {tag})
                continue
            if tag in BLOCKS:
                if tag not in IN_P:
                    end({"p"}, SCOPE)
                end({"head"}, SCOPE)
                if tag in HEADINGS and tags[stack[-1]] in HEADINGS:
                    stack.pop()
            if tag in ENDS:
                end(*ENDS[tag])
            number = len(tags)
            tags.append(tag)
            self.parents.append(stack[-1])
            parts[stack[-1]].append(number)
            parts.append([])
            names = role = ""
            hidden = False
            if found[3] and not found[3].isspace():
                for a in ATTRIBUTE.finditer(found[3]):
                    name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                    if name in ("class", "id"):
                        names += " " + value
                    elif name == "role":
                        role = value.strip().lower()
                    elif name == "itemprop" and value.lower() == "articlebody":
                        role = role or "articlebody"
                    elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
                        hidden = True
            self.names.append(names)
            self.roles.append(role)
            self.hidden.append(hidden)
            if tag in VOID:
                continue
            stack.append(number)
            if tag in RAW:
                raw = tag

    def _is_cut(self, e: int) -> bool:
        tag = self.tags[e]
        if self.hidden[e] or tag in CUT_TAGS or self.roles[e] in CUT_ROLES:
            return True
        if tag in TOP or not self.names[e]:
            return False
        for name in self.names[e].split():
            words = [w.lower() for w in NAME_PART.findall(name)]
            if words and not NOT_A_NAME.intersection(words) and (words[0] in CUT_NAMES or (words[-1] in CUT_NAMES and tag != "article")):
                return True
        return False

    def _mark(self, spared: Set[int]) -> None:
        for e in range(1, len(self.tags)):
            self.cut[e] = self.cut[self.parents[e]] or (e not in spared and self._is_cut(e))

    def _ancestors(self, e: int) -> Iterator[int]:
        while e > 0:
            e = self.parents[e]
            yield e

    def _outermost(self, tag: str, role: str) -> list[int]:
        inside: set[int] = set()
        found = []
        for e in range(1, len(self.tags)):
            if self.parents[e] in inside:
                inside.add(e)
            elif (self.tags[e] == tag or self.roles[e] == role) and not self.cut[e]:
                inside.add(e)
                found.append(e)
        return found

    def _containers(self) -> list[int]:
        """The elements that hold the article: marked ones, else the whole page."""
        self._mark(frozenset())
        found = self._marked()
        if not found:
            marked = [e for e in range(1, len(self.tags)) if self.tags[e] in ("article", "main") and not self._is_cut(e)]
            spared = {a for e in marked[:1] for a in self._ancestors(e)}
            if not marked and not any(self.blocks([0])):
                spared = self._most_text()
            if spared:  # the article lies in something that would be cut, such as a form around the whole page
                self._mark(spared)
                found = self._marked()
        self._nested(found)
        return found or [0]

    def _marked(self) -> list[int]:
        found = self._outermost("article", "article")
        titled = {e for h, tag in enumerate(self.tags) if tag == "h1" and not self.cut[h] for e in self._ancestors(h)}
        return [e for e in found if e in titled] or found or self._outermost("main", "main") or self._outermost("", "articlebody")

    def _most_text(self) -> set[int]:
        """Elements that hold over half of the text outside scripts and the head."""
        sizes = [0] * len(self.tags)
        for e in range(len(self.tags) - 1, -1, -1):
            if self.tags[e] not in RAW and self.tags[e] != "head":
                sizes[e] += sum(sizes[p] if isinstance(p, int) else len(squeezed(p)) for p in self.parts[e])
        return {e for e, n in enumerate(sizes) if 2 * n > sizes[0]}

    def _nested(self, containers: list[int]) -> None:
        """Cut articles within the article; of its header keep the headings."""
        inside = set(containers)
        headers: set[int] = set()
        for e in range(1, len(self.tags)):
            parent = self.parents[e]
            if parent not in inside:
                continue
            inside.add(e)
            if self.tags[e] == "header" and parent not in headers and not self.cut[parent]:
                headers.add(e)
                self.cut[e] = True
            elif parent in headers and self.tags[e] in HEADINGS | {"hgroup", "div", "section"} and not self._is_cut(e):
                self.cut[e] = self.tags[e] not in HEADINGS and self.tags[e] != "hgroup"
                if self.cut[e]:
                    headers.add(e)
            else:
                self.cut[e] = (self.cut[e] and parent not in headers) or self.cut[parent] or self.tags[e] == "article"

    def hashes(self) -> list[int]:
        """A hash of each element's subtree: its name, class, text and elements in order, without what is cut."""
        out = [0] * len(self.tags)
        for e in range(len(self.tags) - 1, -1, -1):
            inner = []
            for p in self.parts[e]:
                if isinstance(p, int):
                    if out[p]:
                        inner.append(out[p].to_bytes(8, "little", signed=True))
                elif not self.cut[e] and (t := squeezed(p)):
                    inner.append(t.encode("utf-8", "replace"))
            if inner:
                head = f"{self.tags[e]} {self.names[e]}".encode("utf-8", "replace")
                out[e] = int.from_bytes(xxhash.xxh64_digest(b"\x00".join([head, *inner])), "little", signed=True) or 1
        return out

    def within(self, containers: list[int]) -> list[int]:
        """The elements inside the containers, these left out, in page order."""
        inside = set(containers)
        found = []
        for e in range(1, len(self.tags)):
            if self.parents[e] in inside:
                inside.add(e)
                found.append(e)
        return found

    def blocks(self, containers: list[int], removed: Set[int] = frozenset()) -> Iterator[str]:
        """Text of every block in the containers that has some: white space squeezed, cut and removed elements left out."""
        for container in containers:
            line: list[str] = []
            todo: list[tuple[int, int]] = [(container, 0)]
            while todo:
                e, at = todo.pop()
                parts = self.parts[e]
                while at < len(parts):
                    p = parts[at]
                    at += 1
                    if not isinstance(p, int):
                        if not self.cut[e]:
                            line.append(p)
                        continue
                    if self.tags[p] == "br":
                        line.append(" ")
                    if self.tags[p] in BLOCKS and not (self.cut[e] and self.cut[p]):
                        if done := squeezed("".join(line)):
                            yield done
                        line = []
                    if p not in removed:
                        todo.append((e, at))
                        e, at, parts = p, 0, self.parts[p]
                if self.tags[e] in BLOCKS and not (self.cut[e] and self.cut[self.parents[e]]):
                    if done := squeezed("".join(line)):
                        yield done
                    line = []
            if done := squeezed("".join(line)):
                yield done
