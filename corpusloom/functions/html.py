"""A tolerant HTML parser: tokens, and a tree built by the rules that browsers share.

Covered: implied html, head and body, paragraphs that end by themselves, list and
definition items, headings, formatting elements that carry on in later blocks and are
closed out of order, tables with what is moved before them, raw-text elements.
Left out: framesets, foreign content, quirks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style xmp".split())
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPECIAL = _CLOSES_P | VOID | RAW | _HEAD | frozenset("applet body button caption colgroup head html marquee object select tbody td textarea tfoot th thead tr".split())
_SCOPE_END = frozenset("applet caption html marquee object table td template th".split())
_MARKED = frozenset("applet marquee object template td th caption".split())
_TABLE_PARTS = frozenset("table tbody tfoot thead tr".split())
_IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
_SPACE = "\t\n\f\r "
_TAG = re.compile(r"<(/?)([a-zA-Z][^\t\n\f\r />]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<!--(.*?)(?:--!?>|$)|<(?:!|\?|/)[^>]*>", re.S)
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")


class Node:
    """An element; its children are elements and strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None

    def append(self, child: Node | str) -> None:
        if isinstance(child, str):
            if self.children and isinstance(self.children[-1], str):
                self.children[-1] += child
                return
        else:
            child.detach()
            child.parent = self
        self.children.append(child)

    def detach(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def insert_before(self, child: Node | str, mark: Node) -> None:
        at = next(i for i, c in enumerate(self.children) if c is mark)
        if isinstance(child, str):
            if at and isinstance(self.children[at - 1], str):
                self.children[at - 1] += child
                return
        else:
            child.detach()
            child.parent = self
            at = next(i for i, c in enumerate(self.children) if c is mark)
        self.children.insert(at, child)

    def elements(self) -> Iterator[Node]:
        """This element and all under it, in document order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if not isinstance(c, str)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack += reversed(n.children)
        return "".join(out)

    def first(self, tag: str) -> Node | None:
        return next((n for n in self.elements() if n.tag == tag), None)

    def outermost(self, tag: str, most: int) -> list[Node]:
        """The first elements of a tag, not looking for more inside of them."""
        out, stack = [], [self]
        while stack and len(out) < most:
            n = stack.pop()
            if n.tag == tag:
                out.append(n)
            else:
                stack += [c for c in reversed(n.children) if not isinstance(c, str)]
        return out


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, data, attributes) of a page's tokens, kind being text, start or end. Comments and the like give none."""
    at, n = 0, len(html)
    while at < n:
        i = html.find("<", at)
        if i < 0:
            i = n
        if i > at:
            yield "text", unescape(html[at:i]), {}
        if i == n:
            return
        m = _TAG.match(html, i)
        if m is None:
            if html.startswith(("<!", "<?", "</"), i) or re.match(r"<[a-zA-Z]", html[i : i + 2]):
                return  # a tag or comment that never ends swallows the rest
            yield "text", "<", {}
            at = i + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            yield "end", tag, {}
            continue
        attrs: dict[str, str] = {}
        for a in _ATTR.finditer(m[3]) if m[3] else ():
            v = a[2] or ""
            attrs.setdefault(a[1].lower(), unescape(v[1:-1] if v[:1] in ('"', "'") and len(v) > 1 else v))
        yield "start", tag, attrs
        if tag in RAW or tag in ("title", "textarea"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            body = html[at : end.start() if end else n]
            if tag == "textarea" and body[:1] == "\n":
                body = body[1:]
            if body:
                yield "text", body if tag in RAW else unescape(body), {}
            yield "end", tag, {}
            at = end.end() if end else n
        elif tag == "plaintext":
            yield "text", html[at:], {}
            return


class _Stack(list):
    """The open elements, with how many there are of each tag, so that a search for a tag that isn't open ends at once."""

    def __init__(self, nodes: list[Node]):
        super().__init__(nodes)
        self.tags: dict[str, int] = {}
        self.held: set[Node] = set(nodes)
        for n in nodes:
            self.tags[n.tag] = self.tags.get(n.tag, 0) + 1

    def _in(self, n: Node) -> None:
        self.held.add(n)
        self.tags[n.tag] = self.tags.get(n.tag, 0) + 1

    def _out(self, n: Node) -> None:
        self.held.discard(n)
        self.tags[n.tag] -= 1

    def __contains__(self, n: object) -> bool:
        return n in self.held

    def append(self, n: Node) -> None:
        super().append(n)
        self._in(n)

    def insert(self, at: int, n: Node) -> None:
        super().insert(at, n)
        self._in(n)

    def pop(self) -> Node:
        n = super().pop()
        self._out(n)
        return n

    def remove(self, n: Node) -> None:
        super().remove(n)
        self._out(n)

    def __delitem__(self, at: int) -> None:
        self._out(self[at])
        super().__delitem__(at)

    def __setitem__(self, at: int, n: Node) -> None:
        self._out(self[at])
        super().__setitem__(at, n)
        self._in(n)


class _Builder:
    def __init__(self):
        self.document = Node("#document")
        self.html = Node("html")
        self.document.append(self.html)
        self.head: Node | None = None
        self.body: Node | None = None
        self.stack: list[Node] = _Stack([self.html])
        self.active: list[Node | None] = []  # formatting elements that carry on; None is a marker
        self.raw: Node | None = None
        self.skip_line = False

    # --- places

    def _in_head(self) -> Node:
        if self.head is None:
            self.head = Node("head")
            self.html.append(self.head)
        return self.head

    def _open_body(self, attrs: dict[str, str] | None = None) -> None:
        if self.body is None:
            self._in_head()
            self.body = Node("body", attrs)
            self.html.append(self.body)
            self.stack = _Stack([self.html, self.body])

    def _scoped(self, tags: tuple[str, ...] | frozenset, more: tuple[str, ...] = ()) -> Node | None:
        if not any(self.stack.tags.get(t) for t in tags):  # most searches; so nesting costs no time
            return None
        for n in reversed(self.stack):
            if n.tag in tags:
                return n
            if n.tag in _SCOPE_END or n.tag in more:
                return None
        return None

    def _put(self, child: Node | str) -> None:
        """Append to the current element; in the bare parts of a table, before the table."""
        top = self.stack[-1]
        odd = top.tag in _TABLE_PARTS and not (isinstance(child, Node) and child.tag in _TABLE_PARTS | {"td", "th", "caption", "colgroup", "col", "script", "style", "template", "form"})
        if odd and not (isinstance(child, str) and not child.strip(_SPACE)):
            table = next((n for n in reversed(self.stack) if n.tag == "table"), None)
            if table is not None and table.parent is not None:
                table.parent.insert_before(child, table)
                return
        top.append(child)

    def _open(self, tag: str, attrs: dict[str, str]) -> Node:
        n = Node(tag, attrs)
        self._put(n)
        self.stack.append(n)
        return n

    def _close_to(self, node: Node) -> None:
        while self.stack[-1] is not node:
            self.stack.pop()
        self.stack.pop()

    def _implied(self, but: str = "") -> None:
        while self.stack[-1].tag in _IMPLIED and self.stack[-1].tag != but:
            self.stack.pop()

    def _close_p(self) -> None:
        p = self._scoped(("p",), ("button",))
        if p is not None:
            self._close_to(p)

    def _clear_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    # --- formatting

    def _carry_on(self) -> None:
        """Open again the formatting elements that a closed block cut short."""
        if not self.active or self.active[-1] is None or self.active[-1] in self.stack:
            return
        i = len(self.active)
        while i and self.active[i - 1] is not None and self.active[i - 1] not in self.stack:
            i -= 1
        for k in range(i, len(self.active)):
            self.active[k] = self._open(self.active[k].tag, self.active[k].attrs)

    def _remember(self, n: Node) -> None:
        alike = []
        for x in reversed(self.active):
            if x is None:
                break
            if x.tag == n.tag and x.attrs == n.attrs:
                alike.append(x)
        if len(alike) >= 3:
            self._forget(alike[-1])
        self.active.append(n)

    def _forget(self, n: Node) -> None:
        self.active = [x for x in self.active if x is not n or x is None]

    def _end_format(self, tag: str) -> None:
        """Close a formatting element, also one that blocks inside of it outlive."""
        if self.stack[-1].tag == tag and self.stack[-1] not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            chosen = None
            for x in reversed(self.active):
                if x is None:
                    break
                if x.tag == tag:
                    chosen = x
                    break
            if chosen is None:
                self._end_other(tag)
                return
            if chosen not in self.stack:
                self._forget(chosen)
                return
            if self._scoped((tag,)) is None:
                return
            place = self.stack.index(chosen)
            block = next((n for n in self.stack[place + 1 :] if n.tag in _SPECIAL), None)
            if block is None:
                self._close_to(chosen)
                self._forget(chosen)
                return
            above = self.stack[place - 1]
            mark = self.active.index(chosen)
            node, last, i, count = block, block, self.stack.index(block), 0
            while True:
                count += 1
                i -= 1
                node = self.stack[i]
                if node is chosen:
                    break
                if count > 3 and node in self.active:
                    if self.active.index(node) < mark:
                        mark -= 1
                    self._forget(node)
                if node not in self.active:
                    del self.stack[i]
                    continue
                copy = Node(node.tag, node.attrs)
                self.active[self.active.index(node)] = copy
                self.stack[i] = copy
                if last is block:
                    mark = self.active.index(copy) + 1
                copy.append(last)
                last = copy
            if above.tag in _TABLE_PARTS:
                keep, self.stack = self.stack, _Stack(self.stack[: self.stack.index(above) + 1])
                last.detach()
                self._put(last)
                self.stack = keep
            else:
                above.append(last)
            copy = Node(chosen.tag, chosen.attrs)
            inner, block.children = block.children, []
            for c in inner:
                if isinstance(c, Node):
                    c.parent = None
                copy.append(c)
            block.append(copy)
            where = self.active.index(chosen)
            self.active[where : where + 1] = []
            self.active.insert(mark - (where < mark), copy)
            self.stack.remove(chosen)
            self.stack.insert(self.stack.index(block) + 1, copy)

    # --- tokens

    def text(self, data: str) -> None:
        if self.raw is not None:
            self.raw.append(data)
            return
        if self.skip_line and data[:1] == "\n":
            data = data[1:]
        self.skip_line = False
        data = data.replace("\x00", "")
        if self.body is None:
            data = data.lstrip(_SPACE)
            if not data:
                return
            self._open_body()
        if data:
            if data.strip(_SPACE) or self.stack[-1].tag not in _TABLE_PARTS:
                self._carry_on()
            self._put(data)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        self.skip_line = False
        if tag == "html":
            for k, v in attrs.items():
                self.html.attrs.setdefault(k, v)
        elif tag == "head":
            if self.body is None and self.head is None:
                self._in_head().attrs.update(attrs)
        elif tag == "body":
            if self.body is None:
                self._open_body(attrs)
            else:
                for k, v in attrs.items():
                    self.body.attrs.setdefault(k, v)
        elif tag in _HEAD and self.body is None:
            n = Node(tag, attrs)
            self._in_head().append(n)
            if tag in RAW or tag == "title":
                self.raw = n
            elif tag == "template":
                self._open_body()  # rare; its content is dropped with it later
                self.stack.append(n)
        else:
            self._open_body()
            self._start_in_body(tag, attrs)

    def _start_in_body(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in RAW or tag in ("title", "textarea"):
            if tag == "xmp":
                self._close_p()
            n = Node(tag, attrs)
            self._put(n)
            self.raw = n
            return
        if tag in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "col", "colgroup"):
            self._table_part(tag, attrs)
            return
        if tag in _FORMAT:
            if tag == "a" and any(x is not None and x.tag == "a" for x in self._since_marker()):
                old = next(x for x in self._since_marker() if x.tag == "a")
                self._end_format("a")
                self._forget(old)
                if old in self.stack:
                    self.stack.remove(old)
            self._carry_on()
            if tag == "nobr" and self._scoped(("nobr",)) is not None:
                self._end_format("nobr")
                self._carry_on()
            self._remember(self._open(tag, attrs))
            return
        if tag in _CLOSES_P:
            if tag in ("li", "dd", "dt"):
                own = ("li",) if tag == "li" else ("dd", "dt")
                for n in reversed(self.stack if any(self.stack.tags.get(t) for t in own) else ()):
                    if n.tag in own:
                        self._implied(n.tag)
                        self._close_to(n)
                        break
                    if n.tag in _SPECIAL and n.tag not in ("address", "div", "p"):
                        break
            self._close_p()
            if tag in _HEADINGS and self.stack[-1].tag in _HEADINGS:
                self.stack.pop()
            if tag == "hr":
                self._put(Node(tag, attrs))
            else:
                self._open(tag, attrs)
                self.skip_line = tag in ("pre", "listing")
            return
        if tag in VOID or tag == "image":
            if tag not in _HEAD and tag not in ("param", "source", "track"):
                self._carry_on()
            self._put(Node("img" if tag == "image" else tag, attrs))
            return
        if tag == "button":
            old = self._scoped(("button",))
            if old is not None:
                self._implied()
                self._close_to(old)
        if tag in ("option", "optgroup") and self.stack[-1].tag == "option":
            self.stack.pop()
        if tag in ("rb", "rp", "rt", "rtc") and self._scoped(("ruby",)) is not None:
            self._implied()
        self._carry_on()
        self._open(tag, attrs)
        if tag in _MARKED:
            self.active.append(None)

    def _since_marker(self) -> list[Node]:
        out = []
        for x in reversed(self.active):
            if x is None:
                break
            out.append(x)
        return out

    def _table_part(self, tag: str, attrs: dict[str, str]) -> None:
        table = next((n for n in reversed(self.stack) if n.tag in ("table", "template")), None)
        if table is None or table.tag != "table":
            return  # outside of a table these are ignored
        for n in reversed(self.stack):  # a cell or caption ends at the next part
            if n.tag in ("td", "th", "caption"):
                self._close_to(n)
                self._clear_marker()
                break
            if n is table:
                break
        stop = {"tr": ("tbody", "thead", "tfoot", "table"), "td": ("tr",), "th": ("tr",)}.get(tag, ("table",))
        while self.stack[-1].tag not in stop and self.stack[-1] is not table:
            self.stack.pop()
        if tag in ("tr", "td", "th") and self.stack[-1] is table:
            self._open("tbody", {})
        if tag in ("td", "th") and self.stack[-1].tag in ("tbody", "thead", "tfoot"):
            self._open("tr", {})
        if tag == "col":
            self._put(Node(tag, attrs))
            return
        self._open(tag, attrs)
        if tag in ("td", "th", "caption"):
            self.active.append(None)

    def end(self, tag: str) -> None:
        self.skip_line = False
        if self.raw is not None:
            self.raw = None
            return
        if self.body is None:
            if tag in ("br", "p"):
                self._open_body()
            else:
                return
        if tag in ("html", "body", "head"):
            return
        if tag == "br":
            self._carry_on()
            self._put(Node("br"))
        elif tag == "p":
            if self._scoped(("p",), ("button",)) is None:
                self._open("p", {})
            self._close_p()
        elif tag in _FORMAT:
            self._end_format(tag)
        elif tag in _HEADINGS:
            n = self._scoped(_HEADINGS)
            if n is not None:
                self._implied()
                self._close_to(n)
        elif tag == "li":
            self._end_scoped("li", ("ol", "ul"))
        elif tag in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"):
            n = next((x for x in reversed(self.stack) if x.tag == tag or x.tag == "template" or (x.tag == "table" and tag != "table")), None)
            if n is not None and n.tag == tag:
                cells = sum(x.tag in ("td", "th", "caption") for x in self.stack[self.stack.index(n) :])
                self._close_to(n)
                for _ in range(cells):
                    self._clear_marker()
        elif tag in _CLOSES_P or tag in ("button", "dd", "dt"):
            self._end_scoped(tag, ())
        elif tag in ("applet", "marquee", "object", "template"):
            if self._scoped((tag,)) is not None or (tag == "template" and any(n.tag == tag for n in self.stack)):
                self._end_scoped(tag, ())
                self._clear_marker()
        else:
            self._end_other(tag)

    def _end_scoped(self, tag: str, more: tuple[str, ...]) -> None:
        if not self.stack.tags.get(tag):
            return
        for n in reversed(self.stack):
            if n.tag == tag:
                self._implied(tag)
                self._close_to(n)
                return
            if n.tag in _SCOPE_END or n.tag in more:
                return

    def _end_other(self, tag: str) -> None:
        if not self.stack.tags.get(tag):
            return
        for n in reversed(self.stack):
            if n.tag == tag:
                self._implied(tag)
                self._close_to(n)
                return
            if n.tag in _SPECIAL:
                return


def parse(html: str) -> Node:
    """The document of a page."""
    b = _Builder()
    for kind, data, attrs in tokens(html.replace("\r\n", "\n").replace("\r", "\n")):
        if kind == "text":
            b.text(data)
        elif kind == "start":
            b.start(data, attrs)
        else:
            b.end(data)
    b._open_body()
    return b.document
