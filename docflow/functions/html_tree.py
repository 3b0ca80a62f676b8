"""A small element tree on top of the standard HTML tokenizer (used inside Arrow batches).

Unclosed elements stay open until an enclosing one ends; an end tag without an open partner is
ignored; blank runs between tags shrink to one newline or space.
"""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

# HTML elements without content, with raw content, with kept blanks.
VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
RAW = frozenset({"script", "style"})
UNSEEN = frozenset({"script", "style", "template"})
KEEP_BLANKS = frozenset({"pre", "textarea"})


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name, attrs=()):
        self.name, self.attrs, self.children = name, dict(attrs), []

    def walk(self):
        todo = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, Node):
                yield node
                todo.extend(reversed(node.children))

    def text(self):
        """Visible text: every piece trimmed, joined without separator."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, Node):
                if node is self or node.name not in UNSEEN:
                    todo.extend(reversed(node.children))
            elif isinstance(node, str):
                out.append(node.strip())
        return "".join(out)

    def markup(self):
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                out.append(node[0])
            elif isinstance(node, str):
                out.append(escape(node, quote=False))
            else:
                attrs = "".join(f" {k}={_quoted(v)}" for k, v in node.attrs.items())
                if node.name in VOID and not node.children:
                    out.append(f"<{node.name}{attrs}/>")
                    continue
                out.append(f"<{node.name}{attrs}>")
                todo.append((f"</{node.name}>",))
                raw = node.name in RAW
                todo.extend((c,) if raw and isinstance(c, str) else c for c in reversed(node.children))
        return "".join(out)


def _quoted(value):
    value = escape(value, quote=False)
    if '"' not in value:
        return f'"{value}"'
    return f"'{value}'" if "'" not in value else '"' + value.replace('"', "&quot;") + '"'


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]
        self.pieces = []

    def flush(self):
        if not self.pieces:
            return
        text = "".join(self.pieces)
        self.pieces = []
        if not text.strip(" \t\n\r\f\v") and not any(n.name in KEEP_BLANKS for n in self.open):
            text = "\n" if "\n" in text else " "
        self.open[-1].children.append(text)

    def handle_data(self, data):
        self.pieces.append(data)

    def handle_starttag(self, tag, attrs):
        self.flush()
        node = Node(tag, ((k, "" if v is None else v) for k, v in attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].name == tag:
                del self.open[depth:]
                return

    def handle_comment(self, data):
        self.flush()
        self.open[-1].children.append((f"<!--{data}-->",))

    def handle_decl(self, decl):
        self.flush()
        self.open[-1].children.append((f"<!{decl}>",))

    def handle_pi(self, data):
        self.flush()
        self.open[-1].children.append((f"<?{data}>",))


def read_html(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder.flush()
    return builder.root
