"""A small HTML parser: elements as flat arrays, and runs of text with the blocks they stand in.

The scanner only moves forward, and elements are found by counts of what is open,
so its time is linear in the page whatever the markup.
"""

from __future__ import annotations

import html
import re

TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: An attribute with its value, or what else stands before the next; each match takes all it has looked at.
ATTRIBUTE = re.compile(r"[\s/]*+(?:([^\s=/>]++)(?:\s*+(=)\s*+)?+|(=))")
UNQUOTED = re.compile(r"[^\s>]*+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")

# What HTML says of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SAME = {"li": ("li", frozenset(["ul", "ol", "menu"])), "dd": ("dd dt", frozenset(["dl"])), "dt": ("dd dt", frozenset(["dl"])), "option": ("option", frozenset(["select"])), "tr": ("tr td th", frozenset(["table"])), "td": ("td th", frozenset(["tr", "table"])), "th": ("td th", frozenset(["tr", "table"]))}
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*+>?", re.I) for name in RAW}


class Page:
    """tag, parent, words (of the attributes class, id and role) by element; text: (element, string) in page order, None for a block's border."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.words = ["#root"], [-1], [""]
        self.text: list[tuple[int, str | None]] = []
        self.source = source
        self.stack = [0]
        #: Of each name the places in the stack where it is open.
        self.open: dict[str, list[int]] = {}
        at = begin = 0
        while (at := source.find("<", at)) >= 0:
            end = self.markup(at, begin)
            if end is None:
                at += 1
            else:
                begin = at = end
        self.say(begin, len(source))

    def say(self, begin: int, end: int) -> None:
        if end > begin:
            run = self.source[begin:end]
            self.text.append((self.stack[-1], html.unescape(run) if "&" in run else run))

    def markup(self, at: int, begin: int) -> int | None:
        """Reads the markup at a place, after the text from begin; where it ends, or None if it is text."""
        source, size = self.source, len(self.source)
        after = source[at + 1 : at + 2]
        if after == "!" or after == "?":
            self.say(begin, at)
            comment = source.startswith("--", at + 2)
            end = source.find("-->" if comment else ">", at + 2)
            return size if end < 0 else end + (3 if comment else 1)
        if after == "/":
            m = TAG_NAME.match(source, at + 2)
            if not m:
                return None
            self.say(begin, at)
            end = source.find(">", m.end())
            name = m.group().lower()
            if name not in VOID:
                self.close(name, frozenset())
                if name not in INLINE:
                    self.text.append((self.stack[-1], None))
            return size if end < 0 else end + 1
        m = TAG_NAME.match(source, at + 1)
        if not m:
            return None
        self.say(begin, at)
        end, words, closed = self.attributes(m.end())
        if end < 0:
            return size  # a tag that never ends is no text
        return self.element(m.group().lower(), words, closed, end)

    def attributes(self, at: int) -> tuple[int, str, bool]:
        """From behind a tag's name: where the tag ends, or -1; its class, id and role; and whether it closes itself."""
        source, words = self.source, []
        while m := ATTRIBUTE.match(source, at):
            at = m.end()
            if m.group(2):
                quote = source[at : at + 1]
                if quote == '"' or quote == "'":
                    end = source.find(quote, at + 1)
                    if end < 0:
                        return -1, "", False
                    value, at = source[at + 1 : end], end + 1
                else:
                    value = UNQUOTED.match(source, at).group()
                    at += len(value)
                if m.group(1).lower() in ("class", "id", "role"):
                    words.append(value)
        end = source.find(">", at)
        return (-1 if end < 0 else end + 1), " ".join(words).lower(), source[end - 1 : end] == "/"

    def element(self, name: str, words: str, closed: bool, end: int) -> int:
        """Opens an element; where reading goes on."""
        stack, text = self.stack, self.text
        if name in CLOSES_P:
            self.close("p", CLOSES_P - {"p"})
        if name in SAME:
            names, scope = SAME[name]
            for other in names.split():
                self.close(other, scope)
        self.tag.append(name)
        self.parent.append(stack[-1])
        self.words.append(words)
        node = len(self.tag) - 1
        if name == "br":
            text.append((stack[-1], " "))
        elif name not in INLINE:
            text.append((node, None))
        if name in RAW:
            m = RAW_END[name].search(self.source, end)
            return m.end() if m else len(self.source)
        if name not in VOID and (not closed or name in CLOSES_P):
            self.open.setdefault(name, []).append(len(stack))
            stack.append(node)
        return end

    def close(self, name: str, scope: frozenset[str]) -> None:
        """Closes the last open element of that name, if none of scope stands above it."""
        own = self.open.get(name)
        if not own:
            return
        k = own[-1]
        if scope and any((above := self.open.get(s)) and above[-1] > k for s in scope):
            return
        for i in range(len(self.stack) - 1, k - 1, -1):
            self.open[self.tag[self.stack[i]]].pop()
        del self.stack[k:]


def block_text(parts: list[str]) -> str:
    return SPACE.sub(" ", "".join(parts)).strip(" ")
