"""Tags of a page, in order, in time linear in its length whatever the markup.

What a scan learns is kept: that no ``>`` follows, that an end tag does not come any more, and at which
quotes a tag cannot be closed, so that broken markup is not scanned again from every ``<``.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"""[>"']""")
_LONG_REFERENCE = re.compile(r"&#([xX]?)0*([0-9a-fA-F]*)(;?)")
#: Longest number of a character reference that can be a code point.
_DIGITS = 8


def decoded(text: str) -> str:
    """Character references replaced; those past the last code point, of any length, by U+FFFD."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _LONG_REFERENCE.sub(lambda m: f"&#{m[1]}{m[2] or '0'}{m[3]}" if len(m[2]) <= _DIGITS and m[0][2 + len(m[1]):3 + len(m[1])].isalnum()
                                   else m[0] if len(m[2]) <= _DIGITS else "�", text)
    return html.unescape(text)


class Tag(NamedTuple):
    start: int
    end: int
    name: str           # lower case; empty for comments and declarations
    closing: bool
    attrs: str


class Tags:
    """Successive tags from ``at`` on, which the caller may move forward."""

    def __init__(self, source: str):
        self.source = source
        self.at = 0
        self.last = source.rfind(">")
        self._unclosed: set[int] = set()        # quotes from which no unquoted > follows
        self._endless: set[str] = set()         # names without an end tag from here on

    def next(self) -> Tag | None:
        """The next tag, comment or declaration; ``at`` moves past it. A ``<`` that starts none is text."""
        s, i = self.source, self.at - 1
        while (i := s.find("<", i + 1)) >= 0:
            if s.startswith("<!--", i) or i > self.last:
                i = s.find("<!--", i)
                if i < 0:
                    return None
                end = s.find("-->", i + 4)
                return self._found(Tag(i, end + 3 if end >= 0 else len(s), "", False, ""))
            if s.startswith(("<!", "<?"), i):
                return self._found(Tag(i, s.find(">", i) + 1, "", False, ""))
            if m := _NAME.match(s, i):
                end = self._close(m.end())
                return self._found(Tag(i, end + 1, m[1].lower(), s[i + 1] == "/", s[m.end():end]))
        return None

    def _found(self, tag: Tag) -> Tag:
        self.at = tag.end
        return tag

    def _close(self, at: int) -> int:
        """The first ``>`` outside of quotes, or the first of all where the quotes do not close."""
        passed, q = [], at
        while (m := _MARK.search(self.source, q)) and m.start() not in self._unclosed:
            if m[0] == ">":
                return m.start()
            passed.append(m.start())
            q = self.source.find(m[0], m.end()) + 1
            if not q:
                break
        self._unclosed.update(passed)
        return self.source.find(">", at)

    def end_of(self, name: str) -> int | None:
        """Where the text after the next end tag of ``name`` starts, if there is one."""
        if name in self._endless:
            return None
        m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(self.source, self.at)
        end = self.source.find(">", m.end()) if m else -1
        if end < 0:
            self._endless.add(name)
            return None
        return end + 1
