"""Helpers for one post: markup, words, and the part its author wrote."""

from __future__ import annotations

import html
import re

# Markup of the posts. A tag ends at '>' or, cut off, at the end of its line.
_HTML = r"</?(?:a|b|i|u|s|p|br|hr|em|tt|ul|ol|li|h[1-6]|div|img|pre|del|ins|sub|sup|span|code|cite|font|strong|small|strike|center|table|tr|td|th|blockquote)\b(?:[^<>\n]*>|[ \t]*/?(?=\n|$))"
_ANY_HTML = r"</?[A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>\"']+))*\s*/?>|<!--.*?-->"
_BBCODE = r"\[/?(?:b|i|u|s|\*|li|url|img|list|code|quote|size|font|color|center|spoiler|email|sub|sup|hr|table|tr|td)(?:=[^\]\n]*)?\]"
TAG_PATTERN = f"(?:{_HTML})|(?:{_ANY_HTML})|(?:{_BBCODE})"
_TAG = re.compile(TAG_PATTERN, re.IGNORECASE | re.DOTALL)
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Tags become a space, then entities their characters."""
    return html.unescape(_TAG.sub(" ", text))


def cased_words(text: str) -> list[str]:
    return _WORD.findall(plain(text))


# Marks after which a word opens a sentence.
_OPENS = re.compile(r"[.!?:\n]")


def words_in_sentences(text: str) -> list[tuple[str, bool]]:
    """Each word and whether it is the first of a sentence."""
    bare, out, at = plain(text), [], 0
    for m in _WORD.finditer(bare):
        out.append((m[0], not out or bool(_OPENS.search(bare, at, m.start()))))
        at = m.end()
    return out


def lower_words(text: str) -> list[str]:
    """Lower-case words of a text without markup."""
    return _WORD.findall(text.lower())


_EDGE = re.compile(r"\[(/?)quote(?:=[^\]\n]*)?\]|<(/?)blockquote\b[^<>\n]*>", re.IGNORECASE)
_UNCLOSED = r".*?(?=\n[ \t]*\n|\Z)"
_PASTED = re.compile(rf"\[code\b[^\]\n]*\](?:.*?\[/code\]|{_UNCLOSED})|<(pre|code)\b[^<>\n]*>(?:.*?</\1>|{_UNCLOSED})|```(?:.*?```|{_UNCLOSED})", re.IGNORECASE | re.DOTALL)
_SIGNED = re.compile(r"\[size=1\].*?(?:\[/size\]|\Z)|<hr\b[^<>\n]*>.*\Z|^(?:-- ?|_{5,}|-{5,})[ \t]*$.*\Z", re.IGNORECASE | re.DOTALL | re.MULTILINE)
#: Words that a signature has at most; what follows a line of dashes and is longer was written by the author.
LONGEST_SIGNATURE = 40
_QUOTE_LINE = re.compile(r"^[ \t]*(?:>|\||&gt;)")
_WROTE = re.compile(r"^\S+ wrote:\s*$")
_LOG_LINE = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d[T ]|\[?\d\d:\d\d:\d\d|step \d+ |\w+\[\d+\]:|.*\b\w+=0x[0-9a-f]+|\s+at \w[\w.$]*\(|Traceback |[A-Z]+: )")


def _unquoted(text: str) -> str:
    """Without quotations in tags, nested ones too; one that is never closed ends with its paragraph."""
    out, at, depth, opened = [], 0, 0, 0
    for m in _EDGE.finditer(text):
        closing = bool(m[1] or m[2])
        if not closing:
            if depth == 0:
                out.append(text[at : m.start()])
                opened = m.end()
            depth += 1
        elif depth:
            depth -= 1
            at = m.end()
            if depth == 0:
                out.append("\n\n")
    if depth:
        gap = text.find("\n\n", max(opened, at))
        out.append("\n\n" + text[gap:] if gap >= 0 else "")
    else:
        out.append(text[at:])
    return "".join(out)


def _signature(m: re.Match) -> str:
    """Nothing for a signature; what follows the mark where that is too long for one."""
    mark = re.match(r"<[^<>]*>|[^\n]*", m[0])[0]
    rest = m[0][len(mark) :]
    if mark.lower().startswith("[size") or len(_WORD.findall(rest)) <= LONGEST_SIGNATURE:
        return "\n\n"
    return "\n\n" + _SIGNED.sub(_signature, rest)


#: What may stand around the author's name in a signature, besides other text before it.
_AROUND = "|~ \t\n\r\f\v\u00a0"


def own_text(text: str, author: str | None) -> str:
    """What the author wrote: no quotations, pasted logs, signature or markup. Paragraphs stay apart, wrapped lines are joined."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = _PASTED.sub("\n\n", _unquoted(text))
    lines = _SIGNED.sub(_signature, text).split("\n")
    kept = []
    for line in lines:
        bare = html.unescape(line)
        if _QUOTE_LINE.match(line) or _WROTE.match(bare) or _LOG_LINE.match(bare):
            kept.append("")
        else:
            kept.append(line)
    while kept and not plain(kept[-1]).strip():
        kept.pop()
    if kept and author:  # a last line that bears the author's name is a signature
        last = plain(kept[-1]).strip()
        at = last.rfind(author)
        if len(last) < 80 and at >= 0 and not last[at + len(author) :].strip(_AROUND) and not last[at - 1 : at].strip(_AROUND):
            kept.pop()
    return plain("\n".join(kept))


# Ends of sentences.
_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n\s*\n")


def sentences(own: str) -> list[str]:
    return [x for x in (" ".join(s.split()) for s in _END.split(own)) if _WORD.search(x)]
