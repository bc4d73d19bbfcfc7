"""What is code and what is text in source files: comments and strings are masked by a
small state machine, whose effect on a block of lines is a function from the state it is
entered in to the state it leaves, so that blocks of one file can be read side by side.
"""

from __future__ import annotations

import re
from bisect import bisect_left

# States: code, or what has to end before code goes on.
CODE, COMMENT, TRIPLE_DOUBLE, TRIPLE_SINGLE, BACKTICK, DOUBLE, SINGLE, DIRECTIVE = range(8)
STATES = 8

_ENDS = {
    COMMENT: re.compile(r"\*/"),
    TRIPLE_DOUBLE: re.compile(r'(?:[^\\"]|\\.|"(?!""))*"""', re.DOTALL),
    TRIPLE_SINGLE: re.compile(r"(?:[^\\']|\\.|'(?!''))*'''", re.DOTALL),
    BACKTICK: re.compile(r"(?:[^\\`]|\\.)*`", re.DOTALL),
    DOUBLE: re.compile(r'(?:[^\\"]|\\.)*"', re.DOTALL),
    SINGLE: re.compile(r"(?:[^\\']|\\.)*'", re.DOTALL),
    DIRECTIVE: re.compile(r"(?:[^\n]*\\\n)*[^\n]*(?<!\\)(?=\n|\Z)"),
}
_NO_CODE = (COMMENT, DIRECTIVE)
_OPENERS = {"/*": COMMENT, '"""': TRIPLE_DOUBLE, "'''": TRIPLE_SINGLE, "`": BACKTICK, '"': DOUBLE, "'": SINGLE}
_LINE_STRINGS = r"""(?P<text>"(?:[^\\"\n]|\\[^\n])*"?|'(?:[^\\'\n]|\\[^\n])*'?)"""
_SLASHES = r"(?P<note>//[^\n]*)|(?P<open>/\*"

#: How code goes over to something else: whole comments and strings of a line, and openers of longer ones.
_RULES = {
    "c": rf"(?P<line>^[ \t]*#[^\n]*)|{_SLASHES})|{_LINE_STRINGS}",
    "java": rf'{_SLASHES}|""")|{_LINE_STRINGS}',
    "javascript": rf"{_SLASHES}|`)|{_LINE_STRINGS}",
    "php": r"""(?P<note>//[^\n]*|\#(?!\[)[^\n]*)|(?P<open>/\*|"|')""",
    "python": rf"""(?P<note>\#[^\n]*)|(?P<open>\"{{3}}|'{{3}})|{_LINE_STRINGS}""",
    "ruby": rf"(?P<note>\#[^\n]*)|{_LINE_STRINGS}",
    "": r"""(?P<open>\"{3}|'{3})""",
}
_SAME = {"cpp": "c", "typescript": "javascript", "go": "javascript"}
_STARTS = {name: re.compile(rule, re.MULTILINE | re.DOTALL) for name, rule in _RULES.items()}

#: Languages whose scopes are told by braces, and those whose brackets tell that a line goes on.
BRACED = frozenset(("java", "javascript", "typescript", "c", "cpp", "go", "php"))
BRACKETED = frozenset(("python", "ruby"))

#: States that the rules of a language can leave a block in, besides code.
_LEFT_OPEN = {
    "c": (COMMENT, DIRECTIVE),
    "java": (COMMENT, TRIPLE_DOUBLE),
    "javascript": (COMMENT, BACKTICK),
    "php": (COMMENT, DOUBLE, SINGLE),
    "python": (TRIPLE_DOUBLE, TRIPLE_SINGLE),
    "ruby": (),
    "": (TRIPLE_DOUBLE, TRIPLE_SINGLE),
}


def _hidden(piece: str, sign: str) -> str:
    """``piece`` with ``sign`` in place of all but line breaks."""
    if "\n" not in piece:
        return sign * len(piece)
    return "\n".join([sign * len(line) for line in piece.split("\n")])


def masked(text: str, state: int, language: str) -> tuple[str, int, list[tuple[int, int]]]:
    """``text`` with comments as blanks and strings as quotes, sign by sign; the state behind it;
    and where something that goes over lines stands. Unknown languages have triple quotes alone."""
    return _read(text, state, language)[:3]


def _read(text: str, state: int, language: str) -> tuple[str, int, list[tuple[int, int]], list[int], list[int]]:
    """As ``masked``, and where all that is no code begins and ends; what goes on ends behind the text."""
    starts = _STARTS.get(_SAME.get(language, language), _STARTS[""])
    out: list[str] = []
    begins: list[int] = [] if state == CODE else [0]
    ends: list[int] = [] if state == CODE else [0]
    inside: list[tuple[int, int]] = []
    at, since = 0, 0
    while at < len(text):
        if state != CODE:
            end = _ENDS[state].match(text, at) if state != COMMENT else _ENDS[state].search(text, at)
            stop = end.end() if end else len(text)
            out.append(_hidden(text[at:stop], " " if state in _NO_CODE else '"'))
            inside.append((since, stop))
            ends[-1] = stop
            state, at = (CODE, stop) if end else (state, stop)
            continue
        found = starts.search(text, at)
        if not found:
            out.append(text[at:])
            break
        out.append(text[at : found.start()])
        kind, piece = found.lastgroup, found[0]
        if kind == "open":
            state, since = _OPENERS[piece], found.start()
        elif kind == "line" and piece.endswith("\\"):
            state, since = DIRECTIVE, found.start()
        out.append(_hidden(piece, '"' if kind == "text" or (kind == "open" and state != COMMENT) else " "))
        at = found.end()
        if state == DIRECTIVE:
            out.append(text[at : at + 1])
            at += 1
        begins.append(found.start())
        ends.append(at)
    if state != CODE:  # goes on behind the text
        ends[-1] = len(text) + 1
    if state == DIRECTIVE and not text.endswith("\\"):  # an empty line ends it
        state = CODE
    return "".join(out), state, inside, begins, ends


def depth_change(code: str, language: str) -> int:
    """Brackets opened and not closed in masked code: braces, or all kinds where lines go on in them."""
    if language in BRACED:
        return code.count("{") - code.count("}")
    if language in BRACKETED:
        return sum(map(code.count, "([{")) - sum(map(code.count, ")]}"))
    return 0


DELIMITER = re.compile(r"[{};]")


def unfinished(code: str, language: str) -> tuple[bool, str]:
    """The end of masked code that may belong to a scope that opens behind it, and whether
    anything else stands before: what follows the last brace or semicolon, or the decorators of the last lines."""
    if language in BRACED:
        last = max(code.rfind(sign) for sign in "{};")
        return last >= 0, code[last + 1 :] + "\n"
    lines = code.split("\n")
    first = len(lines)
    for i in reversed(range(len(lines))):
        bare = lines[i].lstrip()
        if bare and bare[0] != "@":
            return True, "".join(x + "\n" for x in lines[first:])
        first = i if bare else first
    return False, code + "\n"


def moves(text: str, language: str) -> list[tuple[int, int, bool, str]]:
    """For each state a block is entered in: the state it leaves, its change of depth, and what it leaves unfinished.
    States that the language does not have move nothing.

    The text is read once as code. Entered in another state it is the same from where that state
    ends, unless this is within a comment or string of that reading: only then it is read again.
    """
    code, after, _, begins, ends = _read(text, CODE, language)
    out = [(state, 0, False, "") for state in range(STATES)]
    out[CODE] = (after, depth_change(code, language), *unfinished(code, language))
    for state in _LEFT_OPEN.get(_SAME.get(language, language), _LEFT_OPEN[""]):
        end = _ENDS[state].match(text) if state != COMMENT else _ENDS[state].search(text)
        at = end.end() if end else -1
        within = bisect_left(begins, at) - 1
        if text and at >= 0 and (within < 0 or ends[within] <= at):
            shown, left = _hidden(text[:at], " " if state in _NO_CODE else '"') + code[at:], after
        else:
            shown, left, _ = masked(text, state, language)
        out[state] = (left, depth_change(shown, language), *unfinished(shown, language))
    return out


# --- heads of scopes in languages with braces

#: Words before parentheses that open no scope of their own.
CONTROL = frozenset(
    "if for while switch catch else do try synchronized with foreach elseif match unless return throw new await "
    "yield case when using lock defer select range sizeof typeof delete in of and or not assert".split()
)
_NESTED = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
_NOTES = re.compile(rf"@[A-Za-z_][\w.]*\s*(?:{_NESTED})?|\#\[[^\]]*\]")
_TEMPLATE = re.compile(r"\btemplate\s*<[^(){}]*?>(?=\s*[A-Za-z_])")
_LABEL = re.compile(r"^\s*(?:public|private|protected|default|case\b[^:]*)\s*:(?!:)|<\?php|<\?=")
#: What is passed over in a head, and signs without which there is none of it.
_PASSED_OVER = ((_NOTES, ("@", "#[")), (_LABEL, (":", "<?")), (_TEMPLATE, ("template",)))
_TYPE = re.compile(r"\b(class|interface|enum|trait|namespace|record|@interface)\s+([A-Za-z_$][\w$]*)")
_TYPE_WORDS = ("class", "interface", "enum", "trait", "namespace", "record")
_RECORD = re.compile(r"(?:^|\s)(struct|union|enum(?:\s+class)?)\s+([A-Za-z_]\w*)[^()=]*$")
_GO_TYPE = re.compile(r"^\s*type\s+([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*(struct|interface)\s*$")
_GO_FUNC = re.compile(rf"^\s*(func)\s+(?:{_NESTED}\s*)?([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?\(")
_FUNCTION = re.compile(r"(?:^|[\s=:(,])(function)\b\s*[*&]?\s*([A-Za-z_$][\w$]*)\s*(?:<[^()]*>\s*)?\(")
_ARROW = re.compile(
    rf"([A-Za-z_$#][\w$]*)\s*(?::[^=]*)?[=:]\s*(?:async\s+)?(?:(?:<[^()]*>\s*)?{_NESTED}(?:\s*:[^=]*)?\s*=>|[A-Za-z_$][\w$]*\s*=>|function\s*\*?\s*{_NESTED}(?:\s*:.*)?)\s*$",
    re.DOTALL,
)
_BEFORE_PARENTHESES = re.compile(r"(~?[A-Za-z_$#][\w$]*(?:\s*::\s*~?[A-Za-z_]\w*)*)\s*(?:<[^()=]*>\s*)?$")
_BEHIND = re.compile(r"^\s*(?:$|(?:const|noexcept|override|final|volatile|throws|throw|async|use)\b|:|->|&)")
_INITIALS = re.compile(r"^\s*:(?!:)")


def head_of(head: str, language: str) -> tuple[str, str, int] | None:
    """(kind, name, where the name stands) if the masked code before a brace opens a scope:
    a type, or a function or method with or without a keyword. Loops, conditions, blocks and literals are none."""
    # Notes and labels go, places stay.
    for pattern, signs in _PASSED_OVER:
        if any(sign in head for sign in signs):
            head = pattern.sub(lambda m: _hidden(m[0], " "), head)
    if language == "go":
        if "func" in head and (found := _GO_FUNC.search(head)):
            return "func", found[2], found.start(2)
        found = _GO_TYPE.search(head) if "type" in head else None
        return (found[2], found[1], found.start(1)) if found else None
    # Most heads are none of a type or function with a keyword: they are not searched for what they can't hold.
    if any(word in head for word in _TYPE_WORDS) and (found := _TYPE.search(head)) and (found[1] == "record" or "(" not in head[: found.start()]) and "=>" not in head:
        if not (language in ("c", "cpp") and found[1] == "enum" and "(" in head):
            return found[1], found[2], found.start(2)
    if language in ("c", "cpp") and (found := _RECORD.search(head)):
        return found[1].split()[0], found[2], found.start(2)
    if language in ("javascript", "typescript"):
        # A function or method of a literal stands behind the other entries.
        if "," in head:
            start = _last_comma(head)
            head = " " * start + head[start:]
        if ("=>" in head or "function" in head) and (found := _ARROW.search(head)):
            return "function", found[1], found.start(1)
    if "function" in head and (found := _FUNCTION.search(head)):
        return "function", found[2], found.start(2)
    opened = head.find("(")
    found = _BEFORE_PARENTHESES.search(head[:opened]) if opened > 0 else None
    closed = _closing(head, opened) if found else -1
    if closed < 0 or "=" in head[:opened] or not _BEHIND.match(head[closed:]):
        return None
    name, before = re.sub(r"\s+", "", found[1]), head[: found.start()].rstrip()
    if name in CONTROL or not CONTROL.isdisjoint(before.split()) or before.endswith((".", ",", "?")):
        return None
    # Without anything before it a name and parentheses are a call in some languages.
    if not before and language == "c":
        return None
    if not before and language == "cpp":
        made = "::" in name or name[0] == "~" or name[0].isupper() and not name.isupper()
        if not made and not _INITIALS.match(head[closed:]):
            return None
    return "function", name, found.start(1)


def _closing(head: str, opened: int) -> int:
    """Behind the parenthesis that closes the one at ``opened``, or -1."""
    depth = 0
    for found in re.compile(r"[()]").finditer(head, opened):
        depth += 1 if found[0] == "(" else -1
        if not depth:
            return found.end()
    return -1


def _last_comma(head: str) -> int:
    """Behind the last comma outside of brackets."""
    depth, start = 0, 0
    for i, sign in enumerate(head):
        if sign in "([{<":
            depth += 1
        elif sign in ")]}" or sign == ">" and head[i - 1 : i] != "=":
            depth = max(0, depth - 1)
        elif sign == "," and not depth:
            start = i + 1
    return start
