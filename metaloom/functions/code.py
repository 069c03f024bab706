"""A parser of module source code in the ERP platform's procedural language (Russian and English keywords)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# The language's keywords.
PROCEDURE, FUNCTION = ("процедура", "procedure"), ("функция", "function")
END = {"процедура": ("конецпроцедуры", "endprocedure"), "функция": ("конецфункции", "endfunction")}
EXPORT, VAL, NEW, RETURN = ("экспорт", "export"), ("знач", "val"), ("новый", "new"), ("возврат", "return")
KEYWORDS = frozenset("если иначеесли иначе тогда конецесли для каждого из по цикл конеццикла пока возврат попытка исключение конецпопытки новый и или не процедура функция конецпроцедуры конецфункции экспорт знач перем прервать продолжить вызватьисключение истина ложь неопределено null if elsif else then endif for each in to do enddo while return try except endtry new and or not procedure function endprocedure endfunction export val var break continue raise true false undefined".split())
BOOLEANS = ("истина", "ложь", "true", "false")
#: Plural names of object managers, and the kinds they manage.
MANAGERS = {"справочники": "Catalog", "catalogs": "Catalog", "документы": "Document", "documents": "Document", "перечисления": "Enum", "enums": "Enum", "регистрысведений": "InformationRegister", "informationregisters": "InformationRegister", "регистрынакопления": "AccumulationRegister", "accumulationregisters": "AccumulationRegister"}

NAME = r"[A-Za-zА-Яа-яЁё_][\wА-Яа-яЁё]*"
_MASKED = re.compile(r'//[^\n]*|"(?:[^"\n]|""|\n[ \t]*\|)*"?')
_DECLARED = re.compile(rf"(?im)^[ \t]*(?:(?:асинх|async)[ \t]+)?({'|'.join(PROCEDURE + FUNCTION)})[ \t]+({NAME})[ \t]*\(")
_ENDS = re.compile(rf"(?i)(?<!\w)({'|'.join(sum(END.values(), ()))})(?!\w)")
_AFTER = re.compile(r"\s*(\w+)?")
_CALL = re.compile(rf"(?<![\w.])(?:({NAME})\s*\.\s*)?({NAME})\s*\(")
_ASSIGN = re.compile(rf"(?m)(?:^|;)[ \t]*({NAME})[ \t]*=[ \t]*([^;]+);")
_MANAGER = re.compile(rf"({NAME})\s*\.\s*({NAME})(?:\s*\.\s*({NAME})\s*\()?")


@dataclass
class Parameter:
    name: str
    position: int
    by_value: bool
    default: str | None


@dataclass
class Callable_:
    name: str
    kind: str
    export: bool
    directive: str
    line_start: int
    line_end: int
    body: str
    raw: str
    params: list[Parameter] = field(default_factory=list)


def masked(text: str) -> str:
    """The text with strings and comments blanked; its length and line breaks stay."""
    return _MASKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def closing(text: str, at: int) -> int:
    """The position of the parenthesis that closes the one at a position, or the end."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if not depth:
            return i
    return len(text)


def split_top(text: str, mask: str | None = None) -> list[str]:
    """The parts between commas outside brackets and strings; gaps are empty parts, and no text is no part."""
    mask = masked(text) if mask is None else mask
    if not text.strip():
        return []
    out, depth, at = [], 0, 0
    for i, c in enumerate(mask):
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]


def parameters(text: str) -> list[Parameter]:
    out = []
    for k, part in enumerate(split_top(text)):
        head, eq, default = part.partition("=")
        words = head.split()
        by_value = bool(words) and words[0].lower() in VAL
        names = words[1:] if by_value else words
        if names:
            out.append(Parameter(names[0], k, by_value, default.strip() if eq else None))
    return out


def parse_module(text: str | None) -> tuple[list[Callable_], list[str]]:
    """The procedures and functions of a module, and the names of those that are not closed."""
    text = text or ""
    mask = masked(text)
    found, unclosed, line, last = [], [], 1, 0
    starts = list(_DECLARED.finditer(mask))
    for k, m in enumerate(starts):
        kind = "function" if m[1].lower() in FUNCTION else "procedure"
        close = closing(mask, m.end() - 1)
        limit = starts[k + 1].start() if k + 1 < len(starts) else len(text)
        want = END["функция" if kind == "function" else "процедура"]
        end = next((e for e in _ENDS.finditer(mask, close, limit) if e[1].lower() in want), None)
        if end is None:
            unclosed.append(m[2])
            continue
        after = _AFTER.match(mask, close + 1)
        export = bool(after and after[1] and after[1].lower() in EXPORT)
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        line, last = line + text.count("\n", last, begin), begin
        before = _line_before(text, begin)
        directive = before if before.startswith("&") else ""
        body = after.end() if export else close + 1
        found.append(Callable_(m[2], kind, export, directive, line, line + text.count("\n", begin, end.start()), mask[body : end.start()], text[body : end.start()], parameters(text[m.end() : close])))
    return found, unclosed


def _line_before(text: str, at: int) -> str:
    """The last line before that of a position that is not blank."""
    end = text.rfind("\n", 0, at)
    while end >= 0:
        start = text.rfind("\n", 0, end) + 1
        if line := text[start:end].strip():
            return line
        end = start - 1
    return ""


def _word_before(text: str, at: int) -> str:
    """The word that ends before a position, but for white space; found by steps back, as texts are long."""
    while at and text[at - 1].isspace():
        at -= 1
    end = at
    while at and (text[at - 1].isalnum() or text[at - 1] == "_"):
        at -= 1
    return text[at:end]


def calls(c: Callable_) -> list[tuple[str, str, int, int, list[str]]]:
    """(module, method, line, column, arguments) of each call in a body; keywords and constructors are none."""
    out, lines, last = [], 0, 0
    for m in _CALL.finditer(c.body):
        name = m[2].lower()
        if m[1] is None and name in KEYWORDS:
            continue
        if _word_before(c.body, m.start()).lower() in NEW:
            continue
        end = closing(c.body, m.end() - 1)
        lines, last = lines + c.body.count("\n", last, m.start()), m.start()
        out.append((m[1] or "", m[2], c.line_start + lines, m.start() - (c.body.rfind("\n", 0, m.start()) + 1), split_top(c.raw[m.end() : end], c.body[m.end() : end])))
    return out


def events(c: Callable_) -> list[tuple[str, str, str]]:
    """(event, variable, value): what is assigned to variables, and which objects are named through their managers."""
    out = []
    for m in _ASSIGN.finditer(c.body):
        value = m[2].strip()
        word = value.split("(")[0].split()
        if word and word[0].lower() in NEW:
            out.append(("new", m[1], word[1] if len(word) > 1 else ""))
        elif (a := _MANAGER.match(value)) and a[1].lower() in MANAGERS:
            out.append(("manager", m[1], f"{MANAGERS[a[1].lower()]}.{a[2]}"))
        elif re.fullmatch(NAME, value):
            out.append(("copy", m[1], value))
        elif a := _CALL.match(value):
            out.append(("call", m[1], f"{a[1]}.{a[2]}" if a[1] else a[2]))
    for a in _MANAGER.finditer(c.body):
        if a[1].lower() in MANAGERS:
            out.append(("access", a[3] or "", f"{MANAGERS[a[1].lower()]}.{a[2]}"))
    return out


def local_names(c: Callable_) -> set[str]:
    """Names that a body defines: parameters, assigned variables and loop variables, in lower case."""
    out = {p.name.lower() for p in c.params} | {m[1].lower() for m in _ASSIGN.finditer(c.body)}
    out |= {m[1].lower() for m in re.finditer(rf"(?i)(?:для\s+каждого|для|for\s+each|for)\s+({NAME})", c.body)}
    return out - KEYWORDS


def local_types(c: Callable_, returns: dict[str, str], params: dict[str, str]) -> dict[str, tuple[str, float]]:
    """(kind, confidence) of variables: assignments in order, the last wins; a copy or a returned type loses 0.05."""
    out = {k.lower(): (v, 0.9) for k, v in params.items() if v != "AMBIGUOUS"}
    for event, var, value in events(c):
        if event == "new":
            out[var.lower()] = (value, 0.95)
        elif event == "manager":
            out[var.lower()] = (value, 0.9)
        elif event == "copy" and value.lower() in out:
            kind, sure = out[value.lower()]
            out[var.lower()] = (kind, round(sure - 0.05, 3))
        elif event == "call" and returns.get(value.lower(), "AMBIGUOUS") != "AMBIGUOUS":
            out[var.lower()] = (returns[value.lower()], 0.85)
    return out


def type_of(value: str, types: dict[str, tuple[str, float]]) -> tuple[str, float] | None:
    """(kind, confidence) of a simple expression: a literal, a variable, a constructor or a manager's method."""
    value = value.strip()
    if re.fullmatch(r"\d+(\.\d+)?", value):
        return "Number", 1.0
    if value[:1] in ('"', "'"):
        return "String" if value[0] == '"' else "Date", 1.0
    if value.lower() in BOOLEANS:
        return "Boolean", 1.0
    if re.fullmatch(NAME, value):
        return types.get(value.lower())
    word = value.split("(")[0].split()
    if len(word) > 1 and word[0].lower() in NEW:
        return word[1], 1.0
    a = _MANAGER.match(value)
    return (f"{MANAGERS[a[1].lower()]}.{a[2]}", 1.0) if a and a[3] and a[1].lower() in MANAGERS else None


def returned(c: Callable_) -> list[str]:
    """The expressions that a function returns."""
    if c.kind != "function":
        return []
    return [m[1].strip() for m in re.finditer(rf"(?i)(?<!\w)(?:{'|'.join(RETURN)})\s+([^;]+);", c.body)]


def return_type(c: Callable_, types: dict[str, tuple[str, float]]) -> str | None:
    """The kind that all returns of a function agree on; None without one."""
    kinds = set()
    for value in returned(c):
        word = value.split("(")[0].split()
        if word and word[0].lower() in NEW and len(word) > 1:
            kinds.add(word[1])
        elif value.lower() in types:
            kinds.add(types[value.lower()][0])
    return kinds.pop() if len(kinds) == 1 else None
