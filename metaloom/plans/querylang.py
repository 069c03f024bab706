"""Front end of the ERP query language: lexer, parser, checks against a catalogue, advice, and a generator.

It analyses queries and does not run them.  The parser is tolerant: it reports only what is certainly broken, that is
parentheses that do not match and statements that are no SELECT or DROP; what it does not know it passes over.
"""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass, field
from functools import lru_cache

# The language's words, each Russian word with its English one.
_PAIRS = "выбрать select,различные distinct,первые top,разрешенные allowed,поместить into,из from,как as,где where,сгруппировать group,по by,имеющие having,объединить union,все all,упорядочить order,итоги totals,общие overall,уничтожить drop,соединение join,левое left,правое right,полное full,внутреннее inner,внешнее outer,и and,или or,не not,есть is,в in,иерархии hierarchy,между between,подобно like,спецсимвол escape,возр asc,убыв desc,автоупорядочивание autoorder,индексировать index,выбор case,когда when,тогда then,иначе else,конец end,истина true,ложь false,неопределено undefined,ссылка refs,на on,периодами periods,только only"
EN = dict(p.split() for p in _PAIRS.split(","))
WORDS = frozenset(EN) | frozenset(EN.values()) | {"null"}
OPAQUE = frozenset(("значение", "value", "тип", "type"))
#: Kinds of tables as queries name them, with the objects' kinds.
KINDS = {
    k.lower(): k
    for k in "Справочник Документ Перечисление РегистрСведений РегистрНакопления РегистрБухгалтерии РегистрРасчета ПланСчетов ПланВидовХарактеристик ПланВидовРасчета ПланОбмена БизнесПроцесс Задача Константа ЖурналДокументов Последовательность КритерийОтбора ВнешнийИсточникДанных".split()
}
#: Virtual tables by kind.
VIRTUAL = {
    "РегистрНакопления": "Остатки Обороты ОстаткиИОбороты".split(),
    "РегистрСведений": "СрезПоследних СрезПервых".split(),
    "РегистрБухгалтерии": "Остатки Обороты ОстаткиИОбороты ДвиженияССубконто ОборотыДтКт ОстаткиИОборотыДтКт СубконтоСубконто".split(),
    "РегистрРасчета": "ДанныеГрафика БазаТекущийРегистр ФактическийПериодДействия ПериодДействияПоФактическомуПериодуДействия".split(),
}
#: Fields that objects of a kind have without declaring them.
STANDARD = {
    "Справочник": "Ссылка Код Наименование Родитель Владелец ЭтоГруппа ПометкаУдаления Предопределенный ПредопределенноеИмяЗначения Представление",
    "Документ": "Ссылка Номер Дата Проведен ПометкаУдаления Представление",
    "Перечисление": "Ссылка Порядок Представление",
    "ПланВидовХарактеристик": "Ссылка Код Наименование ТипЗначения Родитель ЭтоГруппа ПометкаУдаления Предопределенный ПредопределенноеИмяЗначения Представление",
    "ПланСчетов": "Ссылка Код Наименование Вид Забалансовый Порядок ПометкаУдаления Предопределенный Представление",
    "РегистрСведений": "Период Регистратор Активность НомерСтроки",
    "РегистрНакопления": "Период Регистратор Активность НомерСтроки ВидДвижения",
    "ЖурналДокументов": "Ссылка Номер Дата Тип Представление",
    "Константа": "Значение",
}
#: What resources of accumulation registers are called in virtual tables.
SUFFIXES = {"остатки": ["Остаток"], "обороты": ["Оборот", "Приход", "Расход"], "остаткииобороты": ["НачальныйОстаток", "КонечныйОстаток", "Приход", "Расход", "Оборот"]}

#: White space and comments with the token after them, or the end.
_LEX = re.compile(r'(?:\s++|//[^\n]*+)*+(?:(?P<string>"(?:[^"]|"")*"?)|(?P<param>&[^\W\d]?\w*)|(?P<ident>[^\W\d]\w*)|(?P<number>\d+(?:\.\d+)?)|(?P<punct>>=|<=|<>|[().,;=<>+\-*/])|(?P<odd>.)|\Z)', re.S)


class _Words(dict):
    """English keywords of names, each looked up once; what comes to be known is bounded."""

    def __missing__(self, text: str) -> str:
        if len(self) > 10_000:
            self.clear()
        low = text.lower()
        self[text] = low = EN.get(low, low)
        return low


_WORD_OF = _Words()


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    line: int
    #: The English keyword that this is, else the text in lower case.
    word: str


def tokenize(text: str) -> list[Token]:
    text = text or ""
    out, line, last = [], 1, 0
    for m in _LEX.finditer(text):
        kind = m.lastgroup
        if kind is None or kind == "odd":
            continue
        said, at = m[kind], m.start(kind)
        line, last = line + text.count("\n", last, at), at
        out.append(Token(kind, said, line, _WORD_OF[said] if kind == "ident" else said if kind == "punct" else said.lower()))
    return out


@dataclass
class Source:
    path: list[str]
    alias: str = ""
    join: str = ""
    line: int = 0
    params: bool = False
    query: Statement | None = None

    @property
    def text(self) -> str:
        return ".".join(self.path)


@dataclass
class Ref:
    path: list[str]
    line: int
    section: str


@dataclass
class Part:
    items: list[tuple[str, list[str]]] = field(default_factory=list)  # alias, path of a plain field
    sources: list[Source] = field(default_factory=list)
    refs: list[Ref] = field(default_factory=list)
    sections: set[str] = field(default_factory=set)
    star: bool = False
    distinct: bool = False
    top: int | None = None


@dataclass
class Statement:
    kind: str
    line: int
    parts: list[Part] = field(default_factory=list)
    into: str = ""
    drop: str = ""

    def columns(self) -> list[str] | None:
        """The names of the columns, which the first part gives; None if one has no name."""
        if not self.parts or self.parts[0].star:
            return None
        names = [alias or (path[-1] if path else "") for alias, path in self.parts[0].items]
        return names if all(names) else None


@dataclass
class Batch:
    statements: list[Statement] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)


def split_at(tokens: list[Token], *words: str) -> list[list[Token]]:
    out, depth = [[]], 0
    for t in tokens:
        word = t.word
        if word == "(":
            depth += 1
        elif word == ")":
            depth -= 1
        if not depth and word in words:
            out.append([])
        else:
            out[-1].append(t)
    return out


def _balance(tokens: list[Token]) -> str:
    depth = 0
    for t in tokens:
        if t.text == "(":
            depth += 1
        elif t.text == ")":
            depth -= 1
        if depth < 0:
            return f"line {t.line}: unexpected )"
    return f"line {tokens[-1].line}: {depth} parentheses are not closed" if depth else ""


def parse(text: str, tokens: list[Token] | None = None) -> Batch:
    """The statements of a text, whose tokens may be given."""
    out = Batch()
    for tokens in split_at(tokenize(text) if tokens is None else tokens, ";"):
        if not tokens:
            continue
        if problem := _balance(tokens):
            out.problems.append(problem)
        if tokens[0].word == "drop":
            out.statements.append(Statement("drop", tokens[0].line, drop=tokens[1].text if len(tokens) > 1 else ""))
        elif any(t.word == "select" for t in tokens):
            out.statements.append(_select(tokens))
        else:
            out.problems.append(f"line {tokens[0].line}: no SELECT")
    return out


def _select(tokens: list[Token]) -> Statement:
    st = Statement("select", tokens[0].line)
    for k, part in enumerate(split_at(tokens, "union")):
        part = part[1:] if k and part and part[0].word == "all" else part
        if part:
            st.parts.append(_part(part, st))
    return st


_OPENERS = {"from", "where", "having", "totals", "autoorder", "into"}


def _sections(tokens: list[Token]) -> dict[str, list[Token]]:
    """Tokens by section; GROUP, ORDER and INDEX open one together with BY, which alone also stands before a join's condition."""
    out: dict[str, list[Token]] = {"select": []}
    now, depth, k = "select", 0, 0
    while k < len(tokens):
        t = tokens[k]
        if t.text == "(":
            depth += 1
        elif t.text == ")":
            depth -= 1
        pair = t.word in ("group", "order", "index") and k + 1 < len(tokens) and tokens[k + 1].word in ("by", "on")
        if not depth and t.text != ")" and (t.word in _OPENERS or pair):
            now = t.word
            out.setdefault(now, [])
            k += 2 if pair else 1
            continue
        out[now].append(t)
        k += 1
    return out


def _part(tokens: list[Token], st: Statement) -> Part:
    p, found = Part(), _sections(tokens)
    p.sections = set(found)
    head = [t for t in found["select"]]
    while head and head[0].word in ("select", "distinct", "allowed", "top"):
        word = head.pop(0).word
        p.distinct |= word == "distinct"
        if word == "top" and head and head[0].kind == "number":
            p.top = int(float(head.pop(0).text))
    if found.get("into"):
        st.into = found["into"][0].text
    for item in split_at(head, ","):
        if item:
            _item(item, p)
    _from(found.get("from", []), p)
    for name, toks in found.items():
        if name in ("where", "group", "having", "order", "totals"):
            _refs(toks, name, p)
    return p


def _path(tokens: list[Token], k: int) -> tuple[list[str], int]:
    path = [tokens[k].text]
    k += 1
    while k + 1 < len(tokens) and tokens[k].text == "." and tokens[k + 1].kind == "ident":
        path.append(tokens[k + 1].text)
        k += 2
    return path, k


def _item(tokens: list[Token], p: Part) -> None:
    if any(t.text == "*" and (k == 0 or tokens[k - 1].text == ".") for k, t in enumerate(tokens)):
        p.star = True
        return
    alias, body = "", tokens
    if len(tokens) > 2 and tokens[-2].word == "as":
        alias, body = tokens[-1].text, tokens[:-2]
    elif len(tokens) > 1 and tokens[-1].kind == "ident" and tokens[-2].text not in (".", "(") and tokens[-2].kind != "punct" and tokens[-1].text.lower() not in WORDS and tokens[-2].word not in WORDS:
        alias, body = tokens[-1].text, tokens[:-1]
    plain = body and body[0].kind == "ident" and body[0].text.lower() not in WORDS
    path, end = _path(body, 0) if plain else ([], -1)
    p.items.append((alias, path if end == len(body) else []))
    _refs(body, "select", p)


def _refs(tokens: list[Token], section: str, p: Part) -> None:
    """Chains of names that are fields: no keywords, functions, types in VALUE() or TYPE(), or names after AS."""
    k = 0
    while k < len(tokens):
        t = tokens[k]
        if t.kind != "ident" or t.text.lower() in WORDS:
            if t.word == "as" or t.word == "refs":
                k += 1
                while k + 2 < len(tokens) and tokens[k + 1].text == ".":
                    k += 2
            k += 1
            continue
        path, end = _path(tokens, k)
        if end < len(tokens) and tokens[end].text == "(":
            if t.text.lower() in OPAQUE:
                depth = 0
                while end < len(tokens):
                    depth += (tokens[end].text == "(") - (tokens[end].text == ")")
                    end += 1
                    if not depth:
                        break
        else:
            p.refs.append(Ref(path, t.line, section))
        k = end


def _from(tokens: list[Token], p: Part) -> None:
    k, join = 0, ""
    while k < len(tokens):
        t = tokens[k]
        if t.word in ("left", "right", "full", "inner", "outer"):
            join = t.word if t.word != "outer" else join
            k += 1
        elif t.word == "join":
            join = join or "inner"
            k += 1
        elif t.text == ",":
            join = ""
            k += 1
        elif t.word in ("on", "by"):
            end, depth = k + 1, 0
            while end < len(tokens) and (depth or (tokens[end].word not in ("left", "right", "full", "inner", "join") and tokens[end].text != ",")):
                depth += (tokens[end].text == "(") - (tokens[end].text == ")")
                end += 1
            _refs(tokens[k + 1 : end], "on", p)
            k = end
        elif t.text == "(":
            end, depth = k, 0
            while end < len(tokens):
                depth += (tokens[end].text == "(") - (tokens[end].text == ")")
                end += 1
                if not depth:
                    break
            src = Source([], join=join, line=t.line, query=_select(tokens[k + 1 : end - 1]))
            k = _alias(tokens, end, src)
            p.sources.append(src)
            join = ""
        elif t.kind == "ident" and t.text.lower() not in WORDS:
            path, k = _path(tokens, k)
            src = Source(path, join=join, line=t.line)
            if k < len(tokens) and tokens[k].text == "(":
                depth, begin = 0, k
                while k < len(tokens):
                    depth += (tokens[k].text == "(") - (tokens[k].text == ")")
                    k += 1
                    if not depth:
                        break
                src.params = any(x.text != "," for x in tokens[begin + 1 : k - 1])
            k = _alias(tokens, k, src)
            p.sources.append(src)
            join = ""
        else:
            k += 1


def _alias(tokens: list[Token], k: int, src: Source) -> int:
    if k + 1 < len(tokens) and tokens[k].word == "as":
        src.alias = tokens[k + 1].text
        return k + 2
    if k < len(tokens) and tokens[k].kind == "ident" and tokens[k].text.lower() not in WORDS:
        src.alias = tokens[k].text
        return k + 1
    return k


@dataclass
class Entry:
    """An object of the catalogue: fields as (name, role, targets), sections as lists of fields."""

    kind: str
    name: str
    fields: list[tuple[str, str, list[str]]] = field(default_factory=list)
    sections: dict[str, list[tuple[str, str, list[str]]]] = field(default_factory=dict)
    hierarchical: bool | None = None
    owned: bool | None = None

    @property
    def id(self) -> str:
        return f"{self.kind}.{self.name}"

    def standard(self) -> list[str]:
        off = set()
        if self.hierarchical is False:
            off |= {"Родитель", "ЭтоГруппа"}
        if self.owned is False:
            off.add("Владелец")
        return [f for f in STANDARD.get(self.kind, "").split() if f not in off]

    def virtual(self, name: str) -> list[tuple[str, str, list[str]]] | None:
        """The fields of a virtual table; None where they can't be told."""
        role = lambda r: [f for f in self.fields if f[1] == r]
        plain = lambda *names: [(n, "", []) for n in names]
        low = name.lower()
        if self.kind == "РегистрСведений":
            return plain("Период") + role("dimension") + role("resource") + role("attribute")
        if self.kind == "РегистрНакопления":
            lead = plain() if low == "остатки" else plain("Период", "Регистратор")
            return lead + role("dimension") + [(n + s, "resource", t) for n, _, t in role("resource") for s in SUFFIXES[low]]
        return None


@lru_cache(4096)
def _close(name: str, names: tuple[str, ...], most: int) -> list[str]:
    """The closest of names; batches of queries ask for the same wrong ones."""
    return difflib.get_close_matches(name, names, n=most, cutoff=0.7)


class Catalog:
    def __init__(self, entries: list[Entry]):
        self.by = {e.id.lower(): e for e in entries}
        self._fields: dict[tuple[str, bool], dict[str, list[str]]] = {}

    def fields(self, e: Entry, sections: bool) -> dict[str, list[str]]:
        """The targets of an object's fields, with its standard fields and maybe its sections; made once."""
        key = (e.id, sections)
        if key not in self._fields:
            self._fields[key] = _index(e.fields, [*e.standard(), *(e.sections if sections else ())])
        return self._fields[key]

    def get(self, kind: str, name: str) -> Entry | None:
        return self.by.get(f"{kind}.{name}".lower())

    def near(self, name: str, most: int = 2) -> list[str]:
        names = {e.name.lower(): e.name for e in self.by.values()}
        return [names[x] for x in _close(name.lower(), tuple(names), most)]


def _index(fields, extra=()) -> dict[str, list[str]]:
    out = {n.lower(): list(t) for n, _, t in fields}
    for n in extra:
        out.setdefault(n.lower(), [])
    return out


class Checker:
    """Checks the statements of a batch in order; temporary tables become known as they are made."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.temp = catalog, {}
        self.errors: list[str] = []
        self.warnings: list[str] = []
        self.tables = self.checked = 0

    def run(self, text: str) -> dict:
        batch = parse(text)
        self.warnings += batch.problems
        made = []
        for st in batch.statements:
            if st.kind == "drop":
                if self.temp.pop(st.drop.lower(), "none") == "none":
                    self.warnings.append(f"line {st.line}: DROP {st.drop}: no such temporary table")
                continue
            for p in st.parts:
                self.part(p)
            if st.into:
                columns = st.columns()
                self.temp[st.into.lower()] = columns
                made.append((st.into, columns))
                if columns is None:
                    self.warnings.append(f"line {st.line}: columns of {st.into} have no names")
        return {"valid": not self.errors, "errors": self.errors, "warnings": self.warnings, "tables_checked": self.tables, "fields_checked": self.checked, "temp_tables": made, "statements": len(batch.statements)}

    def source(self, s: Source) -> tuple[dict[str, list[str]] | None, Entry | None, str]:
        """The fields (None: unknown), the object, and an error."""
        if s.query is not None:
            for p in s.query.parts:
                self.part(p)
            columns = s.query.columns()
            return (None if columns is None else _index([(c, "", []) for c in columns])), None, ""
        if len(s.path) == 1:
            if s.path[0].lower() not in self.temp:
                return None, None, f"temporary table {s.path[0]} is not declared above"
            columns = self.temp[s.path[0].lower()]
            return (None if columns is None else _index([(c, "", []) for c in columns])), None, ""
        kind = KINDS.get(s.path[0].lower())
        if kind is None:
            return None, None, f"{s.path[0]} is no kind of table"
        e = self.catalog.get(kind, s.path[1])
        if e is None:
            near = self.catalog.near(s.path[1])
            return None, None, f"table {s.path[0]}.{s.path[1]} is not found" + (f"; perhaps {', '.join(near)}" if near else "")
        if len(s.path) == 2:
            return self.catalog.fields(e, True), e, ""
        third = s.path[2].lower()
        for name, fields in e.sections.items():
            if name.lower() == third:
                return _index(fields, ["Ссылка", "НомерСтроки"]), e, ""
        if third in (v.lower() for v in VIRTUAL.get(kind, [])):
            fields = e.virtual(s.path[2])
            return (None if fields is None else _index(fields)), e, ""
        return None, None, f"{s.path[2]} is neither a virtual table nor a section of {e.id}"

    def part(self, p: Part) -> None:
        known = {}
        resolved = []
        for s in p.sources:
            fields, entry, error = self.source(s)
            self.tables += 1
            if error:
                self.errors.append(f"line {s.line}: {error}")
            resolved.append((fields, entry, error))
            for name in (s.alias, s.path[-1] if s.path else "", s.text):
                if name:
                    known.setdefault(name.lower(), resolved[-1])
        aliases = {a.lower() for a, _ in p.items if a}
        for r in p.refs:
            head = r.path[0].lower()
            if len(r.path) == 1 and head in aliases:
                continue
            if head in known:
                if len(r.path) > 1:
                    self.path(known[head], r.path[1:], r)
            elif len(r.path) == 1:
                if len(resolved) == 1 and not resolved[0][2]:
                    self.path(resolved[0], r.path, r)
                else:
                    self.warnings.append(f"line {r.line}: field {r.path[0]} names no source")
            elif len(resolved) == 1 and resolved[0][0] is not None and head in resolved[0][0]:
                self.path(resolved[0], r.path, r)
            elif head not in KINDS:
                self.errors.append(f"line {r.line}: {r.path[0]} is not declared in FROM")

    def path(self, source, path: list[str], r: Ref) -> None:
        """A field, and below a field with one target the target's field; what is not known is no error."""
        fields, entry, _ = source
        if fields is None:
            return
        self.checked += 1
        name = path[0].lower()
        if name not in fields:
            near = _close(name, tuple(fields), 2)
            self.errors.append(f"line {r.line}: no field {path[0]}" + (f"; perhaps {', '.join(near)}" if near else ""))
            return
        if len(path) == 1:
            return
        targets = fields[name]
        target = targets[0] if len(targets) == 1 else entry.id if entry is not None and name in ("ссылка", "родитель") else None
        below = self.catalog.by.get(target.lower()) if target else None
        if below is not None:
            self.checked += 1
            if path[1].lower() not in self.catalog.fields(below, False):
                self.errors.append(f"line {r.line}: {below.id} has no field {path[1]}")


def check(text: str, catalog: Catalog) -> dict:
    return Checker(catalog).run(text)


def advise(text: str) -> list[tuple[str, str]]:
    """(priority, rule) of each rule that a query breaks, each once."""
    lexed = tokenize(text)
    parts = [p for st in parse(text, lexed).statements for p in st.parts]
    sources = [s for p in parts for s in p.sources]
    register = lambda s: bool(s.path) and s.path[0].lower() == "регистрнакопления"
    virtual = lambda s: len(s.path) == 3 and s.path[2].lower() in (v.lower() for v in VIRTUAL.get(KINDS.get(s.path[0].lower(), ""), []))
    bounded = lambda s: s.params or s.query is not None or len(s.path) == 1
    tokens = [t.word for t in lexed]
    functions = {"подстрока", "выразить", "год", "месяц", "день", "началопериода", "конецпериода", "substring", "cast"}
    where = tokens.index("where") if "where" in tokens else len(tokens)
    rules = [
        ("HIGH", "register_main_table", any(register(s) and len(s.path) == 2 for s in sources)),
        ("HIGH", "virtual_table_without_parameters", any(virtual(s) and not s.params for s in sources)),
        ("MEDIUM", "join_with_subquery", any(s.query is not None and s.join for s in sources)),
        ("MEDIUM", "unbounded_selection", any(p.top is None and "where" not in p.sections and any(not bounded(s) for s in p.sources) for p in parts)),
        ("MEDIUM", "all_fields", any(p.star for p in parts)),
        ("LOW", "distinct", any(p.distinct for p in parts)),
        ("HIGH", "function_in_condition", any(w in functions and k + 1 < len(tokens) and tokens[k + 1] == "(" for k, w in enumerate(tokens) if k > where)),
        ("LOW", "order", any("order" in p.sections for p in parts)),
    ]
    return [(priority, rule) for priority, rule, broken in rules if broken]


def build(catalog: Catalog, tables: list[str], fields: list[str] | None = None, conditions: list[str] | None = None, group_by: list[str] | None = None) -> str:
    """A query over objects: fields asked for or the first ten of the first, left joins over reference fields."""
    entries = [e for t in tables if (e := catalog.by.get(t.lower())) is not None]
    if not entries:
        raise ValueError("none of the tables is in the catalogue")
    alias = {e.id: f"Т{k}" for k, e in enumerate(entries, 1)}
    first = entries[0]
    picked = fields or [n for n, *_ in first.fields][:10] or ["Ссылка"]
    lines = ["ВЫБРАТЬ", ",\n".join(f"  {f if '.' in f else alias[first.id] + '.' + f}" for f in picked), "ИЗ", f"  {first.id} КАК {alias[first.id]}"]
    for e in entries[1:]:
        link = next((f"{alias[a.id]}.{n} = {alias[b.id]}.Ссылка" for a, b in ((first, e), (e, first)) for n, _, t in a.fields if b.id in t), "ИСТИНА")
        lines.append(f"  ЛЕВОЕ СОЕДИНЕНИЕ {e.id} КАК {alias[e.id]}\n  ПО {link}")
    if conditions:
        lines.append("ГДЕ\n  " + " И ".join(conditions))
    if group_by:
        lines.append("СГРУППИРОВАТЬ ПО\n  " + ", ".join(group_by))
    return "\n".join(lines)
