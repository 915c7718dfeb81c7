"""Record schemas as text: reading, checking and writing, between text, plain descriptions and StructTypes.

    package shop;
    enum Status { UNKNOWN = 0; ACTIVE = 1; }
    message Order @128 { required int64 id = 1; repeated string tags = 2; *Customer buyer = 3; map[string]int32 counts = 4; }
    interface Event { 128 = Order; }
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .types import HIGHEST, SPARK_TYPE, Shape, members

TOKEN = re.compile(r'\s*(?:(?P<doc>///[^\n]*)|(?P<skip>//[^\n]*)|(?P<text>"(?:[^"\\\n]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_]\w*)|(?P<sign>[{}\[\]()=;,.*@]))')
MODIFIERS = ("required", "repeated", "optional", "deprecated")
SYNONYMS = {"int": "int64", "uint": "uint64", "byte": "uint8"}
RESERVED = range(19_000, 20_000)


@dataclass
class Type:
    """A scalar or named type, or ``pointer``, ``list``, ``map`` around others."""

    name: str
    item: Type | None = None
    key: Type | None = None
    size: int | None = None

    def __str__(self) -> str:
        return {"pointer": f"*{self.item}", "list": f"[{self.size or ''}]{self.item}", "map": f"map[{self.key}]{self.item}"}.get(self.name, self.name)


@dataclass
class Field:
    name: str
    number: int
    type: Type
    modifiers: tuple[str, ...] = ()
    doc: str = ""
    line: int = 0
    options: dict = field(default_factory=dict)


@dataclass
class Entry:
    """A message's fields, an enum's values or an interface's members."""

    kind: str
    name: str
    items: list = field(default_factory=list)
    type_id: int | None = None
    doc: str = ""
    line: int = 0
    options: dict = field(default_factory=dict)


@dataclass
class Schema:
    package: str = ""
    imports: list[tuple[str, str]] = field(default_factory=list)
    options: dict = field(default_factory=dict)
    entries: list[Entry] = field(default_factory=list)
    faults: list[tuple[int, str]] = field(default_factory=list)

    def of(self, kind: str) -> dict[str, Entry]:
        return {e.name: e for e in self.entries if e.kind == kind}


class Reader:
    """Reads one file; after a fault it goes on behind the next ``;`` or ``}``."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str, int]] = []
        self.schema, self.at, self.doc = Schema(), 0, []
        place = 0
        while place < len(text) and (m := TOKEN.match(text, place)):
            line = text.count("\n", 0, m.start(m.lastgroup)) + 1
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[m.lastgroup], line))
            place = m.end()
        if text[place:].strip():
            self.schema.faults.append((text.count("\n", 0, place) + 1, f"unexpected character {text[place:].strip()[0]!r}"))
        self.tokens.append(("end", "", text.count("\n") + 1))

    def next(self, *wanted: str) -> str:
        """The next token, which must be one of ``wanted``: kinds, or the texts of signs and words."""
        while self.tokens[self.at][0] == "doc":
            self.doc.append(self.tokens[self.at][1][3:].strip())
            self.at += 1
        kind, text, line = self.tokens[self.at]
        if wanted and kind not in wanted and text not in wanted:
            raise SyntaxError(f"{line}:expected {' or '.join(wanted)}, found {text or kind}")
        self.at += kind != "end"
        return text

    def peek(self, *texts: str) -> bool:
        while self.tokens[self.at][0] == "doc":
            self.doc.append(self.tokens[self.at][1][3:].strip())
            self.at += 1
        return self.tokens[self.at][1] in texts

    def line(self) -> int:
        return self.tokens[self.at][2]

    def comment(self) -> str:
        text, self.doc = "\n".join(self.doc), []
        return text

    def value(self) -> object:
        if self.peek("["):
            self.next()
            out = []
            while not self.peek("]"):
                out.append(self.value())
                if not self.peek("]"):
                    self.next(",")
            self.next("]")
            return out
        text = self.next("text", "number", "true", "false")
        if text[0] == '"':
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1])
        return text == "true" if text in ("true", "false") else (int(text) if re.fullmatch(r"-?\d+", text) else float(text))

    def option(self) -> tuple[str, object]:
        name = self.next("word")
        self.next("=")
        got = self.value()
        self.next(";")
        return name, got

    def bracketed(self) -> dict:
        """Options of a field, between brackets; one without a value is true."""
        out = {}
        self.next("[")
        while True:
            name = self.next("word", *MODIFIERS)
            if self.peek("="):
                self.next()
                out[name] = self.value()
            else:
                out[name] = True
            if self.next(",", "]") == "]":
                return out

    def type(self) -> Type:
        if self.peek("*"):
            self.next()
            return Type("pointer", self.type())
        if self.peek("["):
            self.next()
            size = None if self.peek("]") else int(self.next("number"))
            self.next("]")
            return Type("list", self.type(), size=size)
        name = self.next("word")
        if name == "map":
            self.next("[")
            key = self.type()
            self.next("]")
            return Type("map", self.type(), key)
        if self.peek("."):
            self.next()
            name += "." + self.next("word")
        return Type(SYNONYMS.get(name, name))

    def body(self, kind: str, options: dict) -> list:
        """The entry's items; its own options go to ``options``."""
        out = []
        self.next("{")
        while not self.peek("}"):
            self.doc = [] if self.tokens[self.at - 1][0] != "doc" else self.doc
            line = self.line()
            if self.peek("option"):
                self.next()
                name, got = self.option()
                options[name] = got
            elif kind == "interface":
                number = int(self.next("number"))
                self.next("=")
                out.append(Field(str(self.type()), number, Type("message"), doc=self.comment(), line=line))
                self.next(";")
            elif kind == "enum":
                name = self.next("word")
                self.next("=")
                out.append(Field(name, int(self.next("number")), Type("int32"), doc=self.comment(), line=line))
                self.next(";")
            else:
                modifiers = []
                while self.peek(*MODIFIERS):
                    modifiers.append(self.next())
                made = self.type()
                doc, name = self.comment(), self.next("word")
                self.next("=")
                number = int(self.next("number"))
                own = self.bracketed() if self.peek("[") else {}
                out.append(Field(name, number, made, tuple(modifiers), doc, line, own))
                self.next(";")
        self.next("}")
        return out

    def read(self) -> Schema:
        s = self.schema
        while not self.peek("") or self.tokens[self.at][0] != "end":
            try:
                line, word = self.line(), self.next("word")
                if word == "package":
                    s.package = self.next("word")
                    self.next(";")
                elif word == "import":
                    path = self.next("text")[1:-1]
                    alias = ""
                    if self.peek("as"):
                        self.next()
                        alias = self.next("word")
                    s.imports.append((path, alias))
                    self.next(";")
                elif word == "option":
                    name, got = self.option()
                    s.options[name] = got
                elif word in ("message", "enum", "interface"):
                    e = Entry(word, self.next("word"), doc=self.comment(), line=line)
                    if self.peek("@"):
                        self.next()
                        e.type_id = int(self.next("number"))
                    e.items = self.body(word, e.options)
                    s.entries.append(e)
                else:
                    raise SyntaxError(f"{line}:unexpected {word}")
            except (SyntaxError, ValueError) as fault:
                where, _, what = str(fault).partition(":")
                s.faults.append((int(where), what) if where.isdigit() else (self.line(), str(fault)))
                while self.tokens[self.at][0] != "end" and self.tokens[self.at][1] not in (";", "}"):
                    self.at += 1
                self.at += self.tokens[self.at][0] != "end"
        return s


def parse(text: str) -> Schema:
    """The schema; ``faults`` has what didn't parse."""
    return Reader(text).read()


def load(path: str, search: tuple[str, ...] = (), _open: tuple[str, ...] = ()) -> tuple[Schema, dict[str, Schema]]:
    """(schema, imported schemas by alias or package); paths are tried beside the file, then in ``search``."""
    from pathlib import Path

    here = str(Path(path).resolve())
    if here in _open:
        raise ValueError(f"import cycle through {path}")
    s, found = parse(Path(here).read_text(encoding="utf-8")), {}
    for name, alias in s.imports:
        options = [Path(d) / name for d in (Path(here).parent, *search)]
        target = next((p for p in options if p.exists()), None)
        if target is None:
            raise FileNotFoundError(f"{path}: no file {name}")
        own, _ = load(str(target), search, (*_open, here))
        found[alias or own.package or target.stem] = own
    return s, found


def check(s: Schema, imported: dict[str, Schema] | None = None) -> list[tuple[int, str, str]]:
    """(line, severity, message) in line order."""
    imported = imported or {}
    out = [(line, "error", what) for line, what in s.faults]
    names: dict[str, Entry] = {}
    for e in s.entries:
        if e.name in names:
            out.append((e.line, "error", f"{e.name} is declared twice"))
        names.setdefault(e.name, e)

    def find(name: str) -> Entry | None:
        head, _, tail = name.rpartition(".")
        if head:
            return next((e for e in imported[head].entries if e.name == tail), None) if head in imported else None
        same = [e for x in imported.values() if x.package == s.package for e in x.entries if e.name == name]
        return names.get(name) or (same[0] if same else None)

    def types(t: Type, line: int) -> None:
        if t.name in ("pointer", "list", "map"):
            types(t.item, line)
            if t.name == "map":
                key = find(t.key.name)
                if t.key.name not in SPARK_TYPE and not (key and key.kind == "enum") or t.key.name in ("bytes", "float32", "float64", "complex64", "complex128"):
                    out.append((line, "error", f"{t.key} can't be a map key"))
        elif t.name not in SPARK_TYPE and find(t.name) is None:
            out.append((line, "error", f"unknown type {t.name}"))

    for e in s.entries:
        seen_names, seen_numbers = set(), set()
        for f in e.items:
            if f.name in seen_names:
                out.append((f.line, "error", f"{e.name}.{f.name} is declared twice"))
            if f.number in seen_numbers:
                out.append((f.line, "error", f"{e.name}: number {f.number} is used twice"))
            seen_names.add(f.name)
            seen_numbers.add(f.number)
            if e.kind == "message":
                if not 0 < f.number <= HIGHEST:
                    out.append((f.line, "error", f"{e.name}.{f.name}: number {f.number} is out of range"))
                elif f.number in RESERVED:
                    out.append((f.line, "warning", f"{e.name}.{f.name}: number {f.number} is reserved"))
                if {"required", "optional"} <= set(f.modifiers):
                    out.append((f.line, "error", f"{e.name}.{f.name} is both required and optional"))
                types(f.type, f.line)
            elif e.kind == "enum" and f.number < 0:
                out.append((f.line, "warning", f"{e.name}.{f.name} is negative"))
            elif e.kind == "interface":
                target = find(f.name)
                if f.number <= 0:
                    out.append((f.line, "error", f"{e.name}: type id {f.number} must be positive"))
                if target is None or target.kind != "message":
                    out.append((f.line, "error", f"{e.name}: {f.name} is not a message"))
        if e.kind == "enum" and 0 not in seen_numbers:
            out.append((e.line, "warning", f"{e.name} has no zero value"))
    return sorted(out)


def report(spark: SparkSession, s: Schema, imported: dict[str, Schema] | None = None) -> DataFrame:
    return spark.createDataFrame(check(s, imported), "line int, severity string, message string")


def struct_types(s: Schema, imported: dict[str, Schema] | None = None) -> dict[str, T.StructType]:
    """StructType of each message; an interface becomes a struct of nullable branches.  Records can't nest in themselves."""
    known = {e.name: e for x in (imported or {}).values() for e in x.entries} | {f"{k}.{e.name}": e for k, x in (imported or {}).items() for e in x.entries} | {e.name: e for e in s.entries}

    def made(t: Type, open_: tuple[str, ...]) -> tuple[T.DataType, dict]:
        if t.name == "pointer":
            inner, meta = made(t.item, open_)
            return inner, meta | {"pointer": True}
        if t.name == "list":
            inner, meta = made(t.item, open_)
            meta = {("item_pointer" if k == "pointer" else k): v for k, v in meta.items()}
            return T.ArrayType(inner), meta | ({"fixed_size": t.size} if t.size is not None else {})
        if t.name == "map":
            (key, key_meta), (value, meta) = made(t.key, open_), made(t.item, open_)
            meta = {("item_pointer" if k == "pointer" else k): v for k, v in meta.items()}
            return T.MapType(key, value), meta | ({"key_kind": key_meta["kind"]} if key_meta.get("kind") else {})
        if t.name in SPARK_TYPE:
            plain = t.name in ("bool", "int8", "int16", "int32", "int64", "uint64", "float32", "float64", "string", "bytes")
            return SPARK_TYPE[t.name], {} if plain else {"kind": t.name}
        e = known[t.name]
        if e.kind == "enum":
            return T.IntegerType(), {"kind": "enum"}
        if e.name in open_:
            raise ValueError(f"{e.name} nests in itself, which a StructType can't")
        if e.kind == "interface":
            return T.StructType([T.StructField(f.name, message(known[f.name], (*open_, e.name)), True, {"type_id": f.number}) for f in e.items]), {}
        return message(e, (*open_, e.name)), {}

    def message(e: Entry, open_: tuple[str, ...]) -> T.StructType:
        out = []
        for f in e.items:
            t = Type("list", f.type) if "repeated" in f.modifiers and f.type.name != "list" else f.type
            t = Type("pointer", t) if "optional" in f.modifiers and t.name != "pointer" else t
            kind, meta = made(t, open_)
            meta |= {"field_number": f.number} | ({"required": True} if "required" in f.modifiers else {}) | ({"comment": f.doc} if f.doc else {})
            out.append(T.StructField(f.name, kind, True, meta))
        return T.StructType(out)

    return {e.name: message(e, (e.name,)) for e in s.entries if e.kind == "message"}


def write(s: Schema) -> str:
    """The schema in one normal form."""
    out = [f"package {s.package};\n"] if s.package else []
    out += [f'import "{p}"' + (f" as {a}" if a else "") + ";" for p, a in s.imports]
    literal = lambda v: '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else "[" + ", ".join(map(literal, v)) + "]" if isinstance(v, list) else str(v)
    stated = lambda options, indent="": [f"{indent}option {k} = {literal(v)};" for k, v in options.items()]
    out += stated(s.options)
    for e in s.entries:
        head = [f"/// {line}" for line in e.doc.split("\n") if line]
        rows = stated(e.options, "    ")
        for f in e.items:
            rows += [f"    /// {line}" for line in f.doc.split("\n") if line]
            own = " [" + ", ".join(f"{k} = {literal(v)}" for k, v in f.options.items()) + "]" if f.options else ""
            rows.append(f"    {f.number} = {f.name};" if e.kind == "interface" else f"    {f.name} = {f.number};" if e.kind == "enum" else f"    {' '.join((*f.modifiers, str(f.type), f.name))} = {f.number}{own};")
        out += ["", *head, f"{e.kind} {e.name}" + (f" @{e.type_id}" if e.type_id is not None else "") + " {", *rows, "}"]
    return "\n".join(out).strip() + "\n"


def from_struct(name: str, struct: T.StructType, package: str = "") -> Schema:
    """A schema for a DataFrame's rows; nested structs become messages of their own."""
    s = Schema(package)

    def named(shape: Shape, path: str) -> Type:
        if shape.pointer:
            return Type("pointer", named(replace(shape, pointer=False), path))
        if shape.kind == "list":
            return Type("list", named(shape.item, path), size=shape.size)
        if shape.kind == "map":
            return Type("map", named(shape.item, path), named(shape.key, path))
        if shape.kind == "record":
            add(path, shape.fields)
            return Type(path)
        return Type("int32" if shape.kind == "enum" else shape.kind)

    def add(title: str, fields: tuple) -> None:
        e = Entry("message", title)
        for m in fields:
            path = title + "".join(x.capitalize() for x in m.name.split("_"))
            e.items.append(Field(m.name, m.number, named(m.shape, path), ("required",) if m.required else ()))
        s.entries.append(e)

    add(name, members(struct))
    return s


def from_tables(tables: dict[str, T.StructType], package: str = "", include: tuple[str, ...] = ("*",), exclude: tuple[str, ...] = (), interface: str | None = None) -> Schema:
    """A schema of several DataFrames' rows, by name patterns; ``interface`` joins them under type ids from 128 on."""
    from fnmatch import fnmatch

    names = sorted(n for n in tables if any(fnmatch(n, p) for p in include) and not any(fnmatch(n, p) for p in exclude))
    s = Schema(package)
    for name in names:
        s.entries += from_struct(name, tables[name]).entries
    if interface:
        s.entries.append(Entry("interface", interface, [Field(n, 128 + i, Type("message")) for i, n in enumerate(names)]))
    return s
