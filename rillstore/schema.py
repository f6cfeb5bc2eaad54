"""Declared schemas: interface-definition text or JSON Schema to Spark types.

Column facts that Spark types cannot hold (key, index, encryption, default, slot) go to the fields'
metadata. Keys are hints for sorting and lookups; neither uniqueness nor order is enforced.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

MAX_SOURCE, MAX_DEPTH = 1_000_000, 50
_FORBIDDEN = frozenset(("__proto__", "constructor", "prototype"))

# Scalar type names with width in bytes, struct code, and Spark type (unsigned types widen).
SCALARS: dict[str, tuple[int, str, T.DataType]] = {
    "bool": (1, "?", T.BooleanType()),
    "byte": (1, "b", T.ByteType()), "int8": (1, "b", T.ByteType()),
    "ubyte": (1, "B", T.ShortType()), "uint8": (1, "B", T.ShortType()),
    "short": (2, "h", T.ShortType()), "int16": (2, "h", T.ShortType()),
    "ushort": (2, "H", T.IntegerType()), "uint16": (2, "H", T.IntegerType()),
    "int": (4, "i", T.IntegerType()), "int32": (4, "i", T.IntegerType()),
    "uint": (4, "I", T.LongType()), "uint32": (4, "I", T.LongType()),
    "long": (8, "q", T.LongType()), "int64": (8, "q", T.LongType()),
    "ulong": (8, "Q", T.DecimalType(20, 0)), "uint64": (8, "Q", T.DecimalType(20, 0)),
    "float": (4, "f", T.FloatType()), "float32": (4, "f", T.FloatType()),
    "double": (8, "d", T.DoubleType()), "float64": (8, "d", T.DoubleType()),
}
_BYTES = frozenset(("ubyte", "uint8", "byte", "int8"))


class SchemaError(ValueError):
    """The schema text cannot be read."""


@dataclass
class Field:
    name: str
    type: str
    vector: bool = False
    default: object = None
    slot: int = 0
    nullable: bool = True
    indexed: bool = False
    primary_key: bool = False
    encrypted: bool = False


@dataclass
class Table:
    name: str
    fields: list[Field] = field(default_factory=list)
    is_struct: bool = False

    @property
    def keys(self) -> list[str]:
        return [f.name for f in self.fields if f.primary_key]

    @property
    def indexes(self) -> list[str]:
        return [f.name for f in self.fields if f.indexed]


@dataclass
class Enum:
    name: str
    type: str
    values: dict[str, int]


@dataclass
class Schema:
    tables: dict[str, Table] = field(default_factory=dict)
    structs: dict[str, Table] = field(default_factory=dict)
    enums: dict[str, Enum] = field(default_factory=dict)
    unions: dict[str, list[str]] = field(default_factory=dict)
    includes: list[str] = field(default_factory=list)
    namespace: str = ""
    root_type: str = ""
    file_identifier: str = ""

    def spark_type(self, f: Field, depth: int = 0) -> T.DataType:
        if depth > 8:  # recursive tables end as bytes
            return T.BinaryType()
        if f.vector and f.type in _BYTES:
            return T.BinaryType()
        one = self._one(f.type, depth)
        return T.ArrayType(one) if f.vector else one

    def _one(self, name: str, depth: int) -> T.DataType:
        if name in SCALARS:
            return SCALARS[name][2]
        if name == "string" or name in self.enums:
            return T.StringType()
        if name in self.unions:
            return T.StructType([T.StructField("type", T.StringType()), T.StructField("data", T.BinaryType())])
        if name in self.structs or name in self.tables:
            own = self.structs.get(name) or self.tables[name]
            return T.StructType([T.StructField(g.name, self.spark_type(g, depth + 1)) for g in own.fields])
        raise SchemaError(f"unknown type {name!r}")

    def struct_type(self, table: str) -> T.StructType:
        """The Spark type of a table's declared columns."""
        out = []
        for f in self.tables[table].fields:
            facts = {"slot": f.slot, "indexed": f.indexed, "primary_key": f.primary_key, "encrypted": f.encrypted}
            if f.default is not None:
                facts["default"] = f.default
            out.append(T.StructField(f.name, self.spark_type(f), f.nullable, facts))
        return T.StructType(out)


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[A-Za-z_][\w.]*|[-+]?(?:0x[0-9a-fA-F]+|\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|[{}()\[\]:;,=|]|\S')


def _literal(text: str) -> object:
    if text in ("true", "false"):
        return text == "true"
    if text == "null":
        return None
    if text.startswith('"'):
        return json.loads(text)
    try:
        return int(text, 0)
    except ValueError:
        try:
            return float(text)
        except ValueError:
            return text


class _Idl:
    def __init__(self, text: str):
        text = re.sub(r"/\*.*?\*/", " ", text, flags=re.S)
        text = re.sub(r'("(?:[^"\\\n]|\\.)*")|//[^\n]*', lambda m: m[1] or " ", text)
        self.tokens, self.at, self.schema = _TOKEN.findall(text), 0, Schema()

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def next(self, *want: str) -> str:
        got = self.peek()
        if not got or want and got not in want:
            raise SchemaError(f"expected {' or '.join(want) or 'more'}, found {got or 'the end'!r}")
        self.at += 1
        return got

    def name(self) -> str:
        got = self.next()
        if got in _FORBIDDEN or not re.fullmatch(r"[A-Za-z_][\w.]*", got):
            raise SchemaError(f"bad name {got!r}")
        return got

    def attributes(self) -> dict[str, object]:
        out: dict[str, object] = {}
        if self.peek() == "(":
            self.next()
            while self.peek() != ")":
                key = self.next().strip('"')
                out[key] = True
                if self.peek() == ":":
                    self.next()
                    out[key] = _literal(self.next())
                if self.peek() == ",":
                    self.next()
            self.next(")")
        return out

    def table(self, is_struct: bool) -> None:
        t = Table(self.name(), [], is_struct)
        self.attributes()
        self.next("{")
        while self.peek() != "}":
            f = Field(self.name(), "")
            self.next(":")
            f.vector = self.peek() == "["
            if f.vector:
                self.next()
            f.type = self.name()
            if f.vector:
                if self.peek() == ":":  # fixed-length arrays are read as vectors
                    self.next()
                    self.next()
                self.next("]")
            f.type = f.type.rpartition(".")[2]
            if self.peek() == "=":
                self.next()
                f.default = _literal(self.next())
            a = self.attributes()
            f.slot = a["id"] if isinstance(a.get("id"), int) and a["id"] is not True else len(t.fields)
            f.primary_key = a.get("id") is True or "primary_key" in a
            f.indexed = f.primary_key or any(k in a for k in ("key", "index", "indexed"))
            f.nullable = "required" not in a
            f.encrypted = "encrypted" in a
            self.next(";")
            t.fields.append(f)
        self.next("}")
        (self.schema.structs if is_struct else self.schema.tables)[t.name] = t

    def enum(self) -> None:
        name, kind, values, at = self.name(), "byte", {}, 0
        if self.peek() == ":":
            self.next()
            kind = self.name()
        bits = "bit_flags" in self.attributes()
        self.next("{")
        while self.peek() != "}":
            key = self.name()
            if self.peek() == "=":
                self.next()
                at = int(_literal(self.next()))
            values[key] = 1 << at if bits else at
            at += 1
            if self.peek() == ",":
                self.next()
        self.next("}")
        self.schema.enums[name] = Enum(name, kind, values)

    def union(self) -> None:
        name, members = self.name(), []
        self.attributes()
        self.next("{")
        while self.peek() != "}":
            member = self.name()
            if self.peek() == ":":
                self.next()
                member = self.name()
            members.append(member.rpartition(".")[2])
            if self.peek() == "=":
                self.next()
                self.next()
            if self.peek() == ",":
                self.next()
        self.next("}")
        self.schema.unions[name] = members

    def parse(self) -> Schema:
        s = self.schema
        while self.peek():
            word = self.next()
            if word == "table" or word == "struct":
                self.table(word == "struct")
            elif word == "enum":
                self.enum()
            elif word == "union":
                self.union()
            elif word in ("namespace", "root_type", "attribute", "include", "file_identifier", "file_extension"):
                value = self.next().strip('"')
                if word == "include":
                    s.includes.append(value)
                elif word in ("namespace", "root_type", "file_identifier"):
                    setattr(s, word, value)
                self.next(";")
            elif word != ";":
                raise SchemaError(f"unexpected {word!r}")
        return s


# JSON Schema types and the type names they become.
_JSON_TYPES = {"boolean": "bool", "integer": "int64", "number": "double", "string": "string"}
_JSON_FORMATS = frozenset(("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float", "double"))


def _json_table(s: Schema, name: str, spec: dict, depth: int = 0) -> Table:
    if depth > MAX_DEPTH:
        raise SchemaError("the schema is nested too deeply")
    t = Table(name)
    s.tables[name] = t
    required = set(spec.get("required") or ()) if isinstance(spec.get("required"), list) else set()
    for key, p in (spec.get("properties") or {}).items():
        if key in _FORBIDDEN:
            raise SchemaError(f"bad name {key!r}")
        f = Field(key, "string", slot=len(t.fields), default=p.get("default"))
        f.nullable = key not in required and p.get("required") is not True
        f.primary_key = bool(p.get("id") is True or p.get("primaryKey") or p.get("x-primary-key"))
        f.indexed = f.primary_key or any(p.get(k) for k in ("key", "index", "indexed", "x-index"))
        f.encrypted = bool(p.get("encrypted"))
        kind = p.get("type")
        if isinstance(kind, list):
            kind = next((k for k in kind if k != "null"), "string")
        if "$ref" in p:
            f.type = p["$ref"].rpartition("/")[2]
        elif kind == "array":
            f.vector, item = True, p.get("items") or {}
            f.type = item["$ref"].rpartition("/")[2] if "$ref" in item else _JSON_TYPES.get(item.get("type"), "string")
        elif kind == "object":
            f.type = f"{name}_{key}"
            _json_table(s, f.type, p, depth + 1)
        elif kind == "string" and p.get("format") in ("byte", "binary"):
            f.type, f.vector = "ubyte", True
        else:
            f.type = p["format"] if p.get("format") in _JSON_FORMATS else _JSON_TYPES.get(kind, "string")
        t.fields.append(f)
    return t


def parse_json_schema(text: str) -> Schema:
    doc, s = json.loads(text), Schema()
    for group in ("definitions", "$defs"):
        for name, spec in (doc.get(group) or {}).items():
            _json_table(s, name, spec)
    if "properties" in doc or not s.tables:
        name = doc.get("name") or doc.get("title") or "default"
        _json_table(s, name, doc)
        s.root_type = name
    return s


def parse_idl(text: str) -> Schema:
    return _Idl(text).parse()


def parse(text: str) -> Schema:
    """A schema from JSON Schema (text that begins with ``{``) or interface-definition text."""
    if len(text) > MAX_SOURCE:
        raise SchemaError(f"schema texts hold {MAX_SOURCE} characters at most")
    return parse_json_schema(text) if text.lstrip().startswith("{") else parse_idl(text)
