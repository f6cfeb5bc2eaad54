import random
import struct
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillstore import codec
from rillstore.schema import SchemaError, parse

USER = """
table User { id: int (id); name: string; email: string (key); age: int; }
table Post { id: int (id); user_id: int (key); title: string; content: string; }
"""
MONSTER = """
namespace game; // comment
enum Color : ubyte { Red = 1, Green = 2, Blue = 8 }
struct Vec3 { x: float; y: float; z: float; }
struct Test { a: short; b: byte; }
table Weapon { name: string; damage: short; }
table Stat { id: string; val: long; count: ushort; }
union Equipment { Weapon, Stat }
/* a
   block */
table Monster {
  pos: Vec3; mana: short = 150; hp: short = 100; name: string (required, key); color: Color = Blue; inventory: [ubyte];
  test4: [Test]; tags: [string]; ok: bool; f: float = 3.5; weapons: [Weapon]; equipped: Equipment; big: ulong; path: [double]; stat: Stat;
}
root_type Monster;
file_identifier "MONS";
"""


def test_idl_types_and_facts():
    s = parse(MONSTER)
    t = s.struct_type("Monster")
    assert t["pos"].dataType.simpleString() == "struct<x:float,y:float,z:float>"
    assert t["inventory"].dataType.simpleString() == "binary"
    assert t["test4"].dataType.simpleString() == "array<struct<a:smallint,b:tinyint>>"
    assert t["big"].dataType.simpleString() == "decimal(20,0)"
    assert t["mana"].metadata["default"] == 150 and not t["name"].nullable and t["name"].metadata["indexed"]
    assert s.root_type == "Monster" and s.file_identifier == "MONS" and s.unions["Equipment"] == ["Weapon", "Stat"]


def test_key_attribute_is_not_slot_attribute():
    s = parse("table T { a: int (id: 1); b: string (id: 0, key); c: int (id: 2); }")
    a, b, _ = s.tables["T"].fields
    assert not a.primary_key and a.slot == 1 and b.slot == 0 and b.indexed
    assert parse(USER).tables["User"].keys == ["id"]


def test_json_schema():
    s = parse('{"name": "Person", "properties": {"name": {"type": "string"}, "age": {"type": "integer"}, "active": {"type": "boolean"}, "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["name"]}')
    assert s.struct_type("Person").simpleString() == "struct<name:string,age:bigint,active:boolean,tags:array<string>>"
    assert not s.struct_type("Person")["name"].nullable
    assert list(parse('{"$defs": {"A": {"properties": {"x": {"type": "number"}}}}}').tables) == ["A"]


@pytest.mark.parametrize("text", ["table T { a int; }", "table T { __proto__: int; }", "wat", "table T { a: int; ", "x" * 1_000_001])
def test_bad_schemas(text):
    with pytest.raises(SchemaError):
        parse(text)


def test_nested_round_trip():
    s = parse(MONSTER)
    row = dict(
        pos=(1, 2, 3), hp=5, name="Orcé", color="Red", inventory=b"\1\2", test4=[(1, 2), (3, 4)], tags=["a", "", "bb"], ok=True,
        weapons=[{"name": "x", "damage": 3}, {"name": "y"}], equipped=("Stat", {"id": "q", "val": -5, "count": 65535}), big=2**64 - 1, path=[1.5, 2.5], stat={"id": "z", "count": 7},
    )
    record = codec.Encoder(s, "Monster", "MONS").record(row)
    assert codec.type_tag(record) == "MONS"
    got = dict(zip([f.name for f in s.tables["Monster"].fields], codec.Decoder(s, "Monster").row(record), strict=True))
    assert got["pos"] == (1, 2, 3) and got["mana"] == 150 and got["hp"] == 5 and got["color"] == "Red" and got["f"] == 3.5
    assert got["test4"] == [(1, 2), (3, 4)] and got["tags"] == ["a", "", "bb"] and got["weapons"] == [("x", 3), ("y", 0)]
    assert got["big"] == Decimal(2**64 - 1) and got["path"] == [1.5, 2.5] and got["stat"] == ("z", 0, 7)
    kind, data = got["equipped"]
    assert kind == "Stat" and codec.Decoder(s, "Stat").row(data) == ("q", -5, 65535)


def test_public_library_reads_our_records():
    flatbuffers = pytest.importorskip("flatbuffers")
    from flatbuffers.table import Table

    s = parse(USER)
    record = codec.Encoder(s, "User", "USER").record(dict(id=7, name="näme", email="e@x", age=-3))
    t = Table(bytearray(record), struct.unpack_from("<I", record)[0])
    assert t.Get(flatbuffers.number_types.Int32Flags, t.Offset(4) + t.Pos) == 7
    assert t.String(t.Offset(6) + t.Pos).decode() == "näme"


def test_we_read_the_public_librarys_records():
    flatbuffers = pytest.importorskip("flatbuffers")
    b = flatbuffers.Builder(0)
    name, email = b.CreateString("bob"), b.CreateString("b@x")
    b.StartObject(4)
    b.PrependInt32Slot(0, 9, 0)
    b.PrependUOffsetTRelativeSlot(1, name, 0)
    b.PrependUOffsetTRelativeSlot(2, email, 0)
    b.PrependInt32Slot(3, 44, 0)
    b.Finish(b.EndObject(), file_identifier=b"USER")
    assert codec.Decoder(parse(USER), "User").row(bytes(b.Output())) == (9, "bob", "b@x", 44)


STRINGS = ["", "tab\t nl\n '\"\\ ; -- /* % _", "日本語 Ελ ע ا \U0001f600", "O'Brien", "x" * 100_000]


@pytest.mark.parametrize("text", STRINGS)
@pytest.mark.parametrize("n", [0, -1, 2**31 - 1, -(2**31)])
def test_edge_values(text, n):
    s = parse(USER)
    assert codec.Decoder(s, "User").row(codec.Encoder(s, "User", "USER").record(dict(id=n, name=text, email=text, age=n))) == (n, text, text, n)


def test_absent_values():
    s = parse(USER)
    r = codec.Encoder(s, "User").record({})
    assert codec.Decoder(s, "User").row(r) == (0, None, None, 0)
    assert codec.Decoder(s, "User", empty_string_defaults=True).row(r) == (0, "", "", 0)
    assert codec.Decoder(s, "User", ["age", "id"]).row(r) == (0, 0)


@settings(max_examples=100, deadline=None)
@given(st.fixed_dictionaries({"id": st.integers(-(2**31), 2**31 - 1), "name": st.text(), "email": st.text(), "age": st.integers(-(2**31), 2**31 - 1)}))
def test_any_row(row):
    s = parse(USER)
    assert codec.Decoder(s, "User").row(codec.Encoder(s, "User", "USER").record(row)) == tuple(row[k] for k in ("id", "name", "email", "age"))


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200))
def test_random_bytes_never_crash(data):
    try:
        codec.Decoder(parse(MONSTER), "Monster").row(data)
    except codec.DecodeError:
        pass
    list(codec.frames(data))


@pytest.mark.parametrize("chunk", [1, 7, 13, 64, 256, 1024])
def test_chunked_stream(chunk):
    s = parse(USER)
    e = codec.Encoder(s, "User", "USER")
    data = b"".join(codec.frame(e.record(dict(id=i, name=f"u{i}", email="e", age=i))) for i in range(100))
    tail, n = b"", 0
    for i in range(0, len(data), chunk):
        tail += data[i : i + chunk]
        n += sum(1 for _ in codec.frames(tail))
        tail = tail[codec.consumed(tail) :]
    assert n == 100 and not tail


def test_checked_layout():
    data = codec.write_checked([("table1", b"\1\2\3\4\5"), ("table2", b"x"), ("table1", b"\6\7\x08\t\n")], "demo")
    got = list(codec.read_checked(data))
    assert [(g[0], g[2], g[4]) for g in got] == [(0, "table1", b"\1\2\3\4\5"), (1, "table2", b"x"), (2, "table1", b"\6\7\x08\t\n")]
    broken = bytearray(data)
    broken[got[1][1] + 48] ^= 1
    assert len(list(codec.read_checked(bytes(broken)))) == 2
    with pytest.raises(ValueError):
        codec.write_checked([("a_name_longer_than_15", b"")])
    with pytest.raises(codec.DecodeError):
        list(codec.read_checked(b"\0" * 64))


def test_malformed_frames():
    rng = random.Random(42)
    assert list(codec.frames(bytes([1, 2, 3]))) == []
    assert codec.type_tag(b"1234567") == ""
    list(codec.frames(bytes(rng.randrange(256) for _ in range(100))))
