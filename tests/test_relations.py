import pytest

from rillstore.operators import relations as R
from rillstore.schema import parse

FILES = {
    "monster.fbs": 'include "weapons.fbs"; table Monster { name: string; weapon: Weapon; inventory: [Weapon]; eq: Any; eqs: [Any]; } union Any { Weapon, Monster }',
    "weapons.fbs": "table Weapon { name: string; damage: short; }",
}


def test_links_and_order():
    assert R.import_order(FILES) == ["weapons.fbs", "monster.fbs"]
    assert [(x.name, x.kind, x.children) for x in R.links(R.merge(FILES))] == [
        ("Monster__weapon", "single", ("Weapon",)), ("Monster__inventory", "vector", ("Weapon",)), ("Monster__eq", "union", ("Weapon", "Monster")), ("Monster__eqs", "vector_union", ("Weapon", "Monster")),
    ]
    assert "parent_rowid BIGINT" in R.links(R.merge(FILES))[0].ddl()


def test_cycles():
    files = {"a.fbs": 'include "b.fbs";', "b.fbs": 'include "c.fbs";', "c.fbs": 'include "a.fbs";'}
    assert R.import_cycle(files) == ["a.fbs", "b.fbs", "c.fbs", "a.fbs"]
    with pytest.raises(ValueError, match="a.fbs -> b.fbs"):
        R.import_order(files)
    assert R.import_cycle(FILES) == []


def test_extract_and_walk(spark):
    p = spark.createDataFrame([(1, [("sword", 3), ("bow", 1)], ("axe", 9)), (2, [], None), (3, None, ("pike", 2))], "_rowid long, inventory array<struct<name:string,damage:int>>, weapon struct<name:string,damage:int>")
    kids, links = R.extract(p, R.Link("Monster", "inventory", "vector", ("Weapon",)))
    assert [r["name"] for r in R.children(links, kids, 1).collect()] == ["sword", "bow"]
    assert links.columns == list(R.LINK)
    kids1, links1 = R.extract(p, R.Link("Monster", "weapon", "single", ("Weapon",)))
    assert sorted(r["name"] for r in kids1.collect()) == ["axe", "pike"] and links1.filter("vec_index is not null").count() == 0
    one = links.filter("vec_index = 1").first()["child_rowid"]
    assert [r["_rowid"] for r in R.parents(links, p, one).collect()] == [1]
    assert R.reference_counts(links).count() == 2
    assert R.orphans(kids, links.filter("vec_index = 0")).count() == 1


def test_cascade(spark):
    edges = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (10, 20), (20, 30), (30, 20), (40, 41), (41, 40)], "parent long, child long")
    gone = lambda *roots: sorted(r[0] for r in R.cascade(edges, spark.createDataFrame([(x,) for x in roots], "node long")).collect())
    assert gone(1) == [1, 10]  # 20 is still referred to by 30
    assert gone(1, 2) == [1, 2, 10, 11]
    assert gone(40) == [40, 41]
    assert gone(10, 30) == [10, 20, 30]


def test_links_do_not_depend_on_order():
    s = parse("table A { b: B; } table B { x: int; }")
    assert [x.name for x in R.links(s)] == ["A__b"]
