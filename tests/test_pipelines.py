"""Pipelines on small databases: matches, modifiers, writes, functions, documents."""

import json

import pytest

from knotwork.errors import ConflictError, QueryError, SchemaError, WriteError
from knotwork.operators.fetch import documents
from tests.conftest import PEOPLE, rows

THREE = 'insert $a isa person, has age 10, has name "John"; $b isa person, has age 20, has name "Alice"; $c isa person, has age 30, has name "Harry"; $o isa organisation; membership (member: $a, group: $o);'


@pytest.fixture
def people(database):
    return database(PEOPLE, THREE)


def ask(db, text, given=None):
    with db.transaction() as tx:
        return rows(tx.query(text, given))


def write(db, *texts):
    with db.transaction("write") as tx:
        out = [rows(tx.query(t)) for t in texts]
        tx.commit()
    return out[-1]


def test_match_select_sort(people):
    assert ask(people, "match $p isa person, has age $a; select $a;") == [(10,), (20,), (30,)]
    with people.transaction() as tx:
        assert [r[0] for r in tx.query("match $a isa age; sort $a desc;").collect()] == [30, 20, 10]
        assert [r[0] for r in tx.query("match $p isa person, has age $a; sort $a; offset 1; limit 1; select $a;").collect()] == [20]


def test_named_variables_count_and_anonymous_do_not(database):
    db = database(PEOPLE, 'insert $x isa person, has age 1, has age 2, has name "a", has name "b"; $y isa person, has age 3, has name "c";')
    assert ask(db, "match $p isa person, has age $_; reduce $n = count;") == [(2,)]
    assert ask(db, "match $p isa person, has age $a; reduce $n = count;") == [(3,)]
    assert ask(db, "match $p isa person, has age $a, has name $n; select $p; reduce $n = count;") == [(5,)]


def test_roles_are_not_filled_twice_by_one_player(database):
    db = database(PEOPLE, 'insert $x isa person, has name "a"; $y isa person, has name "b"; friendship (friend: $x, friend: $y);')
    assert ask(db, "match friendship (friend: $a, friend: $b); $a has name $x; $b has name $y; select $x, $y;") == [("a", "b"), ("b", "a")]


def test_optional_and_require(people):
    q = "match $p isa person, has name $n; try { membership (member: $p, group: $g); };"
    assert len(ask(people, q)) == 3
    assert ask(people, q + " require $g; select $n;") == [("John",)]
    assert ask(people, q + " reduce $c = count($g);") == [(1,)]


def test_negation_and_disjunction(people):
    assert ask(people, "match $p isa person, has name $n; not { membership (member: $p); }; select $n;") == [("Alice",), ("Harry",)]
    both = "match $p isa person, has age $a; { $a > 5; } or { $a > 15; }; select $a;"
    assert ask(people, both) == [(10,), (20,), (20,), (30,), (30,)]  # an answer of two branches stays two rows


def test_match_after_match_keeps_bag(people):
    assert ask(people, "match $p isa person; reduce $n = count; match $a isa age; select $a;") == [(10,), (20,), (30,)]
    assert len(ask(people, "match $p isa person, has name $n; select $n; match $q isa person, has age $_; select $n, $q;")) == 9


def test_insert_for_each_row(people):
    made = write(people, 'match $p isa person; insert $q isa person, has name "copy"; membership (member: $q);')
    assert len(made) == 3
    assert ask(people, 'match $q isa person, has name "copy"; reduce $n = count;') == [(3,)]


def test_match_insert_match(people):
    got = write(people, "match $p isa person, has age 20; insert $p has age 21; match $p has age $a; select $a;")
    assert got == [(20,), (21,)]


def test_attributes_are_one_by_value(people):
    write(people, "match $p isa person, has age 20; insert $p has age 10;")
    assert ask(people, "match $a isa age; $a == 10; reduce $n = count;") == [(1,)]


def test_put(people):
    assert len(write(people, 'put $p isa person, has name "New";')) == 1
    assert len(write(people, 'put $p isa person, has name "New";')) == 1
    assert ask(people, 'match $p isa person, has name "New"; reduce $n = count;') == [(1,)]


def test_update(database):
    db = database("define attribute score value integer; entity user, owns score;", "insert $u isa user, has score 1;")
    write(db, "match $u isa user; update $u has score 5;")
    assert ask(db, "match $u isa user, has score $s; select $s;") == [(5,)]


def test_update_of_many_is_refused(people):
    with pytest.raises(WriteError):
        write(people, "match $p isa person; update $p has age 5;")


def test_delete(people):
    write(people, 'match $p isa person, has name $n; $n == "John"; delete has $n of $p;')
    assert ask(people, "match $p isa person, has name $n; select $n;") == [("Alice",), ("Harry",)]
    write(people, "match $p isa person, has age 10; delete $p;")
    assert ask(people, "match $p isa person; reduce $n = count;") == [(2,)]
    # the membership lost its only member, but has its group
    assert ask(people, "match $m isa membership; reduce $n = count;") == [(1,)]
    write(people, "match $m isa membership, links (group: $g); delete links (group: $g) of $m;")
    assert ask(people, "match $m isa membership; reduce $n = count;") == [(0,)]


def test_deleted_variables_leave_the_row(people):
    with people.transaction("write") as tx:
        df = tx.query("match $p isa person, has age $a; delete $p;")
        assert df.columns == ["a"]


def test_cardinality_key_and_values(database):
    db = database('define attribute id value integer; attribute mail value string @regex("^.+@.+$"); attribute size value string @values("s", "m"); attribute n value integer @range(1..9); entity user, owns id @key, owns mail, owns size, owns n;')
    write(db, 'insert $u isa user, has id 1, has mail "a@b", has size "s", has n 9;')
    for bad in ("insert $u isa user, has id 1;", "insert $u isa user;", 'insert $u isa user, has id 2, has mail "x";', 'insert $u isa user, has id 2, has size "l";', "insert $u isa user, has id 2, has n 10;", 'insert $u isa user, has id 2, has mail "a@b", has mail "b@c";'):
        with pytest.raises(WriteError):
            write(db, bad)
    assert ask(db, "match $u isa user; reduce $n = count;") == [(1,)]


@pytest.mark.parametrize("text", ["insert $p isa person, has nothing 1;", "insert $m isa membership (nobody: $p);", "match $p isa person; insert $p isa person;", "insert $a isa age;", "match $p isa person; insert { $p has age 1; } or { $p has age 2; };"])
def test_wrong_writes(people, text):
    with pytest.raises(QueryError):
        write(people, text)


def test_transactions(people):
    with people.transaction() as tx, pytest.raises(QueryError):
        tx.query("insert $p isa person;")
    with people.transaction("write") as tx:
        tx.query("insert $p isa person, has age 99;")
        assert rows(tx.query("match $p isa person, has age 99; reduce $n = count;")) == [(1,)]
        tx.rollback()
        assert rows(tx.query("match $p isa person, has age 99; reduce $n = count;")) == [(0,)]
    a, b = people.transaction("write"), people.transaction("write")
    a.query("insert $p isa person, has age 50;")
    b.query("insert $p isa person, has age 51;")
    a.commit()
    with pytest.raises(ConflictError):
        b.commit()
    assert ask(people, "match $a isa age; $a > 40; select $a;") == [(50,)]


def test_schema_changes_are_checked_against_data(people):
    for bad in ("undefine person;", "undefine owns age from person;", "undefine plays membership:member from person;", "define attribute age value integer @range(0..15);", "redefine entity person owns age @card(0..0);"):
        with people.transaction("schema") as tx, pytest.raises(SchemaError):
            tx.query(bad)
    with people.transaction("schema") as tx:
        tx.query("define attribute email value string; entity person owns email;".replace("person owns", "person, owns"))
        tx.commit()
    assert "email" in people.schema()


def test_export_and_load(people, server, tmp_path):
    people.export(f"file://{tmp_path}/out")
    other = server.create("other")
    other.load(f"file://{tmp_path}/out")
    assert ask(other, "match membership (member: $p); $p has name $n; select $n;") == [("John",)]
    write(other, "insert $p isa person, has age 1;")
    assert ask(other, "match $p isa person; reduce $n = count;") == [(4,)]


def test_given(people, spark):
    df = spark.createDataFrame([("John",), ("Nobody",)], "n string")
    assert ask(people, "given $n: string; match $p isa person, has name == $n, has age $a; select $a;", df) == [(10,)]
    with people.transaction() as tx, pytest.raises(QueryError):
        tx.query("given $n: integer; match $p isa person;", df)


LIBRARY = """define attribute isbn value string; attribute title value string; attribute pages value integer;
entity book, owns isbn @key, owns title @card(0..), owns pages, plays citation:source, plays citation:target; relation citation, relates source, relates target;"""
BOOKS = """insert $a isa book, has isbn "i1", has title "Knots", has title "Noeuds", has pages 210; $b isa book, has isbn "i2", has title "Ropes", has pages 95; $c isa book, has isbn "i3", has title "Sails", has title "Segel", has pages 330;
citation (source: $a, target: $b); citation (source: $a, target: $c); citation (source: $c, target: $b);"""


def test_fetch(database):
    """Every kind of leaf, for each book that cites another one."""
    db = database(LIBRARY, BOOKS)
    with db.transaction() as tx:
        df = tx.query("""match $b isa book, has isbn $i, has pages $p; citation (source: $b);
            fetch { "isbn": $i, "pages": $b.pages, "half": $p / 2, "titles": [ $b.title ], "all": { $b.* }, "kind": book, "sheet": { "count": { "of": $p } },
              "cited": [ match citation (source: $b, target: $x); $x has isbn $j; sort $j; fetch { "to": $j, "long": $x.pages }; ],
              "ids": [ match citation (source: $b, target: $x); $x has isbn $j; return { $j }; ],
              "most": ( match citation (source: $b, target: $x); $x has pages $q; return max($q); ), "last": ( match $b has title $t; sort $t; return last $t; ) };""")
        docs = {d["isbn"]: d for d in (json.loads(r[0]) for r in documents(df).collect())}
    for d in docs.values():
        d["ids"].sort()
    assert docs == {
        "i1": {"isbn": "i1", "pages": 210, "half": 105.0, "titles": ["Knots", "Noeuds"], "all": {"isbn": "i1", "title": ["Knots", "Noeuds"], "pages": 210}, "kind": "book", "sheet": {"count": {"of": 210}}, "cited": [{"to": "i2", "long": 95}, {"to": "i3", "long": 330}], "ids": ["i2", "i3"], "most": 330, "last": "Noeuds"},
        "i3": {"isbn": "i3", "pages": 330, "half": 165.0, "titles": ["Sails", "Segel"], "all": {"isbn": "i3", "title": ["Sails", "Segel"], "pages": 330}, "kind": "book", "sheet": {"count": {"of": 330}}, "cited": [{"to": "i2", "long": 95}], "ids": ["i2"], "most": 95, "last": "Segel"},
    }


def test_fetch_lists_may_be_empty_and_objects_are_refused(people):
    with people.transaction() as tx:
        got = tx.query('match $p isa person, has name $n; fetch { "n": $n, "groups": [ match membership (member: $p, group: $g); fetch { "x": 1 }; ] };').collect()
        assert sorted((r["n"], len(r["groups"])) for r in got) == [("Alice", 0), ("Harry", 0), ("John", 1)]
        with pytest.raises(QueryError):
            tx.query('match $p isa person; fetch { "p": $p };')
        with pytest.raises(QueryError):
            tx.query('match $p isa person; fetch { "a": $p.age };')


RIVERS = "define attribute basin value string; attribute flow value integer; entity river, owns basin @card(0..), owns flow, plays mouth:upper, plays mouth:lower; relation mouth, relates upper, relates lower;"
WATER = 'insert $i isa river, has basin "Inn", has flow 700; $d isa river, has basin "Danube", has flow 6500; $s isa river, has basin "Sill", has flow 24; $r isa river, has basin "Ruetz", has flow 9; mouth (upper: $i, lower: $d); mouth (upper: $s, lower: $i); mouth (upper: $r, lower: $s);'
FEEDERS = "with fun feeders($r: river) -> { river }: match { mouth (upper: $f, lower: $r); } or { mouth (upper: $m, lower: $r); let $f in feeders($m); }; return { $f };"
FEEDERS_TWICE = "with fun feeders($r: river) -> { river }: match { mouth (upper: $f, lower: $r); } or { let $m in feeders($r); let $f in feeders($m); }; return { $f };"


@pytest.mark.parametrize("fun", [FEEDERS, FEEDERS_TWICE])
def test_recursion_ends_on_cycles(database, fun):
    """With a canal from the Danube back to the Ruetz each river feeds itself too."""
    db = database(RIVERS, WATER + " mouth (upper: $d, lower: $r);")
    for basin in ("Inn", "Sill"):
        assert ask(db, fun + f' match $r isa river, has basin "{basin}"; let $f in feeders($r); $f has basin $n; select $n;') == [("Danube",), ("Inn",), ("Ruetz",), ("Sill",)]


def test_reduce_over_a_recursive_function(database):
    db = database(RIVERS, WATER)
    assert ask(db, FEEDERS + ' match $r isa river, has basin "Danube"; let $f in feeders($r); $f has flow $w; reduce $s = sum($w), $n = count;') == [(733, 3)]


def test_recursion_that_does_not_end_in_time_is_an_error(database, monkeypatch):
    from knotwork.operators.calls import Tabling

    db = database(RIVERS, WATER)
    monkeypatch.setattr(Tabling, "MOST_ROUNDS", 2)
    with pytest.raises(QueryError):
        ask(db, FEEDERS + " match $r isa river; let $f in feeders($r); reduce $n = count;")


def test_stored_function(database):
    db = database(RIVERS, "define fun broad($r: river) -> boolean: match $r has flow $w; $w > 100; return check;", WATER)
    assert ask(db, "match $r isa river, has basin $x; let $h = broad($r); $h == true; select $x;") == [("Danube",), ("Inn",)]


@pytest.mark.parametrize(
    "fun",
    [
        "with fun f($s: river) -> { river }: match $e isa river; not { let $e in f($s); }; $s isa river; return { $e };",
        "with fun f($s: river) -> integer: match let $n = f($s); return count($n);",
        "with fun f($s: river, $t: river) -> { river }: match $s isa river; return { $s };",
        "with fun f($s: river) -> { river, river }: match $s isa river; return { $s };",
        "with fun f($s: river) -> { river }: match $s isa river; require $s; return { $s };",
    ],
)
def test_functions_that_are_refused(database, fun):
    db = database(RIVERS)
    with db.transaction() as tx, pytest.raises(QueryError):
        tx.query(fun + " match $n isa river; let $x in f($n);")


def test_analyse(people):
    with people.transaction() as tx:
        got = tx.analyse("match $p isa person, has age $a; reduce $m = max($a);")
    assert got["stages"][0]["variables"]["a"]["value"] == "integer" and got["stages"][1]["variables"]["m"]["optional"]


def test_wrong_reads(people):
    for bad in ("match $p isa person; select $q;", "match $p isa person, has name $n; reduce $s = sum($n);", "match $p isa person; reduce $s = max($p);", 'match $p isa person, has name $n; $n like $n;', "match let $x = $y + 1;", "match not { try { $p isa person; }; };", "match $p isa person; fetch { \"a\": 1 }; select $p;"):
        with people.transaction() as tx, pytest.raises(QueryError):
            tx.query(bad)


def test_equal_input_rows_come_back_as_often(database, spark):
    db = database(PEOPLE, 'insert $x isa person, has age 1, has age 2, has name "a"; $y isa person, has age 3, has name "b";')
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "n string")
    assert ask(db, "given $n: string; match $p isa person, has name == $n, has age $_; select $n;", df) == [("a",), ("a",), ("b",)]
    assert len(ask(db, "given $n: string; match $p isa person, has name == $n; { $p has age 1; } or { $p has age > 0; }; select $n;", df)) == 5


def test_types_and_roles_can_be_renamed(people):
    for text in ("redefine person label human;", "redefine membership:member label participant;", "redefine membership label belonging;", "redefine age label years;"):
        with people.transaction("schema") as tx:
            tx.query(text)
            tx.commit()
    assert ask(people, "match belonging (participant: $p, group: $g); $p isa human, has name $n, has years $y; select $n, $y;") == [("John", 10)]
    with people.transaction("schema") as tx, pytest.raises(SchemaError):
        tx.query("redefine human label organisation;")
    with people.transaction("schema") as tx, pytest.raises(QueryError):
        tx.query("redefine person label x;")


SHIPPING = """define
attribute tag value string; attribute tons value integer;
entity cargo @abstract, owns tag @key, plays loading:load; entity barrel sub cargo, owns tons; entity crate sub cargo, plays crating:crate; entity ship sub cargo, plays stowage:ship;
relation loading @abstract, relates load, relates holder @abstract;
relation crating sub loading, relates crate as holder; relation stowage sub loading, relates ship as holder;
fun inside($h: crate) -> { cargo }: match $x isa cargo; { crating (crate: $h, load: $x); } or { crating (crate: $h, load: $c); $c isa crate; let $x in inside($c); }; return { $x };
fun weight($h: crate) -> integer: match let $x in inside($h); $x isa barrel, has tons $t; return sum($t);"""
DOCK = """insert $b isa barrel, has tag "b1", has tons 3; $c isa barrel, has tag "b2", has tons 4; $k isa crate, has tag "k1"; $m isa crate, has tag "k2"; $n isa crate, has tag "k3"; $s isa ship, has tag "s";
crating (crate: $k, load: $b); crating (crate: $k, load: $m); crating (crate: $m, load: $c); crating (crate: $m, load: $n); stowage (ship: $s, load: $k);"""


def test_recursive_functions_over_specialised_roles(database):
    """What is in a crate, to any depth; the abstract relation sees crates and ships as holders."""
    db = database(SHIPPING, DOCK)
    assert ask(db, 'match $k isa crate, has tag "k1"; let $x in inside($k); $x has tag $t; select $t;') == [("b1",), ("b2",), ("k2",), ("k3",)]
    assert ask(db, "match $k isa crate, has tag $t; let $w = weight($k); select $t, $w;") == [("k1", 7), ("k2", 4), ("k3", 0)]
    assert ask(db, 'match loading (holder: $h, load: $x); $h has tag $t; $x has tag $u; select $t, $u;') == [("k1", "b1"), ("k1", "k2"), ("k2", "b2"), ("k2", "k3"), ("s", "k1")]


def test_given_of_several_types_and_tables(spark):
    from pyspark.sql import functions as F

    from knotwork.session import query
    from knotwork.sources import tables

    cat, store = tables.catalog(), tables.store(spark, "/root/testdata/sf0.001")
    both = spark.createDataFrame([(1, "customer"), (1, "supplier"), (2, "supplier")], "x long, `x#t` string")
    assert query(spark, cat, store, "given $x: party; match $x has name $n; select $n;", both).count() == 3
    with pytest.raises(QueryError):
        query(spark, cat, store, "given $x: party; match $x has name $n;", spark.createDataFrame([(11, "supplier")], "x long, `x#t` string"))
    said = query(spark, cat, store, "match $u isa utterance, has turn 0; select $u;").withColumnRenamed("u", "x")
    assert query(spark, cat, store, "given $x: utterance; match $x has said $t; reduce $n = count;", said).first()[0] == said.count()
    live = query(spark, cat, store, "match $r isa residence; select $r;").withColumnRenamed("r", "x").limit(7)
    assert query(spark, cat, store, "given $x: residence; match $x links (place: $p); reduce $n = count;", live).first()[0] == 7
    for kind in ("utterance", "residence", "line-item"):
        ids = query(spark, cat, store, f"match $u isa {kind}; let $i = iid($u); select $i;").select("i").distinct()
        one = ids.orderBy("i").first()[0]
        assert query(spark, cat, store, f"match $u isa {kind}; $u iid {one}; let $i = iid($u); select $i;").collect() == [(one,)]
    assert ids.where(F.col("i").isNull()).isEmpty()


def test_new_ids_have_no_gaps(database, spark):
    db = database("define attribute id value integer; entity thing_, owns id;")
    rows = spark.range(1000).select(F_id()).repartition(7)
    for _ in range(2):
        with db.transaction("write") as tx:
            tx.query("given $k: integer; insert $t isa thing_, has id == $k;", rows)
            tx.commit()
    m = db.manifest(db.version())
    assert m["next_id"] == 2000


def F_id():
    from pyspark.sql import functions as F

    return F.col("id").alias("k")


TWO = "define attribute id value integer; entity boat, owns id @key; entity crane, owns id @card(0..3); relation lift, relates by @card(0..), relates what @card(0..); boat plays lift:what; crane plays lift:by;"


def test_inserts_add_parts_and_read_no_old_ones(database):
    """A commit that only adds writes its own rows; after deleted parts of other tables an insert still works."""
    db = database(TWO, "insert $b isa boat, has id 1; $c isa crane, has id 1;")
    first = db.manifest(db.version())["tables"]
    write(db, "insert $b isa boat, has id 2;")
    second = db.manifest(db.version())["tables"]
    assert second["thing/boat"][:-1] == first["thing/boat"] and second["has/id"][:-1] == first["has/id"] and second["thing/crane"] == first["thing/crane"]
    with db.transaction("write") as tx:
        tx.query("insert $b isa boat, has id 3;")
        plan = tx.writer.delta("has/id")
        assert plan.count() == 1
    for k in (1, 2):
        with db.transaction("write") as tx, pytest.raises(WriteError):
            tx.query(f"insert $b isa boat, has id {k};")
            tx.commit()
    assert ask(db, "match $b isa boat, has id $k; select $k;") == [(1,), (2,)]


def test_more_than_the_most_parts_are_written_whole(database, monkeypatch):
    from knotwork import session

    monkeypatch.setattr(session, "MOST_PARTS", 2)
    db = database(TWO)
    for k in range(4):
        write(db, f"insert $b isa boat, has id {k};")
    assert len(db.manifest(db.version())["tables"]["thing/boat"]) <= 2 and len(ask(db, "match $b isa boat, has id $k; select $k;")) == 4


def test_transactions_on_other_tables_do_not_conflict(database):
    db = database(TWO, "insert $b isa boat, has id 1; $c isa crane;")
    one, two, three = (db.transaction("write") for _ in range(3))
    one.query("insert $c isa crane;")
    two.query("match $b isa boat; $c isa crane; insert lift (by: $c, what: $b);")
    three.query("insert $c isa crane;")
    one.commit()
    two.commit()
    with pytest.raises(ConflictError):
        three.commit()
    assert ask(db, "match $c isa crane; reduce $n = count;") == [(2,)] and ask(db, "match $r isa lift; reduce $n = count;") == [(1,)]


def test_limits_hold_over_commits(database):
    """Checks of new rows see the old ones of the same owners."""
    db = database(TWO, "insert $c isa crane, has id 1, has id 2;")
    write(db, "match $c isa crane; insert $c has id 3;")
    write(db, "match $c isa crane; insert $c has id 3;")
    with db.transaction("write") as tx, pytest.raises(WriteError):
        tx.query("match $c isa crane; insert $c has id 4;")
        tx.commit()
    with db.transaction("write") as tx, pytest.raises(WriteError):
        tx.query("insert $b isa boat;")
        tx.commit()
    assert len(ask(db, "match $c isa crane, has id $k; select $k;")) == 3


def test_a_failed_query_leaves_no_rows(database):
    db = database('define attribute code value string @regex("[a-z]+"); entity part, owns code;')
    with db.transaction("write") as tx:
        tx.query('insert $p isa part, has code "ok";')
        with pytest.raises(WriteError):
            tx.query('insert $p isa part, has code "fine"; insert $q isa part, has code "7";')
        tx.commit()
    assert ask(db, "match $p isa part, has code $c; select $c;") == [("ok",)]


def test_input_rows_are_written_once(people, monkeypatch):
    """A write stage fixes its input rows in one table."""
    from knotwork.operators import write

    seen, cut = [], write.cut
    monkeypatch.setattr(write, "cut", lambda df: seen.append(df.columns) or cut(df))
    with people.transaction("write") as tx:
        tx.query("match $p isa person, has name $n; delete $p;")
        assert sum("#m" in c or "#n" in c for c in seen) == 1
