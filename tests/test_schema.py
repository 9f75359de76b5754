import pytest

from knotwork.errors import InferenceError, SchemaError
from knotwork.plans.infer import Env, infer
from knotwork.plans.parser import parse
from knotwork.schema import Catalog

BASE = """define attribute name value string; attribute nick sub name; attribute age value integer @range(0..150);
entity animal @abstract, owns age; entity cat sub animal, plays ownership:pet; entity dog sub animal, plays ownership:pet, plays walk:dog;
entity person, owns age, plays ownership:owner;
relation ownership, relates pet, relates owner; relation walk sub ownership, relates dog as pet;"""


@pytest.fixture
def catalog():
    return Catalog.of(BASE.replace("attribute name value string; attribute nick sub name;", "attribute label @abstract, value string; attribute name sub label; attribute nick sub label;").replace("owns age;", "owns age, owns label;", 1))


def test_text_round_trip(catalog):
    assert Catalog.of(catalog.text()).text() == catalog.text()


def test_hierarchy(catalog):
    assert set(catalog.subs("animal")) == {"animal", "cat", "dog"}
    assert set(catalog.concrete("animal")) == {"cat", "dog"}
    assert catalog.value_type("nick") == "string"
    assert list(catalog.relates("walk")) == ["walk:dog", "ownership:owner"]  # pet is specialised and hidden
    assert catalog.roles_called("walk", "pet") == ["walk:dog"]
    assert set(catalog.owns("cat")) == {"age", "label"}


def test_define_is_idempotent(catalog):
    before = catalog.text()
    catalog.apply(parse("define entity cat sub animal; attribute age value integer @range(0..150);"))
    assert catalog.text() == before


@pytest.mark.parametrize(
    "text",
    [
        "define relation r;", "define attribute a;", "define entity cat sub person;", "define attribute age value string;", "define entity x, owns nothing;", "define entity x, plays ownership:nobody;",
        "define entity animal sub cat;", "define attribute d value double; entity p2, owns d @key;", "define entity person, owns age @key @unique;", "define relation r, relates a @card(2..1);",
        "define attribute sub-age sub age;", "define entity e2 @independent;", 'define attribute z value integer @regex("a");',
    ],
)
def test_wrong_definitions_change_nothing(catalog, text):
    before = catalog.text()
    with pytest.raises(SchemaError):
        catalog.apply(parse(text))
    assert catalog.text() == before


def test_redefine_changes_one_thing(catalog):
    catalog.apply(parse("redefine attribute age value integer @range(0..200);"))
    assert catalog.types["age"].value_notes.range == (0, 200)
    with pytest.raises(SchemaError):
        catalog.apply(parse("redefine attribute age value integer @range(0..200);"))
    with pytest.raises(SchemaError):
        catalog.apply(parse("redefine attribute age value integer @range(0..10); entity cat sub person;"))


def test_undefine(catalog):
    catalog.apply(parse("undefine owns age from person; @range from age value integer;"))
    assert "age" not in catalog.types["person"].owns and catalog.types["age"].value_notes.range is None
    with pytest.raises(SchemaError):
        catalog.apply(parse("undefine animal;"))
    with pytest.raises(SchemaError):
        catalog.apply(parse("undefine owns age from person;"))
    catalog.apply(parse("undefine as pet from walk relates dog;"))
    assert set(catalog.relates("walk")) == {"walk:dog", "ownership:pet", "ownership:owner"}


def test_functions_are_kept():
    c = Catalog.of("define entity a; fun f($x: a) -> integer: match $x isa a; return count;")
    assert "f" in Catalog.of(c.text()).functions
    c.apply(parse("undefine fun f;"))
    assert not c.functions


def types(catalog, text):
    return infer(catalog, parse("match " + text).stages[0].pattern.items, Env())


def test_inference(catalog):
    assert types(catalog, "$x isa animal;")["x"] == {"cat", "dog"}
    assert types(catalog, "ownership (pet: $x);")["x"] == {"cat", "dog"}
    assert types(catalog, "$r isa walk, links (pet: $x);")["x"] == {"dog"}
    assert types(catalog, "$x has nick $n;")["x"] == {"cat", "dog"}
    e = types(catalog, "$x has $a; $x isa cat;")
    assert e["a"] == {"age", "name", "nick"}
    e = types(catalog, "$x isa $t; $t plays walk:dog;")
    assert e["x"] == {"dog"}
    e = types(catalog, "{ $x isa cat; } or { $x isa person; }; $x has age $a;")
    assert e["x"] == {"cat", "person"}


@pytest.mark.parametrize("text", ["$x isa cat; $x isa dog;", "$x isa nothing;", "$x isa person, has nick $n;", "ownership (pet: $x); $x isa person;", "$x isa animal; $x isa! animal;"])
def test_inference_errors(catalog, text):
    with pytest.raises(InferenceError):
        types(catalog, text)
