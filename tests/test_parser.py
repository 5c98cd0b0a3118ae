"""The query language: trees, precedence, round trips, normalisation."""

import pytest

from tessera.functions.normalise import InvalidQuery, normalise, stem
from tessera.plans.ast import Binary, Distance, Free, Not, Phrase, Relation, Wildcard, Zone
from tessera.plans.parser import ParseError, parse


def free(*t):
    return Free(tuple(t))


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        (" hello     world ", free("hello", "world")),
        (" #DIST , 3 , pumpkin,pie ", Distance(3, "pumpkin", "pie")),
        (" #DIST 3 pumpkin pie ", Distance(3, "pumpkin", "pie")),
        ("borisss, AND, #DIST,4,boris ,johnson,", Binary("AND", free("borisss"), Distance(4, "boris", "johnson"))),
        ("borisss, AND, #DIST,4,boris ,johnson,OR,#CITATION,boris", Binary("AND", free("borisss"), Binary("OR", Distance(4, "boris", "johnson"), Zone("Citation", free("boris"))))),
        ("pumpkin pie OR pumpkin AND patch", Binary("AND", Binary("OR", free("pumpkin", "pie"), free("pumpkin")), free("patch"))),
        ("pumpkin pie AND pumpkin OR patch", Binary("AND", free("pumpkin", "pie"), Binary("OR", free("pumpkin"), free("patch")))),
        ("#CATEGORY BOR AND #CATEGORY TOR", Zone("Category", Binary("AND", free("BOR"), Zone("Category", free("TOR"))))),
        ("#DIST 3 BOR AND", Distance(3, "BOR", "AND")),
        ("#LINKSTO 1337 3 NOT #CATEGORY  #DIST 3 BOR AND", Relation(1337, 3, Not(Zone("Category", Distance(3, "BOR", "AND"))))),
        ("#distobox #LINKSTO 1337 3 NOT april*may AND #DIST 3 BOR AND", Zone("distobox", Relation(1337, 3, Not(Binary("AND", Wildcard("april", "may"), Distance(3, "BOR", "AND")))))),
        ("NOT ca*", Not(Wildcard("ca", ""))),
        (" p * kin           ", Wildcard("p", "kin")),
        ("*kin", Wildcard("", "kin")),
        ("p*", Wildcard("p", "")),
        (' " The  , big ,,,, whale  , ate              a ,tuna     sandwich. " ', Phrase(("The", "big", "whale", "ate", "a", "tuna", "sandwich"))),
        (" #LINKSTO, 173302 ,1 ", Relation(173302, 1)),
        (" #LINKSTO  69  3 ", Relation(69, 3)),
        ("#LINKSTO, 142, 255", Relation(142, 255)),
        ("#LINKSTO , 2222 , 0 , Donald OR Trump  ", Relation(2222, 0, Binary("OR", free("Donald"), free("Trump")))),
        ("Boris,AND,Johnson,AND,#CATEGORY, Prime Ministers of the United Kingdom", Binary("AND", free("Boris"), Binary("AND", free("Johnson"), Zone("Category", free("Prime", "Ministers", "of", "the", "United", "Kingdom"))))),
        ("x ANDROID y", free("x", "ANDROID", "y")),
        ("#TITLEx foo", Zone("Title", free("x", "foo"))),
        ("#LINKSTO foo", Zone("linksto", free("foo"))),
        ("_a%b", free("a%b")),
    ],
)
def test_trees(text, tree):
    assert parse(text) == tree


def test_empty_is_an_error():
    with pytest.raises(ParseError):
        parse("")


@pytest.mark.parametrize(
    "tree",
    [free("a", "b"), Phrase(("a", "b")), Distance(2, "a", "b"), Wildcard("a", "b"), Zone("Title", free("a")), Zone("box", free("a")), Relation(3, 2), Relation(3, 2, free("a")), Not(free("a")), Binary("AND", free("a"), Not(free("b"))), Binary("OR", Phrase(("a", "b")), Wildcard("", "c"))],
)
def test_round_trip(tree):
    assert parse(str(tree)) == tree


def test_normalise():
    assert normalise(free("bOrIs")) == free("bori")
    assert normalise(free("BarCeLOna", "snickers")) == free("barcelona", "snicker")
    assert normalise(free("the")) == free()
    assert normalise(free("bars")) == free("bar")
    assert normalise(Distance(2, "worm", "bars")) == Distance(2, "worm", "bar")
    assert normalise(Phrase(("the", "bikes"))) == free("bike")
    assert normalise(Phrase(("april",))) == free("april")
    assert normalise(Wildcard("the", "bArs")) == Wildcard("the", "bars")
    with pytest.raises(InvalidQuery):
        normalise(Distance(2, "the", "bars"))
    assert normalise(Relation(1, 2, Distance(2, "the", "x"))) == Relation(1, 2, Distance(2, "the", "x"))


@pytest.mark.parametrize(("word", "root"), [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("adjustable", "adjust"), ("controlling", "control"), ("rate", "rate"), ("sky", "sky")])
def test_stem(word, root):
    assert stem(word) == root
