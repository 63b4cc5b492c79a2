from hypothesis import given
from hypothesis import strategies as st

from ferial.operators.packed import explode_packed, split_packed


def pieces(s):
    return [p for _, p, _ in split_packed(s)]


def test_dividers_quotes_and_brackets():
    assert pieces("Ps 1, 2; (Tol 5:8-17);  ; Coll 307/4\nOr\nX<br />\nY|Z • W；V / U\tT") == ["Ps 1, 2", "(Tol 5:8-17)", "Coll 307/4", "X", "Y", "Z", "W", "V", "U", "T"]
    assert pieces('"Ps ""9:5; 7"""; a') == ['Ps "9:5; 7"', "a"]
    assert pieces("'St X's / Y' / Feast of the Day (Green/Red)") == ["St X's / Y", "Feast of the Day (Green/Red)"]
    assert pieces("‘a; don’t’ | «b; c» ; „d; e“ ; ‘f’ g") == ["a; don’t", "b; c", "d; e", "‘f’ g"]
    assert pieces("“Lauds | a”；the “b” reading") == ["Lauds | a", "the “b” reading"]
    assert pieces("A &amp; B, Wardens - PF<BR />C&ndash;end;D") == ["A &amp; B, Wardens - PF", "C&ndash;end", "D"]
    assert pieces(None) == pieces("") == pieces(" \n ") == pieces("Or") == pieces('""') == []
    assert pieces("'Or'; Orb") == ["Or", "Orb"]


def test_malformed_marks_backtrack():
    assert split_packed('"a; b') == [(1, '"a', "malformed_quote"), (2, "b", "")]
    assert split_packed("(a; b") == [(1, "(a", "malformed_bracket"), (2, "b", "")]
    assert split_packed('"a" b; c') == [(1, '"a" b', "malformed_quote"), (2, "c", "")]
    assert len(split_packed("(" * 20000 + ";" + "'" * 300)) == 2


@given(st.lists(st.text(alphabet="abPs 1:-,", min_size=1).map(str.strip).filter(lambda s: s and s.lower() != "or"), min_size=1), st.sampled_from([";", " | ", "<br>", "\n", " / ", "；"]))
def test_round_trip(values, divider):
    assert pieces(divider.join(values)) == values
    if '"' not in divider:
        assert pieces(divider.join(f'"{v};{v}"' for v in values)) == [f"{v};{v}" for v in values]


def test_table_edges(spark):
    df = spark.createDataFrame([(1, "a;b", None, "f"), (1, "a;b", None, "f"), (2, None, "", "f"), (None, "c", "Or", "f")], "row_id int, name string, morning string, field string")
    rows = sorted((r.row_id or 0, r.field, r.pos, r.piece) for r in explode_packed(df, "row_id", ["name", "morning"]).collect())
    assert rows == [(0, "name", 1, "c"), (1, "name", 1, "a"), (1, "name", 2, "b")]
    assert explode_packed(df.limit(0), "row_id", ["name"]).count() == 0
