import itertools

from ferial.operators import rejects
from ferial.operators.rejects import CALENDAR, free_path, judge, least_edits, parse_records, split_good_and_bad

OK = '2031-01-02,A Day,,Ps 1,Ps 2'


def reason(s):
    v = judge([s], CALENDAR)[0]
    return v.reason, v.field


def test_reasons():
    assert reason(OK) == (None, None)
    assert reason(OK + ",") == (None, None)
    assert reason('" 2031-01-02 ","A ""B"" - PF (Red/Blue)<br>C", Collect of the Day: x Amen.,"a,\nb",c,[rubric] y<br>[source] z') == (None, None)
    assert reason(None) == ("columns", "row")
    assert reason("") == ("columns", "row")
    assert reason(OK + ",,") == ("columns", "row")
    assert reason('2031-01-02,A "Day",,x,y') == ("quoting", "row")
    assert reason('2031-01-02,"A" b,,x,y,z,z') == ("quoting", "row")
    # a blank outside the quotes is an ordinary character: the field is not opened, or goes on after the closing quote
    assert reason('2031-01-02, "A",,x,y') == reason('2031-01-02,"A" ,,x,y') == ("quoting", "row")
    assert reason('2031-01-02,\x0bA,,x,y') == reason('2031-01-02,"A\x1c",,x,y') == ("value", "name")
    assert reason("2031-02-29,A,,x,y") == ("value", "cal_date")
    assert reason("2032-02-29,A,,x,y") == (None, None)
    for bad in ("", "- A", "A - PF - HD", "A (red)", "A [n]", "A<br>", "A (Red) - PF", "A\x07", "A�"):
        assert reason(f"2031-01-02,{bad},bad,x,y,bad") == ("value", "name"), bad
    assert reason("2031-01-02,A,Collect of the day: x Amen.,x,y") == ("value", "eucharist")
    for bad in ("[note] x", "[rubric]x", "[rubric]  x", "[rubric] ", "[rubric] x<br>y", "[rubric] x<br>"):
        assert reason(f"2031-01-02,A,,x,y,{bad}") == ("value", "extra"), bad
    assert reason("2031-01-02,A,,x,y,  ") == (None, None)


def apply_edits(s, edits):
    gaps, gone = [""] * (len(s) + 1), set()
    for e in edits:
        op, at = e.split("@")
        if op.startswith("insert"):
            gaps[int(at)] += op[7]
        else:
            assert s[int(at)] == op[7]
            gone.add(int(at))
    return "".join(g + (c if i not in gone else "") for i, (g, c) in enumerate(zip(gaps, s + " ")))[:-1]


def fits(s, least=2, most=3):
    fields = free_path(s)
    return fields is not None and least <= len(fields) <= most


def test_edits_repair_and_the_cost_states_the_reason():
    records = ["".join(x) for n in range(7) for x in itertools.product('",a ', repeat=n)]
    for s, (cost, edits) in zip(records, least_edits(records, 2, 3)):
        assert fits(apply_edits(s, edits)), (s, edits)
        assert (free_path(s) is None) == (cost >= rejects._QUOTING), (s, edits)
        assert fits(s) == (cost == 0) == (not edits), (s, edits)


def test_delimiter_edits_leave_valid_values():
    edits = lambda s: judge([s], CALENDAR)[0].edits
    assert edits("2031-01-02,Ulf, warden,Collect of the Day: x Amen.,a,b,") == "delete ,@14"
    assert edits("2031-01-02,A - HD,Collect of the Day: x; y, Amen.,a,b,[rubric] z") == "delete ,@42"
    assert edits("2031-01-02,A,Collect of the Day: x Amen.") in ("insert ,@13; insert ,@13", "insert ,@41; insert ,@41")
    assert edits("") == "; ".join(["insert ,@0"] * 4)
    for s in ("a,b", "a,b,c,d,e,f,g,h", "", ",,,,,,,,,", '"x,y",z'):
        assert fits(apply_edits(s, edits(s).split("; ")), 5, 6), s


def one_edit(s):
    for i in range(len(s) + 1):
        yield s[:i] + '"' + s[i:]
        yield s[:i] + "," + s[i:]
        if i < len(s) and s[i] in '",':
            yield s[:i] + s[i + 1 :]


def test_edits_are_fewest_where_quoting_holds():
    records = [s for n in range(6) for s in map("".join, itertools.product('",a', repeat=n)) if free_path(s) is not None]
    for s, (_, edits) in zip(records, least_edits(records, 2, 3)):
        assert all("," in e for e in edits)
        if len(edits) > 1 and not any('"' in x for x in s):
            assert not any(fits(x) for x in one_edit(s)), (s, edits)


def test_the_cost_of_the_program_decides(monkeypatch):
    bad = ['2031-01-02,A "Day",,x,y', "2031-01-02,A", OK + ",,"]
    assert [v.reason for v in judge(bad, CALENDAR)] == ["quoting", "columns", "columns"]
    monkeypatch.setattr(rejects, "least_edits", lambda block, least, most: [(rejects._QUOTING, []) for _ in block])
    assert [v.reason for v in judge(bad, CALENDAR)] == ["quoting"] * 3


def test_long_and_table_edges(spark):
    long = '2031-01-02,A,,"' + 'x,""' * 20000 + '",y'
    rows = [(1, OK, "r"), (1, OK, "r"), (2, None, "r"), (3, long, "r"), (4, long[:-3], "r"), (None, "x", "r")]
    df = spark.createDataFrame(rows, "line_id int, raw_line string, reason string")
    by = {r.line_id: r.reason for r in parse_records(df, "line_id", "raw_line").collect()}
    assert by == {1: None, 2: "columns", 3: None, 4: "quoting", None: "columns"}
    good, bad = split_good_and_bad(df, "line_id", "raw_line")
    assert (good.count(), bad.count()) == (2, 3)
    assert parse_records(df.limit(0), "line_id", "raw_line").count() == 0
