"""Functions against values that their rules fix."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakequill.functions import dates as D
from lakequill.functions import json as J
from lakequill.functions import json_codec as C
from lakequill.functions import maths as M
from lakequill.functions import scalars as S
from lakequill.functions.printf import decode_unistr, sprintf


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


L = F.lit


def test_arithmetic(spark):
    assert one(spark, S.int_divide(L(7), L(2)), S.int_divide(L(-7), L(2)), S.int_divide(L(7), L(0)), S.modulo(L(-7), L(3)), S.modulo(L(7), L(0))) == (3, -3, None, -1, None)
    assert one(spark, S.shift_left(L(1), L(70)), S.shift_left(L(-8), L(-1)), S.shift_right(L(-1), L(64)), S.shift_left(L(3), L(2)), S.shift_right(L(1), L(-3))) == (0, -4, -1, 12, 8)
    assert one(spark, S.add(L(2**63 - 1), L(1).cast("bigint")), S.multiply(L(2**62), L(4).cast("bigint")), S.subtract(L(5), L(7))) == (2.0**63, 2.0**64, -2.0)
    assert one(spark, S.divide(L(1), L(0)), S.divide(L(7), L(2))) == (None, 3.5)


def test_casts_and_truth(spark):
    text = ["12abc", "  -7.9e1x", "abc", "", "99999999999999999999", "-99999999999999999999", "+5", "1e3"]
    got = one(spark, *[S.cast_integer(L(t)) for t in text])
    assert got == (12, -7, 0, 0, 2**63 - 1, -(2**63), 5, 1)
    assert one(spark, *[S.cast_real(L(t)) for t in text[:4]]) == (12.0, -79.0, 0.0, 0.0)
    assert one(spark, S.truth(L("0.0x")), S.truth(L("3 pigs")), S.truth(L("x")), S.cast_integer(L(None).cast("string"))) == (False, True, False, None)


@pytest.mark.parametrize("text,pattern,hit", [("abc", "a*", 1), ("abc", "A*", 0), ("abc", "a?c", 1), ("a[c", "a[[]c", 1), ("abc", "a[^b]c", 0), ("adc", "a[^b]c", 1), ("a]c", "a[]]c", 1), ("abc", "*[x-z]", 0), ("a\nc", "a?c", 1), ("a.c", "a.c", 1), ("abc", "a.c", 0), ("abc", "abc", 1), ("a", "[a", 0)])
def test_glob(spark, text, pattern, hit):
    assert one(spark, S.glob(L(text), pattern)) == (bool(hit),)


@pytest.mark.parametrize("text,pattern,escape,hit", [("ABC", "a%", "\\", 1), ("É", "é", "\\", 0), ("10%", "10x%", "x", 1), ("10a", "10x%", "x", 0), ("a_b", "a!_b", "!", 1), ("acb", "a!_b", "!", 0)])
def test_like(spark, text, pattern, escape, hit):
    assert one(spark, S.like(L(text), pattern, escape)) == (bool(hit),)


@pytest.mark.parametrize("start,length,want", [(2, None, "bcde"), (-2, None, "de"), (0, None, "abcde"), (0, 2, "a"), (2, 2, "bc"), (3, -2, "ab"), (-1, -2, "cd"), (-9, 6, "ab"), (9, 2, ""), (2, 0, ""), (1, -1, "")])
def test_substr(spark, start, length, want):
    assert one(spark, S.substr(L("abcde"), L(start), None if length is None else L(length))) == (want,)


def test_text_functions(spark):
    assert one(spark, S.ascii_upper(L("aé")), S.char(L(65), L(960), L(128512)), S.unicode(L("é")), S.unicode(L("")), S.hex_text(L("é"))) == ("Aé", "Aπ😀", 233, None, "C3A9")
    assert one(spark, S.unhex_text(L("4142")), S.unhex_text(L("4x")), S.quote_text(L("it's")), S.quote_blob(L(b"\x01\xff")), S.quote_number(L(None).cast("int"))) == (bytearray(b"AB"), None, "'it''s'", "X'01FF'", "NULL")
    assert one(spark, S.scalar_min(L(3), L(None).cast("int")), S.scalar_max(L(3), L(9)), S.concat_all(L("a"), L(None).cast("string"), L(1)), S.round_half_away(L(-2.5)), S.round_half_away(L(2.675), -3)) == (None, 9, "a1", -3.0, 3.0)
    assert one(spark, S.typeof(L(1), "int"), S.typeof(L(None).cast("double"), "double"), S.zeroblob(L(2)), F.length(S.random_blob(5))) == ("integer", "null", bytearray(b"\0\0"), 5)


def test_rows_compare_with_nulls(spark):
    n = L(None).cast("int")
    assert one(spark, S.row_less([L(1), n], [L(2), L(0)]), S.row_less([L(1), n], [L(1), L(0)]), S.row_equal([L(1), n], [L(2), L(0)]), S.row_less([L(1), L(2)], [L(1), L(2)], True)) == (True, None, False, True)


def test_maths(spark):
    assert one(spark, M.ln(L(0)), M.unary("sqrt", L(-1)), M.unary("acos", L(2)), M.log(L(100)), M.log(L(8), L(2)), M.mod(L(7), L(0)), M.trunc(L(-2.7))) == (None, None, None, 2.0, pytest.approx(3.0), None, -2.0)


@pytest.mark.parametrize("fmt,args,want", [
    ("%5d|%-5d|%05d|%+d", (42, 42, 42, 42), "   42|42   |00042|+42"), ("%,d", (1234567,), "1,234,567"), ("%x %X %o %#x", (255, 255, 8, 255), "ff FF 10 0xff"),
    ("%.2f %e %g", (3.14159, 12345.678, 0.0001), "3.14 1.234568e+04 0.0001"), ("%s %.2s %5s|%-5s|", ("ab", "abc", "x", "y"), "ab ab     x|y    |"), ("%c%3c", ("hey", "z"), "h  z"),
    ("%q %Q %w", ("it's", "it's", 'a"b'), "it''s 'it''s' a\"\"b"), ("%Q", (None,), "NULL"), ("%d%%", ("12x",), "12%"), ("%r %r %r %r", (1, 2, 11, 23), "1st 2nd 11th 23rd"), ("%*d", (6, 7), "     7"), ("%s", (), ""), ("%!g", (2.0,), "2.0"),
])
def test_printf(fmt, args, want):
    assert sprintf(fmt, *args) == want


def test_unistr():
    assert decode_unistr("a\\00e9\\+01F600\\u0041\\U00000042\\\\") == "aé😀AB\\"
    with pytest.raises(ValueError):
        decode_unistr("\\zz")


@pytest.mark.parametrize("text,mods,want", [
    ("2024-01-31", ["+1 month"], "2024-03-02 00:00:00"), ("2023-01-31", ["+1 month"], "2023-03-03 00:00:00"), ("2024-01-31", ["+1 month", "floor"], "2024-02-29 00:00:00"), ("2024-02-29", ["+1 year"], "2025-03-01 00:00:00"),
    ("2024-05-15 10:20:30", ["start of month", "+1 month", "-1 day"], "2024-05-31 00:00:00"), ("2024-05-15", ["weekday 3"], "2024-05-15 00:00:00"), ("2024-05-15", ["weekday 1"], "2024-05-20 00:00:00"),
    ("2024-05-15 23:59:59.5", ["+1.5 seconds"], "2024-05-16 00:00:01"), ("12:30", [], "2000-01-01 12:30:00"), ("2024-05-15T10:00:00Z", ["-00:30"], "2024-05-15 09:30:00"), ("2024-05-15 10:00+05:30", [], "2024-05-15 04:30:00"),
    ("2024-05-15", ["+0001-02-03 04:05"], "2025-07-18 04:05:00"), ("2024-13-01", [], None), ("2024-05-15", ["no such"], None), ("junk", [], None), ("2023-02-31", [], "2023-03-03 00:00:00"), ("1583-03-01", ["-1 day"], "1583-02-28 00:00:00"),
])
def test_dates(spark, text, mods, want):
    assert one(spark, D.datetime(D.moment(L(text), *mods))) == (want,)


def test_date_parts(spark):
    m = D.moment(L("2021-01-03 00:05:09.123"))
    assert one(spark, D.strftime("%f %G-%V %g %j %U %W %w %u %I%p %l %e %%", m), D.julianday(D.moment(L("2000-01-01 12:00"))), D.unixepoch(m), D.time(m.modified("subsec"))) == ("09.123 2020-53 20 003 01 00 0 7 12AM 12  3 %", 2451545.0, 1609632309, "00:05:09.123")
    assert one(spark, D.strftime("%Q", m), D.datetime(D.moment(L(1609632309), "auto", numeric=True)), D.date(D.moment(L(2451544.5), numeric=True))) == (None, "2021-01-03 00:05:09", "2000-01-01")
    a, b = D.moment(L("2023-02-15")), D.moment(L("2023-03-15 12:00"))
    assert one(spark, D.timediff(b, a), D.timediff(a, b)) == ("+0000-01-00 12:00:00.000", "-0000-01-00 12:00:00.000")


def test_json_codec_keeps_text():
    for t in ('{"a":1,"a":2.50,"b":[1e5,"\\u00e9",null,true]}', "[]", '"x"', "-0.10"):
        assert C.dump(C.parse(t)) == t == C.dump(C.from_blob(C.to_blob(C.parse(t))))
    assert C.dump(C.parse("{a:'x\\'y',/*c*/b:[0x10,.5,5.,+1,],}")) == '{"a":"x\'y","b":[16,0.5,5.0,1]}'
    assert C.error_position('{"a":}') == 6 and C.error_position("[1,2]") == 0
    for bad in ("", "[1", "{'a'}", "nul", "[1,,2]"):
        with pytest.raises(C.JsonError):
            C.parse(bad)
    with pytest.raises(C.JsonError):
        C.parse("[" * 1005 + "]" * 1005)


def test_json_edits():
    v = C.parse('{"a":[1,2,3],"b":{"c":4}}')
    assert C.dump(C.edit(v, "$.a[#]", C.Num("9"), True, False)) == '{"a":[1,2,3,9],"b":{"c":4}}'
    assert C.dump(C.edit(v, "$.a[#-1]", C.Num("9"), False, True)) == '{"a":[1,2,9],"b":{"c":4}}'
    assert C.dump(C.edit(v, "$.x.y", C.Num("9"), True, True)) == '{"a":[1,2,3],"b":{"c":4},"x":{"y":9}}'
    assert C.dump(C.remove(v, "$.a[1]")) == '{"a":[1,3],"b":{"c":4}}' and C.dump(C.remove(v, "$.zz")) == C.dump(v)
    assert C.dump(C.array_insert(v, "$.a[0]", C.Num("7"))) == '{"a":[7,1,2,3],"b":{"c":4}}'
    assert C.dump(C.patch(v, C.parse('{"a":null,"b":{"d":5}}'))) == '{"b":{"c":4,"d":5}}'
    assert C.arrow_path("a b") == '$."a b"' and C.arrow_path(2) == "$[2]" and C.arrow_path(-1) == "$[#-1]"
    with pytest.raises(C.JsonError):
        C.steps("a.b")
    assert C.pretty(C.parse('{"a":[1,{}]}')) == '{\n    "a": [\n        1,\n        {}\n    ]\n}'


def test_json_columns(spark):
    d = L('{"a":[1,2.5,"x"],"b":null}')
    assert one(spark, J.json_extract(d, "$.a[2]"), J.arrow(d, "a"), J.arrow_text(d, "b"), J.json_type(d, "$.b"), J.json_type(d, "$.z"), J.json_array_length(d, "$.a"), J.json_array_length(d)) == ("x", '[1,2.5,"x"]', None, "null", None, 3, 0)
    assert one(spark, J.json_valid(L("{a:1}")), J.json_valid(L("{a:1}"), 2), J.json_quote(L("q\"")), J.json_array(L(1), L(None).cast("string"), L("t"))) == (0, 1, '"q\\""', '[1,null,"t"]')
    rows = spark.range(1).select(F.inline(J.json_tree(L('{"a":[1,{"b c":2}]}')))).collect()
    assert [(r.fullkey, r.type, r.parent) for r in rows] == [("$", "object", None), ("$.a", "array", 0), ("$.a[0]", "integer", 1), ("$.a[1]", "object", 1), ('$.a[1]."b c"', "integer", 3)]
    each = spark.range(1).select(F.inline(J.json_each(L('{"a":[1,2]}'), "$.a"))).collect()
    assert [(r.key, r.value, r.fullkey, r.path) for r in each] == [("0", "1", "$.a[0]", "$.a"), ("1", "2", "$.a[1]", "$.a")]


def test_moment_of_timestamp(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 2, 29, 13, 5, 6, 789000),)], "t timestamp_ntz")
    assert df.select(D.datetime(D.of_timestamp(F.col("t"), "subsec"))).first()[0] == "2024-02-29 13:05:06.789"
