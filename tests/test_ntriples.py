import bz2

import pytest
from factdrift import parse_lines, read_ntriples, render_lines
from factdrift.functions import escape_literal, unescape_literal
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F
from samples import EX, XSD_DATE

S, P = f"<{EX}s>", f"<{EX}p>"


def parse(spark, *lines, mode="permissive"):
    return parse_lines(spark.createDataFrame([(line,) for line in lines], "value string"), mode).collect()


def test_kinds_of_objects(spark):
    iri, typed, tagged, blank = parse(
        spark,
        f"{S} {P} <{EX}o> .",
        f'{S} {P} "2023-01-15"^^<{XSD_DATE}> .',
        f'{S} {P} "Alice"@en-GB .',
        f"{S} {P} _:b0 .",
    )
    assert tuple(iri) == (f"{EX}s", f"{EX}p", f"{EX}o", "iri", None, None)
    assert tuple(typed) == (f"{EX}s", f"{EX}p", "2023-01-15", "literal", XSD_DATE, None)
    assert tuple(tagged) == (f"{EX}s", f"{EX}p", "Alice", "literal", None, "en-GB")
    assert tuple(blank) == (f"{EX}s", f"{EX}p", "_:b0", "blank", None, None)


def test_blank_subject_and_empty_literal(spark):
    (row,) = parse(spark, f'_:who {P} "" .')
    assert (row.subject, row.object, row.object_kind) == ("_:who", "", "literal")


def test_comments_blanks_and_malformed_lines_are_skipped(spark):
    lines = ["# comment", "", "   ", "garbage", f"{S} {P} .", f"<> {P} {S} .", f"{S} <> {S} .", f"{S} {P} <> ."]
    assert parse(spark, *lines) == []
    assert len(parse(spark, *lines, f"{S} {P} {S} .")) == 1


def test_grammar_without_spaces_and_with_comment(spark):
    rows = parse(spark, f"{S}{P}_:b0.", f'{S}{P}"x"@en.', f"\t{S} {P} {S} . # note")
    assert [r.object for r in rows] == ["_:b0", "x", f"{EX}s"]


def test_bad_escapes_are_malformed(spark):
    lines = [rf'{S} {P} "\u12" .', rf'{S} {P} "\uZZZZ" .', rf'{S} {P} "\U00110000" .']
    assert parse(spark, *lines) == []
    with pytest.raises(SparkRuntimeException, match="Malformed N-Triples line"):
        parse(spark, lines[0], mode="failfast")


def test_failfast(spark):
    assert len(parse(spark, "# comment", " ", f"{S} {P} {S} .", mode="failfast")) == 1
    with pytest.raises(SparkRuntimeException, match="Malformed N-Triples line: garbage"):
        parse(spark, f"{S} {P} {S} .", "garbage", mode="failfast")
    with pytest.raises(ValueError):
        parse(spark, mode="lenient")


@pytest.mark.parametrize(
    "escaped, text",
    [
        (r'line1\nline2 \"q\"', 'line1\nline2 "q"'),
        (r"tab\there \\ back", "tab\there \\ back"),
        (r"\'\b\f\r", "'\b\f\r"),
        (r"caf\u00e9 \u00E9", "café é"),
        (r"\uD83D\uDE00!", "\U0001f600!"),
        (r"\U0001F600!", "\U0001f600!"),
        (r"\x keeps \q", r"\x keeps \q"),
        (r"lone \uD83D half", r"lone \uD83D half"),
        (r"\\u0041", r"\u0041"),
        ("plain", "plain"),
        ("", ""),
    ],
)
def test_unescape(spark, escaped, text):
    df = spark.createDataFrame([(escaped,)], "e string")
    assert df.select(unescape_literal(F.col("e"))).first()[0] == text
    assert parse(spark, f'{S} {P} "{escaped}" .')[0].object == text


def test_long_literals(spark):
    text = 'a "quoted" line\n' * 20_000 + "\U0001f600" * 10_000
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(unescape_literal(escape_literal(F.col("t")))).first()[0] == text
    hexed = F.regexp_replace(F.hex(F.encode("t", "UTF-16BE")), "(.{4})", r"\\u$1")
    assert df.select(unescape_literal(hexed)).first()[0] == text
    assert len(parse(spark, f'{S} {P} "{"x" * 300_000}" .')[0].object) == 300_000


def test_separator_character_in_a_literal(spark):
    (row,) = parse(spark, f'{S} {P} "a\x01b\x01c"@en .')
    assert (row.object, row.language) == ("a\x01b\x01c", "en")


def test_files_globs_and_compression(spark, tmp_path):
    line = f"{S} {P} {S} .\n"
    (tmp_path / "a.nt").write_text(line)
    (tmp_path / "b.nt").write_text(line * 2)
    (tmp_path / "c.nt.bz2").write_bytes(bz2.compress((line * 4).encode()))
    assert read_ntriples(spark, str(tmp_path / "a.nt")).count() == 1
    assert read_ntriples(spark, str(tmp_path / "*.nt")).count() == 3
    assert read_ntriples(spark, [str(tmp_path / "a.nt"), str(tmp_path / "c.nt.bz2")]).count() == 5
    assert read_ntriples(spark, tmp_path).count() == 7


def test_render_and_parse_round_trip(spark):
    lines = [f"{S} {P} _:b0 .", rf'{S} {P} "a \"b\"\n\\"@en .', f'_:x {P} "1"^^<{EX}int> .', f"{S} {P} {S} ."]
    parsed = parse_lines(spark.createDataFrame([(line,) for line in lines], "value string"))
    assert [r.value for r in render_lines(parsed).collect()] == lines


def test_a_line_is_matched_once(spark):
    plan = parse_lines(spark.range(1).selectExpr("string(id) as value"))._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("regexp_replace") == 1
