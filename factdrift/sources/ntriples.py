"""Distributed N-Triples reading and writing.

Every line is matched once: one ``regexp_replace`` lays the captured terms out in
a row of fields, ``split`` takes them apart. A line of three IRIs is cut at its ``>``
instead. Both arrays pass through a generator, so the optimizer cannot copy the work
into the filter above it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.literals import escape_literal, unescape_literal

IRI = "iri"
BLANK = "blank"
LITERAL = "literal"

TRIPLE_SCHEMA = T.StructType(
    [
        T.StructField("subject", T.StringType(), False),
        T.StructField("predicate", T.StringType(), False),
        T.StructField("object", T.StringType(), False),
        T.StructField("object_kind", T.StringType(), False),
        T.StructField("datatype", T.StringType(), True),
        T.StructField("language", T.StringType(), True),
    ]
)

# Fields are separated by U+0001, which no term but a literal may hold; the
# literal therefore comes last and is never split.
_SEP = "\x01"
_IRI = rf"<([^>{_SEP}]++)>"
_BLANK = rf'(_:[^\s<>"{_SEP}]+)'
# Possessive and unrolled: constant stack depth, however long the literal is.
_HEX = "[0-9A-Fa-f]"
_ESCAPE = rf"\\(?:u{_HEX}{{4}}|U00(?:0{_HEX}|10){_HEX}{{4}}|[^uU])"
_LITERAL = rf'"([^"\\]*+(?:{_ESCAPE}[^"\\]*+)*+)"'
_SUFFIX = rf"(?:\^\^{_IRI}|@([A-Za-z]++(?:-[A-Za-z0-9]++)*+))?"
_STATEMENT = (
    rf"\A\s*(?:{_IRI}|{_BLANK})\s*{_IRI}\s*"
    rf"(?:{_IRI}|{_BLANK}|{_LITERAL}{_SUFFIX})\s*\.\s*(?:#.*)?\z"
)
# The second branch matches any other line and leaves all fields empty.
_LINE = rf"(?s){_STATEMENT}|\A.*\z"
_FIELDS = _SEP.join(["$1$2", "$3", "$4", "$5", "$7", "$8", "$6"])
_BLANK_OR_COMMENT = r"(?s)\A\s*(?:#.*)?\z"

MODES = ("permissive", "failfast")

# What stands before each term of ``<a> <b> <c> .``, the commonest line, cut at its ``>``.
_PLAIN_STARTS = ("<", " <", " <")


def _is_plain(line: str, cut: str) -> Column:
    """Whether a line is three IRIs with one space between, so that cutting it replaces the match."""
    pieces = [F.col(cut).getItem(i) for i in range(len(_PLAIN_STARTS))]
    plain = (F.size(cut) == 4) & (F.col(cut).getItem(3) == " .") & ~F.contains(F.col(line), F.lit(_SEP))
    for piece, start in zip(pieces, _PLAIN_STARTS):
        plain = plain & piece.startswith(start) & (piece != start)
    return plain


def _plain_fields(cut: str) -> Column:
    """The fields that the match of a plain line has."""
    terms = [F.substr(F.col(cut).getItem(i), F.lit(len(s) + 1)) for i, s in enumerate(_PLAIN_STARTS)]
    return F.array(*terms, *([F.lit("")] * 4))


def parse_lines(
    lines: DataFrame, mode: str = "permissive", observation: Observation | None = None
) -> DataFrame:
    """Turn lines (column ``value``) into triples; other columns are kept.

    Comments and blank lines are skipped. A malformed line is skipped too when
    ``mode`` is ``permissive`` and fails the job when it is ``failfast``.

    An ``observation`` counts ``n_lines``, ``n_triples``, ``n_skipped`` (blank lines and
    comments) and ``n_malformed`` in the pass that parses; it has them once the first
    action on the triples has run.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    kept = [name for name in lines.columns if name != "value"]
    cut = lines.select("value", *kept, F.explode(F.array(F.split("value", ">", 5))).alias("_cut"))
    matches = F.split(F.regexp_replace("value", F.lit(_LINE), F.lit(_FIELDS)), _SEP, 7)
    fields = F.when(_is_plain("value", "_cut"), _plain_fields("_cut")).otherwise(matches)
    source = ["value"] if mode == "failfast" or observation is not None else []
    matched = cut.select(*source, *kept, F.explode(F.array(fields)).alias("_f"))

    def field(position: int) -> Column:
        return F.col("_f").getItem(position)

    is_statement = field(1) != ""
    if observation is not None:
        # Only lines that are no statements are looked at again.
        skipped = F.when(is_statement, False).otherwise(F.col("value").rlike(_BLANK_OR_COMMENT))
        matched = matched.observe(
            observation,
            F.count("*").alias("n_lines"),
            F.count_if(is_statement).alias("n_triples"),
            F.count_if(skipped).alias("n_skipped"),
            F.count_if(~is_statement & ~skipped).alias("n_malformed"),
        )
    if mode == "failfast":
        is_statement = (
            F.when(is_statement, True)
            .when(F.col("value").rlike(_BLANK_OR_COMMENT), False)
            .otherwise(
                F.raise_error(F.concat(F.lit("Malformed N-Triples line: "), "value")).cast("boolean")
            )
        )
    iri, blank = field(2), field(3)
    return matched.where(is_statement).select(
        field(0).alias("subject"),
        field(1).alias("predicate"),
        F.when(iri != "", iri)
        .when(blank != "", blank)
        .otherwise(unescape_literal(field(6)))
        .alias("object"),
        F.when(iri != "", IRI).when(blank != "", BLANK).otherwise(LITERAL).alias("object_kind"),
        F.nullif(field(4), F.lit("")).alias("datatype"),
        F.nullif(field(5), F.lit("")).alias("language"),
        *kept,
    )


def read_ntriples(
    spark: SparkSession,
    path: str | Sequence[str],
    mode: str = "permissive",
    observation: Observation | None = None,
) -> DataFrame:
    """Read one N-Triples file, a directory, a glob or a list of these.

    Compressed files are read in place; bzip2 is split over tasks, gzip is not.
    """
    paths = [str(path)] if not isinstance(path, (list, tuple)) else [str(p) for p in path]
    return parse_lines(spark.read.text(paths), mode, observation)


def render_lines(triples: DataFrame) -> DataFrame:
    """Write triples as N-Triples lines in column ``value``; others are kept."""

    def resource(name: str) -> Column:
        term = F.col(name)
        return F.when(term.startswith("_:"), term).otherwise(F.concat(F.lit("<"), term, F.lit(">")))

    literal = F.concat(
        F.lit('"'),
        escape_literal(F.col("object")),
        F.lit('"'),
        F.coalesce(
            F.concat(F.lit("^^<"), F.col("datatype"), F.lit(">")),
            F.concat(F.lit("@"), F.col("language")),
            F.lit(""),
        ),
    )
    kept = [name for name in triples.columns if name not in TRIPLE_SCHEMA.names]
    return triples.select(
        F.concat_ws(
            " ",
            resource("subject"),
            resource("predicate"),
            F.when(F.col("object_kind") == LITERAL, literal).otherwise(resource("object")),
            F.lit("."),
        ).alias("value"),
        *kept,
    )
