"""Temporal triples with known patterns, for scale and sensitivity checks.

Every entity has a class and an organisation in every snapshot. Class 0 works at
organisation 0 throughout (a persistent rule), class 1 at organisation 1 in early
snapshots only (a transient rule); everything else is spread at random.
"""

from __future__ import annotations

from factdrift.sources.ntriples import IRI
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vocabulary of the planted facts and rules.
NAMESPACE = "http://example.org/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
WORKS_AT = f"{NAMESPACE}worksAt"
# Antecedent and consequent.
PERSISTENT_RULE = (f"{RDF_TYPE}={NAMESPACE}Class0", f"{WORKS_AT}={NAMESPACE}Org0")
TRANSIENT_RULE = (f"{RDF_TYPE}={NAMESPACE}Class1", f"{WORKS_AT}={NAMESPACE}Org1")


def _resource(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(NAMESPACE + prefix), number.cast("string"))


def planted_triples(
    entities: DataFrame,
    n_snapshots: int = 4,
    n_classes: int = 5,
    n_orgs: int = 5,
    transient_until: int = 2,
    start_year: int = 2020,
    seed: int = 42,
) -> DataFrame:
    """Two triples per entity and yearly snapshot, for numbers in column ``entity``.

    The random organisation is a hash of entity, snapshot and seed: the same on
    every run and in every partitioning.
    """
    entity, snapshot = F.col("entity"), F.col("_s")
    digest = F.md5(F.concat_ws("/", entity, snapshot, F.lit(seed)).cast("binary"))
    random_org = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n_orgs
    group = F.pmod(entity, F.lit(n_classes))
    org = (
        F.when(group == 0, F.lit(0))
        .when((group == 1) & (snapshot < transient_until), F.lit(1))
        .otherwise(random_org)
    )
    facts = F.array(
        F.struct(F.lit(RDF_TYPE).alias("predicate"), _resource("Class", group).alias("object")),
        F.struct(F.lit(WORKS_AT).alias("predicate"), _resource("Org", org).alias("object")),
    )
    year = F.col("_s") + start_year
    return (
        entities.select("entity", F.explode(F.sequence(F.lit(0), F.lit(n_snapshots - 1))).alias("_s"))
        .select("entity", "_s", F.explode(facts).alias("_fact"))
        .select(
            _resource("entity", entity).alias("subject"),
            "_fact.predicate",
            "_fact.object",
            F.lit(IRI).alias("object_kind"),
            F.lit(None).cast("string").alias("datatype"),
            F.lit(None).cast("string").alias("language"),
            year.cast("string").alias("snapshot"),
            F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("snapshot_ts"),
        )
    )
