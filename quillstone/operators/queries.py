"""What users ask, as a table of queries: terms, specifications, stages, aliases and anchors, and what these select.

Queries are rows; the registries that extend them - terms that tell a specification, aliases of a term - are tables too,
and join on shared grams of text (``select.containing``), so neither side has to be small.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import extract
from quillstone.functions.text import collapse
from quillstone.operators.select import Scope, containing, distinct_words

# The sum of weights from which a specification is inferred, and how many terms of each kind a search uses.
INFERRED = 2.0
MOST_TOKENS, MOST_PHRASES, MOST_ALIASES, MOST_ANCHORS = 6, 2, 6, 6


def normalised(queries: DataFrame, query: str = "query") -> DataFrame:
    """``queries`` with normal (on one line), tokens, specs, stages, stage_filters, aliases, anchors and variants of ``query``."""
    rows = queries.withColumn("normal", collapse(query))
    return rows.withColumns(
        {
            "tokens": extract.query_tokens("normal"),
            "specs": extract.query_specs("normal"),
            "stages": extract.query_stages("normal"),
            "stage_filters": extract.query_stage_filters("normal"),
            "aliases": extract.query_aliases("normal"),
            "anchors": extract.query_anchors("normal"),
            "variants": extract.query_variants("normal"),
        }
    )


def inferred_specs(queries: DataFrame, registry: DataFrame, least: float = INFERRED) -> DataFrame:
    """query_id, spec_no and score: the specifications that a query's words speak for, unless it names one itself.

    ``queries`` are of ``normalised``; ``registry`` has spec_no, term and score. A term counts once for a query if one of
    the query's variants holds it.
    """
    open_ones = queries.filter(F.size("specs") == 0).select("query_id", F.explode("variants").alias("variant"))
    held = containing(open_ones.select(F.col("variant").alias("text")), registry.select("term"))
    terms = open_ones.join(held.withColumnRenamed("text", "variant"), "variant").select("query_id", "term").distinct()
    scored = terms.join(registry, "term").groupBy("query_id", "spec_no").agg(F.sum("score").alias("score"))
    # Scores have three decimals; a sum is compared without its binary noise.
    return scored.withColumn("score", F.round("score", 3)).filter(F.col("score") >= least)


def known_aliases(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """query_id and alias: of every alias group of which a query holds a member, all members; ``aliases`` has canonical and alias, rows with nulls count for nothing."""
    aliases = aliases.filter("canonical is not null and alias is not null")
    members = aliases.select("canonical", "alias").unionByName(aliases.select("canonical", F.col("canonical").alias("alias"))).distinct()
    low = queries.select("query_id", F.lower("normal").alias("text"))
    held = containing(low.select("text"), members.select(F.lower("alias").alias("term")))
    groups = low.join(held, "text").join(members.select("canonical", F.lower("alias").alias("term")), "term").select("query_id", "canonical").distinct()
    return groups.join(members, "canonical").select("query_id", "alias").distinct()


@dataclass(frozen=True)
class Asked:
    """One analysed query, from a row of ``normalised``."""

    normal: str
    tokens: Sequence[str] = ()
    specs: Sequence[str] = ()
    stages: Sequence[str] = ()
    stage_filters: Sequence[str] = ()
    aliases: Sequence[str] = ()
    anchors: Sequence[str] = ()
    inferred: Sequence[str] = field(default_factory=tuple)

    @classmethod
    def of(cls, queries: DataFrame, query: str, inferred: Sequence[str] = ()) -> Asked:
        """The analysis of one query; a row goes through the driver."""
        row = normalised(queries.sparkSession.createDataFrame([(query,)], "query string")).first()
        return cls(*(row[c] for c in ("normal", "tokens", "specs", "stages", "stage_filters", "aliases", "anchors")), inferred)

    def terms(self) -> list[str]:
        """What a hop searches for: tokens and anchors, each once regardless of case."""
        return list({t.lower(): t for t in reversed(distinct_words([*self.tokens, *self.anchors]))}.values())[::-1]

    def condition(self, scope: Scope | None = None) -> Column:
        """The records that a search considers: those that hold a phrase, token, alias or anchor of the query or hint at its
        specification or stage; within the specifications it names, its stages, and ``scope``."""
        phrases = [a for a in self.anchors if len(a.split()) >= 4][:MOST_PHRASES]
        if not phrases and len(self.normal.split()) >= 4:
            phrases = [self.normal]
        anchors = list(self.anchors[:MOST_ANCHORS])
        soft = list(self.specs or self.inferred)
        hints = [v for s in soft for v in ((s, f"{s[:2]}.{s[2:]}", f"TS {s[:2]}.{s[2:]}") if len(s) == 5 and s.isdigit() else (s,))]

        def held(columns: Sequence[str], terms: Sequence[str]) -> list[Column]:
            return [F.contains(F.lower(c), F.lit(t.lower())) for c in columns for t in distinct_words(terms)]

        def listed(columns: Sequence[str], terms: Sequence[str]) -> list[Column]:
            return [F.contains(F.lower(F.array_join(c, "\n")), F.lit(t.lower())) for c in columns for t in distinct_words(terms)]

        found = [
            *held(["clause_title", "row_header", "text"], phrases),
            *held(["text"], [*self.tokens[:MOST_TOKENS], *self.aliases[:MOST_ALIASES], *hints]),
            *held(["clause_title", "row_header"], anchors),
            *listed(["anchor_terms", "ie_names", "message_names", "procedure_names"], [*self.aliases, *anchors]),
            *[F.col("spec_no") == s for s in soft],
            *[F.col("stage_hint") == s for s in self.stages],
        ]
        tests = [reduce(Column.__or__, found, F.lit(False)) if found else F.lit(True)]
        if self.specs:
            tests.append(F.col("spec_no").isin(list(self.specs)))
        if self.stage_filters:
            tests.append(F.col("stage_hint").isin(list(self.stage_filters)))
        return reduce(Column.__and__, tests, (scope or Scope()).condition())
