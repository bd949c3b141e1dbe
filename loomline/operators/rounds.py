"""Discovery that learns: every round tries sites, and the next round knows the outcomes.

A round takes what its searches found, leaves out sites whose last attempt failed and
those the model of all outcomes so far expects to fail, tries the first few of every
country, remembers how that went and registers the brands that worked. Each of these is
one job over all countries; a round's tables are written before the next one starts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from loomline.operators.candidates import as_brands, plan_candidates
from loomline.operators.outcomes import remember, score_domains, train_outcome_model
from loomline.operators.registry import register_new
from loomline.staging import stage


@dataclass
class Discovery:
    """What is known after some rounds.

    attempts: round, country, domain, base_url, turn, probability, success, platform,
    new_brand. latest: the state per domain. registry: all brands.
    """

    attempts: DataFrame | None
    latest: DataFrame
    registry: DataFrame


def discovery_round(known: Discovery, found: DataFrame, attempt: Callable[[DataFrame], DataFrame],
                    number: int, max_new: int, learn: bool = True) -> Discovery:
    """One round over `found` (country, domain, base_url, position).

    `attempt` adds `success` (0 or 1) and `platform` to the sites to try. Without enough
    outcomes, or with `learn` off, nothing is left out for its prediction. An address found
    to work for several countries is registered for the first of them by code.
    """
    model = train_outcome_model(known.latest) if learn else None
    scored = stage(score_domains(model, found), "scored")
    planned = plan_candidates(scored.drop("probability"), known.latest, max_new,
                              scored.select("country", "domain", "probability"))
    tried = stage(attempt(planned).withColumn("round", F.lit(number)), "tried")
    working = as_brands(tried).drop("platform").join(
        tried.where("success = 1").select(
            "base_url", F.upper("country").alias("primary_country"), "platform"),
        ["base_url", "primary_country"])
    registry = stage(
        register_new(known.registry, working, ["primary_country", "platform", "name"]), "registry")
    added = (
        registry.join(known.registry.select("base_url"), "base_url", "left_anti")
        .select("base_url", F.col("primary_country").alias("_for"))
    )
    marked = tried.join(added, "base_url", "left").select(
        "round", "country", "domain", "base_url", "turn", "probability", "success", "platform",
        F.coalesce((F.col("success") == 1) & (F.upper("country") == F.col("_for")), F.lit(False))
        .alias("new_brand"),
    )
    latest = stage(remember(known.latest, tried, F.lit(number)), "latest")
    attempts = marked if known.attempts is None else known.attempts.unionByName(marked)
    return Discovery(stage(attempts, "attempts"), latest, registry)


def discover_and_learn(known: Discovery, searches: list[DataFrame],
                       attempt: Callable[[DataFrame], DataFrame], max_new: int,
                       learn: bool = True) -> Discovery:
    """A round for each of `searches`, the sites its searches found, in turn."""
    for number, found in enumerate(searches, 1):
        known = discovery_round(known, found, attempt, number, max_new, learn)
    return known
