"""Ablation: the root-cause ranking when one modality of the events is left out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FoldConfig, ScoreConfig
from ..operators import fold, graph, rca

#: The variants, and the beginnings of the commands that each leaves out.
VARIANTS = {"no-alerts": ["alert:"], "no-logs": ["log:"], "no-spans": ["span:"]}


def folded_actions(events: DataFrame) -> DataFrame:
    return graph.labelled(fold.scenarios(events, FoldConfig()))


def ablations(
    normal: DataFrame,
    abnormal: DataFrame,
    pods: DataFrame,
    alarms: DataFrame,
    config: ScoreConfig = ScoreConfig(),
    variants: dict[str, list[str]] = VARIANTS,
    acts_of: Callable[[DataFrame], DataFrame] = folded_actions,
) -> DataFrame:
    """(variant, ranked candidates): rca.root_causes for each variant, over the events that it keeps, folded anew.

    normal and abnormal are events; acts_of folds events into labelled actions; pods and alarms are as for rca.root_causes.
    Events keep their place in the source, so that pods are found by it in every variant. Without variants it raises.
    """

    def ranked(name: str, prefixes: list[str]) -> DataFrame:
        left, right = (acts_of(fold.drop_commands(events, prefixes)) for events in (normal, abnormal))
        return rca.root_causes(left, right, pods, alarms, config).withColumn("variant", F.lit(name))

    return reduce(DataFrame.unionByName, (ranked(*v) for v in variants.items()))
