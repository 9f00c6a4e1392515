"""Loads every module that registers queries."""

from linkweave.plans import q_evidence, q_io, q_network, q_pairs, q_training  # noqa: F401
from linkweave.plans.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark, sf_dir):
    """The trained network."""
    return QUERIES["m27_train_network"](spark, sf_dir)
