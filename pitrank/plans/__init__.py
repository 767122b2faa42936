"""Registered queries, by area; the registry comes first, as every module adds to it."""

from pitrank.plans import registry as registry
