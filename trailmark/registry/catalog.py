"""All registered queries and oracles, merged from the per-family registries."""

from __future__ import annotations

from trailmark.registry import enrichments, io, models, parts, selfdescribing, validation


def all_queries():
    out = {}
    for mod in (models, parts, enrichments, io, validation, selfdescribing):
        out.update(mod.QUERIES)
    return out


def all_oracles():
    out = {}
    for mod in (models, parts, enrichments, io, validation, selfdescribing):
        out.update(mod.ORACLE)
    return out
