"""Accountability analytics over AI agent runs, as Spark DataFrame jobs.

The names below are found where they live when they are first asked for, so importing the package alone loads nothing.
"""

from importlib import import_module

__version__ = "0.1.0"

_HOMES = {
    "operators.scan": ("Options", "Rule", "scan", "scan_named", "violations_of", "catalog_table", "unknown_names", "make_rule", "resolve_rules", "lite_violations"),
    "operators.verdict": ("evaluate", "check_input", "explain_allow", "explain_block", "explain_block_fully"),
    "operators.grounding": ("grounded_against",),
    "operators.flow": ("ran", "skipped", "with_lineage", "summaries", "hops", "ancestry", "numbered_steps", "observed"),
    "operators.context": ("index_of", "claims", "ungrounded"),
    "operators.entities": ("contradictions", "consistency", "contradiction_counts"),
    "operators.extension": ("ChatExplainer", "Explainer", "explained", "explained_blocks", "pandas_rule", "resolve_explainer", "safe_callback", "tell_stages", "with_approvals", "with_retry"),
    "functions.catalog": ("ALIASES", "BUNDLES", "RULES"),
}
_MODULES = {"entities": "operators", "context": "operators", "extension": "operators", "flow": "operators", "grounding": "operators", "report": "operators", "verdict": "operators", "catalog": "functions", "ledger": "sources", "rollup": "sources", "live": "streaming"}
__all__ = sorted([*_MODULES, *(name for names in _HOMES.values() for name in names)])


def __getattr__(name: str):
    if name in _MODULES:
        return import_module(f"{__name__}.{_MODULES[name]}.{name}")
    for home, names in _HOMES.items():
        if name in names:
            return getattr(import_module(f"{__name__}.{home}"), name)
    raise AttributeError(name)
