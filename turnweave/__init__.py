"""turnweave: rule-graph analytics over multi-turn dialogues as Spark plans."""

__version__ = "0.1.0"
