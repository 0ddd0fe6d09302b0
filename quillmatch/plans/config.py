"""Search settings with their clamps; a missing or broken file gives the defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import K


@dataclass(frozen=True)
class SearchConfig:
    """Caps and weights. A cap of 0 for ``max_df_sum`` means no budget of its own."""

    k: int = K
    min_doc_tokens: int = 8
    alpha: float = 0.60
    weight: float = 0.90
    fetch: int = 64
    max_candidates: int = 1000
    max_df: int = 200_000
    max_terms: int = 4096
    max_df_sum: int = 2_000_000
    hard_df_sum: int = 20_000_000
    plagiarism: float = 0.70
    partial: float = 0.30
    rare_terms: int = 256
    top_k: int = 10
    extra: dict = field(default_factory=dict, compare=False)

    def clamped(self, profile: str) -> SearchConfig:
        """Hard limits of the profile: M (one index) has ceilings, G (segments) has floors."""
        if profile == "M":
            return replace(
                self,
                top_k=min(max(self.top_k, 1), 2000), fetch=min(max(self.fetch, 1), 8192), max_candidates=min(max(self.max_candidates, 1), 2_000_000),
                max_df=max(self.max_df, 1), max_terms=min(max(self.max_terms, 1), 200_000), max_df_sum=min(max(self.max_df_sum, 0), 500_000_000),
            )
        if profile != "G":
            raise ValueError("profile is M or G")
        budget = self.max_df_sum if self.max_df_sum > 0 else max(self.hard_df_sum, 1_000_000)
        return replace(self, fetch=max(self.fetch, 1), max_candidates=max(self.max_candidates, 1), max_df=max(self.max_df, 1), max_terms=max(self.max_terms, 128), max_df_sum=budget)

    @classmethod
    def from_dict(cls, raw: dict) -> SearchConfig:
        """Settings from the nested form {w_min_doc, weights{alpha, w9}, thresholds{...}, ...}."""
        out, weights, limits = {}, raw.get("weights") or {}, raw.get("thresholds") or {}
        names = {"min_doc_tokens": "w_min_doc", "fetch": "fetch_per_k_doc", "max_candidates": "max_cands_doc", "max_df": "max_df_for_seed", "max_terms": "max_q_uniq9", "max_df_sum": "max_sum_df_seeds"}
        for ours, theirs in names.items():
            if isinstance(raw.get(theirs), int):
                out[ours] = raw[theirs]
        for ours, group, theirs in (("alpha", weights, "alpha"), ("weight", weights, "w9"), ("plagiarism", limits, "plag_thr"), ("partial", limits, "partial_thr")):
            if isinstance(group.get(theirs), int | float):
                out[ours] = min(1.0, max(0.0, float(group[theirs])))
        known = {*names.values(), "weights", "thresholds"}
        return cls(**out, extra={k: v for k, v in raw.items() if k not in known})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SearchConfig:
        """Settings from a JSON file on any store that Spark reads."""
        try:
            return cls.from_dict(json.loads(spark.read.text(path, wholetext=True).first()[0]))
        except Exception:  # noqa: BLE001  missing, unreadable or not JSON: the defaults
            return cls()

    def as_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, json.dumps(v)) for k, v in asdict(self).items()], "name string, value string")
